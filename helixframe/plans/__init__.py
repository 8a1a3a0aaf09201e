"""Plan helpers shared by the operators: shared storage, shipping of code, graph components."""
