"""helixframe: a PySpark-native engine for nucleic-acid structure analytics and corpus preparation."""

__version__ = "0.1.0"
