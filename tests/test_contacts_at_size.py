"""Clashes and RNAView's lines: nothing broadcast, cells against all pairs, one match per line."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.operators import spatial
from tests.oracle import DATA


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_clashes_broadcast_nothing(spark):
    """Tables whose files are small were broadcast with all their atoms."""
    plan = catalog.QUERIES["clash_pairs"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


@pytest.mark.parametrize("whole", [None, "f = 'y'"])
def test_contacts_in_cells(spark, whole):
    rng = random.Random(8)
    rows = [(f, 10 * k + n, [rng.choice((-3.0, 0.0, 0.5, 1.0, 2.0, rng.uniform(-4, 4))) for _ in range(3)], f"{f}{k}") for n, f in enumerate("xyz") for k in range(60)]
    df = spark.createDataFrame(rows, "f string, id long, p array<double>, name string")
    got = spatial.contact_join(df, 1.0, within=("f",), carried=("name",), whole=F.expr(whole) if whole else None).collect()
    want = {(a[0], a[1], b[1], a[3], b[3]) for a, b in itertools.permutations(rows, 2) if a[0] == b[0] and a[1] < b[1] and sum((x - y) ** 2 for x, y in zip(a[2], b[2])) ** 0.5 <= 1.0}
    assert len(got) == len(want) and {(r.f, r.id_1, r.id_2, r.name_1, r.name_2) for r in got} == want


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
def test_rnaview_matches_a_line_once(spark):
    plan = catalog.QUERIES["adapter_rnaview"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|(stacked))") == 1
