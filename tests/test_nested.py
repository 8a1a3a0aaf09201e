"""Brackets, orders and elements inside rows against plain Python, and plans in which no row meets another one."""

import os
import random

import pytest
from pyspark.sql import functions as F

from helixframe import catalog
from helixframe.operators import secondary
from tests.oracle import DATA

ROW_BY_ROW = ("bracket_round_trip", "pseudoknot_first_come", "hairpin_elements", "bracket_pairs", "without_isolated_pairs", "stems_of_brackets", "bpseq_lines")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables are not here")
@pytest.mark.parametrize("name", ROW_BY_ROW)
def test_structures_stay_in_their_rows(spark, name):
    plan = catalog.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "FlatMapGroups" not in plan


def plain_pairs(text):
    open_, out = {}, []
    for p, c in enumerate(text or "", 1):
        if c in secondary.OPENING:
            open_.setdefault(secondary.OPENING.index(c), []).append(p)
        elif c in secondary.CLOSING and open_.get(secondary.CLOSING.index(c)):
            out.append((open_[secondary.CLOSING.index(c)].pop(), p))
    return sorted(out)


def plain_orders(pairs):
    """The pairs of each order as placed so far; a stem asks all pairs that are no part of it."""
    placed, order, out = [], 0, []
    for k, (i, j) in enumerate(pairs):
        if not k or pairs[k - 1] != (i - 1, j + 1):
            order = next((n for n, level in enumerate(placed) if not any(a < i < b < j for a, b in level)), len(placed))
            if order == len(placed):
                placed.append([])
        placed[order].append((i, j))
        out.append((i, j, order))
    return out


def structures(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("..(((())))[[]]{}Aa") for _ in range(rng.randint(0, 60))) for _ in range(300)]
    rows = list(enumerate([*texts, None, "", ")(", "é(..)", "(" * 3000 + ")" * 3000]))
    return rows, spark.createDataFrame(rows, "id int, structure string").withColumn("sequence", F.translate("structure", "()[]{}Aa", "GCAUGCAU"))


def test_brackets_of_odd_texts(spark):
    rows, df = structures(spark)
    pairs = {r.id: [tuple(p) for p in r.p] for r in df.select("id", secondary.pairs_in(F.col("structure")).alias("p")).collect()}
    assert pairs == {k: plain_pairs(t) for k, t in rows}
    ordered = {}
    for r in secondary.orders_first_come(secondary.pairs_of(df)).collect():
        ordered.setdefault(r.id, []).append((r.i, r.j, r.order))
    assert ordered == {k: plain_orders(p) for k, p in pairs.items() if p}
    assert secondary.bpseq_of(df).where("pair > 0").count() == 2 * sum(map(len, pairs.values()))
    nested = df.select("id", "structure", secondary.pairs_in(F.col("structure")).alias("p"))
    for flat, inside in ((secondary.without_isolated, secondary.without_isolated_in), (secondary.stems_of, secondary.stems_in)):
        assert sorted(map(tuple, flat(secondary.pairs_of(df)).collect())) == sorted((r.id, *r.s) for r in nested.select("id", F.explode(inside(F.col("p"))).alias("s")).collect())
    text = secondary.dot_bracket_in(F.length("structure"), secondary.orders_in(F.col("p")))
    written = {r.id: r.t for r in nested.where("structure is not null").select("id", text.alias("t")).collect()}
    assert all(plain_pairs(written[k]) == pairs[k] and len(written[k]) == len(t) for k, t in rows if t is not None)


def test_elements_of_odd_texts(spark):
    _, df = structures(spark)
    flat = secondary.elements_of(secondary.bpseq_of(df)).collect()
    nested = df.select("id", F.explode(secondary.elements_in(secondary.partners_in(F.col("structure")))).alias("e")).select("id", "e.*").collect()
    key = lambda r: (r.id, r.kind, [tuple(s) for s in r.strands])
    assert flat and sorted(map(key, flat)) == sorted(map(key, nested))
