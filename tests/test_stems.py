"""Pseudoknot orders against enumeration, and pairs of stems."""

import itertools
import math
import random

from helixframe.operators import stems


def crossing(a, b):
    return a[0] < b[0] < a[1] < b[1] or b[0] < a[0] < b[1] < a[1]


def value(items, order):
    return sum(s[2] if o == 0 else -o * s[2] for s, o in zip(items, order))


def test_best_orders():
    rng = random.Random(1)
    for _ in range(60):
        ends = rng.sample(range(100), 12)
        items = [(*sorted(ends[2 * k : 2 * k + 2]), rng.randint(1, 6)) for k in range(6)]
        got = stems.best_orders(items)
        legal = [o for o in itertools.product(range(4), repeat=6) if not any(o[a] == o[b] and crossing(items[a], items[b]) for a, b in itertools.combinations(range(6), 2))]
        assert tuple(got) in set(legal) and value(items, got) == max(value(items, o) for o in legal)


def test_frames(spark):
    df = spark.createDataFrame([("x", 1, 20, 3), ("x", 10, 30, 5), ("y", 1, 9, 2)], "id string, i int, j int, length long")
    assert {(r.id, r.i): r.order for r in stems.orders_best(df).collect()} == {("x", 1): 1, ("x", 10): 0, ("y", 1): 0}
    turn = math.radians(32.7)
    axes = [("x", 1, [0.0, 1.0, 0.0], [0.0, 0.0, 0.0]), ("x", 2, [5.0, 0.0, 0.0], [5.0, math.cos(turn), math.sin(turn)])]
    r = stems.stem_pairs(spark.createDataFrame(axes, "id string, stem int, first array<double>, last array<double>")).first()
    assert math.isclose(r.gap, 5.0) and math.isclose(abs(r.torsion), turn) and math.isclose(r.coaxial, 1.0)


def test_orders_of_large_groups(spark):
    """Where the exact search does not end, orders are still legal, better than its first ones, and marked."""
    rng = random.Random(7)
    ends = rng.sample(range(1000), 120)
    items = [(*sorted(ends[2 * k : 2 * k + 2]), rng.randint(1, 9)) for k in range(60)]
    # The search alone ends at -939 here.
    df = spark.createDataFrame([("x", *s) for s in items] + [("y", 1, 20, 3), ("y", 10, 30, 5)], "id string, i int, j int, length long")
    got = stems.orders_best(df).collect()
    assert {r.id: r.proven for r in got} == {"x": False, "y": True}
    large = [r for r in got if r.id == "x"]
    assert len(large) == 60 and not any(a.order == b.order and crossing((a.i, a.j), (b.i, b.j)) for a, b in itertools.combinations(large, 2))
    assert value([(r.i, r.j, r.length) for r in large], [r.order for r in large]) > -850


def test_peel_finds_the_heaviest_level():
    rng = random.Random(2)
    for _ in range(60):
        items = [(*sorted(rng.sample(range(14), 2)), rng.randint(1, 6)) for _ in range(8)]
        found = stems._peel(items, list(range(8)))
        sets = [c for n in range(9) for c in itertools.combinations(range(8), n) if not any(crossing(items[a], items[b]) for a, b in itertools.combinations(c, 2))]
        assert sum(items[s][2] for s in found if found[s] == 0) == max(sum(items[s][2] for s in c) for c in sets)
        assert not any(found[a] == found[b] and crossing(items[a], items[b]) for a, b in itertools.combinations(range(8), 2))


def test_inter_stem_parameters(spark):
    """Types, torsions and densities of pairs of stems against numpy."""
    import numpy as np

    from helixframe.operators import stems as operators

    rng = np.random.default_rng(2)
    rows = [("a", k, rng.normal(size=(4, 3)).cumsum(axis=0).tolist()) for k in range(4)] + [("a", 9, [[0.0, 0.0, 0.0]])]
    out = operators.inter_stem_parameters(spark.createDataFrame(rows, "id string, stem int, centroids array<array<double>>")).collect()
    assert len(out) == 6
    for r in out:
        a, b = (np.array(rows[k][2]) for k in (r.stem_1, r.stem_2))
        ways = {"cs55": (a[1], a[0], b[0], b[1], 147.3), "cs53": (a[1], a[0], b[-1], b[-2], -32.7), "cs35": (a[-2], a[-1], b[0], b[1], 32.7), "cs33": (a[-2], a[-1], b[-1], b[-2], 212.7)}
        kind = min(ways, key=lambda w: np.linalg.norm(ways[w][1] - ways[w][2]))
        p, q, s, t, mu = ways[kind]
        left, right = np.cross(q - p, s - q), np.cross(s - q, t - s)
        turn = np.arctan2(np.linalg.norm(s - q) * (q - p) @ right, left @ right)
        gap = np.linalg.norm(q - s)
        near = 1 / (1 + np.exp(-5 * (gap - 3))) / (1 + np.exp(5 * (gap - 7)))
        spread = np.exp(10 * np.cos(turn - np.radians(mu))) / (2 * np.pi * np.i0(10))
        assert r.type == kind and np.allclose([r.gap, r.torsion, r.torsion_density, r.distance_density], [gap, np.degrees(turn), spread, near])
        assert np.isclose(r.coaxial, near * np.exp(10 * (np.cos(turn - np.radians(mu)) - 1)))
