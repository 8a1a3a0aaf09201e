"""Pseudoknot orders by search, and geometry of pairs of stems."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.functions import geometry
from helixframe.functions.circular import wrap

#: Steps of the exact search per group of crossing stems; beyond them orders are peeled and annealed.
STEPS = 200_000
#: Moves of the annealing, its first temperature and the seeds of its runs.
MOVES, MOVES_PER_STEM, HEAT, SEEDS = 40_000, 200, 2.0, (0, 1, 2)
#: Torsions of coaxial stems in degrees, concentration of their spread, and ends that lie close in angstrom.
HELICAL, KAPPA, CLOSE, WIDTH = 32.7, 10.0, 10.0, 5.0


def best_orders(stems: list[tuple[int, int, int]], steps: int = STEPS) -> list[int]:
    """An order for each stem (first i, last j, length); no two crossing stems share one. See :func:`proven_orders`."""
    return proven_orders(stems, steps)[0]


def proven_orders(stems: list[tuple[int, int, int]], steps: int = STEPS) -> tuple[list[int], list[bool]]:
    """Orders, and for each stem whether those of its group of crossing stems are proven to be the best.

    Maximal: lengths in order 0 less the length times the order elsewhere. Each group is searched by branch and bound,
    stems with the most conflicts first. Where that does not end in ``steps``, orders are peeled off one by one as the
    heaviest stems that do not cross, then annealed; the better of both results stands.
    """
    n = len(stems)
    crosses = [[b for b in range(n) if b != a and (stems[a][0] < stems[b][0] < stems[a][1] < stems[b][1] or stems[b][0] < stems[a][0] < stems[b][1] < stems[a][1])] for a in range(n)]
    order, proven = [0] * n, [True] * n
    seen: set[int] = set()
    for start in range(n):
        if start in seen or not crosses[start]:
            continue
        group, todo = [], [start]
        seen.add(start)
        while todo:
            at = todo.pop()
            group.append(at)
            new = [x for x in crosses[at] if x not in seen]
            seen.update(new)
            todo.extend(new)
        group.sort(key=lambda s: (-stems[s][2], -len(crosses[s]), stems[s]))
        found, ended = _search(stems, crosses, group, steps)
        if not ended:
            peeled = _peel(stems, group)
            tries = [found, peeled, *(_anneal(stems, crosses, group, peeled, seed) for seed in SEEDS)]
            found = max(tries, key=lambda f: sum(_gain(stems[s][2], f[s]) for s in group))
        for stem in group:
            order[stem], proven[stem] = found[stem], ended
    return order, proven


def _gain(length: int, level: int) -> int:
    return -level * length if level else length


def _search(stems: list, crosses: list[list[int]], group: list[int], steps: int) -> tuple[dict[int, int], bool]:
    """The best orders that branch and bound finds in ``steps``, at least the first ones, and whether it came to its end."""
    left = [sum(stems[s][2] for s in group[k:]) for k in range(len(group) + 1)]
    best_value, best, now, values, count = -math.inf, {}, {}, [0], 0
    levels: list = []

    def free(stem: int):
        taken = {now[x] for x in crosses[stem] if x in now}
        return iter([level for level in range(len(crosses[stem]) + 1) if level not in taken])

    levels.append(free(group[0]))
    while levels:
        k = len(levels) - 1
        now.pop(group[k], None)
        level = next(levels[-1], None)
        if level is None:
            levels.pop()
            values.pop()
            continue
        count += 1
        if count > steps and best:
            return best, False
        value = values[-1] + _gain(stems[group[k]][2], level)
        if value + left[k + 1] <= best_value:
            continue
        now[group[k]] = level
        if k + 1 == len(group):
            best_value, best = value, dict(now)
        else:
            values.append(value)
            levels.append(free(group[k + 1]))
    return best, True


def _peel(stems: list, group: list[int]) -> dict[int, int]:
    """Order 0 for the heaviest set of stems of which none cross, by intervals; order 1 for that of the rest, and so on."""
    found: dict[int, int] = {}
    rest, level = list(group), 0
    while rest:
        # Ends that fall together do not cross: closing before opening, and stems of the same end nested.
        ends = sorted([(stems[s][0], 1, -stems[s][1], k, s) for k, s in enumerate(rest)] + [(stems[s][1], 0, -stems[s][0], -k, s) for k, s in enumerate(rest)])
        place: dict[int, list[int]] = {}
        for at, end in enumerate(ends):
            place.setdefault(end[4], []).append(at)
        n = len(ends)
        closing, weight = [0] * n, [0] * n
        for s, (i, j) in place.items():
            closing[i], weight[i] = j, stems[s][2]
        best = np.zeros((n + 1, n + 1), dtype=np.int64)  # of the ends from i up to, not with, j
        for i in range(n - 1, -1, -1):
            best[i] = best[i + 1]
            if closing[i]:
                j = closing[i]
                best[i, j + 1 :] = np.maximum(best[i, j + 1 :], weight[i] + best[i + 1, j] + best[j + 1, j + 1 :])
        todo, taken = [(0, n)], set()
        while todo:
            i, j = todo.pop()
            while i < j and best[i, j] == best[i + 1, j]:
                i += 1
            if i < j:
                taken.add(ends[i][4])
                todo += [(i + 1, closing[i]), (closing[i] + 1, j)]
        found.update(dict.fromkeys(taken, level))
        rest, level = [s for s in rest if s not in taken], level + 1
    return found


def _anneal(stems: list, crosses: list[list[int]], group: list[int], start: dict[int, int], seed: int) -> dict[int, int]:
    """Orders by swaps of two orders along a chain of crossing stems, ever less often for the worse; the best ones seen."""
    rng = random.Random(seed)
    now, best = dict(start), dict(start)
    value = best_value = 0
    count = max(MOVES, MOVES_PER_STEM * len(group))
    for move in range(count):
        heat = HEAT * (1 - move / count)
        first = rng.choice(group)
        if move % 50 == 0:
            top = max(now.values()) + 1
        a, b = now[first], rng.randint(0, top)
        if a == b:
            continue
        chain, todo = {first}, [first]
        while todo:
            for x in crosses[todo.pop()]:
                if x not in chain and now[x] in (a, b):
                    chain.add(x)
                    todo.append(x)
        change = sum(_gain(stems[s][2], b if now[s] == a else a) - _gain(stems[s][2], now[s]) for s in chain)
        if change >= 0 or rng.random() < math.exp(change / heat):
            for s in chain:
                now[s] = b if now[s] == a else a
            value += change
            if value > best_value:
                best_value, best = value, dict(now)
    return best


def orders_best(stems: DataFrame) -> DataFrame:
    """(id, i, j, length, order, proven) of (id, i, j, length): see :func:`proven_orders`."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i")
        order, proven = proven_orders(list(pdf[["i", "j", "length"]].itertuples(index=False, name=None)))
        return pdf.assign(order=order, proven=proven)

    return stems.select("id", "i", "j", "length").groupBy("id").applyInPandas(run, "id string, i int, j int, length long, order int, proven boolean")


def coaxial(torsion: Column, gap: Column) -> Column:
    """Likelihood from 0 to 1 that two stems stack end to end, from the torsion (radians) and the distance of their ends."""
    spread = [F.exp(KAPPA * (F.cos(torsion - math.radians(m)) - 1)) for m in (-180 + HELICAL, -HELICAL, HELICAL, 180 - HELICAL)]
    return F.greatest(*spread) * geometry.plateau(gap, 0.0, CLOSE, WIDTH)


def stem_pairs(axes: DataFrame) -> DataFrame:
    """(id, stem_1, stem_2, gap, torsion, coaxial) of (id, stem, first, last): ends of stems as points.

    The nearest two ends face each other; the torsion runs over far end, near end, near end, far end.
    """
    one, two = [axes.select("id", F.col("stem").alias(f"stem_{k}"), F.array(F.struct(F.col("first").alias("near"), F.col("last").alias("far")), F.struct(F.col("last").alias("near"), F.col("first").alias("far"))).alias(f"e{k}")) for k in (1, 2)]
    pairs = one.join(two, "id").where("stem_1 < stem_2")
    choices = F.flatten(F.transform("e1", lambda a: F.transform("e2", lambda b: F.struct(geometry.distance(a["near"], b["near"]).alias("gap"), a.alias("a"), b.alias("b")))))
    best = pairs.withColumn("m", F.array_min(choices))
    torsion = wrap(geometry.torsion(F.col("m.a.far"), F.col("m.a.near"), F.col("m.b.near"), F.col("m.b.far")))
    return best.withColumn("torsion", torsion).select("id", "stem_1", "stem_2", F.col("m.gap").alias("gap"), "torsion", coaxial(F.col("torsion"), F.col("m.gap")).alias("coaxial"))


#: The four ways in which ends of two stems can lie nearest: its name, whether the ends are last ones, and the torsion in
#: degrees of coaxial stems.
ENDS = (("cs55", False, False, 180 - HELICAL), ("cs53", False, True, -HELICAL), ("cs35", True, False, HELICAL), ("cs33", True, True, 180 + HELICAL))
#: Ends of coaxial stems are so far apart, in angstrom; steepness of the edges of that range.
NEAR, STEEP = (3.0, 7.0), 5.0


def end_distance_density(gap: Column, low: float = NEAR[0], high: float = NEAR[1], steep: float = STEEP) -> Column:
    """Product of a rising and a falling sigmoid: near 1 between the bounds, near 0 elsewhere."""
    rising = 1 / (1 + F.exp(F.least(-steep * (gap - low), F.lit(700.0))))
    falling = 1 / (1 + F.exp(F.least(steep * (gap - high), F.lit(700.0))))
    return rising * falling


def torsion_density(torsion: Column, centre: Column) -> Column:
    """Von Mises density of a torsion (radians) around a centre."""
    return F.exp(KAPPA * F.cos(torsion - centre)) / F.lit(float(2 * math.pi * np.i0(KAPPA)))


def pair_centroid(points: Column) -> Column:
    """Mean of the points (an array) of a base pair."""
    return F.when(F.size(points) > 0, F.array(*[F.aggregate(points, F.lit(0.0), lambda s, p, k=k: s + p[k]) / F.size(points) for k in range(3)]))


def inter_stem_parameters(stems: DataFrame) -> DataFrame:
    """(id, stem_1, stem_2, type, gap, torsion, torsion_density, distance_density, coaxial) of (id, stem, centroids).

    centroids: points of a stem's pairs in order; stems of one pair are left out. The type names the nearest two ends,
    the first of equals. The torsion (degrees) runs over the second and the outer centroid of each. coaxial is the product
    of both densities as shares of their maxima.
    """
    long = stems.where(F.size("centroids") > 1)
    one, two = [long.select("id", F.col("stem").alias(f"stem_{k}"), F.col("centroids").alias(f"c{k}")) for k in (1, 2)]
    at = lambda c, k: F.element_at(c, k)
    outer = lambda c, last: at(c, -1) if last else at(c, 1)
    inner = lambda c, last: at(c, -2) if last else at(c, 2)
    c1, c2 = F.col("c1"), F.col("c2")
    ways = [F.struct(geometry.distance(outer(c1, a), outer(c2, b)).alias("gap"), F.lit(k).alias("k"), F.lit(name).alias("type"), F.lit(math.radians(mu)).alias("mu"), inner(c1, a).alias("p"), outer(c1, a).alias("q"), outer(c2, b).alias("r"), inner(c2, b).alias("s")) for k, (name, a, b, mu) in enumerate(ENDS)]
    pairs = one.join(two, "id").where("stem_1 < stem_2").withColumn("w", F.array_min(F.array(*ways)))
    pairs = pairs.withColumn("t", geometry.torsion(F.col("w.p"), F.col("w.q"), F.col("w.r"), F.col("w.s")))
    near = end_distance_density(F.col("w.gap"))
    share = F.exp(KAPPA * (F.cos(F.col("t") - F.col("w.mu")) - 1))
    return pairs.select("id", "stem_1", "stem_2", "w.type", "w.gap", F.degrees("t").alias("torsion"), torsion_density(F.col("t"), F.col("w.mu")).alias("torsion_density"), near.alias("distance_density"), (share * near).alias("coaxial"))
