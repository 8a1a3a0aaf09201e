"""Representatives and clusters of ensembles: features, radius graphs, knees, silhouettes, cluster records."""

from __future__ import annotations

import heapq
import json
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.operators import clusters, spatial
from helixframe.plans.components import connected_components
from helixframe.plans.storage import discard, materialize

#: Four atoms of each base that features are made of, by kind.
PURINE_FOUR, PYRIMIDINE_FOUR = ("N9", "N3", "N1", "C5"), ("N1", "O2", "N3", "C5")
PURINES, PYRIMIDINES = ("A", "G", "DA", "DG"), ("C", "U", "DC", "DT")


def four_atoms(name: Column, atoms: Column) -> Column:
    """The four points of a base (null where missing); other names as a purine where that is whole, else a pyrimidine."""
    pick = lambda names: F.array(*[F.try_element_at(atoms, F.lit(n)) for n in names])
    purine, pyrimidine = pick(PURINE_FOUR), pick(PYRIMIDINE_FOUR)
    whole = ~F.exists(purine, lambda p: p.isNull())
    return F.when(name.isin(*PURINES), purine).when(name.isin(*PYRIMIDINES), pyrimidine).when(whole, purine).otherwise(pyrimidine)


def pair_features(points: np.ndarray) -> np.ndarray:
    """34 numbers for each pair of residues of (n, 4, 3) points, NaN where missing: 16 distances, then sine and cosine of
    the 9 torsions over an atom of each side between the first atoms; missing ones are 0, and 0 and 1."""
    i, j = np.triu_indices(len(points), 1)
    if not len(i):
        return np.zeros(0, np.float32)
    a, b = points[i], points[j]
    far = np.nan_to_num(np.linalg.norm(a[:, :, None, :] - b[:, None, :, :], axis=3).reshape(len(i), 16))
    shape = (len(i), 3, 3, 3)
    start, end = np.broadcast_to(a[:, None, None, 0], shape), np.broadcast_to(b[:, None, None, 0], shape)
    inner, outer = np.broadcast_to(a[:, 1:, None], shape), np.broadcast_to(b[:, None, 1:], shape)
    first, middle, last = inner - start, outer - inner, end - outer
    left, right = np.cross(first, middle), np.cross(middle, last)
    with np.errstate(invalid="ignore", divide="ignore"):
        turn = -np.arctan2(np.linalg.norm(middle, axis=3) * (first * right).sum(axis=3), (left * right).sum(axis=3))
        flat = (np.linalg.norm(left, axis=3) == 0) | (np.linalg.norm(right, axis=3) == 0)
    turn[flat] = np.nan
    both = np.stack([np.where(np.isnan(turn), 0.0, np.sin(turn)), np.where(np.isnan(turn), 1.0, np.cos(turn))], axis=3).reshape(len(i), 18)
    return np.hstack([far, both]).astype(np.float32).ravel()


def featurize(residues: DataFrame) -> DataFrame:
    """(id, v): the features of each structure from its residues (id, place, residue_name, atoms); one task per structure."""
    rows = residues.select("id", "place", four_atoms(F.col("residue_name"), F.col("atoms")).alias("four"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        points = np.array([[[math.nan] * 3 if p is None else list(p) for p in four] for four in pdf["four"]], float).reshape(-1, 4, 3)
        return pd.DataFrame({"id": [pdf["id"].iloc[0]], "v": [pair_features(points)]})

    return rows.groupBy("id").applyInPandas(run, f"id {dict(residues.dtypes)['id']}, v array<float>")


def unequal_sizes(residues: DataFrame) -> DataFrame:
    """(id, n) of structures whose number of residues is not the most common one; empty if all can be compared."""
    sizes = residues.groupBy("id").agg(F.count("*").alias("n"))
    usual = sizes.groupBy("n").agg(F.count("*").alias("_c")).agg(F.max_by("n", F.struct("_c", "n")).alias("_usual"))
    return sizes.join(F.broadcast(usual)).where("n <> _usual").select("id", "n")  # one row is broadcast


def check_options(*, exact: bool, method: str, threshold: float | None = None, radius: float | None = None, neighbours: int | None = None, count: int | None = None) -> None:
    """Raise ValueError for options that contradict each other."""
    methods = ("hierarchical", "affinity-propagation", "facility-location") if exact else ("hierarchical", "facility-location", "radius-graph")
    if method not in methods:
        raise ValueError(f"{method} is no method of the {'exact' if exact else 'approximate'} mode: {', '.join(methods)}")
    if threshold is not None and (not exact or method != "hierarchical"):
        raise ValueError("a threshold needs the exact hierarchical method")
    if radius is not None and (exact or method == "facility-location"):
        raise ValueError("a radius needs the approximate hierarchical or radius-graph method")
    if neighbours is not None and method != "radius-graph" and exact:
        raise ValueError("neighbours need the approximate mode")
    if count is not None and method != "facility-location":
        raise ValueError("a number of representatives needs facility location")
    for name, value in (("threshold", threshold), ("radius", radius), ("neighbours", neighbours), ("count", count)):
        if value is not None and value < (0 if name in ("threshold", "radius") else 1):
            raise ValueError(f"{name} is too small: {value}")


def minimum_forest(edges: DataFrame, fan: int = 8, part_rows: int = 500_000) -> DataFrame:
    """(a, b, d) of a forest of shortest edges that connects what the edges connect; of equal lengths the smaller ids first.

    Each task keeps the forest of its part, and ``fan`` parts merge in each round: what no part needs, the whole does not
    need. A task holds at most ``fan`` times as many edges as there are nodes.
    """
    parts = max(1, math.ceil(edges.count() / part_rows))

    def kruskal(table: pa.Table) -> pa.Table:
        a, b, d = (np.asarray(table[c]) for c in "abd")
        order = np.lexsort((b, a, d))
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        keep = []
        for k, x, y in zip(order.tolist(), a[order].tolist(), b[order].tolist()):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep.append(k)
        return table.select(["a", "b", "d"]).take(pa.array(keep, pa.int64()))

    now = edges.select(F.least("a", "b").cast("long").alias("a"), F.greatest("a", "b").cast("long").alias("b"), F.col("d").cast("double")).where("a <> b").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts)))
    while True:
        forest = now.groupBy("part").applyInArrow(kruskal, "a long, b long, d double")
        if parts == 1:
            return forest
        forest, parts = materialize(forest, "forest"), math.ceil(parts / fan)
        now = forest.withColumn("part", F.pmod(F.xxhash64("a", "b"), F.lit(parts)))


def radius_candidates(edges: DataFrame, n: int) -> DataFrame:
    """(value, n_clusters): for each distinct edge length the number of components of the edges up to it, of n nodes."""
    forest = minimum_forest(edges).groupBy(F.col("d").alias("value")).agg(F.count("*").alias("joined"))
    lengths = edges.select(F.col("d").cast("double").alias("value")).distinct().join(forest, "value", "left")
    running = F.sum(F.coalesce("joined", F.lit(0))).over(Window.orderBy("value").rowsBetween(Window.unboundedPreceding, 0))
    return lengths.select("value", (F.lit(n) - running).alias("n_clusters"))


def radius_clusters(points: DataFrame, edges: DataFrame, radius: float) -> DataFrame:
    """(id, group): components of the edges (a, b, d) up to the radius; the group is its least id."""
    found = connected_components(edges.where(F.col("d") <= radius + 1e-12).select("a", "b"))
    return points.select("id").join(found, F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("group"))


def decay(x: np.ndarray, a: float, b: float, c: float) -> np.ndarray:
    return a * np.exp(-b * x) + c


def fit_decay(x: np.ndarray, y: np.ndarray, rounds: int = 500) -> tuple[float, float, float] | None:
    """a, b, c of y = a exp(-b x) + c by damped least squares from (max - min, 1, min); None where it does not settle."""
    p, damp = np.array([y.max() - y.min(), 1.0, y.min()], float), 1e-3
    with np.errstate(over="ignore", invalid="ignore"):
        error = ((decay(x, *p) - y) ** 2).sum()
        for _ in range(rounds):
            e = np.exp(-p[1] * x)
            slopes = np.stack([e, -p[0] * x * e, np.ones_like(x)], axis=1)
            normal, side = slopes.T @ slopes, slopes.T @ (y - decay(x, *p))
            if not np.isfinite(normal).all():
                return None
            step = np.linalg.lstsq(normal + damp * np.diag(np.diag(normal) + 1e-12), side, rcond=None)[0]
            new = ((decay(x, *(p + step)) - y) ** 2).sum()
            if np.isfinite(new) and new <= error:
                small = error - new <= 1e-14 * (error + 1e-300) and np.abs(step).max() <= 1e-10 * (np.abs(p).max() + 1e-10)
                p, error, damp = p + step, new, max(damp / 10, 1e-12)
                if small or error == 0:
                    break
            else:
                damp *= 10
                if damp > 1e12:
                    break
    return tuple(map(float, p)) if np.isfinite(p).all() else None


def knees(x: np.ndarray, y: np.ndarray) -> list[float]:
    """Places where a falling curve turns flat: 1/b of the fit, and the inner point of strongest curvature.

    Both only in the inner 80 % of the range, the second only if apart from the first; none for fewer than four points.
    """
    if len(x) < 4:
        return []
    order = np.argsort(x, kind="stable")
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    fit = fit_decay(x, y)
    if fit is None:
        return []
    a, b, _ = fit
    span = x[-1] - x[0]
    inner = lambda v: x[0] + 0.1 * span <= v <= x[-1] - 0.1 * span
    found = [1 / b] if b > 0 and inner(1 / b) else []
    grid = np.linspace(x[0], x[-1], 200)
    bend = (a * b * b * np.exp(-b * grid))[20:-20]
    top = float(grid[20 + int(np.argmax(bend))])
    if inner(top) and (not found or abs(top - found[0]) > 0.05 * span):
        found.append(top)
    return [float(v) for v in found]


def best_value(x: np.ndarray, y: np.ndarray, fallback: float) -> float:
    """The first knee of the curve, else the fallback."""
    return next(iter(knees(x, y)), fallback)


def cut_counts(merges: list[tuple[int, int, float]], n: int) -> list[tuple[float, int]]:
    """(height, clusters) of a dendrogram for each distinct merge height."""
    heights = sorted(m[2] for m in merges)
    return [(h, n - k - 1) for k, h in enumerate(heights) if k + 1 == len(heights) or heights[k + 1] != h]


def leaf_order(merges: list[tuple[int, int, float]], n: int) -> list[int]:
    """Items in the order of the dendrogram's leaves."""
    held = {i: [i] for i in range(n)}
    owner = list(range(n))
    for i, j, _ in merges:
        a, b = owner[i], owner[j]
        for x in held[b]:
            owner[x] = a
        held[a] += held.pop(b)
    return [x for a in sorted(held) for x in held[a]]


def silhouette(d: np.ndarray, labels: list[int]) -> float:
    """Mean silhouette of a distance matrix; members of clusters of one count 0."""
    labels = np.asarray(labels)
    names = np.unique(labels)
    sizes = np.array([(labels == k).sum() for k in names])
    sums = np.stack([d[:, labels == k].sum(axis=1) for k in names], axis=1)
    own = np.searchsorted(names, labels)
    rows = np.arange(len(labels))
    inner = sums[rows, own] / np.maximum(sizes[own] - 1, 1)
    means = sums / sizes
    means[rows, own] = np.inf
    outer = means.min(axis=1)
    most = np.maximum(inner, outer)
    values = np.where((sizes[own] > 1) & (most > 0), (outer - inner) / np.where(most > 0, most, 1), 0.0)
    return float(values.mean())


def best_cutoff(merges: list[tuple[int, int, float]], d: np.ndarray) -> tuple[float | None, list[dict]]:
    """The height with the best silhouette, the lowest of equals, and the curve by number of clusters."""
    curve = []
    for height, count in cut_counts(merges, len(d)):
        if 1 < count < len(d):
            curve.append({"value": height, "n_clusters": count, "silhouette_score": silhouette(d, clusters.cut(merges, len(d), height))})
    best = max(curve, key=lambda e: (e["silhouette_score"], -e["value"]), default=None) if len(d) > 2 else None
    return (best and best["value"]), sorted(curve, key=lambda e: e["n_clusters"])


def best_count(d: np.ndarray, ranking: list[int]) -> tuple[int | None, list[dict]]:
    """The number of ranked representatives with the best silhouette of their nearest members, the least of equals."""
    curve = []
    for k in range(2, min(len(ranking), len(d) - 1) + 1):
        labels = np.argmin(d[:, ranking[:k]], axis=1)
        count = len(np.unique(labels))
        if 1 < count < len(d):
            curve.append({"value": k, "n_clusters": count, "silhouette_score": silhouette(d, labels)})
    best = max(curve, key=lambda e: (e["silhouette_score"], -e["value"]), default=None)
    return (best and best["value"]), curve


def lazy_greedy(similarity: np.ndarray, count: int) -> tuple[list[int], list[float]]:
    """Facility location with a heap of stale gains: only what tops the heap is computed anew. Same picks as the plain one
    but for exact ties."""
    best = np.zeros(len(similarity))
    heap = [(-float(np.maximum(row, 0).sum()), k) for k, row in enumerate(similarity)]
    heapq.heapify(heap)
    picks, gains = [], []
    while heap and len(picks) < count:
        _, k = heapq.heappop(heap)
        gain = float(np.maximum(similarity[k] - best, 0).sum())
        if heap and (-gain, k) > heap[0]:
            heapq.heappush(heap, (-gain, k))
            continue
        picks.append(k)
        gains.append(gain)
        best = np.maximum(best, similarity[k])
    return picks, gains


def lazy_greedy_sparse(neighbours: list[dict[int, float]], count: int) -> tuple[list[int], list[float]]:
    """The same over stored similarities only; what is not stored counts 0."""
    best: dict[int, float] = {}
    gain_of = lambda k: sum(max(s - best.get(j, 0.0), 0.0) for j, s in neighbours[k].items())
    heap = [(-gain_of(k), k) for k in range(len(neighbours))]
    heapq.heapify(heap)
    picks, gains = [], []
    while heap and len(picks) < count:
        _, k = heapq.heappop(heap)
        gain = gain_of(k)
        if heap and (-gain, k) > heap[0]:
            heapq.heappush(heap, (-gain, k))
            continue
        picks.append(k)
        gains.append(gain)
        for j, s in neighbours[k].items():
            best[j] = max(best.get(j, 0.0), s)
    return picks, gains


def gain_curve(picks: DataFrame, gain: str = "gain", order: list | None = None) -> DataFrame:
    """``picks`` with the cumulative gain in the given order and what remains; as many rows as representatives."""
    order = order or [F.desc(gain)]
    window = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = picks.withColumn("cumulative", F.sum(gain).over(window))
    return rows.withColumn("remaining", F.sum(gain).over(Window.partitionBy()) - F.col("cumulative"))


def first_gains(vectors: DataFrame, round_to: int = 6) -> DataFrame:
    """(id, gain) of the first step of facility location: summed similarities 1 / (1 + d) to all other vectors."""
    return spatial.distance_sums(vectors, lambda d: 1 / (1 + d)).select("id", F.round("total", round_to).alias("gain"))


#: Vectors whose exact gains are computed against all others at once; they are sent to each task.
FINALISTS = 2000


def greatest_gains(vectors: DataFrame, round_to: int = 6) -> DataFrame:
    """Rows of :func:`first_gains`, with all that have the greatest gain among them.

    All pairs are summed once to bounds in single precision; exact sums follow for what the bounds leave, which is
    everything if that is more than ``FINALISTS``.
    """
    bounds = materialize(spatial.closeness_bounds(vectors), "gains")
    least = bounds.agg(F.max("low")).first()[0]
    left = bounds.where(F.col("high") >= (least or 0.0) - 4 * 10.0**-round_to).select("id")
    finalists = []
    if left.limit(FINALISTS + 1).count() <= FINALISTS:
        finalists = vectors.join(left, "id", "left_semi").select("id", "v").collect()
    discard(bounds)
    if not finalists:
        return first_gains(vectors, round_to)
    ids, x = np.array([r.id for r in finalists]), np.array([r.v for r in finalists], dtype=float)
    return spatial.sums_to(vectors, ids, x, lambda d: 1 / (1 + d)).select("id", F.round("total", round_to).alias("gain"))


def cluster_records(members: DataFrame) -> DataFrame:
    """(representative, members, size) of (id, group, representative), largest first, then by representative."""
    grouped = members.groupBy("representative").agg(F.sort_array(F.collect_list(F.when(F.col("id") != F.col("representative"), F.col("id")))).alias("members"), F.count("*").alias("size"))
    return grouped.orderBy(F.desc("size"), "representative")


def clustering_json(records: list[dict], *, mode: str, method: str, metric: str, selection: dict, diagnostics: dict | None = None, parameters: dict | None = None) -> str:
    """One result text: parameters, selection, clustering and diagnostics. records: representative and members."""
    records = sorted(records, key=lambda r: (-1 - len(r["members"]), r["representative"]))
    sizes = [1 + len(r["members"]) for r in records]
    return json.dumps({
        "parameters": {"mode": mode, "method": method, "distance_metric": metric, "n_structures": sum(sizes), **(parameters or {})},
        "selection": selection,
        "clustering": {"n_clusters": len(records), "cluster_sizes": sizes, "clusters": records},
        "diagnostics": diagnostics or {},
    })


def summary_lines(records: list[dict]) -> list[str]:
    """A clustering as lines of text."""
    lines = [f"{len(records)} clusters of {sum(1 + len(r['members']) for r in records)} structures"]
    return lines + [f"  {1 + len(r['members'])}: {r['representative']}" for r in records]


def exact_clusters(pairs: DataFrame, ids: list[int], cutoff: float | None = None) -> tuple[list[int], float]:
    """Labels by complete linkage and the cutoff used: the given one, else the knee of the counts, else the middle height."""
    if len(ids) < 2:
        return [0] * len(ids), 0.0
    d = clusters.distance_matrix(pairs, ids)
    merges = clusters.complete_linkage(d)
    if cutoff is None:
        curve = cut_counts(merges, len(ids))
        x, y = (np.array(v, float) for v in zip(*curve))
        cutoff = best_value(x, y, float(x[len(x) // 2]))
    return clusters.cut(merges, len(ids), cutoff), cutoff


def approximate_clusters(vectors: DataFrame, neighbours: int = 10, radius: float | None = None) -> tuple[DataFrame, float]:
    """(id, group) of the radius graph over nearest neighbours of (id, v), and the radius: the given one, else the
    candidate nearest to the knee of the cluster counts."""
    edges = materialize(spatial.nearest_edges(vectors, neighbours), "knn")
    if radius is None:
        curve = radius_candidates(edges, vectors.count()).orderBy("value").toArrow()  # one row per distinct length
        x, y = np.asarray(curve["value"], float), np.asarray(curve["n_clusters"], float)
        aim = best_value(x, y, float(x[len(x) // 2])) if len(x) else 0.0
        radius = float(x[np.argmin(np.abs(x - aim))]) if len(x) else 0.0
    return radius_clusters(vectors, edges, radius), radius


def facility_clusters(d: np.ndarray, count: int | None = None) -> tuple[list[int], list[int]]:
    """Representatives in order of choice and the nearest one of each item, by facility location on max(d) - d.

    count: how many; None: as many as the knee of the remaining gains says, at least one.
    """
    similarity = d.max(initial=0) - d
    np.fill_diagonal(similarity, 0)
    picks, gains = lazy_greedy(similarity, len(d) if count is None else count)
    if count is None:
        left = sum(gains) - np.cumsum(gains)
        picks = picks[: max(1, round(best_value(np.arange(1.0, len(gains) + 1), left, float((len(gains) + 1) // 2))))]
    return picks, [picks[k] for k in np.argmin(d[:, picks], axis=1)]
