"""Exact search for the k largest inner products by multi-resolution segment statistics.

A vector is cut into segments. Means and deviations of the segments bound the distance of two vectors from below by
sum(length * ((mean - mean')^2 + (deviation - deviation')^2)). As the squared norms are the sums of length * (mean^2 +
deviation^2), the same bound caps the inner product by sum(length * (mean * mean' + deviation * deviation')): one matrix
product for a block of pairs. Bounds go from whole groups of vectors (boxes around their statistics) over few segments to
many; the values of the pairs that are left are computed exactly.

1. A tree fitted on a bounded sample deals all vectors into leaves of similar statistics, and leaves into parts.
2. Each part meets the queries among its own vectors: that gives every query a floor for its k-th score.
3. Leaves whose box cannot reach a query's floor are left out; the other parts meet the query.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.vectors import matrix
from helixframe.plans.storage import discard, materialize

LEVELS = (2, 8, 32)
#: The level whose statistics the tree and the boxes use.
COARSE = 8
#: Vectors and queries of one block; queries whose bounds are computed at once.
VECTORS, QUERIES, AT_ONCE = 4096, 2048, 256
#: Vectors and numbers of the sample that the tree is fitted on; most leaves of all trees together.
SAMPLE, SAMPLE_NUMBERS, LEAVES = 8192, 1 << 22, 1024
#: Sums of products are exact in doubles below this product of norms; pairs beyond it are computed with whole numbers.
EXACT = float(1 << 53)
LIMIT, MOST = (1 << 63) - 1, 2.0**64


def segment_statistics(x: np.ndarray, segments: int) -> np.ndarray:
    """Means and deviations of the segments, times the roots of their lengths."""
    edges = np.linspace(0, x.shape[1], min(segments, x.shape[1]) + 1).astype(int)
    length = np.diff(edges)
    means = np.add.reduceat(x, edges[:-1], axis=1) / length
    squares = np.add.reduceat(x * x, edges[:-1], axis=1) / length
    deviations = np.sqrt(np.maximum(squares - means * means, 0))
    return np.hstack([means * np.sqrt(length), deviations * np.sqrt(length)])


def shrink(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by powers of two (1 but for huge numbers) that keep their squares finite, and those powers."""
    power = np.ldexp(1.0, np.maximum(0, np.frexp(np.abs(x).max(axis=1, initial=0))[1] - 400))
    return x / power[:, None], power


def whole_scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Inner products row by row with whole numbers of any size; those beyond 64 bits stop at their limits."""
    values = [sum(int(a) * int(b) for a, b in zip(u, v)) for u, v in zip(q, x)]
    return np.array([max(-LIMIT - 1, min(LIMIT, s)) for s in values], np.int64)


def top_pairs(q: np.ndarray, x: np.ndarray, q_ids: np.ndarray, x_ids: np.ndarray, k: int, floor: np.ndarray | None = None, survivors: dict | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, vector, score) of each row's k best vectors with other ids that reach its floor, ties to smaller ids.

    Of vectors with one id the best counts. survivors: gets the number of pairs that each bound leaves.
    """
    (small_q, power_q), (small_x, power_x) = shrink(q), shrink(x)
    levels = [(s, segment_statistics(small_q, s), segment_statistics(small_x, s)) for s in LEVELS]
    norm_q, norm_x = np.linalg.norm(small_q, axis=1), np.linalg.norm(small_x, axis=1)
    floor = np.full(len(q), -np.inf) if floor is None else floor
    once = np.zeros(len(x), bool)
    once[np.unique(x_ids, return_index=True)[1]] = True
    out = []

    def scaled(values: np.ndarray, rows: slice, columns: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return np.clip(values * power_q[rows, None] * power_x[columns], -MOST, MOST)

    for at in range(0, len(q), AT_ONCE):
        some, live = slice(at, at + AT_ONCE), np.arange(len(x))
        slack = scaled(1e-9 * norm_q[some, None] * norm_x, some, live)
        alive, low = q_ids[some, None] != x_ids[None, :], floor[some, None]
        for level, a, b in levels:
            bound = scaled(a[some] @ b[live].T, some, live) + slack[:, live]
            if level == LEVELS[0] and len(x) > 8 * k:  # a first floor from the vectors that look best
                first = np.argpartition(np.where(alive & once, -bound, np.inf), 4 * k, axis=1)[:, : 4 * k]
                seen = np.einsum("qd,qsd->qs", small_q[some], small_x[first])
                seen = np.clip(seen * power_q[some, None] * power_x[first], -MOST, MOST) - np.take_along_axis(slack, first, 1)
                seen[~np.take_along_axis(alive & once, first, 1)] = -np.inf
                low = np.maximum(low, np.sort(seen, axis=1)[:, -k, None])
            alive &= bound >= low
            left = np.flatnonzero(alive.any(axis=0))
            live, alive = live[left], alive[:, left]
            if survivors is not None:
                survivors[level] = survivors.get(level, 0) + int(alive.sum())
        if not len(live):
            continue
        near = scaled(small_q[some] @ small_x[live].T, some, live)
        if len(live) > k:
            known = np.where(alive & once[live], near - slack[:, live], -np.inf)
            alive &= near + slack[:, live] >= np.partition(known, len(live) - k, axis=1)[:, len(live) - k, None]
        rows, columns = np.nonzero(alive)
        scores = np.zeros(len(rows), np.int64)
        with np.errstate(over="ignore"):
            wide = (norm_q * power_q)[at + rows] * (norm_x * power_x)[live[columns]] >= EXACT
        scores[~wide] = near[rows[~wide], columns[~wide]].astype(np.int64)
        scores[wide] = whole_scores(q[at + rows[wide]], x[live[columns[wide]]])
        ids = x_ids[live[columns]]
        order = np.lexsort((~scores, ids, rows))
        order = order[(np.diff(rows[order], prepend=-1) != 0) | (np.diff(ids[order], prepend=0) != 0)]
        order = order[np.lexsort((ids[order], ~scores[order], rows[order]))]
        rows, ids, scores = rows[order], ids[order], scores[order]
        starts = np.flatnonzero(np.diff(rows, prepend=-1))
        rank = np.arange(len(rows)) - np.repeat(starts, np.diff(np.append(starts, len(rows))))
        best = rank < k
        out.append((q_ids[at + rows[best]], ids[best], scores[best]))
    return tuple(np.concatenate(z) for z in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def grow_tree(x: np.ndarray, leaves: int) -> tuple[np.ndarray, np.ndarray]:
    """Splits (statistic, value) of a binary tree over the vectors' statistics, each at the median of the widest one.

    Node i has the children 2i + 1 and 2i + 2; a negative statistic marks a leaf.
    """
    x = segment_statistics(x, COARSE)
    depth = max(0, int(np.ceil(np.log2(max(leaves, 1)))))
    feature, value = np.full(2 ** (depth + 1), -1), np.zeros(2 ** (depth + 1))
    waiting = [(0, np.arange(len(x)))]
    for node, rows in waiting:
        if node >= 2**depth - 1 or len(rows) < 2:
            continue
        widest = int(np.argmax(x[rows].std(axis=0)))
        middle = np.median(x[rows, widest])
        right = x[rows, widest] > middle
        if right.any():
            feature[node], value[node] = widest, middle
            waiting += [(2 * node + 1, rows[~right]), (2 * node + 2, rows[right])]
    return feature, value


def leaf_of(x: np.ndarray, tree: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    node = np.zeros(len(x), np.int64)
    if tree is None:
        return node
    statistics = segment_statistics(x, COARSE)
    feature, value = tree
    while (inner := np.flatnonzero(feature[node] >= 0)).size:
        at = node[inner]
        node[inner] = 2 * at + 1 + (statistics[inner, feature[at]] > value[at])
    return node


def _by_length(column: pa.Array):
    """(places, matrix) of the lists of each length."""
    lengths = np.asarray(pc.list_value_length(column))
    for d in np.unique(lengths):
        at = np.flatnonzero(lengths == d)
        yield int(d), at, matrix(column.take(pa.array(at)))


def _place(rows: DataFrame, trees: dict, scale: float) -> DataFrame:
    """(d, leaf, deal, id, v): whole components, the leaf of each vector and a number that deals the rows of a leaf out."""
    shared = rows.sparkSession.sparkContext.broadcast(trees)

    def run(batches):
        number = count(TaskContext.get().partitionId() * 7919)
        for batch in batches:
            for d, at, x in _by_length(batch.column(1)):
                x = np.floor(scale * x)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * d), pa.array(x.ravel()))
                deal = np.array([next(number) for _ in at], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), d, np.int32)), pa.array(leaf_of(shrink(x)[0], shared.value.get(d))), pa.array(deal), batch.column(0).take(pa.array(at)), lists], names=["d", "leaf", "deal", "id", "v"])

    return rows.mapInArrow(run, "d int, leaf long, deal long, id long, v array<double>")


def top_k(vectors: DataFrame, *, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of each row whose id is divisible by ``every``, against all rows.

    Components are floor(scale * x); the score is the inner product, at most as far as 64 bits go. Rows with the query's
    own id are no candidates. Null ids, null or empty vectors and vectors with null or non-finite components (also after
    scaling) take no part; vectors of other lengths than the query's are no candidates. A vector repeated under another
    id is a candidate like any other. Rows with equal ids are one query and one candidate: the best score of their
    vectors counts, and an id stands once among a query's k. Queries and vectors meet in blocks of bounded size. An empty
    table gives an empty table.
    """
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c * scale) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & finite & (F.size("v") > 0))
    n, longest = rows.agg(F.count("*"), F.max(F.size("v"))).first()
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(SAMPLE, SAMPLE_NUMBERS // (longest or 1)))).toArrow()
    trees = {}
    for d, at, x in _by_length(sample.column("v").combine_chunks()):
        leaves = min(LEAVES, -(-n // VECTORS)) * len(at) // sample.num_rows
        if leaves > 1:
            trees[d] = grow_tree(shrink(np.floor(scale * x))[0], leaves)
    placed = materialize(_place(rows, trees, scale), "placed")
    asks = F.col("id") % every == 0
    counts = placed.groupBy("d", "leaf").agg(F.ceil(F.count("*") / VECTORS).alias("parts"), F.ceil(F.count_if(asks) / QUERIES).alias("q_parts"))
    counts = materialize(counts, "leaves")
    dealt = placed.join(counts, ["d", "leaf"]).withColumn("part", F.pmod(F.xxhash64("deal"), "parts")).drop("parts")

    def first_floor(table: pa.Table) -> pa.Table:
        d, leaf = table["d"][0].as_py(), table["leaf"][0].as_py()
        ids, x = np.asarray(table["id"]), matrix(table["v"])
        mine = ids % every == 0
        found, _, score = top_pairs(x[mine], x, ids[mine], ids, k)
        asked, many = np.unique(found, return_counts=True)
        lowest = np.full(len(asked), LIMIT)
        np.minimum.at(lowest, np.searchsorted(asked, found), score)
        known = many == k  # rows repeated under one id may give more; they wait for the other parts
        small, power = shrink(x)
        with np.errstate(over="ignore"):
            box = segment_statistics(small, COARSE) * power[:, None]
        lo, hi = box.min(axis=0), box.max(axis=0)
        size = int(known.sum())
        return pa.table({
            "id": pa.array([None, *asked[known].tolist()], pa.int64()), "floor": pa.array([None, *lowest[known].tolist()], pa.int64()),
            "d": pa.array([d] + [None] * size, pa.int32()), "leaf": pa.array([leaf] + [None] * size, pa.int64()),
            "lo": pa.array([lo.tolist()] + [None] * size, pa.list_(pa.float64())), "hi": pa.array([hi.tolist()] + [None] * size, pa.list_(pa.float64())),
        })

    home = dealt.select("d", "leaf", "part", "id", "v").groupBy("d", "leaf", "part")
    first = materialize(home.applyInArrow(first_floor, "id long, floor long, d int, leaf long, lo array<double>, hi array<double>"), "floors")
    floors = first.where("id is not null").groupBy("id").agg(F.max("floor").alias("floor"))
    edges = first.where("id is null").select("d", "leaf", F.posexplode(F.arrays_zip("lo", "hi")).alias("i", "edge"))
    edges = edges.groupBy("d", "leaf", "i").agg(F.min("edge.lo").alias("lo"), F.max("edge.hi").alias("hi"))
    boxes: dict[int, tuple] = {}  # at most LEAVES boxes and one for each length, 4 * COARSE numbers each
    for r in edges.groupBy("d", "leaf").agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi"))).alias("e")).orderBy("d", "leaf").collect():
        boxes.setdefault(r.d, ([], [], []))[0].append(r.leaf)
        boxes[r.d][1].append([e.lo for e in r.e])
        boxes[r.d][2].append([e.hi for e in r.e])
    boxes = {d: tuple(map(np.array, b)) for d, b in boxes.items()}
    shared = vectors.sparkSession.sparkContext.broadcast(boxes)

    def reach(batches):
        """The leaves that each query must meet."""
        for batch in batches:
            for d, at, q in _by_length(batch.column("v")):
                leaf, lo, hi = shared.value[d]
                small, power = shrink(q)
                with np.errstate(over="ignore", invalid="ignore"):
                    statistics = segment_statistics(small, COARSE) * power[:, None]
                    bound = np.maximum(statistics, 0) @ hi.T + np.minimum(statistics, 0) @ lo.T
                    norm = np.abs(statistics) @ np.maximum(np.abs(lo), np.abs(hi)).T
                    floor = batch.column("floor").take(pa.array(at)).cast(pa.float64(), safe=False).fill_null(-np.inf).to_numpy(zero_copy_only=False)
                    out = bound + 1e-9 * norm + 1 < floor[:, None]
                wanted = [leaf[~row] for row in out]
                ends = np.concatenate([[0], np.cumsum([len(w) for w in wanted])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(wanted).astype(np.int64)))
                kept = batch.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*(kept.column(c) for c in ("d", "id", "v", "floor", "home", "q_part")), lists], names=["d", "id", "v", "floor", "home", "q_part", "leaves"])

    queries = placed.where(asks).dropDuplicates(["id", "v"]).join(counts, ["d", "leaf"]).join(floors, "id", "left")
    queries = queries.select("d", "id", "v", "floor", F.col("leaf").alias("home"), F.pmod(F.xxhash64("id"), "q_parts").alias("q_part"))
    asking = materialize(queries.mapInArrow(reach, "d int, id long, v array<double>, floor long, home long, q_part long, leaves array<long>"), "asking")
    parts = counts.select("d", "leaf", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    key = ["d", "home", "q_part", "leaf"]
    asked = materialize(asking.withColumn("leaf", F.explode("leaves")).select(*key).distinct().join(parts, ["d", "leaf"]), "asked")
    cell = F.struct(*key, "part").alias("cell")
    candidates = dealt.drop("q_parts").join(asked, ["d", "leaf", "part"]).select(cell, "id", "v", F.lit(None).cast("long").alias("floor"), F.lit(False).alias("asks"))
    wanted = asking.withColumn("leaf", F.explode("leaves")).join(parts, ["d", "leaf"]).select(cell, "id", "v", "floor", F.lit(True).alias("asks"))

    def search(table: pa.Table) -> pa.Table:
        asks, ids, x = np.asarray(table["asks"]), np.asarray(table["id"]), matrix(table["v"])
        floor = np.asarray(table["floor"].cast(pa.float64(), safe=False).fill_null(-np.inf))
        found = top_pairs(x[asks], x[~asks], ids[asks], ids[~asks], k, floor[asks])
        return pa.table({name: pa.array(column, pa.int64()) for name, column in zip(("query_id", "vec_id", "score"), found)})

    best = candidates.unionByName(wanted).groupBy("cell").applyInArrow(search, "query_id long, vec_id long, score long")
    best = materialize(best.groupBy("query_id", "vec_id").agg(F.max("score").alias("score")), "best")
    for table in (placed, counts, first, asking, asked):
        discard(table)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
