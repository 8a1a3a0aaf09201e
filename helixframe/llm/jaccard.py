"""N-gram Jaccard join: a blocked sparse matrix product of the document by n-gram incidence.

1. Shingles that very many documents hold are put last in the global order of shingles; the rest go by hash. All that
   stand in the first half of a set by hash are counted, in blocks of shingles.
2. Two sets with Jaccard similarity of at least 3/4 share a shingle among the first floor(n / 4) + 1 of each, so only
   those columns of the incidence matrix are multiplied. They are dealt into blocks of columns; a block multiplies its
   part and reports each pair's overlap there. Equal sets are one row of the matrix.
3. The overlaps of all blocks are added up. A pair whose overlap and largest possible rest stay below the bound that the
   sizes of its sets ask for is discarded; the others are compared in full.
4. Columns that stay long even so (copies of one text in great numbers) are not multiplied pair by pair. Documents that
   share long columns, directly or through others, make a group; each group is multiplied in full, in blocks of rows of
   similar size, and a block reports sums of links and a spanning forest instead of its pairs.
5. Links make components.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.arrow import slices, trim
from helixframe.llm.vectors import forest
from helixframe.llm.words import mix, shingle_sets
from helixframe.plans.components import connected_components
from helixframe.plans.storage import discard, materialize, partitions

U = np.uint64


@dataclass(frozen=True)
class Settings:
    """width: words of a shingle. common: counted documents from which a shingle goes last; a higher power of two where
    otherwise over ``common_most`` shingles would (their list is broadcast, 8 bytes each); chunk: shingles that a task
    counts before they are dealt out. long: documents from which a column is not
    multiplied pair by pair. block: shingles of a block of columns. rows: documents of a block of rows."""

    width: int = 5
    common: int = 32
    common_most: int = 1_000_000
    chunk: int = 4_000_000
    long: int = 64
    block: int = 1_500_000
    least_blocks: int = 24
    rows: int = 800


def flatten(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.array([len(s) for s in sets], np.int64)
    return (np.concatenate(sets) if sets else np.zeros(0, U)), sizes


def common_shingles(docs: DataFrame, settings: Settings) -> np.ndarray:
    """Sorted hashes of the shingles that very many documents hold in the first half of their sets.

    Tasks combine what they count and deal it out by ranges of hashes; a range adds the counts up. They only set the
    order, which any choice leaves correct. The limit is raised by powers of two until at most ``common_most`` shingles
    reach it.
    """
    parts = max(settings.least_blocks, partitions(docs.sparkSession))

    def run(batches):
        waiting, size = [], 0

        def report():
            found, counts = np.unique(np.concatenate(waiting), return_counts=True)
            cuts = np.searchsorted(found >> U(32), (np.arange(parts + 1, dtype=np.uint64) << U(32)) // U(parts))
            cuts[-1] = len(found)
            waiting.clear()
            spans = list(zip(cuts[:-1], cuts[1:]))
            return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int64()), pa.array([found[a:b].tobytes() for a, b in spans], pa.binary()), pa.array([counts[a:b].astype(np.int32).tobytes() for a, b in spans], pa.binary())], names=["part", "shingles", "counts"])

        for batch in batches:
            for texts in slices(batch.column(0).to_pylist()):
                waiting += [s[: len(s) // 2 + 1] for s in shingle_sets(texts, settings.width)]
                size += sum(map(len, waiting[-len(texts) :]))
                if size >= settings.chunk:
                    yield report()
                    size = 0
        if waiting:
            yield report()
        trim()

    def add(table: pa.Table) -> pa.Table:
        # Counts of a chunk are combined with those before, so a task holds one range of the counted shingles.
        found, counts = np.zeros(0, U), np.zeros(0, np.int64)
        for shingles, n in zip(table["shingles"], table["counts"]):
            both = np.concatenate([found, np.frombuffer(shingles.as_buffer(), U)])
            n = np.concatenate([counts, np.frombuffer(n.as_buffer(), np.int32)])
            order = np.argsort(both, kind="stable")
            both, n = both[order], n[order]
            starts = np.flatnonzero(np.concatenate([np.ones(min(len(both), 1), bool), both[1:] != both[:-1]]))
            found, counts = both[starts], np.add.reduceat(n, starts) if len(starts) else np.zeros(0, np.int64)
        often = counts >= settings.common
        trim()
        return pa.table({"shingle": found[often].view(np.int64), "n": counts[often]})

    counts = docs.select("text").mapInArrow(run, "part long, shingles binary, counts binary").groupBy("part").applyInArrow(add, "shingle long, n long")
    counts = materialize(counts, "counts")
    levels = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("level")).agg(F.count("*").alias("n")).collect()
    least = settings.common
    while sum(r.n for r in levels if r.level >= least.bit_length() - 1) > settings.common_most:
        least *= 2
    rows = counts.where(F.col("n") >= least).select("shingle").toArrow()
    discard(counts)
    return np.sort(np.asarray(rows.column(0)).view(U))


def signatures(docs: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, number of shingles, and two order-free 64-bit sums over them that stand for the set."""

    def run(batches):
        for batch in batches:
            parts = []
            for texts in slices(batch.column(1).to_pylist()):
                flat, sizes = flatten(shingle_sets(texts, settings.width))
                parts.append((sizes, *_sums(flat, sizes)))
            sums = [pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (zip(*parts) if parts else [(), (), ()])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *sums], names=["doc_id", "n", "one", "two"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n long, one long, two long")


def _sums(flat: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edges = np.concatenate([[0], np.cumsum(sizes)])
    out = []
    for values in (flat, mix(flat ^ U(0x5DEECE66D1234567))):
        sums = np.concatenate([[U(0)], np.cumsum(values, dtype=U)])
        out.append(mix(sums[edges[1:]] - sums[edges[:-1]] + sizes.astype(U)).view(np.int64))
    return out[0], out[1]


def prefix_blocks(docs: DataFrame, common: np.ndarray, blocks: int, settings: Settings) -> DataFrame:
    """The first floor(n / 4) + 1 shingles of each set in the global order, packed per batch and block of columns."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        late = shared.value
        seen = np.zeros(1 << 22, bool)
        seen[late >> U(42)] = True

        def is_common(flat: np.ndarray) -> np.ndarray:
            maybe = np.flatnonzero(seen[flat >> U(42)])
            out = np.zeros(len(flat), bool)
            if len(maybe):
                at = np.minimum(np.searchsorted(late, flat[maybe]), len(late) - 1)
                out[maybe] = late[at] == flat[maybe]
            return out

        for batch in batches:
            ids, texts = np.asarray(batch.column(0)), batch.column(1).to_pylist()
            for start in range(0, len(texts), 500):
                sets = shingle_sets(texts[start : start + 500], settings.width)
                flat, sizes = flatten(sets)
                one, _ = _sums(flat, sizes)
                last = is_common(flat)
                taken, at = [], 0
                for s in sets:
                    n = len(s)
                    if n:
                        mask = last[at : at + n]
                        first = n // 4 + 1
                        if mask.any():
                            early = s[~mask]
                            taken.append(early[:first] if len(early) >= first else np.concatenate([early, s[mask][: first - len(early)]]))
                        else:
                            taken.append(s[:first])
                    at += n
                kept = np.flatnonzero(sizes)
                if not len(kept):
                    continue
                tokens, counts = flatten(taken)
                rows = np.repeat(np.arange(len(kept)), counts)
                bucket = (tokens % U(blocks)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                tokens, rows, bucket = tokens[order], rows[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
                out: tuple[list, ...] = ([], [], [])
                for a, b in zip(cuts[:-1], cuts[1:]):
                    mine, many = np.unique(rows[a:b], return_counts=True)
                    at = kept[mine]
                    out[0].append(int(bucket[a]))
                    out[1].append(tokens[a:b].tobytes())
                    out[2].append(np.concatenate([ids[start + at], sizes[at], one[at], many]).astype(np.int64).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.binary()), pa.array(out[2], pa.binary())], names=["block", "shingles", "documents"])
        trim()

    return docs.select("doc_id", "text").mapInArrow(run, "block long, shingles binary, documents binary")


def multiply_block(tokens: np.ndarray, ids: np.ndarray, sizes: np.ndarray, marks: np.ndarray, counts: np.ndarray, settings: Settings) -> pa.Table:
    """One block of columns: overlaps of pairs there, and (b null, overlap a document of the same group) the documents
    that hold a long column.

    tokens: the shingles of all documents one after another; ids, sizes, marks, counts: per document.
    """
    order = np.lexsort((ids, sizes, marks))
    new = np.ones(len(order), bool)
    new[1:] = (marks[order][1:] != marks[order][:-1]) | (sizes[order][1:] != sizes[order][:-1])
    first = np.zeros(len(ids), bool)
    first[order[new]] = True
    rows = np.repeat(np.arange(len(ids)), counts)
    keep = first[rows]
    tokens, rows = tokens[keep], rows[keep]
    order = np.lexsort((sizes[rows], tokens))
    tokens, rows = tokens[order], rows[order]
    cuts = np.concatenate([[0], np.flatnonzero(tokens[1:] != tokens[:-1]) + 1, [len(tokens)]]) if len(tokens) else np.zeros(1, np.int64)
    length = np.diff(cuts)
    long, root = long_groups(rows, cuts[:-1], length, settings.long, len(ids))
    shared = np.repeat((length > 1) & (length <= settings.long), length)
    tokens, rows = tokens[shared], rows[shared]
    found, overlaps = np.zeros(0, np.int64), np.zeros(0, np.int64)
    edges = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
    start = 0
    while start < len(tokens):
        end = start + 200_000
        end = len(tokens) if end >= len(tokens) else int(edges[np.searchsorted(edges, end)]) if np.searchsorted(edges, end) < len(edges) else len(tokens)
        t, r = tokens[start:end], rows[start:end]
        n = sizes[r]
        keys = []
        for k in range(1, settings.long):
            same = np.flatnonzero(t[k:] == t[:-k]) if k < len(t) else np.zeros(0, np.int64)
            if not len(same):
                break
            same = same[4 * n[same] >= 3 * n[same + k]]
            one, two = r[same], r[same + k]
            keys.append(np.minimum(one, two) * len(ids) + np.maximum(one, two))
        if keys:
            pairs, many = np.unique(np.concatenate([np.concatenate(keys)]), return_counts=True)
            found, inverse = np.unique(np.concatenate([found, pairs]), return_inverse=True)
            overlaps = np.bincount(inverse, np.concatenate([overlaps, many])).astype(np.int64)
        start = end
    a, b = found // max(len(ids), 1), found % max(len(ids), 1)
    swap = ids[a] > ids[b]
    a, b = np.where(swap, b, a), np.where(swap, a, b)
    differ = ids[a] != ids[b]
    a, b, overlaps = a[differ], b[differ], overlaps[differ]
    none = np.arange(len(a) + len(long)) >= len(a)
    pad = np.zeros(len(long), np.int64)
    return pa.table({
        "a": np.concatenate([ids[a], ids[long]]),
        "b": pa.array(np.concatenate([ids[b], pad]), mask=none),
        "na": np.concatenate([sizes[a], sizes[long]]),
        "nb": np.concatenate([sizes[b], pad]),
        "overlap": np.concatenate([overlaps, ids[root]]),
    })


def long_groups(rows: np.ndarray, starts: np.ndarray, length: np.ndarray, most: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The documents (numbers below n) of columns with over ``most`` rows, and the first one that such columns reach."""
    long = length > most
    rows, length = rows[np.repeat(long, length)], length[long]
    label = np.arange(n)
    if len(rows):
        starts = np.concatenate([[0], np.cumsum(length)[:-1]])
        while True:
            new = label.copy()
            np.minimum.at(new, rows, np.repeat(np.minimum.reduceat(label[rows], starts), length))
            new = new[new]
            if (new == label).all():
                break
            label = new
    members = np.unique(rows)
    return members, label[members]


def multiply_rows(sets: list[np.ndarray], sides: np.ndarray, cross: bool) -> np.ndarray:
    """Which documents of a block of rows are linked, by their whole sets. cross: only between the two sides."""
    flat, sizes = flatten(sets)
    rows = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, rows = flat[order], rows[order]
    cuts = np.concatenate([[0], np.flatnonzero(flat[1:] != flat[:-1]) + 1, [len(flat)]])
    length = np.diff(cuts)
    m = len(sets)
    overlap = np.zeros((m, m))
    dense = np.repeat(length > 24, length)
    column = np.repeat(np.cumsum(length > 24) - 1, length)[dense]
    r = rows[dense]
    for low in range(0, int((length > 24).sum()), 4096):
        a, b = np.searchsorted(column, [low, low + 4096])
        part = np.zeros((m, 4096), np.float32)
        part[r[a:b], column[a:b] - low] = 1
        overlap += part @ part.T
    few = np.repeat((length > 1) & (length <= 24), length)
    t, r = flat[few], rows[few]
    for k in range(1, 24):
        same = np.flatnonzero(t[k:] == t[:-k]) if k < len(t) else np.zeros(0, np.int64)
        if not len(same):
            break
        one = np.bincount(r[same] * m + r[same + k], minlength=m * m).reshape(m, m)
        overlap += one + one.T
    linked = 7 * overlap >= 3 * (sizes[:, None] + sizes[None, :])
    np.fill_diagonal(linked, False)
    if cross:
        linked &= sides[:, None] != sides[None, :]
    return linked


def _rest(n: Column) -> Column:
    return n - F.floor(n / 4) - 1


def _row_blocks(hot: DataFrame, settings: Settings) -> DataFrame:
    """(id, size, side) with a key for each block pair of a group's rows to compare: sets whose sizes are as 3 to 4 or nearer.

    A group of few rows is one block. Else size classes are powers of 4/3, so partners are of the same or the next
    class, and classes (some hundred at most) are cut into blocks.
    """
    graded = hot.withColumn("grade", F.floor(F.log("n") / math.log(4 / 3)).cast("int"))
    counts = graded.groupBy("group", "grade").agg(F.count("*").alias("n"))
    blocks = F.map_from_entries(F.collect_list(F.struct("grade", F.ceil(F.col("n") / settings.rows).cast("int").alias("blocks"))))
    counts = materialize(counts.groupBy("group").agg(F.sum("n").alias("total"), blocks.alias("blocks")), "row-blocks")
    few = F.col("total") <= settings.rows
    graded = graded.join(counts, "group").withColumn("grade", F.when(few, 0).otherwise(F.col("grade"))).withColumn("blocks", F.when(few, F.create_map(F.lit(0), F.lit(1))).otherwise(F.col("blocks")))
    grade, own = F.col("grade"), F.col("own")
    graded = graded.withColumn("own", F.pmod(F.xxhash64("id"), F.try_element_at("blocks", grade)).cast("int"))

    def others(grade: Column) -> Column:
        n = F.coalesce(F.try_element_at(F.col("blocks"), grade), F.lit(0))
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    key = lambda g, h, i, j: F.struct(F.col("group"), g.alias("g"), h.alias("h"), i.alias("i"), j.alias("j"))
    keys = F.concat(
        F.transform(others(grade), lambda o: key(grade, grade, F.least(own, o), F.greatest(own, o))),
        F.transform(others(grade + 1), lambda o: key(grade, grade + 1, own, o)),
        F.transform(others(grade - 1), lambda o: key(grade - 1, grade, o, own)),
    )
    return graded.select("id", "size", (grade * 1_000_000 + own).cast("long").alias("side"), F.explode(keys).alias("cell"))


def jaccard_join(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", settings: Settings = Settings()) -> DataFrame:
    """(id, n_shingles, component_id, n_links) of each row.

    A document's set holds the distinct shingles of its words, lower-cased in A-Z; with fewer words than a shingle the
    whole sequence is one. Null or blank texts have empty sets and link with nothing. Two documents are linked when
    4 * intersection >= 3 * union; n_links counts the other documents, copies included. component_id is the smallest id
    that links reach, the own id without links. Rows with a null id link with nothing and have a null component. Rows
    with equal ids are one document to the links of others; where their texts differ, links of either count. Extra
    columns are not looked at. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sign = materialize(signatures(rows, settings), "signatures")
    named = rows.where("doc_id is not null")
    classes = materialize(sign.where("n > 0 and doc_id is not null").groupBy("n", "one", "two").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")), "classes")
    total = sign.where("doc_id is not null").agg(F.sum("n")).first()[0] or 0
    common = common_shingles(named, settings)
    blocks = max(settings.least_blocks, -(-total // (4 * settings.block)))

    def product(table: pa.Table) -> pa.Table:
        tokens = np.concatenate([np.frombuffer(x.as_buffer(), U) for x in table["shingles"]])
        parts = [np.frombuffer(x.as_buffer(), np.int64).reshape(4, -1) for x in table["documents"]]
        out = multiply_block(tokens, *np.concatenate(parts, axis=1), settings)
        trim()
        return out

    schema = "a long, b long, na long, nb long, overlap long"
    found = materialize(prefix_blocks(named, common, blocks, settings).groupBy("block").applyInArrow(product, schema), "overlaps")
    edges = materialize(found.where("b is null").select(F.col("a").alias("id"), F.col("overlap").alias("root")).distinct(), "long-rows")
    heads = connected_components(edges, "id", "root")
    hot = edges.select("id").distinct().join(heads, F.col("id") == F.col("node"), "left")
    hot = materialize(hot.select("id", F.coalesce("component", "id").alias("group")), "hot")
    added = found.where("b is not null").groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    large = added.where(7 * (F.col("overlap") + F.greatest(_rest(F.col("na")), _rest(F.col("nb")))) >= 3 * (F.col("na") + F.col("nb")))
    one, two = (hot.select(F.col("id").alias(f"i{x}"), F.col("group").alias(f"g{x}")) for x in "ab")
    pairs = large.join(one, F.col("a") == F.col("ia"), "left").join(two, F.col("b") == F.col("ib"), "left")
    pairs = materialize(pairs.where("ga is null or gb is null or ga <> gb").select("a", "b"), "pairs")
    discard(edges)
    discard(heads)
    discard(found)

    wanted = pairs.select(F.col("a").alias("doc_id")).unionByName(pairs.select(F.col("b").alias("doc_id"))).unionByName(hot.select(F.col("id").alias("doc_id"))).distinct()
    wanted = materialize(wanted, "wanted")

    def to_set(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                sets = shingle_sets(part.column(1).to_pylist(), settings.width)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["id", "n", "set"])
        trim()

    sets = materialize(named.join(wanted, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(to_set, "id long, n long, set binary"), "sets")

    def check(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                both = np.concatenate([p, q])
                both.sort(kind="stable")
                keep.append(7 * int(np.count_nonzero(both[1:] == both[:-1])) >= 3 * len(both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    with_a = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("set_a")), "a")
    with_both = with_a.join(sets.select(F.col("id").alias("b"), F.col("set").alias("set_b")), "b").select("a", "b", "set_a", "set_b")
    links = materialize(with_both.mapInArrow(check, "a long, b long"), "links")
    discard(pairs)
    discard(wanted)

    def rows_product(table: pa.Table) -> pa.Table:
        cell = table["cell"][0].as_py()
        ids, size = np.asarray(table["id"]), np.asarray(table["size"])
        members = [np.frombuffer(x.as_buffer(), U) for x in table["set"]]
        linked = multiply_rows(members, np.asarray(table["side"]), (cell["g"], cell["i"]) != (cell["h"], cell["j"]))
        root = forest(linked)
        sums = linked @ size
        counted, away = np.flatnonzero(sums), np.flatnonzero(root != np.arange(len(root)))
        none = np.arange(len(counted) + len(away)) < len(counted)
        return pa.table({"id": np.concatenate([ids[counted], ids[away]]), "links": np.concatenate([sums[counted], np.zeros(len(away), np.int64)]), "to": pa.array(np.concatenate([np.zeros(len(counted), np.int64), ids[root[away]]]), mask=none)})

    near = spark.createDataFrame([], "id long, links long, to long")
    if not hot.isEmpty():
        sized = hot.join(classes.select(F.col("rep").alias("id"), "n", "size"), "id")
        cells = _row_blocks(sized, settings).join(sets.select("id", "set"), "id").select("cell", "id", "side", "size", "set")
        near = materialize(cells.groupBy("cell").applyInArrow(rows_product, "id long, links long, to long"), "row-links")
    discard(sets)
    discard(hot)
    groups = connected_components(links.unionByName(near.where("to is not null").select(F.col("id").alias("a"), F.col("to").alias("b"))))
    ends = links.select(F.col("a").alias("id"), F.col("b").alias("rep")).unionByName(links.select(F.col("b").alias("id"), F.col("a").alias("rep")))
    sums = ends.join(classes.select("rep", "size"), "rep").select("id", F.col("size").alias("links")).unionByName(near.select("id", "links"))
    sums = sums.groupBy("id").agg(F.sum("links").alias("links"))
    known = classes.join(sums, classes.rep == sums.id, "left").join(groups, F.col("rep") == F.col("node"), "left")
    known = materialize(known.select("n", "one", "two", (F.coalesce("links", F.lit(0)) + F.col("size") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")), "jaccard-groups")
    for table in (links, near, groups, classes):
        discard(table)
    good = sign.where("n > 0 and doc_id is not null").join(known, ["n", "one", "two"])
    bad = sign.where("n = 0 or doc_id is null")
    return good.select("doc_id", "n", "component_id", "n_links").unionByName(bad.select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))).select(F.col("doc_id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", "n_links")
