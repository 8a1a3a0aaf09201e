"""Token ids in files: canonical length-limited Huffman codes from global counts.

A file holds documents in ascending order of their ids. Its codes stand in blocks of a fixed number of token ids; a
checkpoint gives the bit at which each block starts, so blocks decode independently (all at once, one lane each) by a
table indexed with the next ``limit`` bits.

Layout, little endian: magic, numbers of documents, ids and blocks, ids per block, code limit, bytes of the packed code
lengths; then the code lengths (zlib, one byte per id of the vocabulary), the document ids (int64), a null flag each,
the token counts (uint32), the checkpoints (uint64), and the code words (uint32 words, bits from the top).
"""

from __future__ import annotations

import re
import struct
import sys
import zlib
from array import array
from collections.abc import Callable, Iterable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from helixframe.llm.bpe import byte_characters
from helixframe.llm.words import U, span_hashes
from helixframe.plans.storage import discard, materialize, new_path, partitions

MAGIC = b"HFXTOK01"
HEADER = struct.Struct("<8sQQQIII")
LIMIT = 20
BLOCK = 512
#: About as many ids are put in one file.
FILE_IDS = 4_000_000
#: Words of a generation that the encoder of single words remembers; words that the encoder of texts does.
MEMO, WORDS = 20_000, 1_000_000
#: Slots of its table (a power of two), and bytes of texts that it works on at once.
SLOTS, CHUNK = 1 << 22, 1 << 19
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Words of which the normaliser changes nothing and the pre-tokeniser makes one token.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
#: A closing run of punctuation after such a word is a pre-token of its own.
MARKS = frozenset(b"!#$%&()*+,-./:;=?@[]^_`{|}~\"\\")
CLOSED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:;=?@\[-`{}~]+)")


class WordTokens(dict):
    """Encodes by words (bytes) between blanks, which the tokenizer never joins; remembers the ids of recent words.

    Two generations of MEMO words: a full one becomes the old one, from which words come back when they are met again.
    For a tokenizer that drops white space and lower-cases; its special tokens, which hold ``<|``, are left alone.
    """

    def __init__(self, model: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_str(model)
        self.pieces = self.tokenizer.model.tokenize
        wide = self.tokenizer.get_vocab_size(with_added_tokens=True) > 1 << 16
        self.kind = np.dtype("<u4" if wide else "<u2")
        self.code = "I" if wide else "H"
        self.bytes = dict(enumerate(byte_characters()))
        self.old: dict[bytes, bytes] = {}
        self.wide: set[bytes] = set()  # plain words beyond ASCII

    def __missing__(self, raw: bytes) -> bytes:
        if raw[-1] in MARKS and ((head := raw[:-1]).isalpha() or head in self.wide):
            return self[head] + self[raw[-1:]]
        ids = self.old.pop(raw, None)
        if ids is None:
            word = raw.decode()
            if PLAIN.fullmatch(word):
                mapped = word
                if not raw.isascii():
                    mapped = raw.decode("latin-1").translate(self.bytes)
                    self.wide.add(raw)
                found = [t.id for t in self.pieces(mapped)]
            elif parts := CLOSED.fullmatch(word):
                return self[parts[1].encode()] + self[parts[2].encode()]
            else:
                found = self.tokenizer.encode(word, add_special_tokens=False).ids
            ids = array(self.code, found).tobytes() if sys.byteorder == "little" else np.array(found, self.kind).tobytes()
        if len(self) >= MEMO:
            self.old = dict(self)
            self.wide.intersection_update(self.old)
            self.clear()
        self[raw] = ids
        return ids

    def encode(self, raw: bytes | None) -> bytes:
        """The ids of a text in UTF-8 as bytes of ``kind``."""
        if not raw:
            return b""
        return b"".join(map(self.__getitem__, (raw if b"<|" in raw else raw.translate(LOWER)).split()))


def _marked(bytes_: Iterable[int]) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(bytes_)] = True
    return out


BLANK, LETTER, MARK = _marked([9, 10, 11, 12, 13, 32]), _marked(range(97, 123)), _marked(MARKS)


#: The second bytes of the letters that begin with 0xC3.
SECOND = _marked([*range(0x9F, 0xB7), *range(0xB8, 0xC0)])


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between blanks (``data`` begins and ends with one), and whether they are PLAIN; of a
    plain word with closing marks, the word and the marks."""
    edges = np.flatnonzero(np.diff(BLANK[data])) + 1
    starts, ends = edges[0::2], edges[1::2]
    letter = LETTER[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[SECOND[data[lead + 1]]]
    letter[lead] = letter[lead + 1] = True
    others = np.cumsum(~letter, dtype=np.int32)
    tails = np.maximum.accumulate(np.where(MARK[data], 0, np.arange(len(data), dtype=np.int32)))[ends - 1] + 1
    closed = (tails < ends) & (tails > starts) & (others[tails - 1] == others[starts - 1])
    parts = 1 + closed
    at = np.cumsum(parts)[closed] - 1
    starts, ends = np.repeat(starts, parts), np.repeat(ends, parts)
    starts[at] = ends[at - 1] = tails[closed]
    return starts, ends, others[ends - 1] == others[starts - 1]


class TextTokens:
    """Encodes texts by words that it has met before, with array operations: words are found by a 64-bit hash in an open
    table, and their first eight bytes are compared. Only new words are encoded one by one. A full table starts anew."""

    def __init__(self, model: str, end_id: int):
        self.words = WordTokens(model)
        self.kind, self.end = self.words.kind, np.array([end_id], self.words.kind)
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(SLOTS, U), np.zeros(SLOTS, np.int32)
        self.heads, self.at, self.n = np.zeros(WORDS, U), np.zeros(WORDS, np.int64), np.zeros(WORDS, np.int64)
        self.pool, self.used, self.entries = np.zeros(4 * WORDS, self.kind), 0, 0
        self._add(np.zeros(1, U), self.end, np.ones(1, np.int64))  # entry 0 is what ends a text

    def _add(self, heads: np.ndarray, ids: np.ndarray, many: np.ndarray) -> np.ndarray:
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        new = slice(self.entries, self.entries + len(many))
        self.heads[new], self.n[new], self.at[new] = heads, many, self.used + np.cumsum(many) - many
        self.pool[self.used : self.used + len(ids)] = ids
        self.used, self.entries = self.used + len(ids), new.stop
        return np.arange(new.start, new.stop)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """Entries of the hashes, 0 where there is none."""
        out = np.zeros(len(hashes), np.int64)
        left, place = np.arange(len(hashes)), (hashes & U(SLOTS - 1)).astype(np.int64)
        while len(left):
            key = self.keys[place]
            hit = key == hashes[left]
            out[left[hit]] = self.slots[place[hit]]
            on = ~hit & (key != 0)
            left, place = left[on], (place[on] + 1) & (SLOTS - 1)
        return out

    def _learn(self, hashes: np.ndarray, heads: np.ndarray, starts: np.ndarray, ends: np.ndarray, plain: np.ndarray, raw: bytes) -> None:
        new, first = np.unique(hashes, return_index=True)
        if self.entries + len(new) > WORDS:
            self._clear()
            new, first = new[: WORDS - 1], first[: WORDS - 1]
        pieces, words, table = self.words.pieces, self.words, self.words.bytes

        def ids_of(word: bytes, is_plain: bool) -> list[int]:
            if not is_plain:
                return np.frombuffer(words[word], self.kind).tolist()
            return [t.id for t in pieces(word.decode() if word.isascii() else word.decode("latin-1").translate(table))]

        found = [ids_of(raw[a:b], p) for a, b, p in zip(starts[first].tolist(), ends[first].tolist(), plain[first].tolist())]
        many = np.fromiter(map(len, found), np.int64, len(found))
        left = self._add(heads[first], np.fromiter(chain.from_iterable(found), self.kind, int(many.sum())), many)
        place = (new & U(SLOTS - 1)).astype(np.int64)
        while len(left):  # each free slot takes one of the words that come to it, the others go on
            free = np.flatnonzero(self.keys[place] == 0)
            taken, one = np.unique(place[free], return_index=True)
            self.keys[taken], self.slots[taken] = new[free[one]], left[free[one]]
            on = np.ones(len(left), bool)
            on[free[one]] = False
            left, new, place = left[on], new[on], (place[on] + 1) & (SLOTS - 1)

    def _chunk(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = b" " + b" ".join(texts) + b" "
        data = np.frombuffer(raw + bytes(8), np.uint8)
        starts, ends, plain = word_places(data[: len(raw)])
        hashes = span_hashes(data[: len(raw)], starts, ends)
        hashes[hashes == 0] = U(1)
        heads = np.lib.stride_tricks.as_strided(data, (len(raw), 8), (1, 1))[starts].copy().view("<u8").ravel()
        size = np.minimum(ends - starts, 8)
        heads &= np.where(size < 8, (U(1) << (8 * size).astype(U) % U(64)) - U(1), ~U(0))
        found = self._find(hashes)
        missing = np.flatnonzero(found == 0)
        if len(missing):
            before = self.entries
            self._learn(hashes[missing], heads[missing], starts[missing], ends[missing], plain[missing], raw)
            found = self._find(hashes) if self.entries < before else found
            missing = np.flatnonzero(found == 0)
            found[missing] = self._find(hashes[missing])
        if not found.all() or (self.heads[found] != heads).any():  # the table has started anew, or two words share a hash
            ids = [self.words.encode(t) + self.end.tobytes() for t in texts]
            return np.frombuffer(b"".join(ids), self.kind), np.array([len(x) for x in ids], np.int64) // self.kind.itemsize
        limits = np.searchsorted(starts, 1 + np.cumsum([len(t) + 1 for t in texts]))
        entries = np.insert(found, limits, 0)
        many = self.n[entries]
        out = np.cumsum(many) - many
        flat = self.pool[np.repeat(self.at[entries] - out, many) + np.arange(int(many.sum()))]
        last = limits + np.arange(len(texts))
        return flat, np.diff((out + many)[last], prepend=0)

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts (UTF-8), each with the end id, and the number of ids of each."""
        flat, counts, waiting, size = [], [], [], 0

        def work() -> None:
            nonlocal size
            if waiting:
                ids, n = self._chunk(waiting)
                flat.append(ids)
                counts.append(n)
                waiting.clear()
                size = 0

        for raw in texts:
            if raw and b"<|" in raw:  # may hold special tokens, which keep their case
                work()
                ids = np.concatenate([np.frombuffer(self.words.encode(raw), self.kind), self.end])
                flat.append(ids)
                counts.append(np.array([len(ids)]))
                continue
            waiting.append(raw.translate(LOWER) if raw else b"")
            size += len(waiting[-1]) + 1
            if size >= CHUNK:
                work()
        work()
        return (np.concatenate(flat), np.concatenate(counts)) if flat else (np.zeros(0, self.kind), np.zeros(0, np.int64))


_loaded: dict[int, TextTokens] = {}


def text_tokens(model: str, end_id: int) -> TextTokens:
    """The encoder of this Python worker; it keeps what it has learnt from one task to the next."""
    key = hash((model, end_id))
    if key not in _loaded:
        _loaded.clear()
        _loaded[key] = TextTokens(model, end_id)
    return _loaded[key]


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Lengths of an optimal prefix code of at most ``limit`` bits, by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of this length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(limit):
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        levels.append(order < len(weights))
        merged = merged[order]
        packages = merged[0 : len(merged) // 2 * 2 : 2] + merged[1 : len(merged) // 2 * 2 : 2]
    need = 2 * len(used) - 2
    for single in reversed(levels):
        taken = int(np.count_nonzero(single[:need]))
        lengths[used[:taken]] += 1
        need = 2 * (need - taken)
    return lengths


def canonical(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code of each id, and the ids in order of their codes."""
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    codes = np.zeros(len(lengths), np.uint64)
    code, last = 0, 0
    for length in np.unique(lengths[order]):
        members = order[lengths[order] == length]
        code <<= int(length) - last
        codes[members] = code + np.arange(len(members), dtype=np.uint64)
        code, last = code + len(members), int(length)
    return codes, order


def pack(ids: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Checkpoints and code words of the ids."""
    size = lengths[ids].astype(np.int64)
    ends = np.cumsum(size)
    starts = ends - size
    total = int(ends[-1]) if len(ends) else 0
    words = np.zeros(total // 32 + 3, np.uint32)
    step = 1 << 20
    for at in range(0, len(ids), step):
        s, n, c = starts[at : at + step], size[at : at + step], codes[ids[at : at + step]]
        slot = s >> 5
        wide = c << (64 - (s & 31) - n).astype(np.uint64)
        low, many = int(slot[0]), int(slot[-1]) + 2
        part = np.bincount(slot - low, (wide >> np.uint64(32)).astype(np.float64), many - low)
        part[1:] += np.bincount(slot - low, (wide & np.uint64(0xFFFFFFFF)).astype(np.float64), many - low - 1)
        words[low:many] |= part.astype(np.uint64).astype(np.uint32)
    return starts[::BLOCK].astype(np.uint64), words


def unpack(n_ids: int, checkpoints: np.ndarray, words: np.ndarray, lengths: np.ndarray, limit: int, block: int) -> np.ndarray:
    """All ids, one lane per block."""
    codes, order = canonical(lengths)
    table = np.zeros(1 << limit, np.uint32)
    width = np.ones(1 << limit, np.int64)
    bits = limit - lengths[order].astype(np.int64)
    first = (codes[order].astype(np.int64)) << bits
    filled = np.repeat(order, 1 << bits)
    if len(filled):
        table[int(first[0]) : int(first[0]) + len(filled)] = filled
        width[int(first[0]) : int(first[0]) + len(filled)] = lengths[filled]
    pairs = np.concatenate([words, np.zeros(2, np.uint32)]).astype(np.uint64)
    pairs = pairs[:-1] << np.uint64(32) | pairs[1:]
    at = checkpoints.astype(np.int64)
    out = np.zeros((block, len(at)), np.uint32)
    top = len(pairs) - 1
    for row in range(min(block, n_ids)):
        peek = (pairs[np.minimum(at >> 5, top)] >> (64 - limit - (at & 31)).astype(np.uint64)) & np.uint64((1 << limit) - 1)
        out[row] = table[peek]
        at += width[peek]
    return out.T.reshape(-1)[:n_ids]


def write_bytes(doc_ids: list[int | None], ids: list[np.ndarray], lengths: np.ndarray) -> bytes:
    flat = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
    checkpoints, words = pack(flat, lengths, canonical(lengths)[0])
    packed = zlib.compress(lengths.tobytes(), 6)
    nulls = np.array([x is None for x in doc_ids], np.uint8)
    keys = np.array([x or 0 for x in doc_ids], np.int64)
    counts = np.array([len(x) for x in ids], np.uint32)
    head = HEADER.pack(MAGIC, len(ids), len(flat), len(checkpoints), BLOCK, LIMIT, len(packed))
    return b"".join([head, packed, keys.tobytes(), nulls.tobytes(), counts.tobytes(), checkpoints.tobytes(), words.tobytes()])


def read_bytes(content: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    magic, n_docs, n_ids, n_blocks, block, limit, packed = HEADER.unpack_from(content)
    if magic != MAGIC:
        raise ValueError("not a token file")
    at = HEADER.size
    lengths = np.frombuffer(zlib.decompress(content[at : at + packed]), np.uint8)
    at += packed

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        array = np.frombuffer(content, kind, n, at)
        at += array.nbytes
        return array

    keys, nulls, counts, checkpoints = take("<i8", n_docs), take("u1", n_docs), take("<u4", n_docs), take("<u8", n_blocks)
    words = take("<u4", (len(content) - at) // 4)
    flat = unpack(n_ids, checkpoints, words, lengths, limit, block)
    ends = np.cumsum(counts, dtype=np.int64)
    return [None if z else int(k) for k, z in zip(keys, nulls)], [flat[e - c : e] for c, e in zip(counts.astype(np.int64), ends)]


def tokenise(docs: DataFrame, model: str, end_id: int, size: int) -> DataFrame:
    """(doc_id, text, tie) as doc_id, tie, serial, ids (bytes); and a row per task with ``counts``, pairs of id and frequency.

    serial tells rows that are equal in all else apart, so that ranges of rows can part them.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = ["doc_id", "tie", "serial", "ids", "counts"]

    def run(batches):
        tokens = text_tokens(shared.value, end_id)
        serial, counts = TaskContext.get().partitionId() << 40, np.zeros(size, np.int64)
        for batch in batches:
            flat, many = tokens.encode(batch.column(1).cast(pa.binary()).to_pylist())
            counts += np.bincount(flat, minlength=size)
            n = len(many)
            ends = np.concatenate([[0], np.cumsum(many * tokens.kind.itemsize)]).astype(np.int32)
            ids = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(flat.tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(np.arange(serial, serial + n)), ids, pa.nulls(n, pa.binary())], names=names)
            serial += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([*(pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.int64(), pa.binary())), pa.array([np.stack([used, counts[used]]).tobytes()], pa.binary())], names=names)

    return docs.mapInArrow(run, "doc_id long, tie string, serial long, ids binary, counts binary")


def count_tokens(tokenised: DataFrame, size: int) -> np.ndarray:
    """How often each id occurs over all documents. The result is as large as the vocabulary."""

    def run(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for part in batch.column(0):
                ids, n = np.frombuffer(part.as_buffer(), np.int64).reshape(2, -1)
                counts[ids] += n
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(counts[used])], names=["id", "n"])

    rows = tokenised.where("counts is not null").select("counts").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(size, np.int64)
    counts[rows["id"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with the scheme that Spark would take for it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    full = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return re.sub("^file:/(?!/)", "file:///", full)


def write_tokens(docs: DataFrame, model: str, *, end_id: int, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> tuple[str, DataFrame]:
    """Write all documents' ids (each with ``end_id`` appended) as token files; the folder, and a row per file.

    Texts are encoded where they lie; only ids are dealt to files, by ranges of the document ids, nulls first. Rows with
    the same id follow one another in order of their texts (only theirs travel), and may go to several files. A null or empty text
    has the end id only. An empty table gives no file. Files are written under a name of the task's own and then
    renamed, so repeated tasks do no harm. A folder without a scheme lies on Spark's default file system.
    """
    spark = docs.sparkSession
    kind = WordTokens(model).kind
    size = max(Tokenizer.from_str(model).get_vocab_size(with_added_tokens=True), end_id + 1)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    repeated = materialize(rows.groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("again"), F.lit(True).alias("is_again")), "repeated")
    if repeated.isEmpty():
        rows = rows.withColumn("tie", F.lit(None).cast("string"))
    else:
        rows = rows.join(repeated, F.col("doc_id").eqNullSafe(F.col("again")), "left").select("doc_id", "text", F.when(F.col("is_again"), F.col("text")).alias("tie"))
    tokenised = materialize(tokenise(rows, model, end_id, size), "ids")
    lengths = spark.sparkContext.broadcast(code_lengths(count_tokens(tokenised, size)))
    folder = qualified(spark, folder or new_path(spark, "tokens"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("tie").asc_nulls_first(), F.col("serial")]
    dealt = tokenised.where("counts is null").select("doc_id", "tie", "serial", "ids").repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)

    def run(batches):
        store, root = pa.fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        keys: list = []
        ids: list = []
        place = waiting = 0

        def flush():
            name = f"part-{part:07d}-{place:010d}.hfx"
            own = f"{root}/_{name}.{attempt}"
            with store.open_output_stream(own) as out:
                out.write(write_bytes(keys, ids, lengths.value))
            store.move(own, f"{root}/{name}")
            row = pa.RecordBatch.from_arrays([pa.array([name]), *(pa.array([x], pa.int64()) for x in (part, place, len(keys), waiting))], names=["file", "part", "place", "n_docs", "n_ids"])
            keys.clear()
            ids.clear()
            return row

        for batch in batches:
            for key, found in zip(batch.column(0).to_pylist(), batch.column(3)):
                if waiting >= FILE_IDS:
                    yield flush()
                    place, waiting = place + 1, 0
                keys.append(key)
                ids.append(np.frombuffer(found.as_buffer(), kind))
                waiting += len(ids[-1])
        if keys:
            yield flush()

    written = materialize(dealt.mapInArrow(run, "file string, part long, place long, n_docs long, n_ids long"), "token-files")
    for table in (tokenised, repeated):
        discard(table)
    return folder, written


def read_tokens(spark: SparkSession, folder: str, files: DataFrame, digest: tuple[str, str, Callable] | None = None) -> DataFrame:
    """Documents of the token files: doc_id, start, n_tokens, ids. ``start`` counts the ids of all documents before it.

    digest: name, SQL type and function of a column that stands for ``ids``; it is computed where the ids are decoded.
    """
    order = Window.orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    starts = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("file_start"))
    column, ddl, function = digest or ("ids", "array<int>", None)

    def run(batches):
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                keys, ids = read_bytes(content.as_py())
                counts = np.array([len(x) for x in ids], np.int64)
                offsets = np.concatenate([[0], np.cumsum(counts)])
                name = path.rsplit("/", 1)[-1]
                for at in range(0, len(keys), 500):
                    part = ids[at : at + 500]
                    inner = (offsets[at : at + len(part) + 1] - offsets[at]).astype(np.int32)
                    made = pa.array([function(x) for x in part]) if function else pa.ListArray.from_arrays(pa.array(inner), pa.array(np.concatenate(part).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(part)), pa.array(keys[at : at + 500], pa.int64()), pa.array(offsets[at : at + len(part)]), pa.array(counts[at : at + 500]), made], names=["file", "doc_id", "within", "n_tokens", column])

    if files.isEmpty():
        return spark.createDataFrame([], f"doc_id long, start long, n_tokens long, {column} {ddl}")
    content = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.hfx").load(folder).select("path", "content")
    decoded = content.mapInArrow(run, f"file string, doc_id long, within long, n_tokens long, {column} {ddl}")
    return decoded.join(starts, "file").select("doc_id", (F.col("file_start") + F.col("within")).alias("start"), "n_tokens", column)
