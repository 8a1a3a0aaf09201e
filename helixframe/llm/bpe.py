"""Byte-level BPE encoding and decoding with a sentencepiece model made from the vocabulary.

Each byte stands for one printable character, so that the pieces of the vocabulary become strings. The model is
serialised directly: pieces in order of rank with the negative rank as score, identity normalisation. A pre-token is
encoded by the model unless it is a piece itself; ids are decoded by the inverse mapping.
"""

from __future__ import annotations

import base64
import itertools
import struct

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame

from helixframe.llm.arrow import add_columns

#: Pre-tokens that a task remembers before it starts anew.
MEMO = 200_000
UNKNOWN = ""


def byte_characters() -> list[str]:
    """A printable character for each byte: its own where Latin-1 has a visible one, else one from 256 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    hidden = [b for b in range(256) if b not in set(visible)]
    return [chr(b) if b in set(visible) else chr(256 + hidden.index(b)) for b in range(256)]


def read_ranks(content: bytes) -> list[bytes]:
    """Pieces in order of rank, from lines of base64 and rank."""
    ranks = {int(r): base64.b64decode(p) for p, r in (line.split() for line in content.splitlines() if line)}
    return [ranks[i] for i in range(len(ranks))]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes(out + bytes([n]))


def _field(number: int, payload: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(payload)) + payload


def _number(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def serialise(pieces: list[bytes]) -> bytes:
    """The protobuf of a BPE model whose id 0 is unknown and whose id r + 1 is the piece of rank r."""
    characters = byte_characters()
    out = [_field(1, _field(1, UNKNOWN.encode()) + _varint(2 << 3 | 5) + struct.pack("<f", 0.0) + _number(3, 2))]
    for rank, piece in enumerate(pieces):
        out.append(_field(1, _field(1, "".join(characters[b] for b in piece).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -float(rank))))
    trainer = _number(3, 2) + _number(4, len(pieces) + 1) + _number(40, 0) + _number(41, (1 << 64) - 1) + _number(42, (1 << 64) - 1) + _number(43, (1 << 64) - 1) + _field(45, UNKNOWN.encode())
    normaliser = _field(1, b"identity") + _number(3, 0) + _number(4, 0) + _number(5, 0)
    return b"".join([*out, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Encodes texts by pre-tokens; remembers the ids of up to MEMO of them as bytes."""

    def __init__(self, pieces: list[bytes], pattern: str):
        self.pieces, self.find = pieces, regex.compile(pattern).findall
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialise(pieces))
        self.whole = {p: np.int32(r).tobytes() for r, p in enumerate(pieces)}
        self.characters = dict(enumerate(byte_characters()))
        self.memo: dict[str, bytes] = {}

    def _learn(self, tokens: set[str]) -> None:
        rest, mapped = [], []
        for token in tokens:
            raw = token.encode()
            if (ids := self.whole.get(raw)) is not None:
                self.memo[token] = ids
            else:
                rest.append(token)
                mapped.append(raw.decode("latin-1").translate(self.characters))
        for at in range(0, len(rest), 5000):
            coded = self.model.encode(mapped[at : at + 5000], out_type=int, num_threads=1)
            flat = (np.fromiter(itertools.chain.from_iterable(coded), np.int32) - 1).tobytes()
            start = 0
            for token, ids in zip(rest[at : at + 5000], coded, strict=True):
                end = start + 4 * len(ids)
                self.memo[token] = flat[start:end]
                start = end

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray]:
        """The int32 ids of each text."""
        found = [self.find(x) if x else [] for x in texts]
        if new := set().union(*found).difference(self.memo):
            if len(self.memo) + len(new) > MEMO:
                self.memo.clear()
                new = set().union(*found)
            self._learn(new)
        look = self.memo.__getitem__
        return [np.frombuffer(b"".join(map(look, tokens)), np.int32) for tokens in found]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids.tolist()))


def encode(docs: DataFrame, pieces: list[bytes], pattern: str, text_col: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids array<int>`` of each whole text; one output row per input row.

    decoded: also ``decoded binary``, the bytes that these ids decode to, made in the same pass. A null or empty text has no ids. Special tokens get no treatment. Input columns of these names are replaced. An empty
    table gives an empty table. The vocabulary, of fixed size, travels with the task.
    """
    at = docs.columns.index(text_col)
    vocabulary = docs.sparkSession.sparkContext.broadcast(pieces)

    def compute(column: int):
        codec = Codec(vocabulary.value, pattern)

        def run(batch: pa.RecordBatch) -> list:
            texts = batch.column(column).to_pylist()
            ids = [x for at in range(0, len(texts), 200) for x in codec.encode_all(texts[at : at + 200])]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            return [lists, [codec.decode(x) for x in ids]] if decoded else [lists]

        return run

    return add_columns(docs, "ids array<int>, decoded binary" if decoded else "ids array<int>", compute, at)


def decode(encoded: DataFrame, pieces: list[bytes], ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded binary``: the bytes of the ids. Null ids give null, an id beyond the vocabulary fails."""
    at = encoded.columns.index(ids_col)
    vocabulary = encoded.sparkSession.sparkContext.broadcast(pieces)

    def compute(column: int):
        table = vocabulary.value

        def run(batch: pa.RecordBatch) -> list:
            array = batch.column(column)
            flat, offsets = array.values.to_numpy(zero_copy_only=False), array.offsets.to_numpy()
            valid = array.is_valid().to_numpy(zero_copy_only=False)
            return [[b"".join(map(table.__getitem__, flat[a:b].tolist())) if ok else None for a, b, ok in zip(offsets, offsets[1:], valid)]]

        return run

    return add_columns(encoded, "decoded binary", compute, at)
