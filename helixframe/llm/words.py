"""64-bit hashes of the words of texts, computed over whole arrays of bytes.

Words are runs of anything but space and the controls 9 to 13, after A-Z are lower-cased. The hash of a word is a
polynomial over random 64-bit values of its bytes, taken from running sums and then mixed.
"""

from __future__ import annotations

import functools

import numpy as np

U = np.uint64
#: Texts are joined up to about this many bytes, so that the arrays stay in the cache.
CHUNK = 1 << 17
BASE = 0x9E3779B97F4A7C15


@functools.cache
def _tables(plain: bool) -> tuple[np.ndarray, np.ndarray]:
    values = np.random.Generator(np.random.PCG64(20240607)).integers(1, 2**64, 256, dtype=np.uint64) | U(1)
    values[65:91] = values[97:123]
    blank = np.zeros(256, bool)
    blank[[9, 10, 11, 12, 13, 32]] = True
    if plain:
        blank[[c for c in range(128) if not chr(c).isalnum()]] = True
    return values, blank


_powers: dict[str, np.ndarray] = {}


def _power(name: str, base: int, n: int) -> np.ndarray:
    if name not in _powers or len(_powers[name]) < n:
        _powers[name] = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 2 * CHUNK), U(base))]), dtype=np.uint64)
    return _powers[name][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the spans of bytes; none of them starts at 0."""
    values, _ = _tables(False)
    sums = np.cumsum(values[data] * _power("up", BASE, len(data)), dtype=np.uint64)
    spans = (sums[ends - 1] - sums[starts - 1]) * _power("down", pow(BASE, -1, 1 << 64), len(data))[starts]
    return mix(spans + (ends - starts).astype(U) * STEP)


def _chunk(texts: list[bytes], plain: bool) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" " + b" ".join(texts) + b" ", np.uint8)
    values, blank = _tables(plain)
    edges = np.flatnonzero(np.diff(blank[data])) + 1
    starts, ends = edges[0::2], edges[1::2]
    n = len(data)
    sums = np.cumsum(values[data] * _power("up", BASE, n), dtype=np.uint64)
    words = mix((sums[ends - 1] - sums[starts - 1]) * _power("down", pow(BASE, -1, 1 << 64), n)[starts])
    limits = 1 + np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, limits), prepend=0)


def word_hashes(texts: list[str | None], plain: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and the number of words of each text. plain: ASCII punctuation also parts words."""
    hashes, counts, waiting, size = [], [], [], 0
    for text in texts:
        raw = text.encode("utf-8", "surrogatepass") if text else b""
        if waiting and size + len(raw) > CHUNK:
            h, c = _chunk(waiting, plain)
            hashes.append(h)
            counts.append(c)
            waiting, size = [], 0
        waiting.append(raw)
        size += len(raw) + 1
    if waiting:
        h, c = _chunk(waiting, plain)
        hashes.append(h)
        counts.append(c)
    if not hashes:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(counts)


#: Odd multipliers for the words of a shingle, first to last, and for sequences shorter than a shingle by their length.
STEP = U(0xC2B2AE3D27D4EB4F)


def shingle_sets(texts: list[str | None], width: int = 5) -> list[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of ``width`` words; the whole sequence if it has fewer words."""
    words, counts = word_hashes(texts)
    run = words.copy()
    n = len(words)
    for k in range(1, width):
        run[: n - k] = run[: n - k] * STEP + words[k:]
    run = mix(run)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            s = np.sort(run[at : at + c - width + 1])
            if len(s) > 1:
                keep = np.empty(len(s), bool)
                keep[0] = True
                np.not_equal(s[1:], s[:-1], out=keep[1:])
                if not keep.all():
                    s = s[keep]
            out.append(s)
        elif c:
            h = 0
            for w in words[at : at + c].tolist():
                h = (h * int(STEP) + w + c) & 0xFFFFFFFFFFFFFFFF
            out.append(mix(np.array([h ^ c], U)))
        else:
            out.append(np.zeros(0, U))
        at += c
    return out
