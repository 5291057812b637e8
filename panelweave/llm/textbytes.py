"""Words and shingles of many texts at once, as numpy arrays over UTF-8 bytes.

Texts arrive as one Arrow buffer. Hashes of all words of a slice come from one
prefix sum of a polynomial modulo 2**64 (over random byte values), so no
Python object is made for a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 2**64)
_BYTE = np.random.default_rng(20240229).integers(1, 2**63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(1 << 20, 1 << n.bit_length())
        have = np.empty(size, np.uint64)
        have[0] = 1
        with np.errstate(over="ignore"):
            filled = 1
            while filled < size:
                step = min(filled, size - filled)
                have[filled : filled + step] = have[:step] * _U(pow(base, filled, 2**64))
                filled += step
        if n <= 1 << 24:
            _powers[base] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: every input bit moves every output bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) for runs of whole texts of about most_bytes; null is empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    if not len(texts):
        return
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + most_bytes, "right")) - 1)
        yield at, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def words(data: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, doc): byte spans of maximal runs of non-separators, and each one's row."""
    solid = np.zeros(len(data) + 2, bool)
    solid[1:-1] = ~separators[data]
    begins = solid[1:] & ~solid[:-1]
    inner = offsets[1:-1][offsets[1:-1] < len(data)]
    begins[inner] |= solid[1:][inner]
    closes = solid[:-1] & ~solid[1:]
    closes[inner] |= solid[:-1][inner]
    starts, ends = np.flatnonzero(begins), np.flatnonzero(closes)
    doc = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, doc


class Spans:
    """Hashes of any byte spans of one slice, ASCII letters lower-cased unless ``fold`` is false."""

    def __init__(self, data: np.ndarray, fold: bool = True):
        self.powers = _power(_BASE, len(data) + 1)
        self.inverse = _power(_INVERSE, len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_BYTE[_LOWER[data] if fold else data] * self.powers[: len(data)], dtype=np.uint64)])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            value = (self.sums[ends] - self.sums[starts]) * self.inverse[starts]
            return mix(value ^ ((ends - starts).astype(np.uint64) * _U(0xD6E8FEB86659FD93)))


def shingle_sets(texts: pa.Array, width: int = 5) -> Iterator[np.ndarray]:
    """Per text, the sorted distinct 64-bit hashes of its shingles of ``width`` words.

    Fewer words than ``width``: the whole sequence is the one shingle. No word: empty.
    """
    for _, data, offsets in slices(texts):
        starts, ends, doc = words(data, offsets)
        h = Spans(data).hash(starts, ends)
        with np.errstate(over="ignore"):
            whole = np.zeros(max(0, len(h) - width + 1), np.uint64)
            for k in range(width):
                whole = whole * _U(0xA0761D6478BD642F) + h[k : len(h) - width + 1 + k]
        whole = mix(whole)
        first = np.searchsorted(doc, np.arange(len(offsets)))
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= width:
                yield np.unique(whole[a : b - width + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    value = _U(b - a)
                    for x in h[a:b]:
                        value = value * _U(0xE7037ED1A0B428DB) + x
                yield mix(np.array([value], np.uint64))
            else:
                yield np.empty(0, np.uint64)
