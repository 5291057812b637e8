"""Wavelet matrix of one run of token ids: bit-planes with rank samples.

The planes are stored from the highest bit down. Below each plane the ids are
in stable order of that bit, zeros first, so that rank on a plane leads to the
place on the next one, and select leads back.
"""

from __future__ import annotations

import numpy as np

#: Bytes of a plane between two rank samples.
BLOCK = 64


def _samples(plane: np.ndarray) -> np.ndarray:
    """Ones before each block of a plane, and in the end all."""
    per_block = np.add.reduceat(np.bitwise_count(plane).astype(np.uint32), np.arange(0, len(plane), BLOCK)) if len(plane) else np.empty(0, np.uint32)
    return np.concatenate([[0], np.cumsum(per_block)]).astype(np.uint32)


class WaveletMatrix:
    """n ids in as many planes as they have bits; zeros is the number of zero bits of each plane."""

    def __init__(self, n: int, planes: list[np.ndarray], samples: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.samples, self.zeros = n, planes, samples, zeros

    @classmethod
    def of(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        planes, samples, zeros = [], [], []
        ids = ids.astype(np.uint16) if bits <= 16 else ids  # half the memory to move
        for b in range(bits - 1, -1, -1):
            one = (ids >> b & 1).astype(bool)
            planes.append(np.packbits(one, bitorder="little"))
            samples.append(_samples(planes[-1]))
            ids = np.concatenate([ids[~one], ids[one]])
            zeros.append(int(len(ids) - samples[-1][-1]))
        return cls(len(ids), planes, samples, zeros)

    def ids(self) -> np.ndarray:
        """All ids in order: the stable partitions are undone from the lowest plane up."""
        out = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for b, (plane, zeros) in enumerate(zip(self.planes[::-1], self.zeros[::-1])):
            one = np.unpackbits(plane, count=self.n, bitorder="little").astype(bool)
            above = np.empty_like(out)
            above[~one], above[one] = out[:zeros], out[zeros:] | out.dtype.type(1 << b)
            out = above
        return out.astype(np.uint32)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Rank: the ones of a plane before each place."""
        plane = self.planes[level]
        block = at // (8 * BLOCK)
        out = self.samples[level][block].astype(np.int64)
        inside = block[:, None] * BLOCK + np.arange(BLOCK)
        left = np.clip(at[:, None] - 8 * inside, 0, 8)
        some = np.where(inside < len(plane), plane[np.minimum(inside, len(plane) - 1)], 0) & ((1 << left) - 1)
        return out + np.bitwise_count(some.astype(np.uint8)).sum(axis=1, dtype=np.int64)

    def _select(self, level: int, bit: int, nth: np.ndarray) -> np.ndarray:
        """The place of the nth (from 0) zero or one of a plane."""
        ones = self.samples[level].astype(np.int64)
        count = ones if bit else np.minimum(np.arange(len(ones)) * 8 * BLOCK, self.n) - ones
        block = np.searchsorted(count, nth, "right") - 1
        inside = block[:, None] * BLOCK + np.arange(BLOCK)
        plane = self.planes[level]
        found = np.unpackbits(plane[np.minimum(inside, len(plane) - 1)], axis=1, bitorder="little") == bit
        found &= np.repeat(inside < len(plane), 8, axis=1)
        return block * 8 * BLOCK + np.argmax(np.cumsum(found, axis=1) > (nth - count[block])[:, None], axis=1)

    def access(self, at: np.ndarray) -> np.ndarray:
        """The ids at places."""
        at, out = np.asarray(at, np.int64), np.zeros(len(at), np.int64)
        for level, (plane, zeros) in enumerate(zip(self.planes, self.zeros)):
            one = (plane[at // 8] >> (at % 8) & 1).astype(bool) if self.n else np.zeros(len(at), bool)
            rank = self._ones(level, at)
            at, out = np.where(one, zeros + rank, at - rank), out << 1 | one
        return out

    def _range(self, token: int, begin: int, end: int) -> tuple[int, int]:
        """Where the occurrences of a token from begin up to end are below the last plane."""
        ends = np.array([begin, end])
        if token >> len(self.planes):
            return 0, 0
        for level in range(len(self.planes)):
            rank = self._ones(level, ends)
            ends = self.zeros[level] + rank if token >> (len(self.planes) - 1 - level) & 1 else ends - rank
        return int(ends[0]), int(ends[1])

    def count(self, token: int, begin: int = 0, end: int | None = None) -> int:
        """How often the token stands from begin up to end."""
        first, last = self._range(token, begin, self.n if end is None else end) if self.n else (0, 0)
        return last - first

    def places(self, token: int, step: int = 1 << 14) -> np.ndarray:
        """All places of the token, ascending; select runs on ``step`` of them at a time."""
        first, last = self._range(token, 0, self.n) if self.n else (0, 0)
        out = []
        for lo in range(first, last, step):
            at = np.arange(lo, min(last, lo + step))
            for level in range(len(self.planes) - 1, -1, -1):
                one = token >> (len(self.planes) - 1 - level) & 1
                at = self._select(level, one, at - self.zeros[level] if one else at)
            out.append(at)
        return np.concatenate(out) if out else np.empty(0, np.int64)
