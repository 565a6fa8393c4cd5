"""Words of many texts at once, as numpy arrays over the bytes of an Arrow string column.

A *word* is a run of bytes other than ASCII white space, so words never need decoding.
Hashes are 64-bit: a polynomial over the bytes, then a mixing step.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: All ASCII characters but letters and digits.
PUNCTUATION = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])

CHUNK_BYTES = 2 << 20
_BASE = 0x9E6C63D0876A9A35 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    kept = _powers.get(base)
    if kept is None or len(kept) < n:
        steps = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        steps[0] = 1
        kept = _powers[base] = np.multiply.accumulate(steps)
    return kept


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of ``x`` (uint64) over the whole word."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seeded(x: np.ndarray, seed: int) -> np.ndarray:
    return mix(x + np.uint64((0x9E3779B97F4A7C15 * (2 * seed + 1)) & 0xFFFFFFFFFFFFFFFF))


@dataclass
class Texts:
    """Bytes of consecutive texts; text ``d`` has the bytes ``offsets[d]:offsets[d + 1]`` and the words ``bounds[d]:bounds[d + 1]``."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        """The text of each word."""
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))

    def sums(self, flags: np.ndarray) -> np.ndarray:
        """Set flags of bytes, counted per text."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def word_sums(self, values: np.ndarray) -> np.ndarray:
        """Values of words, added up per text."""
        total = np.zeros(len(values) + 1, np.float64 if values.dtype.kind == "f" else np.int64)
        np.cumsum(values, out=total[1:])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]

    def hashes(self, starts: np.ndarray | None = None, ends: np.ndarray | None = None) -> np.ndarray:
        """Hash of each word, or of each of the given byte ranges."""
        starts, ends = (self.starts, self.ends) if starts is None else (starts, ends)
        n = len(self.data)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * _power(_BASE, n + 1)[:n], out=total[1:])
        shifted = (total[ends] - total[starts]) * _power(_INVERSE, n + 1)[starts]
        return mix(shifted + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))

    def distinct(self, places: bool = False) -> tuple[np.ndarray, ...]:
        """Hash and text (and, with ``places``, one place) of each distinct word of each text, by text, then hash."""
        hashes, owner = self.hashes(), self.owner
        order = np.lexsort((hashes, owner))
        hashes, owner = hashes[order], owner[order]
        new = np.ones(len(hashes), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        return (hashes[new], owner[new], order[new]) if places else (hashes[new], owner[new])

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each run of ``width`` words and whether the run lies inside one text."""
        n = len(hashes) - width + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        out = np.zeros(n, np.uint64)
        for j in range(width):
            out = out * np.uint64(0xD1342543DE82EF95) + hashes[j : j + n]
        owner = self.owner
        return mix(out), owner[:n] == owner[width - 1 :]


def parse(column: pa.Array, lower: bool = True, between: np.ndarray = SPACE) -> Texts:
    """Texts of an Arrow string column; nulls count as empty. ``between`` marks the bytes that part words."""
    column = pc.fill_null(column, "") if column.null_count else column
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, where, raw = column.buffers()
    offsets = np.frombuffer(where, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    if lower:
        data = LOWER[data]
    inside = ~between[data]
    cut = np.zeros(len(data) + 1, bool)
    cut[offsets] = True
    before = np.empty(len(data), bool)
    before[:1] = True
    before[1:] = ~inside[:-1]
    starts = np.flatnonzero(inside & (before | cut[:-1]))
    after = np.empty(len(data), bool)
    after[-1:] = True
    after[:-1] = ~inside[1:]
    ends = np.flatnonzero(inside & (after | cut[1:])) + 1
    return Texts(data, offsets, starts, ends, np.searchsorted(starts, offsets))


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; a longer text is a slice of its own."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(lengths) // limit
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(lengths)]])
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)
