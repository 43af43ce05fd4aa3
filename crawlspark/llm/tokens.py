"""Words of whole texts as 64-bit hashes, for code that runs inside Arrow tasks.

A word is a maximal run of ``[^\\x20\\x09-\\x0D]``. Texts stay UTF-8 bytes; every
function works on a slice of a column, so memory is bounded by ``SLICE_BYTES``
plus one text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (splitmix64's last step)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_table(size: int, seed: int) -> np.ndarray:
    """``size`` fixed odd 64-bit numbers."""
    steps = (np.arange(size, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(steps + mix(np.array([seed], np.uint64))) | np.uint64(1)


_PLACES = random_table(256, 1)


def _places(size: int) -> np.ndarray:
    global _PLACES
    if size > len(_PLACES):
        _PLACES = random_table(max(size, 2 * len(_PLACES)), 1)
    return _PLACES


def lower_ascii(data: np.ndarray) -> np.ndarray:
    """A copy with A-Z in lower case."""
    return _LOWER[data]


@dataclass
class Texts:
    """Texts ``i`` are ``data[offsets[i]:offsets[i + 1]]``; null texts are empty."""

    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1


def texts(column: pa.Array) -> Texts:
    column = pc.fill_null(column.cast(pa.large_string()), "")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] else np.zeros(0, np.uint8)
    return Texts(data, offsets)


def slices(column: pa.Array, size: int = SLICE_BYTES) -> Iterator[tuple[int, int, Texts]]:
    """Runs of rows ``lo`` to ``hi`` with about ``size`` bytes of text each."""
    whole, lo = texts(column), 0
    while lo < len(whole):
        end = whole.offsets[lo] + size
        hi = max(lo + 1, int(np.searchsorted(whole.offsets, end, "right")) - 1)
        part = whole.offsets[lo : hi + 1]
        yield lo, hi, Texts(whole.data[part[0] : part[-1]], part - part[0])
        lo = hi


@dataclass
class Words:
    """Words of a slice; those of text ``i`` are ``first[i]`` to ``first[i + 1]``."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(part: Texts, lower: bool = False, keep: np.ndarray | None = None) -> Words:
    """Words with their hashes. ``keep`` marks the bytes that count in a hash."""
    data, offsets = part.data, part.offsets
    inside = ~_SPACE[data]
    edges = np.zeros(len(data) + 1, bool)
    edges[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    starts = np.flatnonzero(inside & (edges[:-1] | ~before))
    ends = np.flatnonzero(inside & (edges[1:] | ~after)) + 1
    counted = inside if keep is None else inside & keep[data]
    hashes = span_hashes(_LOWER[data] if lower else data, counted, starts, ends)
    return Words(starts, ends, hashes, np.searchsorted(starts, offsets))


def span_hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of the bytes marked ``inside`` of each span; 0 for a span without any."""
    at = np.flatnonzero(inside)
    begin = np.searchsorted(at, starts)
    lengths = np.searchsorted(at, ends) - begin
    some = lengths > 0
    out = np.zeros(len(starts), np.uint64)
    if not some.any():
        return out
    place = np.arange(len(at)) - np.repeat(begin[some], lengths[some])
    terms = (data[at].astype(np.uint64) + np.uint64(1)) * _places(int(lengths.max()))[place]
    out[some] = mix(np.add.reduceat(terms, begin[some]) + lengths[some].astype(np.uint64))
    return out


def windows(hashes: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``size`` words inside a text, and their bounds by text."""
    at, bounds = window_starts(first, size)
    return window_hashes(hashes, at, size), bounds


def window_starts(first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all runs of ``size`` words inside a text, and their bounds by text."""
    counts = np.maximum(np.diff(first) - size + 1, 0)
    bounds = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(bounds[-1]) + np.repeat(first[:-1] - bounds[:-1], counts), bounds


def window_hashes(hashes: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words that begin at ``at``."""
    run = np.full(len(at), size, np.uint64)
    for k in range(size):
        run = mix(run * np.uint64(0x9E3779B97F4A7C15) + hashes[at + k])
    return run
