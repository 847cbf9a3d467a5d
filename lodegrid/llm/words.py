"""Words of whole texts as flat arrays: the shared kernel of the operators on words.

A batch of texts is one run of UTF-8 bytes.  Word classes of the contracts are
sets of ASCII bytes plus all bytes from 0x80, so lower-casing A-Z and word borders
are table look-ups over bytes.  A word's hash takes its bytes by eights through two
64-bit lanes that don't mix linearly, all words at once: one round for each eight
bytes of the longest, over those words that have as many; words above ``LONG`` bytes
are hashed by BLAKE2b.  No Python code runs for each common word.  Work goes in slices
of about ``SLICE_BYTES``, never splitting a text, so memory is bounded by the slice or
the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
#: Words of more bytes are hashed one by one.
LONG = 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Words of the class [^\x20\x09-\x0D].
SPACED = np.ones(256, dtype=bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: Words of the class [^\x00-\x2F\x3A-\x60\x7B-\x7F] after lower-casing.
ALNUM = np.zeros(256, dtype=bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True

_U = np.uint64
#: Masks of the first 0 to 8 bytes of a little-endian number.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: a bijection on 64-bit integers."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _absorb(a: np.ndarray, b: np.ndarray, chunk: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two lanes after eight more bytes."""
    lane = (b + chunk) * _U(0xD6E8FEB86659FD93)
    return mix64(a ^ chunk), lane ^ (lane >> _U(32))


def hash_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each of some runs of bytes; only the bytes decide it."""
    eights = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    size = ends - starts
    a, b = size.astype(np.uint64) * _U(0x9E3779B97F4A7C15), size.astype(np.uint64) + _U(0xC2B2AE3D27D4EB4F)
    a, b = _absorb(a, b, eights[starts] & _FIRST[np.minimum(size, 8)])
    live = np.flatnonzero((size > 8) & (size <= LONG))
    at, left = starts[live] + 8, size[live] - 8
    while len(live):
        a[live], b[live] = _absorb(a[live], b[live], eights[at] & _FIRST[np.minimum(left, 8)])
        more = np.flatnonzero(left > 8)
        live, at, left = live[more], at[more] + 8, left[more] - 8
    out = mix64(a ^ (b * _U(0xA0761D6478BD642F)))
    for i in np.flatnonzero(size > LONG).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


@dataclass
class Texts:
    """Some texts as bytes: text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""

    data: np.ndarray
    offsets: np.ndarray
    first: int

    def __len__(self) -> int:
        return len(self.offsets) - 1


def slices(column: pa.Array | pa.ChunkedArray) -> Iterator[Texts]:
    """The texts of an Arrow column, null as empty, in slices."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    if not pa.types.is_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    if not n:
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1)
        yield Texts(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at], at)
        at = end


@dataclass
class Words:
    """Words of some texts in order: ``counts[i]`` of them are text ``i``'s."""

    starts: np.ndarray
    ends: np.ndarray
    counts: np.ndarray
    lowered: np.ndarray

    @property
    def first(self) -> np.ndarray:
        """Where each text's words start, and the end."""
        return np.concatenate(([0], np.cumsum(self.counts)))

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.counts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each lower-cased word's bytes."""
        return hash_runs(self.lowered, self.starts, self.ends)

    def strings(self) -> pa.Array:
        """The lower-cased words as an Arrow array."""
        inside = np.zeros(len(self.lowered) + 1, np.int8)
        inside[self.starts] += 1
        inside[self.ends] -= 1
        kept = self.lowered[np.cumsum(inside[:-1]).astype(bool)]
        offsets = np.concatenate(([0], np.cumsum(self.ends - self.starts))).astype(np.int32)
        return pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(kept)))


def split(texts: Texts, kind: np.ndarray = SPACED, lower: bool = True) -> Words:
    """Words: maximal runs of bytes of ``kind``, within each text."""
    data = _LOWER[texts.data] if lower else texts.data
    n = len(data)
    inside = kind[data]
    borders = texts.offsets[1:-1]
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    before[borders[borders < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    after[borders[borders > 0] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    counts = np.diff(np.searchsorted(starts, texts.offsets))
    return Words(starts, ends, counts, data)


_ODD = np.random.default_rng(7).integers(1, 1 << 63, 64, dtype=np.uint64) * _U(2) + _U(1)


def shingles(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``k`` words within texts, and how many each text has.

    A text of fewer words, but not none, has one: its whole sequence.
    """
    n = len(hashes)
    first = np.concatenate(([0], np.cumsum(counts)))
    short = (counts < k) & (counts > 0)
    made = np.where(short, 1, np.maximum(counts - k + 1, 0))
    out = np.zeros(n, np.uint64)
    if n >= k:
        for j in range(k):
            out[: n - k + 1] += hashes[j : n - k + 1 + j] * _ODD[j]
    for i in np.flatnonzero(short):
        own = hashes[first[i] : first[i] + counts[i]]
        out[first[i]] = (own * _ODD[: len(own)]).sum(dtype=np.uint64) + _U(len(own))
    keep = np.zeros(n + 1, np.int32)
    np.add.at(keep, first[:-1], 1)
    np.add.at(keep, first[:-1] + made, -1)
    return mix64(out[np.cumsum(keep[:-1]).astype(bool)]), made


def distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's values sorted, each once, and how many each text has."""
    first = np.concatenate(([0], np.cumsum(counts)))
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][counts > 0]] = True
    sums = np.concatenate(([0], np.cumsum(new)))
    return values[new], sums[first[1:]] - sums[first[:-1]]
