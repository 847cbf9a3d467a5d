"""Periodic runs of words: every stretch that repeats with a period and can't be extended.

A run [s, e] of smallest period q has at least 2q words, words q apart in it are equal, and neither
neighbour keeps that.  All runs of a text are enumerated so:

* suffix array and LCP array by prefix doubling; the ranks of all its rounds are kept, as they tell the
  longest common extension of any two places, forward and backward, in a logarithmic number of look-ups,
* the longest previous factor of each place, from nearest smaller places in the suffix array
  (pointers that jump over pointers, carrying the least LCP on the way), and where it stands before,
* LZ blocks: from the left, each the longest previous factor,
* Main's extensions at each border of blocks: a run that touches a border, and ends in the block behind it or just before
  it, has a period of at most the lengths of the two blocks; for each such period the extensions
  to both sides tell the run,
* runs strictly inside a block are those strictly inside its earlier occurrence: copied,
  from buckets of runs by where they start, from left to right.

All this is numpy over a slice of texts at once, but for the walk over blocks and the copying.
Before it, words are left out that no run can hold: a word must be twice in its stretch of
such words, and a stretch must have the least length asked for; so common prose costs little.

The memory of a task grows with a slice (``words.SLICE_BYTES``) or the longest text: some
hundred bytes for each of its words that are left, and 4 more for each round of doubling.

Defined cases: null and empty texts have no words and no runs; very long texts are taken whole;
repeated rows and null ids are rows as any; an empty table gives an empty one; other columns stay, but for
those of the results' names.  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lodegrid.llm import words as W
from lodegrid.llm.arrow import lists, map_arrow, with_columns

#: The fewest words of a run that is asked for.
LEAST = 12
#: Pairs of a border and a period that are looked at at once.
PAIRS = 1 << 20
#: Rounds of leaving out words that no run can hold; any number gives the same runs.
ROUNDS = 6


def _spread(n: np.ndarray) -> np.ndarray:
    """0, 1, ..., n - 1 for each n."""
    upto = np.cumsum(n)
    return np.arange(upto[-1] if len(n) else 0) - np.repeat(upto - n, n)


def stretches(key: np.ndarray, part: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that runs may hold, and the stretch that each is in: consecutive ones of one part (text)."""
    at = np.arange(len(key))
    stretch = part
    for _ in range(ROUNDS):
        if not len(at):
            break
        before = len(at)
        code = W.mix64(key[at] ^ (stretch.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))  # words of one hash stay, at worst
        _, code, times = np.unique(code, return_inverse=True, return_counts=True)
        at = at[times[code] > 1]
        new = np.ones(len(at), bool)
        new[1:] = (np.diff(at) > 1) | (part[at[1:]] != part[at[:-1]])
        stretch = np.cumsum(new) - 1
        size = np.bincount(stretch) if len(at) else np.empty(0, np.int64)
        long = size[stretch] >= least
        at, stretch = at[long], stretch[long]
        if len(at) == before:
            break
    return at, stretch


class Suffixes:
    """Suffix array, LCP and extensions of some stretches; no two stretches share a word's code."""

    def __init__(self, key: np.ndarray, stretch: np.ndarray):
        n = len(key)
        self.n = n
        order = np.lexsort((key, stretch))
        new = np.ones(n, bool)
        new[1:] = (key[order[1:]] != key[order[:-1]]) | (stretch[order[1:]] != stretch[order[:-1]])
        rank = np.empty(n + 1, np.int32)
        rank[n] = -1
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, n))
        rank[order] = np.repeat(first, sizes)
        #: ``ranks[k]``: equal for two places if their next 2^k words are, within their stretch.
        self.ranks = [rank]
        bounds = np.flatnonzero(np.concatenate(([True], stretch[1:] != stretch[:-1]))) if n else np.empty(0, np.int64)
        ends = np.append(bounds[1:], n)
        self.start, self.end = np.repeat(bounds, ends - bounds), np.repeat(ends, ends - bounds)
        active = order[np.repeat(sizes, sizes) > 1]
        step = 1
        while len(active):
            after = np.minimum(active + step, n)
            following = np.where(after < self.end[active], rank[after], -1).astype(np.int64) + 1
            pair = rank[active].astype(np.int64) * (n + 1) + following
            by = np.argsort(pair)
            active, pair = active[by], pair[by]
            new = np.ones(len(active), bool)
            new[1:] = pair[1:] != pair[:-1]
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(active)))
            group = pair // (n + 1)
            opens = np.ones(len(active), bool)
            opens[1:] = group[1:] != group[:-1]
            base = np.flatnonzero(opens)
            base = np.repeat(base, np.diff(np.append(base, len(active))))
            rank = rank.copy()
            rank[active] = (group + np.repeat(first, sizes) - base).astype(np.int32)
            self.ranks.append(rank)
            active = active[np.repeat(sizes, sizes) > 1]
            step *= 2
        self.places = np.empty(n, np.int64)
        self.places[rank[:n]] = np.arange(n)

    def forward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from i on equal those from j on."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = np.minimum(i + out, self.n), np.minimum(j + out, self.n)
            out += (self.ranks[k][a] == self.ranks[k][b]).astype(np.int64) << k
        return out

    def backward(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words up to i equal those up to j; either may be just before the start of the stretch."""
        out = np.zeros(len(i), np.int64)
        for k in range(len(self.ranks) - 1, -1, -1):
            a, b = i - out - (1 << k) + 1, j - out - (1 << k) + 1
            inside = (a >= 0) & (b >= 0)
            out += (inside & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])).astype(np.int64) << k
        return out

    def previous(self) -> tuple[np.ndarray, np.ndarray]:
        """For each place the longest factor that starts there and also before, and a place before where it does."""
        n, places = self.n, self.places
        lcp = np.zeros(n + 1, np.int64)
        if n > 1:
            lcp[1:n] = self.forward(places[:-1], places[1:])
        length, source = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for side in (-1, 1):
            to = np.arange(n) + side
            least = lcp[:n].copy() if side < 0 else lcp[1:].copy()
            active = np.arange(n)
            while len(active):
                seen = to[active]
                inside = (seen >= 0) & (seen < n)
                active, seen = active[inside], seen[inside]
                above = places[seen] > places[active]
                active, seen = active[above], seen[above]
                far, low = to[seen], np.minimum(least[active], least[seen])
                to[active], least[active] = far, low
            found = (to >= 0) & (to < n) & (least > 0)
            own, low, at = places[found], least[found], places[to[found]]
            better = low > length[own]
            length[own[better]], source[own[better]] = low[better], at[better]
        return length, source


def _touching(suffixes: Suffixes, blocks: np.ndarray, least: int) -> np.ndarray:
    """Runs (start, end inclusive, period) that touch a border of blocks."""
    n = suffixes.n
    size = np.diff(np.append(blocks, n))
    opens = suffixes.start[blocks] == blocks
    # Borders inside stretches, with the blocks before and behind, and those at the ends of stretches.
    inner = np.flatnonzero(~opens)
    last = np.flatnonzero(np.append(opens[1:], True))
    border = np.concatenate([blocks[inner], blocks[last] + size[last]])
    before = np.concatenate([size[inner - 1], size[last]])
    behind = np.concatenate([size[inner], np.zeros(len(last), np.int64)])
    low = np.concatenate([suffixes.start[blocks[inner]], suffixes.start[blocks[last]]])
    found = []
    for side in (1, -1):
        reach = behind if side > 0 else np.minimum(before + behind, border - low)
        cuts = np.searchsorted(np.cumsum(reach), np.arange(PAIRS, reach.sum() + PAIRS, PAIRS), "right")
        for a, b in zip(np.append(0, cuts[:-1]), np.append(cuts[:-1], len(reach)), strict=True):
            if a == b:
                continue
            at = np.repeat(border[a:b], reach[a:b])
            p = _spread(reach[a:b]) + 1
            behind_it = np.repeat(behind[a:b], reach[a:b]) > 0
            need = np.maximum(least - p, p)
            # Extensions sum up to ``need`` or more, so one of them has half of it: a pair of equal words if that's over 1.
            level = 1 if least >= 6 and len(suffixes.ranks) > 1 else 0
            rank, width = suffixes.ranks[level], 1 << level
            there = np.minimum(at + side * p, n)
            hope = behind_it & (rank[np.minimum(at, n)] == rank[there])
            x, y = at - width, at + side * p - width
            hope |= (x >= 0) & (y >= 0) & (rank[np.maximum(x, 0)] == rank[np.minimum(np.maximum(y, 0), n)])
            if level == 1:
                hope |= need < 3
            at, p, behind_it, need, there = at[hope], p[hope], behind_it[hope], need[hope], there[hope]
            right = np.where(behind_it, suffixes.forward(np.minimum(at, n), there), 0)
            left = suffixes.backward(at - 1, at + side * p - 1)
            good = left + right >= need
            at, p, left, right = at[good], p[good], left[good], right[good]
            start, end = (at - left, at + p - 1 + right) if side > 0 else (at - p - left, at - 1 + right)
            found.append(np.stack([start, end, p], 1))
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    # Of one stretch with several periods the least is the run's: the others are its multiples.
    new = np.ones(len(runs), bool)
    new[1:] = (runs[1:, :2] != runs[:-1, :2]).any(1)
    return runs[new]


def _copied(runs: np.ndarray, blocks: np.ndarray, n: int, source: np.ndarray, least: int) -> np.ndarray:
    """Those runs and the ones strictly inside blocks, which are copies of earlier ones."""
    buckets: dict[int, list[tuple[int, int]]] = {}
    for s, e, p in runs.tolist():
        buckets.setdefault(s, []).append((e, p))
    starts = sorted(buckets)
    more = []
    size = np.diff(np.append(blocks, n))
    long = blocks[size >= least + 2]
    for b, k, a in zip(long.tolist(), size[size >= least + 2].tolist(), source[long].tolist(), strict=True):
        by = b - a
        at = bisect_left(starts, a + 1)
        while at < len(starts) and starts[at] < a + k - 1:
            s = starts[at]
            for e, p in buckets[s]:
                if e < a + k - 1:
                    if s + by not in buckets:
                        buckets[s + by] = []
                        insort(starts, s + by)
                    buckets[s + by].append((e + by, p))
                    more.append((s + by, e + by, p))
            at += 1
    return np.concatenate([runs, np.array(more, np.int64).reshape(-1, 3)])


def find_runs(key: np.ndarray, part: np.ndarray, least: int = LEAST) -> np.ndarray:
    """Runs (start, end inclusive, period) of at least ``least`` words, by start and period.

    ``key``: the words, as 64-bit numbers; ``part``: the text of each, ascending.
    """
    at, stretch = stretches(key, part, least)
    if not len(at):
        return np.empty((0, 3), np.int64)
    suffixes = Suffixes(key[at], stretch)
    length, source = suffixes.previous()
    step, blocks, i = np.maximum(length, 1).tolist(), [], 0
    while i < len(step):
        blocks.append(i)
        i += step[i]
    blocks = np.array(blocks)
    runs = _copied(_touching(suffixes, blocks, least), blocks, suffixes.n, source, least)
    runs[:, :2] = at[runs[:, :2]]  # a run's places are consecutive
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def _joined(split: W.Words, order: np.ndarray, counts: np.ndarray) -> pa.Array:
    """The words of texts joined by single spaces: ``order`` numbers them, ``counts`` of them to each text."""
    size = (split.ends - split.starts)[order] + 1
    last = np.cumsum(counts)[counts > 0] - 1
    size[last] -= 1
    upto = np.cumsum(size)
    data = np.full(int(upto[-1]) if len(upto) else 0, 0x20, np.uint8)
    own = (split.ends - split.starts)[order]
    data[np.repeat(upto - size, own) + _spread(own)] = split.lowered[np.repeat(split.starts[order], own) + _spread(own)]
    ends = np.concatenate(([0], upto))[np.concatenate(([0], np.cumsum(counts)))]
    return pa.StringArray.from_buffers(len(counts), pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data))


def find(docs: DataFrame, column: str = "text", least: int = LEAST, rewrite: Callable[[pa.RecordBatch, np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Documents with ``runs`` (start, length, period; by start and period) in place of the text, and ``collapsed``.

    ``collapsed``: the words joined by spaces, without those that a run has after its first period.
    ``rewrite``: from rows and their numbers of words to the words' order: numbers of words of the same text, as many as it has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column(column)):
                own = batch.slice(texts.first, len(texts))
                split = W.split(texts, lower=False)
                first, part = split.first, split.text_of
                order = np.arange(len(split.starts)) if rewrite is None else first[part] + rewrite(own, split.counts)
                found = find_runs(split.hashes()[order], part, least)
                cover = np.zeros(len(order) + 1, np.int64)
                np.add.at(cover, found[:, 0] + found[:, 2], 1)
                np.add.at(cover, found[:, 1] + 1, -1)
                kept = np.cumsum(cover[:-1]) == 0
                of = part[found[:, 0]]
                rows = pa.StructArray.from_arrays([pa.array(found[:, 0] - first[of]), pa.array(found[:, 1] - found[:, 0] + 1), pa.array(found[:, 2])], names=["start", "length", "period"])
                yield with_columns(
                    own, drop=(column,), runs=lists(rows, np.bincount(of, minlength=len(texts))), collapsed=_joined(split, order[kept], np.bincount(part[kept], minlength=len(texts)))
                )

    fields = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed", column)]
    made = T.StructType.fromDDL("runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string")
    return map_arrow(docs, run, T.StructType(fields + made.fields))
