"""Benchmark decontamination by a distributed positional inverted index.

``build`` stores the index, document-partitioned: a shard is a row with some megabyte of
documents, and for each term there its posting list, the ascending positions in the shard's
words.  Every posting of the query terms is stored (of all terms where these are too many to
broadcast); shards never move.

``match`` looks query windows up in the stored lists.  A window's terms are ranked from the
rarest, by the lengths of their lists over all shards.  In a shard, windows with a term
that has no list there fall away first; then the list of the rarest term, moved back by its
offset in the window, gives the possible starts, which are intersected with the lists of the
next rarest terms, moved alike, until none or the whole window is left.  Proximity matches
take, around each place of the rarest term, the nearest places of the next terms to either
side: the window's words in order with at most ``near`` others between them.

Windows are made by executors, are rows, and are taken in blocks of at most ``BLOCK_WINDOWS``
(about 150 bytes each, broadcast), whatever items they are of.  With several blocks their
matches are stored by shard and joined to the documents at the end.

Defined cases: null or empty text has no words and no match; a very long text is a shard of
its own; an item without words has no window, one of fewer words than a window is one
window; repeated items and windows count once for each item_id; a null item_id is the item
''; repeated documents are matched each; empty tables give empty results; all other columns of
the documents stay, those of the same names as new ones being replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm import blobs
from lodegrid.llm import words as W
from lodegrid.llm.arrow import lists, map_arrow
from lodegrid.llm.scratch import Scratch

#: Words of a window.
WINDOW = 10
#: Query windows held at once.
BLOCK_WINDOWS = 500_000
#: Query terms up to this many (8 bytes each) are broadcast, and postings of others not stored.
VOCABULARY = 2_000_000
_EXPAND = 2_000_000
_NEW = ("n_words", "n_hit", "match_spans", "match_items", "near_items")
_POSTINGS = ("words", "terms", "sizes", "positions")


# The index.


def _members(vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sieve = np.zeros(1 << 16, bool)
    sieve[(vocabulary & np.uint64(0xFFFF)).astype(np.int64)] = True
    return vocabulary, sieve


def _known(hashes: np.ndarray, vocabulary: np.ndarray, sieve: np.ndarray) -> np.ndarray:
    """Places of words that the vocabulary has."""
    maybe = np.flatnonzero(sieve[(hashes & np.uint64(0xFFFF)).astype(np.int64)])
    at = np.searchsorted(vocabulary, hashes[maybe])
    at[at == len(vocabulary)] = 0
    return maybe[vocabulary[at] == hashes[maybe]] if len(vocabulary) else maybe[:0]


def _binary(*arrays: np.ndarray) -> list[pa.Array]:
    return [pa.array([a.tobytes()], pa.binary()) for a in arrays]


def _built(shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context, n = TaskContext.get(), 0
        members = _members(shared.value) if shared else None
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                split = W.split(texts, W.ALNUM)
                hashes = split.hashes()
                at = _known(hashes, *members) if members else np.arange(len(hashes))
                order = np.argsort(hashes[at], kind="stable")
                at, own = at[order], hashes[at][order]
                starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1]))) if len(own) else np.empty(0, np.int64)
                part = batch.slice(texts.first, len(texts))
                rows = pa.StructArray.from_arrays([part.column(c) for c in columns], names=columns)
                n += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{context.partitionId()}-{context.taskAttemptId()}-{n}"]), pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), rows)]
                    + _binary(split.counts.astype("<i4"), own[starts].astype("<u8"), np.diff(np.append(starts, len(own))).astype("<i4"), at.astype("<i4")),
                    names=["shard", "rows", *_POSTINGS],
                )

    return run


def build(docs: DataFrame, vocabulary: np.ndarray | None = None) -> DataFrame:
    """The index of documents (with a column text): shard, rows (the documents), and as bytes words (of each), terms, sizes and positions.

    ``vocabulary``: sorted hashes of the terms whose postings are wanted; None for all.
    Store it before use: the names of shards are those of the tasks that made them.
    """
    schema = T.StructType([T.StructField("shard", T.StringType()), T.StructField("rows", T.ArrayType(docs.schema)), *[T.StructField(n, T.BinaryType()) for n in _POSTINGS]])
    shared = None if vocabulary is None else docs.sparkSession.sparkContext.broadcast(vocabulary)
    return map_arrow(docs, _built(shared, docs.columns), schema)


def list_lengths(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """How many postings each term of a vocabulary has over all shards."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(shared.value), np.int64)
        members = _members(shared.value)
        for batch in batches:
            terms, sizes = blobs.unpack(batch.column("terms"), "<u8"), blobs.unpack(batch.column("sizes"), "<i4")
            own = _known(terms, *members)
            np.add.at(total, np.searchsorted(shared.value, terms[own]), sizes[own])
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["term", "n"])

    found = map_arrow(index.select("terms", "sizes"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[found["term"].to_numpy()] = found["n"].to_numpy()
    return out


# Query windows.


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(win, items): distinct windows of the items (item_id, text), as the bytes of their words' hashes, and the items that have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                split = W.split(texts, W.ALNUM)
                data = split.hashes().astype("<u8").tobytes()
                found, owner = [], []
                for i, (at, n) in enumerate(zip(split.first.tolist(), split.counts.tolist(), strict=False)):
                    own = {data[8 * j : 8 * (j + min(n, size))] for j in range(at, at + max(1, n - size + 1))} if n else ()
                    found += own
                    owner += [texts.first + i] * len(own)
                yield pa.RecordBatch.from_arrays([batch.column("item").take(pa.array(owner, pa.int64())), pa.array(found, pa.binary())], names=["item", "win"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return map_arrow(items, run, "item string, win binary").groupBy("win").agg(F.sort_array(F.collect_set("item")).alias("items"))


class Windows:
    """A block of query windows over term numbers, each with its terms from the rarest."""

    def __init__(self, table: pa.Table, size: int):
        win, items = table["win"].combine_chunks(), table["items"].combine_chunks()
        flat, self.length = blobs.unpack(win, "<u8"), pc.binary_length(win).to_numpy(zero_copy_only=False).astype(np.int64) // 8
        self.vocabulary, number = np.unique(flat, return_inverse=True)
        self.terms = np.full((len(win), size), -1, np.int32)
        self.terms[np.arange(size)[None, :] < self.length[:, None]] = number
        coded = items.flatten().dictionary_encode()
        self.names = np.array(coded.dictionary.to_pylist(), object)
        self.items = coded.indices.to_numpy()
        self.item_first = np.concatenate(([0], np.cumsum(pc.list_value_length(items).to_numpy(zero_copy_only=False)))).astype(np.int64)

    def rank(self, lengths: np.ndarray) -> None:
        """Order each window's terms by the lengths of their lists, and list windows by their rarest; those with a term of none can't match."""
        many = np.iinfo(np.int64).max
        cost = np.where(self.terms >= 0, lengths[self.terms], many) if len(lengths) else np.full(self.terms.shape, many)
        self.order = np.argsort(cost, axis=1, kind="stable").astype(np.int8)
        possible = np.flatnonzero((cost > 0).all(1) & (self.length > 0))
        anchor = self.terms[possible, self.order[possible, 0]]
        by = np.argsort(anchor, kind="stable")
        self.by_anchor, self.anchors = possible[by], anchor[by]


# Look-up in a shard.


@dataclass
class Shard:
    """A shard's posting lists for a block of windows: ``keys`` are list number x ``span`` + position, ascending."""

    present: np.ndarray
    keys: np.ndarray
    span: int
    first: np.ndarray

    @classmethod
    def of(cls, words: np.ndarray, terms: np.ndarray, sizes: np.ndarray, positions: np.ndarray, members: tuple[np.ndarray, np.ndarray]) -> Shard:
        first = np.concatenate(([0], np.cumsum(words, dtype=np.int64)))
        own = _known(terms, *members)
        upto = np.cumsum(sizes, dtype=np.int64)
        n = sizes[own].astype(np.int64)
        at = np.repeat(upto[own] - sizes[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        span = int(first[-1]) + 1
        return cls(np.searchsorted(members[0], terms[own]), np.repeat(np.arange(len(own)), n) * span + positions[at], span, first)

    def lists_of(self, terms: np.ndarray) -> np.ndarray:
        """List numbers of terms, -1 for those without a list here."""
        if not len(self.present):
            return np.full(len(terms), -1, np.int64)
        at = np.minimum(np.searchsorted(self.present, terms), len(self.present) - 1)
        return np.where(self.present[at] == terms, at, -1)

    def possible(self, block: Windows) -> tuple[np.ndarray, np.ndarray]:
        """Windows all of whose terms have a list here, and the list numbers of their terms from the rarest (-1 past the end)."""
        found = block.by_anchor[self.lists_of(block.anchors) >= 0]
        for r in range(1, block.terms.shape[1]):
            term = block.terms[found, block.order[found, r]]
            found = found[(term < 0) | (self.lists_of(term) >= 0)]
        terms = block.terms[found[:, None], block.order[found]] if len(found) else np.empty((0, block.terms.shape[1]), np.int64)
        return found, np.where(terms >= 0, self.lists_of(terms.ravel()).reshape(terms.shape), -1)

    def starts(self, found: np.ndarray, lists_: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of the rarest terms: (which of the windows, position)."""
        low = np.searchsorted(self.keys, lists_[:, 0] * self.span)
        n = np.searchsorted(self.keys, (lists_[:, 0] + 1) * self.span) - low
        sums = np.cumsum(n)
        at = 0
        while at < len(found):
            end = max(at + 1, int(np.searchsorted(sums, (sums[at - 1] if at else 0) + _EXPAND, "right")))
            which = np.repeat(np.arange(at, end), n[at:end])
            within = np.arange(len(which)) - np.repeat(np.cumsum(n[at:end]) - n[at:end], n[at:end])
            yield which, self.keys[low[which] + within] % self.span
            at = end

    def text_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, "right") - 1

    def exact(self, block: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and windows of exact phrase matches within a text."""
        found, lists_ = self.possible(block)
        out = []
        for which, position in self.starts(found, lists_):
            start = position - block.order[found[which], 0]
            which, start = which[start >= 0], start[start >= 0]
            for r in range(1, block.terms.shape[1]):
                key = lists_[which, r] * self.span + start + block.order[found[which], r]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                keep = (lists_[which, r] < 0) | (self.keys[at] == key)
                which, start = which[keep], start[keep]
            end = start + block.length[found[which]]
            keep = (end <= self.first[-1]) & (self.text_of(start) == self.text_of(end - 1))
            out.append((start[keep], end[keep], found[which[keep]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3

    def near(self, block: Windows, slop: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts, ends and windows of matches in order with at most ``slop`` other words between: the tightest around each place of the rarest term."""
        found, lists_ = self.possible(block)
        out = []
        for which, position in self.starts(found, lists_):
            left, right, anchor = position, position.copy(), block.order[found[which], 0].astype(np.int64)
            for step in range(1, block.terms.shape[1]):
                for side in (-1, 1):
                    offset = anchor + side * step
                    inside = (offset >= 0) & (offset < block.length[found[which]])
                    here = self.lists_of(block.terms[found[which], np.clip(offset, 0, block.terms.shape[1] - 1)])
                    edge = left if side < 0 else right
                    at = np.searchsorted(self.keys, here * self.span + edge, "left" if side < 0 else "right") - (side < 0)
                    hit = self.keys[np.clip(at, 0, len(self.keys) - 1)]
                    good = ~inside | ((at >= 0) & (at < len(self.keys)) & (hit // self.span == here))
                    edge = np.where(inside & good, hit % self.span, edge)
                    left, right = (edge, right) if side < 0 else (left, edge)
                    good &= right - left + 1 <= block.length[found[which]] + slop
                    left, right, which, anchor = left[good], right[good], which[good], anchor[good]
            same = self.text_of(left) == self.text_of(right)
            out.append((left[same], right[same] + 1, found[which[same]]))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.empty(0, np.int64),) * 3


# Matches.


def _items(block: Windows, text: np.ndarray, found: np.ndarray, into: dict[int, set[str]]) -> None:
    pairs = np.unique(np.stack([text, found], 1), axis=0) if len(found) else np.empty((0, 2), np.int64)
    for i, w in pairs.tolist():
        into.setdefault(i, set()).update(block.names[block.items[block.item_first[w] : block.item_first[w + 1]]])


def _looked_up(shared, near: int | None):
    """Matches of a block in rows of the index: (shard row number, spans as (start, end) in the shard, items by text, near items by text)."""
    block = shared.value
    members = _members(block.vocabulary)

    def look(batch: pa.RecordBatch, i: int) -> tuple[Shard, np.ndarray, np.ndarray, dict, dict]:
        one = batch.slice(i, 1)
        shard = Shard.of(*[blobs.unpack(one.column(c), t) for c, t in zip(_POSTINGS, ("<i4", "<u8", "<i4", "<i4"), strict=True)], members)
        items, close = {}, {}
        starts, ends, found = shard.exact(block)
        _items(block, shard.text_of(starts), found, items)
        if near is not None:
            a, _, w = shard.near(block, near)
            _items(block, shard.text_of(a), w, close)
        return shard, starts, ends, items, close

    return look


def _spans(first: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """Joined spans of each text, as word ranges, and how many words they hold."""
    n = len(first) - 1
    depth = np.zeros(int(first[-1]) + 1, np.int32)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    hit = np.cumsum(depth[:-1]) > 0
    border = np.zeros(len(hit) + 1, bool)
    border[first] = True
    begin = np.flatnonzero(hit & (border[:-1] | ~np.concatenate(([False], hit[:-1])))) if len(hit) else np.empty(0, np.int64)
    end = np.flatnonzero(hit & (border[1:] | ~np.concatenate((hit[1:], [False])))) + 1 if len(hit) else begin
    text = np.searchsorted(first, begin, "right") - 1
    local = np.stack([begin - first[text], end - first[text]], 1)
    sums = np.concatenate(([0], np.cumsum(hit)))
    return lists(lists(pa.array(local.ravel()), np.full(len(local), 2)), np.bincount(text, minlength=n)), (sums[first[1:]] - sums[first[:-1]]).astype(np.int64)


def _documents(batch: pa.RecordBatch, i: int, first: np.ndarray, starts: np.ndarray, ends: np.ndarray, items: dict, close: dict | None, keep: list[str]) -> pa.RecordBatch:
    """A shard's documents with their matches."""
    rows = batch.column("rows")[i].values
    spans, n_hit = _spans(first, starts, ends)
    named = lambda found: pa.array([sorted(found.get(j, ())) for j in range(len(rows))], pa.list_(pa.string()))
    new = [pa.array(np.diff(first)), pa.array(n_hit), spans, named(items)] + ([] if close is None else [named(close)])
    return pa.RecordBatch.from_arrays([rows.field(c) for c in keep] + new, names=keep + list(_NEW[: len(new)]))


def match(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW, near: int | None = None, block_windows: int = BLOCK_WINDOWS, vocabulary_size: int = VOCABULARY) -> DataFrame:
    """Add n_words, n_hit (words inside an exact match), match_spans (word ranges) and match_items to documents (column text).

    ``near``: add near_items as well, the items of which a window's words stand in order with at most so many others between.
    """
    spark = docs.sparkSession
    share, scratch = spark.sparkContext.broadcast, Scratch(spark, "decontamination")
    new = _NEW if near is not None else _NEW[:-1]
    keep = [c for c in docs.columns if c not in new]
    docs = docs.select(*keep)
    wanted = scratch.table(windows(benchmark, size), "windows")
    total = wanted.count()
    terms = map_arrow(wanted.select("win"), _terms, "term bigint").distinct()
    few = terms.count() <= vocabulary_size
    vocabulary = np.sort(terms.toArrow()["term"].to_numpy().view(np.uint64)) if few else None
    index = scratch.table(build(docs, vocabulary), "index")
    n = max(1, -(-total // block_windows))
    blocks = []
    for k in range(n):
        block = Windows(wanted.where(F.pmod(F.xxhash64("win"), F.lit(n)) == k).toArrow(), size)
        block.rank(list_lengths(index, block.vocabulary))
        blocks.append(share(block))
        if n > 1:
            blocks[-1] = scratch.table(map_arrow(index.drop("rows"), _stored(blocks[-1], near), "shard string, row int, a array<bigint>, b array<bigint>, items array<string>, close array<string>"), f"block{k}")
    types = [T.LongType(), T.LongType(), T.ArrayType(T.ArrayType(T.LongType())), T.ArrayType(T.StringType()), T.ArrayType(T.StringType())]
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(c, t) for c, t in zip(new, types, strict=False)])
    if n == 1:
        return map_arrow(index, _found(blocks[0], near, keep), schema)
    hits = blocks[0]
    for more in blocks[1:]:
        hits = hits.unionByName(more)
    hits = hits.groupBy("shard").agg(F.collect_list(F.struct("row", "a", "b", "items", "close")).alias("hits"))  # of one shard
    return map_arrow(index.select("shard", "rows", "words").join(hits, "shard", "left"), _joined(near, keep), schema)


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(blobs.unpack(batch.column("win"), "<i8")))], names=["term"])


def _found(shared, near: int | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _looked_up(shared, near)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, starts, ends, items, close = look(batch, i)
                yield _documents(batch, i, shard.first, starts, ends, items, None if near is None else close, keep)

    return run


def _stored(shared, near: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _looked_up(shared, near)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, starts, ends, items, close = look(batch, i)
                text = shard.text_of(starts)
                rows = sorted({*items, *close})
                own = {j: np.flatnonzero(text == j) for j in rows}
                yield pa.RecordBatch.from_arrays(
                    [pa.array([batch.column("shard")[i].as_py()] * len(rows), pa.string()), pa.array(rows, pa.int32()), pa.array([starts[own[j]] for j in rows], pa.list_(pa.int64()))]
                    + [pa.array([ends[own[j]] for j in rows], pa.list_(pa.int64())), pa.array([sorted(items.get(j, ())) for j in rows], pa.list_(pa.string())), pa.array([sorted(close.get(j, ())) for j in rows], pa.list_(pa.string()))],
                    names=["shard", "row", "a", "b", "items", "close"],
                )

    return run


def _joined(near: int | None, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                first = np.concatenate(([0], np.cumsum(blobs.unpack(batch.column("words").slice(i, 1), "<i4"), dtype=np.int64)))
                items, close, starts, ends = {}, {}, [], []
                for hit in batch.column("hits")[i].as_py() or ():
                    items.setdefault(hit["row"], set()).update(hit["items"])
                    close.setdefault(hit["row"], set()).update(hit["close"])
                    starts += hit["a"]
                    ends += hit["b"]
                yield _documents(batch, i, first, np.array(starts, np.int64), np.array(ends, np.int64), items, None if near is None else close, keep)

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """The documents, all columns, without those that hold a window of an item."""
    return match(docs, benchmark, size).where(F.col("n_hit") == 0).select(*docs.columns)
