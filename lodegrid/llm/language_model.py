"""Language-model scores by a weighted backoff automaton.

Tokens are lower-cased words and an end mark.  The model has smoothed n-grams up
to order 3 as arcs of an automaton: the root reads any token with its add-one
unigram probability; a state for a word or a pair of words has an arc for each
n-gram kept, and a failure arc to the state without its first word, whose weight
takes the mass that the state's arcs leave.  A text is one left-to-right walk: at
each token the walk follows failure arcs, adding their weights, to the first state
that has an arc for it.  States are suffix-closed (a pair's state implies its last
word's), so the state after a token is the longest kept suffix, and a whole slice
of texts walks at once: each round tries an arc for all tokens and sends those
without one along their failure arcs.

Probabilities: p(w) = (c(w) + 1) / (N + V + 1); a kept n-gram has
p(w | h) = (c(h w) + PRIOR p(w | h')) / (c(h) + PRIOR), h' being h without its first
word.  With the failure weights every state sums to 1 over all tokens, unknown ones
(together one token more) included.

What is counted and kept grows with the corpus: all tokens, and each pair and triple
that occurs ``LEAST`` times, whatever its share.  A triple that often has pairs that
often, and those have words that often, so what can't be kept is left out before it is
shuffled, by bitmaps of bounded size (``SIEVE_BITS``) that let false keys pass but lose none.

Logarithms add up, so a text's score is a sum of one weight for each n-gram in it
(``gain``).  Weights are a table in Spark.  Its frequent part, n-grams that are a share
``KEEP`` of the tokens or more (so at most 1/KEEP of each order, at any size), is
broadcast; the texts' rarer n-grams are joined to the table.

Defined cases: null text is empty, and an empty text is its end mark; with no training
text all tokens are unknown (N = 0, V = 0, p = 1); repeated rows count and are scored
each; an empty table gives an empty result; other columns stay, but for ``text`` and those
of the same names as new ones.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm import blobs
from lodegrid.llm import words as W
from lodegrid.llm.arrow import map_arrow, with_columns
from lodegrid.llm.scratch import Scratch

#: Share of the tokens from which a token or n-gram is broadcast; rarer ones are joined.
KEEP = 1e-6
#: Least count of a kept pair or triple.
LEAST = 3
#: Passes of the rarer weights' join to the texts: each shuffles that share of the texts' n-grams.
PASSES = 2
#: Most bits (as a power of 2) of a bitmap of keys.
SIEVE_BITS = 27
#: Bytes of a bitmap that are put together at once.
SLICE = 1 << 20
#: Weight of the shorter history, in tokens.
PRIOR = 50.0
END = int(W.mix64(np.array([0x454E44], np.uint64)).view(np.int64)[0])


def tokens(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of texts, each with its end mark, and how many each has."""
    split = W.split(texts)
    hashes = split.hashes().view(np.int64)
    return np.insert(hashes, np.cumsum(split.counts), END), split.counts + 1


def _count(texts: DataFrame, keys_of, names: list[str], total: int, least: int = 1) -> DataFrame:
    """(key, names..., n) of the keys that ``keys_of`` gives for the tokens of slices."""

    def pieces(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
        for part in W.slices(batch.column("text")):
            yield keys_of(*tokens(part))

    return blobs.count(texts.select("text"), pieces, join_keys if len(names) > 1 else lambda t: t, names, blobs.parts_for(total, texts), least)


def join_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The key of two tokens, or of a triple by its two pairs."""
    return W.mix64(W.mix64(a.view(np.uint64)) * np.uint64(3) + b.view(np.uint64)).view(np.int64)


def pair_hashes(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token before each (before a text's first stands the end mark of none), and the key of both."""
    last = np.empty_like(hashes)
    last[1:] = hashes[:-1]
    last[np.cumsum(counts) - counts] = END
    return last, join_keys(last, hashes)


def _not_first(counts: np.ndarray) -> np.ndarray:
    out = np.ones(int(counts.sum()), bool)
    out[np.cumsum(counts) - counts] = False
    return out


@dataclass
class Sieve:
    """A bitmap of keys by their first bits: it may have keys that weren't put in, but has all that were."""

    bits: int
    bitmap: np.ndarray

    def has(self, keys: np.ndarray) -> np.ndarray:
        at = keys.view(np.uint64) >> np.uint64(64 - self.bits)
        return (self.bitmap[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def sieve(keys: DataFrame) -> Sieve:
    """The sieve of a table's ``key``: 16 bits a key, up to ``SIEVE_BITS`` in all."""
    bits = min(SIEVE_BITS, max(10, (16 * keys.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.zeros(1 << (bits - 3), np.uint8)
        for batch in batches:
            at = np.unique(batch.column("key").to_numpy().view(np.uint64) >> np.uint64(64 - bits))
            if len(at):
                byte = (at >> np.uint64(3)).astype(np.int64)
                first = np.flatnonzero(np.diff(byte, prepend=-1))
                bitmap[byte[first]] |= np.bitwise_or.reduceat(np.uint8(1) << (at & np.uint64(7)).astype(np.uint8), first)
        for i in range(0, len(bitmap), SLICE):
            if bitmap[i : i + SLICE].any():
                yield pa.RecordBatch.from_arrays([pa.array([i // SLICE]), pa.array([bitmap[i : i + SLICE].tobytes()], pa.binary())], names=["part", "bitmap"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in blobs.runs(batches):
            whole = reduce(np.bitwise_or, (np.frombuffer(v.as_py(), np.uint8) for b in rows for v in b.column("bitmap")))
            yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([whole.tobytes()], pa.binary())], names=["part", "bitmap"])

    # Slices are put together by tasks, so the driver is sent each of the bitmap's bytes once.
    schema = blobs.schema(["bitmap"])
    slices = map_arrow(keys.select("key").coalesce(4), run, schema)
    found = map_arrow(blobs.dealt(slices, -(-(1 << (bits - 3)) // SLICE)), merge, schema).toArrow()
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for part, own in zip(found["part"].to_pylist(), found["bitmap"], strict=True):
        bitmap[part * SLICE : (part + 1) * SLICE] = np.frombuffer(own.as_buffer(), np.uint8)
    return Sieve(bits, bitmap)


def count_tokens(texts: DataFrame) -> DataFrame:
    """(key, n): how often the texts have each token."""
    size = texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    return _count(texts, lambda t, _: (t,), ["token"], size // 32).select("key", "n")


def _find(table: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Places in a sorted table, -1 where absent."""
    if not len(table):
        return np.full(len(values), -1, np.int64)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return np.where(table[at] == values, at, -1)


@dataclass
class Automaton:
    """The frequent part: words by number (place in ``words``, sorted hashes); pairs and triples by sorted keys."""

    words: np.ndarray
    counts: np.ndarray
    total: int
    distinct: int

    def __post_init__(self):
        self.n = len(self.words)
        self.word_p = np.log10((self.counts + 1) / self.space)
        self.word_fail = np.zeros(self.n)
        self.pairs, self.pair_gain, self.pair_fail = np.empty(0, np.int64), np.empty(0), np.empty(0)
        self.triples, self.triple_gain = np.empty(0, np.int64), np.empty(0)
        self.end = int(_find(self.words, np.array([END]))[0])

    @property
    def space(self) -> float:
        return self.total + self.distinct + 1.0

    @property
    def least(self) -> float:
        return max(LEAST, KEEP * self.total)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        return _find(self.words, hashes)

    def before(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The token before each; before a text's first stands the end mark of none."""
        out = np.empty_like(numbers)
        out[1:] = numbers[:-1]
        out[np.cumsum(counts) - counts] = self.end
        return out

    def add_words(self, fails: pa.Table) -> None:
        """Failure weights of words (h, fail)."""
        at = self.numbers(fails["h"].to_numpy())
        self.word_fail[at[at >= 0]] = fails["fail"].to_numpy()[at >= 0]

    def add_pairs(self, found: pa.Table) -> None:
        """Frequent pairs (h, w, key, step, fail)."""
        keys = self.numbers(found["h"].to_numpy()) * self.n + self.numbers(found["w"].to_numpy())
        order = np.argsort(keys)
        self.pairs, self.pair_gain, self.pair_fail = keys[order], found["step"].to_numpy()[order], found["fail"].to_numpy()[order]

    def add_triples(self, found: pa.Table) -> None:
        """Frequent triples (h, w, last, step): words h and w of the pair, then the last one."""
        pair = _find(self.pairs, self.numbers(found["h"].to_numpy()) * self.n + self.numbers(found["w"].to_numpy()))
        keys = pair * self.n + self.numbers(found["last"].to_numpy())
        order = np.argsort(keys)
        self.triples, self.triple_gain = keys[order], found["step"].to_numpy()[order]

    def places(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each token's pair with the one before it, the state of the two before it, and its triple; -1 where not frequent."""
        last = self.before(numbers, counts)
        pair = _find(self.pairs, np.where((numbers >= 0) & (last >= 0), last * self.n + numbers, -1))
        state = np.full(len(numbers), -1, np.int64)
        state[1:] = pair[:-1]
        state[np.cumsum(counts) - counts] = -1
        triple = _find(self.triples, np.where((state >= 0) & (numbers >= 0), state * self.n + numbers, -1))
        return pair, state, triple

    def walk(self, numbers: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of each token, less what rarer words and n-grams (which aren't here) add to it."""
        last = self.before(numbers, counts)
        out = np.zeros(len(numbers))
        for values, at in zip((self.word_p, self.word_fail, self.pair_gain, self.pair_fail, self.triple_gain), (numbers, last, *self.places(numbers, counts)), strict=True):
            out[at >= 0] += values[at[at >= 0]]
        return out


def _fail(kept: str, below: str) -> Column:
    """Weights of failure arcs: what the arcs leave, over what they would have in the shorter state."""
    rest = lambda c: F.greatest(1 - F.sum(c), F.lit(1e-12))
    return F.log10(rest(kept) / rest(below)).alias("fail")


def train(texts: DataFrame, scratch: Scratch) -> tuple[Automaton, DataFrame]:
    """The frequent part of the automaton of training texts, and all their token counts (key, n)."""
    return learn(texts, scratch)[:2]


def learn(texts: DataFrame, scratch: Scratch) -> tuple[Automaton, DataFrame, DataFrame]:
    """The automaton's frequent part, all token counts, and what isn't in that part: (key, word, base, gain) of each token and kept n-gram."""
    share = texts.sparkSession.sparkContext.broadcast
    counts = scratch.table(count_tokens(texts), "tokens")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    often = max(1.0, KEEP * total)
    found = counts.where(F.col("n") >= often).toArrow()
    keys, n = found["key"].to_numpy(), found["n"].to_numpy()
    order = np.argsort(keys)
    model = Automaton(keys[order], n[order], total, distinct)

    # Pairs whose words may both be kept, then triples whose pairs may.
    words = counts.where(F.col("n") >= LEAST)
    common = share(sieve(words))

    def pair_of(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        last, _ = pair_hashes(t, c)
        ok = common.value.has(t) & common.value.has(last)
        return last[ok], t[ok]

    kept = scratch.table(_count(texts, pair_of, ["h", "w"], total, LEAST), "pair_counts")
    common.destroy()
    scratch.release()
    paired = share(sieve(kept))

    def triple_of(t: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        _, pair = pair_hashes(t, c)
        ok = paired.value.has(pair)
        at = np.flatnonzero(_not_first(c) & ok & np.roll(ok, 1))
        return pair[at - 1], pair[at]

    kept3 = scratch.table(_count(texts, triple_of, ["first", "second"], total, LEAST), "triple_counts")
    paired.destroy()
    scratch.release()

    # Probabilities, shorter histories first; failure weights; one weight for each n-gram.  Tables have counts, from which
    # probabilities follow, and words only of frequent n-grams: the pairs of a frequent triple are as frequent.
    p1 = lambda c: (F.col(c) + 1) / F.lit(model.space)
    frequent = F.col("n") >= model.least
    named = lambda *names: [F.when(frequent, F.col(c)).alias(c) for c in names]
    smoothed = lambda below: (F.col("n") + PRIOR * F.col(below)) / (F.col("n_h") + PRIOR)
    pairs = kept.join(words.select(F.col("key").alias("w"), F.col("n").alias("n_w")), "w").join(words.select(F.col("key").alias("h"), F.col("n").alias("n_h")), "h")
    pair_table = scratch.table(pairs.select("key", "h", "w", "n", "n_w", "n_h"), "pairs")
    scratch.drop(kept)
    scratch.release()
    pairs = pair_table.withColumn("p1", p1("n_w")).withColumn("p", smoothed("p1"))
    word_fail = scratch.table(pairs.groupBy("h").agg(_fail("p", "p1")), "word_fail")
    end = pairs.select(F.col("key").alias("second"), F.when(frequent, F.col("w")).alias("last"), F.col("p").alias("p2"))
    begin = pairs.select(F.col("key").alias("first"), *named("h", "w"), F.col("n").alias("n_h"))
    triples = kept3.join(end, "second").select("key", "first", *named("last"), "n", "p2").join(begin, "first")
    triple_table = scratch.table(triples.select("key", "first", *named("h", "w", "last"), "n", "n_h", "p2"), "triples")
    scratch.drop(kept3)
    scratch.release()
    triples = triple_table.withColumn("p", smoothed("p2"))
    pair_fail = scratch.table(triples.groupBy("first").agg(_fail("p", "p2")), "pair_fail")

    # Of frequent n-grams what the automaton holds, of others the weight alone.
    own = counts.where(F.col("n") < often).join(word_fail.withColumnRenamed("h", "key"), "key", "left").withColumn("base", F.log10(p1("n")))
    own = scratch.table(own.select("key", "base", (F.col("base") + F.coalesce("fail", F.lit(0.0))).alias("gain")), "word_weights")
    model.add_words(word_fail.join(counts.where(F.col("n") >= often).select(F.col("key").alias("h")), "h", "left_semi").toArrow())
    by_h = pairs.join(word_fail, "h").select("key", *named("h", "w"), "n", (F.log10("p") - F.log10("p1") - F.col("fail")).alias("step"))
    by_key = by_h.join(pair_fail.withColumnRenamed("first", "key"), "key", "left").withColumn("fail", F.coalesce("fail", F.lit(0.0)))
    pairs = scratch.table(by_key.select("key", *named("h", "w", "step", "fail"), F.when(~frequent, F.col("step") + F.col("fail")).alias("gain")), "pair_steps")
    for table in (pair_table, word_fail):
        scratch.drop(table)
    scratch.release()
    stepped = triples.join(pair_fail, "first").withColumn("step", F.log10("p") - F.col("fail") - F.log10("p2"))
    triples = scratch.table(stepped.select("key", *named("h", "w", "last", "step"), F.when(~frequent, F.col("step")).alias("gain")), "triple_steps")
    for table in (triple_table, pair_fail):
        scratch.drop(table)
    scratch.release()
    model.add_pairs(pairs.where("h IS NOT NULL").toArrow())
    model.add_triples(triples.where("h IS NOT NULL").select("h", "w", "last", "step").toArrow())
    weights = own.select("key", F.lit(1).alias("word"), "base", "gain")
    for table in (pairs, triples):
        weights = weights.unionByName(table.where("h IS NULL").select("key", F.lit(0).alias("word"), F.lit(0.0).alias("base"), "gain"))
    return model, counts, weights


def _scored(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, kept = shared.value
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                hashes, counts = tokens(texts)
                numbers = model.numbers(hashes)
                first = np.cumsum(counts) - counts
                known = numbers >= 0
                base = np.zeros(len(numbers))
                base[known] = model.word_p[numbers[known]]
                # What the frequent part hasn't: all words, and the pairs and triples that may be kept.
                pair, _, triple = model.places(numbers, counts)
                _, pairs = pair_hashes(hashes, counts)
                triples = join_keys(np.roll(pairs, 1), pairs)
                rest = [(hashes, ~known), (pairs, (pair < 0) & kept.has(pairs)), (triples, (triple < 0) & _not_first(counts) & kept.has(triples))]
                text_of = np.repeat(np.arange(len(counts)), counts)
                order = np.argsort(np.concatenate([text_of[m] for _, m in rest]), kind="stable")
                keys = np.concatenate([k[m] for k, m in rest])[order].view(np.uint64)
                per = sum(np.add.reduceat(m.astype(np.int64), first) for _, m in rest)
                rare, times, n_rare = _distinct(keys, per)
                packed = blobs.pack(np.repeat(np.arange(len(counts)), n_rare), {"keys": rare, "times": times.astype(np.int32)})
                held = np.full(len(counts), -1, np.int64)
                held[packed.column("part").to_numpy()] = np.arange(packed.num_rows)
                held = pa.array(held, mask=held < 0)
                yield with_columns(
                    batch.slice(texts.first, len(texts)), ("text",), n_tokens=pa.array(counts.astype(np.int64)), n_common=pa.array(np.add.reduceat(known.astype(np.int64), first)),
                    base=pa.array(np.add.reduceat(base, first)), walk=pa.array(np.add.reduceat(model.walk(numbers, counts), first)), rare_keys=packed.column("keys").take(held), rare_times=packed.column("times").take(held),
                )

    return run


def _distinct(values: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's values sorted, each once, how often the text has each, and how many it has."""
    first = np.concatenate(([0], np.cumsum(counts)))
    values = values.copy()
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        values[a:b].sort()
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    new[first[:-1][counts > 0]] = True
    starts = np.flatnonzero(new)
    return values[new], np.diff(np.append(starts, len(values))), np.diff(np.searchsorted(starts, first))


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """Documents without their texts, with n_tokens, n_known, train_tokens, base_score and score."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "lm")
    model, counts, weights = learn(training, scratch)
    scratch.drop(counts)
    kept = sieve(weights.where("word = 0"))
    more = [T.StructField(n, t()) for n, t in (("n_tokens", T.LongType), ("n_common", T.LongType), ("base", T.DoubleType), ("walk", T.DoubleType), ("rare_keys", T.BinaryType), ("rare_times", T.BinaryType))]
    numbered = docs.drop(*[f.name for f in more], *RARE, "n_known", "train_tokens", "base_score", "score").withColumn("lm_row", F.monotonically_increasing_id())
    schema = T.StructType([f for f in numbered.schema.fields if f.name != "text"] + more)
    shared = spark.sparkContext.broadcast((model, kept))
    del kept
    scored = scratch.table(map_arrow(numbered, _scored(shared), schema), "scored")
    shared.destroy()
    scratch.release()
    parts = blobs.parts_for(model.total, docs)
    sums = [_looked_up(scored, weights, k, parts, scratch) for k in range(PASSES)]
    sums = reduce(DataFrame.unionByName, sums).groupBy("lm_row").agg(*[F.sum(c).alias(c) for c in RARE])
    rows = scored.drop("rare_keys", "rare_times").join(sums, "lm_row", "left").withColumn("n_known", F.col("n_common") + F.coalesce("rare_known", F.lit(0)))
    unknown = (F.col("n_tokens") - F.col("n_known")) * F.lit(-math.log10(model.space))
    return rows.withColumns({
        "train_tokens": F.lit(model.total).cast("bigint"), "base_score": F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + unknown, "score": F.col("walk") + F.coalesce("rare_gain", F.lit(0.0)) + unknown,
    }).drop("lm_row", "n_common", "base", "walk", *RARE)


#: What weights add to a text: base probability, probability, and known tokens.
RARE = ("rare_base", "rare_gain", "rare_known")


def _looked_up(scored: DataFrame, weights: DataFrame, turn: int, parts: int, scratch: Scratch) -> DataFrame:
    """(lm_row, RARE): the weights of texts' rarer n-grams, of each ``PASSES``-th part.

    Both sides go to parts by key.  A part's weights come first and are held; the keys of some
    texts at a time (``base``: the first one's number) are looked up there and added up by text.
    """

    def mine(part: np.ndarray) -> np.ndarray:
        return np.flatnonzero(part % PASSES == turn)

    def deal_weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column("key").to_numpy()
            order = np.argsort(key.view(np.uint64))
            part = blobs.part_of(key[order], parts)
            order, part = order[mine(part)], part[mine(part)]
            values = {"keys": key, "times": batch.column("word").to_numpy().astype(np.int32), "base_p": batch.column("base").to_numpy(), "gain": batch.column("gain").to_numpy()}
            yield blobs.pack(part, {n: v[order] for n, v in values.items()}, base=-1)

    def deal_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, base = [], 0, -1

        def flush() -> pa.RecordBatch:
            keys, rows, times = (np.concatenate(c) for c in zip(*held, strict=True))
            part = blobs.part_of(keys, parts)
            own = mine(part)
            own = own[np.argsort(part[own], kind="stable")]
            packed = blobs.pack(part[own], {"keys": keys[own], "times": times[own], "base_p": (rows[own] - base).astype("<i4")}, base=base)
            return with_columns(packed, gain=pa.nulls(packed.num_rows, pa.binary()))

        for batch in batches:
            batch = batch.filter(batch.column("rare_keys").is_valid())
            rows = batch.column("lm_row").to_numpy()
            for a, b in blobs.equal(rows >> 33):
                if held and (n > blobs.BATCH_KEYS // 2 or rows[a] >> 33 != base >> 33):
                    yield flush()
                    held, n = [], 0
                base = int(rows[a]) if not held else base
                column = batch.column("rare_keys").slice(a, b - a)
                each = pa.compute.binary_length(column).to_numpy() // 8
                held.append((blobs.unpack(column, "<i8"), np.repeat(rows[a:b], each), blobs.unpack(batch.column("rare_times").slice(a, b - a), "<i4")))
                n += len(held[-1][0])
        if held:
            yield flush()

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _by_part(batches):
            own = [np.concatenate([blobs.unpack(b.column(c), t) for b in rows[0]]) if rows[0] else np.empty(0, t) for c, t in (("keys", "<i8"), ("times", "<i4"), ("base_p", "<f8"), ("gain", "<f8"))]
            order = np.argsort(own[0])
            known, word, base_p, gain = (x[order] for x in own)
            for b in rows[1]:
                for i in range(b.num_rows):
                    one = b.slice(i, 1)
                    at = _find(known, blobs.unpack(one.column("keys"), "<i8"))
                    hit = np.flatnonzero(at >= 0)
                    if not len(hit):
                        continue
                    at, times = at[hit], blobs.unpack(one.column("times"), "<i4")[hit]
                    text, of = np.unique(blobs.unpack(one.column("base_p"), "<i4")[hit], return_inverse=True)
                    base = one.column("base")[0].as_py()
                    values = {"rows": text.astype(np.int32), "rare_base": np.bincount(of, times * base_p[at]), "rare_gain": np.bincount(of, times * gain[at]), "rare_known": np.bincount(of, times * word[at]).astype(np.int32)}
                    yield blobs.pack(np.full(len(text), base), values)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for base, rows in blobs.runs(batches):
            text, of = np.unique(np.concatenate([blobs.unpack(b.column("rows"), "<i4") for b in rows]), return_inverse=True)
            sums = [np.bincount(of, np.concatenate([blobs.unpack(b.column(c), t) for b in rows])) for c, t in zip(RARE, ("<f8", "<f8", "<i4"), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(base + text.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array(sums[2].astype(np.int64))], names=["lm_row", *RARE])

    schema = "part bigint, base bigint, keys binary, times binary, base_p binary, gain binary"
    both = map_arrow(weights, deal_weights, schema).unionByName(map_arrow(scored.select("lm_row", "rare_keys", "rare_times"), deal_texts, schema))
    found = map_arrow(blobs.dealt(both, -(-parts // PASSES), "base"), look_up, blobs.schema(["rows", *RARE]))
    flushes = scored.select((F.col("lm_row") / F.lit(1 << 33)).cast("bigint").alias("p")).distinct().count()
    sums = scratch.table(map_arrow(blobs.dealt(found, flushes), add_up, "lm_row bigint, rare_base double, rare_gain double, rare_known bigint"), "sums")
    scratch.release()
    return sums


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple[list[pa.RecordBatch], Iterator[pa.RecordBatch]]]]:
    """For each part its rows of weights (base -1), and its rows of texts one after another."""
    held: list[pa.RecordBatch] = []
    part = None
    for batch in batches:
        parts, base = batch.column("part").to_numpy(), batch.column("base").to_numpy()
        for a, b in blobs.equal(parts, base < 0):
            if parts[a] != part:
                held, part = [], parts[a]
            if base[a] < 0:
                held.append(batch.slice(a, b - a))
            else:
                yield int(part), (held, iter([batch.slice(a, b - a)]))


def perplexity(score: float, n_tokens: int) -> float:
    return math.pow(10.0, -score / max(1, n_tokens))
