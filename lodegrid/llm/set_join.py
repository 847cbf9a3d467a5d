"""Exact Jaccard join of n-gram sets by a token-group matrix, returned as classes.

1. A document is its set of word shingles (64-bit hashes).  Equal sets are one
   set, named by a 64-bit digest: a group of copies is one row from here on.  A second
   digest shows names that different sets share; those sets are named again by both.
2. Candidates by pigeonhole.  Two sets of sizes in one range differ in at most d
   tokens if they link.  The tokens are dealt by hash into segments, and a set gives
   a signature for each of its segments, in the two size ranges it belongs to.  With
   more than d segments, linked sets agree on at least one; where fewer do, the odds
   of no agreement are at most e^-30 for any pair that links (``_segments`` proves the
   bound), as those of two hashes being equal.  A segment agrees only if all its
   tokens do, so a passage that many documents share makes few candidates.
3. Sets of one signature are compared by bitmaps of their tokens: differing bits
   count no more than differing tokens, so sets whose bitmaps differ too much can't
   link.  Those left make families, the components of what may link; every true
   link lies within one.  Families are the groups of similar documents.
4. Large families are thinned first: each set is verified against the one that it
   shares most signatures with (one test each), and verified sets form a core.
5. A family is worked through in blocks of ``BLOCK`` sets, the core against the
   core never: only sets outside it meet all blocks.  A block's sets are cut into
   groups, and a group's token union bounds what a query set can share with any
   of its members; only groups whose bound reaches the threshold are opened, by
   rows of a token matrix.  Sets already in one component aren't compared.
6. Components of the verified links give the classes.

Pairs of sets are never rows, and no step needs a family in one task.  Left are
families of many sets outside a core that are all alike but not enough to link:
their blocks meet pairwise, ``BLOCK`` x ``BLOCK`` tests in one matrix product.

Defined cases: null, empty and blank texts have the empty set, size 0, linked with
nothing: each such row is a class of its own; a text of fewer words than a shingle
has its whole sequence as one; equal ids (repeated rows) have the class of their
own text each; null ids are never the least of a class; an empty table gives an
empty result; other columns don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm import words as W
from lodegrid.llm.arrow import lists, map_arrow, with_columns
from lodegrid.llm.components import components
from lodegrid.llm.hot import by_key
from lodegrid.llm.scratch import Scratch

#: Sets of one block of a family.
BLOCK = 256
#: Members whose tokens form one union.
GROUP = 32
#: Linked sets agree on no segment with odds below e to the minus this, where that isn't certain.
ODDS = 30
#: Bits of a set's bitmap: at least as many as its tokens, up to this; sets of more than twice that have none.
BITS = 1024
#: Sets named in a broadcast (8 bytes each) when their tokens are fetched; more are joined by shuffle.
BROADCAST_SETS = 1_000_000
_U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Shingles of ``k`` words; sets link when 100 x intersection >= percent x union."""

    k: int = 5
    percent: int = 80
    odds: float = ODDS
    #: Bits of sets' first names; fewer only in tests.
    name_bits: int = 64

    def level(self, sizes: np.ndarray) -> np.ndarray:
        """The size range of sets: linked sets are in one or in neighbouring ranges."""
        edges = self.edges(int(sizes.max(initial=1)))
        return np.searchsorted(edges, sizes, "right") - 1

    def edges(self, most: int) -> np.ndarray:
        out = [1]
        while out[-1] <= most * 2:  # the least size that is beyond reach of the last one
            out.append(max(out[-1] + 1, -(-out[-1] * 100 // self.percent)))
        return np.array(out)

    def differ(self, most: int) -> int:
        """The most tokens in which linked sets of at most that size differ, in all."""
        # intersection >= p / (100 + p) (|x| + |y|), and the sets differ in |x| + |y| - 2 intersection
        total = most + most
        return total - 2 * math.ceil(self.percent * total / (100 + self.percent))

    def segments(self, levels: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        """For each pair of ranges (i, i + 1): segments, and how many may be empty before empty ones count."""
        edges = self.edges(most)
        n, empty = [], []
        for i in range(levels + 2):
            low, high = int(edges[min(i, len(edges) - 1)]), int(edges[min(i + 2, len(edges) - 1)]) - 1
            found = _segments(low, self.differ(max(high, 1)) + 1, self.odds)  # differ() grows with sizes but for rounding: add one
            n.append(found[0])
            empty.append(found[1])
        return np.array(n), np.array(empty)

    def limit(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The most tokens in which linked sets of these sizes differ; -1 where sizes alone forbid a link."""
        total = a + b
        out = total - 2 * (-(-self.percent * total // (100 + self.percent)))
        return np.where(100 * np.minimum(a, b) >= self.percent * np.maximum(a, b), out, -1)

    def links(self, both: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * both >= self.percent * (a + b - both)


@cache
def _segments(low: int, d: int, odds: float = ODDS) -> tuple[int, int]:
    """Segments for sets of at least ``low`` tokens that differ in at most ``d``, and how many may be empty.

    With n segments, call one good if none of the d tokens and at least one of the common ones
    fall into it; sets agree on each good segment.  One is good with probability
    q = (1 - 1/n)^d (1 - (1 - 1/n)^common).  Numbers of balls in bins are negatively associated
    (Dubhashi and Ranjan, 1998), those of different tokens are independent, and being good falls
    with the first and grows with the second number, so these events are negatively associated too:
    none is good with probability at most (1 - q)^n <= e^(-n q), which is the bound taken here.
    More common tokens or fewer differing ones only raise q, so it holds for all pairs of the range.
    """
    allowed = 0
    for _ in range(6):
        mean = (d + 1 + allowed) * math.exp(-low / (d + 1 + allowed))
        allowed = math.ceil(mean + 3 * math.sqrt(mean))
    sure = d + 1 + allowed
    common = max(1, low - d)
    for n in range(sure // 8, sure, max(1, sure // 200)):
        if n > 8 and n * (1 - 1 / n) ** d * (1 - (1 - 1 / n) ** common) >= odds:
            return n, n  # empty segments never count: the untouched ones aren't all empty
    return sure, allowed


def token_sets(texts: W.Texts, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingles of texts, and how many each has."""
    split = W.split(texts)
    return W.distinct(*W.shingles(split.hashes(), split.counts, k))


def _digests(tokens: np.ndarray, counts: np.ndarray, salt: int) -> np.ndarray:
    sums = np.concatenate(([_U(0)], np.cumsum(W.mix64(tokens ^ _U(salt)))))
    end = np.cumsum(counts)
    return W.mix64(sums[end] - sums[end - counts] + counts.astype(np.uint64) * _U(0x9E3779B97F4A7C15))


def checks(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The second digest of each set."""
    return _digests(tokens + _U(0x9FB21C651E98DF25), counts, 0x8CB92BA72F3D8DD7).view(np.int64)


def digests(tokens: np.ndarray, counts: np.ndarray, rule: Rule | None = None, shared: np.ndarray | None = None) -> np.ndarray:
    """A name for each set, 0 for the empty set; ``shared``: the names, sorted, that need the second digest as well."""
    out = _digests(tokens, counts, 0xD1B54A32D192ED03)
    if rule and rule.name_bits < 64:
        out = out >> _U(64 - rule.name_bits)
    if shared is not None and len(shared):
        found = np.isin(out.view(np.int64), shared)
        out = np.where(found, W.mix64(out ^ W.mix64(checks(tokens, counts).view(np.uint64))), out)
    return np.where(counts > 0, out, _U(0)).view(np.int64)


def segment_signatures(tokens: np.ndarray, counts: np.ndarray, rule: Rule) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of sets, and the number of each set's set (its place among ``counts``)."""
    full = np.flatnonzero(counts)
    if not len(full):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    level = rule.level(counts[full])
    n_of, empty_of = rule.segments(int(level.max()), int(counts.max()))
    mixed = W.mix64(tokens ^ _U(0x2545F4914F6CDD1D))
    place = W.mix64(tokens + _U(0x632BE59BD9B4E019)) >> _U(32)
    out, owner = [], []
    for down in (0, 1):
        ok = level >= down
        sets, pair = full[ok], level[ok] - down
        if not len(sets):
            continue
        n = n_of[pair]
        base = np.cumsum(n) - n
        chosen = np.repeat(ok, counts[full])
        size = np.repeat(n, counts[sets]).astype(np.uint64)
        key = np.repeat(base, counts[sets]) + ((place[chosen] * size) >> _U(32)).astype(np.int64)
        order = np.argsort(key, kind="stable")
        key, own = key[order], mixed[chosen][order]
        start = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        sums = np.zeros(int(n.sum()), np.uint64)
        sums[key[start]] = np.add.reduceat(own, start)
        seen = np.zeros(len(sums), bool)
        seen[key[start]] = True
        set_of = np.repeat(np.arange(len(sets)), n)
        empties = n - np.bincount(set_of[seen], minlength=len(sets))
        emit = seen | np.repeat(empties > empty_of[pair], n)
        segment = np.arange(len(sums)) - np.repeat(base, n)
        salt = (np.repeat(pair, n) * 1_000_003 + segment).astype(np.uint64)
        out.append(W.mix64(sums + W.mix64(salt))[emit])
        owner.append(sets[set_of[emit]])
    return np.concatenate(out), np.concatenate(owner)


def bitmaps(tokens: np.ndarray, counts: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a bit for each token's hash."""
    width = np.where(counts > 2 * BITS, 0, np.clip(1 << np.ceil(np.log2(np.maximum(counts, 64))).astype(np.int64), 64, BITS))
    base = np.cumsum(width) - width
    flat = np.zeros(int(width.sum()), bool)
    kept = np.repeat(width > 0, counts)
    own = np.repeat(width, counts)[kept]
    flat[np.repeat(base, counts)[kept] + (W.mix64(tokens[kept] * _U(0x9E3779B97F4A7C15)).astype(np.int64) & (own - 1))] = True
    packed = np.packbits(flat, bitorder="little").tobytes()
    return [packed[a // 8 : (a + w) // 8] for a, w in zip(base.tolist(), width.tolist(), strict=True)]


def _described(rule: Rule, shared: np.ndarray | None):
    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                tokens, counts = token_sets(texts, rule.k)
                ids = batch.column("doc_id").slice(texts.first, len(texts))
                bits = pa.array(bitmaps(tokens, counts), pa.binary())
                names, check = digests(tokens, counts, rule, shared), checks(tokens, counts)
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts.astype(np.int64)), pa.array(names), pa.array(check), bits], names=["doc_id", "n", "set", "check", "bits"])

    return describe


def fresh_sets(batches: Iterator[pa.RecordBatch], rule: Rule, shared: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, pa.RecordBatch, np.ndarray]]:
    """Each set of a task's texts once: (names, tokens, counts, rows, which of the rows these are)."""
    seen: set[int] = set()
    for batch in batches:
        for texts in W.slices(batch.column("text")):
            tokens, counts = token_sets(texts, rule.k)
            names = digests(tokens, counts, rule, shared)
            fresh = np.array([x not in seen and not seen.add(x) for x in names.tolist()], bool)
            if fresh.any():
                yield names[fresh], tokens[np.repeat(fresh, counts)], counts[fresh], batch.slice(texts.first, len(texts)), np.flatnonzero(fresh)


def _signed(rule: Rule, shared: np.ndarray):
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens, counts, _, _ in fresh_sets(batches, rule, shared):
            signatures, owner = segment_signatures(tokens, counts, rule)
            yield pa.RecordBatch.from_arrays([pa.array(signatures.view(np.int64)), pa.array(names[owner])], names=["signature", "set"])

    return sign


def _folded(bits: np.ndarray, width: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) at a smaller width."""
    return np.bitwise_or.reduce(bits.reshape(len(bits), -1, width), axis=1) if bits.shape[1] > width else bits


def may_link(sizes: np.ndarray, bits: list[np.ndarray], rule: Rule) -> list[tuple[int, int]]:
    """A forest over sets of one signature that joins all pairs whose bitmaps allow a link: (set, the set it hangs on)."""
    k = len(sizes)
    width = min(len(b) for b in bits)
    table = np.concatenate([_folded(b[None, :], width) for b in bits]) if width else np.zeros((k, 1), np.uint64)
    left, out = np.arange(1, k), []
    hang = [0]
    while len(left) or hang:
        if not hang:
            hang, left = [int(left[0])], left[1:]
        i = hang.pop()
        if not len(left):
            break
        near = np.bitwise_count(table[left] ^ table[i]).sum(1, dtype=np.int64) <= rule.limit(sizes[left], sizes[i])
        found = left[near]
        out += [(int(j), i) for j in found]
        hang += found.tolist()
        left = left[~near]
    return out


def _hung(rule: Rule):
    """Rows (signature, set, n, bits) in order of signature to candidates (set, other)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []  # rows of the last signature, which may go on
        last = None

        def work(rows: pa.Table) -> pa.RecordBatch:
            signature, sets, sizes = (rows[c].to_numpy() for c in ("signature", "set", "n"))
            column = rows["bits"].combine_chunks()
            offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            words = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.empty(0, np.uint8)
            words = words[offsets[0] : offsets[-1]].copy().view(np.uint64)
            first = (offsets - offsets[0]) // 8
            starts = np.flatnonzero(np.concatenate(([True], signature[1:] != signature[:-1])))
            a, b = [], []
            for low, high in zip(starts.tolist(), np.append(starts[1:], len(signature)).tolist(), strict=True):
                own = low + np.unique(sets[low:high], return_index=True)[1] if high - low > 1 else ()
                if len(own) > 1:
                    for i, j in may_link(sizes[own], [words[first[x] : first[x + 1]] for x in own.tolist()], rule):
                        a.append(sets[own[i]])
                        b.append(sets[own[j]])
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["set", "other"])

        for batch in batches:
            if not batch.num_rows:
                continue
            signature = batch.column("signature").to_numpy()
            if held and signature[-1] != last:
                cut = int(np.searchsorted(signature, signature[-1]))
                yield work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
            last = signature[-1]
        if held:
            yield work(pa.Table.from_batches(held))

    return run


def _tokens(rule: Rule, shared: np.ndarray):
    """Sets and their tokens, each once for a task; tasks of later steps pass over what is left of repeated rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, tokens, counts, _, _ in fresh_sets(batches, rule, shared):
            yield pa.RecordBatch.from_arrays([pa.array(names), lists(pa.array(tokens.view(np.int64)), counts)], names=["set", "tokens"])

    return run


class Forest:
    """Union-find over the sets of one block pair."""

    def __init__(self, start: np.ndarray):
        self.parent = np.arange(len(start))
        for label in np.unique(start):
            same = np.flatnonzero(start == label)
            self.parent[same] = same[0]

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def roots(self) -> np.ndarray:
        p = self.parent
        while (p != p[p]).any():
            p = p[p]
        self.parent = p
        return p


def linked(tokens: list[np.ndarray], left: np.ndarray, right: np.ndarray, start: np.ndarray, rule: Rule) -> list[tuple[int, int]]:
    """Links that join components between sets ``left`` (queries) and ``right`` (grouped), numbers into ``tokens``.

    ``start``: the component of each set so far.  Enough links are returned to join all that links join.
    """
    sizes = np.array([len(t) for t in tokens], np.int64)
    flat = np.concatenate(tokens) if tokens else np.empty(0, np.int64)
    owner = np.repeat(np.arange(len(tokens)), sizes)
    values, token, times = np.unique(flat, return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    keep = shared[token]
    owner, token = owner[keep], number[token[keep]]
    n_tokens = int(shared.sum())
    first = np.searchsorted(owner, np.arange(len(tokens) + 1))
    forest, out = Forest(start), []
    right = right[np.argsort(sizes[right], kind="stable")]
    queries = np.flatnonzero(np.isin(owner, left))
    row = np.full(len(tokens), -1)
    row[left] = np.arange(len(left))
    for at in range(0, len(right), GROUP):
        group = right[at : at + GROUP]
        members = np.concatenate([token[first[g] : first[g + 1]] for g in group])
        union = np.zeros(n_tokens, bool)
        union[members] = True
        hit = queries[union[token[queries]]]
        overlap = np.bincount(row[owner[hit]], minlength=len(left))
        # What a query shares with the union bounds what it shares with any member.
        least, most = sizes[group[0]], sizes[group[-1]]
        bound = np.minimum(overlap, most)
        good = (100 * bound >= rule.percent * sizes[left]) & (100 * most >= rule.percent * sizes[left]) & (100 * sizes[left] >= rule.percent * least)
        roots = forest.roots()
        labels = np.unique(roots[group])
        if len(labels) == 1:
            good &= roots[left] != labels[0]
        opened = left[good]
        if not len(opened):
            continue
        both = _products(token, first, opened, group, union)
        link = rule.links(both, sizes[opened][:, None], sizes[group][None, :])
        for i, j in np.argwhere(link).tolist():
            a, b = forest.find(int(opened[i])), forest.find(int(group[j]))
            if a != b:
                forest.parent[max(a, b)] = min(a, b)
                out.append((int(opened[i]), int(group[j])))
    return out


def _products(token: np.ndarray, first: np.ndarray, opened: np.ndarray, group: np.ndarray, union: np.ndarray) -> np.ndarray:
    """How many tokens each opened query shares with each member, by a product of 0/1 matrices over the union."""
    column = np.cumsum(union) - 1
    width = int(union.sum())
    both = np.zeros((len(opened), len(group)), np.float32)
    step = 1 << 15

    def rows(sets: np.ndarray, low: int) -> np.ndarray:
        m = np.zeros((len(sets), min(step, width - low)), np.float32)
        for i, s in enumerate(sets.tolist()):
            own = token[first[s] : first[s + 1]]
            own = column[own[union[own]]] - low
            m[i, own[(own >= 0) & (own < m.shape[1])]] = 1
        return m

    for low in range(0, width, step):
        both += rows(opened, low) @ rows(group, low).T
    return both.astype(np.int64)


def _blocks_linked(rule: Rule):
    """Tasks are runs of rows (task, side, set, component, tokens) in order of task; side 0: queries and members, 1: queries, 2: members."""

    def work(rows: list[tuple]) -> list[tuple[int, int]]:
        seen: dict[int, int] = {}
        sides: tuple[set, set] = (set(), set())
        tokens, start, names = [], [], []
        for side, name, component, own in rows:
            if name not in seen:
                seen[name] = len(names)
                names.append(name)
                tokens.append(own)
                start.append(component)
            for s in (0, 1) if side == 0 else (side - 1,):
                sides[s].add(seen[name])
        if not sides[0] or not sides[1]:
            return []
        found = linked(tokens, np.array(sorted(sides[0])), np.array(sorted(sides[1])), np.array(start), rule)
        return [(names[i], names[j]) for i, j in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, rows = None, []

        def done() -> pa.RecordBatch:
            pairs = work(rows)
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["a", "b"])

        for batch in batches:
            tasks = batch.column("task").to_pylist()
            sides, names, comps = (batch.column(c).to_pylist() for c in ("side", "set", "component"))
            column = batch.column("tokens")
            flat, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
            for i, t in enumerate(tasks):
                if t != task and rows:
                    yield done()
                    rows = []
                task = t
                rows.append((sides[i], names[i], comps[i], flat[offsets[i] : offsets[i + 1]].copy()))
        if rows:
            yield done()

    return run


def verify(families: DataFrame, best: DataFrame, tokens: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Links (a, b) that join what links join within families.

    families: (set, family); best: (set, other), for each set the one it is most like;
    tokens: (set, tokens) of all sets in families.
    """
    total = families.count()
    sizes = families.groupBy("family").agg(F.count(F.lit(1)).alias("m"))
    families = scratch.table(by_key(families, sizes.withColumn("key_rows", F.col("m")), "family", total), "sized")
    small = families.where(F.col("m") <= BLOCK)
    tasks = small.select(F.col("family").alias("task"), F.lit(0).alias("side"), "set", F.col("set").alias("component"))

    def run(t: DataFrame) -> DataFrame:
        t = scratch.table(t, "tasks")
        t = F.broadcast(t) if t.count() <= BROADCAST_SETS else t
        dealt = tokens.join(t, "set").select("task", "side", "set", "component", "tokens").repartition("task").sortWithinPartitions("task", "side", "set")
        return map_arrow(dealt, _blocks_linked(rule), "a bigint, b bigint")

    links = scratch.table(run(tasks), "links")
    large = scratch.table(families.where(F.col("m") > BLOCK), "large")
    if large.isEmpty():
        return links
    # A core first: every set against the one most like it, hubs in blocks of their followers.
    pair = large.join(best, "set").where("set <> other").select("set", "other")
    hubs = pair.groupBy("other").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"), F.count(F.lit(1)).alias("key_rows"))
    pair = by_key(pair, hubs, "other", total).withColumn("part", F.pmod(F.xxhash64("set", F.lit(1)), F.col("parts")))
    star = pair.select(F.xxhash64("other", "part").alias("task"), F.lit(1).alias("side"), "set", F.col("set").alias("component"))
    hub = pair.select(F.xxhash64("other", "part").alias("task"), F.lit(2).alias("side"), F.col("other").alias("set"), F.col("other").alias("component")).distinct()
    first = scratch.table(run(star.unionByName(hub)), "links")
    named = large.join(components(first, scratch).withColumnRenamed("node", "set"), "set", "left").withColumn("component", F.coalesce("component", "set"))
    by_size = named.groupBy("family", "component").agg(F.count(F.lit(1)).alias("n"))
    cores = by_size.groupBy("family").agg(F.max(F.struct("n", "component")).alias("c"), F.sum("n").alias("members"))
    cores = scratch.table(cores.select("family", F.col("c.component").alias("core"), F.col("c.n").alias("n_core"), "members", F.col("members").alias("key_rows")), "cores")
    cored = by_key(named, cores, "family", total)
    outside = F.col("component") != F.col("core")
    count = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK))
    cored = cored.withColumn("outside", outside).withColumn("of_core", count(F.col("n_core"))).withColumn("of_rest", F.when(F.col("members") > F.col("n_core"), count(F.col("members") - F.col("n_core"))).otherwise(0))
    cored = scratch.table(cored.withColumn("block", F.pmod(F.xxhash64("set", F.lit(2)), F.when(F.col("outside"), F.col("of_rest")).otherwise(F.col("of_core")))).where("of_rest > 0"), "cored")
    # Blocks outside the core meet each other once (i <= j), and all blocks of the core.
    rest = F.sequence(F.lit(0).cast("bigint"), F.col("of_rest") - 1)
    name = lambda i, j, kind: F.xxhash64("family", i, j, F.lit(kind))
    meet_rest = F.transform(rest, lambda j: F.struct(name(F.least(F.col("block"), j), F.greatest(F.col("block"), j), 0).alias("task"), F.when(j == F.col("block"), 0).when(F.col("block") < j, 1).otherwise(2).alias("side")))
    core_blocks = F.sequence(F.lit(0).cast("bigint"), F.col("of_core") - 1)
    meet_core = F.transform(core_blocks, lambda j: F.struct(name(F.col("block"), j, 1).alias("task"), F.lit(1).alias("side")))
    from_core = F.transform(rest, lambda i: F.struct(name(i, F.col("block"), 1).alias("task"), F.lit(2).alias("side")))
    tasks = cored.select("set", "component", F.inline(F.when(F.col("outside"), F.concat(meet_rest, meet_core)).otherwise(from_core))).select("task", "side", "set", "component")
    second = scratch.table(run(tasks), "links")
    return links.unionByName(first).unionByName(second)


def named_sets(docs: DataFrame, rule: Rule) -> DataFrame:
    """Add ``check``, the second digest of each row's set."""

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                yield with_columns(batch.slice(texts.first, len(texts)), check=pa.array(checks(*token_sets(texts, rule.k))))

    return map_arrow(docs, name, T.StructType([*docs.schema.fields, T.StructField("check", T.LongType())]))


def classes(docs: DataFrame, rule: Rule, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of documents (doc_id, text); ``named`` adds component and check."""
    scratch = Scratch(docs.sparkSession, "join")
    docs = docs.select("doc_id", "text")
    sets, shared = described(docs, rule, scratch)
    signatures = map_arrow(docs.select("text"), _signed(rule, shared), "signature bigint, set bigint")
    return joined(docs, sets, shared, signatures, rule, scratch, named)


def described(docs: DataFrame, rule: Rule, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """(doc_id, n, set, check, bits): sizes, names and bitmaps of the documents' sets, stored; and names that different sets shared."""
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n bigint, set bigint, check bigint, bits binary"
    sets = scratch.table(map_arrow(docs, _described(rule, None), schema), "sets")
    apart = sets.where("n > 0").groupBy("set").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("set")
    # One is expected where there are 6 x 10^9 sets, and 100,000 where there are 2 x 10^12.
    shared = np.sort(apart.limit(BROADCAST_SETS + 1).toArrow()["set"].to_numpy())
    if len(shared) > BROADCAST_SETS:
        raise ValueError("too many sets share a name")
    if len(shared):
        sets = scratch.table(map_arrow(docs, _described(rule, shared), schema), "sets")
    return sets, shared


def joined(docs: DataFrame, sets: DataFrame, shared: np.ndarray, signatures: DataFrame, rule: Rule, scratch: Scratch, named: bool = False) -> DataFrame:
    """Classes from sets (as ``described``) and candidate rows (signature, set)."""
    # Most signatures are of one set: those rows end here, and only the others get bitmaps.
    order = Window.partitionBy("signature").orderBy("set")
    near = signatures.withColumns({"before": F.lag("set").over(order), "after": F.lead("set").over(order)})
    fresh = F.col("before").isNull() | (F.col("before") != F.col("set"))
    common = near.where(fresh & (F.col("before").isNotNull() | F.col("after").isNotNull())).select("signature", "set")
    common = scratch.table(common, "common")
    scratch.release()
    # From here on a set is one row, however many documents have it.
    each = sets.where("n > 0").groupBy("set").agg(F.first("n").alias("n"), F.first("bits").alias("bits"), F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    marked = common.join(each.select("set", "n", "bits"), "set").select("signature", "set", "n", "bits").repartition("signature").sortWithinPartitions("signature", "set")
    hung = map_arrow(marked, _hung(rule), "set bigint, other bigint")
    candidates = scratch.table(hung.groupBy("set", "other").agg(F.count(F.lit(1)).alias("n")), "candidates")
    sets = sets.drop("bits")
    each = scratch.table(each.select("set", "least", "copies"), "each")
    scratch.release()
    families = scratch.table(components(candidates.select(F.col("set").alias("a"), F.col("other").alias("b")), scratch).select(F.col("node").alias("set"), F.col("component").alias("family")), "families")
    best = candidates.groupBy("set").agg(F.max_by("other", F.struct("n", "other")).alias("other"))
    # One text for each set of a family gives its tokens again.
    wanted = scratch.table(each.join(families.select("set"), "set").select(F.col("least").alias("doc_id")), "wanted")
    few = wanted.count() <= BROADCAST_SETS
    ids = wanted.distinct()
    texts = docs.join(F.broadcast(ids) if few else ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")
    tokens = map_arrow(texts.select("text"), _tokens(rule, shared), "set bigint, tokens array<bigint>")
    tokens = scratch.table(tokens.join(F.broadcast(families.select("set")) if few else families.select("set"), "set", "left_semi"), "tokens")
    scratch.release()
    links = verify(families, best, tokens, rule, scratch)
    scratch.drop(tokens)
    linked_sets = components(links, scratch).withColumnRenamed("node", "set")
    placed = scratch.table(each.join(linked_sets, "set", "left").withColumn("component", F.coalesce("component", "set")), "placed")
    total = sets.count()
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("key_rows"))
    placed = by_key(placed.drop("least"), least, "component", total).withColumnRenamed("copies", "key_rows")
    placed = scratch.table(placed, "classes")
    rows = by_key(sets.withColumn("set", F.when(F.col("n") > 0, F.col("set"))), placed, "set", total)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), *(["component", "check"] if named else []))
