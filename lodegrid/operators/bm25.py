"""Full-text ranking by BM25 over a positional index."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodegrid.functions.columns import index_tokens

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
#: Postings of a block, a power of 2; blocks that a query names one by one to the scan, and reads to learn a first bound.
BLOCK, LISTED, FIRST = 128, 1_000, 4
#: Columns of nodes and of directories that are indexed.
NODE_TEXTS = ("name", "qualified_name", "signature", "docstring", "semantic_summary", "domain_tags", "inferred_responsibility")
DIRECTORY_TEXTS = ("summary", "domain_tags", "responsibility")


def postings(rows: DataFrame, texts: tuple[str, ...] = NODE_TEXTS, key: str = "id") -> DataFrame:
    """The index: (term, id, places). A place is the token's number, columns being far apart."""

    return rows.select(F.col(key).alias("id"), F.inline(_placed(rows, texts))).groupBy("term", "id").agg(F.sort_array(F.collect_list("place")).alias("places"))


def _placed(rows: DataFrame, texts: tuple[str, ...]) -> Column:
    """Tokens of all texts with their places."""

    def placed(c: str, number: int) -> Column:
        return F.transform(_tokens(rows, c), lambda t, i: F.struct(t.alias("term"), (F.lit(number << 40).cast("bigint") + i).alias("place")))

    return F.concat(*[placed(c, n) for n, c in enumerate(texts)])


def _tokens(rows: DataFrame, c: str) -> Column:
    return index_tokens(F.array_join(c, " ") if dict(rows.dtypes)[c].startswith("array") else F.col(c).cast("string"))


def lengths(index: DataFrame) -> DataFrame:
    """(id, length): tokens of each document of an index; one without any is absent."""
    return index.groupBy("id").agg(F.sum(F.size("places")).alias("length"))


def text_lengths(rows: DataFrame, texts: tuple[str, ...] = NODE_TEXTS, key: str = "id") -> DataFrame:
    """``lengths`` from the rows themselves, without a shuffle."""
    size = sum((F.size(_tokens(rows, c)) for c in texts[1:]), F.size(_tokens(rows, texts[0])))
    return rows.select(F.col(key).alias("id"), size.cast("bigint").alias("length")).where("length > 0")


def statistics(rows: DataFrame, texts: tuple[str, ...] = NODE_TEXTS, key: str = "id") -> DataFrame:
    """One row: n_docs with any token, n_tokens, n_terms. Documents and terms are counted in one pass, which shuffles each term once a task."""
    found = rows.select(F.col(key).alias("id"), F.concat(*[_tokens(rows, c) for c in texts]).alias("all")).where(F.size("all") > 0)
    none = lambda kind: F.lit(None).cast(kind)
    document = F.struct(F.lit(True).alias("document"), F.col("id").alias("id"), none("string").alias("term"), F.size("all").cast("bigint").alias("length"))
    terms = F.transform(F.array_distinct("all"), lambda t: F.struct(F.lit(False).alias("document"), none(dict(found.dtypes)["id"]).alias("id"), t.alias("term"), none("bigint").alias("length")))
    each = found.select(F.inline(F.concat(F.array(document), terms))).groupBy("document", "id", "term").agg(F.sum("length").alias("length"))
    return each.agg(F.count_if("document").alias("n_docs"), F.sum("length").alias("n_tokens"), F.count_if(~F.col("document")).alias("n_terms"))


@dataclass
class Unindexed:
    """Texts of rows that no index is made of: a query's phrases are counted where they stand, in one pass."""

    rows: DataFrame
    texts: tuple[str, ...] = NODE_TEXTS
    key: str = "id"

    def counts(self, phrases: list[tuple[str, ...]]) -> DataFrame:
        """(id, length, counts): tokens of each document, and how often each phrase stands in them; one without tokens is absent."""

        def count(words: str, phrase: tuple[str, ...]) -> Column:
            here = lambda t, i: reduce(Column.__and__, [t == phrase[0], *[F.get(F.col(words), i + n) == p for n, p in enumerate(phrase[1:], 1)]])
            return F.size(F.filter(words, here)).cast("bigint") if phrase else F.lit(0).cast("bigint")

        names = [f"words{n}" for n in range(len(self.texts))]
        # Taken apart by a generator of one row, so that no optimizer puts the tokens' expression in each place where they are used.
        apart = self.rows.select(F.col(self.key).alias("id"), F.inline(F.array(F.struct(*[_tokens(self.rows, c).alias(w) for c, w in zip(self.texts, names, strict=True)]))))
        total = lambda parts: reduce(Column.__add__, parts)
        found = apart.select("id", total([F.size(w) for w in names]).cast("bigint").alias("length"), *[total([count(w, p) for w in names]).alias(f"n{i}") for i, p in enumerate(phrases)])
        sums = found.where("length > 0").groupBy("id").agg(F.sum("length").alias("length"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(phrases))])
        return sums.select("id", "length", F.array(*[F.col(f"n{i}") for i in range(len(phrases))]).alias("counts"))


def indexed(rows: DataFrame, texts: tuple[str, ...] = NODE_TEXTS, key: str = "id") -> DataFrame:
    """``postings`` with the length of each document: (term, id, places, length). Keys of rows are unique."""
    placed = rows.select(F.col(key).alias("id"), _placed(rows, texts).alias("parts")).select("id", F.size("parts").cast("bigint").alias("length"), F.inline("parts"))
    return placed.groupBy("term", "id").agg(F.sort_array(F.collect_list("place")).alias("places"), F.max("length").alias("length"))


def ordered(index: DataFrame, small: bool = False) -> DataFrame:
    """Postings by term and document, with ``block``: runs of about ``BLOCK`` of them are numbered alike, one after another.

    A term of very many documents is spread over partitions; none is held whole by a task. ``small``: one partition will do.
    """
    rows = (index.coalesce(1) if small else index.repartitionByRange("term", "id")).sortWithinPartitions("term", "id")
    return rows.withColumn("block", F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1))


def block_bounds(postings: DataFrame) -> DataFrame:
    """(term, block, n, most, shortest): what bounds the scores of a block: its highest count and least length."""
    return postings.groupBy("term", "block").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("places")).alias("most"), F.min("length").alias("shortest"))


@dataclass
class Stored:
    """A full-text index as it is stored, in one segment or several: postings, block_bounds, (term, n), and (docs, tokens).

    The last two are sums of differences, so documents that went are taken off them; postings are those of living documents.
    """

    postings: DataFrame
    blocks: DataFrame
    terms: DataFrame
    totals: DataFrame

    def total(self) -> DataFrame:
        """One row: documents and tokens."""
        return self.totals.agg(F.sum("docs").alias("total"), F.sum("tokens").alias("all_tokens"))


def phrase_counts(index: DataFrame, phrases: list[tuple[str, ...]]) -> DataFrame:
    """(id, counts): for documents with any term, how often each phrase stands in them; with their length if the index has it."""
    terms = sorted({t for p in phrases for t in p})
    hits = index.where(F.col("term").isin(*terms)) if terms else index.where(F.lit(False))
    more = [F.max("length").alias("length")] if "length" in index.columns else []
    found = hits.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("term", "places"))).alias("of"), *more)

    def count(phrase: tuple[str, ...]) -> Column:
        none = F.array().cast("array<bigint>")
        shifted = lambda t, by: F.transform(F.coalesce(F.col("of")[t], none), lambda p: p - by)
        starts = [shifted(t, i) for i, t in enumerate(phrase)]
        return F.size(reduce(F.array_intersect, starts)) if starts else F.lit(0)

    return found.select("id", F.array(*[count(p) for p in phrases]).alias("counts"), *(["length"] if more else []))


def score(index: DataFrame | Stored | Unindexed, phrases: list[tuple[str, ...]], total: int | DataFrame | None = None, every: bool = False, sizes: DataFrame | None = None) -> DataFrame:
    """(id, score) of documents that have every phrase, or any."""
    rows = scored(index, phrases, total, sizes)
    return (rows.where("whole") if every else rows).drop("whole")


def scored(index: DataFrame | Stored | Unindexed, phrases: list[tuple[str, ...]], total: int | DataFrame | None = None, sizes: DataFrame | None = None) -> DataFrame:
    """(id, score, whole) of documents that have any phrase; ``whole``: they have every one.

    ``total``: number of documents, those without tokens included.  ``sizes``: their lengths,
    if they are at hand.  A stored index has both.  Collection statistics are one row, joined by broadcast.
    """
    stored, bare = (index if isinstance(index, kind) else None for kind in (Stored, Unindexed))
    index = stored.postings if stored else bare.rows.select(F.col(bare.key).alias("id")) if bare else index
    if not phrases:
        return index.select("id", F.lit(0.0).alias("score"), F.lit(False).alias("whole")).where(F.lit(False))
    counts = bare.counts(phrases) if bare else phrase_counts(index, phrases)
    size = counts if bare else lengths(index) if sizes is None and not stored else sizes
    rows = F.lit(total).cast("double") if isinstance(total, int) else F.col("total").cast("double")
    stats = counts.agg(F.array(*[F.count_if(F.col("counts")[i] > 0) for i in range(len(phrases))]).alias("with"))
    have = counts.where(F.exists("counts", lambda n: n > 0))
    if stored:
        joined = have.crossJoin(F.broadcast(stats.crossJoin(stored.total())))
    else:
        stats = stats.crossJoin(size.agg(F.sum("length").alias("all_tokens")))
        if not isinstance(total, int):
            stats = stats.crossJoin(total.agg(F.count(F.lit(1)).alias("total")))
        joined = (have.where(F.col("id").isNotNull()) if bare else have.drop("length").join(size, "id")).crossJoin(F.broadcast(stats))

    def part(i: int) -> Column:
        n, tf = F.col("with")[i], F.col("counts")[i]
        idf = F.ln((rows - n + 0.5) / (n + 0.5))
        idf = F.when(idf <= 0, F.lit(LEAST_IDF)).otherwise(idf)
        average = F.col("all_tokens") / rows
        return idf * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * F.col("length") / average))

    return joined.select("id", sum((part(i) for i in range(1, len(phrases))), part(0)).alias("score"), F.forall("counts", lambda n: n > 0).alias("whole"))


def top(index: DataFrame | Stored | Unindexed, phrases: list[tuple[str, ...]], total: int | DataFrame | None, k: int, sizes: DataFrame | None = None) -> DataFrame:
    """(id, score, leg, rank): documents with all phrases first, then those with any, the best ``k``."""
    if isinstance(index, Stored) and len(phrases) == 1 and len(phrases[0]) == 1:
        return best_any(index, [phrases[0][0]], k).select("id", "score", F.lit(1).alias("leg"), "rank")
    rows = scored(index, phrases, total, sizes).withColumn("leg", F.when(F.col("whole") & F.lit(len(phrases) > 1), 0).otherwise(1))
    best = rows.orderBy("leg", F.col("score").desc(), "id").limit(k)
    return best.select("id", "score", "leg").withColumn("rank", F.expr("cast(row_number() over (order by leg, score desc, id) as int)"))


def best_any(index: Stored, terms: list[str], k: int) -> DataFrame:
    """(id, score, rank): the best ``k`` documents by the summed score of those terms that they have, from few blocks.

    The highest bounds name blocks to read first; the k-th best score in them is one that a document
    must reach.  A block whose own bound and the highest bounds of the other terms sum up to less has no such
    document, and isn't read.  Every posting of a document that reaches it is in a block that is: the result is exact.
    """
    times = Counter(terms)
    names = sorted(times)
    df = {r["term"]: r["n"] for r in index.terms.where(F.col("term").isin(names)).groupBy("term").agg(F.sum("n").alias("n")).collect()}  # a row a term
    whole = index.total().first()
    rows, average = whole["total"] or 0, (whole["all_tokens"] or 0) / max(whole["total"] or 0, 1)
    weight = {}
    for t in names:
        n = df.get(t, 0)
        ratio = (rows - n + 0.5) / (n + 0.5)
        weight[t] = times[t] * (math.log(ratio) if ratio > 1 else LEAST_IDF)

    def part(term: Column, tf: Column, length: Column) -> Column:
        weights = F.element_at(F.create_map(*[F.lit(x) for t in names for x in (t, weight[t])]), term)
        return weights * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * length / F.lit(average)))

    none = index.postings.select("id", F.lit(0.0).alias("score"), F.lit(0).alias("rank")).where(F.lit(False))
    if not any(df.values()):
        return none
    own = [c for c in ("segment",) if c in index.blocks.columns]
    bounds = index.blocks.where(F.col("term").isin(names)).select(*own, "term", "block", "n", part(F.col("term"), F.col("most"), F.col("shortest")).alias("bound"))
    highest = {r["term"]: r["bound"] for r in bounds.groupBy("term").agg(F.max("bound").alias("bound")).collect()}
    first = bounds.orderBy(F.col("bound").desc(), *own, "block", "term").limit(max(FIRST, -(-2 * k // BLOCK))).collect()
    seen = _of_blocks(index, first, own).select("id", part(F.col("term"), F.size("places"), F.col("length")).alias("part")).groupBy("id").agg(F.sum("part").alias("score"))
    least = seen.orderBy(F.col("score").desc()).limit(k).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).first()
    floor = least["least"] * (1 - 1e-9) if least["n"] == k else 0.0
    others = F.element_at(F.create_map(*[F.lit(x) for t in names for x in (t, float(sum(b for u, b in highest.items() if u != t)))]), F.col("term"))
    wanted = bounds.where(F.col("bound") + others >= floor)
    named = wanted.limit(LISTED + 1).collect()
    if len(named) <= LISTED:
        read = _of_blocks(index, named, own)
    else:
        read = index.postings.where(F.col("term").isin(names)).join(wanted.select(*own, "term", "block"), [*own, "term", "block"], "left_semi")
    tf = [F.max(F.when(F.col("term") == t, F.size("places"))).alias(f"tf{i}") for i, t in enumerate(names)]
    found = read.groupBy("id").agg(F.max("length").alias("length"), *tf)
    score = reduce(lambda a, b: a + b, [F.coalesce(part(F.lit(t), F.col(f"tf{i}"), F.col("length")), F.lit(0.0)) for i, t in enumerate(names)])
    best = found.select("id", score.alias("score")).orderBy(F.col("score").desc(), "id").limit(k)
    return best.withColumn("rank", F.expr("cast(row_number() over (order by score desc, id) as int)"))


def _of_blocks(index: Stored, blocks: list, own: list[str]) -> DataFrame:
    """The postings of listed blocks; the scan skips the pages of others."""
    by: dict[tuple, list[int]] = {}
    for b in blocks:
        by.setdefault((*[b[c] for c in own], b["term"]), []).append(b["block"])
    wanted = [reduce(Column.__and__, [*[F.col(c) == v for c, v in zip([*own, "term"], key, strict=True)], F.col("block").isin(at)]) for key, at in sorted(by.items())]
    return index.postings.where(reduce(Column.__or__, wanted) if wanted else F.lit(False))
