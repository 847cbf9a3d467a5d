"""Mixing sources to target weights, in DataFrame expressions alone.

Efraimidis-Spirakis sampling: each document draws an exponential key scaled by
its quality weight, a source takes its documents by ascending key until the
prefix sum of their sizes meets the source's budget.  A budget above the size of
the source is first met by complete epochs; only the rest is sampled.

Nothing is sorted or summed source by source in one task.  Keys fall into
buckets of near equal probability, bucket sums are added up per source, and only
the one bucket in which the budget ends is put in order.  What a source takes is
then one row (epochs, last key, last id), and the decision for a document is a
pure function of its own row, so a source that holds a third of all rows is no
hot spot, and a task that is run again decides as before.

Defined cases: null text has size 0 and is never taken; a null source is a source
of its own, last in order; documents of equal key and id (repeated rows) are
taken together; an empty table gives an empty result; other columns stay, those of the
same names as new ones being replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.llm.scratch import Scratch

#: Sources up to this many are broadcast (one row of some 50 bytes each); more are joined by shuffle.
BROADCAST_SOURCES = 20_000
#: Documents for each bucket of keys, near enough.
BUCKET_ROWS = 4_096
WORD = "[^\\\\x20\\\\x09-\\\\x0D]+"


def n_words(text: str = "text") -> Column:
    """Words of a text as the contract counts them; 0 for null."""
    return F.expr(f"cast(coalesce(regexp_count(`{text}`, '{WORD}'), 0) as bigint)")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that only the key and the seed decide: 52 bits of MD5."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(float(2**52))


def with_keys(docs: DataFrame, weight: Column, seed: str = "mix") -> DataFrame:
    """Add ``mix_size``, unless it is there, and ``mix_key``."""
    sized = docs if "mix_size" in docs.columns else docs.withColumn("mix_size", n_words())
    return sized.withColumn("mix_key", -F.ln(uniform(F.col("doc_id"), seed)) / weight)


def targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2) -> DataFrame:
    """Targets of sources (source, source_size): weights repeat in code point order, null last.

    The level at which uncapped sources stand is found without a loop: by
    ascending cap for each weight, a source is capped exactly if the level that
    would hold without the sources before it is above its own cap.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("w", F.element_at(cycle, (F.row_number().over(everything) - 1) % len(weights) + 1))
    ranked = ranked.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(0, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("w").over(after)
    ranked = ranked.withColumn("level", level).withColumn("pos", F.row_number().over(by_cap))
    ranked = ranked.withColumn("capped", F.col("level") > F.col("cap") / F.col("w"))
    ranked = ranked.withColumn("level", F.min_by(F.when(~F.col("capped"), F.col("level")), F.when(~F.col("capped"), F.col("pos"))).over(whole))
    target = F.when(F.col("capped") | F.col("level").isNull(), F.col("cap").cast("double")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    return ranked.select("source", "source_size", target.alias("target"))


def plan(keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """For each source (source, source_size, target): epochs, and the last key and id of the part that is sampled.

    ``keyed`` has source, doc_id, mix_size and mix_key.  Source sizes may be large
    for one source: all sums are taken in two steps, with partial sums before any shuffle.
    """
    goal = (
        sizes.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint"))
        .withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
        .withColumn("buckets", F.greatest(F.lit(1), F.ceil(F.col("n_docs") / BUCKET_ROWS)).cast("bigint"))
    )
    bucket = F.least(F.col("buckets") - 1, F.floor((F.lit(1.0) - F.exp(-F.col("mix_key"))) * F.col("buckets")))
    split = _by_source(keyed, goal.select("source", "buckets")).withColumn("bucket", bucket)
    sums = split.groupBy("source", "bucket").agg(F.sum("mix_size").alias("size"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edge = (
        sums.withColumn("below", F.coalesce(F.sum("size").over(upto), F.lit(0)))
        .join(goal.select(F.col("source").alias("s"), "rest"), F.col("source").eqNullSafe(F.col("s")))
        .where((F.col("below") <= F.col("rest")) & (F.col("below") + F.col("size") > F.col("rest")))
        .select("source", "bucket", "below", "rest")
    )
    inside = _by_source(split, edge.select("source", F.col("bucket").alias("edge"), "below", "rest")).where(F.col("bucket") == F.col("edge"))
    ids = inside.groupBy("source", "mix_key", "doc_id", "below", "rest").agg(F.sum("mix_size").alias("size"))
    order = Window.partitionBy("source").orderBy("mix_key", "doc_id")
    running = F.col("below") + F.coalesce(F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = (
        ids.withColumn("middle", running + F.col("size") / 2)
        .groupBy("source")
        .agg(
            F.max(F.when(F.col("middle") <= F.col("rest"), F.struct("mix_key", "doc_id"))).alias("last"),
            F.min("mix_key").alias("first_key"),
        )
    )
    full = goal.join(last.select(F.col("source").alias("s"), "last", "first_key"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    # Without a last document the keys below the edge bucket are taken; without an edge bucket, none (no rest) or all.
    return full.select(
        "source", "source_size", "target", "epochs",
        F.when(F.col("rest") <= 0, F.lit(float("-inf"))).when(F.col("last").isNotNull(), F.col("last.mix_key")).otherwise(F.coalesce(F.col("first_key"), F.lit(float("inf")))).alias("last_key"),
        F.when(F.col("rest") > 0, F.col("last.doc_id")).alias("last_id"),
        (F.col("last").isNotNull() & (F.col("rest") > 0)).alias("inclusive"),
    )


def _by_source(rows: DataFrame, small: DataFrame) -> DataFrame:
    """Join on source, null included.  The optimizer broadcasts by its own size limit or splits a hot source (AQE)."""
    other = small.withColumnRenamed("source", "mix_source")
    return rows.join(other, F.col("source").eqNullSafe(F.col("mix_source"))).drop("mix_source")


def mix(docs: DataFrame, weight: Column | None = None, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: str = "mix", narrow: bool = False) -> DataFrame:
    """Add size, source_size, target and taken to documents (columns doc_id, source, and text or mix_size).

    ``weight`` is the quality weight of a document, positive (default 1).
    ``narrow`` keeps doc_id and source alone of the other columns and reads the texts once.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    docs = docs.drop("source_size", "target", "epochs", "last_key", "last_id", "inclusive", "mix_source")
    keyed = with_keys(docs, F.lit(1.0) if weight is None else weight, seed)
    slim = scratch.table(keyed.select("doc_id", "source", "mix_size", "mix_key"), "keys")
    per_source = slim.groupBy("source").agg(F.sum("mix_size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per_source = scratch.table(per_source, "sources")
    goals = targets(per_source.select("source", "source_size"), weights, share, most)
    goals = goals.join(per_source.select(F.col("source").alias("s"), "n_docs"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    plans = scratch.table(plan(slim, goals), "plans")
    if plans.count() <= BROADCAST_SOURCES:
        plans = F.broadcast(plans)
    rows = _by_source(slim if narrow else keyed, plans)
    key, last = F.col("mix_key"), F.col("last_key")
    more = (key < last) | (F.col("inclusive") & (key == last) & (F.coalesce(F.col("doc_id") <= F.col("last_id"), F.col("doc_id").isNull())))
    taken = F.col("mix_size") * (F.col("epochs") + more.cast("bigint"))
    return rows.withColumn("taken", taken).withColumn("size", F.col("mix_size")).drop("mix_size", "mix_key", "epochs", "last_key", "last_id", "inclusive")


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each time that the mix takes a document."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.col("size")).otherwise(0).cast("int")
    return mixed.withColumn("mix_copy", F.explode(F.array_repeat(F.lit(1), times))).select(*columns)


def label_weight(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Add ``mix_weight``: 2 for documents labelled good, 1/2 for bad, 1 without a label.

    Both sides may be shuffled by doc_id, so give documents without their texts.
    """
    best = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("quality").alias("label_quality"))
    joined = docs.join(best, F.col("doc_id") == F.col("label_id"), "left")
    weight = F.when(F.col("label_quality") >= 1, 2.0).when(F.col("label_quality") <= 0, 0.5).otherwise(1.0)
    return joined.withColumn("mix_weight", weight).drop("label_id", "label_quality")
