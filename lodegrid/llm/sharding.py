"""Sharding by jump consistent hashing, in DataFrame expressions alone.

A stable key and the number of shards decide the shard; there is no ring table,
and one more shard takes rows only into itself.  The loop of the published
algorithm (Lamping and Veach, 2014) is a fold over a sequence: a 64-bit linear
congruential generator, kept as DECIMAL(20) because SQL integers don't wrap.

Slots count each shard's rows from 0 without a gap.  They don't need a shard in
one task: rows are numbered within sub-shards, whose counts are added up.  A sub-shard is
chosen by the key and the columns that order its rows, so rows of one key but different
content are spread too.  Rows move once, to the tasks that write their shards.

Defined cases: a null key counts as hash 42 (that of Spark's xxhash64 of null);
null text has 0 bytes and checksum 0; equal keys (repeated rows) share a shard and
get slots of their own; very long texts are rows as any; an empty table gives an empty result; other columns stay, those of
the same names as new ones being replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows numbered together, and rows in a task, near enough.
SLOT_ROWS, TASK_ROWS = 4_096, 16_384


def jump(key: Column | str, shards: int) -> Column:
    """The shard, 0 to ``shards`` - 1, of a key."""
    key = F.col(key) if isinstance(key, str) else key
    state = F.xxhash64(key).cast("decimal(20,0)")
    start = F.when(state < 0, state + F.lit(str(2**64)).cast("decimal(20,0)")).otherwise(state).cast("decimal(20,0)")
    factor, modulus = F.lit("2862933555777941757").cast("decimal(19,0)"), F.lit(str(2**64)).cast("decimal(20,0)")

    def step(acc: Column, _: Column) -> Column:
        drawn = ((acc["state"] * factor + F.lit(1)) % modulus).cast("decimal(20,0)")
        high = F.floor(drawn / F.lit(2**33).cast("decimal(10,0)")).cast("double")
        after = F.floor((acc["next"] + 1) * (F.lit(float(2**31)) / (high + 1.0))).cast("bigint")
        jumped = F.struct(drawn.alias("state"), acc["next"].alias("bucket"), after.alias("next"))
        return F.when(acc["next"] < shards, jumped).otherwise(acc)

    zero = F.struct(start.alias("state"), F.lit(-1).cast("bigint").alias("bucket"), F.lit(0).cast("bigint").alias("next"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), zero, step, lambda acc: acc["bucket"].cast("int"))


def text_crc32(text: str = "text") -> Column:
    """Unsigned CRC-32 of the UTF-8 bytes; 0 for null."""
    return F.coalesce(F.crc32(F.col(text).cast("binary")), F.lit(0)).cast("bigint")


def shard(docs: DataFrame, shards: int = 24, key: str = "doc_id", order: list[str] | None = None) -> DataFrame:
    """Add shard, slot and grown_shard (with one more shard) to rows.

    ``order``: columns by which a sub-shard's rows are numbered (the key first).
    """
    docs = docs.drop("shard", "sub_shard", "slot", "slot_base", "grown_shard")
    part = jump(key, shards)
    content = [F.col(c) for c in (key, *(order or []))]
    sub_of = lambda n: F.pmod(F.xxhash64(*content, F.lit("slot")), F.lit(n))
    ids = docs.select(*content)
    total = ids.count()
    n = max(1, -(-total // (shards * SLOT_ROWS)))
    counts = ids.select(part.alias("shard"), sub_of(n).alias("sub_shard")).groupBy("shard", "sub_shard").count()
    below = Window.partitionBy("shard").orderBy("sub_shard").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "sub_shard", F.coalesce(F.sum("count").over(below), F.lit(0)).alias("slot_base"))
    placed = docs.withColumns({"shard": part, "sub_shard": sub_of(n), "grown_shard": jump(key, shards + 1)})
    placed = placed.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_ROWS)), "shard", "sub_shard")
    numbered = Window.partitionBy("shard", "sub_shard").orderBy(key, *(order or []))
    rows = placed.withColumn("slot", F.row_number().over(numbered).cast("bigint") - 1)
    return rows.join(base, ["shard", "sub_shard"]).withColumn("slot", F.col("slot") + F.col("slot_base")).select(*docs.columns, "shard", "slot", "grown_shard")
