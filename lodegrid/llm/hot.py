"""Joins of many rows to a table with one row for each key, where some keys hold very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot if it holds more than this share of the rows (so at most 1/SHARE keys are), and more than LEAST rows.
SHARE, LEAST = 1e-5, 1_000


def by_key(rows: DataFrame, table: DataFrame, key: str, total: int, n: str = "key_rows") -> DataFrame:
    """``rows`` with the columns of ``table`` (key, n, ...), null where the table lacks the key.

    ``n`` (dropped) says how many of the rows have the key, ``total`` how many rows there are.
    Hot keys, at most 100,000 of them, are broadcast; other keys are joined by shuffle, where
    rows of hot or null keys are spread over all tasks, as they look for nothing there.
    """
    hot = F.col(n) > max(LEAST, SHARE * total)
    values = [c for c in table.columns if c not in (key, n)]
    packed = lambda name: (F.col(key).alias(f"{name}_key"), F.struct(*values).alias(f"{name}_values"))
    near = rows.join(F.broadcast(table.where(hot).select(*packed("hot"))), F.col(key) == F.col("hot_key"), "left")
    spread = F.when(F.col("hot_key").isNull() & F.col(key).isNotNull(), F.col(key)).otherwise(F.xxhash64(F.monotonically_increasing_id()))
    far = near.withColumn("far_key", spread).join(table.where(~hot).select(*packed("cold")), F.col("far_key") == F.col("cold_key"), "left")
    held = F.when(F.col("hot_key").isNotNull(), F.col("hot_values")).when(F.col(key).isNotNull(), F.col("cold_values"))
    found = far.withColumn("found_values", held)
    return found.select(*rows.columns, *[F.col("found_values")[c].alias(c) for c in values])
