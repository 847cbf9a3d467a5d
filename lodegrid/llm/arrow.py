"""Helpers for operators that run numpy on Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of one Arrow batch on its way to a Python worker, unless the session says otherwise.
BATCH_BYTES = 2 << 20


def small_batches(spark: SparkSession) -> None:
    """Bound batches by bytes as well as rows: a batch of long texts then stays small."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    given = spark.sparkContext.getConf().get(key)
    if not given:
        spark.conf.set(key, str(BATCH_BYTES))


def map_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: T.StructType | str) -> DataFrame:
    small_batches(df.sparkSession)
    return df.mapInArrow(f, schema)


def with_columns(batch: pa.RecordBatch, drop: tuple[str, ...] = (), **new: pa.Array) -> pa.RecordBatch:
    """A batch with columns removed and others set at its end."""
    names = [n for n in batch.schema.names if n not in drop and n not in new]
    return pa.RecordBatch.from_arrays([batch.column(n) for n in names] + list(new.values()), names=names + list(new))


def lists(values: pa.Array, counts) -> pa.Array:
    """List arrays from flat values and the number of each."""
    import numpy as np

    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), values)


def id_crc(mod: int):
    """crc32 of the id as text, modulo ``mod``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % mod
