"""Continuous refresh: a stream of files, each micro-batch upserted by the hash gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodegrid.plans.store import Index, gate, last_wins
from lodegrid.sources import files as source_files


def arrivals(spark: SparkSession, root: str) -> DataFrame:
    """Files under a root as they appear: path (full), content, length, modificationTime."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(root)


def apply_batch(index: Index, files: DataFrame, patterns: list[str] | None = None, lost: DataFrame | None = None) -> None:
    """Upsert one batch of files (path, content, length, last_modified), and drop those that went (path); running it again changes nothing."""
    known = index.read()["files"]
    found, _ = source_files.indexable(files, patterns or [])
    found = last_wins(found, ["path"], ["last_modified", "content_hash"])
    changed = gate(found, known).cache()
    went = known.select("path").join(lost.select("path"), "path", "left_semi") if lost is not None else known.select("path").limit(0)
    if not (changed.isEmpty() and went.isEmpty()):
        index.apply(changed, went)
    changed.unpersist()


def path_below(root: str) -> Column:
    """The path of a listed file below a root."""
    base = root.rstrip("/") + "/"
    return F.substring(F.regexp_replace("path", r"^[a-z0-9]+:(//[^/]*)?", ""), F.lit(len(base) + 1), F.lit(1 << 20))


def sweep(index: Index, root: str) -> int:
    """Drop what the index has of files that are no longer under a root; how many went. Files are listed, not read."""
    known = index.read()["files"].select("path")
    listed = index.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(path_below(root).alias("path"))
    went = known.join(listed, "path", "left_anti").cache()
    n = went.count()
    if n:
        nothing = source_files.indexable(index.spark.createDataFrame([], "path string, content binary, length bigint, last_modified timestamp"), [])[0]
        index.apply(nothing, went)
    went.unpersist()
    return n


def removals(index: Index, root: str, checkpoint: str, seconds: int = 60) -> StreamingQuery:
    """Keep an index free of files that went: a listing at each tick of a clock, compared with what is known."""
    clock = index.spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    writer = clock.writeStream.foreachBatch(lambda rows, _: sweep(index, root)).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=f"{seconds} seconds").start()


def refresh(index: Index, root: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Keep an index up with the files that arrive under a root; those that went are dropped as others arrive."""

    def batch(rows: DataFrame, _: int) -> None:
        sweep(index, root)
        apply_batch(index, rows.select(path_below(root).alias("path"), "content", "length", F.col("modificationTime").alias("last_modified")))

    writer = arrivals(index.spark, root).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
