"""Intermediate tables that outlive an executor.

Tables are Parquet below the folder that the cluster names in
``spark.checkpoint.dir``.  Only where that is unset and the session is local (tests, a
notebook) a temporary folder is made and set; a cluster without the setting is refused.
"""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes that a task holds of each table that it writes.
ROW_GROUP_BYTES = 4 << 20
#: Bytes count from the first row on: by default 100 rows come first, and 100 rows of some MB would be one page, whose codec holds it in direct memory.
PARQUET = {"parquet.block.size": ROW_GROUP_BYTES, "parquet.block.size.row.check.min": 1, "parquet.page.size.row.check.min": 1}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    conf = spark.sparkContext.getConf()
    found = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="lodegrid-")
        spark.conf.set("spark.checkpoint.dir", found)
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop, whatever store it is in."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def _remove_late(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)
    except Exception:  # noqa: BLE001 - the session may be gone, and its store with it
        return


class Scratch:
    """Tables of one query, in a folder of their own that goes with the process."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._paths: dict[int, str] = {}
        self._n = 0
        atexit.register(_remove_late, spark, self.root)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return it as read again: its lineage ends here."""
        path = self.path(name)
        df.write.options(**PARQUET).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._paths[id(out)] = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Delete a table that nothing will read again."""
        if path := self._paths.pop(id(df), None):
            remove(self.spark, path)

    def release(self) -> None:
        """Let Spark delete the shuffle files of queries that nothing refers to any more.

        Spark drops its own references to a query some time after its end, so this looks twice.
        """
        for wait in (0.3, 0.0):
            gc.collect()
            self.spark.sparkContext._jvm.System.gc()
            time.sleep(wait)
