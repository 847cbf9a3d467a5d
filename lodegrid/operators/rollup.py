"""Directory roll-ups: prefix conditions on paths as equi-joins on ancestors."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.functions.columns import ancestors, depth, parent_dir


def directories(files: DataFrame, path: str = "path") -> DataFrame:
    """(dir_path, depth) of all directories above files, ``.`` included, deepest first."""
    return files.select(F.explode(ancestors(path)).alias("dir_path")).distinct().withColumn("depth", depth("dir_path")).orderBy(F.col("depth").desc(), "dir_path")


def counts(nodes: DataFrame) -> DataFrame:
    """(dir_path, file_count, node_count) of what is below each directory at any depth.

    Nodes are counted by file first, so ancestors are listed for files, not for nodes.
    """
    by_file = nodes.groupBy("file_path").agg(F.count(F.lit(1)).alias("n"))
    return by_file.select(F.explode(ancestors("file_path")).alias("dir_path"), "n").groupBy("dir_path").agg(F.count(F.lit(1)).alias("file_count"), F.sum("n").alias("node_count"))


def child_directories(dirs: DataFrame) -> DataFrame:
    """(dir_path, child_dirs): the directories directly below, in order."""
    return dirs.where(F.col("dir_path") != ".").groupBy(parent_dir("dir_path").alias("parent")).agg(F.array_sort(F.collect_list("dir_path")).alias("child_dirs")).withColumnRenamed("parent", "dir_path")


def direct_files(nodes: DataFrame) -> DataFrame:
    """Nodes with the directory that their file is directly in."""
    return nodes.withColumn("dir_path", parent_dir("file_path"))


def stale_directories(dirs: DataFrame, nodes: DataFrame, summaries: DataFrame) -> DataFrame:
    """Directories (dir_path) without a stamped summary, or with a direct node enriched after it."""
    newest = direct_files(nodes).groupBy("dir_path").agg(F.max("enriched_at").alias("newest"))
    own = summaries.select("dir_path", "enriched_at")
    joined = dirs.select("dir_path").join(own, "dir_path", "left").join(newest, "dir_path", "left")
    return joined.where(F.col("enriched_at").isNull() | (F.col("newest") > F.col("enriched_at"))).select("dir_path")


def first_lines(lines: DataFrame, key: str, order: list[str], line: str, most: int) -> DataFrame:
    """(key, n, text): how many rows each key has, and the texts of its first ``most`` rows in an order, one to a line.

    The state of a key is that many rows and a count: every task keeps the first rows of each key that
    it sees, those are shuffled, and of them the first are kept again; counts are summed.  So a key of any
    number of rows is never in one row, task or buffer.  Null texts count as rows and give no line; ties in
    the order are broken by the text.
    """
    rows = lines.select(F.col(key), F.struct(*order, line).alias("row"))
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    # Spark keeps the first rows of each task before the shuffle (WindowGroupLimit), as the rank is bounded.
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("row"))).where(F.col("place") <= most)
    text = rows.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list("row")), lambda x: x[line]), "\n").alias("text"))
    return counted.join(text, key)


def contents(nodes: DataFrame, summaries: DataFrame, dirs: DataFrame, most: int | None = None) -> DataFrame:
    """(dir_path, contents, child_count): lines on the files, the nodes of files without a summary, and child directories.

    ``child_count`` is the number of children; a directory with nothing to tell says so and counts as one line.
    With ``most``, contents are the first so many lines and a last one that tells how many are left out.
    """
    placed = direct_files(nodes)
    files = placed.where((F.col("node_type") == "file") & F.col("semantic_summary").isNotNull())
    told = files.select("dir_path", F.lit(0).alias("leg"), F.col("file_path").alias("key"), F.lit(0).alias("ord"), F.concat(F.lit("File "), "file_path", F.lit(": "), "semantic_summary").alias("line"))
    rest = placed.where(F.col("node_type") != "file").join(files.select("file_path"), "file_path", "left_anti")
    units = rest.select("dir_path", F.lit(1).alias("leg"), F.col("file_path").alias("key"), "ord", F.concat("node_type", F.lit(" "), "qualified_name", F.coalesce(F.concat(F.lit(": "), "semantic_summary"), F.lit(""))).alias("line"))
    below = summaries.where((F.col("dir_path") != ".") & F.col("summary").isNotNull())
    folders = below.select(parent_dir("dir_path").alias("dir_path"), F.lit(2).alias("leg"), F.col("dir_path").alias("key"), F.lit(0).alias("ord"), F.concat(F.lit("Directory "), "dir_path", F.lit(": "), "summary").alias("line"))
    lines = told.unionByName(units).unionByName(folders)
    if most is None:
        text = lines.groupBy("dir_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("leg", "key", "ord", "line"))), lambda x: x["line"]), "\n").alias("contents"))
        out = dirs.select("dir_path").join(text, "dir_path", "left").withColumn("contents", F.coalesce("contents", F.lit("(empty directory)")))
        return out.withColumn("child_count", F.size(F.split("contents", "\n")))
    told = first_lines(lines, "dir_path", ["leg", "key", "ord"], "line", most)
    left = F.when(F.col("n") > most, F.concat(F.lit("\n("), F.col("n") - most, F.lit(" more)"))).otherwise("")
    out = dirs.select("dir_path").join(told, "dir_path", "left")
    return out.select("dir_path", F.coalesce(F.concat("text", left), F.lit("(empty directory)")).alias("contents"), F.coalesce("n", F.lit(1)).cast("int").alias("child_count"))


def listing(nodes: DataFrame, wanted: DataFrame, each: int) -> DataFrame:
    """The first ``each`` nodes below each of the directories (dir_path, place: a handful), by type and name; each node once."""
    spread = nodes.select("*", F.explode(ancestors("file_path")).alias("dir_path")).join(F.broadcast(wanted), "dir_path")
    first = Window.partitionBy("dir_path").orderBy("node_type", "qualified_name", "id")
    ranked = spread.withColumn("within", F.row_number().over(first)).where(F.col("within") <= each)
    once = Window.partitionBy("id").orderBy("place", "within")
    return ranked.withColumn("turn", F.row_number().over(once)).where("turn = 1").drop("turn").orderBy("place", "within")
