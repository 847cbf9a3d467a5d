"""The documents and pages of the test tables seen as files, lines, nodes and directories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.functions.columns import ancestors, longest_token
from lodegrid.sources.files import to_lines

#: Lines of one unit of a document.
BLOCK = 5


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_path() -> F.Column:
    return F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.col("doc_id").cast("string"))


def document_files(docs: DataFrame) -> DataFrame:
    """(path, doc_id, text): a file for each document, in a directory for its source and language."""
    return docs.select(document_path().alias("path"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))


def document_lines(docs: DataFrame) -> DataFrame:
    return to_lines(document_files(docs))


def document_nodes(docs: DataFrame) -> DataFrame:
    """Nodes of documents: the file; its first half, a class; and blocks of lines, by turns function and method.

    A unit is named after the longest token of its first line; one without a token is left out.
    """
    lines = F.split("text", "\n")
    files = document_files(docs).select("path", F.col("doc_id").cast("string").alias("doc"), lines.alias("lines"), F.size(lines).alias("n"))
    unit = lambda kind, start, end, number: F.struct(F.lit(kind).alias("node_type") if isinstance(kind, str) else kind.alias("node_type"), start.alias("start_line"), end.alias("end_line"), number.alias("ord"), F.element_at("lines", start).alias("first"))
    one = F.lit(1)
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.col("n") - 1) / BLOCK).cast("int")),
        lambda b: unit(F.when(b % 2 == 0, "function").otherwise("method"), b * BLOCK + 1, F.least(b * BLOCK + BLOCK, F.col("n")), b + 2),
    )
    units = F.concat(F.array(unit("file", one, F.col("n"), F.lit(0))), F.when(F.col("n") >= 4, F.array(unit("class", one, F.ceil(F.col("n") / 2).cast("int"), one))).otherwise(F.array()), blocks)
    rows = files.select("path", "doc", F.inline(units))
    named = rows.withColumn("name", F.when(F.col("node_type") == "file", F.col("doc")).otherwise(longest_token("first")))
    named = named.where(F.col("name").isNotNull())
    qualified = F.when(F.col("node_type") == "file", F.col("path")).when(F.col("node_type") == "method", F.concat("doc", F.lit("."), "name")).otherwise(F.col("name"))
    return named.select(
        F.concat_ws("::", "path", "node_type", qualified, F.col("start_line").cast("string")).alias("id"), F.col("path").alias("file_path"), "node_type", "name",
        qualified.alias("qualified_name"), "start_line", "end_line", "ord",
    )


def page_paths(pages: DataFrame) -> DataFrame:
    """(page_id, path): host and path of each page, without query and fragment."""
    return pages.select("page_id", F.regexp_replace(F.regexp_replace("url", r"^[a-z]+://", ""), r"/?([?#].*)?$", "").alias("path"))


def page_directories(pages: DataFrame) -> DataFrame:
    return page_paths(pages).select("page_id", "path", F.explode(ancestors("path")).alias("dir_path"))


def supply_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges customer -> nation (references), supplier -> nation (calls), nation -> region (imports), order -> customer (inherits)."""
    edge = lambda t, a, sa, b, sb, kind: table(spark, sf_dir, t).select(F.concat(F.lit(a), F.col(sa).cast("string")).alias("source_id"), F.concat(F.lit(b), F.col(sb).cast("string")).alias("target_id"), F.lit(kind).alias("edge_type"), F.lit(0).alias("call_site_line"))
    return (
        edge("customer", "c", "c_custkey", "n", "c_nationkey", "references").unionByName(edge("supplier", "s", "s_suppkey", "n", "s_nationkey", "calls"))
        .unionByName(edge("nation", "n", "n_nationkey", "r", "n_regionkey", "imports")).unionByName(edge("orders", "o", "o_orderkey", "c", "o_custkey", "inherits"))
    )
