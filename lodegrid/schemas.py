"""Tables of the index, and checks that Parquet can't make by itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA_VERSION = 3
NODE_TYPES = ("file", "class", "function", "method", "interface", "object", "module")
EDGE_TYPES = ("calls", "imports", "inherits", "overrides", "references", "instantiates")
LANGUAGES = ("python", "kotlin", "typescript", "java", "ruby")


_KINDS = {"string": T.StringType(), "int": T.IntegerType(), "bool": T.BooleanType(), "timestamp": T.TimestampType(), "long": T.LongType(), "string[]": T.ArrayType(T.StringType()), "long[]": T.ArrayType(T.LongType())}


def _fields(text: str) -> T.StructType:
    """A schema from names and kinds; ! marks columns without nulls."""
    parts = [part.split() for part in text.split(",")]
    return T.StructType([T.StructField(name, _KINDS[kind.rstrip("!")], not kind.endswith("!")) for name, kind in parts])


NODE = _fields(
    "id string!,file_path string!,node_type string!,name string!,qualified_name string!,signature string,docstring string,start_line int!,end_line int!,"
    "language string!,raw_source string,content_hash string!,semantic_summary string,domain_tags string[],inferred_responsibility string,"
    "enriched_at timestamp,enrichment_model string,ord int!"
)
EDGE = _fields("source_id string!,target_id string!,edge_type string!,call_site_line int!")
FILE = _fields("path string!,last_modified timestamp!,content_hash string!,language string!,node_count int,indexed_at timestamp!")
DIRECTORY = _fields("dir_path string!,summary string,domain_tags string[],responsibility string,child_count int!,enriched_at timestamp,enrichment_model string")
META = _fields("key string!,value string!")
LINE = _fields("file_path string!,line_no int!,text string!")
#: What follows from nodes and lines, so that a build touches only what changed: words of lines with the unit that each line
#: belongs to, names that units can be called by, edges with the files of their ends.
MENTION = _fields("word string!,file_path string!,line_no int!,node_id string,node_type string,node_name string,node_qualified string")
NAME = _fields("stem string!,plain bool!,name string!,target_id string!,target_type string!,target_qualified string!,target_path string!")
SITED_EDGE = T.StructType(EDGE.fields + _fields("source_path string!,target_path string!").fields)
#: The full-text index of nodes: places of terms; blocks of postings with what bounds their scores; how many documents have a
#: term, and documents and tokens in all, as differences that are summed.
POSTING = _fields("term string!,id string!,places long[],length long!,block long!")
BLOCK = _fields("term string!,block long!,n long!,most int!,shortest long!")
TERM = _fields("term string!,n long!")
TOTAL = _fields("docs long!,tokens long!")
TABLES = {
    "nodes": NODE, "edges": SITED_EDGE, "files": FILE, "directories": DIRECTORY, "meta": META, "lines": LINE, "mentions": MENTION, "names": NAME, "postings": POSTING, "blocks": BLOCK, "terms": TERM,
    "totals": TOTAL,
}
KEYS = {"nodes": ["id"], "edges": ["source_id", "target_id", "edge_type", "call_site_line"], "files": ["path"], "directories": ["dir_path"], "meta": ["key"], "lines": ["file_path", "line_no"], "postings": ["term", "id"]}
#: Columns by whose values older rows are ended when a commit replaces or removes what they belong to.
OWNERS = {"nodes": ("file_path",), "edges": ("source_path", "target_path"), "files": ("path",), "directories": ("dir_path",), "meta": ("key",), "lines": ("file_path",), "mentions": ("file_path",), "names": ("target_path",), "postings": ("id",)}


def violations(table: DataFrame, name: str) -> DataFrame:
    """Rows that break the table's checks, with ``problem``: nulls, unknown kinds, keys that aren't unique."""
    schema = EDGE if name == "edges" else TABLES[name]
    checks = [F.when(F.col(f.name).isNull(), f"{f.name} is null") for f in schema.fields if not f.nullable]
    if name == "nodes":
        checks += [F.when(~F.col("node_type").isin(*NODE_TYPES), "node_type"), F.when(F.col("end_line") < F.col("start_line"), "lines")]
    if name == "edges":
        checks += [F.when(~F.col("edge_type").isin(*EDGE_TYPES), "edge_type")]
    bad = table.withColumn("problem", F.coalesce(*checks, F.lit(None).cast("string"))).where(F.col("problem").isNotNull())
    twice = table.groupBy(*KEYS[name]).count().where("count > 1").select(*KEYS[name])
    return bad.unionByName(table.join(twice, KEYS[name], "left_semi").withColumn("problem", F.lit("key")))


def cascade(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends exist."""
    ids = nodes.select("id")
    return edges.join(ids, edges["source_id"] == ids["id"], "left_semi").join(ids, edges["target_id"] == ids["id"], "left_semi")
