"""A training corpus from raw documents, stage by stage.

Each stage takes (spark, docs, sf_dir), docs being what the stage before kept, and
returns a DataFrame; ``run`` writes each as Parquet to the shared folder and reads
it again for the next.  All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import decontamination, language, mixing, set_join, sharding
from lodegrid.llm.hot import by_key
from lodegrid.llm.scratch import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHARDS = 24


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents of one known language; ``lang`` becomes what the text is found to be.

    The model learns from all labelled documents.  Rejected are texts without a letter and
    those of which no language makes up half.  Null, empty and blank texts are rejected; null
    lang or id is no reason to be; very long texts are taken whole; repeated rows go or stay together;
    without any label, or of an empty table, nothing is left; other columns are dropped.
    """
    model = language.fit(docs)
    found = language.confident(language.predict(docs, model))
    return found.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each group that links at a Jaccard similarity of 0.8 over 5-word shingles.

    Of repeated rows (equal id and text) one stays.  Rows whose id is null or repeated go by their own sets;
    of a group of null ids alone one stays.  Null, empty and blank texts are like nothing and stay; very long
    texts are compared whole; an empty table gives an empty one; other columns are dropped.
    """
    scratch = Scratch(spark, "pipeline")
    rule = set_join.Rule(k=5, percent=80)
    classes = scratch.table(set_join.classes(docs, rule, named=True), "classes")
    gone = classes.where(F.col("component_id") < F.col("doc_id")).select("doc_id").distinct()
    repeated = scratch.table(classes.groupBy("doc_id").count().where("count > 1 OR doc_id IS NULL").select("doc_id"), "repeated")
    kept = _without(docs, scratch.table(gone, "duplicates"))
    if not repeated.isEmpty():
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "check")).alias("kept")
        full = classes.where("n_shingles > 0").select("doc_id", "component", "check")
        firsts = full.groupBy("component").agg(first, F.count(F.lit(1)).alias("key_rows"))
        other = by_key(full, firsts, "component", classes.count()).where(~(F.col("doc_id").eqNullSafe(F.col("kept.doc_id")) & (F.col("check") == F.col("kept.check"))))
        other = other.select(F.col("doc_id").alias("gone_id"), F.col("check").alias("gone_check")).distinct()
        again = docs.join(repeated, docs["doc_id"].eqNullSafe(repeated["doc_id"]), "left_semi").select(*COLUMNS)
        again = set_join.named_sets(again, rule).join(other, F.col("doc_id").eqNullSafe(F.col("gone_id")) & (F.col("check") == F.col("gone_check")), "left_anti").select(*COLUMNS)
        kept = kept.join(repeated, kept["doc_id"].eqNullSafe(repeated["doc_id"]), "left_anti").select(*COLUMNS).unionByName(again.dropDuplicates(["doc_id", "text"]))
    return kept.select(*COLUMNS)


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Documents without those ids: some 8 bytes each, broadcast while they are few, else joined by shuffle."""
    few = ids.count() <= set_join.BROADCAST_SETS
    return docs.join(F.broadcast(ids) if few else ids, "doc_id", "left_anti")


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that hold no window of a benchmark item.

    Null and empty texts hold none and stay; a very long text is searched whole; repeated rows and null ids are
    rows as any; an empty benchmark drops nothing; an empty table gives an empty one; other columns are dropped.
    """
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat or leave out documents so that sources meet their targets; clean prose is drawn first.

    Documents without a word (null, empty, blank) have no size and are left out; null is a source of its own;
    ties and repeated rows (equal keys) go or stay together; a very long text may end a source's budget alone;
    an empty table gives an empty one; other columns are dropped.
    """
    odd = F.expr(r"regexp_count(text, '[^\\p{L}\\x20\\x0A.,]') / greatest(length(text), 1)")
    mix = mixing.mix(docs, F.when(odd <= 0.1, 2.0).otherwise(0.5))
    return mixing.repeat(mix, COLUMNS)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard and its slot there.

    Rows of one id share a shard, null ids too; repeated rows have slots of their own; null and very long texts
    are rows as any; an empty table gives an empty one; other columns are dropped.
    """
    return sharding.shard(docs.select(*COLUMNS), SHARDS, order=["text"])


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("decontamination", decontaminated), ("mixing", mixed), ("sharding", sharded)]

#: Language identification isn't expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sharded corpus of the documents in ``sf_dir``."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name)
    return docs
