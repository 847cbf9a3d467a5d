"""The registered queries: each applies one operator, with production parameters, to its whole table."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import audit, chat, decontamination, language, language_model, minhash, mixing, periods, pieces, secrets, set_join, sharding, token_files
from lodegrid.llm.arrow import id_crc
from lodegrid.llm.scratch import Scratch


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", mixing.n_words().alias("mix_size"))
    weighed = mixing.label_weight(docs, read(spark, sf_dir, "labels"))
    mixed = mixing.mix(weighed, F.col("mix_weight"), narrow=True)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    slim = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("bigint").alias("size"), sharding.text_crc32().alias("text_crc32"))
    rows = sharding.shard(slim, 24, order=["text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.range(2).select(
        F.lit(-7).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.element_at(F.array(F.lit("user"), F.lit("assistant")), F.col("id").cast("int") + 1).alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    scratch = Scratch(spark, "chat")
    pages = scratch.table(chat.format_conversations(turns), "pages")
    return chat.read_back(pages, scratch.table(chat.examples(pages), "examples"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark").select("item_id", "text")
    found = decontamination.match(docs, items, near=1)
    joined = F.array_join(F.array_sort("match_items"), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("match_items").cast("bigint").alias("n_items"), F.sha2(joined, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
        F.size("near_items").cast("bigint").alias("n_near_items"),
    )


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.with_classes(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op6_set_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return set_join.classes(read(spark, sf_dir, "documents"), set_join.Rule(k=3, percent=90))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(id_crc(4) != 2).select("doc_id", "text", "lang"))
    rows = language.predict(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (id_crc(4) == 2).alias("held_out"), "lang_pred", "score", "lang_set")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(read(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] < 3)
    of = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")
    return found.select(
        "doc_id", of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"), F.sha2(secrets.joined(base), 256).alias("base_sha256"),
        secrets.joined(F.col("secrets")).alias("spans"), of(3).alias("n_random"),
    )


def op3_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = id_crc(7) == 2
    rows = language_model.score(docs.withColumn("held_out", held_out), docs.where(~held_out))
    return rows.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def looped(batch: pa.RecordBatch, counts: np.ndarray) -> np.ndarray:
    """The order of the words of texts: one in ten, by its id, repeats a stretch from some word on; a null id counts as the empty text."""
    first = np.cumsum(counts) - counts
    order = np.arange(counts.sum()) - np.repeat(first, counts)
    for at, n, doc_id in zip(first.tolist(), counts.tolist(), batch.column("doc_id").to_pylist(), strict=True):
        h = zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            order[at + a : at + n] = a + np.arange(n - a) % (1 + (n - a) // (3 + g % 8))
    return order


def op11_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periods.find(read(spark, sf_dir, "documents").select("doc_id", "text"), rewrite=looped)
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    told = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    rows = found.select("doc_id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(told, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    length, period = F.col("best.length"), -F.col("best.period")
    return rows.select(
        "doc_id", "n_runs", (-F.col("best.start")).alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"),
        "runs_sha256", "collapsed_sha256",
    )


def op12_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pieces.digests(read(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("piece_bpe_32k.model"))


def op13_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))
