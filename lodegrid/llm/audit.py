"""Filter interaction audit: what each of some filters removes, in every order of applying them.

Whether a document fails a filter doesn't depend on the order, so its failures are one
number of five bits, and where an order removes it is a look-up: ``first_failure`` holds, for
each of the 32 sets of failed filters and each of the 120 orders, the first step that fails.
Tasks add up removals by part, order, step and label (``np.bincount``), and Spark sums
their partial arrays; kept, redundant and alone-failing documents and the filters' shares
over all orders follow from the sums.

The filters: A too few words; B too few distinct words; C too many capitals; D a mark of code
or tables; E equal to the text of a smaller id, of the whole table.  E is decided by groups of equal
(digest, part, labels), never by rows of one text in one task: of each text all rows fail
but those of its least id.

Defined cases: null text is empty, and equals empty texts; null source is the part '';
a null id is no smaller id of any text, has none, and no labels; rows of one id and text
(repeated rows) count as many, and don't fail E for one another; of several labels of an id each 1 counts;
very long texts are taken whole; empty tables give an empty report; other columns are ignored.
Texts are told apart by 128-bit digests, words by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodegrid.llm import words as W
from lodegrid.llm.arrow import map_arrow

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
STEPS, LABELS, MASKS = len(FILTERS), 4, 1 << len(FILTERS)
#: Sums of one part: by order, step (the last: kept) and label, then by set of failed filters.
REMOVALS = len(ORDERS) * (STEPS + 1) * LABELS
SLOTS = REMOVALS + MASKS
#: Parts whose sums a task holds at a time, some 23 kB each.
PARTS_HELD = 500


@dataclass(frozen=True)
class Limits:
    """When a text fails filters A to D."""

    least_words: int = 50
    distinct_percent: int = 65
    capital_percent: int = 5
    marks: bytes = b"#$%&*|"


def first_failure() -> np.ndarray:
    """For each set of failed filters (bit n: filter n) and each order the number of the step that removes; ``STEPS``: none does."""
    fails = (np.arange(MASKS)[:, None] >> np.arange(STEPS)) & 1
    order = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])
    at = fails[:, order].astype(bool)
    return np.where(at.any(2), at.argmax(2), STEPS)


def _counted(texts: W.Texts, kind: np.ndarray) -> np.ndarray:
    """Bytes of a kind in each text."""
    upto = np.concatenate(([0], np.cumsum(kind[texts.data], dtype=np.int64)))
    return upto[texts.offsets[1:]] - upto[texts.offsets[:-1]]


def _kind(values) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(values)] = True
    return out


def fails_text(texts: W.Texts, limits: Limits) -> np.ndarray:
    """Filters A to D of each text, as bits."""
    split = W.split(texts, lower=False)
    _, distinct = W.distinct(split.hashes(), split.counts)
    chars = _counted(texts, ~_kind(range(0x80, 0xC0)))
    a = split.counts < limits.least_words
    b = 100 * distinct < limits.distinct_percent * split.counts
    c = 100 * _counted(texts, _kind(range(65, 91))) > limits.capital_percent * chars
    d = _counted(texts, _kind(limits.marks)) > 0
    return a + 2 * b + 4 * c + 8 * d


def failures(docs: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(doc_id, part, mask, digest): filters A to D of documents (doc_id, text, source), and a digest of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for texts in W.slices(batch.column("text")):
                cuts = texts.offsets.tolist()
                digests = [hashlib.blake2b(texts.data[a:b], digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                own = batch.slice(texts.first, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [own.column("doc_id"), own.column("part"), pa.array(fails_text(texts, limits), pa.int32()), pa.array(digests, pa.binary())], names=["doc_id", "part", "mask", "digest"]
                )

    slim = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), "text")
    return map_arrow(slim, run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, part string, mask int, digest binary")


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with ``label``: 1 for good ones (quality 1), 2 for toxic ones, 3 for both; ids that are null are spread."""
    one = lambda c: F.max(F.coalesce((F.col(c) == 1).cast("int"), F.lit(0)))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("label_id")).agg((one("quality") + 2 * one("toxic")).alias("label")).where("label > 0")
    spread = F.coalesce(F.col("doc_id").cast("bigint"), F.xxhash64("digest"))
    found = rows.withColumn("at", spread).join(known, (F.col("at") == F.col("label_id")) & F.col("doc_id").isNotNull(), "left")
    return found.select(*rows.columns, F.coalesce("label", F.lit(0)).alias("label"))


def with_copies(rows: DataFrame) -> DataFrame:
    """(part, label, mask, n) with filter E, from rows (doc_id, part, mask, digest, label, n)."""
    known = F.col("doc_id").isNotNull()
    groups = rows.groupBy("digest", "part", "label", "mask").agg(
        F.sum("n").alias("n"), F.min(F.when(known, F.struct("doc_id", "n"))).alias("first"), F.sum(F.when(known, 0).otherwise(F.col("n"))).alias("unnamed")
    )
    # A text has at most one row here for each part and label.
    least = groups.withColumn("least", F.min("first.doc_id").over(Window.partitionBy("digest")))
    fine = F.col("unnamed") + F.when(F.col("first.doc_id") == F.col("least"), F.col("first.n")).otherwise(0)
    both = F.array(F.struct(F.col("mask"), fine.alias("n")), F.struct((F.col("mask") + 16).alias("mask"), (F.col("n") - fine).alias("n")))
    return least.select("part", "label", F.inline(both)).where("n > 0")


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, order = first_failure(), np.arange(len(ORDERS))
    held: dict[str, np.ndarray] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for part, sums in held.items():
            slots = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(slots), pa.string()), pa.array(slots, pa.int32()), pa.array(sums[slots])], names=["part", "slot", "n"])
        held.clear()

    for whole in batches:
        for at in range(0, whole.num_rows, 4096):
            batch = whole.slice(at, 4096)
            coded = batch.column("part").dictionary_encode()
            parts, part = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            mask, label, n = (batch.column(c).to_numpy() for c in ("mask", "label", "n"))
            slot = (order * (STEPS + 1) + table[mask]) * LABELS + label[:, None]
            removed = np.bincount((part[:, None] * REMOVALS + slot).ravel(), np.repeat(n, len(ORDERS)), len(parts) * REMOVALS)
            masks = np.bincount(part * MASKS + mask, n, len(parts) * MASKS)
            sums = np.hstack([removed.reshape(-1, REMOVALS), masks.reshape(-1, MASKS)]).astype(np.int64)
            for p, own in zip(parts, sums, strict=True):
                held[p] = held[p] + own if p in held else own
            if len(held) > PARTS_HELD:
                yield from out()
    yield from out()


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    order = np.array([[FILTERS.index(x) for x in o] for o in ORDERS])
    for batch in batches:
        for row in batch.to_pylist():
            sums = np.zeros(SLOTS, np.int64)
            sums[[x["slot"] for x in row["sums"]]] = [x["n"] for x in row["sums"]]
            by_label, masks = sums[:REMOVALS].reshape(len(ORDERS), STEPS + 1, LABELS)[:, :STEPS], sums[REMOVALS:]
            removed = by_label.sum(2)
            fails = np.array([masks[(np.arange(MASKS) >> f) & 1 == 1].sum() for f in range(STEPS)])
            shares = np.bincount(order.ravel(), removed.ravel(), STEPS).astype(np.int64)
            columns = {
                "kept": masks.sum() - np.cumsum(removed, 1), "removed": removed, "redundant": fails[order] - removed, "unique_fails": masks[1 << order],
                "good_lost": by_label[..., 1] + by_label[..., 3], "toxic_lost": by_label[..., 2] + by_label[..., 3], "shapley": shares[order],
            }
            named = [pa.array([row["part"]] * order.size, pa.string()), pa.array(np.repeat(ORDERS, STEPS).tolist(), pa.string()), pa.array(np.tile(np.arange(1, STEPS + 1), len(ORDERS)), pa.int32())]
            yield pa.RecordBatch.from_arrays(named + [pa.array(c.ravel(), pa.int64()) for c in columns.values()], names=["part", "filter_order", "step", *columns])


def report(counted: DataFrame) -> DataFrame:
    """One row for each part, order and step, from (part, label, mask, n)."""
    summed = map_arrow(counted, _sums, "part string, slot int, n bigint").groupBy("part", "slot").agg(F.sum("n").alias("n"))
    parts = summed.groupBy("part").agg(F.collect_list(F.struct("slot", "n")).alias("sums"))  # at most SLOTS each
    counts = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    return map_arrow(parts, _report, "part string, filter_order string, step int, " + ", ".join(f"{c} bigint" for c in counts))


def audit(docs: DataFrame, labels: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """The report of documents (doc_id, text, source) and labels (doc_id, quality, toxic)."""
    rows = failures(docs, limits).groupBy("doc_id", "digest", "part", "mask").agg(F.count(F.lit(1)).alias("n"))
    counted = with_copies(labelled(rows, labels)).groupBy("part", "label", "mask").agg(F.sum("n").alias("n"))
    return report(counted)
