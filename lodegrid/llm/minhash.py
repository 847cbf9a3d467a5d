"""Document fingerprints: MinHash signatures in numpy, with near-duplicates by bands.

``PERMUTATIONS`` universal hash functions h -> a h + b (mod 2^32, a odd) of the
hashed word shingles keep their minima; a fingerprint is the low byte of each, in
hexadecimal.  The share of equal bytes, less what chance gives, estimates the
Jaccard similarity of the shingle sets.

``near_duplicates`` cuts signatures into bands, groups documents that share a band
in Spark, verifies the exact Jaccard similarity and returns classes; see
``set_join`` for how groups of any size are worked through.

Neighbours: a document is compared with an edited text made of it and its
successor by id.  Ids are cut into ranges (``RANGE_ROWS``, ``RANGES``); each range is
sorted by itself and gets the first document of the next one as a guest.  Texts go to
their ranges compressed, so that the shuffle holds less than the input does.

Defined cases: null text is empty; a text without words has no shingle and the
fingerprint of the empty set (all bytes ff), equal to itself alone; one of fewer
words than a shingle has its whole sequence as one; equal ids (repeated rows) follow
one another by a hash of their texts; a lone document is its own successor; very long texts
are taken whole; an empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.llm import set_join
from lodegrid.llm import words as W
from lodegrid.llm.arrow import map_arrow
from lodegrid.llm.scratch import Scratch

SHINGLE = 5
PERMUTATIONS = 128
RANGE_ROWS = 4_096
#: Ranges at most: beyond that they grow, as they are read as streams. The driver gets the first id of each.
RANGES = 50_000
#: Odds that two sets which link share no band: 32 bands of 4 minima have 5 in 10^8 at a similarity of 0.8.
MISSED = 1e-6
_RANDOM = np.random.default_rng(128)
_A = _RANDOM.integers(0, 1 << 31, PERMUTATIONS, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_B = _RANDOM.integers(0, 1 << 32, PERMUTATIONS, dtype=np.uint32)


def signatures(column: pa.Array, k: int = SHINGLE) -> np.ndarray:
    """MinHash signatures of texts: a row of PERMUTATIONS 32-bit minima for each."""
    out = np.full((len(column), PERMUTATIONS), 0xFFFFFFFF, np.uint32)
    for texts in W.slices(column):
        split = W.split(texts)
        shingled, counts = W.shingles(split.hashes(), split.counts, k)
        full = np.flatnonzero(counts)
        if not len(full):
            continue
        values = (shingled >> np.uint64(32)).astype(np.uint32)
        first = (np.cumsum(counts) - counts)[full]
        moved = np.empty_like(values)
        for i in range(PERMUTATIONS):
            np.multiply(values, _A[i], out=moved)
            moved += _B[i]
            out[texts.first + full, i] = np.minimum.reduceat(moved, first)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of rows of fingerprint bytes, 0 to 1."""
    equal = (a == b).mean(axis=1)
    return np.clip((equal - 1 / 256) / (1 - 1 / 256), 0.0, 1.0)


def fingerprint_bytes(signature: np.ndarray) -> np.ndarray:
    return (signature & np.uint32(0xFF)).astype(np.uint8)


def bands_of(percent: int) -> int:
    """Bands into which signatures are cut: the fewest, a power of 2, by which two sets of that similarity share none with odds below MISSED."""
    n = 1
    while n < PERMUTATIONS and (1 - (percent / 100) ** (PERMUTATIONS // n)) ** n > MISSED:
        n *= 2
    return n


def _banded(rule: set_join.Rule, shared: np.ndarray):
    n = bands_of(rule.percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for names, _, counts, rows, which in set_join.fresh_sets(batches, rule, shared):
            full = counts > 0
            minima = signatures(rows.column("text").take(pa.array(which[full])), rule.k).reshape(int(full.sum()), n, PERMUTATIONS // n).astype(np.uint64)
            bands = np.tile(W.mix64(np.arange(n, dtype=np.uint64) + np.uint64(1)), (len(minima), 1))
            for j in range(minima.shape[2]):
                bands = W.mix64(bands ^ minima[:, :, j])
            yield pa.RecordBatch.from_arrays([pa.array(bands.ravel().view(np.int64)), pa.array(np.repeat(names[full], n))], names=["signature", "set"])

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, k: int = SHINGLE, named: bool = False) -> DataFrame:
    """(doc_id, n_shingles, component_id): classes of documents that share a band and whose exact similarity reaches ``percent``.

    Raises ValueError below a similarity at which even single minima would miss too many.
    """
    if (1 - percent / 100) ** PERMUTATIONS > MISSED:
        raise ValueError(f"{PERMUTATIONS} permutations are too few for a similarity of {percent} %")
    rule, scratch = set_join.Rule(k, percent), Scratch(docs.sparkSession, "minhash")
    docs = docs.select("doc_id", "text")
    sets, shared = set_join.described(docs, rule, scratch)
    scratch.release()
    bands = map_arrow(docs.select("text"), _banded(rule, shared), "signature bigint, set bigint")
    return set_join.joined(docs, sets, shared, bands, rule, scratch, named)


def _placed(splits: list[int], firsts: list[tuple[int, int]]):
    """Give rows their range; the first ids of ranges go to the range before as guests as well."""
    bounds = np.array(splits, np.int64)
    guests = {i: r for i, r in firsts}
    wrap = firsts[0][0] if firsts else None
    schema = pa.schema([("range", pa.int64()), ("guest", pa.int8()), ("doc_id", pa.int64()), ("tie", pa.int64()), ("packed", pa.binary())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            ids = batch.column("doc_id").cast(pa.int64()).fill_null(-(2**63)).to_numpy(zero_copy_only=False)
            ranges = np.searchsorted(bounds, ids, "right")
            own = np.flatnonzero(np.isin(ids, np.fromiter(guests, np.int64, len(guests))))
            rows = np.concatenate([np.arange(len(ids)), own])
            guest = np.concatenate([np.zeros(len(ids), np.int8), np.array([1 + (ids[i] == wrap) for i in own], np.int8)])
            ranges = np.concatenate([ranges, np.array([guests[ids[i]] for i in own], np.int64)])
            packed = pa.array([None if x is None else pack(x) for x in batch.column("text").cast(pa.binary()).to_pylist()], pa.binary())
            # A guest's text stands twice, so rows go on by hundreds, not as one batch of two copies.
            for at in range(0, len(rows), 512):
                part = pa.array(rows[at : at + 512])
                columns = [ranges[at : at + 512].astype(np.int64), guest[at : at + 512], batch.column("doc_id").cast(pa.int64()).take(part), batch.column("tie").take(part), packed.take(part)]
                yield pa.RecordBatch.from_arrays([pa.array(c) if isinstance(c, np.ndarray) else c for c in columns], schema=schema)

    return place


def _hex(rows: np.ndarray) -> list[str]:
    text = rows.tobytes().hex()
    n = 2 * rows.shape[1]
    return [text[i : i + n] for i in range(0, len(text), n)]


def _compared(k: int):
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = None  # the last row seen, which waits for its successor
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = pa.array([None if x is None else unpack(x) for x in part.column("packed").to_pylist()], pa.binary()).cast(pa.string())
                part = pa.RecordBatch.from_arrays([*(part.column(c) for c in ("range", "guest", "doc_id")), texts], names=["range", "guest", "doc_id", "text"])
                rows = pa.Table.from_batches([part] if kept is None else [kept, part]).combine_chunks()
                kept = rows.slice(rows.num_rows - 1).to_batches()[0]
                if rows.num_rows > 1:
                    yield from _pairs(rows, k)

    return compare


def _pairs(rows: pa.Table, k: int) -> Iterator[pa.RecordBatch]:
    ranges, guest = rows["range"].to_numpy(), rows["guest"].to_numpy()
    own = np.flatnonzero((guest[:-1] == 0) & (ranges[:-1] == ranges[1:]))
    if not len(own):
        return
    texts = [x or "" for x in rows["text"].to_pylist()]
    edited = []
    for i in own.tolist():
        n = len(texts[i]) // 4
        edited.append(texts[i][: len(texts[i]) - n] + texts[i + 1][:n])
    plain = fingerprint_bytes(signatures(rows["text"], k))
    other = fingerprint_bytes(signatures(pa.array(edited), k))
    check = np.concatenate([set_join.checks(*set_join.token_sets(part, k)) for part in W.slices(rows["text"])])[own]
    yield pa.RecordBatch.from_arrays(
        [
            rows["doc_id"].combine_chunks().take(pa.array(own)), pa.array([len(texts[i]) for i in own.tolist()], pa.int64()),
            pa.array([hashlib.sha256(x.encode()).hexdigest() for x in edited]), pa.array([x.tobytes() for x in plain[own]], pa.binary()), pa.array([x.tobytes() for x in other], pa.binary()),
            pa.array(likeness(plain[own], other)), pa.array(likeness(plain[own], plain[own + 1])), pa.array(check),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "check"],
    )


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """doc_id and fingerprint (as hexadecimal) of documents (doc_id, text)."""
    schema = docs.select("doc_id", F.lit("").alias("fingerprint")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_hex(fingerprint_bytes(signatures(batch.column("text"), k))), pa.string())], names=["doc_id", "fingerprint"])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def against_edits(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """Fingerprints of documents, of their edited texts, their likeness to those and to the next document's, and ``check``, the digest of their shingles; fingerprints as bytes."""
    ids = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(2**63)).cast("bigint")).alias("doc_id"))
    ranged = ids.repartitionByRange(min(RANGES, max(1, -(-ids.count() // RANGE_ROWS))), "doc_id").groupBy(F.spark_partition_id().alias("p")).agg(F.min("doc_id").alias("first"))
    firsts = sorted(r["first"] for r in ranged.select("first").collect())
    guests = [(x, i - 1 if i else len(firsts) - 1) for i, x in enumerate(firsts)]
    placed = map_arrow(docs.select("doc_id", "text", F.xxhash64("text").alias("tie")), _placed(firsts[1:], guests), "range bigint, guest tinyint, doc_id bigint, tie bigint, packed binary")
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, len(firsts))
    ordered = placed.repartition(tasks, "range").sortWithinPartitions("range", "guest", "doc_id", "tie")
    schema = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, check bigint"
    return map_arrow(ordered, _compared(k), schema)


def in_hex(compared: DataFrame) -> DataFrame:
    """Fingerprints as hexadecimal text."""
    return compared.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


def with_classes(docs: DataFrame, percent: int = 80, k: int = SHINGLE) -> DataFrame:
    """``against_edits``, and for each row near_class, the least doc_id of its class of ``near_duplicates``."""
    scratch = Scratch(docs.sparkSession, "fingerprints")
    compared = scratch.table(against_edits(docs, k), "compared")
    scratch.release()
    found = near_duplicates(docs, percent, k, named=True)
    scratch.release()
    # The class depends on the id and the shingles alone, so repeated rows are one here.
    found = found.select(F.col("doc_id").cast("bigint").alias("class_id"), F.col("check").alias("class_check"), F.col("component_id").alias("near_class")).distinct()
    joined = compared.join(scratch.table(found, "classes"), F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("check") == F.col("class_check")), "left")
    return in_hex(joined.drop("class_id", "class_check", "check"))
