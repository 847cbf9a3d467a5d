"""Token ids in flat binary files.

Format, for each part of the documents in ascending order of their ids:

* ``<part>.ids``: token ids, little-endian unsigned integers of 16 bits where the
  vocabulary has at most 65,536 ids, else of 32;
* ``<part>.off``: one unsigned 64-bit offset for each document, in tokens from
  the start of the part, and the part's number of tokens at the end;
* ``<part>.doc``: the documents' ids, signed 64 bit (the least one stands for null).

The manifest (one row for each part: file, documents, tokens) gives a part its
base, the prefix sum of the tokens before it.  Readers map the files into memory.

Executors write where all of them and the driver can read, under a name of the
task's attempt that is renamed when it is whole; the manifest names the attempts
that ended well, so a task that is run again or twice leaves no trace.

For a vocabulary that is seen to be word-level (``cuttable``) texts are cut where no
token spans the cut (``pieces``), and a worker encodes each distinct piece, told apart
by its bytes, once while it remembers it (``CACHE_PIECES``).  For other vocabularies
whole texts are encoded.

Defined cases: null and empty texts have the end id alone; equal ids (repeated
rows) follow one another, ordered by a hash of their texts; an empty table makes
no files and an empty result; a very long text is one text all the same; other columns of
the documents are not stored.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodegrid.llm import words as W
from lodegrid.llm.arrow import map_arrow
from lodegrid.llm.scratch import Scratch

#: Distinct pieces of text that a worker remembers.
CACHE_PIECES = 300_000
NULL_ID = -(2**63)
# How a word-level vocabulary whose texts may be cut prepares them.
CUTTABLE_STEPS = ["NFC", "Replace", "Lowercase"]
CUTTABLE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _is_local(path: str) -> bool:
    return urlsplit(path).scheme in ("", "file")


class Writer:
    """A file in the shared folder, there under its name only once it is closed well."""

    def __init__(self, path: str):
        if _is_local(path):
            self.final = urlsplit(path).path
            os.makedirs(os.path.dirname(self.final), exist_ok=True)
            self.file = open(f"{self.final}.part", "wb")  # noqa: SIM115
        else:
            from pyarrow import fs

            store, at = fs.FileSystem.from_uri(path)
            self.final, self.file = None, store.open_output_stream(at)

    def write(self, array: np.ndarray) -> None:
        self.file.write(array.tobytes())

    def close(self) -> None:
        self.file.close()
        if self.final:
            os.replace(f"{self.final}.part", self.final)


def mapped(path: str, dtype: str) -> np.ndarray:
    """A file of the shared folder as an array, mapped into memory where the folder is mounted."""
    if _is_local(path):
        at = urlsplit(path).path
        return np.memmap(at, dtype, "r") if os.path.getsize(at) else np.empty(0, dtype)
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    with store.open_input_file(at) as f:
        return np.frombuffer(f.read(), dtype)


_LETTER = np.zeros(256, bool)
_LETTER[0x61:0x7B] = True
_MARK = np.zeros(256, bool)
_MARK[0x21:0x30] = _MARK[0x3A:0x41] = _MARK[0x5B:0x61] = _MARK[0x7B:0x7F] = True


def pieces(texts: W.Texts) -> W.Words:
    """Words in lower case, cut as well where an ASCII mark follows an ASCII letter.

    Word-level vocabularies end a token there in any case, and lower-case A-Z.  Where
    a text may hold the string of a special token, words are kept whole and as they are.
    """
    if b"<|" in texts.data.tobytes():
        return W.split(texts, lower=False)
    split = W.split(texts)
    cut = np.flatnonzero(_LETTER[split.lowered[:-1]] & _MARK[split.lowered[1:]]) + 1
    border = np.zeros(len(split.lowered) + 1, bool)
    border[split.starts] = border[cut] = True
    starts = np.flatnonzero(border)
    border[:] = False
    border[split.ends] = border[cut] = True
    ends = np.flatnonzero(border)
    return W.Words(starts, ends, np.diff(np.searchsorted(starts, texts.offsets)), split.lowered)


def cuttable(tokenizer: str) -> bool:
    """If the vocabulary's own description says that its tokens end where ``pieces`` cuts."""
    with open(tokenizer, encoding="utf-8") as f:
        described = json.load(f)
    steps = [x.get("type") for x in (described.get("normalizer") or {}).get("normalizers", [])]
    first = next(iter((described.get("pre_tokenizer") or {}).get("pretokenizers", [])), {})
    plain = not any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or not t["content"].startswith("<|") for t in described.get("added_tokens", []))
    return plain and steps == CUTTABLE_STEPS and first.get("pattern") == {"Regex": CUTTABLE_PATTERN} and first.get("behavior") == "Removed" and first.get("invert") is True


class Encoder:
    """Encodes texts by their distinct pieces."""

    def __init__(self, tokenizer: str, end_id: int, cut: bool | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.end_id, self.cut = Tokenizer.from_file(tokenizer), end_id, cuttable(tokenizer) if cut is None else cut
        self.wide = self.tokenizer.get_vocab_size(True) > 1 << 16 or end_id >= 1 << 16
        special = [(t.content, i) for i, t in sorted(self.tokenizer.get_added_tokens_decoder().items()) if t.special]
        self.between = special[0] if special else None
        self.known: dict[str, int] = {}
        self.flat = np.array([end_id], np.uint32)
        self.first = np.array([0, 1], np.int64)
        self.used = np.array([2], np.int64)

    def forget(self) -> None:
        """Keep the pieces that several slices had: most are of one text alone."""
        kept = np.flatnonzero(self.used > 1)
        kept = kept if len(kept) <= CACHE_PIECES // 2 else kept[:1]
        n = (self.first[1:] - self.first[:-1])[kept]
        upto = np.cumsum(n)
        self.flat = self.flat[np.repeat(self.first[kept] - (upto - n), n) + np.arange(upto[-1])]
        self.first = np.concatenate(([0], upto))
        number = dict(zip(kept.tolist(), range(len(kept)), strict=True))
        self.known = {x: number[i] for x, i in self.known.items() if i in number}
        self.used = np.minimum(self.used[kept], 1)
        self.used[0] = 2

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        run = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(e.ids, np.uint32) for e in run(texts, add_special_tokens=False)]

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after another, and how many each has."""
        mark, mark_id = self.between or ("", -1)
        if not mark or any(mark in x for x in texts):
            ids = self.encode(texts)
            return np.concatenate(ids), np.array([len(x) for x in ids])
        # A special token between pieces keeps them apart and shows where each ends.
        ids = self.encode([mark.join(texts[i : i + 100]) + mark for i in range(0, len(texts), 100)])
        ids = np.concatenate(ids)
        ends = np.flatnonzero(ids == mark_id)
        return ids[ids != mark_id], np.diff(np.concatenate(([-1], ends))) - 1

    def __call__(self, texts: W.Texts, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with their end ids, and how many each text has."""
        if not self.cut:
            own = self.encode([x or "" for x in column.to_pylist()])
            end = np.array([self.end_id], np.uint32)
            return np.concatenate([x for e in own for x in (e, end)]), np.array([len(e) + 1 for e in own])
        split = pieces(texts)
        coded = split.strings().dictionary_encode()
        names, inverse = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.known) + len(names) > CACHE_PIECES:
            self.forget()
        fresh = [x for x in names if x not in self.known]
        if fresh:
            ids, lengths = self.encode_pieces(fresh)
            n = len(self.first) - 1
            self.known.update(zip(fresh, range(n, n + len(fresh)), strict=True))
            self.flat = np.concatenate([self.flat, ids])
            self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(lengths)])
            self.used = np.concatenate([self.used, np.zeros(len(fresh), np.int64)])
        of = np.fromiter(map(self.known.__getitem__, names), np.int64, len(names))
        self.used[of] += 1
        entry = np.insert(of[inverse], np.cumsum(split.counts), 0)  # 0 is the end id
        start, n = self.first[entry], self.first[entry + 1] - self.first[entry]
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(start - (upto - n), n) + np.arange(upto[-1])]
        last = np.cumsum(split.counts + 1) - 1
        return ids, np.diff(np.concatenate(([0], upto[last])))


_encoders: dict[tuple, Encoder] = {}


def _encoder(tokenizer: str, end_id: int, cut: bool | None) -> Encoder:
    """The worker's encoder, kept from task to task."""
    key = (tokenizer, end_id, cut)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(*key)
    return _encoders[key]


def _write(folder: str, tokenizer: str, end_id: int, cut: bool | None):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name = f"{folder}/part-{context.partitionId():06d}-{context.taskAttemptId()}"
        encoder = files = None
        tokens = docs = 0
        for batch in batches:
            if encoder is None and batch.num_rows:
                encoder = _encoder(tokenizer, end_id, cut)
                files = [Writer(f"{name}.{x}") for x in ("ids", "off", "doc")]
            column, ids_of = batch.column("text"), batch.column("doc_id").cast(pa.int64()).fill_null(NULL_ID).to_numpy()
            for texts in W.slices(column):
                ids, counts = encoder(texts, column.slice(texts.first, len(texts)))
                files[0].write(ids.astype("<u4" if encoder.wide else "<u2"))
                files[1].write((tokens + np.cumsum(counts) - counts).astype("<u8"))
                files[2].write(ids_of[texts.first : texts.first + len(texts)].astype("<i8"))
                tokens, docs = tokens + len(ids), docs + len(texts)
        if files:
            files[1].write(np.array([tokens], "<u8"))
            for f in files:
                f.close()
            yield pa.RecordBatch.from_pydict({"part": [context.partitionId()], "file": [name], "docs": [docs], "tokens": [tokens], "width": [4 if encoder.wide else 2]})

    return write


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, cut: bool | None = None) -> list[dict]:
    """Write token files of documents (doc_id, text); the manifest, in order, with each part's base."""
    ordered = docs.select("doc_id", "text").orderBy("doc_id", F.xxhash64("text"))
    written = map_arrow(ordered, _write(folder, tokenizer, end_id, cut), "part bigint, file string, docs bigint, tokens bigint, width bigint")
    manifest, base = [], 0
    for row in sorted(written.collect(), key=lambda r: r["part"]):  # one row for each partition
        manifest.append(row.asDict() | {"base": base})
        base += row["tokens"]
    return manifest


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in batch.to_pylist():
            ids = mapped(f"{part['file']}.ids", f"<u{part['width']}")
            off = mapped(f"{part['file']}.off", "<u8").astype(np.int64)
            doc = mapped(f"{part['file']}.doc", "<i8")
            for at in range(0, len(doc), 8192):
                own = off[at : at + 8193]
                crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(own[:-1].tolist(), own[1:].tolist(), strict=True)]
                named = np.asarray(doc[at : at + 8192])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(named, mask=named == NULL_ID), pa.array(part["base"] + own[:-1]), pa.array(np.diff(own)), pa.array(crc, pa.int64())],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )


def read(spark: SparkSession, manifest: list[dict]) -> DataFrame:
    """Digests of documents from token files: doc_id, start, n_tokens, ids_crc32."""
    schema = "part bigint, file string, docs bigint, tokens bigint, width bigint, base bigint"
    parts = spark.createDataFrame([[p[k.split()[0]] for k in schema.split(", ")] for p in manifest], schema)
    return map_arrow(parts.repartition(max(1, len(manifest))), _read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str, end_id: int, cut: bool | None = None) -> DataFrame:
    """Write the documents' token files to the shared folder and read their digests back."""
    spark = docs.sparkSession
    return read(spark, write(docs, Scratch(spark, "tokens").path("files"), tokenizer, end_id, cut))
