"""Files to nodes: parsing runs on executors, Arrow batch by batch."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegrid.operators import brace_units, chunking, python_units, ruby_units
from lodegrid.schemas import NODE

TOKEN_LIMIT = 512
EXTRACTORS = {"python": python_units.units, "ruby": ruby_units.units, "java": brace_units.Java().units, "kotlin": brace_units.Kotlin().units, "typescript": brace_units.TypeScript().units}


def parse(path: str, language: str, source: str, limit: int = TOKEN_LIMIT) -> list[dict] | None:
    """The nodes of one file in order, merged ones last; None if it can't be parsed. The last of equal ids wins."""
    found = EXTRACTORS[language](path, source, limit)
    if found is None:
        return None
    merged = chunking.merge(found, limit)
    last = {n["id"]: i for i, n in enumerate(merged)}
    return [n | {"ord": i, "parsed": len(merged)} for i, n in enumerate(merged) if last[n["id"]] == i]


_COLUMNS = [f.name for f in NODE.fields]
_KINDS = {"string": pa.string(), "int": pa.int32(), "timestamp": pa.timestamp("us", "UTC"), "array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}
_ARROW = pa.schema([(f.name, _KINDS[f.dataType.simpleString()]) for f in NODE.fields] + [("parsed", pa.int32()), ("failed", pa.bool_())])
_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in NODE.fields) + ", parsed int, failed boolean"


def extract(files: DataFrame, limit: int = TOKEN_LIMIT) -> DataFrame:
    """Nodes of files (path, language, text), with ``parsed``, the file's number of nodes before equal ids met.

    A file that can't be parsed gives one row, ``failed``, of which only file_path holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, language, text in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "text")), strict=True):
                found = parse(path, language, text, limit)
                rows += [n | {"failed": False} for n in found] if found is not None else [{"file_path": path, "failed": True}]
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    return files.select("path", "language", "text").mapInArrow(run, _SCHEMA)


def nodes_of(extracted: DataFrame) -> DataFrame:
    return extracted.where(~F.col("failed")).select(*_COLUMNS)


def failures(extracted: DataFrame) -> DataFrame:
    return extracted.where(F.col("failed")).select(F.col("file_path").alias("path"), F.lit("can't be parsed").alias("warning"))
