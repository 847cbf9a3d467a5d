"""Shuffles of very many keys as few rows.

Keys are 64-bit hashes, dealt to parts by their leading bits.  A task sorts some millions
of keys at a time and makes one row for each part: its columns as little-endian bytes.
Rows go to their parts by Spark's shuffle, and a part, of a bounded number of keys, is put
together again in numpy.  With more parts than keys in a batch a row has one key, so this
never costs more rows than a shuffle of the keys themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodegrid.llm.arrow import map_arrow

#: Keys in a part, near enough.
PART_KEYS = 1_000_000
#: Keys sorted at once.
BATCH_KEYS = 2_000_000


def parts_for(keys: int, df: DataFrame) -> int:
    return max(2 * df.sparkSession.sparkContext.defaultParallelism, -(-keys // PART_KEYS))


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part of each key: it grows with the key as an unsigned number."""
    return ((keys.view(np.uint64) >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def schema(names: list[str]) -> str:
    return "part bigint, " + ", ".join(f"{n} binary" for n in names)


def pack(part: np.ndarray, columns: dict[str, np.ndarray], **more: int) -> pa.RecordBatch:
    """One row for each run of equal parts; ``more``: columns of one number."""
    starts = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.empty(0, np.int64)
    arrays = [pa.array(part[starts])] + [pa.array(np.full(len(starts), v, np.int64)) for v in more.values()]
    for c in columns.values():
        offsets = (np.append(starts, len(part)) * c.itemsize).astype(np.int32)
        arrays.append(pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(c))]))
    return pa.RecordBatch.from_arrays(arrays, names=["part", *more, *columns])


def unpack(column: pa.Array, dtype: str) -> np.ndarray:
    """The numbers of all rows of a packed column, in order."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, dtype, (int(offsets[-1]) - int(offsets[0])) // np.dtype(dtype).itemsize, int(offsets[0])) if data is not None and offsets[-1] > offsets[0] else np.empty(0, dtype)


def equal(*values: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of equal rows of values start and end."""
    if not len(values[0]):
        return []
    cuts = [0, *(np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1).tolist(), len(values[0])]
    return list(zip(cuts[:-1], cuts[1:], strict=True))


def runs(batches: Iterator[pa.RecordBatch], key: str = "part") -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """Rows of equal ``key``, from rows in its order."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        values = batch.column(key).to_numpy()
        for a, b in equal(values):
            if held and values[a] != last:
                yield last, held
                held = []
            held.append(batch.slice(a, b - a))
            last = int(values[a])
    if held:
        yield last, held


def dealt(df: DataFrame, parts: int, *order: str, key: str = "part") -> DataFrame:
    """Rows by ``key``, and by other columns within it."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-parts // 2))
    return df.repartition(n, key).sortWithinPartitions(key, *order)


def tallied(key: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct key (ascending, unsigned) is found, and how often it is there or the sum of its ``n``."""
    order = np.argsort(key.view(np.uint64))
    ordered = key[order]
    starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1]))) if len(key) else np.empty(0, np.int64)
    times = np.diff(np.append(starts, len(key))) if n is None else np.add.reduceat(n[order], starts) if len(starts) else np.empty(0, np.int64)
    return order[starts], times


def count(df: DataFrame, keys_of, combine, names: list[str], parts: int, least: int = 1) -> DataFrame:
    """(key, names..., n): how often each key is there, if ``least`` times or more.

    ``keys_of`` gives the columns (64-bit integers) of a batch of ``df``, piece by piece;
    ``combine`` the key of the columns.
    """

    def tally(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        key = combine(*columns)
        at, n = tallied(key)
        return pack(part_of(key[at], parts), dict(zip(names, (c[at] for c in columns), strict=True)) | {"n": n.astype(np.int32)})

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for columns in keys_of(batch):
                held.append(columns)
                n += len(columns[0])
                if n >= BATCH_KEYS:
                    yield tally(held)
                    held, n = [], 0
        if n:
            yield tally(held)

    def all_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in runs(batches):
            columns = [np.concatenate([unpack(b.column(c), "<i8") for b in rows]) for c in names]
            key = combine(*columns)
            at, n = tallied(key, np.concatenate([unpack(b.column("n"), "<i4") for b in rows]).astype(np.int64))
            at, n = at[n >= least], n[n >= least]
            for i in range(0, len(at), 100_000):
                own = at[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(key[own]), *[pa.array(c[own]) for c in columns], pa.array(n[i : i + 100_000])], names=["key", *names, "n"])

    packed = map_arrow(df, some, schema([*names, "n"]))
    return map_arrow(dealt(packed, parts), all_, ", ".join(f"{c} bigint" for c in ("key", *names, "n")))
