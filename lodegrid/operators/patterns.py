"""Many names at once: one pass over lines with an Aho-Corasick automaton, whatever characters the names have.

Names are broadcast in blocks of a checked size, and each worker builds a block's automaton once; more names than
a block holds take one more pass over the lines each.  A name is met where it stands as a whole: the characters around it
are no parts of words.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import lru_cache, reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of lines that a task's worker is sent at once, unless the session says otherwise: lines may be whole documents.
BATCH_BYTES = 2 << 20
#: Names, and characters of names, of one automaton.
BLOCK_NAMES, BLOCK_CHARS = 200_000, 4_000_000
# Categories of characters that are parts of words, besides letters; and the joiners.
WORD_CATEGORIES, JOINERS = ("Mn", "Me", "Mc", "Nd", "Nl", "Pc"), "‌‍"

_automata: dict[str, object] = {}


@lru_cache(4096)
def in_word(c: str) -> bool:
    """If a character is part of a word."""
    kind = unicodedata.category(c)
    return kind[0] == "L" or kind in WORD_CATEGORIES or c in JOINERS


def blocks(names: DataFrame) -> Iterator[list[str]]:
    """Distinct names without the empty one, in blocks of a bounded size, one after another on the driver."""
    own, size = [], 0
    for row in names.select("name").where(F.length("name") > 0).distinct().orderBy("name").toLocalIterator():
        if own and (len(own) >= BLOCK_NAMES or size + len(row[0]) > BLOCK_CHARS):
            yield own
            own, size = [], 0
        own.append(row[0])
        size += len(row[0])
    if own:
        yield own


def _automaton(key: str, names: list[str]):
    """The worker's automaton of a broadcast block, kept from task to task."""
    import ahocorasick

    if key not in _automata:
        made = ahocorasick.Automaton()
        for name in names:
            made.add_word(name, name)
        made.make_automaton()
        _automata.clear()
        _automata[key] = made
    return _automata[key]


def whole_matches(automaton, text: str) -> set[str]:
    """Names that stand as a whole in a text."""
    found = set()
    for end, name in automaton.iter(text):
        start = end + 1 - len(name)
        if name not in found and not (start and in_word(text[start - 1])) and not (end + 1 < len(text) and in_word(text[end + 1])):
            found.add(name)
    return found


def match(lines: DataFrame, names: DataFrame) -> DataFrame:
    """(file_path, line_no, name), each once: lines (file_path, line_no, text) that have a name (name) as a whole. Null texts have none."""
    context, limit = lines.sparkSession.sparkContext, "spark.sql.execution.arrow.maxBytesPerBatch"
    if not context.getConf().get(limit):
        lines.sparkSession.conf.set(limit, str(BATCH_BYTES))

    def one(block: list[str]) -> DataFrame:
        shared, key = context.broadcast(block), uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                automaton, at, found = _automaton(key, shared.value), [], []
                for i, text in enumerate(batch.column("text").to_pylist()):
                    own = whole_matches(automaton, text) if text else ()
                    at += [i] * len(own)
                    found += own
                taken = batch.select(["file_path", "line_no"]).take(pa.array(at, pa.int64()))
                yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(found, pa.string())], names=["file_path", "line_no", "name"])

        kind = dict(lines.dtypes)["line_no"]
        return lines.select("file_path", "line_no", "text").mapInArrow(run, f"file_path string, line_no {kind}, name string")

    parts = [one(b) for b in blocks(names)]
    return reduce(DataFrame.unionByName, parts) if parts else lines.select("file_path", "line_no", F.lit("").alias("name")).where(F.lit(False))
