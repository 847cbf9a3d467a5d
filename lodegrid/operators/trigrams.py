"""A positional index of three-character pieces of lines, for literals and regular expressions.

A literal stands in a line where the pieces that cover it stand at their offsets from one start: an equi-group of
few postings.  A regular expression has literals that every match must hold, alternative by alternative;
they give candidate lines, and only these are read and matched.  An expression without such
literals, or with ones under three characters alone, is matched against all lines.
"""

from __future__ import annotations

import re
from functools import reduce
from re import _constants as kinds
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SIZE = 3
#: Alternatives of an expression that are looked up one by one; beyond it some literals are not asked for.
ALTERNATIVES = 32


def index(lines: DataFrame) -> DataFrame:
    """(gram, file_path, line_no, place) of lines (file_path, line_no, text): every piece of three characters."""
    n = F.length("text") - (SIZE - 1)
    at = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    placed = lines.select("file_path", "line_no", "text", F.explode(at).alias("place"))
    return placed.select(F.substring("text", F.col("place"), F.lit(SIZE)).alias("gram"), "file_path", "line_no", "place")


def write(rows: DataFrame, path: str) -> DataFrame:
    """Store an index by gram, so that a look-up reads the pages of its own, and return it as read again."""
    rows.repartitionByRange("gram", "file_path").sortWithinPartitions("gram", "file_path", "line_no").write.option("parquet.block.size", 4 << 20).parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _all(parts: list[list[frozenset[str]]]) -> list[frozenset[str]]:
    """Alternatives of parts that follow one another."""
    out = [frozenset()]
    for part in parts:
        both = [a | b for a in out for b in part]
        out = both if len(both) <= ALTERNATIVES else out
    return out


def _needs(items) -> list[frozenset[str]]:
    parts: list[list[frozenset[str]]] = []
    run = ""

    def close() -> str:
        if len(run) >= SIZE:
            parts.append([frozenset([run])])
        return ""

    for kind, value in items:
        if kind is kinds.LITERAL:
            run += chr(value)
            continue
        run = close()
        if kind is kinds.SUBPATTERN and not value[1] & re.IGNORECASE:
            parts.append(_needs(value[3]))
        elif kind is kinds.BRANCH:
            parts.append([a for option in value[1] for a in _needs(option)])
        elif kind in (kinds.MAX_REPEAT, kinds.MIN_REPEAT, kinds.POSSESSIVE_REPEAT) and value[0] > 0:
            parts.append(_needs(value[2]))
    close()
    return _all(parts)


def required(pattern: str) -> list[frozenset[str]] | None:
    """Sets of literals: a match holds all of one set. None if there is an alternative without any.

    Expressions that Python can't read (other dialects), and those that ignore case, have none.
    """
    try:
        parsed = _parser.parse(pattern)
    except re.error:
        return None
    found = None if parsed.state.flags & re.IGNORECASE else _needs(parsed)
    return found if found and all(found) else None


def places(grams: DataFrame, literal: str) -> DataFrame:
    """(file_path, line_no, start): where a literal of three characters or more stands."""
    offsets: dict[str, list[int]] = {}
    cover = sorted({*range(0, len(literal) - SIZE + 1, SIZE), len(literal) - SIZE})
    for o in cover:
        offsets.setdefault(literal[o : o + SIZE], []).append(o)
    of = F.element_at(F.create_map(*[x for g, o in offsets.items() for x in (F.lit(g), F.array(*map(F.lit, o)))]), F.col("gram"))
    rows = grams.where(F.col("gram").isin(*offsets)).select("file_path", "line_no", "place", F.explode(of).alias("offset"))
    starts = rows.groupBy("file_path", "line_no", (F.col("place") - F.col("offset")).alias("start")).agg(F.countDistinct("offset").alias("n"))
    return starts.where(F.col("n") == len(cover)).drop("n")


def candidates(grams: DataFrame, needs: list[frozenset[str]]) -> DataFrame:
    """(file_path, line_no) of lines that hold all literals of one of the sets."""
    key = ["file_path", "line_no"]

    def one(literals: frozenset[str]) -> DataFrame:
        found = [places(grams, x).select(*key).distinct() for x in sorted(literals)]
        return reduce(lambda a, b: a.join(b, key, "left_semi"), found)

    return reduce(DataFrame.unionByName, [one(x) for x in needs]).distinct()


def grep(lines: DataFrame, grams: DataFrame, pattern: str, literal: bool = False) -> DataFrame:
    """Lines (file_path, line_no, text) that hold a literal or match an expression of Java's, each once.

    Null texts match nothing.  Literals under three characters are looked for in all lines.
    """
    needs = ([frozenset([pattern])] if len(pattern) >= SIZE else None) if literal else required(pattern)
    match: Column = F.contains("text", F.lit(pattern)) if literal else F.rlike("text", F.lit(pattern))
    among = lines if needs is None else lines.join(candidates(grams, needs), ["file_path", "line_no"], "left_semi")
    return among.where(match).select("file_path", "line_no", "text")
