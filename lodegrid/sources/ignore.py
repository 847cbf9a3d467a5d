"""Ignore rules in the syntax of .gitignore, as regular expressions over relative paths."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegrid.functions.columns import col


def rule(pattern: str) -> tuple[str, bool] | None:
    """(regular expression, negated) of a pattern; None for blanks and comments."""
    pattern = pattern.strip()
    if not pattern or pattern.startswith("#"):
        return None
    negated = pattern.startswith("!")
    pattern = pattern[negated:].removeprefix("\\")
    folder = pattern.endswith("/")
    pattern = pattern.rstrip("/")
    anchored = "/" in pattern
    pattern = pattern.lstrip("/")
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if pattern.startswith("**/", i) and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + "(?:[^/]+/)*", i + 3
        elif pattern[i:] == "**" and (i == 0 or pattern[i - 1] == "/"):
            out, i = out + ".+", i + 2
        elif c == "*":
            out += "[^/]*"
            while i < len(pattern) and pattern[i] == "*":
                i += 1
        elif c == "?":
            out, i = out + "[^/]", i + 1
        elif c == "[" and (end := pattern.find("]", i + 2)) > 0:
            inner = pattern[i + 1 : end]
            inner = "^" + inner[1:] if inner[0] in "!^" else inner
            out, i = out + "[" + inner.replace("\\", "\\\\") + "]", end + 1
        else:
            if c == "\\" and i + 1 < len(pattern):
                i += 1
                c = pattern[i]
            out, i = out + re.escape(c), i + 1
    return ("^" if anchored else "^(?:.*/)?") + out + ("/.*$" if folder else "(?:/.*)?$"), negated


def ignored(path: Column | str, patterns: list[str], always: tuple[str, ...] = (".lodegrid",)) -> Column:
    """If a relative path is ignored: the last pattern that matches decides; index folders are always."""
    path = col(path)
    out = F.lit(False)
    for found in filter(None, map(rule, patterns)):
        out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    inside = F.split(path, "/")
    return F.exists(inside, lambda part: part.isin(*always)) | out
