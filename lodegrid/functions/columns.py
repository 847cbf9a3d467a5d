"""Column expressions shared by the operators; all of them run inside the JVM."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters of an identifier token.
TOKEN = r"[\p{L}\p{N}_]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Identifier tokens of a text, in order."""
    return F.regexp_extract_all(col(text), F.lit(f"({TOKEN})"), 1)


def is_word(name: str) -> bool:
    """If an identifier is one token, so that a word match is token equality."""
    return bool(re.fullmatch(r"\w+", name))


def word_count(text: Column | str, name: str) -> Column:
    """How often a text has an identifier as a whole word, whatever characters that has."""
    return F.regexp_count(col(text), F.lit(r"(?U)(?<!\w)\Q" + name.replace(r"\E", r"\E\\E\Q") + r"\E(?!\w)"))


def longest_token(text: Column | str) -> Column:
    """The longest token, the greater one on ties; null without any."""
    return F.array_max(F.transform(tokens(text), lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def parent_dir(path: Column | str) -> Column:
    """The directory of a path, ``.`` at the top."""
    path = col(path)
    return F.when(path == ".", F.lit(None).cast("string")).otherwise(F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*)/[^/]*$", 1), F.lit("")), F.lit(".")))


def ancestors(path: Column | str) -> Column:
    """All directories above a path, from the top, with ``.`` first."""
    parts = F.split(col(path), "/")
    below = F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.array(F.lit(".")), below)


def depth(path: Column | str) -> Column:
    return F.when(col(path) == ".", -1).otherwise(F.regexp_count(col(path), F.lit("/")))


def token_estimate(text: Column | str) -> Column:
    """A quarter of the characters, 1 at least."""
    return F.greatest(F.lit(1), F.floor(F.length(col(text)) / 4)).cast("int")


def _folds() -> tuple[str, str]:
    """Accented Latin letters and what is left of them without marks."""
    letters = [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in letters if len(unicodedata.normalize("NFD", chr(c))) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def folded(text: str) -> str:
    """``fold`` of a string on the driver: queries are folded by the index's own rule."""
    bare = "".join(c for c in text if not unicodedata.category(c).startswith("M")).lower()
    return bare.translate(str.maketrans(*_folds()))


def fold(text: Column | str) -> Column:
    """Lower case without accents."""
    marked, plain = _folds()
    ascii_alone = F.octet_length(col(text)) == F.length(col(text))
    return F.when(ascii_alone, F.lower(col(text))).otherwise(F.translate(F.lower(F.regexp_replace(col(text), r"\p{M}+", "")), marked, plain))


def index_tokens(text: Column | str) -> Column:
    """Tokens of the full-text index: runs of letters and digits, folded."""
    return F.filter(F.split(fold(F.coalesce(col(text), F.lit(""))), r"[^\p{L}\p{N}]+"), lambda t: t != "")


def json_strings(text: Column | str) -> Column:
    """A JSON array of strings, empty where the text is none."""
    return F.coalesce(F.from_json(col(text), "array<string>"), F.array().cast("array<string>"))
