"""What the text of a query looks like, on the driver and as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodegrid.functions.columns import col, folded

# What identifiers, camel case and snake case look like.
IDENTIFIER = r"^[A-Za-z_][A-Za-z0-9_]*([.][A-Za-z_][A-Za-z0-9_]*)*$"
CAMEL = r"[a-z][A-Z]"
SNAKE = r"[a-z]_[a-z]"
# Identifiers so common that a match of them weighs half.
COMMON = (
    "get", "set", "put", "add", "run", "new", "map", "self", "this", "init", "main", "data", "name", "type", "value", "result", "error", "config",
    "test", "setup", "args", "kwargs", "params", "item", "items", "list", "dict", "key", "val", "start", "stop", "close", "open", "read", "write",
    "send", "save", "load", "update", "delete", "create", "path", "file", "node", "model", "index", "count", "size", "text", "line", "util", "utils", "helper",
)
STRATEGIES = ("lexical", "graph", "semantic", "hybrid", "hierarchical", "hierarchical-llm")


def is_identifier(text: str) -> bool:
    return " " not in text and bool(re.search(f"{IDENTIFIER}|{CAMEL}|{SNAKE}", text))


def is_structured(token: str) -> bool:
    """If a token of a longer query is clearly an identifier: camel or snake case, or dotted."""
    return bool(re.search(f"{CAMEL}|{SNAKE}", token) or ("." in token and re.search(IDENTIFIER, token)))


def strategy(text: str, given: str | None = None) -> str:
    """The search strategy of a query; one that is given wins."""
    if given:
        return given
    if is_identifier(text):
        return "lexical"
    words = text.split()
    return "hybrid" if len(words) > 1 and any(map(is_structured, words)) else "semantic"


def strategy_column(text: Column | str) -> Column:
    """``strategy`` as an expression."""
    text = col(text)
    words = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    lone = ~text.contains(" ") & (text.rlike(IDENTIFIER) | text.rlike(CAMEL) | text.rlike(SNAKE))
    mixed = (F.size(words) > 1) & F.exists(words, lambda w: w.rlike(CAMEL) | w.rlike(SNAKE) | (w.contains(".") & w.rlike(IDENTIFIER)))
    return F.when(lone, "lexical").when(mixed, "hybrid").otherwise("semantic")


def phrases(text: str) -> list[tuple[str, ...]]:
    """Each white-space separated term of a query as the phrase of its index tokens; () for one of marks alone."""
    return [tuple(t for t in re.split(r"[\W_]+", term) if t) for term in folded(text).split()]
