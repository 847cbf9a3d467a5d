"""Token budgets: splitting large units and merging runs of small ones."""

from __future__ import annotations

import hashlib

# Node types that are never merged.
WHOLE = ("file", "class", "interface", "object")


def tokens(text: str) -> int:
    """A quarter of the characters, 1 at least."""
    return max(1, len(text) // 4)


def segment(lines: list[str], start: int, end: int) -> str:
    """Lines ``start`` to ``end``, from 1, both included."""
    return "\n".join(lines[start - 1 : end])


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def make(path: str, kind: str, name: str, qualified: str, start: int, end: int, raw: str, language: str, signature: str | None = None, docstring: str | None = None) -> dict:
    """A node without its place in the file."""
    return {
        "id": f"{path}::{kind}::{qualified}", "file_path": path, "node_type": kind, "name": name, "qualified_name": qualified, "signature": signature, "docstring": docstring,
        "start_line": start, "end_line": end, "language": language, "raw_source": raw, "content_hash": sha256(raw),
    }


def split(node: dict, lines: list[str], limit: int, statements: list[tuple[int, int]]) -> list[dict]:
    """Chunks of a unit over its budget: consecutive statements (first line, last line), as many as fit."""
    if tokens(node["raw_source"]) <= limit or not statements:
        return []
    spans: list[list[int]] = []
    for start, end in statements:
        if spans and tokens(segment(lines, spans[-1][0], end)) <= limit:
            spans[-1][1] = max(spans[-1][1], end)
        else:
            spans.append([start, end])
    return [
        make(node["file_path"], node["node_type"], f"chunk_{i}", f"{node['qualified_name']}.chunk_{i}", a, b, segment(lines, a, b), node["language"], node["signature"])
        for i, (a, b) in enumerate(spans)
    ]


def parent_of(node: dict) -> str:
    return node["qualified_name"].rpartition(".")[0] or node["file_path"]


def merge(nodes: list[dict], limit: int) -> list[dict]:
    """Nodes and, after them, one more for each run of two or more consecutive small siblings that fit together."""
    runs: list[tuple[str, list[dict]]] = []
    run: list[dict] = []
    used = 0

    def flush() -> None:
        nonlocal run, used
        if len(run) > 1:
            runs.append((parent_of(run[0]), run))
        run, used = [], 0

    for node in nodes:
        size = tokens(node["raw_source"] or "")
        if node["node_type"] in WHOLE or node["name"].startswith("chunk_") or size >= limit / 3:
            flush()
            continue
        if run and (parent_of(node) != parent_of(run[0]) or used + size > limit):
            flush()
        run.append(node)
        used += size
    flush()
    out = list(nodes)
    for n, (parent, members) in enumerate(runs, 1):
        signatures = "; ".join(m["signature"] for m in members if m["signature"]) or None
        raw = "\n\n".join(m["raw_source"] for m in members)
        start, end = min(m["start_line"] for m in members), max(m["end_line"] for m in members)
        out.append(make(members[0]["file_path"], members[0]["node_type"], f"merged_{n}", f"{parent}.merged_{n}", start, end, raw, members[0]["language"], signatures))
    return out
