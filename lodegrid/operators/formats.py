"""Results as text, JSON and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def json_rows(rows: DataFrame) -> DataFrame:
    """(value): each row as JSON, null columns left out."""
    return rows.select(F.to_json(F.struct(*rows.columns)).alias("value"))


def text_line(with_signature: bool = True) -> Column:
    """A node on one line."""
    head = F.concat(F.rpad("node_type", 10, " "), F.lit(" "), "qualified_name", F.lit("  ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    return F.concat(head, F.coalesce(F.concat(F.lit("\n" + " " * 11), "signature"), F.lit(""))) if with_signature else head


def _plain(row) -> dict:
    out = row.asDict(recursive=True)
    if out.get("raw_source") is None:
        out.pop("raw_source", None)
    return out


def _node_lines(nodes: list[dict]) -> list[str]:
    out = []
    for n in nodes:
        out.append(f"{n['node_type']:10s} {n['qualified_name']}  ({n['file_path']}:{n['start_line']}-{n['end_line']})")
        out += [" " * 11 + n[c] for c in ("signature", "semantic_summary") if n.get(c)]
        out += [" " * 11 + "[source included]"] if n.get("raw_source") else []
    return out


def render(result: object, form: str = "text") -> str:
    """A search's result for people or programs; results are top-k, so they fit the driver.

    ``result``: ranked nodes; (nodes, edges) of a traversal; a dict of a hierarchical search; or None.
    """
    dump = lambda x: json.dumps(x, indent=2, default=str, ensure_ascii=False)
    line = lambda x: json.dumps(x, default=str, ensure_ascii=False)
    if result is None:
        return "[]" if form == "json" else ""
    if isinstance(result, tuple):
        nodes, edges = ([_plain(r) for r in df.collect()] for df in result)
        if form == "json":
            return dump({"root_node": nodes[0] if nodes else None, "nodes": nodes, "edges": edges})
        if form == "jsonl":
            return "\n".join(map(line, nodes))
        head = [f"Root: {nodes[0]['qualified_name']} ({nodes[0]['node_type']})", f"Nodes: {len(nodes)}  Edges: {len(edges)}"] if nodes else []
        return "\n".join(head + [f"  {n['node_type']:10s} {n['qualified_name']}" for n in nodes] + [f"  {e['source_id']} --[{e['edge_type']}]--> {e['target_id']}" for e in edges])
    if isinstance(result, dict):
        dirs, nodes = ([_plain(r) for r in result[k].collect()] for k in ("directories", "nodes"))
        if form == "json":
            return dump({"project_summary": result["project_summary"], "matched_directories": dirs, "nodes": nodes})
        if form == "jsonl":
            return "\n".join([line({"type": "directory"} | d) for d in dirs] + [line(n) for n in nodes])
        out = ["=== Project Overview ===", result["project_summary"], ""] if result["project_summary"] else []
        out += ["=== Matched Directories ===", ""] if dirs else []
        for i, d in enumerate(dirs, 1):
            out.append(f"[{i}] {d['dir_path']}/")
            shown = (("Summary", d["summary"]), ("Tags", ", ".join(d["domain_tags"])), ("Responsibility", d["responsibility"]), ("Children", ", ".join(d["child_dirs"])))
            out += [f"    {label}: {x}" for label, x in shown if x] + [f"    Files: {d['file_count']}  Nodes: {d['node_count']}", ""]
        out += ["=== Relevant Nodes (from matched directories) ===", *_node_lines(nodes)] if nodes else []
        return "\n".join(out)
    nodes = [_plain(r) for r in result.collect()]
    return dump(nodes) if form == "json" else "\n".join(map(line, nodes)) if form == "jsonl" else "\n".join(_node_lines(nodes))
