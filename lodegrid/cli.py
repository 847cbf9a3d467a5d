"""Command line: init, build, enrich, query, status, reset. Exit codes: 0 well, 1 with warnings, 2 failed."""

from __future__ import annotations

import argparse
import hashlib
import importlib
import os
import sys

from pyspark.sql import SparkSession

from lodegrid import schemas
from lodegrid.functions.query_text import STRATEGIES
from lodegrid.operators import enrichment, formats, search
from lodegrid.plans.store import Index, summary
from lodegrid.sources.files import index_location, readme

IGNORE_LINE = ".lodegrid/"


def session() -> SparkSession:
    spark = SparkSession.builder.appName("lodegrid").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ignore_index(root: str) -> bool:
    """Add the index folder to .gitignore; if that was needed."""
    at = os.path.join(root, ".gitignore")
    text = open(at, encoding="utf-8").read() if os.path.exists(at) else ""
    if IGNORE_LINE in text.splitlines():
        return False
    with open(at, "a", encoding="utf-8") as f:
        f.write(("" if not text or text.endswith("\n") else "\n") + IGNORE_LINE + "\n")
    return True


def model_of(name: str) -> enrichment.Model:
    """A model named ``module:callable``."""
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lodegrid", description=__doc__)
    p.add_argument("--index", help="folder of the index (else $LODEGRID_INDEX, else .lodegrid/index)")
    sub = p.add_subparsers(dest="command", required=True)
    init = sub.add_parser("init")
    init.add_argument("--no-gitignore-update", action="store_true")
    build = sub.add_parser("build")
    build.add_argument("--root", default=".")
    build.add_argument("--phase", choices=["PREPARE", "DEPLOY"], default="PREPARE")
    build.add_argument("--token-limit", type=int, default=512)
    build.add_argument("--exclude", action="append", default=[])
    build.add_argument("--no-gitignore-update", action="store_true")
    enrich = sub.add_parser("enrich")
    enrich.add_argument("--dry-run", action="store_true")
    enrich.add_argument("--root", default=".", help="where the project's README is")
    enrich.add_argument("--model", help="module:callable, from a prompt to a reply")
    enrich.add_argument("--concurrency", type=int, default=enrichment.CONCURRENCY)
    query = sub.add_parser("query")
    query.add_argument("text")
    query.add_argument("--type", choices=STRATEGIES)
    query.add_argument("--format", choices=["text", "json", "jsonl"], default="text" if sys.stdout.isatty() else "json")
    query.add_argument("--with-source", action="store_true")
    query.add_argument("--top-k", type=int, default=10)
    query.add_argument("--depth", type=int, default=2)
    query.add_argument("--model")
    sub.add_parser("status")
    reset = sub.add_parser("reset")
    reset.add_argument("--yes", "-y", action="store_true")
    return p


def main(argv: list[str] | None = None) -> int:
    a = parser().parse_args(argv)
    where = index_location(a.index)
    warn = lambda text: print(text, file=sys.stderr)
    if a.command == "query" and not a.text.strip():
        warn("empty query")
        return 2
    if a.command == "reset" and not a.yes and not (sys.stdin.isatty() and input("Delete the index? [y/N] ").lower() == "y"):
        warn("reset needs --yes")
        return 1
    index = Index(session(), where)
    if a.command in ("status", "query", "enrich") and not index.exists():
        warn(f"no index at {where}")
        return 1
    if index.schema_version() > schemas.SCHEMA_VERSION:
        warn("the index is of a newer version")
        return 2
    if a.command == "init":
        index.write({"meta": index.meta_table({"schema_version": schemas.SCHEMA_VERSION})})
        if not a.no_gitignore_update:
            ignore_index(os.getcwd())
        return 0
    if a.command == "reset":
        index.reset()
        index.write({"meta": index.meta_table({"schema_version": schemas.SCHEMA_VERSION})})
        return 0
    if a.command == "build":
        try:
            tables, warnings = index.build(a.root, a.phase, a.token_limit, a.exclude)
        except BlockingIOError:
            warn("another build is running")
            return 2
        if not a.no_gitignore_update:
            ignore_index(a.root)
        for path, text in warnings:
            warn(f"[WARNING] {path}: {text}")
        row = summary(tables).first()
        print(f"Nodes: {row['nodes']}  Edges: {row['edges']}")
        return 1 if warnings else 0
    tables = index.read()
    if a.command == "status":
        row, meta = summary(tables).first(), index.meta()
        shown = {"Nodes": row["nodes"], "Edges": row["edges"], "Unenriched": row["unenriched"], "Last build": meta.get("last_full_build", "N/A"), "Phase boundary": meta.get("last_phase_boundary", "N/A"), "Schema version": index.schema_version(), "Index path": where}
        for label, x in shown.items():
            print(f"{label + ':':<17} {x}")
        return 0
    if a.command == "enrich":
        n = enrichment.unenriched(tables["nodes"]).count()
        if a.dry_run or not a.model:
            print(f"{n} nodes to enrich, about {enrichment.minutes(n, a.concurrency)} minutes")
            return 0 if a.dry_run else 2
        model = enrichment.informed(model_of(a.model), enrichment.project_prompt(tables["directories"], readme(a.root)))
        ledger = f"{index.uri}/replies-{hashlib.sha256(a.model.encode()).hexdigest()[:16]}"  # stays until all that was asked is stored
        for prompts, keys in ((lambda t: enrichment.node_prompts(t["nodes"], t["edges"]), enrichment.NODE_KEYS), (lambda t: enrichment.file_prompts(t["nodes"]), enrichment.DIRECTORY_KEYS)):
            told = enrichment.replies_once(prompts(tables), model, ledger, concurrency=a.concurrency)
            tables = index.enriched(enrichment.answered_nodes(tables["nodes"], told, a.model, keys))
        tables = index.write({"directories": enrichment.enrich_directories(tables["nodes"], tables["directories"], model, a.model, concurrency=a.concurrency, ledger=ledger)})
        index.remove(ledger.rsplit("/", 1)[1])
        left = enrichment.unenriched(tables["nodes"]).count()
        index.write({"meta": index.meta_table({"unenriched_nodes": left})})
        return 1 if left else 0
    if a.type in (None, "semantic", "hybrid") and tables["nodes"].isEmpty():
        warn("the index is empty")
        return 1
    _, result = search.run(a.text, tables, a.type, a.top_k, a.depth, a.with_source, model_of(a.model) if a.model else None, index.full_text())
    print(formats.render(result, a.format))
    return 0


if __name__ == "__main__":
    sys.exit(main())
