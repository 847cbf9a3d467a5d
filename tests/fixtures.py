"""Small index tables."""

from __future__ import annotations

from lodegrid import schemas
from lodegrid.operators import chunking


def node(path, kind, name, start, end, ord=0, qualified=None, **more):
    made = chunking.make(path, kind, name, qualified or name, start, end, more.pop("raw_source", name), more.pop("language", "python"))
    return made | {"semantic_summary": None, "domain_tags": None, "inferred_responsibility": None, "enriched_at": None, "enrichment_model": None, "ord": ord} | more


def frame(spark, rows, schema):
    return spark.createDataFrame([[r.get(f.name) for f in schema.fields] for r in rows], schema)


def search_tables(spark):
    """Four units in two files, three edges, and their lines."""
    app, db = "src/app.py", "src/db.py"
    nodes = [
        node(app, "function", "parse_file", 1, 20, 0, semantic_summary="Parses a Python source file into an AST.", domain_tags=["parsing", "ast"]),
        node(app, "function", "parse_directory", 22, 50, 1, semantic_summary="Parses all files in a directory tree.", domain_tags=["parsing", "directory"]),
        node(db, "function", "get_connection", 1, 10, 0, semantic_summary="Returns a database connection.", domain_tags=["database"]),
        node(app, "class", "Parser", 55, 100, 2),
    ]
    ids = {n["name"]: n["id"] for n in nodes}
    edges = [(ids["parse_directory"], ids["parse_file"], "calls", 25), (ids["parse_file"], ids["get_connection"], "calls", 5), (ids["Parser"], ids["parse_file"], "references", 60)]
    texts = {5: "    conn = get_connection()", 25: "    parse_file(p)", 60: "  # see parse_file and parse_file", 70: "parse_files"}
    lines = [(app, i, texts.get(i, "")) for i in range(1, 101)] + [("README.md", 1, "parse_file is not here")]
    directories = [
        {"dir_path": ".", "summary": "An index of code", "domain_tags": ["indexing"], "child_count": 1},
        {"dir_path": "src", "summary": "Parsing and AST tools", "domain_tags": ["parsing", "ast"], "child_count": 2},
        {"dir_path": "src/db", "summary": "Connections to databases", "domain_tags": ["database"], "child_count": 1},
    ]
    return {
        "nodes": frame(spark, nodes, schemas.NODE), "edges": spark.createDataFrame(edges, schemas.EDGE), "lines": spark.createDataFrame(lines, schemas.LINE),
        "directories": frame(spark, directories, schemas.DIRECTORY),
    }, ids
