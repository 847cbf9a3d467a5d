import json
import sqlite3

import pytest
from pyspark.sql import functions as F

from lodegrid import schemas
from lodegrid.functions.query_text import phrases
from lodegrid.operators import bm25, formats, rollup, search
from tests.fixtures import frame, node, search_tables

TEXTS = [
    (1, "parse_file reads a file", "Parser of files"), (2, "the café is open open", None), (3, "file file file", "file parse"), (4, "", ""), (5, "parse the file, parse it", "open file"),
    (6, "rien de rien", "cafe"), (7, "parse file parse_file", "x y z"), (8, "a quick brown fox", "jumps"), (9, "over the lazy dog", "open"),
]


@pytest.mark.parametrize("query", ["file", "parse_file", "open cafe", "file file", "parse open", "the", "nothing here"])
@pytest.mark.parametrize("every", [True, False])
def test_scores_are_those_of_another_engine(spark, query, every):
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE t USING fts5(a, b)")
    con.executemany("INSERT INTO t(rowid, a, b) VALUES (?, ?, ?)", TEXTS)
    text = (" AND " if every else " OR ").join(f'"{t}"' for t in query.split())
    expected = {k: -r for k, r in con.execute("SELECT rowid, rank FROM t WHERE t MATCH ?", (text,))}
    rows = spark.createDataFrame(TEXTS, "id int, a string, b string")
    got = {r.id: r.score for r in bm25.score(bm25.postings(rows, ("a", "b")), phrases(query), len(TEXTS), every).collect()}
    assert got.keys() == expected.keys()
    assert all(abs(got[k] - expected[k]) < 1e-9 for k in got)


def test_all_terms_come_before_any(spark):
    rows = spark.createDataFrame(TEXTS, "id int, a string, b string")
    best = bm25.top(bm25.postings(rows, ("a", "b")), phrases("parse open"), rows.select("id"), 9).orderBy("rank").collect()
    assert [r.id for r in best if r.leg == 0] == [5] and best[0].id == 5 and len(best) == 6
    assert bm25.top(bm25.postings(rows, ("a", "b")), [], rows.select("id"), 9).count() == 0
    assert bm25.top(bm25.postings(rows, ("a", "b")), phrases("--- open"), rows.select("id"), 9).count() == 3


def test_lexical(spark):
    tables, ids = search_tables(spark)
    found = search.present(search.lexical("parse_file", tables["nodes"], tables["lines"]), tables["nodes"]).collect()
    assert [r.name for r in found] == ["parse_directory", "Parser"]
    assert found[0].score == found[1].score and found[0].raw_source is None
    assert search.lexical("absent", tables["nodes"], tables["lines"]).count() == 0


def test_semantic_hybrid_and_fallback(spark):
    tables, ids = search_tables(spark)
    nodes, lines = tables["nodes"], tables["lines"]
    assert {r.id for r in search.semantic("parsing", nodes).collect()} == {ids["parse_file"], ids["parse_directory"]}
    assert search.semantic("zzz", nodes).count() == 0
    both = search.hybrid("get_connection parsing", nodes, lines).orderBy("rank").collect()
    assert both[0].id == ids["parse_file"] and len({r.id for r in both}) == len(both) == 3
    kind, found = search.run("database", tables)
    assert kind == "lexical" and [r.name for r in found.collect()] == ["get_connection"]
    kind, found = search.run("look for get_connection", tables, "semantic")
    assert "get_connection" in [r.name for r in found.collect()]
    kind, found = search.run(ids["parse_file"], tables, "graph", depth=1)
    assert kind == "graph" and found[0].count() == 4


def test_hierarchical(spark):
    tables, ids = search_tables(spark)
    found = search.hierarchical("parsing AST", tables["nodes"], tables["directories"])
    assert found["project_summary"] == "An index of code"
    dirs = found["directories"].collect()
    assert dirs[0].dir_path == "src" and dirs[0].child_dirs == ["src/db"] and (dirs[0].file_count, dirs[0].node_count) == (2, 4)
    assert found["nodes"].count() == 4


@pytest.mark.parametrize("replies,names", [(['["src"]', '["src/db.py"]'], ["get_connection"]), (['```json\n["src"]\n```', 'Sure: ["src/db.py", "x"]'], ["get_connection"]), (['["src"]', "prose"], []), (["prose"], None)])
def test_hierarchical_with_a_model(spark, replies, names):
    tables, _ = search_tables(spark)
    asked = iter(replies)
    found = search.hierarchical_llm("parsing", tables["nodes"], tables["directories"], lambda _: next(asked))
    got = [r.name for r in found["nodes"].collect()]
    assert got == names if names is not None else len(got) == 4


def test_hierarchical_without_directories_asks_nothing(spark):
    tables, _ = search_tables(spark)
    only = tables["directories"].where("dir_path = '.'")
    assert search.hierarchical_llm("index", tables["nodes"], only, lambda _: 1 / 0)["directories"].count() == 1


def test_parse_array():
    assert search.parse_array('```\n["a"]\n```') == ["a"] and search.parse_array("x [1, 2] y") == ["1", "2"] and search.parse_array("none") == [] and search.parse_array('{"a": 1}') == []


@pytest.mark.parametrize("form", ["text", "json", "jsonl"])
def test_formats(spark, form):
    tables, ids = search_tables(spark)
    nodes = search.present(search.semantic("parsing", tables["nodes"]), tables["nodes"], True)
    text = formats.render(nodes, form)
    assert "parse_file" in text
    if form != "text":
        rows = json.loads(text) if form == "json" else [json.loads(x) for x in text.splitlines()]
        assert len(rows) == 2 and rows[0]["raw_source"]
    assert "src/db" in formats.render(search.hierarchical("parsing", tables["nodes"], tables["directories"]), form)
    from lodegrid.operators import graph

    assert "get_connection" in formats.render(graph.search(ids["parse_file"], tables["nodes"], tables["edges"]), form)
    assert formats.render(None, form) == ("[]" if form == "json" else "")


def test_rollup(spark):
    nodes = frame(spark, [node("a/b/x.py", "file", "x.py", 1, 9, 0, semantic_summary="X."), node("a/b/x.py", "class", "C", 1, 9, 1), node("a/y.py", "file", "y.py", 1, 1, 0), node("a/y.py", "function", "f", 1, 1, 1), node("z.py", "file", "z.py", 1, 1, 0)], schemas.NODE)
    files = nodes.where("node_type = 'file'")
    assert [r.dir_path for r in rollup.directories(files, "file_path").collect()] == ["a/b", "a", "."]
    assert {r.dir_path: (r.file_count, r.node_count) for r in rollup.counts(nodes).collect()} == {".": (3, 5), "a": (2, 4), "a/b": (1, 2)}
    known = frame(spark, [{"dir_path": "a/b", "summary": "B.", "child_count": 1}], schemas.DIRECTORY)
    dirs = rollup.directories(files, "file_path")
    told = {r.dir_path: (r.contents, r.child_count) for r in rollup.contents(nodes, known, dirs).collect()}
    assert told == {"a/b": ("File a/b/x.py: X.", 1), "a": ("function f\nDirectory a/b: B.", 2), ".": ("(empty directory)", 1)}


def test_rollup_of_a_directory_of_any_size(spark):
    """The first lines of hot and small directories against plain Python; tasks keep the first rows before they are shuffled."""
    n = 50_000
    lines = spark.range(n).select(F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.concat(F.lit("d"), (F.col("id") % 7).cast("string"))).alias("dir"), ((F.col("id") * 7919) % n % 1000).alias("at"), F.concat(F.lit("line "), F.col("id").cast("string")).alias("line"))
    lines = lines.unionByName(spark.createDataFrame([("one", 1, "x"), ("null", 1, None), ("same", 2, "y"), ("same", 2, "y")], "dir string, at bigint, line string"))
    found = rollup.first_lines(lines, "dir", ["at"], "line", 5)
    whole = {}
    for r in lines.collect():
        whole.setdefault(r.dir, []).append((r.at, r.line))
    told = {r.dir: (r.n, r.text) for r in found.collect()}
    assert told == {d: (len(rows), "\n".join(x for _, x in sorted(rows)[:5] if x is not None)) for d, rows in whole.items()}
    assert "WindowGroupLimit" in found._jdf.queryExecution().executedPlan().toString()
    assert rollup.first_lines(lines.limit(0), "dir", ["at"], "line", 5).count() == 0


def test_rollup_with_a_bound(spark):
    nodes = frame(spark, [node(f"a/f{i:02}.py", "file", f"f{i:02}.py", 1, 1, 0, semantic_summary=f"S{i}.") for i in range(12)] + [node("b/x.py", "file", "x.py", 1, 1, 0)], schemas.NODE)
    dirs = rollup.directories(nodes, "file_path")
    none = spark.createDataFrame([], schemas.DIRECTORY)
    told = {r.dir_path: (r.contents, r.child_count) for r in rollup.contents(nodes, none, dirs, 2).collect()}
    assert told == {"a": ("File a/f00.py: S0.\nFile a/f01.py: S1.\n(10 more)", 12), "b": ("(empty directory)", 1), ".": ("(empty directory)", 1)}
    same = {r.dir_path: (r.contents, r.child_count) for r in rollup.contents(nodes, none, dirs, 12).collect()}
    assert same == {r.dir_path: (r.contents, r.child_count) for r in rollup.contents(nodes, none, dirs).collect()}


def test_texts_without_an_index_count_as_postings_do(spark):
    rows = spark.createDataFrame([(1, "Öffne parse parse open", "open open"), (2, "open PARSE", None), (3, None, "---"), (4, "parse open parse open", "é parse")], "id int, a string, b string")
    index, texts = bm25.postings(rows, ("a", "b")), bm25.Unindexed(rows, ("a", "b"))
    for query in ("parse", "parse open", "parse_open", "--- open", "absent"):
        for every in (True, False):
            wanted = bm25.score(index, phrases(query), rows.select("id"), every).collect()
            assert sorted(bm25.score(texts, phrases(query), rows.select("id"), every).collect()) == sorted(wanted)
    found = bm25.statistics(rows, ("a", "b")).first()
    assert tuple(found) == (index.select("id").distinct().count(), bm25.lengths(index).groupBy().sum("length").first()[0], index.select("term").distinct().count())
    # One pass over the texts, for all that a query needs.
    assert bm25.score(texts, phrases("parse"), 4)._jdf.queryExecution().optimizedPlan().toString().count("collect_list") == 0
