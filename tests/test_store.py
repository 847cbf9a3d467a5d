import json
import os
import random
import threading
import time
import uuid

import pytest
from pyspark.sql import functions as F

from lodegrid import cli, schemas
from lodegrid.operators import bm25, enrichment, search
from lodegrid.plans import store
from lodegrid.sources import files as source_files
from lodegrid.streaming.refresh import refresh, removals, sweep
from tests.fixtures import frame, node, search_tables


def write(root, contents):
    """Files below a root, by their paths."""
    for path, text in contents.items():
        at = root / path
        assert at.resolve().is_relative_to(root.resolve())
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text if isinstance(text, bytes) else text.encode())


def content(tables):
    nodes = sorted(tuple(r) for r in tables["nodes"].select("id", "content_hash", "start_line", "end_line").collect())
    return nodes, sorted(tuple(r) for r in tables["edges"].collect()), sorted(tuple(r) for r in tables["files"].select("path", "content_hash", "node_count").collect())


def test_scan_guards(spark, tmp_path):
    write(tmp_path, {"a.py": "x = 1", "pkg/b.py": "y = 2", "__pycache__/c.py": "z", "build/d.py": "w", "e.go": "package e", "f.py": b"\xff\xfe bad"})
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "g.py").write_text("g = 1")
    (tmp_path / "big.py").write_bytes(b"#" * (source_files.MAX_BYTES + 1))
    (tmp_path / "a b+c.py").write_text("q = 1")
    (tmp_path / ".gitignore").write_text("build/\n")
    good, warned = source_files.indexable(source_files.scan(spark, str(tmp_path)), source_files.gitignore(str(tmp_path)))
    assert sorted(r.path for r in good.collect()) == ["a b+c.py", "a.py", "pkg/b.py"]
    assert sorted(r.path for r in warned.collect()) == ["big.py", "e.go"]


def test_incremental_equals_full(spark, tmp_path):
    src, a, b = tmp_path / "src", store.Index(spark, str(tmp_path / "a")), store.Index(spark, str(tmp_path / "b"))
    write(src, {"m.py": "def foo():\n    return bar()\n", "n.py": "def bar():\n    return 1\n", "old.py": "def old():\n    foo()\n"})
    first, warnings = a.build(str(src))
    assert not warnings and first["edges"].count() > 0
    before = content(first)
    assert content(a.build(str(src))[0]) == before
    write(src, {"n.py": "def bar():\n    return 2\n\ndef more():\n    foo()\n", "bad.py": "def ("})
    os.remove(src / "old.py")
    again, warnings = a.build(str(src))
    assert warnings == [("bad.py", "can't be parsed")]
    assert content(again) == content(b.build(str(src))[0])
    names = {r.name for r in again["nodes"].collect()}
    assert "old" not in names and "more" in names
    assert schemas.violations(again["nodes"], "nodes").count() == 0
    assert a.meta()["total_nodes"] == str(again["nodes"].count())


def test_index_in_a_store_by_uri(spark, tmp_path):
    write(tmp_path / "src", {"m.py": "import n\n\ndef foo():\n    return 1\n"})
    index = store.Index(spark, f"file://{tmp_path}/by-uri")
    tables, _ = index.build(str(tmp_path / "src"))
    assert tables["nodes"].count() == 2 and index.schema_version() == schemas.SCHEMA_VERSION
    with index.lock(), pytest.raises(BlockingIOError), index.lock():
        pass
    index.reset()
    assert not index.exists() and index.read()["nodes"].count() == 0


def test_enrichment_is_kept_for_equal_content(spark):
    stamp = spark.sql("select timestamp'2024-01-01' t").first().t
    old = frame(spark, [node("a", "function", "f", 1, 1, 0, enriched_at=stamp, semantic_summary="F."), node("a", "function", "g", 2, 2, 1, enriched_at=stamp, raw_source="one")], schemas.NODE)
    new = frame(spark, [node("a", "function", "f", 1, 1, 0), node("a", "function", "g", 2, 2, 1, raw_source="two")], schemas.NODE)
    paths = spark.createDataFrame([("a",)], "path string")
    assert {r.name: r.semantic_summary for r in store.replace_nodes(old, new, paths).collect()} == {"f": "F.", "g": None}
    assert {r.semantic_summary for r in store.replace_nodes(old, new, paths, "file").collect()} == {None}


def test_upserts(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in store.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, o int, v string")
    assert sorted(r.v for r in store.last_wins(rows, ["k"], ["o"]).collect()) == ["y", "z"]


def test_lock(spark, tmp_path):
    index, held, go = store.Index(spark, str(tmp_path)), threading.Event(), threading.Event()

    def hold():
        with index.lock():
            held.set()
            go.wait(20)

    t = threading.Thread(target=hold)
    t.start()
    held.wait(20)
    with pytest.raises(BlockingIOError), index.lock():
        pass
    go.set()
    t.join()
    with index.lock():
        pass


REPLY = '```json\n{"semantic_summary": "S", "domain_tags": ["t"], "inferred_responsibility": "R", "summary": "S", "responsibility": "R"}\n```'


def test_replies(spark):
    rows = [(1, REPLY), (2, "{}"), (3, "prose"), (4, None), (5, '{"semantic_summary": "S", "domain_tags": "t", "inferred_responsibility": "R"}')]
    got = {r.k: r.r for r in spark.createDataFrame(rows, "k int, x string").select("k", enrichment.parse_reply("x").alias("r")).collect()}
    assert got[1].domain_tags == ["t"] and [got[k] for k in (2, 3, 4, 5)] == [None] * 4


def test_prompts_and_context(spark):
    tables, ids = search_tables(spark)
    context = {r.id: r for r in enrichment.context(tables["nodes"], tables["edges"]).collect()}
    assert context[ids["parse_file"]].callers == "['parse_directory']" and context[ids["parse_file"]].callees == "['get_connection']"
    assert context[ids["Parser"]].parent == "none" and context[ids["Parser"]].children == "[]"
    prompts = enrichment.node_prompts(tables["nodes"], tables["edges"])
    assert prompts.count() == 4 and all("Kind: " in r.prompt for r in prompts.collect())


def test_call_tries_again():
    tries = []

    def model(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise TimeoutError
        return "yes"

    assert enrichment.call(model, "p", wait=0) == "yes" and len(tries) == 3
    assert enrichment.call(lambda _: 1 / 0, "p", wait=0) is None
    assert "abcdef123" not in enrichment.safe_error(ValueError("bad key sk-abcdef123456"))
    assert enrichment.minutes(601) == 2


def stub(prompt):
    return None if "Name: broken" in prompt else REPLY


def test_enrichment_levels(spark, tmp_path):
    index = store.Index(spark, str(tmp_path / "i"))
    write(tmp_path / "src", {"a/m.py": "def foo():\n    return 1\n\ndef broken():\n    return 2\n", "top.py": "def bar():\n    return 1\n"})
    tables, _ = index.build(str(tmp_path / "src"))
    nodes = enrichment.enrich_nodes(tables["nodes"], tables["edges"], stub, "stub")
    tables = index.write({"nodes": nodes})
    assert {r.name for r in enrichment.unenriched(tables["nodes"]).where("node_type <> 'file' and name not like 'merged%'").collect()} == {"broken"}
    tables = index.write({"nodes": enrichment.enrich_files(tables["nodes"], stub, "stub")})
    assert enrichment.unenriched(tables["nodes"]).where("node_type = 'file'").count() == 0
    dirs = enrichment.enrich_directories(tables["nodes"], tables["directories"], stub, "stub")
    assert sorted(r.dir_path for r in dirs.collect()) == [".", "a"] and {r.summary for r in dirs.collect()} == {"S"}


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    src, at = tmp_path / "src", str(tmp_path / "index")
    write(src, {"m.py": "def parse_file():\n    return other()\n\nclass Thing:\n    pass\n", "n.py": "import m\n\ndef other():\n    parse_file()\n"})
    assert cli.main(["--index", at, "status"]) == 1
    assert cli.main(["--index", at, "reset"]) == 1
    assert cli.main(["--index", at, "build", "--root", str(src)]) == 0
    assert ".lodegrid/" in (src / ".gitignore").read_text()
    capsys.readouterr()
    assert cli.main(["--index", at, "query", "parse_file", "--format", "text"]) == 0
    assert "other" in capsys.readouterr().out
    assert cli.main(["--index", at, "query", " "]) == 2
    assert cli.main(["--index", at, "query", "m.py::function::parse_file", "--type", "graph", "--format", "jsonl"]) == 0
    assert "other" in capsys.readouterr().out
    assert cli.main(["--index", at, "enrich", "--dry-run"]) == 0
    assert cli.main(["--index", at, "status"]) == 0
    assert "Nodes:" in capsys.readouterr().out
    assert cli.main(["--index", at, "reset", "--yes"]) == 0
    assert cli.main(["--index", at, "query", "parse file"]) == 1


def test_stream_refreshes_an_index(spark, tmp_path):
    index, src = store.Index(spark, str(tmp_path / "i")), tmp_path / "src"
    write(src, {"m.py": "import n\n\ndef foo():\n    return bar()\n"})
    refresh(index, str(src), str(tmp_path / "c"), once=True).awaitTermination()
    write(src, {"n.py": "def bar():\n    return 1\n"})
    refresh(index, str(src), str(tmp_path / "c"), once=True).awaitTermination()
    tables = index.read()
    assert {r.name for r in tables["nodes"].where(F.col("node_type") == "function").collect()} == {"foo", "bar"}
    assert tables["edges"].where("edge_type = 'calls'").count() == 1
    os.remove(src / "n.py")
    clock = removals(index, str(src), str(tmp_path / "r"), 1)
    deadline = time.monotonic() + 120
    while time.monotonic() < deadline and index.read()["files"].count() > 1:
        time.sleep(1)
    clock.stop()
    tables = index.read()
    assert {r.name for r in tables["nodes"].where(F.col("node_type") == "function").collect()} == {"foo"}
    assert tables["edges"].count() == 0 and tables["lines"].where("file_path = 'n.py'").count() == 0 and sweep(index, str(src)) == 0


def everything(tables):
    """Content of all tables that follow from files, but for when it was made."""
    found = {n: sorted(map(str, map(tuple, tables[n].collect()))) for n in ("lines", "mentions", "names", "edges")}
    found["nodes"] = sorted(map(str, map(tuple, tables["nodes"].drop("enriched_at").collect())))
    found["files"] = sorted(tuple(r) for r in tables["files"].select("path", "content_hash", "node_count").collect())
    return found


def ranks(index, nodes, phrases):
    """What full-text search finds by the stored index, and by one made from the nodes."""
    stored = [(r.id, round(r.score, 9), r.rank) for r in bm25.top(index, phrases, None, 5).orderBy("rank").collect()]
    fresh = bm25.top(bm25.postings(nodes), phrases, nodes.select("id"), 5).orderBy("rank").collect()
    return stored, [(r.id, round(r.score, 9), r.rank) for r in fresh]


def test_random_edits_equal_a_fresh_build(spark, tmp_path, monkeypatch):
    """Files changed, broken, mended and removed, by Python and Ruby names (some no words): as a build from nothing, segments merged or not."""
    monkeypatch.setattr(bm25, "BLOCK", 2)
    monkeypatch.setattr(store, "FAN", 2)
    monkeypatch.setattr(store, "ENDED_FILES", 1)
    rng, src, index = random.Random(11), tmp_path / "src", store.Index(spark, str(tmp_path / "i"))
    names = ["alpha", "beta", "gamma", "delta", "valid?", "save!"]

    def text(kind):
        own, used = rng.choice(names), [rng.choice(names) for _ in range(3)]
        if kind == "py":
            word = own.rstrip("?!")
            return f"def {word}():\n    return {used[0].rstrip('?!')}() + {used[1].rstrip('?!')}()\n\nclass {word.title()}:\n    def {rng.choice(names).rstrip('?!')}(self):\n        {used[2].rstrip('?!')}\n"
        return f"class {own.rstrip('?!').title()}\n  def {own}\n    {used[0]}\n    {used[1]} # {used[2]}\n  end\nend\n"

    paths = ["a/m.py", "a/n.py", "b/o.py", "r/p.rb", "r/q.rb", "top.rb"]
    write(src, {p: text(p[-2:]) for p in paths})
    index.build(str(src))
    for step in range(4):
        some = rng.sample(paths, 2)
        write(src, {some[0]: text(some[0][-2:])})
        if (src / some[1]).exists() and step % 2:
            os.remove(src / some[1])
        else:
            write(src, {some[1]: text(some[1][-2:])})
        write(src, {"bad.py": "def (" if step in (0, 1) else "def beta():\n    return alpha()\n"})
        tables, _ = index.build(str(src))
        if step == 3:
            fresh = store.Index(spark, str(tmp_path / f"fresh{step}"))
            want = everything(fresh.build(str(src))[0])
            assert everything(tables) == want and want["edges"]
            assert any("?" in e or "!" in e for e in want["names"])
            for query in ([("alpha",)], [("alpha",), ("beta",)], [("valid",)], [("def", "x")], [("m", "py")]):
                stored, again = ranks(index.full_text(), tables["nodes"], query)
                assert stored == again
            old, new = index.full_text(), fresh.full_text()
            counts = lambda t: sorted(tuple(r) for r in t.groupBy("term").agg(F.sum("n").alias("n")).where("n <> 0").collect())
            assert counts(old.terms) == counts(new.terms) and old.total().first() == new.total().first()
    assert all(len(s) <= 3 for s in index.state()["tables"].values())


def test_bytes_written_follow_the_change(spark, tmp_path):
    src, index = tmp_path / "src", store.Index(spark, str(tmp_path / "i"))
    body = "\n".join(f"def f{{0}}_{i}():\n    return f{{1}}_{i}()\n" for i in range(20))
    write(src, {f"m{i}.py": body.format(i, (i + 1) % 30) for i in range(30)})
    index.build(str(src))
    whole = index.state()["tables"]
    write(src, {"m7.py": body.format(7, 9)})
    tables, _ = index.build(str(src))
    after = index.state()["tables"]
    for name in ("nodes", "lines", "mentions", "names", "edges", "postings"):
        assert after[name][:-1] == whole[name]  # the first build's files are as they were
        new = store.Index.live(index, name, index.state(), after[name][-1:])
        total = tables[name].count() if name in tables else 1
        assert new.count() <= total / 10
    touched = index.live("edges", index.state(), after["edges"][-1:])
    assert {r[0] for r in touched.select("source_path").distinct().collect()} <= {"m7.py", "m6.py"}
    assert tables["edges"].where("source_path = 'm7.py' AND target_path = 'm9.py'").count() == 20
    assert tables["edges"].where("source_path = 'm7.py' AND target_path = 'm8.py'").count() == 0


def test_enrichment_asks_each_prompt_once(spark, tmp_path):
    """As the command line does it: each call leaves a file, and all that is stored describes the same reply."""
    src, calls, index = tmp_path / "src", tmp_path / "calls", store.Index(spark, str(tmp_path / "i"))
    calls.mkdir()
    write(src, {"a.py": "def foo():\n    return 1\n\ndef bar():\n    return foo()\n", "b.py": "def other():\n    return 1\n"})
    tables, _ = index.build(str(src))
    at = str(calls)

    def model(prompt):
        name = uuid.uuid4().hex
        with open(f"{at}/{name}", "w") as f:
            f.write(prompt)
        return json.dumps({"semantic_summary": f"told{name}", "domain_tags": [], "inferred_responsibility": "R"})

    edges, nodes = sorted(map(tuple, tables["edges"].collect())), tables["nodes"].count()
    prompts = enrichment.node_prompts(tables["nodes"], tables["edges"])
    n = prompts.count()
    tables = index.enriched(enrichment.answered_nodes(tables["nodes"], enrichment.replies(prompts, model), "stub"))
    assert len(list(calls.iterdir())) == n > 0
    told = {r.semantic_summary for r in tables["nodes"].where("enriched_at IS NOT NULL").collect()}
    assert len(told) == n and told == {f"told{f.name}" for f in calls.iterdir()}
    for summary in told:
        assert bm25.top(index.full_text(), [(summary,)], None, 5).count() == 1
    assert sorted(map(tuple, tables["edges"].collect())) == edges and tables["nodes"].count() == nodes


def test_older_index_is_read_and_upgraded(spark, tmp_path):
    src, index, old = tmp_path / "src", store.Index(spark, str(tmp_path / "i")), store.Index(spark, str(tmp_path / "old"))
    write(src, {"a.py": "def foo():\n    return bar()\n", "b.py": "def bar():\n    return 1\n"})
    tables, _ = index.build(str(src))
    for n in ("nodes", "files", "lines", "meta", "directories"):
        tables[n].write.parquet(f"{tmp_path}/old/snapshot-1/{n}")
    tables["edges"].select(*[f.name for f in schemas.EDGE.fields]).write.parquet(f"{tmp_path}/old/snapshot-1/edges")
    (tmp_path / "old" / "CURRENT").write_text(json.dumps({"snapshot": "snapshot-1", "schema_version": 2}))
    assert everything(old.read()) == everything(tables)
    assert bm25.top(old.full_text(), [("bar",)], None, 5).count() > 0
    old.upgrade()
    assert old.schema_version() == schemas.SCHEMA_VERSION and everything(old.read()) == everything(tables)


def test_calls_are_made_once_though_a_task_is_lost(spark, tmp_path):
    """A worker dies in the middle; Spark runs its task again; then all is evaluated twice, and by a second run."""
    prompts = spark.createDataFrame([(f"n{i}", f"prompt {i % 25}") for i in range(30)], "id string, prompt string")
    calls, marker = tmp_path / "calls", tmp_path / "died"
    calls.mkdir()
    where, died = str(calls), str(marker)

    def model(prompt):
        if prompt == "prompt 13" and not os.path.exists(died):
            open(died, "w").close()
            raise SystemExit(1)  # no Exception: the task fails
        with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
            f.write(prompt)
        return None if prompt == "prompt 7" else f"reply to {prompt}"

    ledger = f"file://{tmp_path}/ledger"
    told = enrichment.replies_once(prompts, model, ledger, concurrency=4, every=1)
    want = {f"n{i}": None if i % 25 == 7 else f"reply to prompt {i % 25}" for i in range(30)}
    if spark.sparkContext.master.startswith("local["):  # a local master gives a task one try: the run fails, and is started again
        with pytest.raises(Exception):  # noqa: B017
            told.collect()
    assert marker.exists()
    told = enrichment.replies_once(prompts, model, ledger, concurrency=4, every=1)
    assert {r.id: r.reply for r in told.collect()} == want
    assert {r.id: r.reply for r in told.collect()} == want
    again = enrichment.replies_once(prompts, model, ledger, concurrency=4)
    assert {r.id: r.reply for r in again.collect()} == want
    made = sorted(f.read_text() for f in calls.iterdir())
    assert sorted(set(made)) == sorted({f"prompt {i}" for i in range(25)})
    assert all(made.count(p) == 1 for p in set(made) - {"prompt 7"})  # the one without a reply is tried again


def test_lexical_search_by_stored_words(spark, tmp_path):
    src, index = tmp_path / "src", store.Index(spark, str(tmp_path / "i"))
    write(src, {"a.py": "import b\n\ndef parse_file(p):\n    return b.open_it(p)\n", "b.py": "def open_it(p):\n    # b.open_it, parse_file\n    return p\n", "broken.py": "def (\nparse_file open_it\n"})
    tables, _ = index.build(str(src))
    for name in ("parse_file", "b.open_it", "open_it(p", "absent"):
        rows = [sorted(map(tuple, search.lexical(name, tables["nodes"], tables["lines"], mentions=m).collect())) for m in (None, tables["mentions"])]
        assert rows[0] == rows[1] and (rows[0] or name == "absent")
