import random
import zlib

import pytest
from pyspark.sql import functions as F

from lodegrid import schemas
from lodegrid.operators import edges, graph
from lodegrid.operators.resolve import innermost
from tests.fixtures import frame, node, search_tables


def test_innermost_prefers_short_spans_then_order(spark):
    nodes = frame(spark, [node("a", "file", "a", 1, 600, 0), node("a", "class", "C", 2, 10, 1), node("a", "method", "m", 2, 10, 2), node("a", "method", "n", 250, 260, 3)], schemas.NODE)
    lines = spark.createDataFrame([("a", 1), ("a", 5), ("a", 255), ("a", 700), ("b", 1), ("a", 5)], "file_path string, line_no int")
    found = sorted((r.line_no, r.node_name) for r in innermost(lines, nodes, ["name"]).collect())
    assert found == [(1, "a"), (5, "C"), (5, "C"), (255, "n")]


def test_classification(spark):
    cases = [
        ("file", "class", 0, 0, "imports"), ("method", "method", 1, 0, "overrides"), ("method", "method", 1, 1, "calls"), ("method", "method", 0, 0, "calls"), ("class", "interface", 0, 0, "inherits"),
        ("function", "class", 0, 0, "instantiates"), ("function", "interface", 0, 0, "references"), ("object", "class", 0, 0, "references"), ("class", "function", 0, 0, "calls"), ("class", None, 0, 0, "references"),
    ]
    rows = spark.createDataFrame([(a, b, bool(c), bool(d), e) for a, b, c, d, e in cases], "a string, b string, c boolean, d boolean, e string")
    assert rows.where(edges.classify(F.col("a"), F.col("b"), F.col("c"), F.col("d")) != F.col("e")).count() == 0


def test_edges_by_name(spark):
    nodes = [
        node("a.py", "file", "a.py", 1, 9, 0), node("a.py", "function", "greet", 1, 5, 1), node("b.py", "file", "b.py", 1, 9, 0), node("b.py", "function", "run", 2, 6, 1),
        node("c.rb", "method", "valid?", 1, 3, 0, qualified="C.valid?"), node("c.rb", "method", "m", 5, 7, 1, qualified="C.m"),
    ]
    lines = [("a.py", 1, "def greet():"), ("b.py", 1, "from a import greet"), ("b.py", 3, "greet(greet)"), ("b.py", 8, "greeting"), ("c.rb", 6, "valid?(x) if greet"), ("c.rb", 2, "valid")]
    found = edges.build_edges(frame(spark, nodes, schemas.NODE), spark.createDataFrame(lines, schemas.LINE))
    got = sorted((r.source_id.split("::")[-1], r.target_id.split("::")[-1], r.edge_type, r.call_site_line) for r in found.collect())
    assert got == [("C.m", "C.valid?", "calls", 6), ("C.m", "greet", "calls", 6), ("b.py", "greet", "imports", 1), ("run", "greet", "calls", 3)]


def test_maintenance(spark):
    tables, ids = search_tables(spark)
    nodes, found = tables["nodes"], tables["edges"]
    bad = found.unionByName(spark.createDataFrame([(ids["Parser"], "gone", "calls", 1)], schemas.EDGE))
    assert edges.dangling(bad, nodes).count() == 1 and edges.purge_dangling(bad, nodes).count() == 3 and schemas.cascade(bad, nodes).count() == 3
    only = nodes.where(F.col("name") == "parse_file").select("id")
    assert edges.delete_outbound(found, only).count() == 2
    assert sorted(r.id for r in edges.distinct_callers(found, only).collect()) == sorted([ids["Parser"], ids["parse_directory"]])
    near = {r.id: (r.callers, r.callees) for r in edges.neighbours(found, nodes).collect()}
    assert near[ids["parse_file"]] == (["parse_directory"], ["get_connection"]) and near[ids["Parser"]] == ([], [])
    assert schemas.violations(found, "edges").count() == 0
    assert {r.problem for r in schemas.violations(found.unionByName(found).withColumn("edge_type", F.lit("odd")), "edges").collect()} == {"edge_type", "key"}


def test_kinship(spark):
    nodes = frame(spark, [node("a", "class", "C", 1, 9, 0), node("a", "method", "x", 2, 3, 1, qualified="C.x"), node("a", "method", "y", 4, 5, 2, qualified="C.y"), node("b", "method", "z", 1, 1, 0, qualified="C.z")], schemas.NODE)
    assert {r.id.split("::")[-1]: r.parent for r in edges.kinship(nodes).collect()} == {"C": None, "C.x": "C", "C.y": "C", "C.z": None}
    assert [r.children for r in edges.children(nodes).collect()] == [["C.x", "C.y"]]


def brute(pairs, root, depth, direction):
    seen, now = {root: 0}, {root}
    for hop in range(1, depth + 1):
        out = {b for a, b in pairs if a in now and direction != "inbound"} | {a for a, b in pairs if b in now and direction != "outbound"}
        now = out - seen.keys()
        seen |= dict.fromkeys(now, hop)
    return seen


@pytest.mark.parametrize("direction", graph.DIRECTIONS)
def test_reach_as_by_hand(spark, direction):
    random.seed(5)
    pairs = [(f"x{random.randrange(30)}", f"x{random.randrange(30)}") for _ in range(45)]
    found = graph.reach("x1", spark.createDataFrame([(a, b, "calls", 0) for a, b in pairs], schemas.EDGE), 4, direction)
    assert {r.id: r.hop for r in found.collect()} == brute(pairs, "x1", 4, direction)


@pytest.mark.parametrize("direction", graph.DIRECTIONS)
def test_stored_steps_as_by_hand(spark, tmp_path, direction):
    random.seed(6)
    pairs = [(f"x{random.randrange(30)}", f"x{random.randrange(30)}") for _ in range(45)] + [("x1", "x1")]
    rows = [(a, b, "calls", 0) for a, b in pairs + pairs[:5]] + [("x1", None, "calls", 0), (None, "x2", "calls", 0), ("x1", "x99", "imports", 0)]
    kept = graph.Adjacency.write(spark.createDataFrame(rows, "source_id string, target_id string, edge_type string, call_site_line int"), str(tmp_path / "steps"), buckets=7)
    assert {r.id: r.hop for r in kept.reach("x1", 4, direction, ["calls"]).collect()} == brute(pairs, "x1", 4, direction)
    assert kept.reach("x1", 4, direction, limit=5).collect() == kept.reach("x1", 4, direction).limit(5).collect()
    assert [r.id for r in graph.Adjacency(spark, str(tmp_path / "steps")).reach("nothing", 3).collect()] == ["nothing"]


def test_a_round_reads_the_buckets_of_its_frontier_alone(spark, tmp_path):
    """A chain in one bucket each and a hub elsewhere: what is not on the way can be gone."""
    rows = [(f"a{i}", f"a{i + 1}", "calls", 0) for i in range(6)] + [("hub", f"h{i}", "calls", 0) for i in range(5000)]
    kept = graph.Adjacency.write(spark.createDataFrame(rows, schemas.EDGE), str(tmp_path / "steps"), buckets=64)
    needed = {f"bucket={zlib.crc32(f'a{i}'.encode()) % 64}" for i in range(4)}
    for folder in (tmp_path / "steps" / "buckets=64").iterdir():
        if folder.name not in needed:
            folder.rename(tmp_path / folder.name)
    assert [r.id for r in kept.reach("a0", 4, "outbound").collect()] == ["a0", "a1", "a2", "a3", "a4"]


def test_hub_and_empty_graph(spark, tmp_path):
    rows = [("hub", f"h{i:05}", "calls", 0) for i in range(5000)]
    kept = graph.Adjacency.write(spark.createDataFrame(rows, schemas.EDGE), str(tmp_path / "hub"))
    found = kept.reach("hub", 2, "outbound").collect()
    assert len(found) == 1000 and found[1].id == "h00000" and found[-1].id == "h00998"
    none = graph.Adjacency.write(spark.createDataFrame([], schemas.EDGE), str(tmp_path / "none"))
    assert [(r.id, r.hop) for r in none.reach("hub", 2).collect()] == [("hub", 0)]


def test_search(spark):
    tables, ids = search_tables(spark)
    nodes, found = graph.search(ids["parse_directory"], tables["nodes"], tables["edges"], 2, None, "outbound")
    assert [r.name for r in nodes.collect()] == ["parse_directory", "parse_file", "get_connection"] and found.count() == 2
    nodes, found = graph.search(ids["parse_file"], tables["nodes"], tables["edges"], 1, ["references"])
    assert {r.name for r in nodes.collect()} == {"parse_file", "Parser"} and found.count() == 1
    assert graph.search("nothing", tables["nodes"], tables["edges"]) is None


def _tangled(spark, clean):
    """Nodes and lines with few names many times; unless ``clean``, with ids whose rows differ, rows twice and names that are no words."""
    rng = random.Random(7)
    nodes, lines = [], []
    for f in range(8):
        path = f"f{f % 7}" if not clean else f"f{f}"
        nodes.append(node(path, "file", path, 1, 12, 0))
        for i in range(6):
            kind, name = rng.choice(("function", "method", "class", "interface", "object")), rng.choice(("run", "go", "x1") if clean else ("run", "go", "go?", "x1"))
            nodes.append(node(path, kind, name, 2 * i + 1, 2 * i + 2, 10 * f + i + 1, qualified=rng.choice((name, f"C.{name}", f"D{i}.{name}")) + ("" if not clean else f"{f}{i}")))
        lines += [(path, n, " ".join(rng.choices(("run", "go?", "go", "x1", "other"), k=4))) for n in range(1, 13)]
    return frame(spark, nodes + ([] if clean else nodes[:9]), schemas.NODE), spark.createDataFrame(lines, schemas.LINE)


def _all_edges(nodes, lines):
    """Edges as the pairs of all mentions and targets, each once."""
    names = edges.exported(nodes)
    pairs = innermost(edges.mentions(lines, names), nodes, ["id", "node_type", "name", "qualified_name"]).join(names, "name").where("node_id <> target_id")
    kind = edges.classify(F.col("node_node_type"), F.col("target_type"), F.col("node_name") == F.col("name"), F.col("node_qualified_name") == F.col("target_qualified"))
    return pairs.select(F.col("node_id").alias("source_id"), "target_id", kind.alias("edge_type"), F.col("line_no").alias("call_site_line")).distinct()


@pytest.mark.parametrize("clean", [True, False])
def test_edges_by_products_are_those_of_pairs(spark, clean):
    from lodegrid.operators import enrichment

    nodes, lines = (t.cache() for t in _tangled(spark, clean))
    wanted = _all_edges(nodes, lines).cache()
    assert sorted(edges.build_edges(nodes, lines).collect()) == sorted(wanted.collect()) and wanted.where("edge_type = 'overrides'").count() > 0
    assert {tuple(r) for r in edges.histogram(nodes, lines).collect()} == {tuple(r) for r in wanted.groupBy("edge_type").count().collect()}
    sizes = enrichment.node_prompts(nodes, wanted).select("id", F.length("prompt").cast("bigint")).collect()
    assert sorted(map(tuple, enrichment.prompt_sizes(nodes, lines).collect())) == sorted(map(tuple, sizes)) and len(sizes) > 40


def test_edges_are_not_shuffled(spark):
    """Edges go on as the join makes them: nothing that gathers them is above it."""
    copies = 30
    nodes = [node(f"f{c}", "function", "run", 1, 2, 0) for c in range(copies)]
    found = edges.build_edges(frame(spark, nodes, schemas.NODE), spark.createDataFrame([(f"f{c}", 1, "run") for c in range(copies)], schemas.LINE))
    assert found.count() == copies * (copies - 1)
    assert found._jdf.queryExecution().optimizedPlan().toString().startswith("Project")


def _shuffled(df):
    """Rows that a DataFrame's exchanges write when it is collected, those that are read again once."""
    df.collect()
    found, left = 0, [df._jdf.queryExecution().executedPlan()]
    while left:
        plan = left.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            left.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            left.append(plan.plan())
        elif kind != "ReusedExchangeExec":
            found += plan.metrics().get("shuffleRecordsWritten").get().value() if kind == "ShuffleExchangeExec" else 0
            left += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def _wordy(spark, files=20, length=200):
    """Nodes and lines of files of which each calls another, among many words that are no names."""
    nodes = frame(spark, [node(f"f{i}", "function", f"name{i}", 1, 5, 0) for i in range(files)], schemas.NODE)
    lines = [(f"f{i}", n, " ".join([f"name{(i + n) % files}", *(f"w{i}_{n}_{k}" for k in range(length))])) for i in range(files) for n in range(1, 6)]
    return nodes, spark.createDataFrame(lines, schemas.LINE)


@pytest.fixture
def unbroadcast(spark):
    """Only what is to be broadcast at any size is."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_words_that_are_no_names_are_not_shuffled(spark, unbroadcast):
    found = edges.build_edges(*_wordy(spark))
    assert _shuffled(found) < 1_000 and found.count() == 100


@pytest.mark.parametrize("clean", [True, False])
def test_edges_by_small_blocks_and_a_small_filter(spark, monkeypatch, clean):
    monkeypatch.setattr(edges, "BLOCK", 2)
    monkeypatch.setattr(edges, "FILTER_BITS", 8)
    monkeypatch.setattr(edges, "HOT_SAMPLE", 1.0)
    monkeypatch.setattr(edges, "HOT_NODES", 20)
    nodes, lines = (t.cache() for t in _tangled(spark, clean))
    wanted = _all_edges(nodes, lines).cache()
    assert sorted(edges.build_edges(nodes, lines).collect()) == sorted(wanted.collect())
    assert {tuple(r) for r in edges.histogram(nodes, lines).collect()} == {tuple(r) for r in wanted.groupBy("edge_type").count().collect()}


def test_many_nodes_of_a_name_are_dealt_to_several_tasks(spark, monkeypatch, unbroadcast):
    monkeypatch.setattr(edges, "BLOCK", 10, raising=False)
    monkeypatch.setattr(edges, "HOT_NAMES", 0, raising=False)
    copies = 60
    nodes = frame(spark, [node(f"f{c}", "function", "run", 1, 2, 0) for c in range(copies)], schemas.NODE)
    found = edges.build_edges(nodes, spark.createDataFrame([(f"f{c}", 1, "run") for c in range(copies)], schemas.LINE))
    apart = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tasks = found.groupBy(F.spark_partition_id()).count().collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", apart)
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == copies * (copies - 1)


def test_frequent_names_are_looked_up_where_they_stand(spark, monkeypatch, unbroadcast):
    """Mentions of names that many lines have aren't shuffled, neither for edges nor for their sizes."""
    from lodegrid.operators import enrichment

    monkeypatch.setattr(edges, "HOT_SAMPLE", 1.0, raising=False)
    names = " ".join(f"name{k}" for k in range(40))
    nodes = frame(spark, [node(f"f{i}", "function", f"name{i}", 1, 50, 0) for i in range(40)], schemas.NODE)
    lines = spark.createDataFrame([(f"f{i}", n, names) for i in range(40) for n in range(1, 51)], schemas.LINE)
    sizes, found = enrichment.prompt_sizes(nodes, lines), edges.build_edges(nodes, lines)
    assert _shuffled(sizes) < 40_000 and found.count() == 40 * 39 * 50
    assert _shuffled(found) < 20_000
    wanted = enrichment.node_prompts(nodes, found).select("id", F.length("prompt").cast("bigint"))
    assert sorted(map(tuple, sizes.collect())) == sorted(map(tuple, wanted.collect()))
