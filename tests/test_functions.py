import pytest
from pyspark.sql import functions as F

from lodegrid.functions import query_text
from lodegrid.functions.columns import ancestors, depth, fold, index_tokens, json_strings, longest_token, parent_dir, token_estimate, word_count
from lodegrid.sources.ignore import ignored, rule

ROUTES = {
    "parse_file": "lexical", "parseFile": "lexical", "Parser.parse_file": "lexical", "parsing functions": "semantic", "validate the cart": "semantic",
    "parseFile in directory": "hybrid", "find parse_file usage": "hybrid", "Parser.parse_file callers": "hybrid", "": "semantic", "?": "semantic",
}


@pytest.mark.parametrize("text,expected", ROUTES.items())
def test_strategy(text, expected):
    assert query_text.strategy(text) == expected
    assert query_text.strategy(text, "graph") == "graph"


def test_strategy_column_agrees(spark):
    rows = spark.createDataFrame([(t,) for t in ROUTES], "t string").select("t", query_text.strategy_column("t").alias("s")).collect()
    assert {r.t: r.s for r in rows} == ROUTES


def test_phrases():
    assert query_text.phrases("parse_file Café ---") == [("parse", "file"), ("cafe",), ()]


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first().x


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/c.py",), ("c.py",), (".",)], "p string")
    found = [tuple(r) for r in rows.select(parent_dir("p"), F.array_join(ancestors("p"), ","), depth("p")).collect()]
    assert found == [("a/b", ".,a,a/b", 2), (".", ".", 0), (None, ".", -1)]


@pytest.mark.parametrize("line,n", [("foo", 1), ("foo.bar", 1), ("foobar", 0), ("foo_bar", 0), ("xfoo", 0), ("Foo", 0), ("(foo) foo", 2), ("éfoo", 0)])
def test_word_count(spark, line, n):
    assert one(spark, word_count(F.lit(line), "foo")) == n


def test_word_count_of_marks(spark):
    assert one(spark, word_count(F.lit("if valid?(x)"), "valid?")) == 1
    assert one(spark, word_count(F.lit("a \\E b"), "\\E")) == 1


def test_text(spark):
    assert one(spark, fold(F.lit("CAFÉ Ñandú"))) == "cafe nandu"
    assert one(spark, index_tokens(F.lit("parse_file.x é"))) == ["parse", "file", "x", "e"]
    assert one(spark, longest_token(F.lit("a bbb, ccc"))) == "ccc"
    assert one(spark, longest_token(F.lit("--"))) is None
    assert one(spark, token_estimate(F.lit("abc"))) == 1
    assert one(spark, token_estimate(F.lit("a" * 9))) == 2
    assert one(spark, json_strings(F.lit("[broken"))) == []
    assert one(spark, json_strings(F.lit('["a"]'))) == ["a"]


IGNORE = [
    (["*.log"], "a/b.log", True), (["*.log"], "a/b.txt", False), (["/a"], "a/x", True), (["/a"], "b/a/x", False), (["build/"], "x/build/y", True),
    (["build/"], "build", False), (["a/**/z"], "a/b/c/z", True), (["a/**/z"], "a/z", True), (["**/tmp"], "q/tmp/f", True), (["a?c"], "abc", True),
    (["a[0-9]"], "a5", True), (["a[!0-9]"], "a5", False), (["*.log", "!keep.log"], "keep.log", False), (["# x", ""], "x", False), ([], ".lodegrid/index", True),
    (["*.generated.py"], "m/x.generated.py", True), (["docs/*.md"], "docs/a/b.md", False), (["logs/**"], "logs/a/b", True),
]


def test_ignore(spark):
    for patterns, path, expected in IGNORE:
        assert one(spark, ignored(F.lit(path), patterns)) is expected, (patterns, path)
    assert rule("  ") is None
