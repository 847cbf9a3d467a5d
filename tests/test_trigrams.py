"""Grep by three-character pieces against matching every line."""

import random
import re

import pytest

from lodegrid.operators import trigrams


@pytest.mark.parametrize("pattern,needs", [
    ("abc", [{"abc"}]), ("ab", None), ("a.*defg", [{"defg"}]), ("(foo|bar|x)z", None), ("(foo|barn)z.*qux", [{"foo", "qux"}, {"barn", "qux"}]), ("(abc)+x?def", [{"abc", "def"}]),
    ("(abc)*def", [{"def"}]), ("(?i)abc", None), (r"\p{L}abc", None), (r"\bclass\s+Foo\b", [{"class", "Foo"}]), ("[a-z]{3}", None), ("(?:abc|(?i:def))ghi", [{"abc", "ghi"}, {"ghi"}]), ("(?:abc|(?i:def))", None),
])
def test_required_literals(pattern, needs):
    found = trigrams.required(pattern)
    assert (found is None and needs is None) or sorted(map(sorted, found)) == sorted(map(sorted, needs))


def test_grep_equals_matching_all_lines(spark, tmp_path):
    rng = random.Random(1)
    text = lambda: "".join(rng.choice("abcd é😀.(") for _ in range(rng.randrange(40)))
    rows = [(f"f{i % 7}", i, text()) for i in range(400)] + [("f", 1, None), ("f", 2, ""), ("f", 3, "ab"), ("f", 4, "abcabcabcabc"), ("f", 5, "abcabcabcabc")]
    lines = spark.createDataFrame(rows, "file_path string, line_no int, text string")
    grams = trigrams.write(trigrams.index(lines), f"{tmp_path}/grams")
    literals = ["abc", "cabcab", "ab", "abcd", "é😀.", "zzz", "abcabcabcabc", "aaaa"] + [r[2][3:9] for r in rows[:40] if r[2] and len(r[2]) > 9]
    for x in literals[:16]:
        got = sorted((r.file_path, r.line_no) for r in trigrams.grep(lines, grams, x, True).collect())
        assert got == sorted((f, n) for f, n, t in rows if t and x in t), x
    for x in ["abc.*bcd", "(abc|bca)d", "a[bc]a", "(?i)ABC", "(abc)+", "abc|.d"]:
        got = sorted((r.file_path, r.line_no) for r in trigrams.grep(lines, grams, x).collect())
        assert got == sorted((f, n) for f, n, t in rows if t and re.search(x, t)), x
    starts = trigrams.places(grams, "abcabc").where("line_no = 4").select("start").collect()
    assert sorted(r.start for r in starts) == [1, 4, 7]
    assert trigrams.grep(lines.limit(0), grams.limit(0), "abc").collect() == []


def test_only_candidates_are_read(spark):
    lines = spark.createDataFrame([("f", i, f"line {i} abc{i}") for i in range(100)], "file_path string, line_no int, text string")
    found = trigrams.candidates(trigrams.index(lines), trigrams.required("abc4[0-9]|xyzzy"))
    assert {r.line_no for r in found.collect()} == {4, *range(40, 50)}
