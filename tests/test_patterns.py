"""Many names at once against a pattern for each."""

import random
import re

import pytest

from lodegrid.operators import patterns


@pytest.mark.parametrize("block", [200_000, 3])
def test_equals_one_pattern_a_name(spark, monkeypatch, block):
    monkeypatch.setattr(patterns, "BLOCK_NAMES", block)
    rng = random.Random(3)
    bits = ["valid?", "valid", "a.b", "a", "b", "++", "é", "é́", "_", " ", " ", "😀", "x1", "²", "save!", "::", "(", "Kelvin"]
    names = sorted({"".join(rng.choice(bits) for _ in range(rng.randrange(1, 4))) for _ in range(60)} - {""})
    rows = [(f"f{i % 5}", i, "".join(rng.choice(bits) for _ in range(rng.randrange(20)))) for i in range(300)] + [("f", 1, None), ("f", 2, "")]
    lines = spark.createDataFrame(rows, "file_path string, line_no int, text string")
    given = spark.createDataFrame([(n,) for n in names + names[:3] + ["", None]], "name string")
    got = sorted(tuple(r) for r in patterns.match(lines, given).collect())
    word = lambda c: c != "²" and (bool(re.match(r"\w", c)) or c == "́")
    want = []
    for f, n, t in rows:
        for name in names:
            at = [m.start() for m in re.finditer(f"(?={re.escape(name)})", t or "")]
            if any(not (i and word(t[i - 1])) and not (i + len(name) < len(t) and word(t[i + len(name)])) for i in at):
                want.append((f, n, name))
    assert got == sorted(want) and len(want) > 300
    assert patterns.match(lines, given.limit(0)).collect() == [] and patterns.match(lines.limit(0), given).collect() == []


def test_workers_are_sent_few_bytes_of_lines_at_once(spark):
    limit = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(limit)
    lines, names = spark.createDataFrame([("a", 1, "go run")], "file_path string, line_no int, text string"), spark.createDataFrame([("run",)], "name string")
    assert patterns.match(lines, names).count() == 1 and int(spark.conf.get(limit)) == patterns.BATCH_BYTES
