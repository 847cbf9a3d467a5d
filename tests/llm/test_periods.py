"""Periodic runs against all periods tried one by one."""

import hashlib
import random
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodegrid.llm import periods, queries
from tests.llm.helpers import DOCS, clash, odd_docs


def brute(words, least):
    """(start, end, period) of all runs, for each stretch its least period."""
    found = {}
    for p in range(1, len(words) // 2 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j - i + p >= max(least, 2 * p):
                found.setdefault((i, j + p - 1), p)
            i = max(j, i + 1)
    return sorted(((s, e, p) for (s, e), p in found.items()), key=lambda r: (r[0], r[2]))


def texts_of(rng):
    for _ in range(rng.randrange(1, 5)):
        words = [rng.randrange(rng.choice([1, 2, 2, 3, 4, 8])) for _ in range(rng.randrange(120))]
        if words and rng.random() < 0.5:
            for i in range(rng.randrange(len(words)) + 1 + rng.randrange(20), len(words)):
                words[i] = words[i - 1 - rng.randrange(2)] if rng.random() < 0.05 else words[max(0, i - 7)]
        if rng.random() < 0.3:  # long earlier occurrences: runs that are copied
            words = words + words[: rng.randrange(len(words) + 1)] + [77] + words
        if rng.random() < 0.1:
            x, y = [0], [0, 1]
            while len(y) < 150:
                x, y = y, y + x
            words = y
        yield words


def test_runs_equal_brute_force():
    rng = random.Random(5)
    many = 0
    for _ in range(600):
        docs, least = list(texts_of(rng)), rng.choice([2, 3, 5, 6, 7, 12])
        key, part = np.array([x for d in docs for x in d], np.uint64), np.repeat(np.arange(len(docs)), [len(d) for d in docs])
        base, want = 0, []
        for d in docs:
            want += [[s + base, e + base, p] for s, e, p in brute(d, least)]
            base += len(d)
        assert periods.find_runs(key, part, least).tolist() == want, (least, docs)
        many += len(want)
    assert many > 10_000


def test_copied_runs_and_small_blocks_of_pairs(monkeypatch):
    monkeypatch.setattr(periods, "PAIRS", 7)
    one = list(range(20)) + [50, 51, 52, 53] * 5 + list(range(20, 40))
    words = one + [99] + one + [98] + one  # the second and third are strictly inside blocks
    found = periods.find_runs(np.array(words, np.uint64), np.zeros(len(words), np.int64), 12).tolist()
    assert found == [list(r) for r in brute(words, 12)] and len(found) == 3


def expected(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute(words, 12)
    gone = {i for s, e, q in runs for i in range(s + q, e + 1)}
    best = min(runs, key=lambda r: (r[0] - r[1], r[0], r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (
        doc_id, len(runs), *((best[0], best[1] - best[0] + 1, best[2], 1000 * (best[1] - best[0] + 1) // best[2]) if best else (None,) * 4),
        sha("".join(f"{s},{e - s + 1},{q}\n" for s, e, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
    )


def test_query_equals_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, " ".join(f"w{rng.randrange(6)}" for _ in range(rng.randrange(90))), "en", "a", 1) for i in range(400, 800)]
    rows += [r if r[0] != 6 and r[0] != 7 else (r[0], r[1][:9000], *r[2:]) for r in odd_docs()] + [(300, "la  la\n" * 400, "en", "a", 1), (301, " \t", "en", "a", 1)]
    clash(spark.createDataFrame(rows, DOCS), "runs", "collapsed", "best").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periods(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((expected(r[0], r[1]) for r in rows), key=key)
    assert got.where("n_runs > 0").count() > 15


def test_operator_on_odd_rows(spark):
    docs = spark.createDataFrame(odd_docs(), DOCS)
    found = periods.find(clash(docs, "runs", "key", "part"))
    assert found.columns == ["doc_id", "lang", "source", "n_chars", "key", "part", "runs", "collapsed"]
    assert found.count() == len(odd_docs()) and found.where("doc_id IN (0, 1, 2)").select("collapsed").distinct().collect() == [("",)]
    assert found.where("doc_id = 6").select(F.size("runs") == 0, F.size(F.split("collapsed", " "))).collect() == [(True, 20_000)]
    assert periods.find(docs.limit(0)).collect() == []
