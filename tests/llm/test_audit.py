"""The filter audit against orders applied one by one."""

import random
import re
from itertools import permutations

from pyspark.sql import functions as F

from lodegrid.llm import audit, queries, sql
from tests.llm.helpers import DOCS, clash, odd_docs

LABELS = "doc_id bigint, quality int, toxic int"


def brute(docs, labels):
    good, bad = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, text, *_ in docs:
        if i is not None:
            least[text or ""] = min(i, least.get(text or "", i))
    fails = []
    for i, text, _, source, _ in docs:
        t = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        own = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > least[t]}
        fails.append((source or "", {k for k, v in own.items() if v}, i in good, i in bad))
    out = {}
    for part in {f[0] for f in fails}:
        share = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [f for f in fails if f[0] == part]
            for step, c in enumerate(order, 1):
                hit = [f for f in left if c in f[1]]
                every = [f for f in fails if f[0] == part and c in f[1]]
                left = [f for f in left if c not in f[1]]
                share[c] += len(hit)
                out[part, "".join(order), step] = [len(left), len(hit), len(every) - len(hit), sum(f[1] == {c} for f in every), sum(f[2] for f in hit), sum(f[3] for f in hit)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(share[order[step - 1]])
    return out


def tables(rng):
    text = lambda: " ".join(rng.choice(["Word", "x", "y%", "z", f"u{rng.randrange(80)}", "QRS"][: rng.randrange(2, 7)]) for _ in range(rng.randrange(40, 70)))
    own = [text() for _ in range(60)]
    docs = [(i, rng.choice(own), "en", rng.choice(["a", "b", None, ""]), 1) for i in range(100, 300)]
    docs += [docs[0], docs[1], (100, own[3], "en", "b", 1), (None, own[4], "en", "a", 1), (None, own[4], "en", "b", 1)] + [r for r in odd_docs() if r[0] != 6]
    labels = [(i, rng.randrange(2), rng.randrange(2)) for i in range(100, 300, 2)] + [(100, 0, 0), (100, 1, 0), (None, 1, 1), (9999, 1, 1), (104, None, None)]
    return docs, labels


def test_audit_equals_brute_force(spark, tmp_path):
    docs, labels = tables(random.Random(2))
    clash(spark.createDataFrame(docs, DOCS), "part", "mask", "digest", "label", "n", "slot").write.parquet(f"{tmp_path}/documents.parquet")
    clash(spark.createDataFrame(labels, LABELS), "text", "label", "part").write.parquet(f"{tmp_path}/labels.parquet")
    got = {(r["part"], r["filter_order"], r["step"]): list(r[3:]) for r in queries.op13_audit(spark, str(tmp_path)).collect()}
    want = brute(docs, labels)
    assert len(got) == 600 * len({k[0] for k in want}) and got == want
    assert any(r[5] for r in want.values()) and any(r[3] for r in want.values())


def test_sql_agrees_on_odd_rows(spark, tmp_path):
    import duckdb

    docs, labels = tables(random.Random(3))
    spark.createDataFrame(docs, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    got = queries.op13_audit(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(con.execute(sql.OP13).fetchall())


def test_many_parts_are_let_go(spark, monkeypatch):
    docs = spark.range(50).select(F.col("id").alias("doc_id"), F.lit("One two").alias("text"), F.col("id").cast("string").alias("source"))
    labels = spark.createDataFrame([], LABELS)
    monkeypatch.setattr(audit, "PARTS_HELD", 3)
    rows = audit.audit(docs.coalesce(1), labels).where("step = 1 AND filter_order = 'EABCD'").collect()
    assert len(rows) == 50 and sum(r["removed"] for r in rows) == 49
    assert audit.audit(docs.limit(0), labels).collect() == []


def test_limits_are_parameters(spark):
    docs = spark.createDataFrame([(1, "a b c", "s")], "doc_id bigint, text string, source string")
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    rows = audit.audit(docs, labels, audit.Limits(least_words=3)).where("filter_order = 'ABCDE'").collect()
    assert [r["kept"] for r in rows] == [1] * 5
