"""Set join, components, fingerprints."""

import collections
import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest

from lodegrid.llm import hot, minhash, set_join
from lodegrid.llm.components import components
from lodegrid.llm.scratch import Scratch
from tests.llm.helpers import DOCS, clash, jaccard_classes, odd_docs, thue_morse


def edited(rng, text, rate):
    return " ".join(f"e{rng.randrange(10**6)}" if rng.random() < rate else w for w in text.split())


def families(rng, n, sizes, rates):
    docs = []
    for size in sizes:
        base = " ".join(f"b{rng.randrange(10**5)}" for _ in range(rng.randrange(5, 300)))
        docs += [edited(rng, base, rng.choice(rates)) for _ in range(size)]
    docs += [" ".join(f"u{rng.randrange(10**5)}" for _ in range(rng.randrange(1, 80))) for _ in range(n)]
    rng.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize("k,percent", [(3, 90), (5, 80), (1, 50)])
def test_join_is_exact(spark, k, percent):
    rng = random.Random(k)
    docs = families(rng, 40, [1, 2, 3, 8, 20, 40], [0, 0.002, 0.005, 0.01, 0.02, 0.05])
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, t + " " + passage if i % 3 == 0 else t) for i, t in docs]
    found = set_join.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), set_join.Rule(k, percent))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_classes(docs, k, percent)


def test_large_families_are_worked_through_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(set_join, "BLOCK", 16)
    rng = random.Random(9)
    docs = families(rng, 10, [120, 60], [0.004, 0.01, 0.02])
    found = set_join.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), set_join.Rule(3, 90))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_classes(docs, 3, 90)


@pytest.mark.parametrize("bits", [3, 7])
def test_sets_that_share_a_name_are_told_apart(spark, bits):
    rng = random.Random(31)
    docs = families(rng, 40, [2, 6, 12], [0, 0.004, 0.01])
    found = set_join.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), set_join.Rule(3, 90, name_bits=bits))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_classes(docs, 3, 90)


def test_constructed_words_make_no_links(spark):
    a, b = thue_morse(1024), thue_morse(1024, True)
    docs = [(1, f"{a} x y z"), (2, f"{b} x y z"), (3, a), (4, b), (5, f"{a} x y z")]
    found = set_join.classes(spark.createDataFrame(docs, "doc_id bigint, text string"), set_join.Rule(3, 90)).collect()
    assert {r.doc_id: r.component_id for r in found} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}


def test_bound_on_missed_links():
    """Fewer segments than differing tokens: pairs without a common signature are as rare as proved."""
    rng = np.random.default_rng(8)
    rule, n, drawn = set_join.Rule(3, 90, odds=2.0), 600, 400
    d = rule.differ(n)
    missed = 0
    for _ in range(drawn):
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[d // 2 :], rng.integers(0, 1 << 62, d // 2).astype(np.uint64)]))
        signatures, owner = set_join.segment_signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), rule)
        assert len(signatures[owner == 0]) < 3 * d
        missed += not set(signatures[owner == 0].tolist()) & set(signatures[owner == 1].tolist())
    assert missed / drawn < 1.2 * np.exp(-2.0)


def test_hot_keys_join_as_any(spark, monkeypatch):
    monkeypatch.setattr(hot, "LEAST", 5)
    rows = [(i, None if i % 11 == 0 else i % 7 if i % 2 else 1000 + i) for i in range(400)]
    n = collections.Counter(k for _, k in rows)
    table = [(k, f"v{k}", c) for k, c in n.items() if k is not None and k % 5]
    got = hot.by_key(spark.createDataFrame(rows, "id bigint, k bigint"), spark.createDataFrame(table, "k bigint, v string, key_rows bigint"), "k", 400).collect()
    known = {k: v for k, v, _ in table}
    assert sorted((r.id, r.k, r.v) for r in got if r.k is not None) == sorted((i, k, known.get(k)) for i, k in rows if k is not None)
    assert [r.v for r in got if r.k is None] == [None] * n[None] and got[0].asDict().keys() == {"id", "k", "v"}


def test_join_of_odd_rows(spark):
    docs = clash(spark.createDataFrame(odd_docs(), DOCS), "set", "n", "tokens", "component")
    rows = set_join.classes(docs, set_join.Rule(3, 90)).collect()
    by = collections.defaultdict(set)
    for r in rows:
        by[r.doc_id].add((r.n_shingles, r.component_id))
    assert len(rows) == len(odd_docs())
    assert by[0] == {(0, 0)} and by[1] == {(0, 1)} and by[2] == {(0, 2)} and by[3] == {(1, 3)} and by[5] == {(9, 4)} and by[11] == {(2, 11)}
    assert {c for _, c in by[7]} == {6}
    assert set_join.classes(docs.limit(0), set_join.Rule(3, 90)).count() == 0


def test_segments_find_the_most_unlike_links():
    rng = np.random.default_rng(2)
    for percent in (80, 90):
        rule = set_join.Rule(3, percent)
        for n in (1, 2, 3, 5, 9, 17, 40, 100, 250, 600, 3000):
            for _ in range(6):
                a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
                drop = len(a) - int(np.ceil(percent * len(a) / 100))
                smaller = a[drop:]
                half = drop // 2
                other = np.unique(np.concatenate([a[half:], rng.integers(0, 1 << 62, half).astype(np.uint64)]))
                for b in (smaller, other):
                    both = len(np.intersect1d(a, b))
                    if not rule.links(both, len(a), len(b)):
                        continue
                    signatures, owner = set_join.segment_signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), rule)
                    assert set(signatures[owner == 0].tolist()) & set(signatures[owner == 1].tolist())
                    bits = [np.frombuffer(x, np.uint64) for x in set_join.bitmaps(np.concatenate([a, b]), np.array([len(a), len(b)]))]
                    assert set_join.may_link(np.array([len(a), len(b)]), bits, rule)


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, i) for i in range(501, 560)]
    parent = {}

    def find(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    expected = {a: find(a) for e in edges for a in e if e[0] != e[1]}
    got = components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()
    assert {r.node: r.component for r in got} == expected and len(got) == len(expected)


def test_fingerprints_estimate_likeness():
    rng = random.Random(6)
    base = [f"w{i}" for i in range(400)]
    texts, shares = [" ".join(base)], []
    for cut in (20, 80, 200):
        texts.append(" ".join(base[:-cut] + [f"v{rng.random()}" for _ in range(cut)]))
        shares.append((396 - cut) / (396 + cut))
    rows = minhash.fingerprint_bytes(minhash.signatures(pa.array(texts)))
    got = minhash.likeness(np.repeat(rows[:1], 3, 0), rows[1:])
    assert np.abs(got - np.array(shares)).max() < 0.13
    assert minhash.likeness(rows[:1], rows[:1])[0] == 1.0
    assert (minhash.signatures(pa.array([None, "", "  "])) == 0xFFFFFFFF).all()


def test_near_duplicates_by_bands(spark):
    rng = random.Random(21)
    docs = families(rng, 30, [2, 5, 12], [0, 0.01, 0.04])
    found = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id bigint, text string"))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == jaccard_classes(docs, 5, 80)
    assert minhash.near_duplicates(clash(spark.createDataFrame(odd_docs(), DOCS), "set")).count() == len(odd_docs())


@pytest.mark.parametrize("rows", [4096, 3])
def test_edits_by_hand(spark, monkeypatch, rows):
    monkeypatch.setattr(minhash, "RANGE_ROWS", rows)
    docs = [r for r in odd_docs() if r[0] is not None] + [(100 + i, "abc " * i, "en", "a", 0) for i in range(40)]
    frame = clash(spark.createDataFrame(docs, DOCS), "range", "guest")
    got = minhash.in_hex(minhash.against_edits(frame)).collect()
    order = sorted({r[0] for r in docs})
    texts = collections.defaultdict(set)
    for r in docs:
        texts[r[0]].add(r[1] or "")
    assert len(got) == len(docs)
    marks = {}
    for r in got:
        following = texts[order[(order.index(r.doc_id) + 1) % len(order)]] | (texts[r.doc_id] if sum(d[0] == r.doc_id for d in docs) > 1 else set())
        possible = {hashlib.sha256((t[: len(t) - len(t) // 4] + f[: len(t) // 4]).encode()).hexdigest() for t in texts[r.doc_id] for f in following}
        assert r.edited_sha256 in possible and r.n_chars in {len(t) for t in texts[r.doc_id]}
        marks.setdefault(r.doc_id, set()).add(r.fingerprint)
    # Likeness by hand: equal bytes of the fingerprints, less those equal by chance; fingerprints of edited texts alone.
    like = lambda a, b: min(1, max(0, (np.mean([x == y for x, y in zip(bytes.fromhex(a), bytes.fromhex(b), strict=True)]) - 1 / 256) / (255 / 256)))
    edits = {}
    for i in order:
        for t in texts[i]:
            for f in set().union(*texts.values()):
                e = t[: len(t) - len(t) // 4] + f[: len(t) // 4]
                edits[hashlib.sha256(e.encode()).hexdigest()] = e
    asked = sorted({r.edited_sha256 for r in got})
    prints = {r.doc_id: r.fingerprint for r in minhash.fingerprints(spark.createDataFrame([(i, edits[h]) for i, h in enumerate(asked)], "doc_id bigint, text string")).collect()}
    prints = {h: prints[i] for i, h in enumerate(asked)}
    for r in got:
        assert r.edited_fingerprint == prints[r.edited_sha256] and abs(r.near_edited - like(r.fingerprint, r.edited_fingerprint)) < 1e-12
        after = marks[order[(order.index(r.doc_id) + 1) % len(order)]] | (marks[r.doc_id] if sum(d[0] == r.doc_id for d in docs) > 1 else set())
        assert any(abs(r.near_next - like(r.fingerprint, x)) < 1e-12 for x in after)
    assert minhash.against_edits(frame.limit(0)).count() == 0
    lone = minhash.against_edits(spark.createDataFrame([(1, "a b c d e f g h")], "doc_id bigint, text string")).collect()
    assert len(lone) == 1 and lone[0].near_next == 1.0
    assert minhash.fingerprints(frame).count() == len(docs)


def test_fingerprints_with_classes(spark):
    rng = random.Random(22)
    docs = families(rng, 30, [2, 5, 12], [0, 0.01, 0.04])
    found = minhash.with_classes(spark.createDataFrame(docs, "doc_id bigint, text string")).collect()
    assert {r.doc_id: r.near_class for r in found} == {i: c for i, (_, c) in jaccard_classes(docs, 5, 80).items()} and len(found) == len(docs)
    odd = minhash.with_classes(spark.createDataFrame(odd_docs(), DOCS)).collect()
    assert len(odd) == len(odd_docs()) and {r.near_class for r in odd if r.doc_id == 7} == {6} and {r.near_class for r in odd if r.doc_id == 5} == {4}
    one = {"a": random.Random(1), "b": random.Random(2)}
    same = " ".join(f"s{one['a'].randrange(9999)}" for _ in range(200))
    part = same.split()
    for cut in (5, 20, 60):
        near = " ".join(part[:-cut] + [f"t{one['b'].randrange(9999)}" for _ in range(cut)])
        a, b = ({tuple(t.split()[i : i + 5]) for i in range(196)} for t in (same, near))
        got = minhash.likeness(*(minhash.fingerprint_bytes(minhash.signatures(pa.array([t]))) for t in (same, near)))[0]
        assert abs(got - len(a & b) / len(a | b)) < 0.13
