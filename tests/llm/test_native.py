"""Mixing, sharding and chat formatting."""

import collections
import hashlib
import re
import zlib

from pyspark.sql import functions as F

from lodegrid.llm import chat, mixing, sharding
from tests.llm.helpers import DOCS, clash, odd_docs


def water_fill(sizes, weights, share=1.5, most=2):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = [s for s in open_ if level * w[s] > most * sizes[s]]
        if not over:
            out |= {s: level * w[s] for s in open_}
            break
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
            open_.remove(s)
    return out


def test_targets_as_by_sharing_again_and_again(spark):
    for sizes in ({"a": 100, "b": 10, "c": 1000, None: 50}, {"a": 5}, {"x": 0, "y": 7}, {str(i): (i * 37) % 101 for i in range(23)}):
        rows = mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        expected = water_fill(sizes, (3, 1, 2))
        assert all(abs(r.target - expected[r.source]) < 1e-6 for r in rows) and len(rows) == len(sizes)


def test_mix_by_hand(spark):
    rows = [(i, "w " * (i % 17), "en", f"s{i % 3}" if i % 5 else None, 0) for i in range(600)]
    docs = spark.createDataFrame(rows, DOCS)
    found = mixing.mix(docs, F.lit(1.0)).collect()
    by = collections.defaultdict(list)
    for r in found:
        assert r.size == r.doc_id % 17 and r.taken in (0, r.size, 2 * r.size)
        by[r.source].append(r)
    for own in by.values():
        taken, target = sum(r.taken for r in own), own[0].target
        assert abs(taken - target) <= 9 and own[0].source_size == sum(r.size for r in own)
        assert min(r.taken // r.size for r in own if r.size) == target // own[0].source_size
    assert sorted(map(tuple, mixing.mix(docs, F.lit(1.0)).collect()), key=str) == sorted(map(tuple, found), key=str)
    narrow = mixing.mix(docs, F.lit(1.0), narrow=True).select("doc_id", "taken").collect()
    assert {r.doc_id: r.taken for r in narrow} == {r.doc_id: r.taken for r in found}


def test_better_documents_are_drawn_first(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "en", "abc"[i // 2000], 0) for i in range(6000)], DOCS)
    good = F.when(F.col("doc_id") % 2 == 0, 4.0).otherwise(0.25)
    counts = {r.g: r.n for r in mixing.mix(docs, good).where("taken > 0 and target < source_size").groupBy((F.col("doc_id") % 2).alias("g")).agg(F.count("*").alias("n")).collect()}
    assert counts[0] > 990 and counts[1] < 700


def test_mix_of_odd_rows(spark):
    docs = clash(spark.createDataFrame(odd_docs(), DOCS), "bucket", "rest", "w", "cap", "target", "size", "taken", "epochs")
    found = mixing.mix(docs).collect()
    assert len(found) == len(odd_docs()) and {r.bucket for r in found} == {"own"}
    twice = [r.taken for r in found if r.doc_id == 11]
    assert twice[0] == twice[1]
    assert all(r.taken == 0 for r in found if not (r.text or "").split())
    assert mixing.mix(docs.limit(0)).count() == 0
    assert mixing.repeat(mixing.mix(docs), ["doc_id"]).count() == sum(r.taken // r.size for r in found if r.size)


def test_labels_make_weights(spark):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (2, 0, 1), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame([(1,), (2,), (3,), (None,)], "doc_id bigint")
    assert sorted(r.mix_weight for r in mixing.label_weight(docs, labels).collect()) == [0.5, 1.0, 1.0, 2.0]


def jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % 2**64
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_is_the_published_loop(spark):
    rows = spark.range(300).select("id", F.xxhash64("id").alias("h"), *[sharding.jump("id", n).alias(f"n{n}") for n in (1, 2, 24, 25, 100)]).collect()
    for r in rows:
        for n in (1, 2, 24, 25, 100):
            assert r[f"n{n}"] == jump(r.h % 2**64, n)


def test_shards_and_slots(spark):
    rows = odd_docs() + [(i, "x" * (i % 9), "en", "a", 0) for i in range(100, 5000)]
    docs = clash(spark.createDataFrame(rows, DOCS), "sub", "count", "slot", "slot_base", "sub_shard", "shard")
    found = sharding.shard(docs, 7, order=["text"]).collect()
    assert len(found) == len(rows)
    slots = collections.defaultdict(list)
    for r in found:
        slots[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 7)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and slots.keys() <= set(range(7))
    assert sharding.shard(docs.limit(0), 7).count() == 0
    sums = {r.doc_id: r.c for r in docs.select("doc_id", sharding.text_crc32().alias("c")).collect()}
    assert sums[0] == 0 and sums[4] == zlib.crc32(dict((r[0], r[1]) for r in rows)[4].encode())


TURNS = "conv_id bigint, turn bigint, role string, text string"
CHAT = [
    (1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (1, 2, "user", ""), (1, 3, "assistant", None), (2, 5, "system", "### x: </turn>\n\\"), (2, 6, "assistant", "\\### Assistant: </turn> ok"),
    (3, 0, "user", "alone"), (4, None, "assistant", "first"), (4, 1, None, "none"), (4, 1, "assistant", "tie"), (4, 1, "assistant", "tie"), (5, 0, "a:b\\</turn>", "odd\nrole"), (None, 0, "assistant", "no id"),
    *[(6, i, ("user", "assistant")[i % 2], f"turn {i}") for i in range(200)],
]


def expected_chat():
    out = {}
    for conv in {r[0] for r in CHAT}:
        own = sorted(((t is not None, t or 0, role or "", text or "") for c, t, role, text in CHAT if c == conv))
        digest = "".join(f"{role}\n{text}\n" for *_, role, text in own)
        loss = "".join(text for *_, role, text in own if role == "assistant")
        out[conv] = (len(own), hashlib.sha256(digest.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_chat_round_trip(spark):
    turns = clash(spark.createDataFrame(CHAT, TURNS), "page", "base")
    pages = chat.format_conversations(turns)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.read_back(pages, chat.examples(pages)).collect()}
    assert got == expected_chat()
    assert pages.where("conv_id = 6").count() == 4
    none = chat.format_conversations(turns.limit(0))
    assert chat.read_back(none, chat.examples(none)).count() == 0
    long = spark.createDataFrame([(1, 0, "user", "x" * 300_000), (1, 1, "assistant", "</turn>\\" * 100_000)], TURNS)
    r = chat.read_back(chat.format_conversations(long), chat.examples(chat.format_conversations(long))).first()
    assert r.loss_chars == 800_000 and r.loss_sha256 == hashlib.sha256(("</turn>\\" * 100_000).encode()).hexdigest()


def test_examples_are_prefixes_and_replies(spark):
    pages = chat.format_conversations(spark.createDataFrame(CHAT, TURNS))
    whole = {}
    for r in sorted(pages.collect(), key=lambda r: (str(r.conv_id), r.base)):
        whole[r.conv_id] = whole.get(r.conv_id, "") + r.text
    rows = chat.examples(pages).collect()
    assert len(rows) == sum(r[2] == "assistant" for r in CHAT)
    shown = {(r.conv_id, r.loss_start): r for r in chat.render(pages).collect()}
    for r in rows:
        text = whole[r.conv_id]
        assert text[: r.context_end].endswith("</turn>\n") or r.context_end == 0
        assert r.target == text[r.context_end : r.context_end + len(r.target)] and re.match(r"### assistant: $", r.target[: r.loss_at]) and r.target[r.loss_at + r.loss_chars :] == "</turn>\n"
        x = shown[(r.conv_id, r.context_end + r.loss_at)]
        assert x.context == text[: r.context_end] and x.target == r.target and x.loss_text == r.target[r.loss_at : r.loss_at + r.loss_chars]
