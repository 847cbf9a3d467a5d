"""Piece encoding against the library, whole ids and decoded texts."""

import hashlib
import random

import public_tokenizers
import pytest

from lodegrid.llm import pieces, queries
from tests.llm.helpers import DOCS, clash, odd_docs

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def encoder():
    return pieces.Encoder(MODEL)


def texts(rng, known, n):
    for _ in range(n):
        kind = rng.random()
        if kind < 0.3:
            yield "".join(rng.choice(" ab\n.▁é😀\x00ſ") for _ in range(rng.randrange(40)))
        elif kind < 0.6:
            yield "".join(rng.choice(known) for _ in range(rng.randrange(12)))
        elif kind < 0.8:
            yield " " * rng.randrange(60) + rng.choice(["", "a", "\n", "the"]) + " " * rng.randrange(40)
        elif kind < 0.9:
            yield "".join(chr(rng.choice([rng.randrange(1, 0xD800), rng.randrange(0x20, 0x250), rng.randrange(0xE000, 0x110000)])) for _ in range(rng.randrange(30)))
        else:
            yield "".join(rng.choice("aeinrst") for _ in range(rng.randrange(300)))


def test_ids_equal_the_library(encoder):
    rng = random.Random(4)
    for text in texts(rng, list(encoder.vocabulary.ids), 20_000):
        ids, digest = encoder(text)
        want = encoder.vocabulary.library.encode(text)
        assert ids == want, text
        assert digest == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_border_rule_equals_merging_anew(encoder):
    v, rng = encoder.vocabulary, random.Random(6)
    plain = sorted(v.plain)
    for _ in range(20_000):
        a, b = rng.choice(plain), rng.choice(plain)
        assert v._border_holds(a, b) == (v.merged(a + b) == [a, b]), (a, b)
    assert len(plain) > 31_000


def test_going_back_and_failed_positions(encoder, monkeypatch):
    """Texts whose longest pieces are wrong: the encoder must go back, and still be right without any memory."""
    v = encoder.vocabulary
    before = []
    monkeypatch.setattr(v, "shorter", type("Seen", (dict,), {"__getitem__": lambda s, k: before.append(k) or dict.__getitem__(s, k)})(v.shorter))
    for text in ("▁theireresses", "sssssssssssssssssssssssssssssss", "▁" * 47, "aaaaaaaaaaaaabaaaaaaaab"):
        ids = [v.ids[p] for p in v.encode_known(text)]
        assert ids == [v.ids[p] for p in v.merged(text)]
    assert before


def test_steps_and_forgetting_change_nothing(encoder, monkeypatch):
    rng = random.Random(8)
    text = " ".join("".join(rng.choice("aeinrst.") for _ in range(rng.randrange(12))) for _ in range(20_000))
    want = encoder.vocabulary.library.encode(text)
    monkeypatch.setattr(pieces, "STEP", 1000)
    monkeypatch.setattr(pieces, "CACHE_WORDS", 300)
    monkeypatch.setattr(pieces, "CACHE_PAIRS", 50)
    monkeypatch.setattr(pieces, "LONG", 5)
    ids, digest = pieces.Encoder(MODEL)(text)
    assert ids == want and digest == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()


def test_query_and_round_trip(spark, tmp_path, encoder):
    library = encoder.vocabulary.library
    docs = clash(spark.createDataFrame(odd_docs(), DOCS), "ids", "n_tokens", "decoded")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in odd_docs():
        ids = library.encode(r[1] or "")
        want.append((r[0], len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    got = queries.op12_pieces(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    there = pieces.decode(pieces.encode(docs, MODEL), MODEL)
    assert there.columns[-2:] == ["ids", "decoded"] and "lang" in there.columns
    assert all(r["decoded"] == (r["text"] or "") for r in there.collect())
    assert pieces.digests(docs.limit(0), MODEL).collect() == []


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as proto

    model = proto.ModelProto()
    with open(MODEL, "rb") as f:
        model.ParseFromString(f.read())
    model.trainer_spec.model_type = model.trainer_spec.UNIGRAM
    (tmp_path / "other.model").write_bytes(model.SerializeToString())
    with pytest.raises(ValueError, match="merge-type"):
        pieces.Vocabulary(str(tmp_path / "other.model"))
