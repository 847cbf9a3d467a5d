import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from lodegrid.llm import words as W
from tests.llm.helpers import LOWER, odd_docs, thue_morse, words


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("aAbZ \t\n\x0b0-é😀 ."), max_size=12)), max_size=6), st.integers(1, 5))
def test_words_and_shingles(texts, k):
    strings, counts, made, shingled = [], [], [], []
    for part in W.slices(pa.array(texts, pa.string())):
        split = W.split(part)
        strings += split.strings().to_pylist()
        counts += split.counts.tolist()
        hashes, n = W.shingles(split.hashes(), split.counts, k)
        made += n.tolist()
        shingled += hashes.tolist()
    expected = [words(t) for t in texts]
    assert strings == [w for t in expected for w in t] and counts == [len(t) for t in expected]
    own = [tuple(t[i : i + k]) for t in expected if t for i in range(max(1, len(t) - k + 1))]
    assert made == [max(1, len(t) - k + 1) if t else 0 for t in expected]
    assert len(set(shingled)) == len(set(own)) and len({(a, b) for a, b in zip(shingled, own, strict=True)}) == len(set(own))


def test_alphanumeric_class():
    texts = ["It's 3.5x Ünï, a_b", None, "ABC"]
    got = [w for part in W.slices(pa.array(texts)) for w in W.split(part, W.ALNUM).strings().to_pylist()]
    assert got == [w for t in texts for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))]


def test_slices_cut_between_texts_only(monkeypatch):
    monkeypatch.setattr(W, "SLICE_BYTES", 64)
    texts = [r[1] for r in odd_docs()]
    parts = list(W.slices(pa.chunked_array([pa.array(texts[:5]), pa.array(texts[5:])])))
    assert [p.first for p in parts][0] == 0 and sum(len(p) for p in parts) == len(texts) and len(parts) > 3
    assert b"".join(p.data.tobytes() for p in parts).decode() == "".join(t or "" for t in texts)


def test_hashes_depend_on_the_word_alone():
    rng = random.Random(1)
    names = [f"x{rng.randrange(10**9)}" for _ in range(3000)]
    one = W.split(next(W.slices(pa.array([" ".join(names)])))).hashes()
    other = W.split(next(W.slices(pa.array([" ".join(reversed(names))])))).hashes()
    assert (one == other[::-1]).all() and len(set(one.tolist())) == len(set(names))


def test_hashes_of_related_words_differ():
    rng = random.Random(4)
    names = {thue_morse(1 << k, swap) for k in range(3, 13) for swap in (False, True)}
    names |= {"x" * n for n in range(1, 600)} | {"x" * n + "y" for n in range(600)} | {"y" + "x" * n for n in range(600)}
    names |= {"".join(rng.choice("ab") for _ in range(24)) for _ in range(20_000)}
    names = sorted(names)
    assert len(set(W.split(next(W.slices(pa.array([" ".join(names)])))).hashes().tolist())) == len(names)


def test_hashes_depend_on_the_bytes_of_the_word_alone():
    for n in (1, 7, 8, 9, 16, 255, 256, 257, 5000):
        word = thue_morse(n)
        one = [W.split(next(W.slices(pa.array([t])))).hashes().tolist() for t in (word, f"{word} {word}", f"é{'z' * (n % 5)} {word} q", word.upper())]
        assert one[0] == one[3] and one[1] == one[0] * 2 and one[2][1] == one[0][0]


def test_distinct():
    values, counts = W.distinct(np.array([3, 1, 3, 2, 2], np.uint64), np.array([3, 0, 2]))
    assert values.tolist() == [1, 3, 2] and counts.tolist() == [2, 0, 1]
