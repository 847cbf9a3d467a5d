"""Small tables and plain restatements of the contracts."""

from __future__ import annotations

import random
import re
import zlib

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def prose(rng, n, names=40):
    vocabulary = [f"w{rng.randrange(names)}" for _ in range(names)]
    return " ".join(rng.choice(vocabulary) for _ in range(n))


def thue_morse(n, swap=False):
    """Words whose polynomial hashes modulo powers of 2 are equal for both values of ``swap``."""
    return "".join("ab"[(i.bit_count() + swap) % 2] for i in range(n))


def odd_docs():
    """Null, empty, blank, repeated, long and unusual texts, with nulls in every column."""
    rng = random.Random(3)
    long = " ".join(f"token{rng.randrange(5000)}" for _ in range(20_000))
    rows = [
        (0, None, None, None, None), (1, "", "en", "a", 0), (2, " \t\n ", "en", "a", 4), (3, "one", "en", None, 3), (4, "One two THREE four five six seven eight nine ten eleven", "en", "b", 1),
        (5, "one two three four five six seven eight nine ten eleven", "de", "b", 1), (6, long, "en", "c", 1), (7, long + " end", "en", "c", 1), (8, "ÄÖ é ñ x y 😀😀 á", "fr", "é", 1), (9, "-- ## 12", None, "a", 1),
        (10, prose(rng, 60), "en", "a", 1), (10, prose(rng, 60), "en", "a", 1), (11, "same text here now", "en", "z", 1), (11, "same text here now", "en", "z", 1), (None, "an id of none", "en", "a", 1),
    ]
    return rows


def clash(df, *names):
    """The table with more columns, of names that operators use themselves."""
    from pyspark.sql import functions as F

    return df.withColumns({n: F.lit("own") for n in names})


def crc(x, mod):
    return zlib.crc32(("" if x is None else str(x)).encode()) % mod


def jaccard_classes(docs, k, percent):
    """Least linked id of each document, over all pairs."""
    sets = {}
    for i, text in docs:
        w = words(text)
        sets[i] = frozenset(" ".join(w[j : j + k]) for j in range(max(1, len(w) - k + 1))) if w else frozenset()
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}
