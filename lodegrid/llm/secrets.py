"""Secret scans: patterns, and a battery of randomness tests.

Patterns find assigned passwords and tokens, access key ids and long hexadecimal
strings.  The battery finds other random strings.  A candidate is a run of at least
``LEAST`` characters of the base64 and base64url alphabets, or a piece of one between its
symbols, with digits and letters.  Its encoding is the smallest alphabet that holds it.
Three tests ask if its symbols could be uniform and independent draws from that alphabet:

* chi-squared uniformity over classes of symbols: digits and others, and the common and
  the rare letters of either case,
* the Wald-Wolfowitz runs test on symbols of the lower and the upper half of the alphabet,
  which is put in order of these classes,
* lag-1 serial correlation of places in that order.

Fisher's method joins their p-values to one number: small for random strings, large for
names, paths and URLs, and larger the longer they are.

False discoveries are controlled among the strings that are *reported*.  The null
hypothesis is a structured string: words with the letter transitions of the corpus's own
ordinary words (counted over all texts), numbers and separators, in the styles of paths
and identifiers.  Strings drawn so, for each alphabet and length, show how small the
battery's number gets by chance (the logarithm is close to normal); a candidate's p-value
is the odds that a structured one of its alphabet and length looks as random.  In each
stratum of like length the Benjamini-Hochberg procedure over all distinct candidates of the corpus
picks those reported, at false discovery rate ``RATE``.  Strings that the battery says
aren't random (p below ``FIT``) are not reported in any case.

What the procedure needs of the corpus are 27 x 27 letter transitions and counts by
stratum and p-value bin, some thousands of numbers at any size.  Documents never move
between tasks.

Defined cases: null text is empty; offsets count code points; overlapping spans of
different patterns are all kept, but a candidate that overlaps a pattern's span is left
out, and of overlapping candidates the least likely structured one is reported; a very
long text is scanned whole; repeated rows are scanned each, but equal candidates count
once; an empty table gives an empty result; other columns of the documents stay, those of
the same names as new ones being replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm import words as W
from lodegrid.llm.arrow import map_arrow, with_columns
from lodegrid.llm.scratch import Scratch

LEAST, RATE, FIT = 20, 0.05, 1e-3
KINDS = ("assign", "access", "hex", "random")
# The patterns of the contract.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{16,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % LEAST)
_PIECES = tuple(re.compile(r"[A-Za-z0-9%s]{%d,}" % (symbols, LEAST)) for symbols in ("", "_-", "+/"))
#: Texts without a match of this have no span of any kind.
_SIEVE = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{16}|[A-Za-z0-9+/_-]{%d}" % LEAST
_LOW, _UP, _DIGIT = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = {
    "hex": _DIGIT + "abcdef", "HEX": _DIGIT + "ABCDEF", "base32": _UP + "234567", "upper": _DIGIT + _UP, "lower": _DIGIT + _LOW,
    "upper-": _DIGIT + _UP + "-_", "lower-": _DIGIT + _LOW + "-_", "upper/": _DIGIT + _UP + "+/", "lower/": _DIGIT + _LOW + "+/",
    "alnum": _DIGIT + _UP + _LOW, "base64": _UP + _LOW + _DIGIT + "+/", "base64url": _UP + _LOW + _DIGIT + "-_",
}
_SYMBOLS = {name: set(alphabet) for name, alphabet in ENCODINGS.items()}
#: Structured strings drawn for each alphabet, of ``LEAST`` to ``LONGEST`` characters.
DRAWS, LONGEST = 250, 256
#: The logarithm's tails are heavier than a normal distribution's: its spread is widened so.
WIDER = 1.5
# How many of 1,000 letters of English prose are a to z. They count as so many letters more in the corpus.
_PROSE = (82, 15, 28, 43, 127, 22, 20, 61, 70, 2, 8, 40, 24, 67, 75, 19, 1, 60, 63, 91, 28, 10, 24, 2, 20, 1)


def encoding_of(text: str) -> str | None:
    """The smallest alphabet that holds all symbols."""
    symbols = set(text)
    return next((name for name, known in _SYMBOLS.items() if symbols <= known), None)


def _chi2_tail(x: float, k: int) -> float:
    """P(chi-squared with k degrees > x): the regularized upper gamma function by series or continued fraction."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while term > total * 1e-12:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    b, c = x + 1 - a, 1e300
    d = h = 1 / b
    for i in range(1, 500):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b)
        c = b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-12:
            break
    return min(1.0, front * h)


def _normal_tails(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2))


class Battery:
    """The three tests, for common letters as given."""

    def __init__(self, common: str):
        self.places, self.bins, self.shares = {}, {}, {}
        for name, alphabet in ENCODINGS.items():
            kind = lambda c: (1 if c in _UP else 2, c.lower() in common) if c.isalpha() else (0, c in "56789" if name in ("hex", "HEX") else False)  # noqa: B023, E731
            ordered = sorted(alphabet, key=lambda c: (kind(c), c))
            kinds = sorted({kind(c) for c in alphabet})
            self.places[name] = {c: i for i, c in enumerate(ordered)}
            self.bins[name] = np.array([kinds.index(kind(c)) for c in ordered])
            self.shares[name] = np.bincount(self.bins[name]) / len(ordered)

    def __call__(self, text: str, encoding: str) -> tuple[float, float, float]:
        """p-values of the uniformity, runs and serial correlation tests."""
        places, shares = self.places[encoding], self.shares[encoding]
        x = np.array([places[c] for c in text])
        n, size = len(x), len(places)
        expected = n * shares
        seen = np.bincount(self.bins[encoding][x], minlength=len(shares))
        uniform = _chi2_tail(float(((seen - expected) ** 2 / expected).sum()), len(shares) - 1)
        above = x >= size / 2
        n1 = int(above.sum())
        n2 = n - n1
        if n1 and n2:
            runs = 1 + int((above[1:] != above[:-1]).sum())
            mean = 1 + 2 * n1 * n2 / n
            spread = (mean - 1) * (mean - 2) / (n - 1)
            run = _normal_tails((runs - mean) / math.sqrt(spread)) if spread > 0 else 1.0
        else:
            run = 2.0 ** (1 - n)
        centred = x - x.mean()
        total = float((centred**2).sum())
        serial = _normal_tails((float((centred[1:] * centred[:-1]).sum()) / total + 1 / n) * math.sqrt(n)) if total else 0.0
        return uniform, run, serial


def joint(p: tuple[float, ...]) -> float:
    """Fisher's number of p-values: chi-squared with twice as many degrees of freedom if all are of random strings."""
    return -2 * sum(math.log(max(x, 1e-300)) for x in p)


def stratum(n: int) -> int:
    """Lengths within a factor of the square root of 2."""
    return int(2 * math.log2(n))


def testable(text: str) -> bool:
    """With digits and letters."""
    return any(c.isdigit() for c in text) and any(c.isalpha() for c in text)


class Null:
    """Structured strings: words by letter transitions (27 x 27 counts, place 26 being a word's border), numbers and separators."""

    def __init__(self, transitions: np.ndarray):
        letters = transitions[:, :26].sum(0) + np.array(_PROSE)
        self.battery = Battery("".join(_LOW[i] for i in np.argsort(-letters, kind="stable")[:13].tolist()))
        prior = np.array([*_PROSE, 200], float)
        prior = prior / prior.sum()
        rows = transitions + 200 * prior[None, :]
        rows[26, 26] = 0
        self.upto = np.cumsum(rows / rows.sum(1, keepdims=True), axis=1).tolist()
        rng = random.Random(20240731)
        self.fits: dict[str, tuple[list[float], list[float]]] = {}  # mean and spread of the logarithm, linear in that of the length
        for encoding in ENCODINGS:
            lengths = [int(LEAST * (LONGEST / LEAST) ** (i / (DRAWS - 1))) for i in range(DRAWS)]
            drawn = np.array([math.log(max(0.01, joint(self.battery(self.draw(rng, encoding, n), encoding)))) for n in lengths])
            mean = np.polyfit(np.log(lengths), drawn, 1)
            spread = np.polyfit(np.log(lengths), np.abs(drawn - np.polyval(mean, np.log(lengths))) * math.sqrt(math.pi / 2), 1)
            self.fits[encoding] = mean.tolist(), spread.tolist()

    def word(self, rng: random.Random, letters: str) -> str:
        out, at = [], 26
        for _ in range(12):
            at = bisect.bisect_right(self.upto[at], rng.random())
            if at >= 26:
                break
            out.append(_LOW[at])
        return "".join(c for c in out if c in letters) or letters[0]

    def draw(self, rng: random.Random, encoding: str, n: int) -> str:
        """A structured string of ``n`` symbols of an alphabet, with digits and letters."""
        alphabet = ENCODINGS[encoding]
        letters = "".join(c for c in _LOW if c in alphabet or c.upper() in alphabet)
        digits = "".join(c for c in _DIGIT if c in alphabet)
        symbols = [c for c in "+/-_" if c in alphabet]
        between = rng.choice(symbols) if symbols else ""
        upper, lower = "A" in alphabet, "a" in alphabet
        style = rng.randrange(3)
        out = ""
        while len(out) < n:
            if rng.random() < (0.5 if letters == "abcdef" else 0.25):
                piece = str(rng.choice((rng.randrange(10), rng.randrange(100), rng.randrange(1990, 2030), rng.randrange(10**6)))).zfill(rng.choice((1, 1, 2, 4, 8)))
                piece = "".join(c for c in piece if c in digits)
            else:
                piece = self.word(rng, letters)
                if upper and (not lower or (style == 0 and rng.random() < 0.1)):
                    piece = piece.upper()
                elif upper and (style == 1 or rng.random() < 0.2):
                    piece = piece[0].upper() + piece[1:]
            out += (between if out else "") + piece
        out = out[:n]
        if not any(c.isalpha() for c in out):
            out = (letters[0].upper() if upper and not lower else letters[0]) + out[1:]
        return out if any(c.isdigit() for c in out) else out[:-1] + digits[-1]

    def odds(self, text: str, encoding: str) -> tuple[float, float]:
        """The odds that a structured string of that alphabet and length looks as random, and the joint p-value of randomness."""
        p = self.battery(text, encoding)
        size = math.log(min(len(text), LONGEST))
        (slope, level), (change, spread) = self.fits[encoding]
        spread = WIDER * max(0.15, spread + change * size)
        return 0.5 * math.erfc((level + slope * size - math.log(max(0.01, joint(p)))) / spread / math.sqrt(2)), _chi2_tail(joint(p), 2 * len(p))


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x61:0x7B] = True


def _transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Letter pairs of ordinary words: ASCII letters, all small but the first, no more than 20."""
    total = np.zeros(27 * 27, np.int64)
    for batch in batches:
        for texts in W.slices(batch.column("text")):
            split = W.split(texts, _WORD_BYTE, lower=False)
            small = np.concatenate(([0], np.cumsum((texts.data >= 0x61) & (texts.data <= 0x7A))))
            size = split.ends - split.starts
            ok = (small[split.ends] - small[split.starts + 1] == size - 1) & (texts.data[split.starts] >= 0x41) & (size <= 20)
            starts, size = split.starts[ok], size[ok]
            upto = np.cumsum(size)
            at = np.repeat(starts - (upto - size), size) + np.arange(upto[-1] if len(upto) else 0)
            letter = (texts.data[at] & 0x1F).astype(np.int64) - 1
            before = np.empty_like(letter)
            before[1:] = letter[:-1]
            before[upto - size] = 26
            total += np.bincount(before * 27 + letter, minlength=27 * 27) + np.bincount(letter[upto - 1] * 27 + 26, minlength=27 * 27)
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], names=["pair", "n"])


def learn(texts: DataFrame) -> Null:
    """The null model of a corpus (column text)."""
    found = map_arrow(texts.select("text"), _transitions, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")).collect()  # at most 729 rows
    counts = np.zeros(27 * 27)
    for r in found:
        counts[r["pair"]] = r["n"]
    return Null(counts.reshape(27, 27))


def pieces(run: str, at: int = 0) -> list[tuple[int, int]]:
    """Spans to test: the run if one alphabet holds it, and its longest pieces with the symbols of one alphabet or none."""
    spans = {(0, len(run))} if encoding_of(run) is not None else set()
    spans |= {m.span() for cut in _PIECES for m in cut.finditer(run)}
    return sorted((at + a, at + b) for a, b in spans if testable(run[a:b]))


def patterns(text: str) -> list[tuple[int, int, int]]:
    """Pattern spans (start, kind, end) in order."""
    base = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 12]
    base += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 18]
    base += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(base)


def scan(text: str, null: Null) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int, int, float, int]]]:
    """Pattern spans (start, kind, end), and candidates (start, end, stratum, bin of the odds, joint p-value of randomness, digest)."""
    base = patterns(text)
    found = []
    for m in _CANDIDATE.finditer(text):
        for a, b in pieces(m[0], m.start()):
            if not any(s < b and a < e for s, _, e in base):
                own = text[a:b]
                odds, fit = null.odds(own, encoding_of(own))
                found.append((a, b, stratum(b - a), bin_of(odds), fit, int.from_bytes(hashlib.blake2b(own.encode(), digest_size=8).digest(), "little", signed=True)))
    return base, found


def bin_of(p: float) -> int:
    """Tenths of log10 p; bin b ends at 10^((b + 1) / 10)."""
    return max(-3000, math.floor(math.log10(max(p, 1e-300)) * 10))


_SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("kind", T.IntegerType()), T.StructField("end", T.LongType())])
_FOUND = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("stratum", T.IntegerType()), T.StructField("bin", T.IntegerType()), T.StructField("fit", T.DoubleType()), T.StructField("digest", T.LongType())])
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]))
_FOUNDS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("stratum", pa.int32()), ("bin", pa.int32()), ("fit", pa.float64()), ("digest", pa.int64())]))


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        null = shared.value
        for batch in batches:
            column = batch.column("text")
            maybe = np.flatnonzero(pc.fill_null(pc.match_substring_regex(column, _SIEVE), False).to_numpy(zero_copy_only=False))
            base, found = [[] for _ in range(batch.num_rows)], [[] for _ in range(batch.num_rows)]
            for i, text in zip(maybe.tolist(), column.take(pa.array(maybe)).to_pylist(), strict=True):
                spans, candidates = scan(text, null)
                base[i] = [dict(zip(("start", "kind", "end"), s, strict=True)) for s in spans]
                found[i] = [dict(zip(("start", "end", "stratum", "bin", "fit", "digest"), c, strict=True)) for c in candidates]
            yield with_columns(batch, ("text",), secret_base=pa.array(base, _SPANS), secret_candidates=pa.array(found, _FOUNDS))

    return run


def thresholds(counts: list[tuple[int, int, int]], rate: float = RATE) -> dict[int, int]:
    """Benjamini-Hochberg by stratum from (stratum, bin of the odds, count): the last bin that is reported."""
    by: dict[int, dict[int, int]] = {}
    for level, p, n in counts:
        by.setdefault(level, {})[p] = n
    out = {}
    for level, own in by.items():
        total, upto = sum(own.values()), 0
        for p in sorted(own):
            upto += own[p]
            if 10 ** ((p + 1) / 10) <= rate * upto / total:
                out[level] = p
    return out


def find(docs: DataFrame) -> DataFrame:
    """Documents without their texts, with ``secrets``: spans (start, kind, end) in order, kinds numbered as KINDS."""
    spark = docs.sparkSession
    docs = docs.drop("secret_base", "secret_candidates", "secrets")
    schema = T.StructType([f for f in docs.schema.fields if f.name != "text"] + [T.StructField("secret_base", T.ArrayType(_SPAN)), T.StructField("secret_candidates", T.ArrayType(_FOUND))])
    null = spark.sparkContext.broadcast(learn(docs))
    scanned = Scratch(spark, "secrets").table(map_arrow(docs, _scanned(null), schema), "spans")
    each = scanned.select(F.inline("secret_candidates")).select("stratum", "bin", "digest").distinct().groupBy("stratum", "bin").count()
    last = thresholds([tuple(r) for r in each.collect()])  # at most 3,000 rows for each stratum
    limit = F.create_map(*[F.lit(x) for pair in last.items() for x in pair]) if last else F.create_map(F.lit(0), F.lit(-4000))
    kept = F.filter("secret_candidates", lambda c: (c["fit"] >= FIT) & (c["bin"] <= F.coalesce(F.element_at(limit, c["stratum"]), F.lit(-4000))))
    first = F.array_sort(F.transform(kept, lambda c: F.struct(c["bin"].alias("bin"), (c["start"] - c["end"]).alias("size"), c["start"].alias("start"), c["end"].alias("end"))))
    none = F.expr("cast(array() as array<struct<start:bigint,kind:int,end:bigint>>)")
    more = F.aggregate(
        first, none, lambda acc, c: F.when(F.exists(acc, lambda x: (x["start"] < c["end"]) & (c["start"] < x["end"])), acc).otherwise(F.concat(acc, F.array(F.struct(c["start"].alias("start"), F.lit(3).alias("kind"), c["end"].alias("end")))))
    )
    return scanned.withColumn("secrets", F.array_sort(F.concat("secret_base", more))).drop("secret_base", "secret_candidates")


def joined(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["kind"] + 1), s["start"], s["end"])), ",")
