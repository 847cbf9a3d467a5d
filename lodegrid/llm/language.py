"""Language identification by multilingual mixture inference.

A language is a distribution over letter 3-grams (of UTF-8 bytes, hashed to
``BUCKETS``), learned from labelled documents.  A document is a mixture: its
3-grams come from several languages in unknown proportions, which
expectation-maximisation estimates over the whole text.  Sets of languages are
compared by penalised likelihood: one language alone, the best two, and so on as long as a
larger set could win (the slopes at each set's mixture bound what any mixture can reach), each
estimated over the languages of the set alone; a larger set has to raise the log-likelihood by ``PENALTY`` x ln(n)
for each language more (n: 3-grams, thinned by 3, as neighbours overlap).

The model is fitted on a bounded sample: about ``SAMPLE`` documents of each
language, chosen by a hash of their ids.  It has BUCKETS x languages numbers, so
its size doesn't depend on the corpus; of more than ``LANGUAGES`` languages none is
learned (ValueError), as the numbers are held by the driver and each worker.  Documents never move between tasks.

Defined cases: null texts and texts without a letter are ``und`` with score 0; a
text with letters but no usable 3-gram gets the most frequent language of the
sample with its share as the score; without any labelled document all texts are
``und``; ties go to the language that sorts first; repeated rows count and are predicted
each; very long texts are taken whole; an empty table gives an empty result; other columns
stay, those of the same names as new ones being replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodegrid.llm import words as W
from lodegrid.llm.arrow import lists, map_arrow, with_columns

BUCKETS = 1 << 16
#: Labelled documents of each language that the model is fitted on, near enough.
SAMPLE = 2_000
#: Languages at most: 256 KB each.
LANGUAGES = 1_000
#: How much likelihood each further language of a document has to earn.
PENALTY = 2.0
#: Steps of the mixture of all languages, which ranks them; change of proportions at which a set's mixture is done, and steps at most.
STEPS, TOLERANCE, MOST_STEPS = 6, 1e-4, 1000
#: Languages whose likelihoods of all 3-grams of a slice are held at once; of more they are looked up again when needed.
HELD = 8
UNKNOWN = "und"
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[0x61:0x7B] = np.arange(0x61, 0x7B)
_LETTER[0x41:0x5B] = np.arange(0x61, 0x7B)
_LETTER[0x80:] = np.arange(0x80, 0x100)


def grams(texts: W.Texts) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-grams of texts, and how many each text has: those with two letter bytes or more."""
    data = _LETTER[texts.data].astype(np.uint32)
    n = len(data)
    if n < 3:
        return np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    code = (data[:-2] << np.uint32(16)) | (data[1:-1] << np.uint32(8)) | data[2:]
    letter = data != 0x20
    keep = np.zeros(n, bool)
    keep[: n - 2] = (letter[:-2].astype(np.int8) + letter[1:-1] + letter[2:]) >= 2
    ends = texts.offsets[1:]
    for back in (1, 2):  # those that would reach into the next text
        at = ends - back
        keep[at[at >= 0]] = False
    sums = np.concatenate(([0], np.cumsum(keep)))
    bucket = (code[keep[: n - 2]] * np.uint32(2654435761)) >> np.uint32(16)
    return bucket.astype(np.int64), sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


@dataclass
class Model:
    languages: list[str]
    likelihood: np.ndarray  # languages x BUCKETS, float32
    share: np.ndarray

    def infer(self, texts: W.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Proportions of languages (texts x languages), which of them are in the set, and 3-grams of each text."""
        bucket, counts = grams(texts)
        n_lang = len(self.languages)
        share = np.repeat(self.share[None, :], len(counts), 0)
        full = np.flatnonzero(counts)
        if not len(full):
            return share, share == share.max(1, keepdims=True), counts
        count, first = counts[full], (np.cumsum(counts) - counts)[full]
        alone = np.stack([np.add.reduceat(np.log(row)[bucket], first, dtype=np.float64) for row in self.likelihood], 1)
        everyone = np.broadcast_to(np.arange(n_lang), (len(full), n_lang))
        n_all = np.full((len(full), n_lang), 1 / n_lang)
        before = self._expect(bucket, everyone, n_all, count, first, STEPS - 1)[0]
        mixed, fit = self._expect(bucket, everyone, before, count, first, 1)
        # No mixture of any set is likelier than this (the likelihood is concave in the proportions).
        bound = fit + count * (np.max(mixed / np.maximum(before, 1e-300), axis=1, initial=1.0) - 1) * 1.001 + 1
        order = np.argsort(-mixed, axis=1, kind="stable")
        best = np.argmax(alone, axis=1)
        chosen = np.zeros_like(mixed)
        chosen[np.arange(len(full)), best] = 1.0
        score = alone.max(1)
        for k in range(2, n_lang + 1):
            cost = PENALTY * 3 * (k - 1) * np.log(np.maximum(count, 2))
            open_ = np.flatnonzero(bound - cost > score)
            if not len(open_):
                break
            own = count[open_]
            starts = np.cumsum(own) - own
            held = bucket[np.repeat(first[open_] - starts, own) + np.arange(own.sum())]
            near = np.sort(order[open_, :k], axis=1)
            start = np.maximum(np.take_along_axis(mixed[open_], near, 1), 1e-6)
            part, fit = self._converged(held, near, start / start.sum(1, keepdims=True), own, starts)
            bound[open_] = np.minimum(bound[open_], self._most(held, near, part, own, starts))
            fit = fit - cost[open_]
            better = np.flatnonzero(fit > score[open_])
            chosen[open_[better]] = 0.0
            chosen[open_[better][:, None], near[better]] = part[better]
            score[open_[better]] = fit[better]
        share[full] = chosen
        return share, share > 0, counts

    def _weighed(self, bucket: np.ndarray, langs: np.ndarray, share: np.ndarray, count: np.ndarray) -> Iterator[np.ndarray]:
        """For one language of each text (a column of ``langs``) after another, the likelihoods of 3-grams times its share."""
        for i in range(langs.shape[1]):
            lang = langs[:, i]
            p = self.likelihood[lang[0]][bucket] if (lang == lang[0]).all() else self.likelihood[np.repeat(lang, count), bucket]
            yield p * np.repeat(share[:, i].astype(np.float32), count)

    def _most(self, bucket: np.ndarray, langs: np.ndarray, share: np.ndarray, count: np.ndarray, first: np.ndarray) -> np.ndarray:
        """What no mixture of all languages exceeds in likelihood, by the slopes at a mixture of some: tight where that is the best one."""
        total = np.zeros(len(bucket), np.float32)
        for x in self._weighed(bucket, langs, share, count):
            total += x
        total = np.maximum(total, np.float32(1e-30))
        steepest = np.ones(len(count))
        for row in self.likelihood:
            steepest = np.maximum(steepest, np.add.reduceat(row[bucket] / total, first, dtype=np.float64) / count)
        return np.add.reduceat(np.log(total), first, dtype=np.float64) + count * (steepest - 1) * 1.001 + 1

    def _converged(self, bucket: np.ndarray, langs: np.ndarray, share: np.ndarray, count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Proportions and log-likelihoods of texts over the languages of their sets, by expectation-maximisation until none changes by ``TOLERANCE``."""
        out, fits = share.copy(), np.zeros(len(count))
        left, own, starts, held = np.arange(len(count)), count, first, bucket
        for _ in range(MOST_STEPS):
            part, fits[left] = self._expect(held, langs[left], out[left], own, starts, 1)
            moved = np.abs(part - out[left]).max(1) >= TOLERANCE
            out[left] = part
            if not moved.any():
                break
            if not moved.all():
                left = left[moved]
                own = count[left]
                starts = np.cumsum(own) - own
                held = bucket[np.repeat(first[left] - starts, own) + np.arange(own.sum())]
        return out, fits

    def _expect(self, bucket: np.ndarray, langs: np.ndarray, share: np.ndarray, count: np.ndarray, first: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Steps of expectation-maximisation over some languages of each text, and the log-likelihood before the last of them."""
        few = langs.shape[1] <= HELD
        for step in range(steps):
            weighed = list(self._weighed(bucket, langs, share, count)) if few else None
            total = np.zeros(len(bucket), np.float32)
            for x in weighed or self._weighed(bucket, langs, share, count):
                total += x
            total = np.maximum(total, np.float32(1e-30))
            fit = np.add.reduceat(np.log(total), first, dtype=np.float64) if step == steps - 1 else None
            share = np.stack([np.add.reduceat(x / total, first, dtype=np.float64) for x in weighed or self._weighed(bucket, langs, share, count)], 1) / count[:, None]
            share /= share.sum(1, keepdims=True)
        return share, fit


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        languages = np.array(batch.column("lang").to_pylist(), object)
        for texts in W.slices(batch.column("text")):
            bucket, counts = grams(texts)
            of = np.repeat(languages[texts.first : texts.first + len(texts)], counts)
            for lang in set(of.tolist()):
                sums[lang] = sums.get(lang, 0) + np.bincount(bucket[of == lang], minlength=BUCKETS)
    for lang, total in sums.items():
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(seen), pa.string()), pa.array(seen), pa.array(total[seen].astype(np.int64))], names=["lang", "bucket", "n"])


def fit(labelled: DataFrame, sample: int = SAMPLE) -> Model | None:
    """A model from documents (doc_id, text, lang) with a language; None without any."""
    labelled = labelled.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().limit(LANGUAGES + 1).collect()}
    if len(sizes) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages")
    if not sizes:
        return None
    limit = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, sample / n))]), F.col("lang"))
    drawn = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / float(1 << 30)
    counted = map_arrow(labelled.where(drawn < limit), _counted, "lang string, bucket bigint, n bigint")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow().to_pandas()  # at most BUCKETS for each language
    languages = sorted(sizes)
    table = np.zeros((len(languages), BUCKETS))
    table[rows["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(np.int64), rows["bucket"].to_numpy()] = rows["n"]
    smooth = (table + 0.5) / (table.sum(1, keepdims=True) + 0.5 * BUCKETS)
    total = np.array([sizes[x] for x in languages], float)
    return Model(languages, smooth.astype(np.float32), total / total.sum())


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """Add lang_pred, score (its proportion), lang_set and lang_proportions to documents (column text)."""
    new = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_proportions", T.ArrayType(T.DoubleType()))]
    names = [f.name for f in new]
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in batches:
            column = batch.column("text")
            lettered = pc.fill_null(pc.match_substring_regex(column, r"\pL"), False).to_numpy(zero_copy_only=False)
            for texts in W.slices(column):
                letters = lettered[texts.first : texts.first + len(texts)]
                if known is None:
                    tag, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                    inside = np.zeros((len(texts), 0), bool)
                    share = np.zeros((len(texts), 0))
                    languages = np.empty(0, object)
                else:
                    languages = np.array(known.languages, object)
                    share, inside, _ = known.infer(texts)
                    best = np.argmax(share, axis=1)
                    tag = np.where(letters, languages[best], UNKNOWN)
                    score = np.where(letters, share[np.arange(len(texts)), best], 0.0)
                    inside = inside & letters[:, None]
                which = np.nonzero(inside)
                sets = lists(pa.array(languages[which[1]], pa.string()), inside.sum(1))
                parts = lists(pa.array(share[which].astype(np.float64)), inside.sum(1))
                yield with_columns(batch.slice(texts.first, len(texts)), lang_pred=pa.array(tag, pa.string()), score=pa.array(score), lang_set=sets, lang_proportions=parts)

    schema = T.StructType([f for f in docs.schema.fields if f.name not in names] + new)
    return map_arrow(docs, run, schema)


def confident(predicted: DataFrame, least: float = 0.5) -> DataFrame:
    """Documents whose language is known and has at least that proportion."""
    return predicted.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
