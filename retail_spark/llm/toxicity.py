"""Toxicity scores: gradient-boosted trees over dense text features, calibrated by isotonic regression.

1. Of the labelled rows that may be learnt from (crc32 of the id, modulo 5, is not 0) a
   sample of at most ``TRAINING_ROWS`` is taken by hash.
2. The **lexicon** is learnt: words and word beginnings that occur in far more toxic
   documents than chance explains, with their log odds.
3. A document's **features** are rates: lexicon density and weight, how close second-person words
   stand to lexicon words, capitals, punctuation and obfuscation.
4. Boosted trees are fitted on part of the sample, and their probability is mapped to
   the observed share of toxic rows on the rest.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import drawn, map_texts, safe_id, true_id
from retail_spark.sources.scratch import stage

#: At most about so many labelled rows are learnt from.
TRAINING_ROWS = 20_000
#: At most so many lexicon entries, those with the strongest evidence.
LEXICON_ENTRIES = 400
#: Least log-likelihood ratio of an entry (25 is about one in two million by chance), and its least documents.
LEAST_EVIDENCE, LEAST_DOCUMENTS = 25.0, 4
#: Lengths of the word beginnings that are tried.
STEMS = range(3, 9)
NEAR = 5
BROADCAST_LABELS = 1_000_000
CACHED_WORDS = 50_000

# Second-person words of the four languages, and what stands for a letter in disguised words.
SECOND_PERSON = frozenset(
    "you your yours yourself u ur du dich dir dein deine ihr euch sie tu te toi ton ta tes vous votre vos tú ti tus usted ustedes vosotros".split()
)
DISGUISE = str.maketrans("013457@$!", "oieastasi")

FEATURES = (
    "log_words", "lexicon_density", "lexicon_weight", "log_hits", "kinds", "burst", "second_person", "near_second_person",
    "capital_share", "capital_words", "exclamations", "questions", "punctuation", "disguised", "stretched",
)

_SPLIT = re.compile(r"[\x20\x09-\x0D]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_INSIDE = re.compile(r"[^\W_]")
_STRETCH = re.compile(r"([^\W\d_])\1\1")
_MIXED = re.compile(r"[^\W\d_][\d@$!*.]+[^\W\d_]")
_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")
_PUNCTUATION = re.compile(r"[^\w\s]")


def plain_word(word: str) -> tuple[str, bool]:
    """A word without its edges and case, undisguised; and whether it was disguised."""
    word = _EDGE.sub("", word.lower())
    if word.isalpha() or not _MIXED.search(word):
        return word, False
    return "".join(_INSIDE.findall(word.translate(DISGUISE))), True


def stems_of(word: str) -> list[str]:
    """The word itself and its beginnings (marked with ``*``)."""
    return [word, *[word[:k] + "*" for k in STEMS if len(word) > k]]


class _Words(dict):
    """Raw word -> what it adds to the features, ``None`` for the many words that add nothing."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon = lexicon
        self.beginnings = {s.rstrip("*")[: STEMS[0]] for s in lexicon} | {p[: STEMS[0]] for p in SECOND_PERSON}

    def __missing__(self, raw: str) -> tuple | None:
        """Weight and entry; second person, disguised, in capitals; numbers of capitals, punctuation and stretches."""
        if len(self) >= CACHED_WORDS:
            self.clear()
        found = None
        if not (raw.isalpha() and raw.islower()) or raw[: STEMS[0]] in self.beginnings or _STRETCH.search(raw):
            found = self._marks(raw)
        self[raw] = found
        return found

    def _marks(self, raw: str) -> tuple | None:
        word, disguised = plain_word(raw)
        best = (0.0, "")
        if word[: STEMS[0]] in self.beginnings:
            best = max(((self.lexicon[s], s) for s in stems_of(word) if s in self.lexicon), default=best)
        marks = (word in SECOND_PERSON, disguised, len(raw) > 2 and raw.isupper())
        counts = tuple(len(p.findall(raw)) for p in (_CAPITAL, _PUNCTUATION, _STRETCH))
        return (*best, *marks, *counts) if best[1] or any(marks) or any(counts) else None


class TextFeatures:
    """Turns texts into feature rows for one lexicon (entry -> weight)."""

    def __init__(self, lexicon: dict[str, float]):
        self.known = _Words(lexicon)

    def row(self, text: str | None) -> tuple[float, ...]:
        text = text or ""
        raw = [w for w in _SPLIT.split(text) if w]
        seen = [(k, x) for k, x in enumerate(map(self.known.__getitem__, raw)) if x is not None]
        n, chars = max(1, len(raw)), max(1, len(text))
        hits = [(k, x) for k, x in seen if x[0]]
        persons = np.array([k for k, x in seen if x[2]], dtype=np.int64)
        near = burst = 0
        if hits:
            at = np.array([k for k, _ in hits])
            burst = int((np.searchsorted(at, at + 50) - np.arange(len(at))).max())
            if len(persons):
                near = int((np.searchsorted(persons, at + NEAR, "right") > np.searchsorted(persons, at - NEAR)).sum())
        disguised, shouted, capitals, punctuation, stretched = (sum(x[f] for _, x in seen) for f in range(3, 8))
        return (
            float(np.log1p(len(raw))),
            len(hits) / n,
            sum(x[0] for _, x in hits) / n,
            float(np.log1p(len(hits))),
            float(len({x[1] for _, x in hits})),
            float(burst),
            len(persons) / n,
            near / max(1, len(hits)),
            capitals / chars,
            shouted / n,
            text.count("!") / chars,
            text.count("?") / chars,
            punctuation / chars,
            disguised / n,
            stretched / n,
        )


def _stems_of_raw(raw: str) -> tuple[str, ...]:
    word = plain_word(raw)[0]
    return tuple(stems_of(word)) if word else ()


def _count_stems(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    # Known for the length of a task: a worker outlives the task and must not keep it.
    stems_of_raw = lru_cache(CACHED_WORDS)(_stems_of_raw)
    for frame in frames:
        counts = {0: Counter(), 1: Counter()}
        for text, toxic in zip(frame["text"], frame["toxic"]):
            words = set(_SPLIT.split(text or ""))
            counts[int(toxic)].update(set().union(*map(stems_of_raw, words)))
        rows = [(s, n, 0) for s, n in counts[0].items()] + [(s, 0, n) for s, n in counts[1].items()]
        yield pd.DataFrame(rows, columns=["stem", "clean", "toxic"])


def learn_lexicon(rows: DataFrame) -> dict[str, float]:
    """Entries with their log odds, from labelled ``rows`` (text, toxic)."""
    total = rows.agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c")).first()
    toxic_rows, clean_rows = int(total.t or 0), int(total.c or 0)
    if not toxic_rows or not clean_rows:
        return {}
    t, c = F.col("toxic").cast("double"), F.col("clean").cast("double")
    share = toxic_rows / (toxic_rows + clean_rows)
    expected = (t + c) * share
    evidence = 2 * (t * F.log(t / expected) + F.when(c > 0, c * F.log(c / (t + c - expected))).otherwise(0.0))
    weight = F.log(((t + 0.5) / (toxic_rows + 1)) / ((c + 0.5) / (clean_rows + 1)))
    found = (
        rows.mapInPandas(_count_stems, "stem string, clean long, toxic long")
        .groupBy("stem")
        .agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
        .where((F.col("toxic") >= LEAST_DOCUMENTS) & (t > expected))
        .select("stem", evidence.alias("evidence"), weight.alias("weight"))
        .where(F.col("evidence") >= LEAST_EVIDENCE)
        .orderBy(F.desc("evidence"), "stem")
        .limit(LEXICON_ENTRIES)
    )
    return {r.stem: round(r.weight, 4) for r in found.collect()}


def _featured(rows: DataFrame, lexicon: dict[str, float], keep: list[str]) -> DataFrame:
    def compute(texts: Iterator[list[str | None]]) -> Iterator[list[pa.Array]]:
        features = TextFeatures(lexicon)
        for batch in texts:
            values = np.array([features.row(t) for t in batch], np.float64).reshape(-1, len(FEATURES))
            yield [pa.array(v) for v in values.T]

    return map_texts(rows, keep, compute, [f"{f} double" for f in FEATURES])


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5; fold 0 is never learnt from."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def training_rows(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, text, toxic, fold`` of the labelled rows to learn from, at most about ``TRAINING_ROWS``."""
    marked = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .withColumn("fold", fold_of(F.col("doc_id")).cast("int"))
        .where("fold <> 0")
    )
    marked = stage(marked, "labels")
    share = min(1.0, TRAINING_ROWS / max(1, marked.count()))
    marked = marked.where(drawn(share, "doc_id"))
    if marked.count() <= BROADCAST_LABELS:
        marked = F.broadcast(marked)
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.join(marked, "doc_id")


class ToxicityModel:
    """A lexicon, boosted trees and their calibration."""

    def __init__(self, lexicon: dict[str, float], trees, calibration, constant: float):
        self.lexicon, self.trees, self.calibration, self.constant = lexicon, trees, calibration, constant
        self.vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

    def _raw(self, featured: DataFrame) -> DataFrame:
        scored = self.trees.transform(self.vector.transform(featured))
        return scored.withColumn("raw", F.round(vector_to_array("probability")[1], 3))

    def score(self, rows: DataFrame, keep: list[str]) -> DataFrame:
        """``*keep, score`` for rows with a ``text``."""
        if not self.trees:
            return rows.select(*keep, F.lit(self.constant).alias("score"))
        raw = self._raw(_featured(rows, self.lexicon, keep)).select(*keep, "raw")
        scored = self.calibration.transform(raw)
        return scored.select(*keep, F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")).alias("score"))


def fit_toxicity(documents: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learn a model from ``labels`` (doc_id, toxic 0 or 1; other values and NULLs are skipped).

    Without rows of both kinds every text gets the share of toxic rows (0 without any).
    """
    rows = stage(training_rows(documents, labels), "training")
    total = rows.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    toxic = int(total.t or 0)
    if not 0 < toxic < total.n:
        return ToxicityModel({}, None, None, float(toxic / total.n) if total.n else 0.0)
    lexicon = learn_lexicon(rows.select("text", "toxic"))
    featured = stage(_featured(rows, lexicon, ["doc_id", "toxic", "fold"]), "features").coalesce(8)
    model = ToxicityModel(lexicon, None, None, 0.0)
    trees = GBTClassifier(labelCol="toxic", maxIter=20, maxDepth=3, stepSize=0.3, maxBins=64, seed=7)
    vectors = model.vector.transform(featured)
    fit = vectors.where("fold <> 1")
    kinds = {r.toxic for r in fit.select("toxic").distinct().collect()}
    model.trees = trees.fit(fit if len(kinds) == 2 else vectors)
    held = model._raw(featured.where("fold = 1"))
    held = held if held.agg(F.sum("toxic")).first()[0] else model._raw(featured)
    counted = held.groupBy("raw").agg(F.avg("toxic").alias("share"), F.count("*").cast("double").alias("rows"))
    model.calibration = IsotonicRegression(featuresCol="raw", labelCol="share", weightCol="rows").fit(counted)
    return model


def toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``documents`` (doc_id, text).

    A NULL or empty text is scored by its (zero) features like any other; a NULL
    ``doc_id`` counts as the empty text in its checksum.  Repeated rows come back as often as they
    came in, with equal scores.  Labels, language, source and id are never inputs.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    model = fit_toxicity(documents, labels)
    rows = documents.select(safe_id("doc_id"), F.col("text").cast("string").alias("text"))
    return model.score(rows, ["doc_id"]).select(
        true_id("doc_id"),
        (fold_of(true_id("doc_id")) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
