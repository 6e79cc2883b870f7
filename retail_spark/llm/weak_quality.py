"""Quality classifier from weak labels: overlapping heuristics, their accuracies by expectation-maximisation, a hashed linear scorer.

Each rule votes good, bad or nothing on a text.  The votes of all documents are
counted per pattern of votes (3 to the power of the rules at most, whatever the
number of documents).  Rules that look at one trait of a text are not independent, as
expectation-maximisation takes labellers to be, so a trait is one labeller: bad where one of its rules
says so, else good where one does.  On the counts expectation-maximisation estimates how often good
documents there are and how each labeller votes on good and on bad ones.  A pattern's posterior
labels a bounded sample of documents, on which a logistic model over hashed words and
word shapes is trained; it scores every whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import drawn, mix, safe_id, true_id
from retail_spark.llm.quality_rules import counts_of
from retail_spark.llm.shingles import word_hashes
from retail_spark.sources.scratch import stage

BUCKETS = 1 << 16
#: The scorer is trained on at most about so many documents.
TRAINING_ROWS = 8_000
EPOCHS, STEP, SHRINK = 4, 0.5, 1e-6
ROUNDS = 100
GOOD, NONE, BAD = 2, 1, 0
LABELLERS = ("length", "symbols", "repeats", "lines", "word_length", "sentences", "tables", "variety", "capitals")

#: The rules of one trait, by position in ``LABELLERS``: length, writing, repetition.
TRAITS = ((0,), (1, 4, 5, 6, 8), (2, 3, 7))

_CAPITAL = re.compile(r"[A-ZÀ-ÖØ-Þ]")


def _vote(value: float, good: tuple[float, float], fair: tuple[float, float]) -> int:
    """Good inside the first interval, bad outside the second, else nothing."""
    if good[0] <= value <= good[1]:
        return GOOD
    return NONE if fair[0] <= value <= fair[1] else BAD


def votes(text: str | None) -> list[int]:
    """One vote per labeller."""
    text = text or ""
    words, chars, symbols, lines, dup_lines, repeats = counts_of(text)
    if not words:
        return [BAD] + [NONE] * (len(LABELLERS) - 1)
    own_lines = [line.rstrip() for line in text.split("\n") if line.strip()]
    return [
        _vote(words, (100, 1e12), (10, 1e12)),
        _vote(symbols / chars, (0, 0.005), (0, 0.03)),
        _vote(repeats / words, (0, 0.1), (0, 0.35)),
        _vote(dup_lines / max(1, lines), (0, 0.1), (0, 0.4)) if lines > 2 else NONE,
        _vote(chars / words, (4, 6.5), (3, 9)),
        _vote(sum(line[-1] in ".!?…\"”" for line in own_lines) / max(1, len(own_lines)), (0.7, 1), (0.3, 1)),
        _vote(text.count("|") / words, (0, 0.01), (0, 0.1)),
        _vote(len(set(text.split())) / words, (0.25, 1), (0.12, 1)) if words >= 50 else NONE,
        _vote(len(_CAPITAL.findall(text)) / chars, (0, 0.1), (0, 0.3)),
    ]


def by_trait(patterns: np.ndarray) -> np.ndarray:
    """Votes of the rules (pattern, rule) to votes of the traits (pattern, trait)."""
    joint = []
    for rules in TRAITS:
        own = patterns[:, rules]
        joint.append(np.where((own == BAD).any(axis=1), BAD, own.max(axis=1)))
    return np.stack(joint, axis=1)


def fit_accuracies(patterns: np.ndarray, counts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good documents, chances of votes per class (class, labeller, vote), and each pattern's posterior of good."""
    counts = counts.astype(float)
    good = np.where((patterns == BAD).any(axis=1), 0.1, 0.9)  # a first guess: labellers are right when they object
    hot = np.eye(3)[patterns]
    hot[:, :, NONE] = 0  # no vote says nothing
    for _ in range(ROUNDS):
        weight = np.stack([(1 - good) * counts, good * counts])
        share = (weight[1].sum() + 1) / (counts.sum() + 2)
        chance = np.einsum("cp,plv->clv", weight, hot) + 0.5
        chance /= chance.sum(axis=2, keepdims=True)
        logs = np.einsum("plv,clv->cp", hot, np.log(chance)) + np.log([[1 - share], [share]])
        before, good = good, 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))
        if np.abs(good - before).max() < 1e-9:
            break
    return share, chance, good


def hashed_features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and weights (of length 1) of a text's words, and of the shapes of its words."""
    words = word_hashes(text)
    shapes = word_hashes(shapes_of(text))
    bucket = np.concatenate([mix(words) % np.uint64(BUCKETS // 2), BUCKETS // 2 + mix(shapes) % np.uint64(BUCKETS // 2)])
    at, times = np.unique(bucket.astype(np.int64), return_counts=True)
    weight = np.log1p(times) / max(1.0, np.sqrt((np.log1p(times) ** 2).sum()))
    return at, weight


def _kinds() -> np.ndarray:
    kind = np.arange(256, dtype=np.uint8)
    kind[ord("a") : ord("z") + 1] = kind[128:] = ord("a")
    kind[ord("A") : ord("Z") + 1] = ord("Z")
    kind[ord("0") : ord("9") + 1] = ord("0")
    return kind


_KIND = _kinds()


def shapes_of(text: str | None) -> str:
    """A text with every run of letters, capitals, digits or one other character cut to one."""
    kind = _KIND[np.frombuffer((text or "").encode("utf-8", "surrogatepass"), dtype=np.uint8)]
    return kind[np.diff(kind, prepend=0) != 0].tobytes().decode("ascii")


def fit_scorer(rows: list[tuple[list[int], list[float], float]]) -> np.ndarray:
    """Weights (the last one the constant) of a logistic model of (buckets, weights, chance of good)."""
    weight = np.zeros(BUCKETS + 1)
    seen = np.full(BUCKETS + 1, 1.0)
    data = [(np.array([*at, BUCKETS]), np.array([*w, 1.0]), y) for at, w, y in rows]
    rng = np.random.default_rng(3)
    for _ in range(EPOCHS):
        for k in rng.permutation(len(data)):
            at, value, y = data[k]
            slope = (1 / (1 + np.exp(-np.clip(weight[at] @ value, -30, 30))) - y) * value
            seen[at] += slope**2
            weight[at] -= STEP * slope / np.sqrt(seen[at]) + SHRINK * weight[at]
    return weight


def quality_classifier(documents: DataFrame) -> DataFrame:
    """``doc_id, votes, posterior, score, kept`` for every row of ``documents`` (doc_id, text).

    ``posterior`` is the chance of a good document given the votes, ``score`` the linear
    scorer's; ``kept`` where their mean is at least 1/2.  A NULL or empty text has one vote
    (too short).  Equal texts get equal scores; repeated rows come back as often as they came in, NULL
    ids stay NULL.  Other columns are ignored; an empty table gives no rows.
    """
    docs = documents.select(safe_id("doc_id"), F.col("text").cast("string").alias("text"))

    def voted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            frame["votes"] = ["".join(map(str, votes(t))) for t in frame.pop("text")]
            yield frame

    rows = stage(docs.mapInPandas(voted, "doc_id long, votes string"), "votes")
    counted = rows.groupBy("votes").count().orderBy("votes").collect()  # at most 3 ** labellers rows
    if not counted:
        return rows.select(
            "doc_id", "votes", F.lit(0.0).alias("posterior"), F.lit(0.0).alias("score"), F.lit(False).alias("kept")
        )
    patterns = np.array([[int(c) for c in r["votes"]] for r in counted])
    _, _, good = fit_accuracies(by_trait(patterns), np.array([r["count"] for r in counted]))
    posterior = {r["votes"]: float(g) for r, g in zip(counted, good)}

    share = min(1.0, TRAINING_ROWS / sum(r["count"] for r in counted))
    # By id and text, repeated rows once: neither an id nor a row that many share can fill the sample.
    sample = docs.where(drawn(share, "doc_id", "text")).dropDuplicates(["doc_id", "text"])

    def features(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            pairs = [hashed_features(t) for t in frame["text"]]
            chance = [posterior["".join(map(str, votes(t)))] for t in frame["text"]]
            yield pd.DataFrame(
                {"doc_id": frame["doc_id"], "at": [a.tolist() for a, _ in pairs], "w": [w.tolist() for _, w in pairs], "y": chance}
            )

    learnt = sample.mapInPandas(features, "doc_id long, at array<int>, w array<float>, y double").orderBy("doc_id", "y").collect()
    weight = fit_scorer([(r["at"], r["w"], r["y"]) for r in learnt])

    def scored(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                own = "".join(map(str, votes(text)))
                at, value = hashed_features(text)
                score = 1 / (1 + np.exp(-np.clip(weight[at] @ value + weight[-1], -30, 30)))
                out.append((doc_id, own, posterior[own], float(score)))
            yield pd.DataFrame(out, columns=["doc_id", "votes", "posterior", "score"])

    found = docs.mapInPandas(scored, "doc_id long, votes string, posterior double, score double")
    return found.select(true_id("doc_id"), "votes", "posterior", "score", ((F.col("posterior") + F.col("score")) >= 1).alias("kept"))
