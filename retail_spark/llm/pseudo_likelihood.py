"""Masked pseudo-likelihood of documents under a bidirectional window network.

Every word is predicted from the two words on either side.  Words are numbered by frequency over the whole
corpus, and a number is predicted in three steps, each a choice that narrows the numbers
down, so a prediction costs three small softmaxes.  The count of numbers grows with the
square root of the distinct words.  The words beyond share the last numbers; such a word's probability is that of its
number times its part in the number's occurrences, by a table of the counts of all words that is joined
and never gathered.  The summed log-probabilities of a document's words, each given its surroundings, are its pseudo-likelihood.

Training is data parallel, in numpy: the files of numbered documents are taken together into parts of at least so many
words per number on average, without a shuffle, and every part masks
a share of its positions, starts from the common parameters and learns from its own masks; parameters are
averaged, weighted by masks.  The rounds mask different positions, all of them in the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from retail_spark.llm.common import mix, safe_id, true_id
from retail_spark.llm.shingles import word_hashes
from retail_spark.sources.scratch import stage

LEAST_GROUPS, PLACES, WIDTH, SIDE = 32, 64, 16, 2
#: Choices that tell a number, and how much more the rarer parameters of each move in a step.
LEVELS, LIFT = 3, (1, 8, 8)
RARE = 64  # the last numbers are shared by rare words
MASKED_PART, ROUNDS, BATCH, STEP = 8, 2, 2048, 0.3
#: Groups per square root of the distinct words, and words per number in a part that trains.
GROUPS_PER_ROOT, PART_WORDS = 1 / 8, 512
#: Positions that are scored at once, words of texts that are taken together, and words that are counted at once.
CHUNK, TOGETHER, COUNTED = 2048, 1 << 17, 1_000_000
#: Parameters in a row, and sums of a row's parts before the last one.
ROW, LOTS = 4096, 4


def groups_for(distinct: int) -> int:
    """The count of groups of ``PLACES`` numbers for so many distinct words."""
    return max(LEAST_GROUPS, math.ceil(math.sqrt(distinct) * GROUPS_PER_ROOT))


def side_of(groups: int) -> int:
    """Choices of a level, so that ``LEVELS`` of them tell all numbers apart."""
    side = 2
    while side**LEVELS < groups * PLACES:
        side += 1
    return side


def shapes(groups: int) -> dict[str, tuple[int, ...]]:
    """Shapes of the parameters; the number after the last stands beyond the ends of a text."""
    side, out = side_of(groups), {"seen": (2 * SIDE, groups * PLACES + 1, WIDTH), "shift": (WIDTH,)}
    for k in range(LEVELS):
        out |= {f"choice{k}": (WIDTH, side), f"after{k}": (side**k, WIDTH), f"bias{k}": (side**k, side)}
    return out


def initial(groups: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(11)
    return {k: (rng.normal(size=s) * (0 if "bias" in k else 0.1)).astype(np.float32) for k, s in shapes(groups).items()}


def choices(numbers: np.ndarray, side: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per level, the choices before it as one number, and the choice."""
    for k in range(LEVELS):
        yield k, *np.divmod(numbers // side ** (LEVELS - 1 - k), side)


def flat(parameters: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([v.ravel() for v in parameters.values()])


def shaped(values: np.ndarray, groups: int) -> dict[str, np.ndarray]:
    out, start = {}, 0
    for k, shape in shapes(groups).items():
        size = int(np.prod(shape))
        out[k] = np.asarray(values[start : start + size], np.float32).reshape(shape)
        start += size
    return out


def numbers_of(words: np.ndarray, vocabulary: np.ndarray, rank: np.ndarray, groups: int) -> np.ndarray:
    """The numbers of words; ``vocabulary`` is sorted, ``rank`` holds its numbers."""
    number = groups * PLACES - RARE + (mix(words) % np.uint64(RARE)).astype(np.int64)
    if len(vocabulary) and len(words):
        # Hashes are even, so their leading bits part the vocabulary into slots of about one word in eight.
        bits = len(vocabulary).bit_length() + 3
        held = np.bincount((vocabulary >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        start = np.cumsum(held) - held
        slot = (words >> np.uint64(64 - bits)).astype(np.int64)
        size = held[slot]
        for k in range(held.max()):
            some = np.flatnonzero(size > k)
            at = start[slot[some]] + k
            known = vocabulary[at] == words[some]
            number[some[known]] = rank[at[known]]
    return number


class Texts:
    """Some texts side by side: all words, the words around each, and each word's text and place."""

    def __init__(self, numbers: np.ndarray, sizes: np.ndarray, edge: int):
        self.numbers, self.sizes = numbers.astype(np.int64), sizes.astype(np.int64)
        self.text = np.repeat(np.arange(len(sizes)), self.sizes)
        self.place = np.arange(len(numbers)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        # ``SIDE`` ends stand before every text and after the last one.
        self.at = np.arange(len(self.numbers)) + SIDE * (self.text + 1)
        self.padded = np.full(len(numbers) + SIDE * (len(sizes) + 1), edge)
        self.padded[self.at] = self.numbers

    def around(self, part: slice | np.ndarray) -> np.ndarray:
        """The words around some positions, by offset and position."""
        at = self.at[part]
        return np.stack([self.padded[at + o] for o in (*range(-SIDE, 0), *range(1, SIDE + 1))])


def side_by_side(column: pa.ListArray, edge: int) -> Iterator[Texts]:
    """The texts of a column in lots of at most ``TOGETHER`` words, or of one text."""
    ends, numbers, at = np.asarray(column.offsets), np.asarray(column.values), 0
    while at < len(column):
        upto = max(at + 1, int(np.searchsorted(ends, int(ends[at]) + TOGETHER, "right")) - 1)
        yield Texts(numbers[ends[at] : ends[upto]], np.diff(ends[at : upto + 1]), edge)
        at = upto


def _exponentials(x: np.ndarray) -> np.ndarray:
    """The exponentials of rows, in place, each row up to a factor."""
    if max(x.max(initial=0), -x.min(initial=0)) > 60:  # else nothing can overflow
        x -= x.max(axis=1, keepdims=True)
    return np.exp(x, out=x)


def _hidden(p: dict, around: np.ndarray) -> np.ndarray:
    hidden = p["seen"][0].take(around[0], axis=0)
    for k in range(1, 2 * SIDE):
        hidden += p["seen"][k].take(around[k], axis=0)
    hidden += p["shift"]
    return np.tanh(hidden, out=hidden)


def _logits(p: dict, level: int, hidden: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What a level sees, and its logits."""
    seen = hidden + p[f"after{level}"].take(before, axis=0)
    x = seen @ p[f"choice{level}"]
    x += p[f"bias{level}"].take(before, axis=0)
    return seen, x


def log_probabilities(p: dict, texts: Texts) -> np.ndarray:
    """Per text, the summed log-probability of every number given those around it."""
    found, side = np.empty(len(texts.numbers)), p["bias0"].shape[1]
    ones = np.ones(side, np.float32)
    for start in range(0, len(found), CHUNK):
        part = slice(start, start + CHUNK)
        hidden, chance = _hidden(p, texts.around(part)), 1.0
        row = np.arange(len(hidden))
        for k, before, choice in choices(texts.numbers[part], side):
            x = _exponentials(_logits(p, k, hidden, before)[1])
            chance = chance * (x[row, choice] / (x @ ones))
        found[part] = np.log(np.maximum(chance, 1e-30), dtype=np.float64)
    return np.bincount(texts.text, found, len(texts.sizes))


def _add_rows(into: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    width = into.shape[1]
    np.add.at(into.reshape(-1), ((at * width)[:, None] + np.arange(width)).ravel(), rows.ravel())


def train_step(p: dict, around: np.ndarray, numbers: np.ndarray) -> None:
    """One gradient step on a batch of masked positions, in place."""
    # Positions with the same choices before a level stand together; short numbers sort faster.
    order = np.argsort(numbers.astype(np.uint16) if len(p["seen"][0]) < 1 << 16 else numbers, kind="stable")
    around, numbers = around[:, order], numbers[order]
    row, n = np.arange(len(numbers)), np.float32(len(numbers) ** 0.5)
    rate, side = np.float32(STEP) / n, p["bias0"].shape[1]
    ones = np.ones(side, np.float32)
    hidden = _hidden(p, around)
    back = np.zeros_like(hidden)
    for k, before, choice in choices(numbers, side):
        seen, x = _logits(p, k, hidden, before)
        x = _exponentials(x)
        x *= (1 / (x @ ones))[:, None]
        x[row, choice] -= 1
        own = x @ p[f"choice{k}"].T
        back += own
        start = np.flatnonzero(np.diff(before, prepend=-1))
        p[f"choice{k}"] -= rate / n * (seen.T @ x)
        p[f"after{k}"][before[start]] -= rate / n * LIFT[k] * np.add.reduceat(own, start)
        p[f"bias{k}"][before[start]] -= rate / n * LIFT[k] * np.add.reduceat(x, start)
    back *= 1 - hidden**2
    p["shift"] -= rate / n * back.sum(0)
    back *= -rate
    for k in range(2 * SIDE):
        _add_rows(p["seen"][k], around[k], back)


def word_counts(docs: DataFrame) -> DataFrame:
    """``word, times`` of every distinct word of all documents, by its hash."""

    def counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def merged() -> pd.DataFrame:
            word, times = np.unique(np.concatenate(held), return_counts=True)
            return pd.DataFrame({"word": word.view(np.int64), "times": times})

        for frame in frames:
            for text in frame["text"]:
                held.append(word_hashes(text))
                size += len(held[-1])
                if size > COUNTED:
                    yield merged()
                    held, size = [], 0
        if held:
            yield merged()

    words = docs.select("text").mapInPandas(counted, "word long, times long")
    return stage(words.groupBy("word").agg(F.sum("times").alias("times")), "words")


def _vocabulary(counts: DataFrame, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent words (as hashes, sorted) and their numbers; all but the shared numbers are given out."""
    top = counts.orderBy(F.desc("times"), "word").limit(groups * PLACES - RARE).select("word").toPandas()
    word = top["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(word)
    return word[order], np.arange(len(word))[order]


def _shared(counts: DataFrame, vocabulary: np.ndarray, rank: np.ndarray, groups: int) -> np.ndarray:
    """How often each shared number occurs in all documents."""

    def summed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = groups * PLACES - RARE
        for frame in frames:
            place = numbers_of(frame["word"].to_numpy(np.int64).view(np.uint64), vocabulary, rank, groups) - first
            rare = frame[place >= 0].assign(place=place[place >= 0])
            yield rare.groupby("place", as_index=False)["times"].sum()

    rows = counts.mapInPandas(summed, "place long, times long").groupBy("place").agg(F.sum("times").alias("times")).collect()
    total = np.zeros(RARE)
    for row in rows:
        total[row["place"]] = row["times"]
    return total


def _mean(frame: pd.DataFrame) -> pd.DataFrame:
    """The mean of rows of parameters, weighted by steps."""
    steps = frame["steps"].to_numpy()
    values = sum(np.asarray(v, np.float64) * n for v, n in zip(frame["values"], steps)) / steps.sum()
    return pd.DataFrame({"at": frame["at"].iloc[:1], "values": [values], "steps": [steps.sum()]})


def _trained(texts: DataFrame, start: np.ndarray, groups: int, turn: int) -> np.ndarray:
    """Parameters after a round: the mean over partitions, weighted by masked positions."""

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = {k: v.copy() for k, v in shaped(start, groups).items()}
        around, wanted, held, steps = [], [], 0, 0

        def step() -> None:
            nonlocal around, wanted, held, steps
            a, w = np.concatenate(around, axis=1), np.concatenate(wanted)
            for at in range(0, len(w), BATCH):
                train_step(p, a[:, at : at + BATCH], w[at : at + BATCH])
            steps += len(w)
            around, wanted, held = [], [], 0

        for batch in batches:
            for texts in side_by_side(batch.column("numbers"), groups * PLACES):
                masked = np.flatnonzero(masks(texts.sizes[texts.text], turn, texts.place))
                if len(masked):
                    around.append(texts.around(masked))
                    wanted.append(texts.numbers[masked])
                    held += len(masked)
                    if held >= 16 * BATCH:
                        step()
        if held:
            step()
        if steps:
            values, lot = flat(p), TaskContext.get().partitionId() % LOTS
            rows = [{"at": at, "lot": lot, "values": values[at : at + ROW], "steps": float(steps)} for at in range(0, len(values), ROW)]
            kind = {"at": pa.int32(), "lot": pa.int32(), "values": pa.list_(pa.float32()), "steps": pa.float64()}
            yield pa.RecordBatch.from_pylist(rows, pa.schema(kind))

    parts = texts.mapInArrow(learn, "at int, lot int, values array<float>, steps double")
    kind = "at int, values array<float>, steps double"
    rows = parts.groupBy("at", "lot").applyInPandas(_mean, kind).groupBy("at").applyInPandas(_mean, kind)
    rows = rows.toPandas().sort_values("at")  # as many values as the model has parameters
    return np.concatenate(rows["values"].to_list()).astype(np.float32) if len(rows) else start


def masks(size: int | np.ndarray, turn: int, place: np.ndarray | None = None) -> np.ndarray:
    """Which places (all by default) of a text of a size a round masks: its share of the ``MASKED_PART`` classes."""
    return mix((np.arange(size) if place is None else place) + size) % np.uint64(MASKED_PART) % np.uint64(ROUNDS) == turn


def pseudo_likelihood(documents: DataFrame) -> DataFrame:
    """``doc_id, n_words, log_likelihood, mean_log_likelihood`` for every row of ``documents`` (doc_id, text).

    The mean is per word.  A NULL or empty text has no words, a sum of 0 and no mean (NULL).  Repeated
    rows come back as often as they came in and are learnt from as often; NULL ids stay NULL.  Other
    columns are ignored, whatever their names; an empty table gives no rows.
    """
    docs = documents.select(safe_id("doc_id"), F.col("text").cast("string").alias("text"))
    counts = word_counts(docs)
    size = counts.agg(F.count("*").alias("words"), F.coalesce(F.sum("times"), F.lit(0)).alias("times")).first()
    groups = groups_for(size["words"])
    vocabulary, rank = _vocabulary(counts, groups)
    shared = _shared(counts, vocabulary, rank, groups)
    parts = max(1, -(-size["times"] // (PART_WORDS * groups * PLACES)))

    def numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = groups * PLACES - RARE

        def record(ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
            numbers = numbers_of(np.concatenate(held), vocabulary, rank, groups).astype(np.int32)
            ends = np.cumsum([0, *map(len, held)])
            among, rare, often = np.zeros(len(held)), [], []
            for k, words in enumerate(held):
                own = numbers[ends[k] : ends[k + 1]]
                few = own >= first
                among[k] = np.log(shared[own[few] - first]).sum()
                word, times = np.unique(words[few].view(np.int64), return_counts=True)
                rare.append(word)
                often.append(times.astype(np.int32))
            some = np.cumsum([0, *map(len, rare)])
            lists = [(ends, numbers), (some, np.concatenate(rare)), (some, np.concatenate(often))]
            numbers, rare, often = [pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(v)) for e, v in lists]
            return pa.RecordBatch.from_arrays([ids, numbers, pa.array(among), rare, often], ["doc_id", "numbers", "among", "rare", "often"])

        for batch in batches:
            held, size, start = [], 0, 0
            for k, text in enumerate(batch.column("text")):
                held.append(word_hashes(text.as_py()))
                size += len(held[-1])
                if size >= TOGETHER or k + 1 == batch.num_rows:
                    yield record(batch.column("doc_id").slice(start, len(held)), held)
                    held, size, start = [], 0, k + 1

    kind = "doc_id long, numbers array<int>, among double, rare array<long>, often array<int>"
    texts = stage(docs.mapInArrow(numbered, kind).withColumn("row", F.monotonically_increasing_id()), "numbers")
    values = flat(initial(groups))
    for turn in range(ROUNDS):
        values = _trained(texts.select("numbers").coalesce(parts), values, groups, turn)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = shaped(values, groups)
        for batch in batches:
            lots = side_by_side(batch.column("numbers"), groups * PLACES)
            score = np.concatenate([np.empty(0), *(log_probabilities(p, texts) for texts in lots)])
            n_words = pa.array(np.diff(np.asarray(batch.column("numbers").offsets)), pa.int64())
            score = pa.array(score - np.asarray(batch.column("among")))
            columns = [batch.column("row"), batch.column("doc_id"), n_words, score]
            yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "n_words", "of_numbers"])

    found = texts.select("row", "doc_id", "numbers", "among")
    found = found.mapInArrow(scored, "row long, doc_id long, n_words long, of_numbers double")
    # No word here is frequent: the frequent ones have numbers of their own.
    rare = texts.select("row", F.explode(F.arrays_zip("rare", "often")).alias("each")).select("row", "each.often", F.col("each.rare").alias("word"))
    rare = rare.join(counts, "word").groupBy("row").agg(F.sum(F.col("often") * F.log("times")).alias("of_words"))
    found = found.join(rare, "row", "left")
    found = found.withColumn("log_likelihood", F.col("of_numbers") + F.coalesce("of_words", F.lit(0.0)))
    return found.select(
        true_id("doc_id"), "n_words", "log_likelihood", F.try_divide("log_likelihood", "n_words").alias("mean_log_likelihood")
    )
