"""Phrase collocations by best-first branch-and-bound growth.

A phrase of counts a = f(phrase), l = f(first k words) and r = f(rest) scores floor(1000 * a * n / (l * r)) at
its worst cut k.  As a <= r at the first cut, no phrase that begins with the word w scores more than
1000 * n / f(w): the count of a prefix bounds all that grows from it, and a prefix found less than
``LEAST`` times grows nothing.  So words are expanded best first, that is rarest first, in waves: a wave takes
the next words of each language by that bound until their occurrences make up a share of the text, grows them by
two words, keeps the prefixes that are frequent, grows those by two more, and scores what is
frequent.  A language is settled when its ``TOP``-th surviving score lies above the bound of
all words not expanded (a tie still counts as open); until then the next wave takes four times as much, but
never words whose bound lies below the score reached.

Every pass reads the whole texts again and emits numbers or phrases that are counted in Spark.  What workers
need to know (the frontier, frequent words and prefixes) comes as bitmaps of bounded size that may let
others through, never less: the counts that decide are those of whole phrases, made afterwards.
A phrase lies inside a longer candidate just as frequent if the word before it, or after it, is
always the same one; each count therefore carries the smallest and largest number of both neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from retail_spark.llm.word_grams import Words, among, bitmap, fold, grouped, runs, salt_of, slices
from retail_spark.sources.scratch import stage

LEAST = 100
WORDS = 5
TOP = 2000
NO_LANG = "und"
#: The first wave expands words that make up one in so many of a language's words; every later one four times as many.
FIRST_SHARE = 16
#: Words are dealt to waves by bands of their count: four to a doubling.
BANDS = 4
#: Up to so many languages their rows (a name and two numbers) are broadcast.
FEW_LANGUAGES = 100_000

_GROWN = 3  # words of a phrase after the first step of a wave
COUNTS = "lang string, g1 long, g2 long, n long"
PHRASES = "lang string, phrase string, n long, left_lo long, left_hi long, right_lo long, right_hi long"


def _texts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    return docs.select(
        F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), F.col(text).cast("string").alias("text")
    ).where("text <> ''")


def _blocks(batches: Iterator[pa.RecordBatch], before: int, after: int) -> Iterator[tuple[str, Words]]:
    """Slices of the texts of one language each."""
    for batch in batches:
        langs, texts = batch.column("lang").dictionary_encode(), batch.column("text").cast(pa.binary())
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            own = texts.filter(pc.equal(langs.indices, code))
            for words in slices(fold(own.to_pylist()), before, after):
                yield lang, words


def _signed(numbers: np.ndarray) -> pa.Array:
    return pa.array(numbers.view(np.int64), pa.int64())


def _counts(lang: str, g1: np.ndarray, g2: np.ndarray) -> pa.RecordBatch:
    order, first, n = grouped(g1, g2)
    own = order[first]
    columns = [pa.repeat(lang, len(own)), _signed(g1[own]), _signed(g2[own]), pa.array(n, pa.int64())]
    return pa.RecordBatch.from_arrays(columns, names=["lang", "g1", "g2", "n"])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words by their two numbers; NULL numbers stand for all words of a language."""
    for lang, words in _blocks(batches, 0, 0):
        salt = salt_of(lang)
        yield _counts(lang, words.numbers(salt, 0), words.numbers(salt, 1))
        none = pa.nulls(1, pa.int64())
        total = pa.array([words.own.stop - words.own.start], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array([lang]), none, none, total], names=["lang", "g1", "g2", "n"])


def _count_prefixes(frontier: np.ndarray, frequent: np.ndarray, longest: int):
    """Runs of two and three frequent words that begin in the frontier, by one number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _blocks(batches, 0, _GROWN - 1):
            one = words.numbers(salt_of(lang), 0)
            known = among(frequent, one)
            good = among(frontier, one[words.own])
            number, found = runs(one, words.own, 1, 0), []
            for size in range(2, min(_GROWN, longest) + 1):
                number = runs(one, words.own, size, 0, number)
                good = good & words.within(size) & _ahead(known, words.own, size - 1)
                found.append(number[good])
            both = np.concatenate(found)
            yield _counts(lang, both, np.zeros_like(both))

    return run


def _ahead(flags: np.ndarray, own: slice, by: int) -> np.ndarray:
    """The flag of the word ``by`` places on, false beyond the slice."""
    out = np.zeros(own.stop - own.start, dtype=bool)
    part = flags[own.start + by : own.stop + by]
    out[: len(part)] = part
    return out


def _count_phrases(frontier: np.ndarray, frequent: np.ndarray, prefixes: np.ndarray, longest: int):
    """Phrases that begin in the frontier with their neighbours: frequent prefixes and what extends them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _blocks(batches, 1, longest):
            salt, own = salt_of(lang), words.own
            one, two = words.numbers(salt, 0), words.numbers(salt, 1)
            known = among(frequent, one)
            good = among(frontier, one[own])
            number, other = runs(one, own, 1, 0), runs(two, own, 1, 1)
            for size in range(2, longest + 1):
                number, other = runs(one, own, size, 0, number), runs(two, own, size, 1, other)
                good = good & words.within(size) & _ahead(known, own, size - 1)
                if size <= _GROWN:
                    good = good & among(prefixes, number)
                at = np.flatnonzero(good)
                if not len(at):
                    break
                order, first, n = grouped(number[at], other[at])
                left = _neighbour(one, words.piece, own.start + at, -1)[order].view(np.int64)
                right = _neighbour(one, words.piece, own.start + at + size - 1, 1)[order].view(np.int64)
                texts = [words.text(own.start + int(k), size) for k in at[order[first]]]
                columns = [pa.repeat(lang, len(n)), pa.array(texts, pa.binary()).cast(pa.string()), pa.array(n, pa.int64())]
                columns += [pa.array(f.reduceat(side, first), pa.int64()) for side in (left, right) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays(columns, names=PHRASE_COLUMNS)

    return run


PHRASE_COLUMNS = ["lang", "phrase", "n", "left_lo", "left_hi", "right_lo", "right_hi"]


def _neighbour(one: np.ndarray, piece: np.ndarray, at: np.ndarray, by: int) -> np.ndarray:
    """The number of the word before or after, 0 where the piece ends."""
    place = np.clip(at + by, 0, len(piece) - 1)
    inside = (place == at + by) & (piece[place] == piece[at])
    return np.where(inside, one[place], np.uint64(0))


def _count_rests(wanted: np.ndarray, longest: int):
    """Runs of two and more words that may be wanted, wherever they lie, by both numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, words in _blocks(batches, 0, longest - 1):
            salt, own = salt_of(lang), words.own
            one, two = words.numbers(salt, 0), words.numbers(salt, 1)
            number, found = runs(one, own, 1, 0), []
            for size in range(2, longest):
                number = runs(one, own, size, 0, number)
                at = np.flatnonzero(words.within(size) & among(wanted, number))
                found.append((number[at], runs(two, own, size, 1)[at]))
            yield _counts(lang, *(np.concatenate(part) for part in zip(*found)))

    return run


def _cuts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every phrase once per cut, with the numbers of both parts and of the whole."""
    names = ["lang", "phrase", "k", "words", "l1", "l2", "r1", "r2", "g1", "g2"]
    for batch in batches:
        langs = batch.column("lang").dictionary_encode()
        for code, lang in enumerate(langs.dictionary.to_pylist()):
            phrases = batch.column("phrase").filter(pc.equal(langs.indices, code))
            done = 0
            for words in slices(fold(phrases.cast(pa.binary()).to_pylist()), 0, WORDS * 4):
                own, salt = words.own, salt_of(lang)
                begins = np.flatnonzero(np.diff(words.piece[own], prepend=-1))
                size = np.diff(begins, append=own.stop - own.start)
                numbers = [words.numbers(salt, which) for which in (0, 1)]
                at = [{m: runs(numbers[w], own, m, w) for m in range(1, size.max(initial=0) + 1)} for w in (0, 1)]
                for m in np.unique(size):
                    which = np.flatnonzero(size == m)
                    head = begins[which]
                    for k in range(1, m):
                        parts = [at[0][k][head], at[1][k][head], at[0][m - k][head + k], at[1][m - k][head + k]]
                        columns = [pa.repeat(lang, len(head)), phrases.take(pa.array(done + which))]
                        columns += [pa.repeat(pa.scalar(int(x), pa.int32()), len(head)) for x in (k, m)]
                        columns += [_signed(np.ascontiguousarray(x)) for x in (*parts, at[0][m][head], at[1][m][head])]
                        yield pa.RecordBatch.from_arrays(columns, names=names)
                done += len(begins)


CUTS = "lang string, phrase string, k int, words int, l1 long, l2 long, r1 long, r2 long, g1 long, g2 long"


def _per_language(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A row per language; sent to all tasks while they are few, so that a language's rows need not meet in one task."""
    frame = spark.createDataFrame(rows, schema)
    return F.broadcast(frame) if len(rows) <= FEW_LANGUAGES else frame


class _Language:
    """How far one language is expanded."""

    def __init__(self, total: int):
        self.total = total
        self.bands: list[tuple[int, int]] = []  # largest count in the band, occurrences of its words; rarest first
        self.done = 0  # words of at most this count are expanded
        self.reached = 0  # the score of the last of the first TOP survivors

    def limit(self) -> int:
        """Words beyond this count cannot reach the score."""
        most = self.bands[-1][0] if self.bands else 0
        return min(most, 1000 * self.total // self.reached) if self.reached else most

    def next(self, share: float) -> int:
        mass = 0
        for most, occurrences in self.bands:
            if most <= self.done:
                continue
            mass += occurrences
            if mass >= share * self.total or most >= self.limit():
                return min(most, self.limit())
        return self.limit()


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = WORDS, top: int = TOP
) -> DataFrame:
    """The first ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score, cut``.

    Phrases have two to ``longest`` words within a piece and occur ``least`` times or more; a phrase inside a longer such
    phrase that is as frequent is left out.  A NULL language is ``und``; NULL and empty texts have no words;
    repeated rows count each time; ties go by ``a`` from the largest, then by the phrase's bytes.  Other columns,
    whatever their names, are left out.  An empty table, or one without such phrases, gives no rows.
    """
    spark, texts = docs.sparkSession, _texts(docs, text, lang)
    counted = texts.mapInArrow(_count_words, COUNTS).groupBy("lang", "g1", "g2").agg(F.sum("n").alias("n"))
    words = stage(counted.where(F.col("g1").isNull() | (F.col("n") >= least)), "words")
    state = {r["lang"]: _Language(r["n"]) for r in words.where("g1 is null").collect()}  # a row per language
    words = words.where("g1 is not null")
    band = F.floor(F.log2("n") * BANDS)
    for r in words.groupBy("lang", band.alias("band")).agg(F.max("n").alias("most"), F.sum("n").alias("mass")).orderBy("most").collect():
        state[r["lang"]].bands.append((r["most"], r["mass"]))
    totals = _per_language(spark, [(name, s.total) for name, s in state.items()], "lang string, total long")
    frequent = bitmap(words, "g1")
    known, survivors, share = [words.select("g1", "g2", "n")], [], 1 / FIRST_SHARE
    while limits := [(name, s.done, s.next(share)) for name, s in state.items() if s.done < s.limit()]:
        wave = _per_language(spark, limits, "lang string, low long, high long")
        expanded = stage(words.join(wave, "lang").where("n > low and n <= high").select("g1", "g2"), "frontier")
        frontier = bitmap(expanded, "g1")
        counts = texts.mapInArrow(_count_prefixes(frontier, frequent, longest), COUNTS).groupBy("g1").agg(F.sum("n").alias("n"))
        prefixes = bitmap(stage(counts.where(F.col("n") >= least), "prefixes"), "g1")
        grown = texts.mapInArrow(_count_phrases(frontier, frequent, prefixes, longest), PHRASES).groupBy("lang", "phrase")
        ends = [f(c).alias(c) for c, f in zip(PHRASE_COLUMNS[3:], (F.min, F.max, F.min, F.max))]
        phrases = stage(grown.agg(F.sum("n").alias("n"), *ends).where(F.col("n") >= least), "phrases")
        cuts = phrases.select("lang", "phrase").mapInArrow(_cuts, CUTS)
        # The bitmap may have let other first words through, whose turn is in another wave.
        begins = cuts.where("k = 1").select("lang", "phrase", F.col("l1").alias("g1"), F.col("l2").alias("g2"))
        begins = begins.join(expanded, ["g1", "g2"], "left_semi").select("lang", "phrase")
        cuts = stage(cuts.join(begins, ["lang", "phrase"], "left_semi"), "cuts")
        own = cuts.where("k = 1").select("lang", "phrase", "g1", "g2").join(phrases.select("lang", "phrase", "n"), ["lang", "phrase"])
        known.append(stage(own.select("g1", "g2", "n"), "counts"))
        all_known = reduce(DataFrame.unionByName, known)
        open_rests = cuts.where("words - k > 1").select(F.col("r1").alias("g1"), F.col("r2").alias("g2")).distinct()
        open_rests = stage(open_rests.join(all_known, ["g1", "g2"], "left_anti"), "rests")
        counts = texts.mapInArrow(_count_rests(bitmap(open_rests, "g1"), longest), COUNTS).groupBy("g1", "g2").agg(F.sum("n").alias("n"))
        known.append(stage(counts.join(open_rests, ["g1", "g2"], "left_semi"), "counts"))
        survivors.append(stage(_surviving(phrases, cuts, reduce(DataFrame.unionByName, known).distinct(), totals, longest), "survivors"))
        share *= 4
        scores = reduce(DataFrame.unionByName, survivors).select("lang", "score")
        by_score = Window.partitionBy("lang").orderBy(F.desc("score"))
        best = scores.withColumn("place", F.row_number().over(by_score)).where(F.col("place") <= top)
        reached = {r["lang"]: r["score"] for r in best.where(F.col("place") == top).collect()}
        for name, _, high in limits:
            state[name].done = high
        for name, score in reached.items():
            state[name].reached = score
    if not survivors:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long, cut int")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = reduce(DataFrame.unionByName, survivors).withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score", "cut")


def _surviving(phrases: DataFrame, cuts: DataFrame, known: DataFrame, totals: DataFrame, longest: int) -> DataFrame:
    """Phrases that lie in no longer one as frequent, with their worst cut."""
    same = lambda side: (F.col(f"{side}_lo") == F.col(f"{side}_hi")) & (F.col(f"{side}_lo") != 0)
    n_words = F.size(F.split("phrase", " "))
    kept = phrases.where((n_words == longest) | ~(same("left") | same("right"))).select("lang", "phrase", F.col("n").alias("a"))
    part = lambda side, name: known.select(F.col("g1").alias(f"{side}1"), F.col("g2").alias(f"{side}2"), F.col("n").alias(name))
    tried = cuts.join(kept, ["lang", "phrase"]).join(part("l", "l"), ["l1", "l2"]).join(part("r", "r"), ["r1", "r2"]).join(totals, "lang")
    exact = lambda name: f"cast({name} AS decimal(17, 0))"
    score = F.expr(f"(cast(1000 AS decimal(4, 0)) * {exact('a')} * {exact('total')}) div ({exact('l')} * {exact('r')})")
    tried = tried.withColumn("score", score.cast("long"))
    worst = tried.groupBy("lang", "phrase").agg(
        F.first("a").alias("a"), F.first("total").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("worst")
    )
    return worst.select("lang", "phrase", "a", "worst.l", "worst.r", "n", "worst.score", F.col("worst.k").alias("cut"))


def oracle(least: int = LEAST, longest: int = WORDS, top: int = TOP) -> str:
    """The same in SQL: every run of words is counted."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return f"""WITH pieces AS (SELECT coalesce(lang, '{NO_LANG}') AS lang,
        unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
    worded AS (SELECT lang, list_filter(string_split_regex(piece, '[ \\t]+'), lambda w: w <> '') AS w FROM pieces),
    totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM worded GROUP BY lang),
    grams AS (SELECT lang, m, w[i:i + m - 1] AS g FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i
        FROM worded, (SELECT unnest(range(1, {longest + 1})) AS m) s WHERE len(w) >= m) t),
    f AS MATERIALIZED (SELECT lang, m, g, count(*) AS n FROM grams GROUP BY ALL HAVING count(*) >= {least}),
    cut AS (SELECT p.lang, p.g, p.n AS a, k, l.n AS l, r.n AS r,
        CAST((CAST(1000 AS HUGEINT) * p.n * t.n) // (CAST(l.n AS HUGEINT) * r.n) AS BIGINT) AS score, t.n AS n
        FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1) p JOIN totals t ON t.lang = p.lang
        JOIN f l ON l.lang = p.lang AND l.g = p.g[1:k] JOIN f r ON r.lang = p.lang AND r.g = p.g[k + 1:p.m]),
    scored AS (SELECT lang, g, any_value(a) AS a, any_value(n) AS n, min({{'score': score, 'k': k, 'l': l, 'r': r}}) AS worst FROM cut GROUP BY lang, g),
    longer AS (SELECT DISTINCT lang, g, n FROM (SELECT lang, g[1:m - 1] AS g, n FROM f WHERE m > 2 UNION ALL SELECT lang, g[2:m] AS g, n FROM f WHERE m > 2) t),
    ranked AS (SELECT s.lang, array_to_string(s.g, ' ') AS phrase, a, worst.l AS l, worst.r AS r, n, worst.score AS score FROM scored s
        WHERE NOT EXISTS (SELECT 1 FROM longer x WHERE x.lang = s.lang AND x.g = s.g AND x.n = s.a))
    SELECT * FROM (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM ranked) t
    WHERE rank <= {top}"""


ORACLE_SQL = oracle()
