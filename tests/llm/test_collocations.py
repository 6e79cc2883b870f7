"""Collocations against counting every run of words, and slices against whole texts."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from odd_rows import no_documents, odd_documents  # noqa: F401

from retail_spark.llm import word_grams
from retail_spark.llm.collocations import _count_phrases, collocations, oracle
from retail_spark.llm.word_grams import among, bitmap, fold, salt_of, slices

LEAST = 5


def pieces(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return [re.findall(r"[^\x20\x09]+", piece) for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower)]


def plain(rows, least, top, longest=5):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        name = "und" if lang is None else lang
        for words in pieces(text):
            total[name] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    count[name][tuple(words[i : i + m])] += 1
    out = []
    for name, f in count.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = {
            q
            for p, a in candidates.items()
            for size in range(2, len(p))
            for i in range(len(p) - size + 1)
            if f[q := p[i : i + size]] <= a
        }
        found = []
        for p, a in candidates.items():
            if p not in inside:
                cuts = [(1000 * a * total[name] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
                score, _, left, right = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(found)[:top], 1):
            out.append((name, rank, phrase.decode(), -a, left, right, total[name], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    words = ["the", "of", "And", "Zürich", "x" * 300, "x" * 299 + "y", "naïve", "日本", "a\x0bb", *[f"w{k}" for k in range(40)]]
    weights = [40, 30, 20, *[3] * (len(words) - 3)]
    rows = []
    for k in range(150):
        text = "".join(rng.choices(words, weights)[0] + rng.choice([" ", " ", " ", "  ", "\t", ". ", "\n", " , "]) for _ in range(60))
        rows.append((text, rng.choice(["en", "en", "de", None, "und"])))
    rows += [("copied words that always stand together, in new york city. " * 3, "en")] * 12
    rows += [("in a row in a row in a row in a row", "de")] * 6
    return [*rows, (None, "en"), ("", "en"), (" \t\n", None), ("one", "fr"), ("lonely words here", "")]


def frame(spark, rows):
    return spark.createDataFrame([(t, lang, "x", 1, 2) for t, lang in rows], "text string, lang string, phrase string, n long, g1 long")


@pytest.mark.parametrize("top", [2000, 7])
def test_every_run(spark, rows, top):
    found = collocations(frame(spark, rows).repartition(3), least=LEAST, top=top).drop("cut")
    assert sorted(map(tuple, found.collect())) == plain(rows, LEAST, top)


def test_sql(spark, rows):
    duck = duckdb.connect()
    duck.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    duck.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    assert sorted(duck.execute(oracle(least=LEAST, top=30)).fetchall()) == plain(rows, LEAST, 30)


def test_early_waves_settle_what_later_ones_cannot_change(spark):
    # Rare words that always stand together score highest; frequent words never need to be expanded.
    rng = random.Random(1)
    rows = []
    for k in range(60):
        pair = f"left{k % 12} right{k % 12}"
        rows += [(" ".join(rng.choice("abcdefgh") for _ in range(200)) + " " + pair, "en")]
    found = collocations(frame(spark, rows), least=LEAST, top=10).drop("cut")
    assert sorted(map(tuple, found.collect())) == plain(rows, LEAST, 10)


def test_no_rows(spark, odd_documents, no_documents):
    assert collocations(no_documents).collect() == []
    assert collocations(odd_documents, least=10_000).collect() == []
    texts = [(r["text"], r["lang"]) for r in odd_documents.collect()]
    assert sorted(map(tuple, collocations(odd_documents, least=4).drop("cut").collect())) == plain(texts, 4, 2000)


def test_slices_hold_every_word_once_with_its_neighbours(monkeypatch, rows):
    texts = [t.encode() for t, _ in rows if t]
    whole = list(slices(fold(texts), 1, 5))
    assert len(whole) == 1
    every = [(whole[0].data[s:e]) for s, e in zip(whole[0].start, whole[0].end)]
    monkeypatch.setattr(word_grams, "SLICE_BYTES", 50)
    parts = list(slices(fold(texts), 1, 5))
    assert len(parts) > 100
    assert [w.data[w.start[k] : w.end[k]] for w in parts for k in range(w.own.start, w.own.stop)] == every


def test_phrases_do_not_depend_on_slices(monkeypatch, spark, rows):
    batch = pa.RecordBatch.from_pydict({"lang": ["en"] * len(rows), "text": pa.array([t or "" for t, _ in rows], pa.string())})
    everything = bitmap(spark.range(0).selectExpr("id AS g1"), "g1") | 255

    def counted():
        total: Counter = Counter()
        sides = defaultdict(set)
        for out in _count_phrases(everything, everything, everything, 5)([batch]):
            for r in out.to_pylist():
                total[r["phrase"]] += r["n"]
                sides[r["phrase"]] |= {("left", r["left_lo"]), ("left", r["left_hi"]), ("right", r["right_lo"]), ("right", r["right_hi"])}
        ends = {p: tuple(f(v for s, v in found if s == side) for side in ("left", "right") for f in (min, max)) for p, found in sides.items()}
        return total, ends

    before = counted()
    monkeypatch.setattr(word_grams, "SLICE_BYTES", 40)
    assert counted() == before


def test_numbers_tell_words_apart():
    words = [bytes([65 + k % 26]) * (k // 26 + 1) for k in range(26 * 40)] + [b"x" * 300, b"x" * 299 + b"y", b"a\0", b"a"]
    (found,) = slices(fold(words), 0, 0)
    for which in (0, 1):
        numbers = found.numbers(salt_of("en"), which)
        assert len(set(numbers.tolist())) == len({w.lower() for w in words})
        assert not set(numbers.tolist()) & set(found.numbers(salt_of("de"), which).tolist())


def test_bitmap_holds_its_members(spark):
    import numpy as np

    rows = spark.range(5000).selectExpr("xxhash64(id) AS g1")
    bits = bitmap(rows, "g1")
    members = np.array([r["g1"] for r in rows.collect()], dtype=np.int64).view(np.uint64)
    assert among(bits, members).all()
    others = np.random.default_rng(1).integers(0, 1 << 62, 5000).astype(np.uint64)
    assert among(bits, others).mean() < 0.1
