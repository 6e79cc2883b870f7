"""The mix against a plain version of its blocks, passes and budgets in Python."""

import math
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from retail_spark.llm import mixing
from retail_spark.llm.mixing import mix_sources


@pytest.fixture
def documents(spark):
    rows = []
    for k in range(1500):
        source = ("hot", "warm", "cold", None, "void")[0 if k % 3 else (k // 3) % 5]
        text = None if source == "void" else " ".join(["w"] * (k * 7919 % 23))
        rows.append((k, text, source, k))
    return spark.createDataFrame(rows + rows[:40], "doc_id long, text string, source string, mix_tokens long")


def plain(documents, exponent, budget, block_rows, seed=17):
    """Rows as often as the mix has them, and each row's source's target."""
    key = F.xxhash64(F.col("doc_id").cast("string"), F.col("text"), F.lit(seed))
    rows = [(r.doc_id, r.source, len((r.text or "").split()), r.k) for r in documents.withColumn("k", key).collect()]
    spark = documents.sparkSession
    tokens, count = Counter(), Counter()
    for _, source, n, _ in rows:
        tokens[source] += n
        count[source] += 1
    total = sum(tokens.values())
    power = {s: (n / total) ** exponent for s, n in tokens.items() if n}
    target = {s: math.floor(round(p / sum(power.values()) * budget, 3)) for s, p in power.items()}
    blocks = defaultdict(list)
    for doc, source, n, k in rows:
        blocks[source, k % math.ceil(count[source] / block_rows)].append((doc, n, k))
    wanted = Counter()
    for source in count:
        passes, part = divmod(target[source], tokens[source]) if tokens[source] else (1, 0)
        own = [b for s, b in blocks if s == source]
        for doc, s, _, _ in rows:
            if s == source:
                wanted[doc] += passes
        if part:
            name = "" if source is None else f"={source}"
            turns = spark.createDataFrame([(name, b) for b in own], "s string, b long")
            turns = turns.select("b", F.xxhash64("s", "b", F.lit(passes).cast("long"), F.lit(seed)).alias("t")).collect()
            room = part
            for _, block in sorted((r.t, r.b) for r in turns):
                inside = blocks[source, block]
                if sum(n for _, n, _ in inside) > room:
                    frame = spark.createDataFrame([(k, d, n) for d, n, k in inside], "k long, d long, n long")
                    order = frame.select("d", "n", F.xxhash64("k", F.lit(passes).cast("long")).alias("o")).collect()
                    for at in sorted({r.o for r in order}):
                        alike = [r for r in order if r.o == at]
                        room -= sum(r.n for r in alike)
                        if room < 0:
                            break
                        wanted.update(r.d for r in alike)
                    break
                room -= sum(n for _, n, _ in inside)
                wanted.update(d for d, _, _ in inside)
                if room <= 0:
                    break
    return wanted, target, tokens


@pytest.mark.parametrize("band_blocks", [1024, 4])
@pytest.mark.parametrize("budget", [None, 40_000])
def test_mix_matches_a_plain_version(documents, monkeypatch, band_blocks, budget):
    monkeypatch.setattr(mixing, "BLOCK_ROWS", 16)
    monkeypatch.setattr(mixing, "BAND_BLOCKS", band_blocks)
    exponents = []
    find = mixing.find_exponent
    monkeypatch.setattr(mixing, "find_exponent", lambda *a: exponents.append(find(*a)) or exponents[0])
    got = mix_sources(documents, budget).collect()
    total = sum(len((r.text or "").split()) for r in documents.collect())
    wanted, target, tokens = plain(documents, exponents[0], budget or total, 16)
    assert Counter(r.doc_id for r in got) == +wanted
    used = Counter()
    for r in got:
        used[r.source] += r.mix_tokens
        assert r.mix_tokens == len((r.text or "").split()) and 0 <= r.mix_position <= 1
    for source, n in target.items():
        assert n - 23 * 2 < used[source] <= n
        # Every stretch has the source's share: positions of its tokens are even.
        half = sum(r.mix_tokens for r in got if r.source == source and r.mix_position < 0.5)
        assert abs(half - used[source] / 2) <= 0.25 * max(used[source], 16 * 23)
    assert sum(tokens.values()) == total
