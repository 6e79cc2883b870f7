"""Clustering against all distances in Python's integers, and against SQL."""

import hashlib
import math
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from retail_spark.llm.centroids import Centroids, cluster_vectors, oracle

SCHEMA = "vec_id long, embedding array<double>, label int, cluster string"


def plain(rows, length, clusters, rounds, seed=3):
    """Rows of (id, cluster, distance) and centroids, by all distances."""
    kept = [(i, v) for i, v, *_ in rows if v is not None and len(v) == length and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v in kept]
    first = lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1])
    centroids = [v for _, v in sorted(kept, key=first)[:clusters]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            members = [v for (_, v), at in zip(kept, own) if at == k]
            if members:
                centroids[k] = [sum(column) // len(members) for column in zip(*members)]
    return [(i, *nearest(v)[::-1]) for i, v in kept], centroids


def order(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, *r[1:]))


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice([0.01, 1, 3])], 1, "x") for i in range(300)]
    rows += [(1, rows[1][1], 1, "x")] * 40  # repeated rows
    rows += [(900 + i, [0.25, 0.25, 0.0, 0.0, -0.25, 0.0], 1, "x") for i in range(30)]  # one vector, many ids
    rows += [
        (None, [0.5] * 6, 1, "x"), (5, None, 1, "x"), (6, [1.0], 1, "x"), (7, [None] + [1.0] * 5, 1, "x"),
        (8, [math.nan] + [1.0] * 5, 1, "x"), (9, [math.inf] + [1.0] * 5, 1, "x"), (10, [], 1, "x"), (11, [0.0] * 6, None, None),
    ]
    return rows


@pytest.mark.parametrize("large", [False, True])
def test_all_distances(spark, rows, large):
    if large:
        rows = [*rows, (2000, [1e30, -1e30, 1.0, 0.0, 0.0, 0.0], 1, "x"), (2001, [3e6] * 6, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    found = cluster_vectors(df, length=6, clusters=5, rounds=4)
    expected, centroids = plain(rows, 6, 5, 4)
    fits = lambda x: x if x < 1 << 63 else None
    got = found.collect()
    assert order([(r["vec_id"], r["cluster"], r["distance"]) for r in got]) == order([(i, k, fits(d)) for i, k, d in expected])
    total = {k: sum(d for _, at, d in expected if at == k) for k in range(5)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    for r in got:
        assert r["cluster_inertia"] == fits(total[r["cluster"]]) and r["inertia"] == fits(sum(total.values()))
        assert r["centroid_sha256"] == digest[r["cluster"]] and r["centroid"] == [str(x) for x in centroids[r["cluster"]]]


def test_fewer_vectors_than_clusters_and_none(spark):
    rows = [(1, [1.0, 2.0], 1, "x"), (2, [1.0, 2.0], 1, "x"), (3, [5.0, 2.0], 1, "x")]
    got = cluster_vectors(spark.createDataFrame(rows, SCHEMA), length=2).collect()
    assert order([(r["vec_id"], r["cluster"], r["distance"]) for r in got]) == order(plain(rows, 2, 8, 10)[0])
    assert cluster_vectors(spark.createDataFrame([], SCHEMA), length=2).collect() == []
    assert cluster_vectors(spark.createDataFrame(rows, SCHEMA), length=3).collect() == []


def test_the_search_finds_ties_and_every_nearest():
    rng = np.random.default_rng(2)
    for spread in (1, 3, 1000, 1 << 22):
        centroids = rng.integers(-spread, spread + 1, (40, 8))
        centroids[7] = centroids[3]
        rows = np.concatenate([rng.integers(-spread, spread + 1, (500, 8)), centroids])
        found, distance = Centroids(centroids.tolist()).nearest(rows)
        every = ((rows[:, None] - centroids[None]) ** 2).sum(2)
        assert (found == every.argmin(1)).all() and (distance == every.min(1)).all()


def test_sql(spark, rows):
    duck = duckdb.connect()
    kept = [r for r in rows if r[0] is not None]
    duck.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INT, cluster VARCHAR)")
    duck.executemany("INSERT INTO embeddings VALUES (?, ?, ?, ?)", kept)
    expected = duck.execute(oracle(length=6, clusters=5, rounds=4)).fetchall()
    found = cluster_vectors(spark.createDataFrame(kept, SCHEMA), length=6, clusters=5, rounds=4).drop("centroid")
    assert sorted(map(tuple, found.collect())) == sorted(expected)
