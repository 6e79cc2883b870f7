"""Centroid clustering of integer vectors with an equal-average equal-variance search.

Components become integers (``floor(SCALE * x)``), so that every sum, mean and distance is
exact whatever order the tasks add in.  A round is one pass over the written integer
vectors: each task finds the nearest centroid of its rows and emits sums per centroid, which
are added in Spark; only ``clusters * length`` sums reach the driver, however many rows there are.

The search never tries all centroids.  With S the sum of a vector's components and R the root of
``length * sum of squares - S * S`` (mean and deviation, both times ``length``),

    length * distance(x, c) >= (S(x) - S(c))**2 + (R(x) - R(c))**2.

Centroids lie sorted by S.  A vector starts at its own S and scans outward, nearest mean first:
once the mean alone puts a centroid past the best distance, all that remain on either side lie further and
the scan ends; a centroid whose mean and deviation together put it past the best is
skipped; what is left gets its distance in whole numbers.  A bound must lie above the best by more
than rounding can explain, so ties are always compared and go to the smaller number.
"""

from __future__ import annotations

import hashlib
import math
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retail_spark.sources.scratch import stage

LENGTH = 64
SCALE = 1024
CLUSTERS = 8
ROUNDS = 10
SEED = 3
#: Times the length, the largest component whose squares and sums below all fit 64 bits; larger ones are reckoned in Python's integers.
SMALL = 1 << 30
#: Sums travel in pieces of so many bits, so that no sum of pieces can pass 64 bits.
PIECE_BITS = 32
#: More than floating point can lose in the bounds, as a part of them; one more is added for the smallest.
SLACK = 1e-9


class Centroids:
    """Centroids sorted by component mean, and the search for the nearest of them."""

    def __init__(self, vectors: list[list[int]]):
        self.vectors = vectors
        self.small = all(abs(x) * len(v) <= SMALL for v in vectors for x in v)
        exact = np.array(vectors, dtype=np.int64 if self.small else object).reshape(len(vectors), -1)
        total = exact.sum(axis=1)
        # Equal means stay in the order of their numbers.
        self.number = np.array(sorted(range(len(vectors)), key=lambda k: (total[k], k)), dtype=np.int64)
        self.exact = exact[self.number]
        if self.small:
            self.total = total[self.number]
            self.spread = _deviation(self.exact, self.total)

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of, and squared distance to, the nearest centroid of every row."""
        if not self.small or rows.dtype == object:
            return self._plainly(rows.astype(object))
        n, length = rows.shape
        k = len(self.number)
        total = rows.sum(axis=1)
        spread = _deviation(rows, total)
        best = np.full(n, np.iinfo(np.int64).max)
        found = np.full(n, k, dtype=np.int64)
        # The next centroids to try, on either side of a row's own mean.
        right = np.searchsorted(self.total, total)
        left = right - 1
        scanning = np.arange(n)
        while len(scanning):
            lo, hi, mean = left[scanning], right[scanning], total[scanning]
            below = np.where(lo >= 0, mean - self.total[np.maximum(lo, 0)], np.iinfo(np.int64).max)
            above = np.where(hi < k, self.total[np.minimum(hi, k - 1)] - mean, np.iinfo(np.int64).max)
            down = below <= above
            at = np.where(down, lo, hi)
            left[scanning[down]] -= 1
            right[scanning[~down]] += 1
            apart = np.where(down, below, above).astype(np.float64) ** 2
            limit = best[scanning].astype(np.float64) * length * (1 + SLACK) + 1
            # Past the best by the mean alone: so is every centroid that remains.
            inside = apart <= limit
            scanning, at, apart, limit = scanning[inside], at[inside], apart[inside], limit[inside]
            turn = (apart + (spread[scanning] - self.spread[at]) ** 2 * (1 - SLACK)) <= limit
            row, tried = scanning[turn], at[turn]
            gap = rows[row] - self.exact[tried]
            distance = np.einsum("ij,ij->i", gap, gap)
            number = self.number[tried]
            better = (distance < best[row]) | ((distance == best[row]) & (number < found[row]))
            best[row[better]] = distance[better]
            found[row[better]] = number[better]
            scanning = scanning[(left[scanning] >= 0) | (right[scanning] < k)]
        return found, best

    def _plainly(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with Python's integers, for components whose squares could pass 64 bits."""
        found, best = np.zeros(len(rows), dtype=np.int64), np.empty(len(rows), dtype=object)
        centroids = [(int(number), self.exact[at].astype(object)) for at, number in enumerate(self.number)]
        for i, row in enumerate(rows):
            best[i], found[i] = min((int(((row - c) ** 2).sum()), number) for number, c in centroids)
        return found, best


def _deviation(exact: np.ndarray, total: np.ndarray) -> np.ndarray:
    length = exact.shape[1]
    return np.sqrt((length * np.einsum("ij,ij->i", exact, exact) - total * total).astype(np.float64))


def integer_vectors(vectors: DataFrame, column: str = "embedding", length: int = LENGTH, scale: int = SCALE) -> DataFrame:
    """``vec_id``, ``small`` and ``large`` of the rows that take part, written out.

    A row takes part whose vector has ``length`` components, none NULL or not finite.  ``small`` holds the
    integers of a row where all are small; ``large`` the components themselves of any other row.
    """
    value = F.col(column).cast("array<double>")
    good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), value.alias("vector"))
    rows = rows.where((F.size("vector") == length) & good)
    little = F.forall("vector", lambda x: F.abs(x) < SMALL // length // scale)
    exact = F.when(little, F.transform("vector", lambda x: F.floor(x * scale).cast("int")))
    return stage(rows.select("vec_id", exact.alias("small"), F.when(~little, F.col("vector")).alias("large")), "vectors")


def _whole(large: list[float], scale: int) -> list[int]:
    return [math.floor(Fraction(x) * scale) for x in large]


def _blocks(batches: Iterator[pa.RecordBatch], length: int, scale: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Ids and integers of the rows, block by block; blocks of large components hold Python's integers."""
    for batch in batches:
        ids, small, large = batch.column("vec_id"), batch.column("small"), batch.column("large")
        if part := small.drop_null():
            rows = part.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            yield ids.filter(small.is_valid()), rows.reshape(-1, length)
        if part := large.drop_null():
            yield ids.filter(large.is_valid()), np.array([_whole(x, scale) for x in part.to_pylist()], dtype=object)


def _pieces(value: int) -> list[tuple[int, int]]:
    """A number as (index, signed piece), least first."""
    size, sign, out = abs(value), -1 if value < 0 else 1, []
    while size or not out:
        out.append((len(out), sign * (size & ((1 << PIECE_BITS) - 1))))
        size >>= PIECE_BITS
    return out


def _sums(model: Centroids, length: int, scale: int):
    """One set of sums per task: (cluster, place, piece, part of the sum, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(model.vectors), length), dtype=object)
        counts = [0] * len(model.vectors)
        for _, rows in _blocks(batches, length, scale):
            found, _ = model.nearest(rows)
            for cluster in np.unique(found):
                own = rows[found == cluster]
                # The sum over a block fits 64 bits; Python's integers add the blocks.
                sums[cluster] += np.array([int(x) for x in own.sum(axis=0)], dtype=object)
                counts[cluster] += len(own)
        out = [
            (k, j, piece, part, counts[k])
            for k in range(len(counts))
            if counts[k]
            for j in range(length)
            for piece, part in _pieces(sums[k][j])
        ]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
        columns = [pa.array([row[at] for row in out], kind) for at, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "place", "piece", "part", "n"])

    return run


def _assigned(model: Centroids, length: int, scale: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, rows in _blocks(batches, length, scale):
            found, distance = model.nearest(rows)
            fitting = [int(d) if d < 1 << 63 else None for d in distance] if distance.dtype == object else distance
            columns = [ids, pa.array(found, pa.int32()), pa.array(fitting, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "cluster", "distance"])

    return run


def _start(rows: DataFrame, scale: int, clusters: int, seed: int) -> list[list[int]]:
    """The first vectors by a hash of their ids; rows without an id come last, ties go by components."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    order = [F.col("hashed").asc_nulls_last(), F.col("small").asc_nulls_last(), F.col("large")]
    first = rows.withColumn("hashed", hashed).orderBy(*order).limit(clusters).collect()
    return [r["small"] if r["small"] is not None else _whole(r["large"], scale) for r in first]


def fit_centroids(
    rows: DataFrame,
    length: int = LENGTH,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> Centroids | None:
    """Centroids after ``rounds`` rounds over ``integer_vectors``; None where no row takes part."""
    vectors = _start(rows, scale, clusters, seed)
    if not vectors:
        return None
    for _ in range(rounds):
        schema = "cluster int, place int, piece int, part long, n long"
        parts = rows.mapInArrow(_sums(Centroids(vectors), length, scale), schema)
        total = F.sum(F.col("part").cast("decimal(38,0)")).alias("total")
        # Every task names piece 0 of all its sums, so that piece counts all rows.
        added = parts.groupBy("cluster", "place", "piece").agg(total, F.sum("n").alias("n")).collect()
        sums: dict[tuple[int, int], int] = defaultdict(int)
        for found in added:  # clusters * length * pieces
            sums[found["cluster"], found["place"]] += int(found["total"]) << (PIECE_BITS * found["piece"])
        moved = [list(v) for v in vectors]
        for found in added:
            if found["piece"] == 0:
                k, j = found["cluster"], found["place"]
                moved[k][j] = sums[k, j] // found["n"]
        if moved == vectors:
            break  # no later round can move them
        vectors = moved
    return Centroids(vectors)


def _per_cluster(values: list, kind: str) -> Column:
    """The value of a row's cluster, as literals: there are as many as clusters."""
    cases = (F.when(F.col("cluster") == k, F.lit(value)) for k, value in enumerate(values))
    return F.coalesce(*cases, F.lit(None)).cast(kind)


def cluster_vectors(
    vectors: DataFrame,
    column: str = "embedding",
    length: int = LENGTH,
    scale: int = SCALE,
    clusters: int = CLUSTERS,
    rounds: int = ROUNDS,
    seed: int = SEED,
) -> DataFrame:
    """Every vector's cluster: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256, centroid``.

    Vectors that are NULL, of another length or hold NULL or non-finite components take no part and have no row.
    Repeated rows and repeated ids each count and each have a row.  Centroids start as the vectors with the
    smallest SHA-256 of ``seed:vec_id`` (rows without an id last; of one id, smaller components first); with fewer
    vectors than ``clusters`` there are fewer centroids.  Equal centroids: the smaller number takes all, the
    other stays empty and where it is.  A distance or sum that no 64-bit number holds is NULL.
    ``centroid`` has the components in decimal digits.  Other columns, whatever their names, are left out;
    an empty table gives no rows.
    """
    rows = integer_vectors(vectors, column, length, scale)
    model = fit_centroids(rows, length, scale, clusters, rounds, seed) or Centroids([[0] * length])  # for no rows
    near = stage(rows.mapInArrow(_assigned(model, length, scale), "vec_id long, cluster int, distance long"), "nearest")
    # A distance past 64 bits puts its sums past them too.
    total = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    sums = near.groupBy("cluster").agg(total, F.count("distance").alias("fit"), F.count("*").alias("n")).collect()
    inertia = {r["cluster"]: int(r["total"]) if r["fit"] == r["n"] else 1 << 63 for r in sums}
    fits = lambda x: x if x < 1 << 63 else None
    return near.select(
        "*",
        _per_cluster([fits(inertia.get(k, 0)) for k in range(len(model.vectors))], "long").alias("cluster_inertia"),
        F.lit(fits(sum(inertia.values()))).cast("long").alias("inertia"),
        _per_cluster([_digest(v) for v in model.vectors], "string").alias("centroid_sha256"),
        _per_cluster([[str(x) for x in v] for v in model.vectors], "array<string>").alias("centroid"),
    )


def _digest(vector: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, vector)).encode()).hexdigest()


def oracle(length: int = LENGTH, scale: int = SCALE, clusters: int = CLUSTERS, rounds: int = ROUNDS, seed: int = SEED) -> str:
    """The same in SQL, all distances to all centroids, one pair of tables per round."""
    gap = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: CAST(p[1] - p[2] AS HUGEINT) * (p[1] - p[2])))"
    steps = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS row, vec_id,
        list_transform(embedding, lambda e: CAST(floor({scale} * CAST(e AS DOUBLE)) AS BIGINT)) AS x
        FROM embeddings WHERE len(embedding) = {length} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {length})""",
        f"""c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || vec_id), x) - 1 AS cluster, x
        FROM v ORDER BY 1 LIMIT {clusters})""",
    ]
    for k in range(rounds + 1):
        near = f"""a{k} AS MATERIALIZED (SELECT row, any_value(vec_id) AS vec_id, any_value(x) AS x, arg_min(cluster, d) AS cluster, min(d).d AS distance
        FROM (SELECT v.row, v.vec_id, v.x, c.cluster, {{'d': {gap}, 'k': c.cluster}} AS d FROM v, c{k} AS c) t GROUP BY row)"""
        steps.append(near)
        if k < rounds:
            steps.append(
                f"""c{k + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN (
                SELECT cluster, list(mean ORDER BY place) AS x FROM (SELECT cluster, place, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS mean
                FROM (SELECT cluster, place, sum(CAST(x[place] AS HUGEINT)) AS s, count(*) AS n
                FROM a{k}, (SELECT unnest(range(1, {length + 1})) AS place) p GROUP BY ALL) t) t GROUP BY cluster) m USING (cluster))"""
            )
    digest = "sha256(array_to_string(list_transform(c.x, lambda e: CAST(e AS VARCHAR)), ','))"
    return f"""WITH {", ".join(steps)}
    SELECT vec_id, CAST(cluster AS INTEGER) AS cluster, CAST(distance AS BIGINT) AS distance,
    CAST(sum(distance) OVER (PARTITION BY cluster) AS BIGINT) AS cluster_inertia, CAST(sum(distance) OVER () AS BIGINT) AS inertia,
    {digest} AS centroid_sha256 FROM a{rounds} JOIN c{rounds} AS c USING (cluster)"""


ORACLE_SQL = oracle()
