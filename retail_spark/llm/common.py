"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but blank, tab, line feed, vertical tab, form feed and return.
WORD = r"[^\x20\x09-\x0D]+"

#: Documents and pages may be long: small batches keep a Python worker's memory low.
ROWS_PER_BATCH = "1000"

PACKAGE_HOME = str(Path(__file__).resolve().parents[2])


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of a folder of Parquet tables."""
    # A local session may have been started elsewhere: its workers must find this package.
    spark.sparkContext.environment.setdefault("PYTHONPATH", PACKAGE_HOME)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; none for NULL."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def n_words(text: Column) -> Column:
    """The number of words of a text; 0 for NULL."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that any bits of the result may serve as a hash."""
    x = np.asarray(x, dtype=np.uint64).copy()
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def drawn(share: float, *columns: str) -> Column:
    """Whether a row belongs to a sample of a share of all rows, by a hash of some columns; of 62 bits, so that no share is too small."""
    return F.pmod(F.xxhash64(*columns), F.lit(1 << 62)) < F.lit(int(share * (1 << 62)))


#: Stands for a missing id inside pandas code, which could not tell it from a fraction.
NO_ID = -(1 << 63)


def safe_id(column: str) -> Column:
    """A long id without NULLs."""
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID)).alias(column)


def true_id(column: str) -> Column:
    """What ``safe_id`` was made from."""
    return F.when(F.col(column) != NO_ID, F.col(column)).alias(column)


def map_texts(
    rows: DataFrame, keep: Sequence[str], compute: Callable[[Iterator[list[str | None]]], Iterator[list[pa.Array]]], columns: Sequence[str]
) -> DataFrame:
    """The columns ``keep`` of ``rows`` as they are, and ``columns`` (names with types) that ``compute`` makes of each batch of ``text``.

    Kept columns pass by as Arrow arrays: NULLs, long numbers and texts stay what they are, and rows need
    no key to be joined back by.
    """
    names = [*keep, *(c.split()[0] for c in columns)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def texts() -> Iterator[list[str | None]]:
            for batch in batches:
                held.append(batch)
                yield batch.column("text").to_pylist()

        for values in compute(texts()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *values], names=names)

    kinds = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep] + list(columns))
    return rows.select(*dict.fromkeys((*keep, "text"))).mapInArrow(run, schema)
