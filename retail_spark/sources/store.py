"""The stored star schema: four Parquet tables with declared constraints.

Parquet has no keys, so loading applies them: rows that break NOT NULL, CHECK,
the primary key or a unique column are skipped, and a dangling foreign key stops
the load, or, where a stream loads, lets the row wait for its dimension row.  A load
is one version of all tables (``snapshots``): it is seen whole or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from retail_spark.functions.cleaning import clamp_min, flag_to_int
from retail_spark.operators.dedup import first_per_each_key
from retail_spark.operators.referential import orphan_keys
from retail_spark.operators.rules import acceptable
from retail_spark.schemas import FOREIGN_KEYS, PRIMARY_KEYS, STORE_SCHEMAS, TABLES, UNIQUE_COLUMNS
from retail_spark.sources.readers import SOURCE_ORDER
from retail_spark.sources.scratch import stage
from retail_spark.sources.snapshots import Snapshot, key_ranges

FACTS = tuple(dict.fromkeys(fact for fact, _ in FOREIGN_KEYS))
#: A row that waits has a digest of its content, and the version before which it came.
ROW_ID, ARRIVED = "_row_id", "_arrived"


def waiting_table(fact: str) -> str:
    return f"waiting_{fact}"


def released_table(fact: str) -> str:
    return f"released_{fact}"


_ID = StructField(ROW_ID, StringType())
ALL_SCHEMAS: dict[str, StructType] = {
    **STORE_SCHEMAS,
    **{waiting_table(f): StructType([*STORE_SCHEMAS[f].fields, _ID, StructField(ARRIVED, LongType())]) for f in FACTS},
    **{released_table(f): StructType([_ID]) for f in FACTS},
}


class DanglingKeyError(ValueError):
    """A fact row points at a dimension row that is not stored."""


def open_store(spark: SparkSession, root: str) -> Snapshot:
    """The newest version of a store; one that was never loaded has empty tables."""
    return Snapshot.latest(spark, root, ALL_SCHEMAS)


def create_schema(spark: SparkSession, root: str) -> None:
    """Make a first version with empty tables, if there is none yet."""
    store = open_store(spark, root)
    if not store.version:
        store.commit()


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    return open_store(spark, root).read(table)


def read_store(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """All tables of one version."""
    store = open_store(spark, root)
    return {table: store.read(table) for table in TABLES}


def _keys(table: str) -> list[str]:
    return [PRIMARY_KEYS[table], *UNIQUE_COLUMNS.get(table, ())]


def _foreign_keys(fact: str) -> dict[str, str]:
    """Column to dimension."""
    return {fk: dim for (table, fk), dim in FOREIGN_KEYS.items() if table == fact}


def to_stored(df: DataFrame, table: str) -> DataFrame:
    """Clean columns to stored columns: flags to 0/1, stock not below zero.

    A missing ``is_active`` counts as inactive, a missing ``verified_purchase``
    stays unknown.
    """
    kinds = dict(df.dtypes)
    columns = []
    for field in STORE_SCHEMAS[table].fields:
        c = F.col(field.name)
        if kinds[field.name] == "boolean":
            c = flag_to_int(c, null_as_zero=field.name != "verified_purchase")
        if field.name == "stock_quantity":
            c = clamp_min(c)
        columns.append(c.cast(field.dataType).alias(field.name))
    if SOURCE_ORDER in df.columns:
        columns.append(F.col(SOURCE_ORDER))
    return df.select(*columns)


def insertable(df: DataFrame, table: str, store: Snapshot, staged: bool = False) -> DataFrame:
    """The rows of a batch that an insert with skipping would add, in source order.

    The batch is written out first, unless it is ``staged`` already: cleaning then runs once, and the planner
    knows the size of the batch.  Of the stored table only the files whose key ranges meet the batch's are
    read, and their keys are looked up from the batch's side, so a small batch is broadcast to
    them and the table itself is never shuffled.
    """
    stored = to_stored(df, table)
    ordered = SOURCE_ORDER in stored.columns
    if not ordered and len(_keys(table)) > 1:
        # Copies share their primary key: with no other key, the one first row of each is found below.
        stored = stored.distinct()
    batch = stored.where(acceptable(table))
    if not staged:
        batch = stage(batch, f"load-{table}")
    if not ordered:
        # Without a source order the smallest content comes first.
        batch = batch.withColumn(SOURCE_ORDER, F.struct(*batch.columns))
    fresh = batch
    for key in _keys(table):
        if store.has(table):
            existing = store.read(table, key, key_ranges(batch, key))
            known = existing.select(key).join(batch.select(key), key, "left_semi")
            fresh = fresh.join(known, key, "left_anti")
    return first_per_each_key(fresh, _keys(table), SOURCE_ORDER, stage).select(*STORE_SCHEMAS[table].fieldNames())


def check_references(df: DataFrame, table: str, dimensions: Mapping[str, DataFrame]) -> None:
    """Raise if a row to be inserted points nowhere; all foreign keys in one job."""
    counts = []
    for fk, dim in _foreign_keys(table).items():
        unknown = orphan_keys(df, dimensions[dim], fk, PRIMARY_KEYS[dim])
        counts.append(
            unknown.agg(
                F.lit(fk).alias("fk"),
                F.lit(dim).alias("dim"),
                F.sum("n").alias("n"),
                F.min(F.col(fk).cast("string")).alias("example"),
            )
        )
    for found in reduce(DataFrame.unionByName, counts).where("n > 0").collect():
        raise DanglingKeyError(
            f"{table}.{found['fk']}: {found['n']} rows without a {found['dim']} row, e.g. {found['example']}"
        )


def insert(
    store: Snapshot, table: str, df: DataFrame, write: Callable[[DataFrame], DataFrame] | None = None, matched: bool = False
) -> DataFrame:
    """Add what is new and acceptable to a draft; what was added.  Fact rows must have their dimension rows.

    ``matched`` rows are staged, and were joined with the dimensions of this draft before.
    """
    new_rows = insertable(df, table, store, staged=matched)
    if table in FACTS and not matched:
        check_references(new_rows, table, {dim: store.read(dim) for dim in _foreign_keys(table).values()})
    return store.append(table, new_rows, _keys(table), write)


def load_insert_ignore(
    spark: SparkSession, root: str, table: str, df: DataFrame, write: Callable[[DataFrame], DataFrame] | None = None
) -> None:
    """One batch of one table as a version of its own; fact rows that waited for it come in with it."""
    store = open_store(spark, root)
    added = insert(store, table, df, write)
    if table not in FACTS:
        release(store, table, added)
    store.commit()


def load_star_schema(
    spark: SparkSession,
    root: str,
    bundle: Mapping[str, DataFrame],
    force_reload: bool = False,
    write: Callable[[str, DataFrame], DataFrame] | None = None,
) -> dict[str, DataFrame]:
    """Load dimensions before facts, as one version: a load that fails leaves the version before as it was.

    ``force_reload`` replaces the tables; otherwise known keys are skipped.  ``write`` may wrap each
    frame on its way out, for instance to observe it.
    """
    store = open_store(spark, root)
    if force_reload:
        store.clear(TABLES)
    added = {}
    for table in TABLES:
        wrap = (lambda df, t=table: write(t, df)) if write else None
        added[table] = insert(store, table, bundle[table], wrap)
    for table in TABLES:
        if table not in FACTS:
            release(store, table, added[table])
    store.commit()
    return {table: store.read(table) for table in TABLES}


def waiting_rows(store: Snapshot, fact: str) -> DataFrame:
    """Fact rows whose dimension rows have not come yet."""
    return _unreleased(store, fact, store.read(waiting_table(fact)))


def _unreleased(store: Snapshot, fact: str, rows: DataFrame) -> DataFrame:
    return rows.join(store.read(released_table(fact)), ROW_ID, "left_anti") if store.has(released_table(fact)) else rows


def hold_back(store: Snapshot, fact: str, rows: DataFrame) -> None:
    """Let stored-form rows wait in a draft; a row that waits already, or has waited, is not added again.

    Rows wait in the order of their primary key, so only the files whose keys meet those of ``rows`` are looked at.
    """
    columns, key = STORE_SCHEMAS[fact].fieldNames(), PRIMARY_KEYS[fact]
    # Names are part of the text, so a NULL is not taken for the value of another column.
    row_id = F.sha2(F.to_json(F.struct(*columns)), 256)
    new = first_per_each_key(rows.select(*columns, row_id.alias(ROW_ID)), [ROW_ID], ROW_ID, stage)
    if store.has(waiting_table(fact)):
        # No range tells of rows without a key.
        ranged = all(key in f.ranges for f in store.files[waiting_table(fact)] if f.rows)
        ranged = ranged and rows.where(F.col(key).isNull()).isEmpty()
        waits = store.read(waiting_table(fact), key, key_ranges(rows, key) if ranged else None)
        new = new.join(waits.select(ROW_ID), ROW_ID, "left_anti")
    new = new.select(*columns, ROW_ID, F.lit(store.version).cast("long").alias(ARRIVED))
    store.append(waiting_table(fact), new, [key, ROW_ID])


def release(store: Snapshot, dim: str, added: DataFrame) -> None:
    """Load the waiting rows that ``added`` rows of a dimension complete, in the order in which they came.

    Only rows that wait for one of the added keys are looked at; one that lacks another key
    besides stays.  A released row is marked, not removed, so nothing is rewritten.
    """
    for fact in FACTS:
        own = _foreign_keys(fact)
        if dim not in own.values() or not store.has(waiting_table(fact)):
            continue
        complete = store.read(waiting_table(fact))
        # The dimension that has grown may only newly know keys that were just added: it goes first, and leaves few rows.
        for fk, target in sorted(own.items(), key=lambda x: x[1] != dim):
            members = added if target == dim else store.read(target)
            complete = complete.join(members.select(F.col(PRIMARY_KEYS[target]).alias(fk)), fk, "left_semi")
        complete = _unreleased(store, fact, complete)
        order = F.struct(ARRIVED, ROW_ID).alias(SOURCE_ORDER)
        complete = stage(complete.select(*STORE_SCHEMAS[fact].fieldNames(), ROW_ID, order), f"released-{fact}")
        if complete.isEmpty():
            continue
        store.append(fact, insertable(complete.drop(ROW_ID), fact, store, staged=True), _keys(fact))
        store.append(released_table(fact), complete.select(ROW_ID), [ROW_ID])
