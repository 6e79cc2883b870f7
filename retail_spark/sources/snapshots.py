"""Versions of a set of Parquet tables that become visible all at once.

Data files are only ever added, each load to folders of its own.  What a version consists of is
written in one manifest file, last: until it is there, readers see the version before, and a load
that fails half-way leaves nothing but files that no manifest names.  A manifest is created, never
replaced, so of two writers that start from one version the second fails.  A reader stays with the
manifest it has read.

A manifest lists the data files of every table with the range of each key column.  Tables are written in key
order, so a lookup of some keys needs only the files whose ranges meet theirs.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable, Mapping, Sequence
from dataclasses import dataclass, field
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from retail_spark.sources import files

MANIFESTS = "_manifest"
DATA = "data"
#: The keys of a lookup are told to the file list as at most so many ranges.
LOOKUP_RANGES = 64

Range = tuple[str, str]


class ConcurrentLoadError(RuntimeError):
    """Another writer has made a version in the meantime."""


@dataclass
class DataFile:
    path: str
    rows: int
    #: By key column; a column without any value has none.
    ranges: dict[str, Range] = field(default_factory=dict)

    def may_hold(self, column: str, wanted: Sequence[Range]) -> bool:
        if column not in self.ranges:
            return False
        low, high = self.ranges[column]
        return any(a <= high and low <= b for a, b in wanted)


@dataclass
class Snapshot:
    """One version of the tables, or, after ``append`` and ``clear``, the draft of the next."""

    spark: SparkSession
    root: str
    schemas: Mapping[str, StructType]
    version: int = 0
    files: dict[str, list[DataFile]] = field(default_factory=dict)
    #: The last batch of each stream whose rows are in.
    applied: dict[str, int] = field(default_factory=dict)

    @classmethod
    def latest(cls, spark: SparkSession, root: str, schemas: Mapping[str, StructType]) -> Snapshot:
        """The newest whole version; version 0, without any rows, if there is none."""
        for name in reversed(files.names(spark, f"{root}/{MANIFESTS}")):
            try:
                found = json.loads(files.read_text(spark, f"{root}/{MANIFESTS}/{name}"))
            except ValueError:
                continue  # still being written
            listed = {
                table: [DataFile(f["path"], f["rows"], {k: tuple(r) for k, r in f["ranges"].items()}) for f in entries]
                for table, entries in found["files"].items()
            }
            return cls(spark, root, schemas, found["version"], listed, found["applied"])
        return cls(spark, root, schemas)

    def commit(self) -> Snapshot:
        """Make the draft the newest version."""
        content = {
            "version": self.version + 1,
            "applied": self.applied,
            "files": {t: [{"path": f.path, "rows": f.rows, "ranges": f.ranges} for f in own] for t, own in self.files.items()},
        }
        path = f"{self.root}/{MANIFESTS}/{self.version + 1:012d}.json"
        try:
            files.write_new_text(self.spark, path, json.dumps(content))
        except FileExistsError as failure:
            raise ConcurrentLoadError(f"{self.root}: version {self.version + 1} exists already") from failure
        self.version += 1
        return self

    def has(self, table: str) -> bool:
        return any(f.rows for f in self.files.get(table, ()))

    def read(self, table: str, column: str | None = None, wanted: Sequence[Range] | None = None) -> DataFrame:
        """A table, or only its files that may hold keys in the ranges ``wanted`` of ``column``."""
        chosen = [f for f in self.files.get(table, ()) if wanted is None or f.may_hold(column, wanted)]
        if not chosen:
            # Known to be empty when a query is planned, so that no join with it is run.
            none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schemas[table].fields]
            return self.spark.range(1).where(F.lit(False)).select(*none)
        return self.spark.read.schema(self.schemas[table]).parquet(*[f"{self.root}/{f.path}" for f in chosen])

    def append(
        self, table: str, rows: DataFrame, keys: Sequence[str], wrap: Callable[[DataFrame], DataFrame] | None = None
    ) -> DataFrame:
        """Write rows to a new folder of the draft, in the order of the first key; the rows as written.

        ``wrap`` sees every row once, just before it is written.
        """
        folder = f"{DATA}/{table}/{uuid4().hex}"
        placed = rows.repartitionByRange(keys[0]).sortWithinPartitions(keys[0])
        (wrap(placed) if wrap else placed).write.parquet(f"{self.root}/{folder}")
        written = self.spark.read.schema(self.schemas[table]).parquet(f"{self.root}/{folder}")
        ends = [f(F.col(k)).alias(f"{name}_{k}") for k in keys for name, f in (("low", F.min), ("high", F.max))]
        listed = written.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count("*").alias("rows"), *ends)
        self.files[table] = list(self.files.get(table, ())) + [
            DataFile(
                f"{folder}/{r['file']}",
                r["rows"],
                {k: (r[f"low_{k}"], r[f"high_{k}"]) for k in keys if r[f"low_{k}"] is not None},
            )
            for r in listed.collect()  # a row per file
        ]
        return written

    def clear(self, tables: Iterable[str]) -> None:
        for table in tables:
            self.files[table] = []


def key_ranges(batch: DataFrame, column: str) -> list[Range]:
    """Where the keys of a batch lie, as at most ``LOOKUP_RANGES`` ranges."""
    keys = batch.where(F.col(column).isNotNull()).select(column).repartitionByRange(LOOKUP_RANGES, column)
    ends = keys.groupBy(F.spark_partition_id().alias("part")).agg(F.min(column).alias("low"), F.max(column).alias("high"))
    return [(r["low"], r["high"]) for r in ends.collect()]


def expire(spark: SparkSession, root: str, keep: int = 1) -> int:
    """Delete all but the newest ``keep`` manifests, and load folders that none of those names; how many folders went.

    Not to be run beside a load, whose folders are not named yet, nor while older versions are read.
    """
    manifests = files.names(spark, f"{root}/{MANIFESTS}")
    kept: set[str] = set()
    for name in manifests[-keep:]:
        found = json.loads(files.read_text(spark, f"{root}/{MANIFESTS}/{name}"))
        kept |= {f["path"].rsplit("/", 1)[0] for entries in found["files"].values() for f in entries}
    for name in manifests[:-keep]:
        files.delete(spark, f"{root}/{MANIFESTS}/{name}")
    gone = 0
    for table in files.names(spark, f"{root}/{DATA}"):
        for folder in files.names(spark, f"{root}/{DATA}/{table}"):
            if f"{DATA}/{table}/{folder}" not in kept:
                files.delete(spark, f"{root}/{DATA}/{table}/{folder}")
                gone += 1
    return gone
