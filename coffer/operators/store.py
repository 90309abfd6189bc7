"""Tables of parquet segments under versioned manifests.

A version is a manifest: the list of the segments that make up the table. A
change writes new segments and then one manifest with the next number; creating
that file is the commit, and it fails if another writer was first: the file
system must refuse to create a file that is there (HDFS, local disks and object
stores with conditional writes do; on others only one writer at a time is safe).
What is computed from a version and then written passes that version as
``base``, so a change in between is a Conflict and never lost. An append
writes only new rows. An update or delete rewrites only the segments that hold
a changed key. Readers keep the version they began with. All files go through
Spark's file systems, so a store can be anywhere Spark can write.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer import schemas
from coffer.operators.ranking import numbered


class Conflict(RuntimeError):
    """Another writer committed first; read again and repeat."""


class Store:
    """The tables of ``schemas.TABLES`` under one root."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(self, table: str) -> int:
        """The latest committed version, 0 before the first."""
        folder = self._path(f"{self.root}/{table}/manifests")
        if not self._fs.exists(folder):
            return 0
        return max((int(f.getPath().getName().split(".")[0]) for f in self._fs.listStatus(folder)), default=0)

    def segments(self, table: str, version: int | None = None) -> list[str]:
        """Names of the segments of a version."""
        at = self.version(table) if version is None else version
        if not at:
            return []
        stream = self._fs.open(self._path(f"{self.root}/{table}/manifests/{at:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _folders(self, table: str, segments: Sequence[str]) -> list[str]:
        return [f"{self.root}/{table}/segments/{s}" for s in segments]

    def _commit(self, table: str, base: int, segments: Sequence[str]) -> int:
        path = self._path(f"{self.root}/{table}/manifests/{base + 1:012d}.json")
        try:
            stream = self._fs.create(path, False)
        except Exception as e:
            raise Conflict(f"{table}: version {base + 1} is taken") from e
        try:
            stream.write(bytearray(json.dumps(list(segments)).encode()))
        finally:
            stream.close()
        return base + 1

    def _write(self, table: str, rows: DataFrame) -> str:
        schema = schemas.TABLES[table]
        name = uuid.uuid4().hex
        ordered = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) if f.name in rows.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])
        ordered.write.parquet(f"{self.root}/{table}/segments/{name}")
        return name

    def read(self, table: str, version: int | None = None) -> DataFrame:
        """A table as of a version; empty before the first."""
        schema, names = schemas.TABLES[table], self.segments(table, version)
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*self._folders(table, names))

    def append(self, table: str, rows: DataFrame, base: int | None = None) -> int:
        """Add rows as one new segment."""
        base = self.version(table) if base is None else base
        held = self.segments(table, base)
        return self._commit(table, base, [*held, self._write(table, rows)])

    def next_id(self, table: str, version: int | None = None) -> int:
        """One above the largest id: read from the columns' statistics, not the rows."""
        return (self.read(table, version).agg(F.max("id")).first()[0] or 0) + 1

    def insert(self, table: str, rows: DataFrame, order: list[Column], base: int | None = None) -> DataFrame:
        """Append ``rows`` with fresh ids in ``order`` and both times set; returns the rows as stored."""
        now = F.current_timestamp().cast("timestamp_ntz")
        stamps = {c: now for c in ("created_at", "updated_at") if c in schemas.TABLES[table].fieldNames()}
        base = self.version(table) if base is None else base
        held = self.segments(table, base)
        segment = self._write(table, numbered(rows.withColumns(stamps), order, self.next_id(table, base)))
        self._commit(table, base, [*held, segment])
        return self.spark.read.schema(schemas.TABLES[table]).parquet(*self._folders(table, [segment]))

    def _rewrite(self, table: str, keys: DataFrame, key: str, changed: DataFrame | None, base: int | None = None) -> int:
        """Take the rows with ``keys`` out of the segments that have any, and put ``changed`` in."""
        base = self.version(table) if base is None else base
        held = self.segments(table, base)
        if held:
            rows = self.spark.read.schema(schemas.TABLES[table]).parquet(*self._folders(table, held))
            of = F.regexp_extract(F.col("_metadata.file_path"), r"/segments/([0-9a-f]+)/", 1)
            hit = {r[0] for r in rows.select(key, of.alias("segment")).join(keys.select(key), key, "left_semi").select("segment").distinct().collect()}
        else:
            hit = set()
        new = [s for s in held if s not in hit]
        parts = [] if changed is None else [changed]
        if hit:
            touched = self.spark.read.schema(schemas.TABLES[table]).parquet(*self._folders(table, sorted(hit)))
            parts.append(touched.join(keys.select(key), key, "left_anti"))
        if parts:
            rows = parts[0]
            for p in parts[1:]:
                rows = rows.unionByName(p, allowMissingColumns=True)
            new.append(self._write(table, rows))
        return self._commit(table, base, new)

    def compact(self, table: str, files: int = 1) -> int:
        """Rewrite all segments as one of ``files`` files."""
        base = self.version(table)
        if not self.segments(table, base):
            return base
        return self._commit(table, base, [self._write(table, self.read(table, base).repartition(files))])

    def delete(self, table: str, keys: DataFrame, key: str = "id") -> int:
        """Remove the rows whose key is in ``keys``."""
        return self._rewrite(table, keys, key, None)

    def upsert(self, table: str, rows: DataFrame, key: str = "id", base: int | None = None) -> int:
        """Replace rows by key, and add those whose key is new."""
        return self._rewrite(table, rows, key, rows, base)

    def patch(self, table: str, changes: DataFrame, key: str = "id", base: int | None = None) -> int:
        """Set the columns of ``changes`` where they are not null; columns that are null or missing there stay as stored. Keys that the table lacks are ignored."""
        base = self.version(table) if base is None else base
        stored = self.read(table, base)
        return self._rewrite(table, changes, key, patched(stored.join(changes.select(key), key, "left_semi"), changes, key), base)


def patched(stored: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """``stored`` with the non-null values of ``changes``; ``updated_at`` is now for rows that ``changes`` has."""
    own = [c for c in stored.columns if c != key]
    renamed = changes.select(F.col(key), F.lit(True).alias("_changed"), *[F.col(c).alias(f"_new_{c}") for c in changes.columns if c in own])
    joined = stored.join(renamed, key, "left")
    now = F.current_timestamp().cast("timestamp_ntz")

    def value(c: str) -> Column:
        if f"_new_{c}" in joined.columns:
            return F.coalesce(F.col(f"_new_{c}").cast(stored.schema[c].dataType), F.col(c)).alias(c)
        if c == "updated_at":
            return F.when(F.col("_changed"), now).otherwise(F.col(c)).alias(c)
        return F.col(c)

    return joined.select(*[F.col(c) if c == key else value(c) for c in stored.columns])


def shown(df: DataFrame, table: str) -> DataFrame:
    """Without the columns that users do not see."""
    return df.drop(*schemas.HIDDEN.get(table, ()))
