"""Pieces that several corpus operators share: scratch tables and global ranks."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: The words of a text are the runs of anything but space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"

_local_scratch: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where that is unset, one of our own if all runs on one machine, as in tests; else an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_scratch:
        _local_scratch[app] = tempfile.mkdtemp(prefix="coffer-scratch-")
    return _local_scratch[app]


def materialise(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, by the session's codec or ``codec``, and read it again: cuts lineage and survives the loss of executors.

    Results read these tables when they are evaluated, so nothing here deletes
    them: they lie in one folder for each application, to be removed after it.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/coffer-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def global_rank(df: DataFrame, keys: list[str], label: str, rows_per_part: int = 20_000, codec: str | None = None) -> tuple[DataFrame, int]:
    """Add ``global_rank``: 0 .. n-1 in the order of ``keys``; return the frame and n.

    One range shuffle sorts the rows; the place inside a partition comes from
    ``monotonically_increasing_id`` and the sorted table is written before the
    partition sizes are counted, so both see the same partition bounds. ``df``
    must be cheap to read twice (a scratch table). Rows that tie on all keys get
    distinct ranks in an arbitrary order, so ``keys`` should hold every column
    that the caller shows. A key that many rows share does not make a hot
    partition as long as later keys differ.
    """
    n = df.count()
    parts = max(1, min(8192, -(-n // rows_per_part)))
    place = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys) if n else df
    ordered = materialise(
        ordered.withColumns({"rank_part": F.shiftright(place, 33), "rank_place": place.bitwiseAND(F.lit((1 << 33) - 1))}),
        label,
        codec,
    )
    # At most 8192 rows (one for each partition), so one task and a broadcast are safe.
    before = Window.orderBy("rank_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("rank_part").agg(F.count("*").alias("rank_rows")).select("rank_part", F.coalesce(F.sum("rank_rows").over(before), F.lit(0)).alias("rank_start"))
    ranked = ordered.join(F.broadcast(starts), "rank_part").withColumn("global_rank", F.col("rank_start") + F.col("rank_place"))
    return ranked.drop("rank_part", "rank_place", "rank_start"), n


#: Rows of a lookup table up to which it is broadcast, and the keys that count as frequent at most.
LOOKUP_ROWS, FREQUENT_KEYS = 100_000, 50_000


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` joined with ``table``, one row a key; both written, keys never null.

    A short table is broadcast. Of a longer one only what frequent keys need is:
    keys with more than one row in FREQUENT_KEYS, so fewer than that many. The
    other rows meet the table by a shuffle, in which no key is frequent.
    """
    if table.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS:
        return rows.join(F.broadcast(table), keys)
    most = max(1000, rows.count() // FREQUENT_KEYS)
    often = materialise(rows.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "lookup-often")
    held = F.broadcast(materialise(table.join(F.broadcast(often), keys), "lookup-held"))
    return rows.join(held, keys).unionByName(rows.join(F.broadcast(often), keys, "left_anti").join(table, keys))


#: Bytes of an Arrow batch between the JVM and a Python worker. Spark's own limit is 64 MB, which both hold several times over.
BATCH_BYTES = 8 << 20
_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, once its session's Arrow batches are at most BATCH_BYTES long (or one row); a lower setting is kept.

    The setting counts when a plan runs, so it stays for the session.
    """
    conf = df.sparkSession.conf
    number, unit = re.fullmatch(r"(-?[0-9]+)\s*([a-z]*)", (conf.get(_BATCH_SETTING, None) or "-1").lower()).groups()
    held = int(number) * 1024 ** " kmgt".index((unit or "b").rstrip("b")[:1] or " ")
    if not 0 < held <= BATCH_BYTES:
        conf.set(_BATCH_SETTING, str(BATCH_BYTES))
    return df


def parts(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to ``rows`` rows, without copying: what becomes Python objects at once stays small."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def text_bytes(column: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(column).cast("binary"), F.lit(b""))
