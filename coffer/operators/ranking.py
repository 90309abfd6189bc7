"""Ranks without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.operators.lineage import cut


#: Rows that a task ranks at once.
ROWS = 200_000


def numbered(df: DataFrame, order: list[Column], start: int, name: str = "id") -> DataFrame:
    """Add ``name``: start, start + 1, ... in ``order``, which must be unique for the same result in each run.

    One range shuffle sorts the rows, so no key is too large for a task; the
    sorted rows are checkpointed, so their places and the sizes of the
    partitions, of which there are few, come from the same partitions.
    """
    df = cut(df)
    n = df.count()
    keys = {f"_key{i}": c for i, c in enumerate(order)}
    ordered = df.withColumns(keys)
    if n:
        ordered = ordered.repartitionByRange(-(-n // ROWS), *keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    ordered = cut(ordered.drop(*keys).withColumns({"_part": F.shiftright(place, 33), "_place": place.bitwiseAND(F.lit((1 << 33) - 1))}))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"))
    ranked = ordered.join(F.broadcast(starts), "_part")  # one row for each ROWS rows
    return ranked.withColumn(name, (F.lit(start) + F.col("_before") + F.col("_place")).cast("long")).drop("_part", "_place", "_before")


def newest(df: DataFrame, by: str, n: int, offset: int = 0) -> DataFrame:
    """The n newest rows, ties to the larger id: a top-n, not a full sort."""
    return df.orderBy(F.col(by).desc(), F.col("id").desc()).offset(offset).limit(n)


def newest_per_key(df: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The n newest rows of each key. Spark cuts each partition to n a key before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(by).desc(), F.col("id").desc()))
    return df.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")
