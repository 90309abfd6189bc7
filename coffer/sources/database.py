"""Moving the tables of a relational store into this one over JDBC.

The driver's jar is the user's to provide (``--jars``). A table is read in
ranges of its id, so that no one task or connection carries all of it.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coffer import schemas
from coffer.operators.store import Store

ROWS_A_RANGE = 200_000


def id_ranges(low: int | None, high: int | None, rows: int = ROWS_A_RANGE) -> list[str]:
    """Predicates that cut low .. high into ranges of ``rows`` ids; an empty table is one range."""
    if low is None or high is None:
        return ["1 = 1"]
    return [f"id >= {a} AND id < {min(a + rows, high + 1)}" for a in range(low, high + 1, rows)]


def _typed(column: Column, kind: T.DataType, stored: T.DataType) -> Column:
    """A column as the schema has it: JSON text is parsed where the schema is nested, delimited text where it is a list."""
    if isinstance(kind, T.ArrayType) and isinstance(stored, T.StringType):
        return F.when(column.isNotNull(), F.filter(F.transform(F.split(column, ","), lambda x: F.trim(x)), lambda x: x != ""))
    if isinstance(kind, T.MapType) and isinstance(stored, T.StringType):
        return F.from_json(column, kind)
    return column.cast(kind)


def conformed(rows: DataFrame, table: str, renamed: Mapping[str, str] | None = None) -> DataFrame:
    """``rows`` with the columns of a stored table; ``renamed`` maps theirs to ours, and what they lack is null."""
    for theirs, ours in (renamed or {}).items():
        rows = rows.withColumnRenamed(theirs, ours)
    have = {f.name: f.dataType for f in rows.schema.fields}
    return rows.select(*[(_typed(F.col(f.name), f.dataType, have[f.name]) if f.name in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.TABLES[table].fields])


def read_table(spark: SparkSession, url: str, table: str, properties: Mapping[str, str]) -> DataFrame:
    """A table in ranges of its id."""
    ends = spark.read.jdbc(url, f"(SELECT min(id) AS low, max(id) AS high FROM {table}) ends", properties=dict(properties)).first()
    return spark.read.jdbc(url, table, predicates=id_ranges(ends["low"], ends["high"]), properties=dict(properties))


def move(store: Store, url: str, properties: Mapping[str, str], renamed: Mapping[str, Mapping[str, str]] | None = None) -> dict[str, int]:
    """Append every table with an id to the store; the version that each one has then."""
    out = {}
    for table, schema in schemas.TABLES.items():
        if "id" in schema.fieldNames():
            out[table] = store.append(table, conformed(read_table(store.spark, url, table, properties), table, (renamed or {}).get(table)))
    return out
