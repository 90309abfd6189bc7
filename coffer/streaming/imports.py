"""Streaming import: landed bank answers become micro-batches of the same import as in batch.

The lookback is per account and reads the store, so it needs no watermark: a
global one would drop rows of a quiet account. A micro-batch that is repeated
stores nothing twice (the anti-join), calls no sink twice (the log), and runs the
triggers of rows that an interrupted one had stored (the deliveries).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from coffer import schemas
from coffer.operators import ingest, merchants, triggers
from coffer.operators.store import Store
from coffer.sources import bank


def answers(spark: SparkSession, path: str, files_per_batch: int = 100) -> DataFrame:
    """Stream of landed answers: account_id, seq and wire fields, ``files_per_batch`` files at a time."""
    schema = T.StructType([T.StructField("transactions", T.StructType([T.StructField("booked", T.ArrayType(schemas.WIRE_TRANSACTION))]))])
    raw = spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_per_batch).json(path)
    return raw.select(bank.account_of_file().alias("account_id"), F.posexplode("transactions.booked").alias("seq", "t")).select("account_id", F.col("seq").cast("long").alias("seq"), "t.*")


def importer(store: Store, enricher: merchants.Enricher | None = None, sinks: Mapping[str, triggers.Sink] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: import, attach merchants, run triggers."""

    def run(batch: DataFrame, batch_id: int) -> None:
        ingest.import_batch(store, batch)
        ingest.deliver(store, finish)

    def finish(rows: DataFrame) -> None:
        known = merchants.enrich(store, rows, enricher) if enricher is not None else rows
        triggers.dispatch(store, known, sinks or {})

    return run


def start(spark: SparkSession, store: Store, path: str, checkpoint: str, **how: object) -> StreamingQuery:
    """Import all that has landed under ``path`` since the last call, then stop."""
    return answers(spark, path).writeStream.foreachBatch(importer(store, **how)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def newest_by_account(rows: DataFrame) -> DataFrame:
    """Stream of (account_id, newest): the newest booking date of each account so far, kept as state and never expired.

    Later rows of an account that are older change nothing, so quiet accounts
    keep their date.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        best = state.get[0] if state.exists else None
        for pdf in batches:
            for day in pdf["booking_date"].dropna():
                best = day if best is None or day > best else best
        if best is not None:
            state.update((best,))
            yield pd.DataFrame({"account_id": [key[0]], "newest": [best]})

    return rows.groupBy("account_id").applyInPandasWithState(update, "account_id long, newest date", "newest date", "update", GroupStateTimeout.NoTimeout)


def matched_stream(transactions: DataFrame, trigger_table: DataFrame) -> DataFrame:
    """A stream of transactions joined with the static trigger table."""
    return triggers.matched(transactions, trigger_table)
