"""The bank source: landed answers read by Spark, and a data source that calls a client.

Landed answers are the provider's JSON, one file for each account; Spark reads
them from any of its file systems. ``fetch`` and its likes call a client in the
tasks, some accounts in each, and the data source ``coffer-bank`` does for a few
accounts; the client is named by its import path.
"""

from __future__ import annotations

import importlib
import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from coffer import schemas
from coffer.operators.lineage import cut

#: Account types that have a source.
KNOWN_SOURCES = ("bank",)


def account_of_file() -> Column:
    """The account that a landed file is of: the first number in its name (``12.json``, ``12_2026-01.json``, ``booked-12.json``)."""
    return F.regexp_extract(F.input_file_name(), r"/[^0-9/]*([0-9]+)[^/]*\.json$", 1).try_cast("long")


def read_transactions(spark: SparkSession, path: str, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Booked transactions of landed answers: account_id (the name of the file), seq (the order of the answer) and the wire fields. Pending ones are ignored."""
    schema = T.StructType([T.StructField("transactions", T.StructType([T.StructField("booked", T.ArrayType(schemas.WIRE_TRANSACTION))]))])
    raw = spark.read.schema(schema).option("multiLine", True).json(path)
    account = account_of_file()
    rows = raw.select(account.alias("account_id"), F.posexplode("transactions.booked").alias("seq", "t")).select("account_id", F.col("seq").cast("long").alias("seq"), "t.*")
    if date_from:
        rows = rows.where(F.col("bookingDate").isNull() | (F.col("bookingDate") >= F.to_date(F.lit(date_from))))
    if date_to:
        rows = rows.where(F.col("bookingDate").isNull() | (F.col("bookingDate") <= F.to_date(F.lit(date_to))))
    return rows


def read_details(spark: SparkSession, path: str) -> DataFrame:
    """account_id and details of landed answers."""
    schema = T.StructType([T.StructField("account", schemas.WIRE_DETAILS)])
    account = account_of_file()
    return spark.read.schema(schema).option("multiLine", True).json(path).select(account.alias("account_id"), F.col("account").alias("details"))


def read_balances(spark: SparkSession, path: str) -> DataFrame:
    """account_id and balances of landed answers."""
    schema = T.StructType([T.StructField("balances", schemas.WIRE_BALANCES)])
    account = account_of_file()
    return spark.read.schema(schema).option("multiLine", True).json(path).select(account.alias("account_id"), "balances")


def read_institutions(spark: SparkSession, path: str, country: str | None = None, id: str | None = None) -> DataFrame:
    """Institutions of landed answers, all, of a country, or one."""
    rows = spark.read.schema(schemas.INSTITUTION).option("multiLine", True).json(path)
    if country:
        rows = rows.where(F.array_contains("countries", country))
    return rows.where(F.col("id") == id) if id else rows


def read_rates(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """base_code and conversion_rates of landed answers."""
    schema = T.StructType([T.StructField("base_code", T.StringType()), T.StructField("conversion_rates", T.MapType(T.StringType(), T.DoubleType()))])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.where(F.col("base_code") == base) if base else rows


def load(path: str) -> Callable:
    """The object at ``module:name``."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


class _Account(InputPartition):
    def __init__(self, account_id: int, config: str, date_from: str | None, date_to: str | None) -> None:
        self.account_id, self.config, self.date_from, self.date_to = account_id, config, date_from, date_to


def _booked(client: str, account_id: int, config: str, date_from: str | None, date_to: str | None) -> Iterator[tuple]:
    """(account_id, seq, JSON text, None) for each booked row of an account from ``date_from`` to ``date_to``; a client that fails gives one row with its message instead."""
    try:
        answer = load(client)(json.loads(config)).transactions(date_from)
        rows = [r for r in answer.get("transactions", {}).get("booked", []) if not date_to or (r.get("bookingDate") or "") <= date_to]
    except Exception as e:  # noqa: BLE001  any failure of one account must not stop the others
        yield account_id, None, None, f"{type(e).__name__}: {e}"
        return
    for seq, row in enumerate(rows):
        yield account_id, seq, json.dumps(row), None


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.client, self.accounts = options["client"], json.loads(options["accounts"])

    def partitions(self) -> list[_Account]:
        return [_Account(a["account_id"], a.get("config") or "{}", a.get("date_from"), a.get("date_to")) for a in self.accounts]

    def read(self, partition: _Account) -> Iterator[tuple]:
        return _booked(self.client, partition.account_id, partition.config, partition.date_from, partition.date_to)


class BankSource(DataSource):
    """``coffer-bank``: options ``client`` (module:factory; the factory takes an account's config and gives an object with ``transactions(date_from)``) and ``accounts`` (a JSON list of account_id, config, date_from, date_to: for a few accounts; ``fetch`` takes a table of any size)."""

    @classmethod
    def name(cls) -> str:
        return "coffer-bank"

    def schema(self) -> str:
        return "account_id bigint, seq bigint, payload string, error string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)


def _spread(rows: DataFrame, by: str, per_task: int = 64) -> DataFrame:
    """A few ``rows`` for each task: a client's answers take long and the rows are short."""
    return rows.repartition(max(1, -(-rows.count() // per_task)), by)


def fetch(spark: SparkSession, accounts: DataFrame, start: DataFrame, client: str, date_to: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Wire rows of ``accounts`` (id, config) from their from_date in ``start`` on, up to ``date_to``, and (account_id, error) of those whose client failed. The accounts stay in the tasks."""
    wanted = accounts.select(F.col("id").alias("account_id"), F.coalesce("config", F.lit("{}")).alias("config")).join(start.select("account_id", F.col("from_date").cast("string").alias("date_from")), "account_id")

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for account_id, config, date_from in zip(pdf["account_id"], pdf["config"], pdf["date_from"], strict=True):
                rows = list(_booked(client, int(account_id), config, date_from if isinstance(date_from, str) else None, date_to))
                if rows:
                    yield pd.DataFrame(rows, columns=["account_id", "seq", "payload", "error"]).astype({"seq": "Int64"})

    rows = cut(_spread(wanted, "account_id").mapInPandas(ask, "account_id long, seq long, payload string, error string"))
    wire = rows.where("payload IS NOT NULL").select("account_id", "seq", F.from_json("payload", schemas.WIRE_TRANSACTION).alias("t")).select("account_id", "seq", "t.*")
    return wire, rows.where("error IS NOT NULL").select("account_id", "error")


def ask(keys: DataFrame, client: str, method: str) -> tuple[DataFrame, DataFrame]:
    """What ``client`` says of each of ``keys`` (key, config): (key, answer: JSON text) from its ``method`` called with the key, and (key, error) where that failed."""

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, config in zip(pdf["key"], pdf["config"], strict=True):
                try:
                    rows.append((key, json.dumps(getattr(load(client)(json.loads(config)), method)(key)), None))
                except Exception as e:  # noqa: BLE001  one key's failure must not stop the others
                    rows.append((key, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    wanted = keys.select(F.col("key").cast("string").alias("key"), F.coalesce("config", F.lit("{}")).alias("config"))
    rows = cut(_spread(wanted, "key").mapInPandas(call, "key string, answer string, error string"))
    return rows.where("answer IS NOT NULL").select("key", "answer"), rows.where("error IS NOT NULL").select("key", "error")


def _answers(accounts: DataFrame, client: str, method: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """account_id and the parsed answer ``a`` for ``accounts`` (id, config), and the failures."""
    good, bad = ask(accounts.select(F.col("id").alias("key"), "config"), client, method)
    key = F.col("key").cast("long").alias("account_id")
    return good.select(key, F.from_json("answer", schema).alias("a")), bad.select(key, "error")


def fetch_details(accounts: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """account_id and details of ``accounts`` (id, config) from a client with ``details(key)``; and the failures."""
    good, bad = _answers(accounts, client, "details", T.StructType([T.StructField("account", schemas.WIRE_DETAILS)]))
    return good.select("account_id", F.col("a.account").alias("details")), bad


def fetch_balances(accounts: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """account_id and balances of ``accounts`` (id, config) from a client with ``balances(key)``; and the failures."""
    good, bad = _answers(accounts, client, "balances", T.StructType([T.StructField("balances", schemas.WIRE_BALANCES)]))
    return good.select("account_id", "a.balances"), bad


def fetch_institutions(countries: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """Institutions of ``countries`` (key, config) from a client with ``institutions(key)``; and the failures."""
    good, bad = ask(countries, client, "institutions")
    return good.select(F.explode(F.from_json("answer", T.ArrayType(schemas.INSTITUTION))).alias("i")).select("i.*").dropDuplicates(["id"]), bad


def fetch_rates(bases: DataFrame, client: str) -> tuple[DataFrame, DataFrame]:
    """base_code and conversion_rates of ``bases`` (key, config) from a client with ``rates(key)``; and the failures."""
    good, bad = ask(bases, client, "rates")
    schema = T.StructType([T.StructField("base_code", T.StringType()), T.StructField("conversion_rates", T.MapType(T.StringType(), T.DoubleType()))])
    return good.select(F.from_json("answer", schema).alias("a")).select("a.*"), bad
