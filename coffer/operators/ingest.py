"""Incremental import of bank transactions: canonical rows, lookback, identity, deduplication.

All accounts are one job. Each step is a frame function; ``import_batch`` puts
them together over a store.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.functions import currency, scalars
from coffer.operators.lineage import cut
from coffer.operators.store import Store

LOOKBACK_DAYS = 7


def canonical(wire: DataFrame) -> DataFrame:
    """Wire rows (account_id and the provider's fields) as canonical transactions, with identities.

    ``seq``, if there, is the order of the bank's answer and is kept.
    """
    amount, exchange = F.col("transactionAmount"), F.col("currencyExchange")
    text = F.col("remittanceInformationUnstructured")
    extra = [c for c in ("account_id", "seq") if c in wire.columns]
    return wire.select(
        *extra,
        scalars.content_id(F.col("transactionId"), F.col("bookingDate"), amount["amount"], amount["currency"], text).alias("external_id"),
        F.col("creditorName").alias("creditor_name"),
        F.col("debtorName").alias("debtor_name"),
        text.alias("remittance_information"),
        F.col("bookingDate").alias("booking_date"),
        scalars.naive_utc(F.col("bookingDateTime")).alias("booking_datetime"),
        amount["amount"].alias("transaction_amount"),
        amount["currency"].alias("transaction_amount_currency"),
        F.col("proprietaryBankTransactionCode").alias("proprietary_bank_transaction_code"),
        exchange["exchangeRate"].alias("currency_exchange_rate"),
        exchange["sourceCurrency"].alias("currency_exchange_source_currency"),
        exchange["targetCurrency"].alias("currency_exchange_target_currency"),
    )


def usable(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that can be stored, and the quarantine: rows without a booking date, amount or currency, with ``reason``."""
    reason = F.when(F.col("booking_date").isNull(), "no booking date").when(F.col("transaction_amount").isNull() | F.col("transaction_amount_currency").isNull(), "no amount")
    marked = rows.withColumn("reason", reason)
    return marked.where(F.col("reason").isNull()).drop("reason"), marked.where(F.col("reason").isNotNull())


def lookback(accounts: DataFrame, transactions: DataFrame, days: int = LOOKBACK_DAYS) -> DataFrame:
    """account_id and from_date of each account: its newest booking date less ``days``, null (everything) if it has none."""
    newest = transactions.groupBy("account_id").agg(F.max("booking_date").alias("newest"))
    return accounts.select(F.col("id").alias("account_id")).join(newest, "account_id", "left").select("account_id", scalars.lookback_start(F.col("newest"), days).alias("from_date"))


def since(rows: DataFrame, start: DataFrame) -> DataFrame:
    """The rows of accounts in ``start`` that are not older than its from_date."""
    return rows.join(start, "account_id").where(F.col("from_date").isNull() | (F.col("booking_date") >= F.col("from_date"))).drop("from_date")


def one_a_key(rows: DataFrame) -> DataFrame:
    """One row of each (external_id, account_id): the first by ``seq``, or any without that column.

    A second import would take the twin as stored, so it is not kept in the first.
    """
    keys = ["external_id", "account_id"]
    if "seq" not in rows.columns:
        return rows.dropDuplicates(keys)
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy("seq"))).where("_rank = 1").drop("_rank")


def new_rows(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """The rows whose (external_id, account_id) the store lacks: one anti-join."""
    return rows.join(stored.select("external_id", "account_id"), ["external_id", "account_id"], "left_anti")


def stamped(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """With the user of each row's account, and a flag for currencies that are not in ISO 4217."""
    owners = accounts.select(F.col("id").alias("account_id"), "user_id")
    return rows.join(owners, "account_id").withColumn("currency_valid", F.coalesce(currency.is_currency(F.col("transaction_amount_currency")), F.lit(False)))


@dataclass
class Imported:
    """What an import stored, what it set aside, and how each account fared (account_id, status, n_new)."""

    rows: DataFrame
    quarantine: DataFrame
    status: DataFrame


def account_status(accounts: DataFrame, sources: DataFrame | None, stored: DataFrame) -> DataFrame:
    """One row for each account: ``no source`` if its type or config is missing, ``failed`` with the source's message, else ``ok`` and the number of new rows."""
    counted = stored.groupBy("account_id").agg(F.count("*").alias("n_new"))
    base = accounts.select(F.col("id").alias("account_id"), "account_type", "config").join(counted, "account_id", "left")
    message = F.lit(None).cast("string")
    if sources is not None:
        base = base.join(sources.select("account_id", F.col("error").alias("_error")), "account_id", "left")
        message = F.col("_error")
    status = F.when(F.col("config").isNull() | (F.coalesce(F.col("account_type"), F.lit("")) == ""), "no source").when(message.isNotNull(), F.concat(F.lit("failed: "), message)).otherwise("ok")
    return base.select("account_id", status.alias("status"), F.coalesce("n_new", F.lit(0)).cast("long").alias("n_new"))


def import_batch(store: Store, wire: DataFrame, errors: DataFrame | None = None) -> Imported:
    """Import wire rows of any number of accounts.

    Rows of accounts that the store lacks are set aside too.

    A source that failed is a row of ``errors`` (account_id, error) and does not
    stop the others. Importing the same rows again stores nothing.
    """
    base = store.version("transactions")
    accounts, stored = store.read("accounts"), store.read("transactions", base)
    start_deliveries(store, base)
    good, bad = usable(canonical(wire))
    strange = good.join(accounts.select(F.col("id").alias("account_id")), "account_id", "left_anti")
    bad = bad.unionByName(strange.withColumn("reason", F.lit("unknown account")))
    fresh = new_rows(one_a_key(since(good, lookback(accounts, stored))), stored)
    rows = stamped(fresh, accounts)
    order = [F.col(c) for c in ("booking_date", "account_id", "seq", "external_id") if c in rows.columns]
    kept = store.insert("transactions", rows, order, base)
    return Imported(kept, bad, account_status(accounts, errors, kept))


def start_deliveries(store: Store, version: int) -> None:
    """In a store without deliveries: what it has so far counts as delivered."""
    if not store.version("deliveries"):
        delivered(store, store.next_id("transactions", version) - 1)


def undelivered(store: Store) -> DataFrame:
    """The stored transactions whose triggers have not been run to the end: those with ids above the last delivery, as ids follow the imports.

    An import that ended before its triggers had run leaves its rows here, so the
    next one takes them along.
    """
    last = store.read("deliveries").agg(F.max("id")).first()[0] or 0  # one row for each import
    return store.read("transactions").where(F.col("id") > last)


def delivered(store: Store, last_id: int) -> None:
    """Note that triggers have been run for all transactions up to ``last_id``."""
    store.append("deliveries", store.spark.createDataFrame([(last_id,)], "id long").withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")))


def deliver(store: Store, run: Callable[[DataFrame], object]) -> DataFrame:
    """``run`` over all undelivered transactions, and note them as delivered; returns them."""
    rows = cut(undelivered(store))
    run(rows)
    last = rows.agg(F.max("id")).first()[0]
    if last is not None:
        delivered(store, last)
    return rows
