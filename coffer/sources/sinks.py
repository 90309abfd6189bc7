"""Sinks for trigger calls: the draft of a budget entry, a registry, and a writer that posts or lands it."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars
from coffer.operators.lineage import cut
from coffer.operators.triggers import Sink
from coffer.sources.bank import load

#: Parameters of the budget sink: name, is it required, what it is. Keys are the same for users and for the parser.
BUDGET_PARAMS = (("api_key", True, "key of the budget service"), ("account_id", True, "number of the budget account"), ("category_key", False, "key of a service that picks a category"))
#: Sent with each draft.
BUDGET_FLAGS = {"apply_rules": True, "check_for_recurring": True, "debit_as_negative": True, "skip_balance_update": False}


def missing_params(settings: Column) -> Column:
    """Names of required parameters that a call lacks."""
    required = F.array(*[F.lit(n) for n, needed, _ in BUDGET_PARAMS if needed])
    return F.filter(required, lambda n: F.coalesce(F.try_element_at(settings, n), F.lit("")) == "")


def draft(transaction: Column, settings: Column, category_id: Column | None = None) -> Column:
    """A budget entry for a transaction: amounts as the bank wrote them, the currency in lower case, payee by creditor or debtor, cleared, named by the external id."""
    return F.struct(
        (category_id if category_id is not None else F.lit(None).cast("long")).alias("category_id"),
        F.try_element_at(settings, F.lit("account_id")).try_cast("long").alias("asset_id"),
        F.date_format(transaction["booking_date"], "yyyy-MM-dd").alias("date"),
        transaction["transaction_amount"].alias("amount"),
        F.lower(transaction["transaction_amount_currency"]).alias("currency"),
        scalars.payee(transaction["creditor_name"], transaction["debtor_name"]).alias("payee"),
        scalars.blank(transaction["remittance_information"]).alias("notes"),
        F.lit("cleared").alias("status"),
        transaction["external_id"].alias("external_id"),
    )


def with_category(calls: DataFrame, choices: DataFrame, categories: DataFrame) -> DataFrame:
    """Calls with ``category_id``: the category whose name was chosen for the transaction; the smallest id of several of that name.

    ``choices``: external_id, category (what a chooser answered); ``categories``:
    id, name. No choice or an unknown name: null.
    """
    first = categories.groupBy(F.col("name").alias("category")).agg(F.min("id").alias("category_id"))
    chosen = choices.join(first, "category", "left").select(F.col("external_id").alias("_external"), "category_id")
    return calls.join(chosen, F.col("transaction.external_id") == F.col("_external"), "left").drop("_external")


#: From calls to (external_id, category): the name that was chosen for each; calls without an answer are missing.
Chooser = Callable[[DataFrame], DataFrame]


def choosing_sink(sink: Sink, chooser: Chooser, categories: DataFrame) -> Sink:
    """``sink``, with a category for the calls whose settings have a ``category_key``: the one of ``categories`` (id, name) that ``chooser`` names."""

    def run(calls: DataFrame) -> DataFrame:
        asked = calls.where(F.coalesce(F.try_element_at("settings", F.lit("category_key")), F.lit("")) != "")
        choices = cut(chooser(asked).dropDuplicates(["external_id"]))
        return sink(with_category(calls, choices, categories))

    return run


def client_chooser(client: str, categories: list[str]) -> Chooser:
    """A chooser that asks ``client`` (module:factory; an object whose ``category(names, transaction)`` gives one of the names). A request that fails has no answer."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = load(client)()
        for pdf in batches:
            names = []
            for text in pdf["transaction"]:
                try:
                    names.append(service.category(categories, json.loads(text)))
                except Exception:  # noqa: BLE001  a service's failure is no answer
                    names.append(None)
            yield pd.DataFrame({"external_id": pdf["external_id"], "category": names})

    def run(calls: DataFrame) -> DataFrame:
        rows = calls.select(F.col("transaction.external_id").alias("external_id"), F.to_json("transaction").alias("transaction")).dropDuplicates(["external_id"])
        return rows.mapInPandas(ask, "external_id string, category string").where("category IS NOT NULL")

    return run


def request_body(calls: DataFrame) -> Column:
    """The body that is posted for a call: its draft and the flags."""
    category = F.col("category_id") if "category_id" in calls.columns else None
    return F.struct(F.array(draft(F.col("transaction"), F.col("settings"), category)).alias("transactions"), *[F.lit(v).alias(k) for k, v in BUDGET_FLAGS.items()])


def client_sink(client: str) -> Sink:
    """A sink that posts each draft with ``client`` (module:factory; takes the call's settings and gives an object whose ``post(body)`` returns a list of errors)."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        make = load(client)
        for pdf in batches:
            status, console = [], []
            for settings, body, missing in zip(pdf["settings_json"], pdf["body"], pdf["missing"], strict=True):
                try:
                    errors = [f"missing {n}" for n in missing] or list(make(json.loads(settings)).post(json.loads(body)) or [])
                except Exception as e:  # noqa: BLE001  one call's failure is its own status
                    errors = [f"{type(e).__name__}: {e}"]
                status.append("failed" if errors else "ok")
                console.append(errors)
            yield pdf[["payload"]].assign(status=status, console=console)

    def run(calls: DataFrame) -> DataFrame:
        asked = calls.select("payload", F.to_json("settings").alias("settings_json"), F.to_json(request_body(calls)).alias("body"), missing_params(F.col("settings")).alias("missing"))
        return calls.join(asked.mapInPandas(send, "payload string, status string, console array<string>"), "payload")

    return run


def landing_sink(path: str) -> Sink:
    """A sink that appends drafts as JSON files under ``path``, for a loader to pick up."""

    def run(calls: DataFrame) -> DataFrame:
        rows = cut(calls.withColumn("_missing", missing_params(F.col("settings"))))
        category = F.col("category_id") if "category_id" in calls.columns else None
        rows.where(F.size("_missing") == 0).select(draft(F.col("transaction"), F.col("settings"), category).alias("d")).select("d.*").write.mode("append").json(path)
        failed = F.size("_missing") > 0
        return rows.withColumns({"status": F.when(failed, "failed").otherwise("ok"), "console": F.transform("_missing", lambda n: F.concat(F.lit("missing "), n))}).drop("_missing")

    return run


def registry(**sinks: Sink) -> Mapping[str, Sink]:
    """Sinks by function type."""
    return dict(sinks)
