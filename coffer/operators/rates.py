"""Currency rates: one map of known codes for each base currency."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions.currency import is_currency
from coffer.operators.store import Store


def known_rates(answers: DataFrame) -> DataFrame:
    """``answers`` (base_code, conversion_rates) without codes that are not in ISO 4217; bases that are unknown go. Stamped with the time."""
    kept = F.map_filter("conversion_rates", lambda code, _: is_currency(code))
    return answers.where(is_currency(F.col("base_code"))).select("base_code", kept.alias("conversion_rates"), F.current_timestamp().cast("timestamp_ntz").alias("last_update"))


def refresh(store: Store, answers: DataFrame) -> int:
    """Insert or replace the rates of each base in ``answers``."""
    return store.upsert("exchange_rates", known_rates(answers).dropDuplicates(["base_code"]), "base_code")


def listed(rates: DataFrame) -> DataFrame:
    """One row for each pair of currencies."""
    return rates.select("base_code", F.explode("conversion_rates").alias("code", "rate"), "last_update")
