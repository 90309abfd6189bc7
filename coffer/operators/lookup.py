"""Reads of the stored tables: each takes and returns frames, so filters reach the scan and joins stay lazy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class NotFound(LookupError):
    """A read of exactly one row found none."""


def equals(**values: object) -> Column:
    """All columns equal these values; a null value matches nothing."""
    return reduce(lambda a, b: a & b, [F.col(k) == F.lit(v) for k, v in values.items()])


def find(df: DataFrame, **values: object) -> DataFrame:
    """The rows with these values."""
    return df.where(equals(**values)) if values else df


def one(df: DataFrame, **values: object) -> DataFrame:
    """At most one of the rows with these values, lazily."""
    return find(df, **values).limit(1)


def require(df: DataFrame, **values: object):
    """The row with these values, as a Row; raises NotFound."""
    row = one(df, **values).first()
    if row is None:
        raise NotFound(", ".join(f"{k}={v}" for k, v in values.items()))
    return row


def user_by_email(users: DataFrame, email: str) -> DataFrame:
    return one(users, email=email)


def accounts_of_user(accounts: DataFrame, user_id: int) -> DataFrame:
    return find(accounts, user_id=user_id)


def account_by_bank_details(accounts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The accounts that ``wanted`` (number, institution_name, user_id) names, by an equi-join on the three keys."""
    keys = ["number", "institution_name", "user_id"]
    return accounts.join(wanted.select(*keys).distinct(), keys, "left_semi")


def transactions_of_account(transactions: DataFrame, account_id: int) -> DataFrame:
    return find(transactions, account_id=account_id)


def transaction_of_user(transactions: DataFrame, id: int, user_id: int) -> DataFrame:
    return one(transactions, id=id, user_id=user_id)


def merchant_by_name(merchants: DataFrame, name: str, website: str) -> DataFrame:
    """By name and website; rows without a website never match. The smallest id of several."""
    return find(merchants, name=name, website=website).orderBy("id").limit(1)


def merchant_by_external_id(merchants: DataFrame, external_id: str) -> DataFrame:
    return find(merchants, external_id=external_id).orderBy("id").limit(1)


def functions_of_user(functions: DataFrame, user_id: int) -> DataFrame:
    return find(functions, user_id=user_id)


def triggers_for(triggers: DataFrame, user_id: int, event: str) -> DataFrame:
    return find(triggers, user_id=user_id, event=event)


def log_of_user(log: DataFrame, user_id: int) -> DataFrame:
    return find(log, user_id=user_id)


def rates_of(rates: DataFrame, base_code: str) -> DataFrame:
    """The latest rates of a base currency."""
    return rates.where(F.col("base_code") == base_code).groupBy("base_code").agg(F.max_by("conversion_rates", "last_update").alias("conversion_rates"), F.max("last_update").alias("last_update"))
