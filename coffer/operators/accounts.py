"""Accounts: balances, details, relinking, and adding those that a consent names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.functions import scalars
from coffer.operators.store import Store


def read_balances(answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(account_id, balance) from ``answers`` (account_id, balances: array), first balance as float; and the accounts without a readable one, with ``reason``."""
    first = F.get("balances", F.lit(0))["balanceAmount"]["amount"]
    read = answers.select("account_id", first.alias("_text"), scalars.parse_number(first).alias("balance"))
    reason = F.when(F.col("_text").isNull(), "no balance").otherwise(F.concat(F.lit("not a number: "), "_text"))
    return read.where("balance IS NOT NULL").select("account_id", "balance"), read.where("balance IS NULL").select("account_id", reason.alias("reason"))


def refresh_balances(store: Store, answers: DataFrame) -> DataFrame:
    """Store the balances that can be read; returns the accounts that failed. One account's failure does not touch the others."""
    good, bad = read_balances(answers)
    store.patch("accounts", good.withColumnRenamed("account_id", "id"))
    return bad


def from_details(details: DataFrame) -> DataFrame:
    """Wire details (account_id, institution_name, source_id, user_id, details: struct) as account columns; what is missing is '' and the status ``active``."""
    d = F.col("details")
    return details.select(
        *[c for c in ("account_id", "institution_name", "source_id", "user_id") if c in details.columns],
        F.coalesce(d["displayName"], d["ownerName"], F.lit("")).alias("name"),
        d["currency"].alias("currency"),
        d["product"].alias("product"),
        d["cashAccountType"].alias("cash_account_type"),
        F.coalesce(d["status"], F.lit("active")).alias("status"),
        scalars.blank(d["details"]).alias("details"),
        d["ownerName"].alias("owner_name"),
        scalars.account_number(d).alias("number"),
    )


def populate_details(store: Store, details: DataFrame) -> int:
    """Fill stored accounts from their source's details; what a source does not say stays as it is."""
    rows = from_details(details).withColumnRenamed("account_id", "id")
    empty = [c for c in ("name", "details", "number") if c in rows.columns]
    return store.patch("accounts", rows.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in empty}))


def add_accounts(store: Store, details: DataFrame, account_type: str) -> DataFrame:
    """Store the accounts of a consent. Type and config are set, so that an import can find their source."""
    rows = from_details(details).withColumns({"account_type": F.lit(account_type), "config": F.to_json(F.struct(F.col("source_id").alias("account_id")))})
    return store.insert("accounts", rows.drop("account_id"), [F.col("user_id"), F.col("source_id")])


def relink(store: Store, details: DataFrame) -> DataFrame:
    """Point stored accounts at a new consent, matched by number, institution and user; returns what matched none."""
    found = from_details(details)
    keys = ["number", "institution_name", "user_id"]
    base = store.version("accounts")
    matched = store.read("accounts", base).select("id", *keys).join(found.select(*keys, "source_id").dropDuplicates(keys), keys)
    store.patch("accounts", matched.select("id", "source_id", F.to_json(F.struct(F.col("source_id").alias("account_id"))).alias("config")), base=base)
    return found.join(matched.select(*keys), keys, "left_anti")


def with_source(accounts: DataFrame, known: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Accounts whose type is ``known`` and whose config is a JSON object, and the others."""
    usable = F.coalesce(F.col("account_type").isin(*known) & F.from_json("config", "map<string,string>").isNotNull(), F.lit(False))
    return accounts.where(usable), accounts.where(~usable)
