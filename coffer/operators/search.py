"""Listings and paged text search over transactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.functions.scalars import like_pattern
from coffer.operators.ranking import newest, newest_per_key

#: What a search looks into, of a transaction and of its merchant.
SEARCHED = ("creditor_name", "debtor_name", "remittance_information", "merchant_name", "merchant_labels")


def with_merchant(transactions: DataFrame, merchants: DataFrame) -> DataFrame:
    """Each transaction with its merchant's columns, prefixed ``merchant_``; null where it has none."""
    named = merchants.select(F.col("id").alias("merchant_id"), *[F.col(c).alias(f"merchant_{c}") for c in merchants.columns if c not in ("id", "merchant_id")])
    return transactions.join(named, "merchant_id", "left")


def mentions(df: DataFrame, term: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """Does any of the columns contain the term, in any case? % and _ are wildcards; arrays are searched as comma-joined text."""
    pattern = like_pattern(term).lower()
    found = None
    for c in columns:
        if c not in df.columns:
            continue
        text = F.array_join(F.col(c), ",") if df.schema[c].dataType.typeName() == "array" else F.col(c)
        hit = F.lower(text).like(pattern)
        found = hit if found is None else found | hit
    return F.lit(False) if found is None else found


def mentions_plain(df: DataFrame, term: str, columns: tuple[str, ...] = SEARCHED) -> Column:
    """As ``mentions``, but accents count as their plain letters and there are no wildcards."""
    found = F.lit(False)
    for c in columns:
        if c in df.columns:
            text = F.array_join(F.col(c), ",") if df.schema[c].dataType.typeName() == "array" else F.col(c)
            found = found | F.coalesce(F.contains(F.collate(text, "UNICODE_CI_AI"), F.collate(F.lit(term), "UNICODE_CI_AI")), F.lit(False))
    return found


def search_page(transactions: DataFrame, merchants: DataFrame, user_id: int, term: str, page: int = 1, per_page: int = 100) -> DataFrame:
    """One page of a user's transactions that mention the term, newest first, ties to the larger id.

    Pages count from 1. The user filter reaches the scan of transactions; rows
    without a merchant stay in play, as the search may find them by their own
    text. Top-n with offset: no full sort.
    """
    if page < 1 or per_page < 1:
        raise ValueError("pages and their sizes count from 1")
    rows = with_merchant(transactions.where(F.col("user_id") == user_id), merchants)
    return newest(rows.where(mentions(rows, term)), "booking_date", per_page, (page - 1) * per_page)


def without_merchant(transactions: DataFrame, n: int = 100) -> DataFrame:
    """The newest n transactions that lack a merchant."""
    return newest(transactions.where(F.col("merchant_id").isNull()), "booking_date", n)


def newest_transactions(transactions: DataFrame, n: int = 100) -> DataFrame:
    return newest(transactions, "booking_date", n)


def newest_of_accounts(transactions: DataFrame, n: int = 50) -> DataFrame:
    """The newest n of each account."""
    return newest_per_key(transactions, "account_id", "booking_date", n)
