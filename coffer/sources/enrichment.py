"""Merchant enrichment behind one interface: a table of known texts, or a client called in the tasks.

An enricher takes transactions and gives transaction_id and merchant (a struct
of ``schemas.NEW_MERCHANT``); rows that are not recognised are missing.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer import schemas
from coffer.functions import currency, scalars
from coffer.operators.merchants import Enricher
from coffer.sources.bank import load

#: Requests under way at once in a task.
CONCURRENCY = 10


def requests(transactions: DataFrame) -> DataFrame:
    """What a service is asked for each transaction: description, the amount as the bank wrote it and as an absolute number, direction, currency, its first country ('' if none uses it) and date."""
    amount = scalars.amount_or_zero(F.col("transaction_amount"), "double")
    return transactions.select(
        F.col("id").alias("transaction_id"),
        scalars.description(F.col("creditor_name"), F.col("debtor_name"), F.col("remittance_information")).alias("description"),
        F.col("transaction_amount").alias("amount_text"),
        F.abs(amount).alias("amount"),
        scalars.direction(amount).alias("entry_type"),
        F.col("transaction_amount_currency").alias("iso_currency_code"),
        F.coalesce(currency.first_country(F.col("transaction_amount_currency")), F.lit("")).alias("country"),
        F.date_format("booking_date", "yyyy-MM-dd").alias("date"),
        F.col("user_id").cast("string").alias("account_holder_id"),
    )


def table_enricher(known: DataFrame) -> Enricher:
    """An enricher that looks descriptions up in ``known`` (description, merchant)."""
    return lambda transactions: requests(transactions).join(known, "description").select("transaction_id", "merchant")


def client_enricher(client: str) -> Enricher:
    """An enricher that calls ``client`` (module:factory; an object whose ``merchant(request)`` gives a dict or None), CONCURRENCY requests at a time in each task. A request that fails leaves its row unmatched."""

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        service = load(client)()

        def one(request: dict) -> str | None:
            try:
                found = service.merchant(request)
            except Exception:  # noqa: BLE001  a service's failure is no answer
                return None
            return json.dumps(found) if found and found.get("name") else None

        with ThreadPoolExecutor(CONCURRENCY) as pool:
            for pdf in batches:
                yield pd.DataFrame({"transaction_id": pdf["transaction_id"], "answer": list(pool.map(one, pdf.to_dict("records")))})

    def run(transactions: DataFrame) -> DataFrame:
        answers = requests(transactions).mapInPandas(ask, "transaction_id long, answer string").where("answer IS NOT NULL")
        return answers.select("transaction_id", F.from_json("answer", schemas.NEW_MERCHANT).alias("merchant"))

    return run


def from_place(answer: Column) -> Column:
    """A merchant from an answer with merchant, merchant_id, website, icon and address (line1, city, state, postalCode, country)."""
    address = answer["address"]
    location = F.struct(
        *[address[a].alias(b) for a, b in (("line1", "address"), ("city", "city"), ("state", "state"), ("postalCode", "postcode"), ("country", "country"))],
        *[F.lit(None).cast(f.dataType).alias(f.name) for f in schemas.LOCATION.fields[5:]],
    )
    return F.struct(
        answer["merchant"].alias("name"),
        answer["icon"].alias("logo_url"),
        F.when(address.isNotNull(), scalars.address_text(address)).alias("location"),
        F.when(address.isNotNull(), location).alias("location_structured"),
        F.lit(None).cast("array<string>").alias("labels"),
        answer["merchant_id"].alias("external_id"),
        answer["website"].alias("website"),
    )


def from_labels(answer: Column) -> Column:
    """A merchant from an answer with merchant, merchant_id, website, logo, location and labels; null without a merchant."""
    made = F.struct(answer["merchant"].alias("name"), answer["logo"].alias("logo_url"), answer["location"].alias("location"), F.lit(None).cast(schemas.LOCATION).alias("location_structured"), answer["labels"].alias("labels"), answer["merchant_id"].alias("external_id"), answer["website"].alias("website"))
    return F.when(answer["merchant"].isNotNull(), made)


def with_brand(merchants: DataFrame, brands: DataFrame) -> DataFrame:
    """``merchants`` (the columns of ``schemas.NEW_MERCHANT``) with name, logo and external id of the first hit of a brand search.

    ``brands``: query, hits (array of brandId, name, icon). The query is the
    website's host, or the name. Merchants without a hit stay as they are.
    """
    keyed = merchants.withColumn("query", scalars.host_or_name(F.col("website"), F.col("name")))
    hit = F.get("hits", F.lit(0))
    found = keyed.join(brands.withColumn("hit", hit).select("query", "hit"), "query", "left")
    changes = {"name": F.coalesce("hit.name", "name"), "logo_url": F.coalesce("hit.icon", "logo_url"), "external_id": F.coalesce("hit.brandId", "external_id")}
    return found.withColumns(changes).select(*merchants.columns)
