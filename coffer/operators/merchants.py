"""Merchants: enrichment results, resolution against the store and within a batch, attachment.

The rules, for candidates in the order of ``seq``: with an external id, the
stored row of that id; else the row of that name and website ('' if the
candidate has none, which a stored null never equals); else insert. Without an
external id but with a website: name and website, else insert. With neither:
insert. A candidate sees what earlier ones inserted.

``resolve`` does this in rounds of joins. In a round a candidate is settled if
nothing that an earlier, still open candidate might insert could change its
outcome. Groups of equal candidates settle together, so the number of rounds
depends on how candidates chain, not on how many share a key.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer import schemas
from coffer.operators.lineage import cut
from coffer.operators.ranking import newest, numbered
from coffer.operators.store import Store

_KEYS = "seq long, external_id string, name string, website string"


def keyed(candidates: DataFrame) -> DataFrame:
    """With ``lookup``: the website that a candidate is looked up by, null if it is not."""
    return candidates.withColumn("lookup", F.when(F.col("external_id").isNotNull(), F.coalesce("website", F.lit(""))).otherwise(F.col("website")))


def match_store(candidates: DataFrame, merchants: DataFrame) -> DataFrame:
    """``candidates`` (seq, external_id, name, website) with by_id and by_name: the smallest stored merchant ids that the two rules find."""
    ids = merchants.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("id").alias("by_id"))
    names = merchants.where("website IS NOT NULL").groupBy(F.col("name"), F.col("website").alias("lookup")).agg(F.min("id").alias("by_name"))
    return keyed(candidates).join(ids, "external_id", "left").join(names, ["name", "lookup"], "left")


def resolve(candidates: DataFrame, merchants: DataFrame) -> DataFrame:
    """The outcome of each candidate: seq, merchant_id (stored) or insert_seq (the candidate that is inserted; its own seq if it is itself).

    Exact in the sense above. ``seq`` must be unique. Each round is written to
    the checkpoint folder, so lineage stays short.
    """
    spark = candidates.sparkSession
    open_ = cut(match_store(candidates.select("seq", "external_id", "name", "website"), merchants))
    settled = spark.createDataFrame([], "seq long, merchant_id long, insert_seq long")
    inserted = spark.createDataFrame([], _KEYS)
    while True:
        ids = inserted.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("seq").alias("id_seq"))
        names = inserted.where("website IS NOT NULL").groupBy("name", F.col("website").alias("lookup")).agg(F.min("seq").alias("name_seq"))
        seen = open_.join(ids, "external_id", "left").join(names, ["name", "lookup"], "left")
        seen = seen.withColumns({"id_seq": F.when(F.col("id_seq") < F.col("seq"), F.col("id_seq")), "name_seq": F.when(F.col("name_seq") < F.col("seq"), F.col("name_seq"))})
        found = seen.withColumns({"has_id": F.col("by_id").isNotNull() | F.col("id_seq").isNotNull(), "has_name": F.col("by_name").isNotNull() | F.col("name_seq").isNotNull()})
        # Who may still insert: neither rule finds anything for it so far.
        may = found.where("NOT has_id AND NOT has_name")
        first_id = may.where("external_id IS NOT NULL").groupBy("external_id").agg(F.min("seq").alias("first_id"))
        first_name = may.where("website IS NOT NULL").groupBy("name", F.col("website").alias("lookup")).agg(F.min("seq").alias("first_name"))
        waits = found.join(first_id, "external_id", "left").join(first_name, ["name", "lookup"], "left")
        behind = lambda c: F.coalesce(F.col(c) < F.col("seq"), F.lit(False))
        blocked = ~F.col("has_id") & (behind("first_id") | (~F.col("has_name") & behind("first_name")))
        step = cut(waits.withColumn("blocked", blocked))
        done = step.where("NOT blocked")
        merchant = F.when(F.col("has_id"), F.col("by_id")).when(F.col("has_name"), F.col("by_name"))
        own = F.when(F.col("has_id"), F.when(F.col("by_id").isNull(), F.col("id_seq"))).when(F.col("has_name"), F.when(F.col("by_name").isNull(), F.col("name_seq"))).otherwise(F.col("seq"))
        settled = cut(settled.unionByName(done.select("seq", merchant.alias("merchant_id"), own.alias("insert_seq"))))
        inserted = cut(inserted.unionByName(done.where("NOT has_id AND NOT has_name").select("seq", "external_id", "name", "website")))
        open_ = step.where("blocked").select("seq", "external_id", "name", "website", "lookup", "by_id", "by_name")
        if not open_.take(1):
            return settled


def by_external_id(candidates: DataFrame, merchants: DataFrame) -> DataFrame:
    """The older rule: seq and merchant_id, the smallest stored id of the candidate's external id, or null; name and website do not count."""
    return match_store(candidates, merchants).select("seq", F.col("by_id").alias("merchant_id"))


def create_or_fetch(store: Store, candidates: DataFrame) -> DataFrame:
    """Resolve ``candidates`` (seq and the columns of ``schemas.NEW_MERCHANT``), insert what is new, and return seq and merchant_id."""
    base = store.version("merchants")
    outcome = resolve(candidates, store.read("merchants", base))
    new = candidates.join(outcome.where("insert_seq = seq").select("seq"), "seq", "left_semi").withColumn("location_structured", F.coalesce(F.to_json("location_structured"), F.lit("null")))
    stored = _insert_in_order(store, new, base)
    found = outcome.join(stored, outcome["insert_seq"] == stored["new_seq"], "left")
    return found.select("seq", F.coalesce("merchant_id", "new_id").alias("merchant_id"))


def _insert_in_order(store: Store, new: DataFrame, base: int) -> DataFrame:
    """Insert merchants by seq; new_seq and new_id of each. Raises Conflict if the table is not at version ``base``."""
    ranked = cut(numbered(new, [F.col("seq")], store.next_id("merchants", base)))
    store.append("merchants", ranked.drop("seq").withColumn("created_at", F.current_timestamp().cast("timestamp_ntz")), base)
    return ranked.select(F.col("seq").alias("new_seq"), F.col("id").alias("new_id"))


def attach(transactions: DataFrame, resolved: DataFrame) -> DataFrame:
    """``transactions`` with the merchant of ``resolved`` (seq: the transaction's id, merchant_id). Rows without one keep what they had: nothing is dropped."""
    known = resolved.select(F.col("seq").alias("id"), F.col("merchant_id").alias("_merchant"))
    return transactions.join(known, "id", "left").withColumn("merchant_id", F.coalesce("_merchant", "merchant_id")).drop("_merchant").select(*transactions.columns)


#: From transactions to (transaction_id, merchant: struct of ``schemas.NEW_MERCHANT``); rows that are not recognised are missing.
Enricher = Callable[[DataFrame], DataFrame]


def enrich(store: Store, transactions: DataFrame, enricher: Enricher) -> DataFrame:
    """Ask for the merchants of ``transactions``, resolve them, update the stored rows, and return all rows."""
    answers = enricher(transactions).where("merchant IS NOT NULL AND merchant.name IS NOT NULL")
    answers = cut(answers.groupBy("transaction_id").agg(F.max_by("merchant", F.to_json("merchant")).alias("merchant")))
    resolved = create_or_fetch(store, answers.select(F.col("transaction_id").alias("seq"), *[F.col(f"merchant.{f.name}") for f in schemas.NEW_MERCHANT.fields]))
    out = cut(attach(transactions, resolved))
    changed = out.join(resolved.select(F.col("seq").alias("id")), "id", "left_semi").withColumn("updated_at", F.current_timestamp().cast("timestamp_ntz"))
    store.upsert("transactions", changed)
    return out


def backfill(store: Store, enricher: Enricher, limit: int = 100) -> DataFrame:
    """One pass over the newest ``limit`` transactions that lack a merchant; returns them, with ``attempted`` set.

    Rows that are not recognised stay without a merchant and are not asked for
    again in this pass, so it always ends.
    """
    transactions = store.read("transactions")
    rows = cut(newest(transactions.where("merchant_id IS NULL"), "booking_date", limit))
    return enrich(store, rows, enricher).withColumn("attempted", F.lit(True))
