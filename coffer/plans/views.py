"""The engine's tables as views of the star-schema test tables.

The tables have no nulls where optional columns need them, so some columns are
null for every third, fifth or fourth key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, external_id, account_id, user_id, creditor_name, debtor_name, booking_date, amount, merchant_id: orders of customers."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    key = F.col("o_orderkey")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).select(
        key.alias("id"),
        F.concat(F.lit("T-"), key.cast("string")).alias("external_id"),
        F.col("o_custkey").alias("account_id"),
        F.col("c_nationkey").cast("long").alias("user_id"),
        F.when(key % 3 != 0, F.col("o_orderpriority")).alias("creditor_name"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("debtor_name"),
        F.col("o_orderdate").cast("date").alias("booking_date"),
        F.col("o_totalprice").alias("amount"),
        F.when(key % 4 != 0, key % 97).alias("merchant_id"),
    )


def merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").cast("long").alias("user_id"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("institution_name"), F.col("c_name").alias("number"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))


TRIGGER_ROWS = [
    (1, 3, "transaction_created", "[]"),
    (2, 3, "transaction_created", '[{"Account":[17,57]}]'),
    (3, 7, "transaction_created", '[{"Account":[87,95]},{"Account":[95,135]}]'),
    (4, 7, "other", "[]"),
]


def triggers(spark: SparkSession) -> DataFrame:
    """Four triggers: all rows of a user, two accounts, one account by two predicates, and another event."""
    rows = [(i, event, f"t{i}", filter_, "{}", user, 1) for i, user, event, filter_ in TRIGGER_ROWS]
    return spark.createDataFrame(rows, "id long, event string, name string, filter string, params string, user_id long, function_id long")


#: The same views for DuckDB.
SQL = """WITH transactions AS (
  SELECT o_orderkey AS id, concat('T-', CAST(o_orderkey AS VARCHAR)) AS external_id, o_custkey AS account_id, CAST(c_nationkey AS BIGINT) AS user_id,
    CASE WHEN o_orderkey % 3 <> 0 THEN o_orderpriority END AS creditor_name, CASE WHEN o_orderkey % 5 <> 0 THEN c_mktsegment END AS debtor_name,
    CAST(o_orderdate AS DATE) AS booking_date, o_totalprice AS amount, CASE WHEN o_orderkey % 4 <> 0 THEN o_orderkey % 97 END AS merchant_id
  FROM orders JOIN customer ON o_custkey = c_custkey),
merchants AS (SELECT s_suppkey AS id, s_name AS name FROM supplier),
accounts AS (SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS user_id, c_acctbal AS balance, c_mktsegment AS institution_name, c_name AS number FROM customer),
users AS (SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name FROM nation),
triggers AS (SELECT * FROM (VALUES """ + ", ".join(f"(CAST({i} AS BIGINT), CAST({u} AS BIGINT), '{e}', '{f}')" for i, u, e, f in TRIGGER_ROWS) + ") t(id, user_id, event, filter))\n"
