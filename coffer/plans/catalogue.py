"""Driver queries: each operator over the whole test tables, with DuckDB SQL of the same result."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer import schemas
from coffer.functions import currency, scalars
from coffer.operators import accounts as account_ops
from coffer.operators import ingest, lineage, lookup, merchants, ranking, rates, search, store, triggers
from coffer.plans import views
from coffer.sources import enrichment, sinks
from coffer.streaming import imports

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

_TX = "id, external_id, account_id, user_id, creditor_name, debtor_name, booking_date, amount, merchant_id"
_TX_COLUMNS = _TX.split(", ")


def query(sql: str) -> Callable[[Query], Query]:
    """Register a query by its function's name; ``sql`` follows the views."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        ORACLES[f.__name__] = views.SQL + sql
        return f

    return add


# Listings and search


_SEARCH_SQL = f"""SELECT {", ".join("t." + c for c in _TX_COLUMNS)}, m.name AS merchant_name FROM transactions t LEFT JOIN merchants m ON t.merchant_id = m.id
WHERE t.user_id = 3 AND (lower(creditor_name) LIKE '%urg%' OR lower(debtor_name) LIKE '%urg%' OR lower(m.name) LIKE '%urg%')
ORDER BY booking_date DESC, t.id DESC LIMIT 10"""


@query(_SEARCH_SQL)
def tx_search_first_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.search_page(views.transactions(spark, sf_dir), views.merchants(spark, sf_dir), 3, "urg", page=1, per_page=10)
    return page.select(*_TX_COLUMNS, "merchant_name")


@query(_SEARCH_SQL + " OFFSET 20")
def tx_search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = search.search_page(views.transactions(spark, sf_dir), views.merchants(spark, sf_dir), 3, "urg", page=3, per_page=10)
    return page.select(*_TX_COLUMNS, "merchant_name")


@query(f"SELECT {_TX} FROM transactions WHERE merchant_id IS NULL ORDER BY booking_date DESC, id DESC LIMIT 100")
def tx_without_merchant_top100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.without_merchant(views.transactions(spark, sf_dir))


@query(f"SELECT {_TX} FROM transactions ORDER BY booking_date DESC, id DESC LIMIT 100")
def tx_newest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest_transactions(views.transactions(spark, sf_dir))


@query(f"SELECT {_TX} FROM transactions QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY booking_date DESC, id DESC) <= 3")
def tx_newest_k_per_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.newest_of_accounts(views.transactions(spark, sf_dir), 3)


@query(f"SELECT {_TX} FROM transactions WHERE account_id = 5")
def tx_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.transactions_of_account(views.transactions(spark, sf_dir), 5)


@query(f"SELECT {_TX} FROM transactions WHERE user_id = 3")
def tx_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find(views.transactions(spark, sf_dir), user_id=3)


@query(f"SELECT {_TX} FROM transactions WHERE id = 6")
def tx_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(views.transactions(spark, sf_dir), id=6)


@query("SELECT id, user_id, balance, institution_name, number FROM accounts")
def accounts_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find(views.accounts(spark, sf_dir))


@query("SELECT id, user_id, balance, institution_name, number FROM accounts WHERE user_id = 3")
def accounts_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.accounts_of_user(views.accounts(spark, sf_dir), 3)


@query("SELECT id, user_id, balance, institution_name, number FROM accounts WHERE id = 9 AND user_id = (SELECT user_id FROM accounts WHERE id = 9)")
def account_by_id_and_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = views.accounts(spark, sf_dir)
    return all_.join(lookup.one(all_, id=9).select("id", "user_id"), ["id", "user_id"], "left_semi")


@query("SELECT id, user_id, balance, institution_name, number FROM accounts a WHERE EXISTS (SELECT 1 FROM accounts b WHERE b.id % 10 = 0 AND b.number = a.number AND b.institution_name = a.institution_name AND b.user_id = a.user_id)")
def account_by_bank_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    all_ = views.accounts(spark, sf_dir)
    return lookup.account_by_bank_details(all_, all_.where("id % 10 = 0")).select("id", "user_id", "balance", "institution_name", "number")


@query("SELECT id, name FROM users")
def users_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find(views.users(spark, sf_dir))


@query("SELECT id, name FROM users WHERE id = 3")
def user_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(views.users(spark, sf_dir), id=3)


@query("SELECT id, name FROM merchants")
def merchants_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.find(views.merchants(spark, sf_dir))


@query("SELECT id, name FROM merchants WHERE id = 7")
def merchant_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(views.merchants(spark, sf_dir), id=7)


@query("SELECT id, user_id, event, filter FROM triggers WHERE user_id = 7 AND event = 'transaction_created'")
def triggers_for_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.triggers_for(views.triggers(spark), 7, "transaction_created").select("id", "user_id", "event", "filter")


@query(f"SELECT {', '.join('t.' + c for c in _TX_COLUMNS)}, m.name AS merchant_name FROM transactions t LEFT JOIN merchants m ON t.merchant_id = m.id")
def tx_with_merchant(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.with_merchant(views.transactions(spark, sf_dir), views.merchants(spark, sf_dir)).select(*_TX_COLUMNS, "merchant_name")


# Import


@query("SELECT a.id AS account_id, max(t.booking_date) - 7 AS from_date FROM accounts a LEFT JOIN transactions t ON t.account_id = a.id GROUP BY a.id")
def account_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.lookback(views.accounts(spark, sf_dir), views.transactions(spark, sf_dir))


@query("SELECT t.id, t.account_id, t.booking_date FROM transactions t JOIN (SELECT account_id, max(booking_date) - 7 AS f FROM transactions GROUP BY account_id) n ON t.account_id = n.account_id WHERE t.booking_date >= n.f")
def tx_since_lookback(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir)
    return ingest.since(rows, ingest.lookback(views.accounts(spark, sf_dir), rows)).select("id", "account_id", "booking_date")


@query(f"SELECT {_TX} FROM transactions i WHERE id % 2 = 0 AND NOT EXISTS (SELECT 1 FROM transactions s WHERE s.id % 6 = 0 AND s.external_id = i.external_id AND s.account_id = i.account_id)")
def new_tx_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir)
    return ingest.new_rows(rows.where("id % 2 = 0"), rows.where("id % 6 = 0")).select(*_TX_COLUMNS)


@query("SELECT min(id) AS id, external_id, account_id FROM (SELECT id, concat('D-', CAST(id // 2 AS VARCHAR)) AS external_id, CAST(1 AS BIGINT) AS account_id FROM transactions) d GROUP BY external_id, account_id")
def tx_dedupe_in_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).select("id", F.concat(F.lit("D-"), F.expr("CAST(id div 2 AS string)")).alias("external_id"), F.lit(1).cast("long").alias("account_id"), F.col("id").alias("seq"))
    return ingest.one_a_key(rows).drop("seq")


@query("SELECT id, sha256(CASE WHEN booking_date > DATE '2000-02-20' THEN concat(strftime(booking_date, '%Y-%m-%d'), ':1EUR:', external_id) ELSE concat(strftime(booking_date, '%Y-%m-%d'), ':', strftime(booking_date, '%Y-%m-%d'), ':', external_id, ':[object Object]') END) AS content_id FROM transactions")
def tx_content_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The data end before the real cutover, so it is moved; the amount is a constant, as engines print doubles differently.
    made = scalars.content_id(F.lit(None).cast("string"), F.col("booking_date"), F.lit("1"), F.lit("EUR"), F.col("external_id"), cutover="2000-02-20")
    return views.transactions(spark, sf_dir).select("id", made.alias("content_id"))


@query("SELECT id, CASE WHEN id % 7 = 0 THEN 'no booking date' ELSE 'no amount' END AS reason FROM transactions WHERE id % 7 = 0 OR id % 11 = 0")
def tx_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).select("id", F.when(F.col("id") % 7 != 0, F.col("booking_date")).alias("booking_date"), F.when(F.col("id") % 11 != 0, F.lit("1.00")).alias("transaction_amount"), F.lit("EUR").alias("transaction_amount_currency"))
    return ingest.usable(rows)[1].select("id", "reason")


@query("SELECT a.id AS account_id, CASE WHEN a.id % 9 = 0 THEN 'no source' WHEN a.id % 10 = 0 THEN 'failed: timeout' ELSE 'ok' END AS status, count(t.id) AS n_new FROM accounts a LEFT JOIN transactions t ON t.account_id = a.id AND t.id % 2 = 0 GROUP BY a.id")
def account_import_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each account fared in an import: some have no source, some failed."""
    held = views.accounts(spark, sf_dir).select("id", F.lit("bank").alias("account_type"), F.when(F.col("id") % 9 != 0, F.lit("{}")).alias("config"))
    errors = held.where("id % 10 = 0").select(F.col("id").alias("account_id"), F.lit("timeout").alias("error"))
    return ingest.account_status(held, errors, views.transactions(spark, sf_dir).where("id % 2 = 0"))


@query("SELECT id, account_id, user_id, CASE WHEN id % 3 = 0 THEN 'XXQ' ELSE 'EUR' END AS code, id % 3 <> 0 AS currency_valid FROM transactions")
def tx_stamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with the user of their account and a flag for unknown currencies."""
    rows = views.transactions(spark, sf_dir).select("id", "account_id", F.when(F.col("id") % 3 == 0, F.lit("XXQ")).otherwise(F.lit("EUR")).alias("transaction_amount_currency"))
    return ingest.stamped(rows, views.accounts(spark, sf_dir)).select("id", "account_id", "user_id", F.col("transaction_amount_currency").alias("code"), "currency_valid")


# Scalars


@query("SELECT id, coalesce(creditor_name, debtor_name, '') AS payee, concat(coalesce(creditor_name, ''), ' ', coalesce(debtor_name, ''), ' ', external_id) AS description, CASE WHEN amount - 200000 < 0 THEN 'outgoing' ELSE 'incoming' END AS direction, abs(amount - 200000) AS amount FROM transactions")
def tx_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("amount") - 200000
    return views.transactions(spark, sf_dir).select(
        "id",
        scalars.payee(F.col("creditor_name"), F.col("debtor_name")).alias("payee"),
        scalars.description(F.col("creditor_name"), F.col("debtor_name"), F.col("external_id")).alias("description"),
        scalars.direction(amount).alias("direction"),
        F.abs(amount).alias("amount"),
    )


@query("SELECT event_id, event_type, json_extract_string(props, '$.k') AS k FROM events")
def event_props_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat JSON objects of events, read as a trigger's parameters are."""
    return views.table(spark, sf_dir, "events").select("event_id", "event_type", F.try_element_at(scalars.parse_params(F.col("props")), F.lit("k")).alias("k"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages")
def page_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.table(spark, sf_dir, "pages").select("page_id", scalars.host_or_name(F.col("url"), F.lit("")).alias("host"))


_CODES = ["EUR", "USD", "XXQ", "", "eur", "JPY", "SEK"]
_KNOWN = "('EUR', 'USD', 'JPY', 'SEK')"


@query(f"SELECT id, code, code IN {_KNOWN} AS known, CASE WHEN code IN {_KNOWN} THEN code ELSE 'USD' END AS lenient, CASE WHEN code IN {_KNOWN} THEN code END AS strict FROM (SELECT id, (ARRAY{_CODES!r})[CAST(id % 7 AS INTEGER) + 1] AS code FROM transactions) c")
def currency_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*[F.lit(c) for c in _CODES]), (F.col("id") % 7 + 1).cast("int"))
    rows = views.transactions(spark, sf_dir).select("id", code.alias("code"))
    c = F.col("code")
    return rows.select("id", "code", currency.is_currency(c).alias("known"), currency.currency_or_usd(c).alias("lenient"), currency.strict_currency(c).alias("strict"))


_NUMBERS = ["1.5", "-0", "abc", "", "1f", "+2", " 3 ", "-1.25"]


@query(f"SELECT id, text, CAST(CASE WHEN regexp_full_match(text, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)') THEN TRY_CAST(text AS FLOAT) ELSE 0 END AS FLOAT) AS amount FROM (SELECT id, (ARRAY{_NUMBERS!r})[CAST(id % 8 AS INTEGER) + 1] AS text FROM transactions) c")
def amount_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(c) for c in _NUMBERS]), (F.col("id") % 8 + 1).cast("int"))
    return views.transactions(spark, sf_dir).select("id", text.alias("text")).withColumn("amount", scalars.amount_or_zero(F.col("text")))


@query("SELECT id, concat('L', CAST(id AS VARCHAR), ', ', coalesce(debtor_name, ''), ', , ', coalesce(creditor_name, ''), ', CH') AS address FROM transactions")
def address_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    address = F.struct(F.concat(F.lit("L"), F.col("id").cast("string")).alias("line1"), F.col("debtor_name").alias("city"), F.lit(None).cast("string").alias("state"), F.col("creditor_name").alias("postalCode"), F.lit("CH").alias("country"))
    return views.transactions(spark, sf_dir).select("id", scalars.address_text(address).alias("address"))


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'C' || CAST(id AS VARCHAR) END AS city FROM transactions")
def location_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fourth row has a whole location; the others have null, broken JSON, or a field of the wrong type."""
    kind = F.col("id") % 4
    whole = F.concat(F.lit('{"city":"C'), F.col("id").cast("string"), F.lit('","latitude":1.5}'))
    json = F.when(kind == 0, whole).when(kind == 1, F.lit("null")).when(kind == 2, F.lit("bad")).otherwise(F.lit('{"city":"X","latitude":"abc"}'))
    return views.transactions(spark, sf_dir).select("id", json.alias("json")).select("id", scalars.parse_location(F.col("json"))["city"].alias("city"))


@query("SELECT id, CASE id % 3 WHEN 0 THEN 'a|b' ELSE '' END AS console FROM transactions")
def console_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    json = F.when(F.col("id") % 3 == 0, F.lit('["a","b"]')).when(F.col("id") % 3 == 1, F.lit("bad"))
    return views.transactions(spark, sf_dir).select("id", json.alias("json")).select("id", scalars.joined(scalars.parse_console(F.col("json")), "|").alias("console"))


# Merchants


@query("SELECT seq, merchant_id FROM (VALUES (1, 3), (2, 7), (3, NULL), (4, NULL)) v(seq, merchant_id)")
def merchant_resolve_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resolution against the store: by external id, by name and website, and twice not at all."""
    name = F.col("name")
    stored = views.merchants(spark, sf_dir).select("id", name, F.concat(F.lit("e"), F.col("id").cast("string")).alias("external_id"), F.concat(F.lit("w"), F.col("id").cast("string")).alias("website"))
    seven = stored.where("id = 7").select(F.lit(2).cast("long").alias("seq"), F.lit("e-unknown").alias("external_id"), "name", "website")
    rows = [(1, "e3", "any", None), (3, "e-other", "nobody", None), (4, None, "nobody", "w3")]
    wanted = spark.createDataFrame(rows, "seq long, external_id string, name string, website string").unionByName(seven)
    return merchants.match_store(wanted, stored).select(F.col("seq").cast("int").alias("seq"), F.coalesce("by_id", "by_name").cast("int").alias("merchant_id"))


@query("SELECT id AS seq, min(id) OVER (PARTITION BY CASE WHEN id % 3 = 0 THEN 'x' ELSE 'y' END, account_id % 50) AS insert_seq FROM transactions")
def merchant_resolve_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch of candidates against an empty store: a third share external ids, the others names and websites; the first of each inserts."""
    rows = views.transactions(spark, sf_dir)
    third, key = F.col("id") % 3 == 0, (F.col("account_id") % 50).cast("string")
    wanted = rows.select(F.col("id").alias("seq"), F.when(third, F.concat(F.lit("e"), key)).alias("external_id"), F.when(third, F.concat(F.lit("n"), F.col("id").cast("string"))).otherwise(F.concat(F.lit("m"), key)).alias("name"), F.when(~third, F.concat(F.lit("w"), key)).alias("website"))
    stored = spark.createDataFrame([], "id long, external_id string, name string, website string")
    return merchants.resolve(wanted, stored).select("seq", "insert_seq")


@query("SELECT id, CAST(CASE WHEN id % 97 < 10 AND merchant_id IS NOT NULL THEN 1000 + id % 97 ELSE merchant_id END AS BIGINT) AS merchant_id FROM transactions")
def enrich_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that enrichment knows get its merchant, and all others stay."""
    rows = views.transactions(spark, sf_dir)
    found = rows.where("id % 97 < 10 AND merchant_id IS NOT NULL").select(F.col("id").alias("seq"), (F.lit(1000) + F.col("id") % 97).alias("merchant_id"))
    return merchants.attach(rows, found).select("id", "merchant_id")


@query("SELECT id AS transaction_id, concat(coalesce(creditor_name, ''), ' ', coalesce(debtor_name, ''), ' ', external_id) AS description, 'incoming' AS entry_type, '7.25' AS amount_text, CAST(7.25 AS DOUBLE) AS amount, 'AD' AS country, strftime(booking_date, '%Y-%m-%d') AS date FROM transactions")
def enrichment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).withColumns({"remittance_information": F.col("external_id"), "transaction_amount": F.lit("7.25"), "transaction_amount_currency": F.lit("EUR")})
    return enrichment.requests(rows).select("transaction_id", "description", "entry_type", "amount_text", "amount", "country", "date")


# Triggers and sinks


@query("""SELECT g.id AS trigger_id, t.id AS transaction_id FROM triggers g JOIN transactions t ON g.user_id = t.user_id
WHERE g.event = 'transaction_created' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(from_json(g.filter, '[{"Account":["BIGINT"]}]')) AS p) z WHERE NOT list_contains(p.Account, t.account_id))""")
def trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return triggers.matched(views.transactions(spark, sf_dir), views.triggers(spark)).select("trigger_id", F.col("transaction.id").alias("transaction_id"))


@query("SELECT CAST(2 AS BIGINT) AS trigger_id, id AS transaction_id FROM (SELECT * FROM transactions WHERE account_id IN (17, 57) QUALIFY row_number() OVER (PARTITION BY account_id ORDER BY booking_date DESC, id DESC) <= 5) n WHERE user_id = 3")
def trigger_manual_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = triggers.manual_run(views.transactions(spark, sf_dir), views.triggers(spark).where("id = 2"), 5)
    return rows.select("trigger_id", F.col("transaction.id").alias("transaction_id"))


@query("SELECT id, CAST(42 AS BIGINT) AS asset_id, strftime(booking_date, '%Y-%m-%d') AS date, '7.25' AS amount, 'eur' AS currency, coalesce(creditor_name, debtor_name, '') AS payee, coalesce(debtor_name, '') AS notes, 'cleared' AS status, external_id FROM transactions")
def sink_draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).withColumns({"remittance_information": F.col("debtor_name"), "transaction_amount": F.lit("7.25"), "transaction_amount_currency": F.lit("EUR")})
    body = sinks.draft(F.struct(*rows.columns), F.create_map(F.lit("account_id"), F.lit("42")))
    return rows.select("id", body.alias("d")).select("id", "d.asset_id", "d.date", "d.amount", "d.currency", "d.payee", "d.notes", "d.status", "d.external_id")


# Rates, balances and changes to stored rows


_RATES_SQL = "SELECT CASE id % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'USD' ELSE 'CHF' END AS base_code, u.code, CAST(CASE u.code WHEN 'EUR' THEN id + 0.5 ELSE id * 2 END AS DOUBLE) AS rate FROM accounts, (VALUES ('EUR'), ('JPY')) u(code)"


def _rate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each account: a known base, and for every fourth an unknown one too; two known codes and an unknown one."""
    number = F.col("id").cast("double")
    base = F.when(F.col("id") % 3 == 0, "EUR").when(F.col("id") % 3 == 1, "USD").otherwise("CHF")
    rates_ = F.create_map(F.lit("EUR"), number + 0.5, F.lit("XXQ"), F.lit(1.0), F.lit("JPY"), number * 2)
    good = views.accounts(spark, sf_dir).select("id", base.alias("base_code"), rates_.alias("conversion_rates"))
    return good.unionByName(good.where("id % 4 = 0").withColumn("base_code", F.lit("QQQ")))


@query(_RATES_SQL)
def rate_map_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rates.listed(rates.known_rates(_rate_answers(spark, sf_dir))).select("base_code", "code", "rate")


@query(f"SELECT base_code, code, max(rate) AS rate FROM ({_RATES_SQL}) r WHERE base_code = 'USD' GROUP BY base_code, code")
def rates_of_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest of many rates of a base; here the later is the larger."""
    held = rates.known_rates(_rate_answers(spark, sf_dir)).withColumn("last_update", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, 0, conversion_rates['EUR'])"))
    return rates.listed(lookup.rates_of(held, "USD")).select("base_code", "code", "rate")


@query("SELECT base_code, code, rate FROM (VALUES ('EUR', 'EUR', 9.5), ('EUR', 'JPY', 18.0), ('USD', 'EUR', 10.5), ('USD', 'JPY', 20.0)) v(base_code, code, rate) WHERE EXISTS (SELECT 1 FROM accounts WHERE id = 10)")
def rates_refresh_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of two bases inserted and then replaced in a store."""
    held, answers = _store(spark), _rate_answers(spark, sf_dir)
    for ids in ((6, 7), (9, 10)):
        rates.refresh(held, answers.where(F.col("id").isin(*ids)))
    return rates.listed(held.read("exchange_rates")).select("base_code", "code", F.col("rate").cast("decimal(3,1)").alias("rate"))


@query("SELECT id AS account_id, CAST(CASE WHEN id % 5 <> 0 AND id % 7 <> 0 THEN id % 100 + 0.5 END AS FLOAT) AS balance, CASE WHEN id % 7 = 0 THEN 'no balance' WHEN id % 5 = 0 THEN 'not a number: n/a' END AS reason FROM accounts")
def balance_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First balances of all accounts; those that fail say why."""
    text = F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise(F.concat((F.col("id") % 100).cast("string"), F.lit(".5")))
    one = F.struct(F.struct(text.alias("amount"), F.lit("EUR").alias("currency")).alias("balanceAmount"))
    balances = F.when(F.col("id") % 7 == 0, F.array().cast("array<struct<balanceAmount:struct<amount:string,currency:string>>>")).otherwise(F.array(one))
    good, bad = account_ops.read_balances(views.accounts(spark, sf_dir).select(F.col("id").alias("account_id"), "id").select("account_id", balances.alias("balances")))
    return good.unionByName(bad, allowMissingColumns=True)


@query("SELECT id, external_id FROM transactions WHERE id % 3 <> 0")
def delete_antijoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third transaction deleted from a store."""
    held, rows = _stored(spark, sf_dir)
    held.delete("transactions", rows.where("id % 3 = 0").select("id"))
    return held.read("transactions").select("id", "external_id")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE external_id END AS external_id FROM transactions UNION ALL SELECT -id, 'added' FROM transactions WHERE id % 7 = 0")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth row replaced and every seventh added under a new key."""
    held, rows = _stored(spark, sf_dir)
    changed = rows.where("id % 5 = 0").withColumn("external_id", F.lit("new")).unionByName(rows.where("id % 7 = 0").withColumns({"id": -F.col("id"), "external_id": F.lit("added")}))
    held.upsert("transactions", changed)
    return held.read("transactions").select("id", "external_id")


@query("SELECT id, CASE WHEN id % 5 = 0 THEN 'patched' ELSE debtor_name END AS debtor_name, creditor_name FROM transactions")
def store_patch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls of a patch change nothing."""
    held, rows = _stored(spark, sf_dir)
    held.patch("transactions", rows.where("id % 5 = 0").select("id", F.lit("patched").alias("debtor_name"), F.lit(None).cast("string").alias("creditor_name")))
    return held.read("transactions").select("id", "debtor_name", "creditor_name")


@query("SELECT row_number() OVER (ORDER BY booking_date, t.id) AS id, external_id FROM transactions t")
def store_insert_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two inserts, the earlier days first: ids go on where the first ended."""
    held, rows = _store(spark), _canonical(spark, sf_dir)
    for part in (rows.where("booking_date < date'1996-01-01'"), rows.where("booking_date >= date'1996-01-01'")):
        held.insert("transactions", part.drop("id"), [F.col("booking_date"), F.substring("external_id", 3, 20).cast("long")])
    return held.read("transactions").select("id", "external_id")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'P' || CAST(id AS VARCHAR) ELSE institution_name END AS institution_name, number FROM accounts")
def patch_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second account gets a new institution; nulls in the change leave what is stored."""
    rows = views.accounts(spark, sf_dir).select("id", "institution_name", "number")
    changes = rows.select("id", F.when(F.col("id") % 2 == 0, F.concat(F.lit("P"), F.col("id").cast("string"))).alias("institution_name"), F.lit(None).cast("string").alias("number"))
    return store.patched(rows, changes)


@query("SELECT id, 1000 + row_number() OVER (ORDER BY booking_date, id) - 1 AS new_id FROM transactions")
def id_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir).select("id", "booking_date")
    return ranking.numbered(rows, [F.col("booking_date"), F.col("id")], 1000, "new_id").select("id", "new_id")


@query("SELECT user_id, event_id AS transaction_id, CAST(g.id AS BIGINT) AS trigger_id FROM events e JOIN (SELECT id, user_id AS u FROM triggers WHERE filter = '[]' AND event = 'transaction_created') g ON e.user_id = g.u WHERE e.event_type = 'purchase'")
def event_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases stand for created transactions."""
    events = views.table(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("event_id").alias("id"), "user_id", F.lit(-1).cast("long").alias("account_id"))
    return triggers.matched(events, views.triggers(spark)).select(F.col("transaction.user_id").alias("user_id"), F.col("transaction.id").alias("transaction_id"), "trigger_id")


@query("SELECT id, CASE id % 4 WHEN 0 THEN 'AD' WHEN 1 THEN 'US' WHEN 2 THEN 'CH' END AS country FROM transactions")
def currency_countries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first country that uses each row's currency."""
    code = F.when(F.col("id") % 4 == 0, "EUR").when(F.col("id") % 4 == 1, "USD").when(F.col("id") % 4 == 2, "CHF").otherwise("XXQ")
    return views.transactions(spark, sf_dir).select("id", currency.first_country(code).alias("country"))


# Stores: what commands do to stored tables, read back


def _store(spark: SparkSession) -> store.Store:
    """An empty store in the shared folder."""
    return store.Store(spark, f"{lineage.folder(spark)}/store-{uuid.uuid4().hex}")


def _canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir)
    return rows.withColumns({"transaction_amount": F.lit("7.25"), "transaction_amount_currency": F.lit("EUR"), "remittance_information": F.col("external_id")}).drop("amount")


def _stored(spark: SparkSession, sf_dir: str) -> tuple[store.Store, DataFrame]:
    """A store with all transactions, in two segments, and its rows."""
    held, rows = _store(spark), _canonical(spark, sf_dir)
    held.append("transactions", rows.where("id % 2 = 0"))
    held.append("transactions", rows.where("id % 2 = 1"))
    return held, held.read("transactions")


def _with_accounts(spark: SparkSession, sf_dir: str) -> store.Store:
    """A store with all accounts; none has a config."""
    held = _store(spark)
    rows = views.accounts(spark, sf_dir).select("id", "user_id", "institution_name", "number", F.lit("bank").alias("account_type"), F.lit("old").alias("name"), F.lit("EUR").alias("currency"), F.lit("active").alias("status"), F.lit("").alias("details"), F.concat(F.lit("s"), F.col("id").cast("string")).alias("source_id"))
    held.append("accounts", rows)
    return held


def _details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A bank's details of every account: every other one has a new name, all have their number."""
    rows = views.accounts(spark, sf_dir)
    fields = {"resourceId": F.concat(F.lit("n"), F.col("id").cast("string")), "displayName": F.when(F.col("id") % 2 == 0, F.concat(F.lit("N"), F.col("id").cast("string"))), "iban": F.when(F.col("id") % 3 == 0, F.col("number")), "bban": F.when(F.col("id") % 3 != 0, F.col("number"))}
    made = F.struct(*[(fields.get(f.name, F.lit(None)).cast(f.dataType)).alias(f.name) for f in schemas.WIRE_DETAILS.fields])
    return rows.select(F.col("id").alias("account_id"), "institution_name", "user_id", F.concat(F.lit("n"), F.col("id").cast("string")).alias("source_id"), made.alias("details"))


@query(f"SELECT {_TX} FROM transactions")
def tx_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows as a store gives them back."""
    return _stored(spark, sf_dir)[1].select(*_TX_COLUMNS[:7], "merchant_id").join(views.transactions(spark, sf_dir).select("id", "amount"), "id").select(*_TX_COLUMNS)


@query("SELECT id, name, concat(lower(name), '@x.example') AS email FROM users WHERE name = 'CHINA'")
def user_by_email(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = views.users(spark, sf_dir).withColumn("email", F.concat(F.lower("name"), F.lit("@x.example")))
    return lookup.user_by_email(users, "china@x.example")


@query("SELECT id, external_id FROM transactions WHERE id = 6 AND user_id = (SELECT user_id FROM transactions WHERE id = 6)")
def tx_by_id_and_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.transactions(spark, sf_dir)
    owner = lookup.require(rows, id=6)["user_id"]
    return lookup.transaction_of_user(rows, 6, owner).select("id", "external_id")


def _named_merchants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merchants with websites and external ids that two share."""
    pair = F.expr("CAST(id div 2 AS string)")
    return views.merchants(spark, sf_dir).select("id", F.concat(F.lit("m"), pair).alias("name"), F.concat(F.lit("w"), pair).alias("website"), F.concat(F.lit("e"), pair).alias("external_id"))


@query("SELECT min(id) AS id, 'm3' AS name FROM merchants WHERE id // 2 = 3")
def merchant_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.merchant_by_name(_named_merchants(spark, sf_dir), "m3", "w3").select("id", "name")


@query("SELECT min(id) AS id, 'e4' AS external_id FROM merchants WHERE id // 2 = 4")
def merchant_by_external_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.merchant_by_external_id(_named_merchants(spark, sf_dir), "e4").select("id", "external_id")


@query("SELECT id AS seq, CASE WHEN id % 3 = 0 THEN (SELECT min(m.id) FROM merchants m WHERE m.id // 2 = t.account_id % 50) END AS merchant_id FROM transactions t")
def merchant_resolve_older(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older rule, by external id alone: names and websites that are stored do not count."""
    key = (F.col("account_id") % 50).cast("string")
    wanted = views.transactions(spark, sf_dir).select(F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, F.concat(F.lit("e"), key)).alias("external_id"), F.concat(F.lit("m"), key).alias("name"), F.concat(F.lit("w"), key).alias("website"))
    return merchants.by_external_id(wanted, _named_merchants(spark, sf_dir))


_FUNCTIONS = "(SELECT id AS id, name, CASE WHEN id % 2 = 0 THEN 'budget' ELSE 'other' END AS function_type, id % 5 AS user_id FROM users) f"


def _functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.users(spark, sf_dir).select("id", "name", F.when(F.col("id") % 2 == 0, "budget").otherwise("other").alias("function_type"), F.lit("").alias("source"), (F.col("id") % 5).alias("user_id"))


@query(f"SELECT id, name, function_type, user_id FROM {_FUNCTIONS} WHERE user_id = 3")
def functions_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.functions_of_user(_functions(spark, sf_dir), 3).select("id", "name", "function_type", "user_id")


@query(f"SELECT id, name, function_type, user_id FROM {_FUNCTIONS} WHERE id = 4")
def function_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(_functions(spark, sf_dir), id=4).select("id", "name", "function_type", "user_id")


@query(f"SELECT id, CASE WHEN id = 2 THEN 'renamed' ELSE name END AS name FROM {_FUNCTIONS} WHERE id <> 3")
def functions_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A function deleted and another renamed."""
    held = _store(spark)
    held.append("functions", _functions(spark, sf_dir))
    held.delete("functions", spark.createDataFrame([(3,)], "id long"))
    held.patch("functions", spark.createDataFrame([(2, "renamed")], "id long, name string"))
    return held.read("functions").select("id", "name")


@query("SELECT id, user_id, event, CASE WHEN id = 2 THEN '[]' ELSE filter END AS filter FROM triggers WHERE id <> 4")
def triggers_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Triggers added in order, one deleted, one given another filter."""
    held = _store(spark)
    triggers.add_trigger(held, views.triggers(spark).drop("id"))
    held.delete("triggers", held.read("triggers").where("event = 'other'").select("id"))
    held.patch("triggers", held.read("triggers").where("filter = '[{\"Account\":[17,57]}]'").select("id", F.lit("[]").alias("filter")))
    return held.read("triggers").select("id", "user_id", "event", "filter")


@query("SELECT id, user_id, event, filter FROM triggers WHERE id = 2 AND user_id = 3")
def trigger_by_id_and_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookup.one(views.triggers(spark), id=2, user_id=3).select("id", "user_id", "event", "filter")


_IMPORT_SQL = "SELECT external_id, t.account_id, t.user_id, booking_date FROM transactions t JOIN accounts a ON a.id = t.account_id"


def _wire(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All transactions as a bank's answer, with seq."""
    rows = views.transactions(spark, sf_dir)
    fields = {"transactionId": F.col("external_id"), "bookingDate": F.col("booking_date"), "creditorName": F.col("creditor_name"), "debtorName": F.col("debtor_name"), "remittanceInformationUnstructured": F.col("external_id"), "transactionAmount": F.struct(F.lit("-7.25").alias("amount"), F.lit("EUR").alias("currency"))}
    return rows.select("account_id", F.col("id").alias("seq"), *[(fields[f.name] if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.WIRE_TRANSACTION.fields])


def _imported(spark: SparkSession, sf_dir: str) -> store.Store:
    held = _with_accounts(spark, sf_dir)
    ingest.import_batch(held, _wire(spark, sf_dir))
    return held


@query(_IMPORT_SQL)
def import_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An import of all rows, and the same again, which stores nothing."""
    held = _imported(spark, sf_dir)
    ingest.import_batch(held, _wire(spark, sf_dir))
    return held.read("transactions").select("external_id", "account_id", "user_id", "booking_date")


@query("SELECT 'unknown account' AS reason, external_id FROM transactions WHERE account_id % 10 = 7")
def import_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of accounts that a store lacks are set aside."""
    held = _store(spark)
    held.append("accounts", views.accounts(spark, sf_dir).where("id % 10 <> 7").select("id", "user_id", "institution_name", "number"))
    return ingest.import_batch(held, _wire(spark, sf_dir)).quarantine.select("reason", "external_id")


@query("SELECT row_number() OVER (ORDER BY booking_date, account_id, id) AS id, external_id FROM transactions")
def import_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of imported rows follow day, account and the order of the answer."""
    return _imported(spark, sf_dir).read("transactions").select("id", "external_id")


@query("SELECT external_id FROM transactions WHERE booking_date >= DATE '1998-01-01'")
def import_undelivered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a second import stored and no trigger was run for, as after a crash."""
    held, wire = _with_accounts(spark, sf_dir), _wire(spark, sf_dir)
    held.append("transactions", _canonical(spark, sf_dir).where("booking_date < date'1998-01-01'"))
    ingest.import_batch(held, wire.where("bookingDate >= date'1998-01-01'").withColumn("bookingDate", F.lit("1999-01-01").cast("date")))
    return ingest.undelivered(held).select("external_id")


@query("SELECT id, 'n' || CAST(id AS VARCHAR) AS source_id, '{\"account_id\":\"n' || CAST(id AS VARCHAR) || '\"}' AS config FROM accounts")
def accounts_relink(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts pointed at a new consent, matched by number, institution and user."""
    held = _with_accounts(spark, sf_dir)
    account_ops.relink(held, _details(spark, sf_dir))
    return held.read("accounts").select("id", "source_id", "config")


@query("SELECT id, CASE WHEN id % 2 = 0 THEN 'N' || CAST(id AS VARCHAR) ELSE 'old' END AS name, number, institution_name FROM accounts")
def accounts_populate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details filled in; what the bank does not say stays."""
    held = _with_accounts(spark, sf_dir)
    account_ops.populate_details(held, _details(spark, sf_dir).drop("source_id"))
    return held.read("accounts").select("id", "name", "number", "institution_name")


@query("SELECT row_number() OVER (ORDER BY user_id, 'n' || CAST(id AS VARCHAR)) AS id, number, user_id, 'bank' AS account_type, '{\"account_id\":\"n' || CAST(id AS VARCHAR) || '\"}' AS config FROM accounts")
def accounts_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All accounts of a consent stored with type and config."""
    held = _store(spark)
    account_ops.add_accounts(held, _details(spark, sf_dir), "bank")
    return held.read("accounts").select("id", "number", "user_id", "account_type", "config")


@query("SELECT id, CAST(CASE WHEN id % 5 <> 0 THEN id % 100 + 0.5 END AS FLOAT) AS balance FROM accounts")
def accounts_balances_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balances stored where they can be read, the others left alone."""
    held = _with_accounts(spark, sf_dir)
    text = F.when(F.col("id") % 5 == 0, F.lit("n/a")).otherwise(F.concat((F.col("id") % 100).cast("string"), F.lit(".5")))
    account_ops.refresh_balances(held, views.accounts(spark, sf_dir).select(F.col("id").alias("account_id"), F.array(F.struct(F.struct(text.alias("amount")).alias("balanceAmount"))).alias("balances")))
    return held.read("accounts").select("id", "balance")


_MERCHANT_OF = "'M' || CAST(account_id % 20 AS VARCHAR)"


def _enricher(rows: DataFrame) -> DataFrame:
    """Knows the rows with a creditor; twenty merchants by account."""
    name = F.concat(F.lit("M"), (F.col("account_id") % 20).cast("string"))
    fields = {"name": name, "website": F.lower(name)}
    made = F.struct(*[(fields[f.name] if f.name in fields else F.lit(None).cast(f.dataType)).alias(f.name) for f in schemas.NEW_MERCHANT.fields])
    return rows.where("creditor_name IS NOT NULL").select(F.col("id").alias("transaction_id"), made.alias("merchant"))


@query(f"SELECT t.id, CASE WHEN creditor_name IS NOT NULL THEN {_MERCHANT_OF} END AS name FROM transactions t")
def enrich_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows enriched in a store: merchants are inserted once and attached, rows that are not recognised stay."""
    held, rows = _store(spark), _canonical(spark, sf_dir).withColumn("merchant_id", F.lit(None).cast("long"))
    held.append("transactions", rows)
    merchants.enrich(held, held.read("transactions"), _enricher)
    return held.read("transactions").join(held.read("merchants").select(F.col("id").alias("merchant_id"), "name"), "merchant_id", "left").select("id", "name")


@query("SELECT DISTINCT 'M' || CAST(account_id % 20 AS VARCHAR) AS name FROM transactions WHERE creditor_name IS NOT NULL")
def merchants_inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = _store(spark)
    found = _enricher(views.transactions(spark, sf_dir))
    merchants.create_or_fetch(held, found.select(F.col("transaction_id").alias("seq"), "merchant.*"))
    return held.read("merchants").select("name")


@query(f"SELECT id, CASE WHEN creditor_name IS NOT NULL THEN {_MERCHANT_OF} END AS name FROM (SELECT * FROM transactions WHERE merchant_id IS NULL ORDER BY booking_date DESC, id DESC LIMIT 100) n")
def backfill_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One pass over the newest hundred rows without a merchant."""
    held = _stored(spark, sf_dir)[0]
    done = merchants.backfill(held, _enricher, 100).select("id", "merchant_id")
    return done.join(held.read("merchants").select(F.col("id").alias("merchant_id"), "name"), "merchant_id", "left").select("id", "name")


_CALLS_SQL = """SELECT g.id AS trigger_id, t.external_id, 'ok' AS status FROM triggers g JOIN transactions t ON g.user_id = t.user_id
WHERE g.event = 'transaction_created' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(from_json(g.filter, '[{"Account":["BIGINT"]}]')) AS p) z WHERE NOT list_contains(p.Account, t.account_id))"""


@query(_CALLS_SQL)
def dispatch_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log after all rows were dispatched twice to a sink that always succeeds: each call once."""
    held, rows = _stored(spark, sf_dir)
    held.append("triggers", views.triggers(spark))
    held.append("functions", spark.createDataFrame([(1, "f", "fine", "", 1)], "id long, name string, function_type string, source string, user_id long"))
    fine = lambda calls: calls.withColumns({"status": F.lit("ok"), "console": F.array().cast("array<string>")})
    for _ in range(2):
        triggers.dispatch(held, rows, sinks.registry(fine=fine))
    return held.read("trigger_log").select("trigger_id", F.get_json_object("payload", "$.external_id").alias("external_id"), "status")


@query(f"SELECT trigger_id, external_id FROM ({_CALLS_SQL}) c WHERE trigger_id IN (SELECT id FROM triggers WHERE user_id = 7)")
def trigger_log_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = triggers.matched(views.transactions(spark, sf_dir), views.triggers(spark))
    log = found.select("trigger_id", F.col("transaction.external_id").alias("external_id"), F.col("transaction.user_id").alias("user_id"))
    return lookup.log_of_user(log, 7).select("trigger_id", "external_id")


@query("SELECT id, CASE WHEN creditor_name = '1-URGENT' THEN CAST(11 AS BIGINT) WHEN creditor_name = '5-LOW' THEN CAST(12 AS BIGINT) END AS category_id FROM transactions")
def sink_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories chosen by name; of two with one name the smaller id, unknown names and rows without a choice none."""
    rows = views.transactions(spark, sf_dir)
    calls = rows.select("id", F.struct("external_id", "creditor_name").alias("transaction"), F.create_map(F.lit("category_key"), F.lit("k")).alias("settings"))
    categories = spark.createDataFrame([(11, "1-URGENT"), (13, "1-URGENT"), (12, "5-LOW")], "id long, name string")
    chooser = lambda c: c.select(F.col("transaction.external_id").alias("external_id"), F.col("transaction.creditor_name").alias("category"))
    return sinks.choosing_sink(lambda c: c, chooser, categories)(calls).select("id", "category_id")


@query("""SELECT id, '{"transactions":[{"asset_id":42,"date":"' || strftime(booking_date, '%Y-%m-%d') || '","amount":"7.25","currency":"eur","payee":"' || coalesce(creditor_name, debtor_name, '') || '","notes":"' || coalesce(debtor_name, '') || '","status":"cleared","external_id":"' || external_id || '"}],"apply_rules":true,"check_for_recurring":true,"debit_as_negative":true,"skip_balance_update":false}' AS body FROM transactions""")
def sink_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole body that is posted for each row."""
    rows = views.transactions(spark, sf_dir).withColumns({"remittance_information": F.col("debtor_name"), "transaction_amount": F.lit("7.25"), "transaction_amount_currency": F.lit("EUR")})
    calls = rows.select("id", F.struct(*rows.columns).alias("transaction"), F.create_map(F.lit("account_id"), F.lit("42")).alias("settings"))
    return calls.select("id", F.to_json(sinks.request_body(calls)).alias("body"))


@query("SELECT id, '7.25EUR' AS amount, 'EUR -> USD ' || CAST(id AS VARCHAR) AS exchange, '7.25' AS amount_text, CASE id % 2 WHEN 0 THEN 'AD' ELSE 'CH' END AS country FROM transactions")
def amount_and_exchange_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.when(F.col("id") % 2 == 0, "EUR").otherwise("CHF")
    rows = views.transactions(spark, sf_dir).withColumns({"remittance_information": F.lit(""), "transaction_amount": F.lit("7.25"), "transaction_amount_currency": code})
    asked = enrichment.requests(rows).select(F.col("transaction_id").alias("id"), "amount_text", "country")
    shown = rows.select("id", scalars.amount_text(F.col("transaction_amount"), F.lit("EUR")).alias("amount"), scalars.exchange_text(F.col("id").cast("string"), F.lit("EUR"), F.lit("USD")).alias("exchange"))
    return shown.join(asked, "id").select("id", "amount", "exchange", "amount_text", "country")


@query("SELECT id, CAST(booking_date AS TIMESTAMP) + INTERVAL 90 MINUTE AS at FROM transactions")
def naive_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times with a zone as UTC without one."""
    at = F.to_timestamp(F.concat(F.date_format("booking_date", "yyyy-MM-dd"), F.lit("T03:30:00+02:00")))
    return views.transactions(spark, sf_dir).select("id", scalars.naive_utc(at).alias("at"))


# Streams


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as a stream of transactions: all files there are, in one micro-batch or more."""
    schema = views.table(spark, sf_dir, "orders").schema
    orders = spark.readStream.schema(schema).option("pathGlobFilter", "orders.parquet").parquet(sf_dir)
    return orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("account_id"), F.col("o_orderdate").cast("date").alias("booking_date"))


def _ran(stream: DataFrame, mode: str) -> DataFrame:
    """What ``stream`` gives until all input is read, each micro-batch written to the shared folder."""
    root = f"{lineage.folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/out/batch={batch_id}")

    stream.writeStream.outputMode(mode).foreachBatch(keep).option("checkpointLocation", f"{root}/check").trigger(availableNow=True).start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{root}/out")


@query("SELECT account_id, max(booking_date) AS newest FROM transactions GROUP BY account_id")
def stream_newest_by_account(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest day of each account, kept as the state of a stream."""
    found = _ran(imports.newest_by_account(_streamed(spark, sf_dir).select("account_id", "booking_date")), "update")
    return found.groupBy("account_id").agg(F.max_by("newest", "batch").alias("newest"))


@query("""SELECT g.id AS trigger_id, t.id AS transaction_id FROM triggers g JOIN (SELECT id, account_id, account_id % 25 AS user_id FROM transactions) t ON g.user_id = t.user_id
WHERE g.event = 'transaction_created' AND NOT EXISTS (SELECT 1 FROM (SELECT unnest(from_json(g.filter, '[{"Account":["BIGINT"]}]')) AS p) z WHERE NOT list_contains(p.Account, t.account_id))""")
def stream_trigger_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of transactions against the static trigger table."""
    rows = _streamed(spark, sf_dir).withColumn("user_id", F.col("account_id") % 25)
    found = _ran(imports.matched_stream(rows, views.triggers(spark)).select("trigger_id", F.col("transaction.id").alias("transaction_id")), "append")
    return found.drop("batch")


@query("SELECT external_id, account_id FROM transactions")
def stream_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rows imported micro-batch by micro-batch, each of them twice."""
    held, wire = _with_accounts(spark, sf_dir), _wire(spark, sf_dir)
    run = imports.importer(held)
    for batch_id, part in enumerate((wire.where("bookingDate < date'1996-01-01'"), wire.where("bookingDate < date'1996-01-01'"), wire, wire)):
        run(part, batch_id)
    return held.read("transactions").select("external_id", "account_id")
