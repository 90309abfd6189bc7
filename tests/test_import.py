"""Import, enrichment, triggers and sinks over a store, in batch and as a stream."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from coffer.operators import accounts, ingest, merchants, rates, triggers
from coffer.operators.store import Store
from coffer.sources import bank, enrichment, sinks
from coffer.streaming import imports


def booked(day: str | None, amount: str | None, text: str | None = None, id: str | None = None, **more) -> dict:
    row = {"bookingDate": day, "remittanceInformationUnstructured": text, "transactionId": id, **more}
    return {k: v for k, v in (row | ({"transactionAmount": {"amount": amount, "currency": "EUR"}} if amount else {})).items() if v is not None}


def land(folder, account_id: int, rows: list[dict], tag: str = "") -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{tag}{account_id}.json").write_text(json.dumps({"transactions": {"booked": rows, "pending": [{"transactionId": "p"}]}}))


@pytest.fixture
def store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    rows = [(i, f"acc{i}", "bank", "EUR", 10 + i % 2, "{}" if i != 3 else None) for i in (1, 2, 3)]
    store.append("accounts", spark.createDataFrame(rows, "id long, name string, account_type string, currency string, user_id long, config string").withColumns({"status": F.lit("active"), "details": F.lit(""), "institution_name": F.lit("B"), "source_id": F.col("name")}))
    return store


def test_import_is_incremental_and_repeats_do_nothing(spark, store, tmp_path):
    land(tmp_path / "one", 1, [booked("2024-03-10", "-1.00", "A", "x1"), booked("2024-03-09", "-2.00", "B"), booked("2024-03-09", "-2.00", "B"), booked(None, "1", "no date"), booked("2024-03-09", None, "no amount")])
    land(tmp_path / "one", 2, [booked("2023-01-01", "5", "old", "x1")])
    wire = bank.read_transactions(spark, str(tmp_path / "one"))
    done = ingest.import_batch(store, wire)
    assert done.rows.count() == 3  # the twin of B is one row, and x1 is one for each account
    assert sorted(r["reason"] for r in done.quarantine.collect()) == ["no amount", "no booking date"]
    assert {tuple(r) for r in done.status.collect()} == {(1, "ok", 2), (2, "ok", 1), (3, "no source", 0)}
    assert ingest.import_batch(store, wire).rows.count() == 0
    land(tmp_path / "two", 1, [booked("2024-03-02", "-9", "too old", "x7"), booked("2024-03-03", "-9", "just in", "x8")])
    later = ingest.import_batch(store, bank.read_transactions(spark, str(tmp_path / "two"))).rows.collect()
    assert [r["external_id"] for r in later] == ["x8"] and later[0]["user_id"] == 11
    ids = [r["id"] for r in store.read("transactions").orderBy("id").collect()]
    assert ids == [1, 2, 3, 4]


def test_fetch_isolates_failures(spark, store):
    held = store.read("accounts").withColumn("config", F.when(F.col("id") == 2, F.lit('{"broken": "yes"}')).otherwise(F.col("config"))).where("config IS NOT NULL")
    start = spark.createDataFrame([(1, dt.date(2024, 3, 2)), (2, None)], "account_id long, from_date date")
    wire, errors = bank.fetch(spark, held, start, "stubs:Bank")
    assert [(r["account_id"], r["remittanceInformationUnstructured"]) for r in wire.collect()] == [(1, "RENT")]
    assert [tuple(r) for r in errors.collect()] == [(2, "ConnectionError: no answer")]
    status = {r["account_id"]: r["status"] for r in ingest.import_batch(store, wire, errors).status.collect()}
    assert status[1] == "ok" and status[2].startswith("failed") and status[3] == "no source"


def import_two(spark, store, tmp_path):
    land(tmp_path / "in", 1, [booked("2024-03-10", "-4.50", "x", "t1", creditorName="Cafe"), booked("2024-03-11", "-1", "boom", "t2", creditorName="Cafe"), booked("2024-03-12", "7", "pay", "t3", debtorName="Refused")])
    return ingest.import_batch(store, bank.read_transactions(spark, str(tmp_path / "in"))).rows


def test_enrichment_keeps_unmatched_rows(spark, store, tmp_path):
    rows = import_two(spark, store, tmp_path)
    out = {r["external_id"]: r["merchant_id"] for r in merchants.enrich(store, rows, enrichment.client_enricher("stubs:Enrichment")).collect()}
    assert out == {"t1": 1, "t2": None, "t3": None}
    kept = {r["external_id"]: r["merchant_id"] for r in store.read("transactions").collect()}
    assert kept == out
    stored = store.read("merchants").first()
    assert (stored["name"], stored["external_id"], stored["location_structured"]) == ("Cafe Uno", "m-1", "null")
    again = merchants.backfill(store, enrichment.client_enricher("stubs:Enrichment"))
    assert again.count() == 2 and store.read("merchants").count() == 1


def add_triggers(spark, store):
    store.append("functions", spark.createDataFrame([(1, "f", "budget", "", 11), (2, "g", "gone", "", 11)], "id long, name string, function_type string, source string, user_id long"))
    params = json.dumps({"api_key": "k", "account_id": "42"})
    rows = [("transaction_created", "all", "[]", params, 11, 1), ("transaction_created", "none", '[{"Account":[2]}]', params, 11, 1), ("other", "event", "[]", params, 11, 1), ("transaction_created", "unknown", '[{"Account":[1]}]', "{}", 11, 2)]
    triggers.add_trigger(store, spark.createDataFrame(rows, "event string, name string, filter string, params string, user_id long, function_id long"))


def test_dispatch_logs_each_call_once(spark, store, tmp_path):
    rows = import_two(spark, store, tmp_path)
    add_triggers(spark, store)
    how = sinks.registry(budget=sinks.client_sink("stubs:Budget"))
    log = [(json.loads(r["payload"])["external_id"], r["status"], r["console"]) for r in triggers.dispatch(store, rows, how).collect()]
    assert sorted(log) == sorted([("t1", "ok", "[]"), ("t2", "ok", "[]"), ("t3", "failed", '["refused"]')] + [(t, "failed", '["no sink for gone"]') for t in ("t1", "t2", "t3")])
    second = [json.loads(r["payload"])["external_id"] for r in triggers.dispatch(store, rows, how).where("status = 'ok'").collect()]
    assert second == []  # what was done is not done again


def test_bad_triggers_are_rejected(spark, store):
    row = lambda f, p: spark.createDataFrame([("transaction_created", "n", f, p, 1, 1)], "event string, name string, filter string, params string, user_id long, function_id long")
    for f, p in (('[{"Other":[1]}]', "{}"), ("bad", "{}"), ("[]", '"{}"')):
        with pytest.raises(triggers.InvalidTrigger):
            triggers.add_trigger(store, row(f, p))


def test_manual_run_covers_all_named_accounts(spark):
    rows = spark.createDataFrame([(i, 1 + i % 3, 11, dt.date(2024, 1, 1 + i)) for i in range(9)], "id long, account_id long, user_id long, booking_date date")
    trigger = lambda f: spark.createDataFrame([(5, "other", "n", f, "{}", 11, 1)], "id long, event string, name string, filter string, params string, user_id long, function_id long")
    got = triggers.manual_run(rows, trigger('[{"Account":[1,2]}]'), 2).select("transaction.id").collect()
    assert sorted(r[0] for r in got) == [3, 4, 6, 7]
    assert triggers.manual_run(rows, trigger("[]"), 2).count() == 0


def test_the_whole_body_that_is_posted(spark):
    t = F.struct(F.lit(dt.date(2024, 1, 2)).alias("booking_date"), F.lit("3.10").alias("transaction_amount"), F.lit("EUR").alias("transaction_amount_currency"), F.lit("C").alias("creditor_name"), F.lit("D").alias("debtor_name"), F.lit("n").alias("remittance_information"), F.lit("e").alias("external_id"))
    calls = spark.range(1).select(F.create_map(F.lit("account_id"), F.lit("7")).alias("settings"), t.alias("transaction"), F.lit(5).cast("long").alias("category_id"))
    body = json.loads(calls.select(F.to_json(sinks.request_body(calls))).first()[0])
    row = {"category_id": 5, "asset_id": 7, "date": "2024-01-02", "amount": "3.10", "currency": "eur", "payee": "C", "notes": "n", "status": "cleared", "external_id": "e"}
    assert body == {"transactions": [row], "apply_rules": True, "check_for_recurring": True, "debit_as_negative": True, "skip_balance_update": False}


def test_a_chooser_picks_categories_where_a_key_is_set(spark):
    t = lambda i: F.struct(F.lit(f"e{i}").alias("external_id"), F.lit(f"C{i}").alias("creditor_name"))
    keyed = F.create_map(F.lit("category_key"), F.lit("k"))
    calls = spark.range(4).select("id", F.when(F.col("id") < 3, keyed).otherwise(F.create_map(F.lit("x"), F.lit("y"))).alias("settings"), F.when(F.col("id") == 0, t(0)).when(F.col("id") == 1, t(1)).when(F.col("id") == 2, t(2)).otherwise(t(3)).alias("transaction"))
    categories = spark.createDataFrame([(9, "food"), (4, "food"), (5, "rent")], "id long, name string")
    run = sinks.choosing_sink(lambda c: c, sinks.client_chooser("stubs:Categories", ["food", "rent"]), categories)
    assert {r["id"]: r["category_id"] for r in run(calls).select("id", "category_id").collect()} == {0: 4, 1: 5, 2: None, 3: None}


def test_triggers_of_an_interrupted_import_run_later(spark, store, tmp_path):
    """Rows are stored, and then the process dies before the triggers: the next import runs them, and nothing twice."""
    import_two(spark, store, tmp_path)
    add_triggers(spark, store)
    run = imports.importer(store, sinks=sinks.registry(budget=sinks.client_sink("stubs:Budget")))
    wire = bank.read_transactions(spark, str(tmp_path / "in"))
    run(wire, 1)
    done = lambda: sorted(json.loads(r["payload"])["external_id"] for r in store.read("trigger_log").where("status = 'ok'").collect())
    assert done() == ["t1", "t2"]
    run(wire, 2)
    assert done() == ["t1", "t2"] and ingest.undelivered(store).count() == 0


def test_what_was_stored_before_deliveries_is_not_run(spark, store):
    store.append("transactions", spark.createDataFrame([(3, "old", 1, 11, "2024-01-01")], "id long, external_id string, account_id long, user_id long, booking_date string"))
    ingest.start_deliveries(store, store.version("transactions"))
    assert ingest.undelivered(store).count() == 0


def test_rows_of_unknown_accounts_are_set_aside(spark, store, tmp_path):
    land(tmp_path / "in", 99, [booked("2024-03-10", "-1.00", "A", "x1")])
    done = ingest.import_batch(store, bank.read_transactions(spark, str(tmp_path / "in")))
    assert done.rows.count() == 0 and [r["reason"] for r in done.quarantine.collect()] == ["unknown account"]


def test_file_names_mean_the_same_in_batch_and_stream(spark, store, tmp_path):
    land(tmp_path / "in", 1, [booked("2024-03-10", "-1.00", "A", "x1")])
    (tmp_path / "in" / "1.json").rename(tmp_path / "in" / "1_2026-01.json")
    assert [r["account_id"] for r in bank.read_transactions(spark, str(tmp_path / "in")).collect()] == [1]
    imports.start(spark, store, str(tmp_path / "in"), str(tmp_path / "check")).awaitTermination()
    assert [r["account_id"] for r in store.read("transactions").collect()] == [1]


def test_clients_for_details_balances_institutions_and_rates(spark):
    held = spark.createDataFrame([(1, "{}"), (2, '{"broken": "1"}')], "id long, config string")
    for fetch, want in ((bank.fetch_details, "DE1"), (bank.fetch_balances, "5.5")):
        good, bad = fetch(held, "stubs:Bank")
        assert want in str(good.collect()) and [r["account_id"] for r in good.collect()] == [1]
        assert [(r["account_id"], r["error"]) for r in bad.collect()] == [(2, "ConnectionError: no answer")]
    keys = lambda *k: spark.createDataFrame([(x, "{}") for x in k], "key string, config string")
    assert sorted(r["id"] for r in bank.fetch_institutions(keys("DE", "FR"), "stubs:Bank")[0].collect()) == ["b-DE", "b-FR", "both"]
    assert [(r["base_code"], r["conversion_rates"]) for r in bank.fetch_rates(keys("USD"), "stubs:Bank")[0].collect()] == [("USD", {"EUR": 0.9})]


def test_fetch_up_to_a_date(spark):
    held = spark.createDataFrame([(1, None)], "id long, config string")
    start = spark.createDataFrame([(1, None)], "account_id long, from_date date")
    wire, errors = bank.fetch(spark, held, start, "stubs:Bank", date_to="2024-03-01")
    assert [r["transactionId"] for r in wire.collect()] == ["a1"] and errors.count() == 0
    listed = json.dumps([{"account_id": 1, "date_to": "2024-03-01"}])
    spark.dataSource.register(bank.BankSource)
    assert spark.read.format("coffer-bank").option("client", "stubs:Bank").option("accounts", listed).load().count() == 1


def test_requests_have_country_and_both_amounts(spark):
    rows = spark.createDataFrame([(1, "-1234567.89", "CHF"), (2, "x", "XXQ")], "id long, transaction_amount string, transaction_amount_currency string")
    rows = rows.withColumns({"creditor_name": F.lit("C"), "debtor_name": F.lit(None).cast("string"), "remittance_information": F.lit("r"), "booking_date": F.lit("2024-01-02").cast("date"), "user_id": F.lit(1)})
    got = {r["transaction_id"]: (r["amount_text"], r["amount"], r["country"]) for r in enrichment.requests(rows).collect()}
    assert got == {1: ("-1234567.89", 1234567.89, "CH"), 2: ("x", 0.0, "")}


def test_landing_sink(spark, tmp_path):
    t = F.struct(F.lit(dt.date(2024, 1, 2)).alias("booking_date"), F.lit("3").alias("transaction_amount"), F.lit("EUR").alias("transaction_amount_currency"), F.lit(None).cast("string").alias("creditor_name"), F.lit("D").alias("debtor_name"), F.lit(None).cast("string").alias("remittance_information"), F.lit("e").alias("external_id"))
    calls = spark.range(2).select(F.when(F.col("id") == 0, F.create_map(F.lit("api_key"), F.lit("k"), F.lit("account_id"), F.lit("7"))).otherwise(F.create_map(F.lit("api_key"), F.lit("k"))).alias("settings"), t.alias("transaction"))
    got = [r["status"] for r in sinks.landing_sink(str(tmp_path / "out"))(calls).collect()]
    assert sorted(got) == ["failed", "ok"]
    row = json.loads(spark.read.text(str(tmp_path / "out")).first()[0])
    assert row == {"asset_id": 7, "date": "2024-01-02", "amount": "3", "currency": "eur", "payee": "D", "notes": "", "status": "cleared", "external_id": "e"}
    chosen = sinks.with_category(calls, spark.createDataFrame([("e", "Food")], "external_id string, category string"), spark.createDataFrame([(9, "Food"), (4, "Food")], "id long, name string"))
    assert {r["category_id"] for r in chosen.collect()} == {4}


def test_balances_details_and_relink(spark, store):
    one = lambda a: [{"balanceAmount": {"amount": a, "currency": "EUR"}}]
    answers = spark.createDataFrame([(1, one("12.5")), (2, []), (3, one("n/a"))], "account_id long, balances array<struct<balanceAmount:struct<amount:string,currency:string>>>")
    bad = {tuple(r) for r in accounts.refresh_balances(store, answers).collect()}
    assert bad == {(2, "no balance"), (3, "not a number: n/a")}
    assert {r["id"]: r["balance"] for r in store.read("accounts").collect()} == {1: 12.5, 2: None, 3: None}
    details = "account_id long, institution_name string, source_id string, user_id long, details struct<displayName:string,iban:string,bban:string,bic:string,pan:string,maskedPan:string,currency:string,product:string,cashAccountType:string,ownerName:string,status:string,details:string>"
    d = {"iban": "DE1", "currency": "EUR", "ownerName": "O"}
    accounts.populate_details(store, spark.createDataFrame([(1, "B", "acc1", 11, d)], details))
    row = store.read("accounts").where("id = 1").first()
    assert (row["number"], row["owner_name"], row["name"], row["balance"]) == ("DE1", "O", "O", 12.5)
    left = accounts.relink(store, spark.createDataFrame([(None, "B", "new1", 11, d), (None, "B", "new9", 99, d)], details)).collect()
    assert [r["source_id"] for r in left] == ["new9"]
    assert store.read("accounts").where("id = 1").first()["source_id"] == "new1"
    added = accounts.add_accounts(store, spark.createDataFrame([(None, "C", "s4", 12, d)], details), "bank").first()
    assert added["id"] == 4 and added["account_type"] == "bank" and json.loads(added["config"]) == {"account_id": "s4"}
    good, rest = accounts.with_source(store.read("accounts"), bank.KNOWN_SOURCES)
    assert {r["id"] for r in good.collect()} == {1, 2, 4} and {r["id"] for r in rest.collect()} == {3}


def test_rates_refresh(spark, store):
    for rate in (0.9, 0.8):
        rates.refresh(store, spark.createDataFrame([("USD", {"EUR": rate, "XXQ": 1.0})], "base_code string, conversion_rates map<string,double>"))
    assert [r["conversion_rates"] for r in store.read("exchange_rates").collect()] == [{"EUR": 0.8}]


def test_brand_lookup_offline(spark):
    rows = spark.createDataFrame([("Example Merchant", "https://apple.com", None, None), ("Solo", None, "l", "e")], "name string, website string, logo_url string, external_id string")
    brands = spark.createDataFrame([("apple.com", [("b1", "Apple", "icon")])], "query string, hits array<struct<brandId:string,name:string,icon:string>>")
    got = {r["name"]: (r["website"], r["logo_url"], r["external_id"]) for r in enrichment.with_brand(rows, brands).collect()}
    assert got == {"Apple": ("https://apple.com", "icon", "b1"), "Solo": (None, "l", "e")}


def test_enrichment_answers(spark):
    rows = spark.createDataFrame([("Shop", "m1", None, "i", ("L1", "C", None, "123", "CH")), ("No place", None, "w", None, None)], "merchant string, merchant_id string, website string, icon string, address struct<line1:string,city:string,state:string,postalCode:string,country:string>")
    got = [r["m"] for r in rows.select(enrichment.from_place(F.struct(*rows.columns)).alias("m")).collect()]
    assert got[0]["location"] == "L1, C, , 123, CH" and got[0]["location_structured"]["postcode"] == "123"
    assert got[1]["location"] is None and got[1]["location_structured"] is None and got[1]["website"] == "w"
    labels = spark.createDataFrame([(None, "x"), ("M", "x")], "merchant string, merchant_id string").withColumns({"website": F.lit(None).cast("string"), "logo": F.lit("l"), "location": F.lit("here"), "labels": F.array(F.lit("a"), F.lit("b"))})
    made = [r["m"] for r in labels.select(enrichment.from_labels(F.struct(*labels.columns)).alias("m")).collect()]
    assert made[0] is None and made[1]["labels"] == ["a", "b"]


def test_stream_imports_what_landed(spark, store, tmp_path):
    land(tmp_path / "landing", 1, [booked("2024-03-10", "-1.00", "A", "x1")])
    for _ in range(2):
        imports.start(spark, store, str(tmp_path / "landing"), str(tmp_path / "check")).awaitTermination()
    assert [r["external_id"] for r in store.read("transactions").collect()] == ["x1"]
    land(tmp_path / "landing", 1, [booked("2024-03-10", "-1.00", "A", "x1"), booked("2024-03-11", "-1.00", "B", "x2")], tag="b-")
    land(tmp_path / "landing", 2, [booked("2020-01-01", "-1.00", "quiet", "y1")])
    imports.start(spark, store, str(tmp_path / "landing"), str(tmp_path / "check")).awaitTermination()
    assert sorted(r["external_id"] for r in store.read("transactions").collect()) == ["x1", "x2", "y1"]


def stream_of(spark, folder, rows: list[tuple], schema: str):
    """A file stream over batches that tests write one by one."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).parquet(str(folder))


def test_state_keeps_the_newest_date_of_quiet_accounts(spark, tmp_path):
    schema = "account_id long, booking_date date"
    day = lambda n: dt.date(2024, 1, n)
    rows = stream_of(spark, tmp_path / "in", [(1, day(5)), (2, day(1)), (1, day(3))], schema)
    query = imports.newest_by_account(rows).writeStream.outputMode("update").format("memory").queryName("newest").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
        spark.createDataFrame([(1, day(9)), (3, None), (1, day(2))], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        query.processAllAvailable()
    finally:
        query.stop()
    seen = [(r["account_id"], r["newest"]) for r in spark.table("newest").collect()]
    assert sorted(seen) == [(1, day(5)), (1, day(9)), (2, day(1))]


def test_stream_joins_the_trigger_table(spark, tmp_path):
    rows = stream_of(spark, tmp_path / "in", [(1, 7, 11), (2, 8, 11), (3, 7, 12)], "id long, account_id long, user_id long")
    table = spark.createDataFrame([(5, "transaction_created", "n", '[{"Account":[7]}]', "{}", 11, 1)], "id long, event string, name string, filter string, params string, user_id long, function_id long")
    query = imports.matched_stream(rows, table).writeStream.format("memory").queryName("matched").option("checkpointLocation", str(tmp_path / "c")).start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    assert [(r["trigger_id"], r["transaction"]["id"]) for r in spark.table("matched").collect()] == [(5, 1)]
