"""Scalar expressions, against values worked out by hand."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from coffer.functions import currency, scalars
from coffer.operators import ingest, rates, search

D = dt.date


def values(spark, schema: str, rows: list[tuple], *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_content_id(spark):
    rows = [
        (None, D(2024, 2, 20), "1", "EUR", "COFFEE"),
        (None, D(2024, 2, 20), "1", "EUR", None),
        (None, D(2024, 2, 21), "-4.50", "EUR", "COFFEE"),
        (None, D(2024, 2, 21), None, None, None),
        (None, None, "1", "EUR", "RENT"),
        ("given", D(2024, 2, 21), "1", "EUR", "X"),
    ]
    c = [F.col(x) for x in "gdacr"]
    got = [v[0] for v in values(spark, "g string, d date, a string, c string, r string", rows, scalars.content_id(*c))]
    assert got == [
        "d0476edddfc3dcff9afab129e61a343f7a0c8706235b1535ddaae3f21a09027e",
        "f97abf2ed03e1f5b1ff75ef29a01bc1e875ae15294e1b6e92cc1b397ef43ebb3",
        "20df6e51fd66c7a2807511b7c596990c1feb89effd17a57dfaf9fd4380e87b2f",
        "b75b554c4e7d9ba1b97a5df2c7bf7c4862d09fd40c88b4cbdd99b91176887d2c",
        "012ee8b60d4c50624e9d0663a630cf82ed109217f6023a4365e0d933e9fdf27a",
        "given",
    ]


def test_amounts_and_direction(spark):
    rows = [("-0",), ("0",), ("abc",), ("-1.5",), (" 1.5 ",), ("1f",), (None,), ("2e3",)]
    a = scalars.amount_or_zero(F.col("t"))
    got = values(spark, "t string", rows, a, scalars.direction(a), scalars.parse_number(F.col("t"), "double"))
    assert [g[0] for g in got] == [0, 0, 0, -1.5, 0, 0, 0, 2000]
    assert [g[1] for g in got] == ["incoming"] * 3 + ["outgoing"] + ["incoming"] * 4
    assert [g[2] for g in got] == [0, 0, None, -1.5, None, None, None, 2000]


def test_texts_keep_their_blanks(spark):
    rows = [(None, "D", "R"), (None, None, None)]
    c, d, r = F.col("c"), F.col("d"), F.col("r")
    assert values(spark, "c string, d string, r string", rows, scalars.description(c, d, r), scalars.payee(c, d)) == [(" D R", "D"), ("  ", "")]
    assert values(spark, "c string, d string, r string", rows[:1], scalars.exchange_text(F.lit("1.1"), F.lit("EUR"), c), scalars.amount_text(F.lit("5"), F.lit("EUR"))) == [("EUR ->  1.1", "5EUR")]


def test_numbers_of_accounts(spark):
    rows = [((None, "B", "M"),), ((None, None, None),)]
    assert values(spark, "a struct<iban:string,bban:string,maskedPan:string>", rows, scalars.party_text(F.col("a"))) == [("B",), ("",)]
    details = [((None, None, "BIC", "PAN", None),)]
    assert values(spark, "d struct<iban:string,bban:string,bic:string,pan:string,maskedPan:string>", details, scalars.account_number(F.col("d"))) == [("BIC",)]


def test_json_columns(spark):
    rows = [("null",), ("bad",), ('{"city":"X","latitude":"abc"}',), ('{"city":"X","latitude":1.5}',), ("[]",), (None,)]
    got = values(spark, "j string", rows, scalars.parse_location(F.col("j")), scalars.parse_console(F.col("j")))
    assert [g[0] and (g[0]["city"], g[0]["latitude"]) for g in got] == [None, None, None, ("X", 1.5), None, None]
    assert all(g[1] == [] for g in got[:2]) and got[5][1] == []
    assert values(spark, "j string", [('["a","b"]',)], scalars.parse_console(F.col("j"))) == [(["a", "b"],)]
    assert values(spark, "j string", [('{"k":"v"}',), ('"{\\"k\\":\\"v\\"}"',)], scalars.parse_params(F.col("j"))) == [({"k": "v"},), (None,)]


def test_trigger_filters(spark):
    rows = [("[]",), ('[{"Account":[1,2]}]',), ('[{"Account":[1,2]},{"Account":[2,3]}]',), ('[{"Account":[]}]',), ('[{"Other":[1]}]',), ("bad",)]
    f = scalars.parse_filter(F.col("f"))
    got = values(spark, "f string", rows, scalars.filter_is_known(F.col("f")), scalars.filter_matches(f, F.lit(1)), scalars.filter_matches(f, F.lit(3)))
    assert got[:4] == [(True, True, True), (True, True, False), (True, False, False), (True, False, False)]
    assert [g[0] for g in got[4:]] == [False, False]


def test_hosts(spark):
    rows = [("https://apple.com/x", "Apple"), ("apple.com", "Apple"), (None, "Apple")]
    assert [v[0] for v in values(spark, "u string, n string", rows, scalars.host_or_name(F.col("u"), F.col("n")))] == ["apple.com", "Apple", "Apple"]


def test_currencies(spark):
    c = F.col("c")
    got = values(spark, "c string", [("EUR",), ("XXQ",), (None,)], currency.strict_currency(c), currency.currency_or_usd(c), currency.first_country(c))
    assert got == [("EUR", "EUR", "AD"), (None, "USD", None), (None, None, None)]
    rows = spark.createDataFrame([("USD", {"EUR": 0.9, "XXQ": 1.2}), ("ZZZ", {"EUR": 1.0})], "base_code string, conversion_rates map<string,double>")
    assert [tuple(r)[:3] for r in rates.listed(rates.known_rates(rows)).collect()] == [("USD", "EUR", 0.9)]


def test_like_patterns(spark):
    texts = [("50% off",), ("a\\b",), ("x_y",), ("xzy",), (None,)]
    df = spark.createDataFrame(texts, "creditor_name string")
    hits = lambda term: [r[0] for r in df.where(search.mentions(df, term)).collect()]
    assert hits("0% O") == ["50% off"]
    assert hits("\\") == ["a\\b"]
    assert hits("x_y") == ["x_y", "xzy"]
    assert hits("x\\_y") == ["x_y"]
    accents = spark.createDataFrame([("Café",)], "creditor_name string")
    assert accents.where(search.mentions_plain(accents, "cafe")).count() == 1


def test_page_zero_is_rejected(spark):
    df = spark.createDataFrame([], "id long")
    with pytest.raises(ValueError):
        search.search_page(df, df, 1, "x", page=0)


def test_lookback(spark):
    accounts = spark.createDataFrame([(1,), (2,)], "id long")
    rows = spark.createDataFrame([(1, D(2024, 3, 3)), (1, D(2024, 1, 1))], "account_id long, booking_date date")
    assert {tuple(r) for r in ingest.lookback(accounts, rows).collect()} == {(1, D(2024, 2, 25)), (2, None)}
