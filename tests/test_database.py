"""Rows of another store, without a database: ranges and conversion."""

from __future__ import annotations

from coffer.operators.store import Store
from coffer.sources import database


def test_ranges_cover_each_id_once():
    for low, high, rows in ((1, 10, 3), (5, 5, 3), (1, 9, 9), (-4, 4, 2)):
        hit = []
        for p in database.id_ranges(low, high, rows):
            a, b = p.removeprefix("id >= ").split(" AND id < ")
            hit += range(int(a), int(b))
        assert hit == list(range(low, high + 1))
    assert database.id_ranges(None, None) == ["1 = 1"]


def test_rows_conform(spark, tmp_path):
    rows = spark.createDataFrame([(1, "Shop", "food, drink,", "src1"), (2, "Other", None, None)], "id int, name string, labels string, ext string")
    out = database.conformed(rows, "merchants", {"ext": "external_id"})
    store = Store(spark, str(tmp_path))
    store.append("merchants", out)
    got = {r["id"]: (r["name"], r["labels"], r["external_id"], r["website"]) for r in store.read("merchants").collect()}
    assert got == {1: ("Shop", ["food", "drink"], "src1", None), 2: ("Other", None, None, None)}
    rates = spark.createDataFrame([("USD", '{"EUR":0.9}')], "base_code string, conversion_rates string")
    assert database.conformed(rates, "exchange_rates").first()["conversion_rates"] == {"EUR": 0.9}
