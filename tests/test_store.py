"""Stored tables: versions, changes, conflicts."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from coffer import schemas
from coffer.operators import lookup, ranking
from coffer.operators.store import Conflict, Store, shown


@pytest.fixture
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


def add_users(spark, store, *names: str):
    rows = spark.createDataFrame([(n, f"{n}@example.com") for n in names], "name string, email string")
    return store.insert("users", rows, [F.col("name")])


def test_ids_versions_and_segments(spark, store):
    assert store.read("users").count() == 0 and store.version("users") == 0
    add_users(spark, store, "b", "a")
    add_users(spark, store, "c")
    assert [tuple(r) for r in store.read("users").orderBy("id").select("id", "name").collect()] == [(1, "a"), (2, "b"), (3, "c")]
    assert store.version("users") == 2 and len(store.segments("users")) == 2
    assert store.read("users", 1).count() == 2
    store.compact("users")
    assert len(store.segments("users")) == 1 and store.read("users").count() == 3


def test_only_touched_segments_are_rewritten(spark, store):
    add_users(spark, store, "a", "b")
    add_users(spark, store, "c")
    first, second = store.segments("users")
    store.delete("users", spark.createDataFrame([(3,)], "id long"))
    assert first in store.segments("users") and second not in store.segments("users")
    assert {r["name"] for r in store.read("users").collect()} == {"a", "b"}


def test_patch_never_erases(spark, store):
    add_users(spark, store, "a", "b")
    store.patch("users", spark.createDataFrame([(1, None, "new@example.com"), (9, "ghost", None)], "id long, name string, email string"))
    got = {r["id"]: (r["name"], r["email"]) for r in store.read("users").collect()}
    assert got == {1: ("a", "new@example.com"), 2: ("b", "b@example.com")}


def test_upsert(spark, store):
    add_users(spark, store, "a")
    rows = store.read("users").withColumn("name", F.lit("z")).unionByName(spark.createDataFrame([(7, "n", "n@x")], "id long, name string, email string"), allowMissingColumns=True)
    store.upsert("users", rows.checkpoint())
    assert {(r["id"], r["name"]) for r in store.read("users").collect()} == {(1, "z"), (7, "n")}


def test_second_writer_fails(spark, store):
    add_users(spark, store, "a")
    store._commit("users", 1, store.segments("users"))
    with pytest.raises(Conflict):
        store._commit("users", 1, [])


def test_a_change_between_read_and_write_is_a_conflict(spark, store):
    """Patches, inserts and what is computed from a version: none of them overwrites another writer's change."""
    add_users(spark, store, "a", "b")
    base = store.version("users")
    store.patch("users", spark.createDataFrame([(1, "first")], "id long, name string"))
    change = spark.createDataFrame([(1, "second")], "id long, name string")
    for act in (lambda: store.patch("users", change, base=base), lambda: store.upsert("users", change, base=base), lambda: store.insert("users", change.drop("id"), [F.col("name")], base=base), lambda: store.append("users", change, base)):
        with pytest.raises(Conflict):
            act()
    assert {r["id"]: r["name"] for r in store.read("users").collect()} == {1: "first", 2: "b"}


def test_numbers_follow_the_order_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(ranking, "ROWS", 50)
    rows = spark.range(500).select((F.col("id") * 7919 % 500).alias("k"), F.lit("one day").alias("day")).repartition(6)
    got = {r["k"]: r["id"] for r in ranking.numbered(rows, [F.col("day"), F.col("k")], 11).collect()}
    assert got == {k: 11 + k for k in range(500)}
    assert ranking.numbered(rows.limit(0), [F.col("k")], 1).count() == 0


def test_lookups(spark, store):
    add_users(spark, store, "a", "b")
    users = store.read("users")
    assert lookup.require(users, id=2)["name"] == "b"
    assert lookup.user_by_email(users, "a@example.com").first()["id"] == 1
    with pytest.raises(lookup.NotFound):
        lookup.require(users, id=99)
    assert "password" not in shown(users, "users").columns


def test_rates_keep_the_latest(spark):
    rows = spark.createDataFrame([("USD", {"EUR": 1.0}, "2024-01-01"), ("USD", {"EUR": 2.0}, "2024-02-01")], "base_code string, conversion_rates map<string,double>, d string")
    rows = rows.withColumn("last_update", F.col("d").cast("timestamp_ntz"))
    assert lookup.rates_of(rows, "USD").first()["conversion_rates"] == {"EUR": 2.0}


def test_every_schema_has_a_key():
    for name, schema in schemas.TABLES.items():
        assert schema.fieldNames()[0] in ("id", "base_code"), name
