"""The pipeline on the smallest tables: each stage does what it says to all that it gets."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F
from support import awkward, clashing, empty

import corpus_pipeline
from coffer.llm import mixing, neardup, pii, toxicity
from coffer.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet").cache(), []
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF).cache()
        out.append((name, docs, after))
        docs = after
    return out


def test_names_and_columns(stages):
    assert [name for name, *_ in stages] == ["toxicity", "near-duplicates", "pii", "mixing", "packing"]
    for _, before, after in stages[:-1]:
        assert after.columns == before.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxic_documents_go_and_others_stay(spark, stages):
    _, before, after = stages[0]
    scores = toxicity.score_documents(before, spark.read.parquet(f"{SF}/labels.parquet"))
    assert {r[0] for r in after.select("doc_id").collect()} == {r[0] for r in scores.where("predicted = 0").select("doc_id").collect()}
    assert after.exceptAll(before).count() == 0


def test_one_of_each_group_stays(stages):
    _, before, after = stages[1]
    found = neardup.near_duplicates(before, 5, 80).collect()
    assert {r[0] for r in after.select("doc_id").collect()} == {r["component_id"] for r in found}
    assert after.exceptAll(before).count() == 0


def test_all_documents_keep_their_place_in_pii(stages):
    _, before, after = stages[2]
    assert {r[0] for r in before.select("doc_id").collect()} == {r[0] for r in after.select("doc_id").collect()}
    clean = F.size(F.regexp_extract_all("text", F.lit(pii.ANY), F.lit(0))) == 0
    assert after.exceptAll(before).count() == before.where(~clean).count()


def test_copies_are_those_of_the_plan(stages):
    _, before, after = stages[3]
    plan = {r["doc_id"]: r["copies"] for r in mixing.mix(before).collect()}
    assert Counter(r[0] for r in after.select("doc_id").collect()) == Counter({i: c for i, c in plan.items() if c})


def test_packing_holds_every_row(stages):
    _, before, after = stages[4]
    assert after.where("piece = 0").count() == before.count()
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0


@pytest.mark.parametrize("make", [empty, awkward, lambda spark: clashing(awkward(spark))])
def test_stages_take_awkward_tables(spark, make, tmp_path):
    """Each stage takes empty tables, nulls, repeated rows and clashing names, and all but the last keep the columns."""
    spark.createDataFrame([(i, 1, i % 2) for i in range(1, 9)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = make(spark)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert out.count() >= 0 and (n == 4 or out.columns == docs.columns)
        docs = out if n < 4 else docs


def test_run_and_registry(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 11))
