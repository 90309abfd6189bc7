"""Mixing and sharding, against plain Python."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F
from support import awkward, clashing, empty, frame, words

from coffer.llm import mixing, sharding


def waterfill(sizes: dict, share=1.5, most=2.0) -> dict:
    """Targets by cutting and resharing until none is above its limit."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        cut = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not cut:
            return out | {s: unit * weight[s] for s in open_}
        for s in cut:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= cut
    return out


def test_targets_equal_resharing(spark):
    rng = random.Random(1)
    for _ in range(4):
        names = rng.sample(["a", "B", "é", "z", "漢", None, "aa"], rng.randint(1, 7))
        rows = [(n, rng.choice([0, 5, 50, 5000])) for n in names for _ in range(2)]
        sizes = Counter()
        for n, s in rows:
            sizes[n] += s
        got = {r["source"]: r["target"] for r in mixing.source_targets(spark.createDataFrame(rows, "source string, size long")).collect()}
        want = waterfill(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in want)


def test_mix_keeps_targets_bounds_and_reruns(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(1, 60), "en", "hot" if i % 3 else f"s{i % 7}", 0) for i in range(3000)]
    docs = frame(spark, rows).repartition(5)
    got = mixing.mix(docs).collect()
    assert len(got) == 3000
    by, target = defaultdict(int), {}
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2 and r["size"] == len(words(rows[r["doc_id"]][1]))
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    assert all(abs(by[s] - target[s]) <= 60 for s in target)
    again = {(r["doc_id"], r["copies"]) for r in mixing.mix(docs.repartition(3)).collect()}
    assert again == {(r["doc_id"], r["copies"]) for r in got}


def test_rounding_is_unbiased(spark):
    """Over many draws a document is taken as often as it should be; but for the shortest, which is left at the root and rounded to the nearer side."""
    items = spark.createDataFrame([(f"s{k}", 12 * k + i, 1000 + i, 12, 0.25 + i / 20) for k in range(100) for i in range(12)], "source string, doc_id long, size long, n_docs long, p double")
    total = Counter()
    for r in mixing.round_up(items, 3).collect():
        total[r["doc_id"] % 12] += r["up"]
    assert all(abs(total[i] / 100 - (0.25 + i / 20)) < 0.17 for i in range(1, 12))


def test_equal_rows_are_rounded_one_by_one(spark):
    """400 equal rows and 3 of another kind: within one row of the target, in the plan and in the rows."""
    rows = [(1, "w " * 5, "en", "s", i) for i in range(400)] + [(2, "v " * 7, "en", "s", i) for i in range(3)] + [(3, "u " * 500, "en", "t", 0)]
    docs = frame(spark, rows)
    got = [r for r in mixing.mix(docs).collect() if r["source"] == "s"]
    assert len(got) == 403 and abs(sum(r["taken"] for r in got) - got[0]["target"]) <= 5 and {r["copies"] for r in got} == {1, 2}
    taken = Counter((r["doc_id"], r["source"], r["n_chars"]) for r in mixing.mixed_rows(docs).collect())
    assert Counter((i, n) for (i, _, _), n in taken.items()) == Counter((r["doc_id"], r["copies"]) for r in mixing.mix(docs).collect() if r["copies"])
    many = spark.range(20_000).select(F.lit("x").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 2).cast("string").alias("source"))
    assert mixing.mix(many).agg(F.sum("taken")).first()[0] == mixing.mixed_rows(many).count() * 3 == 90_000


def test_sources_come_near_their_targets(spark):
    """A few dozen documents of very different lengths: the root works its rest off with short ones."""
    rng = random.Random(4)
    rows = [(i, "w " * int(2 ** rng.uniform(0, 9)), "en", f"s{i % 6}", 0) for i in range(360)]
    by, target, size = Counter(), {}, {}
    for r in mixing.mix(frame(spark, rows)).collect():
        by[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    # s1 wants nearly every document once, so few can still be added.
    assert all(abs(by[s] - target[s]) <= (2 if s != "s1" else 0.03 * target[s]) for s in target)


def test_mix_awkward_rows(spark):
    docs = awkward(spark)
    got = mixing.mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert mixing.mix(empty(spark)).count() == 0 and mixing.mixed_rows(empty(spark)).count() == 0
    rows = mixing.mixed_rows(clashing(docs))
    assert rows.columns == clashing(docs).columns
    copies = Counter((r["doc_id"], r["source"], r["size"]) for r in got for _ in range(r["copies"]))
    assert Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows.collect()) == copies


def feistel(x: int, n: int, seed: int) -> int:
    """The permutation in plain integers."""
    (a, b), keys = sharding.grid(n), sharding.round_keys(seed)

    def mixed(v: int, k: int) -> int:
        f = ((v + k) * sharding.MULTIPLIERS[0]) % sharding.PRIME
        return ((f ^ (f >> 15)) * sharding.MULTIPLIERS[1]) % sharding.PRIME

    while True:
        left, right = divmod(x, b)
        for i, k in enumerate(keys):
            if i % 2 == 0:
                left = (left + mixed(right, k)) % a
            else:
                right = (right + mixed(left, k)) % b
        x = left * b + right
        if x < n:
            return x


def test_permutation(spark):
    for n in (0, 1, 2, 3, 5, 7, 10, 97, 1000, 4097):
        got = [r[0] for r in sharding.permute(spark.range(n).withColumn("p", F.col("id")), "p", n, 9).orderBy("id").select("p").collect()]
        assert sorted(got) == list(range(n))
        if n > 1:
            assert got == [feistel(i, n, 9) for i in range(n)]


def test_shards(spark):
    docs = frame(spark, [(i * 3, f"t{i % 5}", "en", "s", 1) for i in range(1003)]).repartition(7)
    rows = sharding.shard_documents(docs).collect()
    slots = defaultdict(list)
    for r in rows:
        text = f"t{r['doc_id'] // 3 % 5}".encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(text) + 1, zlib.crc32(text), "rows", None)
        p = feistel(r["doc_id"] // 3, 1003, 20_240_501)
        assert (r["shard"], r["slot"]) == (p % 8, p // 8)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1


def test_shards_of_awkward_rows(spark):
    for docs in (awkward(spark), clashing(awkward(spark)), empty(spark)):
        rows = sharding.shard_documents(docs).collect()
        assert len(rows) == docs.count() and len({(r["shard"], r["slot"]) for r in rows}) == len(rows)
    nulls = [r for r in sharding.shard_documents(awkward(spark)).collect() if r["doc_id"] == 2]
    assert (nulls[0]["size"], nulls[0]["text_crc32"]) == (1, 0)
