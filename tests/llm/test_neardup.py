"""Near-duplicates, against all pairs."""

from __future__ import annotations

import random
import re
from collections import defaultdict

import numpy as np
from support import awkward, clashing, empty, frame, words

from coffer.llm import neardup


def shingle_set(text: str | None, k: int) -> set[tuple[str, ...]]:
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def brute(rows: list[tuple], k: int, similarity: int = 80) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component) by comparing all pairs."""
    sets = {r[0]: shingle_set(r[1], k) for r in rows}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= similarity * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: (len(sets[i]), find(i)) for i in ids}


def edited(rng: random.Random, text: list[str], n: int) -> list[str]:
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**6)}"
    return out


def family_rows(seed: int = 1) -> list[tuple]:
    """Exact copies, near copies on both sides of the threshold, chains, a shared passage, and unrelated texts."""
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(5000)}"
    rows: list[str] = []
    base = [word() for _ in range(150)]
    rows += [" ".join(edited(rng, base, n)) for n in [1, 2, 3, 4, 5, 6, 7] * 20]
    rows += [" ".join(base)] * 15
    chain = [word() for _ in range(120)]
    for _ in range(25):
        chain = edited(rng, chain, 2)
        rows.append(" ".join(chain))
    passage = [word() for _ in range(60)]
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(60)]
    rows += [" ".join(word() for _ in range(rng.randint(1, 80))) for _ in range(60)]
    rows += ["Same Text here now", "same text HERE now", "two", "two", "TWO", "É x y z", "é x y z", "", " \t"]
    rng.shuffle(rows)
    return [(i * 2 + 1, t, "en", "s", 0) for i, t in enumerate(rows)]


def result(df, k: int) -> dict[int, tuple[int, int]]:
    got = neardup.near_duplicates(df, k).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got}


def test_components_equal_all_pairs(spark):
    rows = family_rows()
    for k in (4, 5):
        assert result(frame(spark, rows).repartition(6), k) == brute(rows, k)


def test_small_blocks_change_nothing(spark, monkeypatch):
    """With blocks of a few rows every block pair is crossed, and the shuffle path replaces the broadcast."""
    rows = family_rows(2)
    monkeypatch.setattr(neardup, "BUCKET_BLOCK", 7)
    monkeypatch.setattr(neardup, "FAMILY_BLOCK", 5)
    monkeypatch.setattr(neardup, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(neardup, "GROUP", 3)
    assert result(frame(spark, rows), 4) == brute(rows, 4)


def test_one_stray_beside_many_copies_costs_a_line(spark):
    """The rows made for a component and a stray grow as the component, not as its square; pairs of two components all meet."""
    for n in (500, 2000):
        rows = spark.createDataFrame([(7, i, 0) for i in range(n)] + [(7, n, n), (7, n + 1, n + 1)], "family long, node long, component long")
        made = neardup._blocked(rows, "family", 50)
        assert made.count() <= n + 3 * (n // 50 + 2)
    for seed, sizes in enumerate([(1, 1, 1), (30, 1), (30, 25, 3, 2), (5, 5, 5, 5), (40, 40)]):
        rng, node, rows = random.Random(seed), 0, []
        for c, size in enumerate(sizes):
            rows += [(seed, node + i, 1000 + c) for i in range(size)]
            node += size
        rng.shuffle(rows)
        meets = defaultdict(list)
        for r in neardup._blocked(spark.createDataFrame(rows, "family long, node long, component long"), "family", 7).collect():
            meets[r["i"], r["j"]].append(r)
        met = {(a["node"], b["node"]) for (i, j), rs in meets.items() for a in rs for b in rs if a["component"] != b["component"] and (i == j or a["block"] != b["block"])}
        assert met == {(a, b) for _, a, x in rows for _, b, y in rows if x != y}


def test_components_of_hot_nodes(spark, monkeypatch):
    monkeypatch.setattr(neardup, "LEAST_HOT", 3)
    monkeypatch.setattr(neardup, "HOT_SHARE", 10)
    links = [(0, i) for i in range(1, 200)] + [(i, 5000 + i) for i in range(1, 50)] + [(900, 901), (901, 902)]
    got = {r["node"]: r["component"] for r in neardup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(1, 200), *range(5001, 5050)]} | {901: 900, 902: 900}


def test_signature_estimates_similarity():
    rng = np.random.default_rng(3)
    common, a, b = (rng.integers(0, 2**63, n).astype(np.uint64) for n in (400, 50, 50))
    x, y = neardup.signature(np.union1d(common, a)), neardup.signature(np.union1d(common, b))
    assert abs((x == y).mean() - 400 / 500) < 0.08
    first, slices = neardup.permutations()
    assert len(np.unique(first)) == len(first) == slices.shape[0]
    assert (slices[5, :100] == [slices[5 + j, 0] for j in range(100)]).all()  # coordinate j is the same permutation, shifted by j


def test_intersections_and_forest():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 300, rng.integers(1, 200))).astype(np.uint64) for _ in range(30)]
    got = neardup.intersections(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)
    linked = np.zeros((6, 6), bool)
    for i, j in ((0, 3), (3, 5), (1, 2)):
        linked[i, j] = linked[j, i] = True
    assert neardup.forest(linked) == [(0, 3), (0, 5), (1, 2)]


def test_long_chains_of_links(spark):
    n = 300
    order = list(range(n))
    random.Random(5).shuffle(order)
    links = spark.createDataFrame([(order[i], order[i + 1]) for i in range(n - 1)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(links).collect()}
    assert got == {i: 0 for i in range(1, n)} | {1001: 1000}
    assert neardup.components(links.limit(0)).count() == 0


def test_awkward_rows(spark):
    docs = clashing(awkward(spark))
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == 10
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in got}
    assert by[2] == (0, 2, True) and by[3] == (0, 3, True) and by[4] == (0, 4, True)
    assert by[7] == (4, 1, False) and by[None] == (3, None, True) and by[5] == (1, 5, True)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([1, 2, 3, 4, 5, 6, 8, None], key=str)
    assert neardup.near_duplicates(empty(spark)).count() == 0 and neardup.keep_one(empty(spark)).count() == 0
