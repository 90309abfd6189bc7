"""Merchant resolution: the fixture, and random batches against a one-by-one fold."""

from __future__ import annotations

import random

from coffer.operators import merchants

CANDIDATE = "seq long, external_id string, name string, website string"
STORED = "id long, external_id string, name string, website string"


def fold(candidates: list[tuple], stored: list[tuple]) -> dict[int, tuple]:
    """Each rule, one candidate after the other: seq -> ('old', id) or ('new', seq of the insert)."""
    rows = [(("old", i), e, n, w) for i, e, n, w in sorted(stored)]
    out = {}
    for seq, ext, name, site in sorted(candidates):
        lookup = (site or "") if ext is not None and site is None else site
        hit = next((r[0] for r in rows if ext is not None and r[1] == ext), None)
        if hit is None and lookup is not None:
            hit = next((r[0] for r in rows if r[2] == name and r[3] == lookup), None)
        if hit is None:
            hit = ("new", seq)
            rows.append((hit, ext, name, site))
        out[seq] = hit
    return out


def resolved(spark, candidates, stored) -> dict[int, tuple]:
    rows = merchants.resolve(spark.createDataFrame(candidates, CANDIDATE), spark.createDataFrame(stored, STORED)).collect()
    assert len(rows) == len(candidates)
    return {r["seq"]: ("old", r["merchant_id"]) if r["merchant_id"] is not None else ("new", r["insert_seq"]) for r in rows}


def test_fixture(spark):
    stored = [(1, "e1", "N", "W"), (2, None, "P", None)]
    candidates = [(1, "e1", "X", "Y"), (2, "e2", "N", "W"), (3, "e2", "M", "V"), (4, "e2", "Q", None), (5, "e9", "P", None), (6, None, "P", None), (7, None, "P", None), (8, None, "N", "W")]
    got = resolved(spark, candidates, stored)
    assert got == {1: ("old", 1), 2: ("old", 1), 3: ("new", 3), 4: ("new", 3), 5: ("new", 5), 6: ("new", 6), 7: ("new", 7), 8: ("old", 1)}
    assert got == fold(candidates, stored)


def test_random_batches_equal_the_fold(spark):
    """All batches in one call each would be slow, so names, ids and sites of many batches are kept apart by a prefix."""
    rng = random.Random(3)
    candidates, stored, want = [], [], {}
    for batch in range(60):
        own, held = [], []
        for i in range(rng.randint(0, 3)):
            held.append((batch * 10 + i, rng.choice([None, f"{batch}e{rng.randint(0, 2)}"]), f"{batch}n{rng.randint(0, 2)}", rng.choice([None, "w0", "w1", ""])))
        for i in range(rng.randint(1, 9)):
            own.append((batch * 100 + i, rng.choice([None, f"{batch}e{rng.randint(0, 3)}"]), f"{batch}n{rng.randint(0, 2)}", rng.choice([None, "w0", "w1"])))
        want |= fold(own, held)
        candidates += own
        stored += held
    assert resolved(spark, candidates, stored) == want


def test_many_equal_candidates_settle_together(spark):
    candidates = [(i, "e", "n", "w") for i in range(200)] + [(200 + i, None, "m", "v") for i in range(200)]
    got = resolved(spark, candidates, [])
    assert all(got[i] == ("new", 0) for i in range(200)) and all(got[200 + i] == ("new", 200) for i in range(200))


def test_empty(spark):
    assert resolved(spark, [], [(1, "e", "n", "w")]) == {}
