"""Token counts and packing, against the tokenizers library and an exact fill."""

from __future__ import annotations

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import awkward, clashing, empty, frame
from tokenizers import Tokenizer

from coffer.llm import packing, tokencount
from coffer.llm.queries import vocabulary_path

ALPHABET = [*"stmdrvlexyzAB'' '\n\t   　129.,!?éß漢字😀\r​́\x00\x1c\x85½²", "'re", "'ll", "'ve", "<|endoftext|>", "'s", "  "]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(vocabulary_path())


def noise(n: int, longest: int = 60, seed: int = 5) -> list[str]:
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, longest))) for _ in range(n)]


def test_counts_equal_the_library(library):
    texts = noise(4000) + ["a" * 20_000, " " * 5000 + "x", "'" * 999, "<|endoftext|>" * 50]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(vocabulary_path()).count(texts).tolist() == want


def test_every_code_point_counts_as_in_the_library(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{p}a{p}{p}1 {p}" for p in points[at : at + 100]) for at in range(0, len(points), 100)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert tokencount.Counter(vocabulary_path()).count(texts).tolist() == want
    assert [len(packing.encode(t, vocabulary_path())) for t in texts] == want


def test_compiled_merges_equal_the_library(library):
    """Runs, few letters and joined tokens: where merges compete most. Forgetting compiled states changes nothing."""
    rng = random.Random(8)
    counter = tokencount.Counter(vocabulary_path())
    emitter = counter.paths.emitter
    texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 70))) for _ in range(2000)]
    texts += ["".join(rng.choice("aeinorst") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["".join(rng.choice(emitter.merges.bytes).decode("utf-8", "ignore") for _ in range(rng.randint(1, 6))) for _ in range(6000)]
    texts += [c * n for c in "a- =_" for n in range(150)]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert counter.count(texts).tolist() == want
    emitter.forget()
    counter.paths.clear()
    assert counter.count(texts[::7]).tolist() == want[::7]
    assert emitter.emitted(b"".join(emitter.merges.bytes[300:400]) * 30) > 0


def test_transitions_carry_the_tokens_added():
    """Along any path, the sums of the transitions are the tokens of the prefixes."""
    emitter = tokencount.Counter(vocabulary_path()).paths.emitter
    text, state, total = b"internationalisation", 0, 0
    for n, byte in enumerate(text, 1):
        arc = emitter[state << 8 | byte]
        state, total = arc >> 8, total + (arc & 255) - 128
        assert total == emitter.emitted(text[:n])


def test_chunk_maps_compose():
    """Every chunk length gives the same cuts, so entry states come out right wherever chunks begin."""
    classes = np.random.default_rng(1).integers(0, tokencount.CLASSES, 5000).astype(np.uint8)
    classes[-1] = tokencount.END
    cutter, want = tokencount.Cutter(), None
    old = tokencount.CHUNK
    try:
        for size in (5000, 1, 7, 64, 1024):
            tokencount.CHUNK = size
            got = cutter.run(classes).tolist()
            want = want or got
            assert got == want
    finally:
        tokencount.CHUNK = old


def test_count_documents(spark, library):
    docs = awkward(spark)
    texts = {r["doc_id"]: r["text"] or "" for r in docs.collect()}
    for r in tokencount.count_tokens(clashing(docs), vocabulary_path(), limit=10).collect():
        text = texts[r["doc_id"]]
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (n, len(text.encode()), n > 10)
    assert tokencount.count_tokens(empty(spark), vocabulary_path()).count() == 0


def test_texts_that_are_no_utf8(spark, library):
    docs = spark.range(2).select(F.col("id").alias("doc_id"), F.when(F.col("id") == 0, F.unhex(F.lit("4142ff2043"))).otherwise(F.unhex(F.lit("e282"))).cast("string").alias("text"))
    want = {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(("AB\ufffd C", "\ufffd"))}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in tokencount.count_tokens(docs, vocabulary_path()).collect()} == {0: (5, want[0]), 1: (2, want[1])}
    assert {r["doc_id"]: r["length"] for r in packing.pack_documents(docs, vocabulary_path()).collect()} == {i: n + 1 for i, n in want.items()}


def test_ids_equal_the_library(library):
    for text in noise(500, seed=6) + ["a" * 5000]:
        assert packing.encode(text, vocabulary_path()).tolist() == library.encode(text, add_special_tokens=False).ids


def filled(plan: packing.Plan) -> dict[int, list[tuple[int, int]]]:
    out = defaultdict(list)
    for w, n, first, offset in plan.runs:
        for i in range(n):
            out[first + i].append((offset, w))
    return out


def best(lengths: tuple[int, ...], capacity: int) -> int:
    """The fewest bins, by search."""
    lengths = tuple(sorted(lengths, reverse=True))

    def fits(i: int, rooms: tuple[int, ...]) -> bool:
        if i == len(lengths):
            return True
        return any(r >= lengths[i] and fits(i + 1, tuple(sorted((*rooms[:j], r - lengths[i], *rooms[j + 1 :])))) for j, r in enumerate(rooms) if r not in rooms[:j])

    n = -(-sum(lengths) // capacity)
    while not fits(0, (capacity,) * n):
        n += 1
    return n


def test_plans_are_whole_and_dominance_loses_nothing():
    rng = random.Random(8)
    for _ in range(150):
        capacity = rng.choice([10, 20, 31])
        lengths = tuple(rng.randint(1, capacity) for _ in range(rng.randint(1, 9)))
        plan = packing.Plan(dict(Counter(lengths)), capacity)
        bins = filled(plan)
        assert sorted(w for b in bins.values() for _, w in b) == sorted(lengths) and len(bins) == plan.sequences
        for b in bins.values():
            at = 0
            for offset, w in sorted(b):
                assert offset == at
                at += w
            assert at <= capacity
        # The fixed bins are part of an optimal packing.
        fixed = [w for s, b in bins.items() if s < plan.fixed for _, w in b]
        rest = list((Counter(lengths) - Counter(fixed)).elements())
        assert plan.fixed + (best(tuple(rest), capacity) if rest else 0) == best(lengths, capacity)


def plain_best_fit(lengths: list[int], capacity: int = 1024) -> int:
    """Bins of best fit in decreasing order, one piece at a time."""
    rooms: list[int] = []
    for w in sorted(lengths, reverse=True):
        fit = min((r for r in rooms if r >= w), default=None)
        if fit is not None:
            rooms.remove(fit)
        rooms.append((capacity if fit is None else fit) - w)
    return len(rooms)


def test_pack_documents(spark, library):
    rng = random.Random(9)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma"]) for _ in range(rng.choice([0, 3, 90, 600, 2500]))) if i % 11 else None, "en", "s", 0) for i in range(120)]
    got = packing.pack_documents(frame(spark, rows), vocabulary_path()).collect()
    pieces = defaultdict(list)
    for r in got:
        pieces[r["doc_id"]].append(r)
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        own = sorted(pieces[doc_id], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(len(own))) and sum(r["length"] for r in own) == len(ids)
        assert all(r["length"] == 1024 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 1024
    assert len(bins) <= plain_best_fit([r["length"] for r in got])


def test_pack_awkward_rows(spark):
    for docs in (awkward(spark), clashing(awkward(spark))):
        got = packing.pack_documents(docs, vocabulary_path()).collect()
        assert Counter(r["doc_id"] for r in got if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())
        assert len({(r["sequence_id"], r["offset"]) for r in got}) == len(got)
    assert packing.pack_documents(empty(spark), vocabulary_path()).count() == 0


def test_ids_on_request(spark):
    row = packing.encode_pieces(frame(spark, [(1, "hello world", "en", "s", 1)]), vocabulary_path(), with_ids=True).first()
    assert zlib.crc32(np.array(row["ids"], "<u4").tobytes()) == row["ids_crc32"] and row["ids"][-1] == 2


def test_packed_sequences_hold_their_ids(spark, library):
    """Documents come back from the packed sequences alone, and the digests are those of the packed ids."""
    rows = [(i, "alpha beta gamma " * n, "en", "s", 0) for i, n in enumerate([0, 1, 40, 500, 900, 1400])]
    packed = packing.pack_documents(frame(spark, rows), vocabulary_path())
    got = packed.collect()
    sequences: dict[int, dict[int, int]] = defaultdict(dict)
    for r in got:
        sequences[r["sequence_id"]] |= dict(enumerate(r["ids"], r["offset"]))
    for doc_id, text, *_ in rows:
        own = sorted((r for r in got if r["doc_id"] == doc_id), key=lambda r: r["start"])
        found = [sequences[r["sequence_id"]][r["offset"] + i] for r in own for i in range(r["length"])]
        assert found == [*library.encode(text, add_special_tokens=False).ids, 2]
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert packing.digests(packed).columns == columns
    assert sorted(map(tuple, packing.digests(packed).collect())) == sorted(tuple(r[c] for c in columns) for r in got)
