"""Media columns and top-k search, against plain Python."""

from __future__ import annotations

import hashlib
import io
import pickle
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from support import awkward, clashing, empty

from coffer.llm import media, topk


def test_decoders_round_trip():
    rng = np.random.default_rng(3)
    grey = rng.integers(0, 256, (5, 7), dtype=np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all()
    colour = rng.integers(0, 256, (4, 3, 3), dtype=np.uint8)
    assert (media.decode(media.encode_bmp(colour)) == colour).all()
    assert (media.decode(b"P6 3 4\n255\n" + colour.tobytes()) == colour).all()
    assert media.decode(b"P2\n# note\n2 2 # more\n9\n1 2\n3 9").tolist() == [[1, 2], [3, 9]]
    assert media.decode(b"P3 1 2 255 1 2 3 4 5 6").tolist() == [[[1, 2, 3]], [[4, 5, 6]]]
    assert media.decode(b"P1 3 1 1 0 1").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4 9 1\n\x80\x80").tolist() == [[0] + [255] * 7 + [0]]
    wide = rng.integers(0, 65536, (2, 2)).astype(np.uint16)
    assert (media.decode(b"P5 2 2 65535\n" + wide.astype(">u2").tobytes()) == wide).all()


@pytest.mark.parametrize("data", [b"", b"P5", b"P5 2 2 255\n\x00", b"P9 1 1", b"BM", b"P5 0 1 255\n", b"P2 1 1 5 9", b"P3 1 1 255 a b c", b"P4 9 2\n\x00"])
def test_bad_media(data):
    with pytest.raises(media.MediaError):
        media.decode(data)
    assert media.describe(data)[-1]


def test_area_resize_is_exact():
    rng = np.random.default_rng(4)
    image = rng.random((6, 10))
    fine = np.repeat(np.repeat(image, 8, 0), 9, 1)  # 48 x 90 divides into 8 x 9 cells
    want = fine.reshape(8, 6, 9, 10).mean((1, 3))
    assert np.allclose(media.resize_area(image, 8, 9), want)
    assert np.allclose(media.resize_area(np.full((1, 1), 3.0), 4, 4), 3)


def test_tiles_and_hashes():
    image = np.tile(np.arange(64.0), (10, 1))
    assert media.difference_hash(image) == "00" * 8 and media.difference_hash(image[:, ::-1]) == "ff" * 8
    tile = np.load(io.BytesIO(media.npy_tile(image)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_text_media(spark):
    docs = awkward(spark)
    texts = {r["doc_id"]: (r["text"] or "").encode() for r in docs.collect()}
    rows = media.media_features(clashing(docs)).collect()
    assert len(rows) == docs.count()
    for r in rows:
        raw = texts[r["doc_id"]]
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        stored = media.encode_pgm(np.frombuffer(payload, np.uint8).reshape(-1, 64))
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(stored))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["media_sha256"] == hashlib.sha256(stored).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(payload[-64:])
        _, _, samples, tile, dhash, error = media.describe(stored)
        assert samples == payload and r["feature"] == f"{dhash}-{zlib.crc32(tile):08x}" and error is None
    assert media.media_features(empty(spark)).count() == 0


def test_media_column_reports_errors(spark):
    df = spark.createDataFrame([(1, bytearray(b"P5 1 1 255\n\x07")), (2, bytearray(b"junk")), (3, None)], "k long, m binary")
    got = {r["k"]: (r["height"], bytes(r["samples"] or b""), r["error"]) for r in media.process_media(df, "m", ["k"]).collect()}
    assert got == {1: (1, b"\x07", None), 2: (None, b"", "not Netpbm"), 3: (None, b"", "no media")}


def brute(rows: dict[int, np.ndarray], every: int, k: int) -> list[tuple]:
    out = []
    for q in sorted(i for i in rows if i % every == 0):
        best = sorted(((-int(rows[q] @ v), i) for i, v in rows.items() if i != q))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("spread", [1.0, 0.004])
def test_topk_equals_brute_force(spark, spread):
    rng = np.random.default_rng(5)
    vectors = {i: (rng.standard_normal(12) * spread).astype(np.float32) for i in range(400)}
    vectors[7] = vectors[8]  # ties
    df = spark.createDataFrame([(i, v.tolist(), 0) for i, v in vectors.items()], "vec_id long, embedding array<float>, label int")
    want = brute({i: np.floor(v.astype(np.float64) * 1024).astype(np.int64) for i, v in vectors.items()}, 20, 10)
    for rows in (4096, 70):
        got = sorted(tuple(r) for r in topk.top_k(df, every=20, shard_rows=rows).collect())
        assert got == want


def test_topk_stops_early_and_stays_exact():
    rng = np.random.default_rng(6)
    vectors = rng.integers(-20, 20, (3000, 24))
    queries = rng.integers(-3, 3, (5, 24))
    queries[:, 0] = 400
    index = topk.opened(pickle.dumps(topk.build_index(np.arange(3000) + 7000, np.arange(3000), vectors)))
    for query, own in zip(queries, (5, -1, 7, 8, 9), strict=True):
        ids, scores, read = topk.search(index, query, own + 7000, 10)
        exact = sorted(((-int(vectors[i] @ query), i) for i in range(3000) if i != own))[:10]
        assert [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == exact
        assert read < 24 * topk.LEVELS // 4  # one dimension decides, and its segments come first


def test_topk_reads_by_each_querys_own_impact():
    rng = np.random.default_rng(9)
    vectors = rng.integers(-50, 50, (2000, 6))
    index = topk.opened(topk.build_index(np.arange(2000), np.arange(2000), vectors))
    for d in range(6):
        query = np.ones(6, np.int64)
        query[d] = 1000
        ids, scores, read = topk.search(index, query, -1, 5)
        assert read <= 2 * topk.LEVELS and [(-s, i) for i, s in zip(ids.tolist(), scores.tolist(), strict=True)] == sorted((-int(vectors[i] @ query), i) for i in range(2000))[:5]


def test_topk_awkward_vectors(spark):
    rows = [(0, [1.0, 2.0]), (100, None), (200, [float("nan"), 1.0]), (300, [float("inf"), 1.0]), (400, [None, 1.0]), (None, [1.0, 1.0]), (1, [1.0]), (2, []), (3, [0.5, 0.5]), (3, [0.25, 0.5]), (500, [0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    k = 1024
    want = [(0, 1, 3, k * k // 2 + k * k), (0, 2, 3, k * k // 4 + k * k), (0, 3, 1, k * k), (0, 4, 500, 0), (500, 1, 0, 0), (500, 2, 1, 0), (500, 3, 3, 0), (500, 4, 3, 0)]
    for more in (df, df.withColumns({c: F.lit("own") for c in ("row", "v", "rank", "score", "shard", "index", "query_id", "query_row")})):
        assert [tuple(r) for r in topk.top_k(more).orderBy("query_id", "rank").collect()] == want
    assert topk.top_k(df.limit(0)).count() == 0
    assert topk.top_k(df.where("vec_id = 1")).count() == 0


def test_topk_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(0, [1.0]), (0, [2.0]), (0, [1.0]), (5, [3.0])], "vec_id long, embedding array<double>")
    unit = 1024 * 1024
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"] // unit) for r in topk.top_k(df).collect())
    assert got == sorted([*[(0, 1, 5, 3), (0, 2, 0, 2), (0, 3, 0, 1)] * 2, (0, 1, 5, 6), (0, 2, 0, 2), (0, 3, 0, 2)])


def test_topk_sums_beyond_64_bits(spark):
    df = spark.createDataFrame([(0, [1e300, 1.0]), (1, [-1e300, 1.0]), (2, [1e17, -2.0]), (100, [2.0, 2.0]), (3, [1e12, 0.0])], "vec_id long, embedding array<double>")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df).collect()}
    most = 2**63 - 1
    assert got[0, 1] == (2, most) and got[0, 2] == (3, most) and got[0, 3] == (100, most) and got[0, 4] == (1, -most - 1)
    assert [got[100, i] for i in range(1, 5)] == [(0, most), (2, most), (3, 2048 * 1024 * 10**12), (1, -most - 1)]


def test_topk_in_several_blocks_of_queries(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_CELLS", 12)
    rng = np.random.default_rng(3)
    vectors = {i: rng.integers(-5, 5, 4).astype(float) for i in range(60)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in vectors.items()], "vec_id long, embedding array<double>")
    want = brute({i: (v * 1024).astype(np.int64) for i, v in vectors.items()}, 6, 3)
    assert sorted(tuple(r) for r in topk.top_k(df, every=6, k=3).collect()) == want
