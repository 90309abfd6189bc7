"""Exact top-k by inner product: an impact-ordered index, read score at a time.

The index of a shard of vectors has, for each dimension, the vectors grouped
into segments by quantised value. A query multiplies a segment by its own
component, so a segment's impact is the most that it can add above its
dimension's least. Each query reads the segments of all dimensions by its own
descending impact. At any time a vector's true score lies between its sum and
its sum plus what unread segments can still add. Reading stops when that proves
that all but a few vectors are out of the top k; the rest are scored exactly.

Vectors are dealt into shards, once. Queries go to the shards and not the other
way round: a block of them, of bounded size, is broadcast, each task reads its
shards and keeps the k best of each query, and these meet in a last rank.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.common import materialise

SCALE = 1024
#: Components in a shard at most, and vectors.
SHARD_CELLS, SHARD_ROWS = 1 << 20, 16_384
#: Components of the queries that are broadcast at once, 8 bytes each.
BLOCK_CELLS = 1 << 21
LEVELS = 16
#: The bounds are looked at after every LOOKS-th part of the segments.
LOOKS = 16
#: Reading stops when no more than 1 row in FEW can be among the best: to score those exactly costs less than reading on.
FEW = 8
LONG = 2**63 - 1


def _narrow(values: np.ndarray) -> np.ndarray:
    """As 32-bit integers if they fit: half the index."""
    return values.astype(np.int32) if values.size and values.max() < 2**31 and values.min() >= -(2**31) else values


def _most(dims: int) -> int:
    """Components up to this size make sums, and sums of impacts, below 2^53: exact in 64-bit floats too."""
    return math.isqrt((1 << 50) // max(1, dims))


def _is_wide(vectors: np.ndarray) -> np.ndarray:
    most = _most(vectors.shape[1])
    return ((vectors > most) | (vectors < -most)).any(1)


def build_index(rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray, levels: int = LEVELS) -> dict:
    """Index of int64 ``vectors`` (n, dims) with their row numbers and ids: for each dimension the places and values by level, where levels end, and each level's bounds. Vectors with components that may make sums too large for it are kept beside it."""
    wide = _is_wide(vectors)
    beside = (rows[wide], ids[wide], vectors[wide])
    rows, ids, vectors = rows[~wide], ids[~wide], vectors[~wide]
    n, dims = vectors.shape
    low, high = (vectors.min(0), vectors.max(0)) if n else (np.zeros(dims, np.int64),) * 2
    level = (vectors - low) * levels // np.maximum(high - low + 1, 1)
    places = np.ascontiguousarray(np.argsort(level, axis=0, kind="stable").T, np.int32)
    values = np.take_along_axis(np.ascontiguousarray(vectors.T), places, axis=1)
    ends = np.stack([np.searchsorted(level[places[d], d], np.arange(levels + 1)) for d in range(dims)]) if dims else np.zeros((0, levels + 1), np.int64)
    lo, hi = np.zeros((dims, levels), np.int64), np.zeros((dims, levels), np.int64)
    for d in range(dims):
        for s in range(levels):
            part = values[d, ends[d, s] : ends[d, s + 1]]
            if part.size:
                lo[d, s], hi[d, s] = part.min(), part.max()
    return {"rows": rows, "ids": ids, "vectors": _narrow(vectors), "places": places, "values": _narrow(values), "ends": ends, "lo": lo, "hi": hi, "low": low, "high": high, "beside": beside}


def opened(blob: bytes | dict) -> dict:
    """A stored index, ready to be searched: values as distances from their dimension's least and largest (whole numbers below 2^53, see ``_most``), and room for what is read between two looks."""
    index = pickle.loads(blob) if isinstance(blob, bytes) else blob
    values, cells = index["values"].astype(np.float64), index["values"].size
    rising, falling = values - index["low"][:, None], index["high"][:, None] - values
    return index | {"places": index["places"].astype(np.intp), "rising": rising, "falling": falling, "room": (np.empty(cells, np.intp), np.empty(cells))}


def exact_scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in whole numbers of any size; those outside 64 bits become the nearest that fits."""
    products = vectors.astype(object) @ query.astype(object)
    return np.array([max(-LONG - 1, min(LONG, x)) for x in products.tolist()], np.int64)


def _read(index: dict, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, int]:
    """Places of the vectors that can be among the k best for ``query``, and how many segments were read to know."""
    places, ends, (where, adds) = index["places"], index["ends"], index["room"]
    dims, levels = index["lo"].shape
    n = len(index["ids"])
    floor = np.minimum(query * index["low"], query * index["high"])
    impact = np.maximum(query[:, None] * index["lo"], query[:, None] * index["hi"]) - floor[:, None]
    impact[(ends[:, 1:] == ends[:, :-1]) | (query == 0)[:, None]] = -1
    # By dimension, impacts fall: reading one leaves the next as the most that is unread.
    falling = np.maximum(-np.sort(-impact, axis=1), 0)
    drops = falling - np.concatenate([falling[:, 1:], np.zeros((dims, 1), np.int64)], axis=1)
    by_level = np.argsort(-impact, axis=1, kind="stable")
    order = np.argsort(-np.take_along_axis(impact, by_level, 1), axis=None, kind="stable")
    order = order[: int((impact >= 0).sum())]
    left = int(falling[:, 0].sum()) - np.cumsum(drops.ravel()[order])
    alive = np.flatnonzero(index["rows"] != own)
    sums, few, done = np.zeros(n), max(8 * k, n // FEW), 0
    look = max(1, len(order) // LOOKS)
    dimension, level = order // levels, by_level.ravel()[order]
    first, last = ends[dimension, level].tolist(), ends[dimension, level + 1].tolist()
    distances = [index["rising"][d] if c > 0 else index["falling"][d] for d, c in enumerate(query.tolist())]
    factor = np.abs(query).astype(np.float64).tolist()
    dimension = dimension.tolist()
    while alive.size > few and done < len(order):
        # The next segments, up to the next look at the bounds.
        at = 0
        for i in range(done, min(done + look, len(order))):
            d, a, z = dimension[i], first[i], last[i]
            where[at : at + z - a] = places[d, a:z]
            np.multiply(distances[d][a:z], factor[d], out=adds[at : at + z - a])
            at += z - a
        sums += np.bincount(where[:at], adds[:at], n)
        done = min(done + look, len(order))
        # Who can still reach the k-th largest sum with all that is unread? The others are out for good.
        live = sums[alive]
        alive = alive[live + left[done - 1] >= np.partition(live, live.size - k)[live.size - k]]
    return alive, done


def search(index: dict, query: np.ndarray, own: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Ids and exact scores of the k best vectors for an int64 ``query``, without row ``own``, and how many segments were read. Ties go to the smaller id."""
    rows, ids, vectors = index["beside"]
    others = rows != own
    if _is_wide(query[None, :])[0]:
        keep = index["rows"] != own
        alive, read, scores = np.flatnonzero(keep), 0, exact_scores(index["vectors"][keep], query)
    else:
        alive, read = _read(index, query, own, k)
        scores = index["vectors"][alive].astype(np.int64) @ query
    scores = np.concatenate([scores, exact_scores(vectors[others], query)]) if others.any() else scores
    found = np.concatenate([index["ids"][alive], ids[others]])
    best = np.lexsort((found, -scores if scores.size and scores.min() > -LONG - 1 else [-x for x in scores.tolist()]))[:k]
    return found[best], scores[best], read


def _quantised(df: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """row (a number of its own), vec_id and v: floor(scale * x) of each component."""
    x = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) > 0) & F.forall(x, lambda c: F.coalesce((c == c) & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)), F.lit(False)))
    v = F.transform(x, lambda c: F.floor(c * F.lit(float(scale))))
    return df.where(usable).select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


def top_k(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, scale: int = SCALE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """For each row whose id is divisible by ``every``: the k rows with the highest inner product, without itself.

    Returns query_id, rank (from 1), vec_id, score. Components count as
    floor(scale * x), and as the nearest 64-bit number if that is none; scores
    are exact, and the nearest 64-bit number if they are none. Rows without an
    id, with a null or empty vector or with null or non-finite components take
    no part. Rows that share an id are rows of their own, as queries and as
    candidates. Vectors of unequal length are padded with zeros. Ties go to the
    smaller id. No rows or no queries: no rows.
    """
    spark = df.sparkSession
    vectors = materialise(_quantised(df, id_col, vector_col, scale), "topk-vectors")  # written, so row numbers stay
    asked = vectors.where(F.col("vec_id") % every == 0)
    size = vectors.agg(F.count("*"), F.sum(F.when(F.col("vec_id") % every == 0, 1)), F.max(F.size("v"))).first()
    n, n_queries, dims = size[0], size[1] or 0, size[2] or 0
    schema = "query_row bigint, query_id bigint, vec_id bigint, score bigint"
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id"))
    ranked = lambda found: found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    if not n_queries:
        return ranked(spark.createDataFrame([], schema))
    shards = max(-(-n // max(1, min(shard_rows, SHARD_CELLS // dims))), min(n // 1024, spark.sparkContext.defaultParallelism), 1)
    blocks = -(-n_queries * dims // BLOCK_CELLS)

    def matrix(column: list) -> np.ndarray:
        out = np.zeros((len(column), dims), np.int64)
        for i, v in enumerate(column):
            out[i, : len(v)] = v
        return out

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        blob = pickle.dumps(build_index(pdf["row"].to_numpy(np.int64), pdf["vec_id"].to_numpy(np.int64), matrix(pdf["v"].tolist())), protocol=5)
        return pd.DataFrame({"index": [blob]})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"))
    index = materialise(dealt.groupBy("shard").applyInPandas(build, "index binary"), "topk-index")
    found = None
    for block in range(blocks):
        part = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("row", F.lit(7)), F.lit(blocks)) == block)
        queries = part.select("row", "vec_id", "v").toPandas()  # about BLOCK_CELLS numbers
        shared = spark.sparkContext.broadcast((queries["row"].to_numpy(np.int64), queries["vec_id"].to_numpy(np.int64), matrix(queries["v"].tolist())))

        def find(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            rows, ids, asked = shared.value
            best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(rows)
            for batch in batches:
                for blob in batch.column(0):
                    shard = opened(blob.as_py())
                    for i, query in enumerate(asked):
                        new, scores, _ = search(shard, query, int(rows[i]), k)
                        new, scores = np.concatenate([best[i][0], new]), np.concatenate([best[i][1], scores])
                        order = sorted(range(len(new)), key=lambda j: (-int(scores[j]), int(new[j])))[:k]  # noqa: B023
                        best[i] = new[order], scores[order]
            times = [len(b[0]) for b in best]
            if sum(times):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(rows, times)), pa.array(np.repeat(ids, times)), pa.array(np.concatenate([b[0] for b in best])), pa.array(np.concatenate([b[1] for b in best]))], names=["query_row", "query_id", "vec_id", "score"])

        here = materialise(index.mapInArrow(find, schema), "topk-found")
        found = here if found is None else found.unionByName(here)
    return ranked(found)
