"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 .. n-1 in the order of their key; a keyed Feistel network
with cycle walking permutes the numbers; number p goes to shard p mod S, slot
p div S. So shard sizes differ by one row at most, slots have no gaps, and
shard and slot follow from (row number, n, seed) alone. DataFrame functions
only.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import global_rank, materialise

ROUNDS = 6
#: Steps of cycle walking. Where the grid has fewer spare cells than this, no
#: walk can be longer; else a row leaves the grid with a probability below
#: 1/24 in each step and 24 steps fail for fewer than one row in 10^33.
WALK = 24
# Fixed parameters of the round function: a prime and two multipliers below 2^31.
PRIME = 2_147_483_647
MULTIPLIERS = (1_103_515_245, 1_664_525_317)


def round_keys(seed: int) -> list[int]:
    """ROUNDS keys below PRIME from the seed."""
    keys, state = [], seed % PRIME
    for i in range(ROUNDS):
        state = (state * 48_271 + 12_820_163 + i) % PRIME
        keys.append(state)
    return keys


def grid(n: int) -> tuple[int, int]:
    """Sides a, b with a * b >= n and fewer than a spare cells."""
    a = max(1, math.isqrt(max(n - 1, 0)) + 1)
    return a, max(1, -(-n // a))


def _round(value: Column, key: int) -> Column:
    first = ((value + F.lit(key)) * F.lit(MULTIPLIERS[0])) % F.lit(PRIME)
    return (first.bitwiseXOR(F.shiftright(first, 15)) * F.lit(MULTIPLIERS[1])) % F.lit(PRIME)


def _permute_once(df: DataFrame, column: str, a: int, b: int, keys: list[int]) -> DataFrame:
    """One pass of the network over ``column``; each round is its own projection so that no expression doubles."""
    df = df.withColumns({"feistel_l": F.expr(f"`{column}` div {b}"), "feistel_r": F.expr(f"`{column}` % {b}")})
    for i, key in enumerate(keys):
        if i % 2 == 0:
            df = df.withColumn("feistel_l", (F.col("feistel_l") + _round(F.col("feistel_r"), key)) % F.lit(a))
        else:
            df = df.withColumn("feistel_r", (F.col("feistel_r") + _round(F.col("feistel_l"), key)) % F.lit(b))
    return df.withColumn(column, F.col("feistel_l") * F.lit(b) + F.col("feistel_r")).drop("feistel_l", "feistel_r")


def _walk_sql(a: int, b: int, keys: list[int]) -> str:
    """SQL of one pass over the lambda variable ``x``, for the few rows that leave 0 .. n-1."""
    half = lambda v, k: f"((({v} + {k}) * {MULTIPLIERS[0]}) % {PRIME})"
    state = f"named_struct('l', x div {b}, 'r', x % {b})"
    for i, k in enumerate(keys):
        src, dst, side, other = ("r", "l", a, "r") if i % 2 == 0 else ("l", "r", b, "l")
        mixed = f"((f ^ shiftright(f, 15)) * {MULTIPLIERS[1]}) % {PRIME}"
        new = f"(s.{dst} + transform(array({half(f's.{src}', k)}), f -> {mixed})[0]) % {side}"
        fields = f"'l', {new}, 'r', s.r" if dst == "l" else f"'l', s.l, 'r', {new}"
        state = f"transform(array({state}), s -> named_struct({fields}))[0]"
    return f"transform(array({state}), s -> s.l * {b} + s.r)[0]"


def permute(df: DataFrame, column: str, n: int, seed: int) -> DataFrame:
    """Replace row numbers 0 .. n-1 in ``column`` by a keyed permutation of them.

    Empty and one-row inputs stay as they are. Numbers outside the range raise.
    """
    if n < 2:
        return df
    (a, b), keys = grid(n), round_keys(seed)
    df = _permute_once(df, column, a, b, keys)
    spare = a * b - n
    if not spare:
        return df
    once = _walk_sql(a, b, keys)
    walked = F.expr(f"aggregate(sequence(1, {min(spare, WALK)}), `{column}`, (x, i) -> IF(x < {n}, x, {once}))")
    df = df.withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(walked))
    return df.withColumn(column, F.when(F.col(column) < n, F.col(column)).otherwise(F.raise_error(F.lit("cycle walking did not return"))))


def shard(df: DataFrame, keys: list[str], n_shards: int = 8, seed: int = 20_240_501) -> DataFrame:
    """Add ``row_number``, ``position``, ``shard`` and ``slot`` (all long but ``shard``, int).

    ``df`` holds the columns to keep, and must not have these four names or
    ``global_rank``. Rows are numbered in the order of ``keys`` (nulls first);
    rows with the same keys are interchangeable. Empty input gives no rows.
    """
    ranked, n = global_rank(df, keys, "shard-order")
    placed = permute(ranked.withColumn("position", F.col("global_rank")), "position", n, seed)
    return placed.withColumnRenamed("global_rank", "row_number").withColumns({"shard": (F.col("position") % n_shards).cast("int"), "slot": F.expr(f"position div {n_shards}")})


def shard_documents(docs: DataFrame, n_shards: int = 8, seed: int = 20_240_501) -> DataFrame:
    """Shards of ``documents`` (doc_id, text; other columns are ignored) by the law ``rows``.

    Returns doc_id, size (UTF-8 bytes plus 1), text_crc32, law, shard, slot and
    grown_shard (null: this law moves rows when a shard is added). Null text:
    no bytes. Null or repeated doc_id: ordered by checksum and size next, so the
    result is the same in each run; fully equal rows can change places.
    """
    text = F.coalesce(F.col("text").cast("binary"), F.lit(b""))
    base = docs.select("doc_id", (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32"))
    out = shard(materialise(base, "shard-base"), ["doc_id", "text_crc32", "size"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
