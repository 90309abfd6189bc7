"""Small frames with every awkward row: nulls, empties, repeats, ties, long texts, clashing columns."""

from __future__ import annotations

import re

#: Names that operators use inside; inputs that have them must come through.
CLASH = ("row", "old", "new", "score", "predicted", "evidence", "pii", "copies", "size", "shard", "slot", "component_id", "kept", "node", "bucket", "a", "b", "text_key", "global_rank", "length", "piece", "dropped_id", "own_id", "k_size", "d_size", "key", "spoken")


def words(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def frame(spark, rows: list[tuple], schema: str = "doc_id long, text string, lang string, source string, n_chars long"):
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    long_ = "word " * 30_000
    rows = [
        (1, "one two three four five six seven eight", "en", "s1", 1),
        (2, None, None, None, None),
        (3, "", "en", "s2", 0),
        (4, "  \t\n ", "en", "s1", 5),
        (5, long_, "en", "s2", len(long_)),
        (6, "naïve café 漢字 😀 don't  stop here", "fr", None, 3),
        (6, "naïve café 漢字 😀 don't  stop here", "fr", None, 3),
        (7, "one two three four five six seven eight", "en", "s1", 1),
        (None, "nobody names this row at all today", "en", "s3", 1),
        (8, "x<|endoftext|>y \x00 \x1f", "en", "s3", 1),
    ]
    return frame(spark, rows)


def clashing(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit(f"own {c}") for c in CLASH})


def empty(spark):
    return frame(spark, [])
