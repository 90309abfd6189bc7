"""Driver queries of the corpus operators, with their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coffer.llm import lmscore, media, mixing, neardup, packing, pii, sharding, tokencount, topk, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    """The public byte-level BPE vocabulary that the driver's contracts name."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.replaced_documents(_table(spark, sf_dir, "documents"))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), k=4, similarity=80)


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op4_tokencount(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(_table(spark, sf_dir, "documents"), vocabulary_path())


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_table(spark, sf_dir, "documents"))


def op7_lmscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lmscore.score_documents(_table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(_table(spark, sf_dir, "documents"), vocabulary_path()))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_minhash": op2_minhash,
    "op3_toxicity": op3_toxicity,
    "op4_tokencount": op4_tokencount,
    "op5_mixing": op5_mixing,
    "op6_sharding": op6_sharding,
    "op7_lmscore": op7_lmscore,
    "op8_packing": op8_packing,
    "op9_media": op9_media,
    "op10_topk": op10_topk,
}

# All pairs by their shared shingles, and components by following links. Enough for the smaller tables.
_NEARDUP_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' ')) END) AS shingle FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 80 * (na.n + nb.n - count(*))
), reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, d.doc_id <= coalesce(l.b, d.doc_id) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def _sharding_sql(n_shards: int = 8, seed: int = 20_240_501) -> str:
    """The permutation as nested projections; walking is a recursion over the few rows outside 0 .. n-1."""

    def rounds(source: str) -> str:
        """One pass over column x of ``source``, which has a and b (the sides of the grid) too."""
        sql = f"SELECT * EXCLUDE (x), x // b AS l, x % b AS r FROM {source}"
        for i, key in enumerate(sharding.round_keys(seed)):
            src, dst, side = ("r", "l", "a") if i % 2 == 0 else ("l", "r", "b")
            sql = f"SELECT *, (({src} + {key}) * {sharding.MULTIPLIERS[0]}) % {sharding.PRIME} AS f FROM ({sql})"
            sql = f"SELECT * EXCLUDE (f) REPLACE (({dst} + (xor(f, f >> 15) * {sharding.MULTIPLIERS[1]}) % {sharding.PRIME}) % {side} AS {dst}) FROM ({sql})"
        return f"SELECT * EXCLUDE (l, r), l * b + r AS x FROM ({sql})"

    bit = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    table = "SELECT CAST(range AS BIGINT) AS c FROM range(256)"
    for _ in range(8):
        table = f"SELECT {bit} AS c FROM ({table})"
    return f"""
WITH RECURSIVE crc_table AS (SELECT list(c) AS t FROM ({table.replace("SELECT CAST(range AS BIGINT) AS c FROM range(256)", "SELECT CAST(range AS BIGINT) AS c FROM range(256) ORDER BY range")})),
base AS (
  SELECT doc_id, CAST(octet_length(raw) + 1 AS BIGINT) AS size,
    CASE WHEN octet_length(raw) = 0 THEN 0 ELSE xor(4294967295, list_reduce(list_transform(regexp_extract_all(hex(raw), '..'), lambda h: CAST('0x' || h AS BIGINT)),
      lambda acc, byte: xor(acc >> 8, t[xor(acc & 255, byte) + 1]), CAST(4294967295 AS BIGINT))) END AS text_crc32
  FROM (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents), crc_table
), numbered AS (SELECT *, row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS x, count(*) OVER () AS n FROM base),
sides AS (SELECT *, CAST(floor(sqrt(n - 1)) AS BIGINT) + 1 AS a FROM numbered),
grid AS (SELECT *, CAST((n + a - 1) // a AS BIGINT) AS b FROM sides),
walk AS ({rounds("grid")} UNION ALL {rounds("(SELECT * FROM walk WHERE x >= n)")})
SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, 'rows' AS law, CAST(x % {n_shards} AS INTEGER) AS shard, CAST(x // {n_shards} AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM walk WHERE x < n
"""


# Scores are unique sums of whole numbers, so SQL can rank all rows for each query.
_TOPK_SQL = """
WITH usable AS (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 1024) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), scored AS (
  SELECT q.r AS query_row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM usable q JOIN usable c ON q.vec_id % 100 = 0 AND c.r <> q.r
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""

ORACLES: dict[str, str] = {"op2_minhash": _NEARDUP_SQL, "op6_sharding": _sharding_sql(), "op10_topk": _TOPK_SQL}
