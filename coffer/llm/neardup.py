"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard checks.

A document's set is its distinct shingles. Two random permutations of a
universe of 2^22 cells make the whole signature: the first scatters the
shingles; the second, shifted by j places, gives coordinate j as its smallest
value over them. In memory the second permutation is written out once with its
beginning repeated, so all coordinates of a shingle are one slice.

Equal sets are one class from the start. Classes whose signatures agree in a
whole band are candidates; 38 bands of 5 miss a pair at similarity 0.8 with a
probability of 3 in 10^7. Two filters drop most candidates: set sizes, which a
link cannot fail, and the low bits of 512 coordinates, where a link at 0.8
fails with about the same probability. The rest are compared on full sets.

Links are sought in two rounds, so that a group of copies costs one comparison
a member and band and not one a pair. First each bucket's members are compared
with its smallest. Then only members of one bucket that lie in different
components are left. Of those, what passes the filters is joined to families,
block against block of a bucket, and each family is compared block against
block on full sets; blocks of one large component are not compared with each other. Both steps give a spanning forest of what they find and
never the pairs; no pair that shares a bucket stays unsettled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.common import in_small_batches, materialise, text_bytes

UNIVERSE_BITS = 22
COORDINATES = 512
BANDS, BAND_ROWS = 38, 5
SEED = 20_240_611
WORDS = COORDINATES // 64
#: Of COORDINATES low bits, how many may differ: a pair at 0.8 differs in 51 on average, with a deviation of 6.8 at most.
MOST_BITS = 87
#: Members of a bucket, and of a family, in one block.
BUCKET_BLOCK, FAMILY_BLOCK = 1024, 128
#: Members compared with one centre in one group of rows.
GROUP = 64
#: Rows of ids up to which a side is broadcast (16 bytes or so each); above that both sides are shuffled.
BROADCAST_ROWS = 200_000
_MOST_WORDS = 200_000
BITS = [f"s{i}" for i in range(WORDS)]
#: A node is hot if it has more than one edge in so many, and LEAST_HOT at least.
HOT_SHARE, LEAST_HOT = 50_000, 200
#: Rows of a batch that are held as sets at once.
PART_ROWS = 256

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """Word -> 64-bit hash, filled as words are met and emptied when large."""

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_64_intdigest(word, SEED)
        if len(self) >= _MOST_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = h
        return h


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, k: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's k-word shingles; of the whole sequence if it is shorter; empty without words."""
    words = text.translate(_LOWER).split()  # bytes.split cuts at space and 9 to 13
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    size = min(n, k)
    total = np.full(n - size + 1, np.uint64(size), np.uint64)
    for i in range(size):
        total += w[i : n - size + 1 + i] * (_ODD[i % 5] + np.uint64(2 * (i // 5)))
    return np.unique(_mixed(total))


@cache
def permutations() -> tuple[np.ndarray, np.ndarray]:
    """The first permutation, and each place's slice of the second, circulant one."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    first, second = (rng.permutation(np.arange(1 << UNIVERSE_BITS, dtype=np.uint32)) for _ in range(2))
    circle = np.concatenate([second, second[: COORDINATES - 1]])
    return first, np.lib.stride_tricks.sliding_window_view(circle, COORDINATES)


def signature(hashes: np.ndarray) -> np.ndarray:
    """COORDINATES minima of a set that is not empty."""
    first, slices = permutations()
    places = first[hashes >> np.uint64(64 - UNIVERSE_BITS)]
    out = slices[places[:512]].min(0)
    for at in range(512, len(places), 512):
        np.minimum(out, slices[places[at : at + 512]].min(0), out=out)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each row and band."""
    rows = signatures[:, : BANDS * BAND_ROWS].reshape(-1, BANDS, BAND_ROWS).astype(np.uint64)
    total = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03), rows.shape[:2]).copy()
    for i in range(BAND_ROWS):
        total = _mixed(total + rows[:, :, i] * _ODD[i])
    return total.view(np.int64)


def _sketched(batch: pa.RecordBatch, k: int, hashes: WordHashes) -> pa.RecordBatch:
    """The sketches of a batch (doc_id, text)."""
    sets = [shingles(t.as_py(), k, hashes) for t in batch.column(1)]
    full = np.array([len(s) > 0 for s in sets], bool)
    keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
    signatures = np.stack([signature(s) for s in sets if len(s)]) if full.any() else np.zeros((0, COORDINATES), np.uint32)
    bits = np.packbits((signatures & 1).astype(np.uint8), axis=1).view(np.int64)
    spread = np.cumsum(full) - 1
    words = [pa.array([int(bits[j, w]) if f else None for j, f in zip(spread, full, strict=True)], pa.int64()) for w in range(WORDS)]
    bands = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(full * BANDS)]).astype(np.int32)), pa.array(band_keys(signatures).ravel()))
    return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), *words, bands], names=["doc_id", "n_shingles", "set_key", *BITS, "bands"])


def sketch(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, n_shingles, set_key (128-bit digest of the set), signature bits, band keys. Nulls after n_shingles without shingles."""
    raw = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, PART_ROWS):
                yield _sketched(batch.slice(at, PART_ROWS), k, hashes)

    return in_small_batches(raw).mapInArrow(run, f"doc_id bigint, n_shingles bigint, set_key binary, {', '.join(b + ' bigint' for b in BITS)}, bands array<bigint>")


def _can_link(similarity: int):
    """SQL over the columns of both ends of a pair: sizes and signature bits do not rule a link out."""
    bits = " + ".join(f"bit_count(a_{b} ^ b_{b})" for b in BITS)
    return F.expr(f"100 * least(a_n, b_n) >= {similarity} * greatest(a_n, b_n) AND {bits} <= {MOST_BITS}")


def _end(classes: DataFrame, side: str) -> DataFrame:
    return classes.select(F.col("node").alias(side), F.col("n_shingles").alias(f"{side}_n"), *[F.col(b).alias(f"{side}_{b}") for b in BITS])


def _small(df: DataFrame) -> DataFrame:
    """A hint to broadcast ``df``, a written table of ids, if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def verified(docs: DataFrame, pairs: DataFrame, k: int, similarity: int, label: str) -> DataFrame:
    """The rows of ``pairs`` (a, b; written, distinct) whose full sets reach 100 * intersection >= similarity * union.

    Texts of one centre a meet in groups of about GROUP, each with a copy of the
    centre's text, sorted so that the centre comes first.
    """
    groups = pairs.groupBy("a").agg(F.expr(f"ceil(count(*) / {GROUP}D)").alias("groups"))
    members = pairs.join(groups, "a").select("a", F.expr("pmod(xxhash64(b), groups)").alias("part"), F.col("b").alias("doc_id"))
    centres = groups.select("a", F.explode(F.expr("sequence(0L, groups - 1)")).alias("part")).select("a", "part", F.col("a").alias("doc_id"))
    need = materialise(members.unionByName(centres), f"{label}-need")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).join(_small(need), "doc_id")
    texts = texts.withColumn("member", F.col("doc_id") != F.col("a")).repartition("a", "part").sortWithinPartitions("a", "part", "member", "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        group, centre = None, []
        for batch in batches:
            found: tuple[list[int], list[int]] = ([], [])
            for a, part, doc_id, member, text in zip(*(batch.column(i) for i in range(5)), strict=True):
                here, own = (a.as_py(), part.as_py()), shingles(text.as_py(), k, hashes)
                if here != group:
                    group, centre = here, []
                if not member.as_py():
                    centre.append(own)
                    continue
                for other in centre:
                    both = len(np.intersect1d(other, own, assume_unique=True))
                    if both and 100 * both >= similarity * (len(other) + len(own) - both):
                        found[0].append(here[0])
                        found[1].append(doc_id.as_py())
                        break
            yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return materialise(in_small_batches(texts).select("a", "part", "doc_id", "member", "text").mapInArrow(run, "a bigint, b bigint").distinct(), f"{label}-links")


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """Connected components of ``links`` (a, b): node, component (the smallest node), for nodes other than that one.

    Turns of large-star and small-star, each over written tables, until no edge
    changes: O(log^2 n) turns at most, two or three for stars. Edges meet the
    minimum of their node by a shuffle, but for the nodes with more than one in
    HOT_SHARE of all edges: those are 2 * HOT_SHARE at most and are broadcast,
    so no task gets the edges of one large node.
    """
    edges = materialise(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    state = None
    while True:
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"), F.count("*").alias("n"))
        large = _met(both.where("v > u"), low, "u", 2 * now[0], f"{label}-low").where("v != low").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        large = materialise(large, label)
        low = large.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n"))
        small = _met(large, low, "u", now[0], f"{label}-low")
        small = small.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(low.select("u", F.col("low").alias("v")))
        edges = materialise(small.where("u != v").distinct(), label)


def _met(rows: DataFrame, table: DataFrame, key: str, n_rows: int, label: str) -> DataFrame:
    """``rows``, ``n_rows`` at most, joined with ``table``: one row a key, with n, the rows of the key. Keys with very many are broadcast."""
    most = max(LEAST_HOT, n_rows // HOT_SHARE)
    table = materialise(table, label)
    if not table.where(F.col("n") > most).take(1):
        return rows.join(table.drop("n"), key)
    hot = F.broadcast(table.where(F.col("n") > most).drop("n"))  # n_rows / most rows at most
    rest = rows.join(hot.select(key), key, "left_anti").join(table.where(F.col("n") <= most).drop("n"), key)
    met = rows.join(hot, key)
    return met.unionByName(rest.select(*met.columns))


def forest(linked: np.ndarray) -> list[tuple[int, int]]:
    """For a symmetric boolean matrix: (first, other) for each node and the first of its component, if that is another."""
    out, seen = [], np.zeros(len(linked), bool)
    for i in np.flatnonzero(linked.any(1)).tolist():
        if seen[i]:
            continue
        here = np.zeros(len(linked), bool)
        here[i] = True
        edge = here
        while edge.any():
            edge = linked[edge].any(0) & ~here
            here |= edge
        seen |= here
        out += [(i, j) for j in np.flatnonzero(here).tolist() if j != i]
    return out


def _blocked(rows: DataFrame, group: str, size: int) -> DataFrame:
    """``rows`` (``group``, node, component, ...; distinct) once for each pair of blocks that its block of the group is in: adds i <= j, the blocks, and ``block``.

    A component with more than ``size`` rows has blocks of its own, which are not
    paired with each other, as its members are joined already; the others
    share blocks. So one stray row beside a large component costs one row for
    each of its blocks, and the component's members are there once.
    """
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("n"))
    own = sizes.where(F.col("n") > size).withColumn("own", F.expr(f"ceil(n / {size}D)"))  # few: one in ``size`` rows of a group at most
    shared = sizes.groupBy(group).agg(F.expr(f"ceil(coalesce(sum(IF(n <= {size}, n, 0)), 0) / {size}D)").alias("shared"), F.expr(f"sum(IF(n > {size}, ceil(n / {size}D), 0))").alias("owned"))
    before = F.sum("own").over(Window.partitionBy(group).orderBy("component").rowsBetween(Window.unboundedPreceding, -1))
    own = own.select(F.col(group).alias("own_group"), F.col("component").alias("own_component"), "own", F.coalesce(before, F.lit(0)).alias("skipped"))
    spread = rows.join(shared, group).join(own, (F.col(group) == F.col("own_group")) & (F.col("component") == F.col("own_component")), "left")
    spread = spread.withColumn("start", F.expr("IF(own IS NULL, 0L, shared + skipped)")).withColumn("width", F.expr("coalesce(own, shared)")).withColumn("total", F.expr("shared + owned"))
    spread = spread.withColumn("block", F.expr("start + pmod(xxhash64(node, 3), width)"))
    others = F.expr("IF(own IS NULL, sequence(0L, total - 1), concat(IF(start > 0, sequence(0L, start - 1), array()), IF(start + width < total, sequence(start + width, total - 1), array())))")
    paired = spread.withColumn("other", F.explode(others))
    return paired.select(*rows.columns, "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))


def _by_group(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[list]]:
    """The rows of each run of equal first ``keys`` columns, column by column, over batch ends."""
    held: list[list] | None = None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if held is None or any(held[i][0] != row[i] for i in range(keys)):
                if held is not None:
                    yield held
                held = [[] for _ in row]
            for column, value in zip(held, row, strict=True):
                column.append(value)
    if held is not None:
        yield held


def _edges(found: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])


def _apart(component: np.ndarray, block: np.ndarray, i: int, j: int) -> np.ndarray:
    """Pairs of two components; where two blocks meet, only pairs across them."""
    out = component[:, None] != component[None, :]
    return out if i == j else out & (block[:, None] != block[None, :])


def families(open_: DataFrame, similarity: int) -> DataFrame:
    """node and family of the members of ``open_`` (bucket, node, component, n_shingles, signature bits) that pass the filters with a member of their bucket in another component."""
    columns = ["bucket", "i", "j", "node", "component", "block", "n_shingles", *BITS]
    rows = _blocked(open_, "bucket", BUCKET_BLOCK).select(*columns).repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, i, j, node, component, block, n, *bits in _by_group(batches, 3):
            n, bits = np.array(n), np.array(bits, np.int64).view(np.uint64)
            near = _apart(np.array(component), np.array(block), i[0], j[0])
            near &= 100 * np.minimum(n[:, None], n[None, :]) >= similarity * np.maximum(n[:, None], n[None, :])
            if near.any():
                differ = np.zeros(near.shape, np.uint16)
                for word in bits:
                    differ += np.bitwise_count(word[:, None] ^ word[None, :])
                near &= differ <= MOST_BITS
                yield _edges([(node[a], node[b]) for a, b in forest(near)])

    edges = in_small_batches(rows).mapInArrow(run, "a bigint, b bigint")
    inner = components(edges, "dup-families")
    return inner.select("node", F.col("component").alias("family")).unionByName(inner.select(F.col("component").alias("node"), F.col("component").alias("family")).distinct())


def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections of sorted distinct arrays, counting only values that two sets have."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    owner, every = owner[order], every[order]
    starts = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
    counts = np.diff(np.append(starts, len(every)))
    both = np.zeros((len(sets), len(sets)), np.float32)
    column = np.repeat(np.arange(len(starts)), counts)
    shared = np.repeat(counts > 1, counts)
    owner, column = owner[shared], column[shared]
    at = np.cumsum(np.diff(column, prepend=-1) != 0) - 1 if len(column) else column
    width = 4096
    for first in range(0, int(at[-1]) + 1 if len(at) else 0, width):
        a, z = np.searchsorted(at, [first, first + width])
        has = np.zeros((len(sets), width), np.float32)
        has[owner[a:z], at[a:z] - first] = 1
        both += has @ has.T
    return both.astype(np.int64)


def links_between(docs: DataFrame, classes: DataFrame, members: DataFrame, joined: DataFrame, k: int, similarity: int) -> DataFrame | None:
    """Links, enough to join what they join, between members of one bucket (bucket, b) that ``joined`` (node, component) has in different components; None if there are no candidates."""
    placed = members.select("bucket", F.col("b").alias("node")).join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    split = placed.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n")).where("low < high").select("bucket", "n")
    open_ = materialise(_met(placed, split, "bucket", members.count(), "dup-split").join(classes.select("node", "n_shingles", *BITS), "node"), "dup-open")
    if not open_.take(1):
        return None
    in_family = materialise(families(open_, similarity), "dup-family")
    if not in_family.take(1):
        return None
    rows = in_family.join(joined, "node", "left").select("family", "node", F.coalesce("component", "node").alias("component"))
    need = materialise(_blocked(rows, "family", FAMILY_BLOCK), "dup-need")
    texts = docs.select(F.col("doc_id").cast("long").alias("node"), text_bytes().alias("text")).join(_small(need), "node")
    texts = texts.select("family", "i", "j", "node", "component", "block", "text").repartition("family", "i", "j").sortWithinPartitions("family", "i", "j", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch_group in _by_group(_with_sets(batches, k, hashes), 3):
            _, i, j, node, component, block, held = batch_group
            sets = [np.frombuffer(s, np.uint64) for s in held]
            both, n = intersections(sets), np.array([len(s) for s in sets])
            linked = _apart(np.array(component), np.array(block), i[0], j[0]) & (both > 0) & (100 * both >= similarity * (n[:, None] + n[None, :] - both))
            if linked.any():
                yield _edges([(node[a], node[b]) for a, b in forest(linked)])

    return materialise(in_small_batches(texts).mapInArrow(run, "a bigint, b bigint").distinct(), "dup-second")


def _with_sets(batches: Iterator[pa.RecordBatch], k: int, hashes: WordHashes) -> Iterator[pa.RecordBatch]:
    """Batches with their last column, texts, replaced by the bytes of the texts' sets, a part at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(at, PART_ROWS)
            sets = pa.array([shingles(t.as_py(), k, hashes).tobytes() for t in part.column(part.num_columns - 1)], pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], sets], names=part.schema.names)


def near_duplicates(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """Groups of near-duplicate rows of ``docs`` (doc_id, text; other columns are ignored).

    Words are runs without white space, A-Z lower-cased; a document's set is its
    distinct k-word shingles (the whole text, if shorter). Documents are linked
    at 100 * intersection >= similarity * union. Returns doc_id, n_shingles,
    component_id (the smallest doc_id reachable by links, itself included), kept
    (doc_id is component_id).

    Null and empty texts: no shingles, linked with nothing, kept. Rows that share
    a doc_id count as linked. A row without a doc_id joins the component of rows
    with an equal set, and is kept only if there is none. Empty input: no rows.
    """
    rows = materialise(sketch(docs, k), "dup-sketch")
    sets = rows.where("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("node"), *[F.first(c).alias(c) for c in ("n_shingles", *BITS, "bands")])
    classes = materialise(sets, "dup-classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.min("node").alias("a"), F.max("node").alias("last"), F.count("*").alias("n")).where("a < last").select("bucket", "a", "n")
    members = _met(banded, shared, "bucket", BANDS * classes.count(), "dup-shared")
    members = materialise(members.select("bucket", "a", F.col("node").alias("b")), "dup-members")

    pairs = members.where("a != b").select("a", "b").distinct().join(_end(classes, "a"), "a").join(_end(classes, "b"), "b").where(_can_link(similarity)).select("a", "b").distinct()
    links = verified(docs, materialise(pairs, "dup-pairs"), k, similarity, "dup-first")
    joined = components(links)

    more = links_between(docs, classes, members, joined, k, similarity)
    if more is not None:
        joined = components(links.unionByName(more))

    found = classes.select("set_key", "node").join(joined, "node", "left").select("set_key", F.coalesce("component", "node").alias("component"))
    out = rows.select("doc_id", "n_shingles", "set_key").join(found, "set_key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def keep_one(docs: DataFrame, k: int = 5, similarity: int = 80) -> DataFrame:
    """``docs`` with one document of each group of near-duplicates, the one with the smallest doc_id; columns as they were.

    Of rows that share a doc_id one stays. Of rows without a doc_id, those in the
    group of a row that has one go, and the others stay.
    """
    found = materialise(near_duplicates(docs, k, similarity), "dup-result")
    dropped = materialise(found.where("NOT kept AND doc_id IS NOT NULL").select(F.col("doc_id").alias("dropped_id")).distinct(), "dup-dropped")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("own_id"))
    kept = whole.join(_small(dropped), F.col("own_id") == F.col("dropped_id"), "left_anti").select("row.*")
    repeats = found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeats:
        named = kept.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
        kept = named.unionByName(kept.where("doc_id IS NULL"))
    return kept
