"""Mixing sources to target weights by pivotal dependent rounding.

A source with target T and S words wants T / S copies of each document. The
whole part is fixed; the fraction is rounded by pairs: two documents trade
words, in a random direction whose odds keep every expectation, until one of
them has a whole number of copies. The words of a pair are the same before and
after, so a source's words stay at its target but for the one document that is
left at the root of the reduction tree, rounded to the nearer side. What that
leaves is worked off at the root: from the longest on, a settled document there
is taken once more or once less if that brings the source nearer to its target.

Equal rows (id, source and size) are rounded among themselves first, which
needs no draw: as many as their fractions add up to are taken once more, and
the rest of the sum is the fraction of one of them, which goes into the tree.

The tree: documents are dealt by hash into chunks of about ``CHUNK``; a fold
settles all of a chunk but one residual; residuals of ``CHUNK`` chunks meet in
the next level; one chunk waits for the root, so that the last residual meets
ordinary documents and not only other residuals. No task sees more than two
chunks of one source, however large the source. DataFrame and SQL functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coffer.llm.common import WORD, global_rank, materialise

CHUNK = 128
#: Weights of the sources in code point order, repeating.
WEIGHTS = (3, 1, 2)
#: Rows of a plan up to which it is broadcast (some 50 bytes each).
BROADCAST_ROWS = 200_000

#: Rows of a key that are made at once.
RUN = 4096


def _types(kind: str) -> tuple[str, str]:
    """SQL types of an open item and of a settled one, for ids of type ``kind``."""
    return f"struct<h: bigint, doc_id: {kind}, size: bigint, p: double>", f"struct<h: bigint, doc_id: {kind}, size: bigint, up: int>"


def _order() -> str:
    """SQL: longest first, so a long open document meets ever shorter ones until their small trades settle it; the order does not depend on how rows arrive."""
    return """(l, r) -> CASE WHEN l.size <> r.size THEN IF(l.size > r.size, -1, 1) WHEN l.h <> r.h THEN IF(l.h < r.h, -1, 1)
  WHEN l.doc_id <=> r.doc_id THEN 0 ELSE IF(coalesce(l.doc_id < r.doc_id, l.doc_id IS NULL), -1, 1) END"""


def _open(x: str, p: str) -> str:
    """SQL: item ``x`` with the fraction ``p``."""
    return f"named_struct('h', {x}.h, 'doc_id', {x}.doc_id, 'size', {x}.size, 'p', {p})"


def _settled(x: str, up: str) -> str:
    """SQL: item ``x``, rounded down or up."""
    return f"named_struct('h', {x}.h, 'doc_id', {x}.doc_id, 'size', {x}.size, 'up', {up})"


def _step(seed: int) -> str:
    """SQL of one step of the fold over (acc, it).

    a is the open item, b the next; up: words that can go from b to a; down: from
    a to b. Going up has the odds down / (up + down), so no expectation moves.
    """
    a, b = "acc.open", "it"
    settle = lambda x, up: f"concat(acc.done, array({_settled(x, str(up))}))"
    up, down = f"least({a}.size * (1 - {a}.p), {b}.size * {b}.p)", f"least({a}.size * {a}.p, {b}.size * (1 - {b}.p))"
    draw = f"pmod(xxhash64({a}.h, {b}.h, {seed}), 9007199254740992) / 9007199254740992D"
    both = f"named_struct('a', {a}, 'b', {b}, 'up', {up}, 'down', {down}, 'u', {draw})"
    return f"""CASE WHEN acc.open IS NULL THEN named_struct('open', it, 'done', acc.done)
    ELSE transform(array({both}), s -> CASE
      WHEN s.u * (s.up + s.down) < s.down AND s.up >= s.a.size * (1 - s.a.p)
        THEN named_struct('open', {_open("s.b", "greatest(0D, s.b.p - s.up / s.b.size)")}, 'done', {settle("s.a", 1)})
      WHEN s.u * (s.up + s.down) < s.down
        THEN named_struct('open', {_open("s.a", "least(1D, s.a.p + s.up / s.a.size)")}, 'done', {settle("s.b", 0)})
      WHEN s.down >= s.a.size * s.a.p
        THEN named_struct('open', {_open("s.b", "least(1D, s.b.p + s.down / s.b.size)")}, 'done', {settle("s.a", 0)})
      ELSE named_struct('open', {_open("s.a", "greatest(0D, s.a.p - s.down / s.a.size)")}, 'done', {settle("s.b", 1)})
    END)[0] END"""


def _root(done_kind: str) -> str:
    """SQL: all settled items of a root's fold ``f``, its open item among them, with its excess or lack of words worked off."""
    last = _settled("f.open", "IF(f.open.p >= 0.5D, 1, 0)")
    every = f"array_sort(concat(f.done, array({last})), {_order()})"
    start = f"named_struct('off', f.open.size * (IF(f.open.p >= 0.5D, 1D, 0D) - f.open.p), 'done', CAST(array() AS array<{done_kind}>))"
    moved = "acc.off + IF(it.up = 1, -1D, 1D) * it.size"
    step = f"""IF(abs({moved}) < abs(acc.off), named_struct('off', {moved}, 'done', concat(acc.done, array({_settled("it", "1 - it.up")}))),
      named_struct('off', acc.off, 'done', concat(acc.done, array(it))))"""
    return f"aggregate({every}, {start}, (acc, it) -> {step}).done"


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row for each source of ``sizes`` (source, size): n_docs, source_size, weight, target.

    Weights repeat over the sources by code point, null last. Targets share
    ``share`` of all words by weight; none is above ``most`` times its source,
    and what is cut goes to the others by weight. Solved in closed form: with
    sources in the order of limit / weight, the first k stop at their limit and
    the others get lambda * weight, for the first k at which that fits.
    The frame has one row a source, so its windows need no partitions.
    """
    by_source = sizes.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").cast("binary").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    listed = by_source.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int")))
    listed = listed.withColumns({"limit": F.col("source_size") * F.lit(float(most)), "stop": F.col("source_size") * F.lit(float(most)) / F.col("weight")})
    everything = Window.partitionBy()
    order = Window.orderBy("stop", F.col("source").cast("binary").asc_nulls_last())
    before, onward = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.sum("source_size").over(everything) * F.lit(float(share))
    level = (budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(onward)
    solved = listed.withColumn("level", level).withColumn("fits", F.col("level") <= F.col("stop"))
    first = F.min(F.when(F.col("fits"), F.struct("stop", "level"))).over(everything)
    solved = solved.withColumn("level", first["level"])
    return solved.select("source", "n_docs", "source_size", "weight", F.coalesce(F.least("limit", F.col("level") * F.col("weight")), F.col("limit"), F.lit(0.0)).alias("target"))


def round_up(items: DataFrame, seed: int) -> DataFrame:
    """Which of ``items`` (source, doc_id, size > 0, n_docs, p: 0 < p < 1) are taken once more: returns source, doc_id, size, up (0 or 1).

    A source's words are those wanted, the sum of size * p, to within half an
    item, and nearer if it has items to work that off. n_docs: items of the
    source, or more.
    """
    open_kind, done_kind = _types(items.schema["doc_id"].dataType.simpleString())
    head = items.withColumn("h", F.xxhash64("doc_id", "size", F.lit(seed)))
    level = head.select("source", F.expr(f"pmod(h, ceil(n_docs / {CHUNK}D))").alias("chunk"), F.expr(f"ceil(n_docs / {CHUNK}D)").alias("chunks"), F.struct("h", "doc_id", "size", "p").cast(open_kind).alias("item"))
    zero = f"named_struct('open', CAST(NULL AS {open_kind}), 'done', CAST(array() AS array<{done_kind}>))"
    # One chunk of a source that has several waits for the root, where its documents settle the residuals of the others.
    waits = (F.col("chunk") == 0) & (F.col("chunks") > 1)
    held, level = level.where(waits), level.where(~waits)
    settled, step = [], 0
    while step == 0 or level.take(1) or held.take(1):
        fold = F.expr(f"aggregate(array_sort(items, {_order()}), {zero}, (acc, it) -> {_step(seed + step)})")
        folded = level.groupBy("source", "chunk", "chunks").agg(F.collect_list("item").alias("items")).select("source", "chunk", "chunks", fold.alias("f"))
        folded = materialise(folded, f"mix-level{step}")
        last = F.col("chunks") <= 1
        settled.append(folded.select("source", F.explode(F.when(last, F.expr(_root(done_kind))).otherwise(F.col("f.done"))).alias("d")).select("source", "d.doc_id", "d.size", "d.up"))
        up = [F.expr(f"pmod(chunk, ceil(chunks / {CHUNK}D))").alias("chunk"), F.expr(f"ceil(chunks / {CHUNK}D)").alias("chunks")]
        held = held.select("source", *up, "item")
        level = folded.where(~last).select("source", *up, F.col("f.open").alias("item")).unionByName(held.where(last))
        held = held.where(~last)
        step += 1
    return reduce(DataFrame.unionByName, settled)


def _words() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def _same(columns: tuple[str, ...], left: str, right: str) -> Column:
    """All ``columns`` of two aliased frames are equal, or null in both."""
    return reduce(lambda x, y: x & y, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in columns])


def plan_mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """Copies for each distinct (doc_id, source, size) of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns doc_id (of any type that can be compared), source, size (words; null
    text 0), source_size, target, and for the n_rows rows that have these three:
    n_up of them are taken whole + 1 times, the others whole times. Texts without
    words are taken 0 times. Null source is a source of its own, the last.
    """
    base = docs.select("doc_id", F.col("source").cast("string").alias("source"), _words().alias("size"))
    base = materialise(base.groupBy("doc_id", "source", "size").agg(F.count("*").alias("n_rows")), "mix-base")
    sources = materialise(source_targets(base.select("source", (F.col("size") * F.col("n_rows")).alias("size")), share, most), "mix-sources")
    joined = base.alias("d").join(sources.alias("s"), _same(("source",), "d", "s")).select("d.source", "d.doc_id", "d.size", "d.n_rows", "s.n_docs", "s.source_size", "s.target")
    wanted = F.when(F.col("size") > 0, F.least(F.lit(float(most)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    full = joined.withColumn("x", wanted).withColumn("whole", F.floor("x").cast("int"))
    sums = F.col("n_rows") * (F.col("x") - F.col("whole"))
    full = full.withColumn("sure", F.least(F.floor(sums), F.col("n_rows") - 1)).withColumn("p", sums - F.col("sure"))
    full = materialise(full, "mix-wanted")
    rounded = materialise(round_up(full.where("p > 0").select("source", "doc_id", "size", "n_docs", "p"), seed), "mix-rounded")
    out = full.alias("r").join(rounded.alias("u"), _same(("source", "doc_id", "size"), "r", "u"), "left")
    return out.select("r.doc_id", "r.source", "r.size", "r.n_rows", "r.source_size", "r.target", "r.whole", (F.col("r.sure") + F.coalesce("u.up", F.lit(0))).alias("n_up"))


def mix(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """How often the mix takes each row of ``docs`` (doc_id, text, source; other columns are ignored).

    Returns doc_id, source, size, source_size, target, copies, taken (copies *
    size), one row for each row of ``docs``. Nulls: see ``plan_mix``. Empty input
    gives no rows. Same input, same result.
    """
    plan = plan_mix(docs, share, most, seed)
    runs = plan.withColumn("first", F.explode(F.expr(f"sequence(0L, n_rows - 1, {RUN}L)")))
    rows = runs.withColumn("each", F.explode(F.expr(f"sequence(first, least(first + {RUN}, n_rows) - 1)")))
    copies = F.col("whole") + F.when(F.col("each") < F.col("n_up"), 1).otherwise(0)
    return rows.withColumn("copies", copies).select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_rows(docs: DataFrame, share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; columns as they were.

    The plan is joined to the documents by broadcast while it has few enough
    rows, and by a shuffle beyond. Where rows with equal id, source and size
    differ in their copies, they are numbered by one range shuffle of those rows.
    """
    key = ("doc_id", "source", "size")
    plan = plan_mix(docs, share, most, seed).select(*[F.col(c).alias(f"k_{c}") for c in key], "n_rows", "whole", "n_up")
    plan = materialise(plan.where("whole + n_up > 0"), "mix-plan")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("d_doc_id"), F.col("source").cast("string").alias("d_source"), _words().alias("d_size"))
    split = F.col("n_rows") * F.col("n_up") != F.col("n_up") * F.col("n_up")  # some rows of the key up, some not
    alike = plan.where(~split).select(*[f"k_{c}" for c in key], (F.col("whole") + F.when(F.col("n_up") > 0, 1).otherwise(0)).alias("copies"))
    out = whole.join(_few(alike), _keyed("d", "k")).select("row", "copies")
    apart = plan.where(split)
    if apart.take(1):
        rows = whole.join(_few(apart), _keyed("d", "k")).select("row", *[f"k_{c}" for c in key], "whole", "n_up", F.monotonically_increasing_id().alias("place"))
        rows = materialise(rows, "mix-apart")
        ranked, _ = global_rank(rows, [*[f"k_{c}" for c in key], "place"], "mix-order")
        first = materialise(ranked.groupBy(*[f"k_{c}" for c in key]).agg(F.min("global_rank").alias("first")), "mix-first").select(*[F.col(f"k_{c}").alias(f"f_{c}") for c in key], "first")
        numbered = ranked.join(_few(first), _keyed("k", "f"))
        out = out.unionByName(numbered.select("row", (F.col("whole") + F.when(F.col("global_rank") - F.col("first") < F.col("n_up"), 1).otherwise(0)).alias("copies")))
    return out.where("copies > 0").select("row", F.explode(F.expr("sequence(1, copies)")).alias("copy")).select("row.*")


def _keyed(left: str, right: str) -> Column:
    return reduce(lambda x, y: x & y, [F.col(f"{left}_{c}").eqNullSafe(F.col(f"{right}_{c}")) for c in ("doc_id", "source", "size")])


def _few(df: DataFrame) -> DataFrame:
    """A hint to broadcast ``df``, made from a written table, if it has few enough rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df
