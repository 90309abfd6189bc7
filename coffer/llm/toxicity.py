"""Toxicity by nearest labelled examples.

Texts are TF-IDF vectors over all words that the examples have, a bounded
sample of labelled texts: a word weighs (1 + log of its count in the text) *
idf * relevance. Document frequencies are counted over all documents. The
relevance of a word is FLOOR plus the square of its log-odds z between toxic and
clean examples, in parts of the strongest word's: without it, words of the
subject outweigh the few words that make a text toxic. No word is left out; one
that no example has weighs as a word of no document would, and makes the
vector longer.

An inverted index over the examples holds, for each term and block of examples,
the largest weight. Postings of rarer terms are summed for all examples; blocks
that cannot reach the k best with the frequent terms' largest weights are passed
over. So the k nearest by cosine are exact. Their votes count by
1 / (distance + NEAR), and a logistic fit to leave-one-out votes turns the vote
into a score.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, LongType

from coffer.llm.common import in_small_batches, materialise, parts, text_bytes

#: Labelled texts taken of each class at most, by the smallest hash of their doc_id.
SAMPLE = 1024
#: Relevance of a word that says nothing about toxicity, where the strongest word has 1 more.
FLOOR = 0.1
NEIGHBOURS = 15
#: Examples in a block, and the terms with the longest postings that are passed over by blocks.
BLOCK, FREQUENT = 256, 512
#: Examples held in single precision beyond those asked for, and what its rounding can change.
SPARE, DOUBT = 17, 1e-5
#: Texts that are searched for at once.
TOGETHER = 256
NEAR = 0.05
THRESHOLD = 0.7

_SPLIT = bytes(ord(chr(c).lower()) if c < 128 and chr(c).isalnum() else c if c >= 128 else 32 for c in range(256))
#: Bytes that begin no character of three or four bytes.
_SHORT = bytes(range(0xE0))
#: Scripts that mostly write without spaces: Thai to Khmer, and from CJK radicals on to Hangul and the CJK planes.
_UNSPACED = re.compile("[\u0e00-\u109f\u1780-\u17ff\u2e80-\ufaff\U00020000-\U0003ffff]+")


def _pairs(run: re.Match) -> str:
    """A run of characters as its overlapping pairs, with spaces around them."""
    text = run.group()
    return " " + " ".join(text[i : i + 2] for i in range(max(1, len(text) - 1))) + " "


def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all other characters above ASCII; runs of scripts without spaces as pairs of characters."""
    if not text.isascii():
        lower = text.decode("utf-8", "replace").lower()
        text = (_UNSPACED.sub(_pairs, lower) if text.translate(None, _SHORT) else lower).encode()
    return text.translate(_SPLIT).split()


def _ranges(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one after another."""
    n = ends - starts
    total = int(n.sum())
    return np.arange(total) + np.repeat(starts - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if total else np.empty(0, np.int64)


class BlockMaxIndex:
    """Unit vectors of ``size`` examples by term: postings (``starts`` by term, ``rows``, ``weights``), and each term's largest weight in each block."""

    def __init__(self, size: int, n_terms: int, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> None:
        order = np.lexsort((rows, terms))
        self.size, self.n_terms = size, n_terms
        self.rows, self.weights = rows[order], weights[order]
        self.starts = np.searchsorted(terms[order], np.arange(n_terms + 1))
        lengths = np.diff(self.starts)
        #: The place of a term among the frequent ones, or -1.
        self.place = np.full(n_terms, -1)
        often = np.argsort(-lengths, kind="stable")[:FREQUENT]
        self.place[often] = np.arange(len(often))
        blocks = max(1, -(-size // BLOCK))
        self.exact = np.zeros((blocks * BLOCK, len(often)))
        for i, t in enumerate(often.tolist()):
            part = slice(self.starts[t], self.starts[t + 1])
            self.exact[self.rows[part], i] = self.weights[part]
        self.table = np.ascontiguousarray(self.exact.T, np.float32)
        self.most = self.table.reshape(len(often), blocks, BLOCK).max(2)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, without: list[int] | None = None) -> list[list[tuple[float, int]]]:
        """For each query (terms, weights): the k largest positive dot products with their example numbers; ties to the smaller number.

        Blocks are searched in single precision for more than k; those are scored
        again in double precision, or all examples where rounding leaves a doubt.
        """
        m, blocks = len(queries), self.most.shape[1]
        width, held = blocks * BLOCK, k + SPARE
        who = np.repeat(np.arange(m), [len(t) for t, _ in queries])
        terms = np.concatenate([np.empty(0, np.int64), *[t for t, _ in queries]])
        weights = np.concatenate([np.empty(0), *[w for _, w in queries]])
        place = self.place[terms]
        often = place >= 0
        dense = np.zeros((m, len(self.table)))
        dense[who[often], place[often]] = weights[often]
        single = dense.astype(np.float32)
        who, terms, weights = who[~often], terms[~often], weights[~often]
        a, z = self.starts[terms], self.starts[terms + 1]
        at = _ranges(a, z)
        sums = np.bincount(np.repeat(who * width, z - a) + self.rows[at], np.repeat(weights, z - a) * self.weights[at], m * width).reshape(m, blocks, BLOCK)
        if without is not None:
            sums.reshape(m, width)[np.arange(m), without] = -2  # below what the other terms can add
        bound = single @ self.most + sums.max(2) + DOUBT
        best, ids = np.zeros((m, held), np.float32), np.full((m, held), width - 1)
        for b in np.argsort(-bound.sum(0), kind="stable").tolist():
            reach = np.flatnonzero((bound[:, b] > DOUBT) & (bound[:, b] >= best[:, -1]))
            if not len(reach):
                continue
            scores = single[reach] @ self.table[:, b * BLOCK : (b + 1) * BLOCK]
            scores += sums[reach, b]
            # Only scores that can be among the best are sorted.
            hit, column = np.nonzero(scores > np.maximum(best[reach, -1:], 1e-9))
            owner = np.concatenate([np.repeat(reach, held), reach[hit]])
            every = np.concatenate([best[reach].ravel(), scores[hit, column]])
            number = np.concatenate([ids[reach].ravel(), b * BLOCK + column])
            order = np.lexsort((-every, owner))
            owner = owner[order]
            kept = order[np.arange(len(owner)) - np.searchsorted(owner, owner) < held]
            best[reach], ids[reach] = every[kept].reshape(-1, held), number[kept].reshape(-1, held)
        out = []
        for q in range(m):
            if best[q, -1] > max(0.0, best[q, k - 1] - DOUBT):  # as good as the k-th: others may be too
                numbers = np.arange(width)
            else:
                numbers = ids[q][best[q] > 0]
            scores = np.round(self.exact[numbers] @ dense[q] + sums.reshape(m, width)[q, numbers], 12)
            order = np.lexsort((numbers, -scores))[:k]
            out.append([(s, i) for s, i in zip(scores[order].tolist(), numbers[order].tolist(), strict=True) if s > 0])
        return out


@dataclass
class Model:
    """What scoring needs; its size is bounded by the texts of SAMPLE examples a class."""

    words: list[bytes] = field(default_factory=list)
    #: idf * relevance of each word, and of a word that no example has.
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    unseen: float = 1.0
    ids: list = field(default_factory=list)
    toxic: list[int] = field(default_factory=list)
    #: The examples' vectors: example, word and weight of each entry.
    entries: tuple[np.ndarray, np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)))
    balance: tuple[float, float] = (1.0, 1.0)
    base: float = 0.5
    slope: float = 0.0
    offset: float = 0.0
    id_kind: DataType = field(default_factory=LongType)

    @cached_property
    def lookup(self) -> dict[bytes, int]:
        return {w: i for i, w in enumerate(self.words)}

    @cached_property
    def index(self) -> BlockMaxIndex:
        return BlockMaxIndex(len(self.ids), len(self.words), *self.entries)

    def vector(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """TF-IDF of unit length: the words that examples have, and their weights."""
        counts = Counter(words_of(text))
        number = np.fromiter(map(self.lookup.get, counts, repeat(-1)), np.int64, len(counts))
        times = 1 + np.log(np.fromiter(counts.values(), np.float64, len(counts)))
        seen = number >= 0
        weights = times[seen] * self.weights[number[seen]]
        norm = math.sqrt(float(weights @ weights) + self.unseen**2 * float(times[~seen] @ times[~seen])) or 1.0
        return number[seen], weights / norm

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Distance-weighted share of toxic neighbours; neighbours that are missing vote with the base rate from distance 1."""
        far = (NEIGHBOURS - len(near)) / (1 + NEAR)
        top, all_ = far * self.base, far
        for similarity, i in near:
            w = self.balance[self.toxic[i]] / (max(0.0, 1 - similarity) + NEAR)
            top, all_ = top + w * self.toxic[i], all_ + w
        return top / all_

    def score(self, vote: float) -> float:
        z = max(-30.0, min(30.0, self.slope * vote + self.offset))
        return 1 / (1 + math.exp(-z))

    def calibrate(self) -> None:
        """Logistic fit of the labels to leave-one-out votes, by Newton steps on smoothed targets."""
        n1, n0 = sum(self.toxic), len(self.toxic) - sum(self.toxic)
        self.slope, self.offset = 0.0, math.log(self.base / (1 - self.base))
        if not n1 or not n0:
            return
        cuts = np.searchsorted(self.entries[0], np.arange(len(self.ids) + 1))
        votes = []
        for at in range(0, len(self.ids), TOGETHER):
            own = list(range(at, min(at + TOGETHER, len(self.ids))))
            found = self.index.nearest([(self.entries[1][cuts[i] : cuts[i + 1]], self.entries[2][cuts[i] : cuts[i + 1]]) for i in own], NEIGHBOURS, own)
            votes += [self.vote(near) for near in found]
        x, y = np.array(votes), np.array(self.toxic, float)
        w = np.where(y > 0, self.balance[1], self.balance[0])
        target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        beta = np.array([0.0, self.offset])
        design = np.stack([x, np.ones_like(x)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
            hessian = design.T @ (design * (w * p * (1 - p) + 1e-9)[:, None]) + np.diag([1e-3, 1e-9])
            move = np.linalg.solve(hessian, design.T @ (w * (target - p)) - np.array([1e-3 * beta[0], 0]))
            beta = beta + np.clip(move, -5, 5)
            if np.abs(move).max() < 1e-6:
                break
        self.slope, self.offset = float(max(beta[0], 0.0)), float(beta[1])


def relevance(clean: np.ndarray, toxic: np.ndarray, n_clean: int, n_toxic: int) -> np.ndarray:
    """FLOOR and the square of the log-odds z of words that ``clean`` and ``toxic`` examples have, in parts of the largest."""
    a, b, c, d = toxic + 0.5, n_toxic - toxic + 0.5, clean + 0.5, n_clean - clean + 0.5
    z = np.log(a * d / (b * c)) / np.sqrt(1 / a + 1 / b + 1 / c + 1 / d)
    return FLOOR + np.square(z / max(1e-9, np.abs(z).max(initial=0)))


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """Rows that nothing is learnt from: the CRC-32 of the id as text leaves 1 when divided by 3. A null id is not held out."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit a model to ``labels`` (doc_id, toxic) and the texts of ``docs`` (doc_id, text), without the held-out rows.

    Labels other than 0 and 1 and null ids are passed over; of several labels for
    an id the larger counts; equal texts are one example. Without labels of both
    classes every score is the smoothed rate of toxic labels.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = materialise(known, "toxic-labels")
    found = {int(r["toxic"]): int(r["count"]) for r in known.groupBy("toxic").count().collect()}
    n0, n1 = found.get(0, 0), found.get(1, 0)
    base = (n1 + 1) / (n0 + n1 + 2)
    pick = lambda c: known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    chosen = pick(0).unionByName(pick(1))  # 2 * sample rows at most
    texts = docs.select("doc_id", text_bytes().alias("text")).join(F.broadcast(chosen), "doc_id").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.max("toxic").alias("toxic"))
    texts = materialise(texts, "toxic-sample")
    listed = sorted(((int(r["toxic"]), r["doc_id"]) for r in texts.select("toxic", "doc_id").collect()))  # alike examples side by side make tighter blocks
    toxic = np.array([t for t, _ in listed], np.int64)
    s0, s1 = int((toxic == 0).sum()), int(toxic.sum())
    if not s0 or not s1:
        model = Model(base=base)
        model.calibrate()
        return model

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts(batches):
            held = [Counter(words_of(t)) for t in batch.column(1).to_pylist()]
            owner = pa.array(np.repeat(np.arange(len(held)), [len(c) for c in held]))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(owner), pa.array([w for c in held for w in c], pa.binary()), pa.array([n for c in held for n in c.values()], pa.int32())], names=["doc_id", "word", "n"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    counted = in_small_batches(texts).select("doc_id", "text").mapInArrow(count, f"doc_id {kind}, word binary, n int").toArrow()
    coded = counted.column("word").combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    by_name = pc.array_sort_indices(coded.dictionary)
    sorted_place = np.empty(len(by_name), np.int64)
    sorted_place[by_name.to_numpy()] = np.arange(len(by_name))
    words: list[bytes] = coded.dictionary.take(by_name).to_pylist()
    term = sorted_place[coded.indices.to_numpy(zero_copy_only=False)]
    place = {doc_id: i for i, (_, doc_id) in enumerate(listed)}
    ids = counted.column("doc_id").combine_chunks().dictionary_encode()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    owner = np.array([place[d] for d in ids.dictionary.to_pylist()], np.int64)[ids.indices.to_numpy(zero_copy_only=False)]
    times = 1 + np.log(counted.column("n").to_numpy().astype(np.float64))
    del counted, coded, ids
    pa.default_memory_pool().release_unused()

    shared = docs.sparkSession.sparkContext.broadcast(words)

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup, seen, df = {w: i for i, w in enumerate(shared.value)}, 0, np.zeros(len(shared.value) + 1, np.int64)
        for batch in parts(batches):
            held = [set(words_of(text)) for text in batch.column(0).to_pylist()]
            for have in held:
                df[np.fromiter(map(lookup.get, have, repeat(-1)), np.int64, len(have))] += 1
            seen += len(held)
        df[-1] = seen
        met = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(df[met])], names=["term", "n"])

    counts = in_small_batches(docs).select(text_bytes().alias("text")).mapInArrow(frequencies, "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(words) + 1)
    df[counts.column("term").to_numpy()] = counts.column("n").to_numpy()
    total = df[-1]
    shared.unpersist()
    in_toxic = np.bincount(term, toxic[owner], len(words))
    weights = (np.log((1 + total) / (1 + df[:-1])) + 1) * relevance(np.bincount(term, minlength=len(words)) - in_toxic, in_toxic, s0, s1)
    order = np.lexsort((term, owner))
    owner, term, entry = owner[order], term[order], (times * weights[term])[order]
    entry /= np.sqrt(np.bincount(owner, entry * entry, len(listed)))[owner]
    model = Model(words, weights, (math.log(1 + total) + 1) * FLOOR, [d for _, d in listed], toxic.tolist(), (owner, term, entry), (n0 / s0, n1 / s1), base, id_kind=texts.schema["doc_id"].dataType)
    model.calibrate()
    model.__dict__.pop("index", None)  # made anew where it is used
    del order, in_toxic, counts
    pa.default_memory_pool().release_unused()
    return model


def score(df: DataFrame, text: str, keep: list[Column], names: list[str], model: Model, evidence: int = 3) -> DataFrame:
    """Score each row's whole text: the columns ``keep`` under ``names``, then score, predicted and evidence.

    evidence: the nearest examples (doc_id, similarity, toxic). Null and empty
    texts, and texts that share no word with any example, have none and get the
    score of the base rate's vote. ``names`` must not have the three names added
    here. doc_id in the evidence has the type that the labels' ids have.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)
    narrow = df.select(*[c.alias(n) for c, n in zip(keep, names, strict=True)], text_bytes(text).alias("scored_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in narrow.schema.fields[:-1])
    id_kind = model.id_kind
    proof = pa.list_(pa.struct([("doc_id", to_arrow_type(id_kind)), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in parts(batches, TOGETHER):
            found = m.index.nearest([m.vector(t) for t in batch.column(batch.num_columns - 1).to_pylist()], NEIGHBOURS) if m.ids else [[]] * batch.num_rows
            scores = np.array([m.score(m.vote(near)) for near in found], float)
            shown = [[{"doc_id": m.ids[i], "similarity": s, "toxic": m.toxic[i]} for s, i in near[:evidence]] for near in found]
            columns = [batch.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores), pa.array((scores >= THRESHOLD).astype(np.int32)), pa.array(shown, proof)], names=[*names, "score", "predicted", "evidence"])

    return in_small_batches(narrow).mapInArrow(run, f"{kinds}, score double, predicted int, evidence array<struct<doc_id: {id_kind.simpleString()}, similarity: double, toxic: int>>")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted and evidence for each row of ``docs`` (doc_id, text); the model learns from ``labels`` (doc_id, toxic).

    Null texts count as empty. Null and repeated doc_ids stay as they are. Empty
    ``docs``: no rows.
    """
    model = learn(docs, labels)
    return score(docs, "text", [F.col("doc_id"), held_out()], ["doc_id", "held_out"], model)


def keep_clean(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that are predicted toxic; columns and clean rows as they were."""
    model = learn(docs, labels)
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    return score(docs, "text", [whole], ["row"], model).where(F.col("predicted") == 0).select("row.*")
