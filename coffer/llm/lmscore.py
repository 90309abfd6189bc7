"""Language-model scores by masked pseudo-likelihood.

A small network sees the two words on either side of a place and predicts the
word between them: position-wise embeddings, one tanh layer, and a two-level
softmax over classes and words of a class. A document's score is the sum, over
all its places, of the log-probability of the true word given both sides.

The vocabulary comes from counts of all words of the corpus and grows with it:
a word is known if it occurs at least a tenth of the square root of the number of
words, and classes, words of a class and buckets follow. Other words fall into
hash cells, and cells into buckets; a word's share of its bucket is what its
cell occurs among all words of the bucket, shared equally by the cell's words.
Cells are twice the distinct words, up to MOST_CELLS.

Documents are encoded once. Training deals them by a hash of the row into
lanes; each lane trains a copy in numpy on windows of all its documents in the
order of the hashes, and the copies are averaged by the number of windows, in
whole numbers, over a tree of groups. So the result does not depend on how the
rows are partitioned. Lanes are as many as the corpus has words for, each with
LANE_WORDS of them or, if that is more, LANE_SHARE times the words that there are
weights: so the copies stay a small part of the corpus. What is gathered - word
counts and copies - grows with the corpus; scoring needs the vocabulary and one copy.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import in_small_batches, materialise, text_bytes

# The smallest network; ``sizes`` has those of larger corpora.
CLASSES, PER_CLASS = 32, 32
VOCABULARY = CLASSES * PER_CLASS
BUCKETS = 256
KNOWN = VOCABULARY - BUCKETS
#: The last row of the embeddings, however many there are.
PAD = -1
#: A word is known from sqrt(words of the corpus) / COMMON occurrences on.
COMMON = 10
SIDE = 2
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
#: One place in STRIDE of each document is trained on in a round, and each round has its own: together they train on every place once.
ROUNDS = 2
STRIDE = ROUNDS
#: Places in a step: as many as leave STEPS of them in a lane and round, within these bounds.
BATCH, LEAST_BATCH, STEPS = 8192, 4096, 200
RATE = 0.15
SEED = 4242
#: Weights are averaged as multiples of 2^-20; a block has so many of them.
UNIT, BLOCK = 1 << 20, 4096
LANE_WORDS, LANE_SHARE = 1 << 21, 4
#: Places whose class logits are held at once: few enough to stay in a cache.
ROWS = 1024
#: Words that a lane turns into one stream at once.
PART_WORDS = 1 << 17
#: Hash cells of words that are not known: 8 bytes each on the driver, 4 in a worker.
LEAST_CELLS, MOST_CELLS = 1 << 10, 1 << 21
_MOST_WORDS = 200_000

_SPLIT = bytes((c + 32 if 65 <= c <= 90 else c) if chr(c).isalnum() or c >= 128 else 32 for c in range(256))


def shapes(side: int = CLASSES) -> dict[str, tuple[int, ...]]:
    """Shapes of the weights for ``side`` classes of ``side`` words."""
    return {"embed": (len(OFFSETS), side * side + 1, HIDDEN), "bias": (HIDDEN,), "class_out": (HIDDEN, side), "class_bias": (side,), "word_out": (side, HIDDEN, side), "word_bias": (side, side)}


SHAPES = shapes()


def sizes(common: int) -> tuple[int, int, int]:
    """Known words, buckets and classes for a corpus with ``common`` words that should be known."""
    known = max(KNOWN, common)
    buckets = max(BUCKETS, known // 3)
    return known, buckets, max(CLASSES, math.isqrt(known + buckets - 1) + 1)



def words_of(text: bytes) -> list[bytes]:
    """Lower-cased words: runs of ASCII letters and digits and of all bytes above ASCII."""
    return text.translate(_SPLIT).split()


class Codes(dict):
    """Word -> code, filled as words are met and emptied when large: the id of a known word, or ``first`` and the word's cell."""

    def __init__(self, known: dict[bytes, int], first: int = KNOWN, cells: int = LEAST_CELLS) -> None:
        super().__init__()
        self.known, self.first, self.cells = known, first, cells

    def __missing__(self, word: bytes) -> int:
        i = self.known.get(word)
        if i is None:
            i = self.first + zlib.crc32(word) % self.cells
        if len(self) >= _MOST_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = i
        return i

    def of(self, text: bytes) -> np.ndarray:
        words = words_of(text)
        return np.fromiter(map(self.__getitem__, words), np.int32, len(words))


def initial(side: int = CLASSES) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(SEED))
    return {k: (rng.standard_normal(s) * (0.0 if "bias" in k else 0.1)).astype(np.float32) for k, s in shapes(side).items()}


def flat(weights: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([weights[k].ravel() for k in SHAPES])


def shaped(values: np.ndarray, side: int = CLASSES) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k, s in shapes(side).items():
        n = int(np.prod(s))
        out[k] = values[at : at + n].reshape(s).astype(np.float32)
        at += n
    return out


def stream(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """One run of ids with SIDE pads around each text, and the places of the words in it."""
    gap = np.full(SIDE, PAD, np.int32)
    ids = np.concatenate([gap, *[x for t in texts for x in (t, gap)]])
    return ids, np.flatnonzero(ids != PAD)


def _exponentials(logits: np.ndarray, bounded: bool) -> tuple[np.ndarray, np.ndarray]:
    """exp of ``logits`` in place, up to a factor for each row, and its sums. ``bounded``: no logit can overflow, so no maximum is needed."""
    if not bounded:
        logits -= logits.max(1, keepdims=True)
    np.exp(logits, out=logits)
    return logits, logits.sum(1)


def _softmax(logits: np.ndarray, bounded: bool) -> np.ndarray:
    raised, sums = _exponentials(logits, bounded)
    raised /= sums[:, None]
    return raised


def _is_bounded(out: np.ndarray, bias: np.ndarray) -> bool:
    """Hidden values lie within 1, so no logit is above the sum of a column's weights."""
    return bool(np.abs(out).sum(-2).max() + np.abs(bias).max() < 60)


def _with_one(h: np.ndarray) -> np.ndarray:
    """``h`` with a column of ones, which biases are the weights of."""
    return np.concatenate([h, np.ones((len(h), 1), h.dtype)], axis=1)


def _flat(values: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Places of one column in each row, in the rows laid end to end."""
    return np.arange(len(values)) * values.shape[1] + column


def _at(values: np.ndarray, column: np.ndarray) -> np.ndarray:
    return values.ravel()[_flat(values, column)]


class Network:
    """The window network."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights
        self.classes, _, self.per_class = weights["word_out"].shape

    def _bounded(self) -> tuple[bool, bool]:
        return _is_bounded(self.w["class_out"], self.w["class_bias"]), _is_bounded(self.w["word_out"], self.w["word_bias"])

    def hidden(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        h = np.tile(self.w["bias"], (len(places), 1))
        for i, o in enumerate(OFFSETS):
            h += self.w["embed"][i][ids[places + o]]
        return np.tanh(h, out=h)

    def _outputs(self) -> tuple[np.ndarray, np.ndarray]:
        """Output weights of classes and of the words of each class, with their biases as one row more."""
        return np.concatenate([self.w["class_out"], self.w["class_bias"][None]]), np.concatenate([self.w["word_out"], self.w["word_bias"][:, None]], axis=1)

    def _by_class(self, kind: np.ndarray) -> tuple[np.ndarray, list[slice]]:
        """The order that puts the places of a class side by side, and where those of each class lie then."""
        order = np.argsort(kind.astype(np.int16 if self.classes < 1 << 15 else np.int32), kind="stable")
        ends = np.searchsorted(kind[order], np.arange(self.classes + 1)).tolist()
        return order, [slice(a, z) for a, z in zip(ends[:-1], ends[1:], strict=True)]

    def _word_logits(self, h: np.ndarray, words: np.ndarray, parts: list[slice]) -> np.ndarray:
        """Logits of the words of each place's class; places side by side by class."""
        out = np.empty((len(h), self.per_class), h.dtype)
        for c, part in enumerate(parts):
            if part.stop > part.start:
                np.matmul(h[part], words[c], out=out[part])
        return out

    def log_probability(self, ids: np.ndarray, places: np.ndarray) -> np.ndarray:
        """Log-probability of the id at each place, given the ids around it."""
        h = _with_one(self.hidden(ids, places))
        classes, words = self._outputs()
        classes_bounded, words_bounded = self._bounded()
        target = ids[places]
        kind, member = target // self.per_class, target % self.per_class
        hit, every = np.empty(len(places), h.dtype), np.empty(len(places), h.dtype)
        for a in range(0, len(places), ROWS):
            part = slice(a, a + ROWS)
            raised, every[part] = _exponentials(h[part] @ classes, classes_bounded)
            hit[part] = _at(raised, kind[part])
        out = np.log((hit / every).astype(np.float64))
        order, parts = self._by_class(kind)
        raised, every = _exponentials(self._word_logits(h[order], words, parts), words_bounded)
        out[order] += np.log((_at(raised, member[order]) / every).astype(np.float64))
        return out

    def gradient(self, ids: np.ndarray, places: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean negative log-probability."""
        g, seen = self.sparse_gradient(ids, places)
        embed = np.zeros(self.w["embed"].shape, np.float32)
        for i, (rows, values) in enumerate(seen):
            embed[i][rows] = values
        return g | {"embed": embed}

    def sparse_gradient(self, ids: np.ndarray, places: np.ndarray) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        """The gradient of all weights but the embeddings, and for each offset the rows of those that were seen and their gradient."""
        n = len(places)
        h = self.hidden(ids, places)
        target = ids[places]
        kind, member = target // self.per_class, target % self.per_class
        classes_bounded, words_bounded = self._bounded()
        classes, words = self._outputs()
        h1 = _with_one(h)
        to_classes, to_words = np.zeros_like(classes), np.zeros_like(words)
        dh, back = np.empty_like(h), np.ascontiguousarray(self.w["class_out"].T)
        for a in range(0, n, ROWS):
            part = slice(a, a + ROWS)
            d = _softmax(h1[part] @ classes, classes_bounded)
            d.ravel()[_flat(d, kind[part])] -= 1
            to_classes += h1[part].T @ d
            dh[part] = d @ back
        order, parts = self._by_class(kind)
        sorted_h, sorted_dh = h1[order], np.empty_like(h)
        d = _softmax(self._word_logits(sorted_h, words, parts), words_bounded)
        d.ravel()[_flat(d, member[order])] -= 1
        for c, part in enumerate(parts):
            if part.stop > part.start:
                np.matmul(sorted_h[part].T, d[part], out=to_words[c])
                np.matmul(d[part], self.w["word_out"][c].T, out=sorted_dh[part])
        to_classes /= n
        to_words /= n
        g = {"class_out": to_classes[:-1], "class_bias": to_classes[-1], "word_out": to_words[:, :-1], "word_bias": to_words[:, -1]}
        dh[order] += sorted_dh
        dh *= (1 - h * h) / n
        g["bias"] = dh.sum(0)
        embed = []
        for o in OFFSETS:
            seen = ids[places + o]
            order = np.argsort(seen.astype(np.int16) if len(self.w["embed"][0]) < 1 << 15 else seen, kind="stable")
            first = np.flatnonzero(np.diff(seen[order], prepend=PAD - 1))
            embed.append((seen[order][first], np.add.reduceat(dh[order], first, axis=0)))
        return g, embed


class Trainer:
    """Adagrad over batches of windows."""

    def __init__(self, weights: dict[str, np.ndarray], words: int = 0) -> None:
        """``words``: of all texts to come, if known."""
        self.batch = min(BATCH, max(LEAST_BATCH, words // ROUNDS // STEPS))
        self.net = Network({k: v.copy() for k, v in weights.items()})
        self.squares = {k: np.full(v.shape, 1e-6, np.float32) for k, v in weights.items()}
        self.windows = 0

    def step(self, ids: np.ndarray, places: np.ndarray) -> None:
        dense, embed = self.net.sparse_gradient(ids, places)
        for k, g in dense.items():
            self.squares[k] += g * g
            self.net.w[k] -= RATE * g / np.sqrt(self.squares[k])
        for w, squares, (rows, g) in zip(self.net.w["embed"], self.squares["embed"], embed, strict=True):
            total = squares[rows] + g * g
            squares[rows] = total
            w[rows] -= RATE * g / np.sqrt(total)
        self.windows += len(places)

    def texts(self, texts: list[np.ndarray], shift: int) -> None:
        """Train on each place whose number in its text is ``shift`` modulo STRIDE."""
        ids, _ = stream(texts)
        at, places = SIDE, []
        for t in texts:
            places.append(np.arange(at + shift, at + len(t), STRIDE))
            at += len(t) + SIDE
        chosen = np.concatenate(places) if places else np.empty(0, np.int64)
        for a in range(0, len(chosen), self.batch):
            self.step(ids, chosen[a : a + self.batch])


def folded(codes: np.ndarray, first: int, buckets: int) -> np.ndarray:
    """Codes as ids: cells become buckets."""
    return np.where(codes < first, codes, first + (codes - first) % buckets).astype(np.int32)


class Model:
    """A vocabulary, each cell's log share of its bucket for one of its words, and weights."""

    def __init__(self, known: list[bytes], buckets: int, shares: np.ndarray, weights: dict[str, np.ndarray]) -> None:
        self.known, self.buckets, self.shares, self.weights = known, buckets, shares, weights
        #: The first bucket's id: the buckets are the last of the vocabulary.
        self.first = weights["word_bias"].size - buckets

    def codes(self) -> Codes:
        return Codes({w: i for i, w in enumerate(self.known)}, self.first, len(self.shares))

    def ids(self, codes: np.ndarray) -> np.ndarray:
        """Ids of known words as they are, and buckets of the others."""
        return folded(codes, self.first, self.buckets)

    def scores(self, texts: list[np.ndarray]) -> np.ndarray:
        """Summed log-probability of each text's words, given as codes."""
        ids, places = stream([self.ids(t) for t in texts])
        net = Network(self.weights)
        logs = np.concatenate([net.log_probability(ids, places[a : a + BATCH]) for a in range(0, len(places), BATCH)]) if len(places) else np.empty(0)
        codes = np.concatenate([np.empty(0, np.int32), *texts])
        rare = codes >= self.first
        logs[rare] += self.shares[codes[rare] - self.first]
        total = np.concatenate([[0.0], np.cumsum(logs)])
        return np.diff(total[np.cumsum([0, *[len(t) for t in texts]])])


def _parts(batches: Iterator[pa.RecordBatch], column: int, rows: int = 256) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            yield part, part.column(column).to_pylist()


def vocabulary(docs: DataFrame) -> tuple[Model, int]:
    """An untrained model with the known words of the corpus, most frequent first (ties by the word), and the shares of the others; and the number of words in all."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return out

        for _, texts in _parts(batches, 0):
            for t in texts:
                held.update(words_of(t))
            if len(held) >= _MOST_WORDS:
                yield rows()
        yield rows()

    counts = in_small_batches(docs).select(text_bytes().alias("text")).mapInArrow(count, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    counts = materialise(counts, "lm-words")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_known, buckets, side = sizes(counts.where(F.col("n") >= max(2.0, math.sqrt(total) / COMMON)).count())
    known = [(bytes(r["word"]), int(r["n"])) for r in counts.orderBy(F.col("n").desc(), "word").limit(n_known).collect()]
    cells = min(MOST_CELLS, max(LEAST_CELLS, 1 << (2 * distinct).bit_length()))
    found = counts.groupBy((F.crc32("word") % cells).cast("int").alias("cell")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toArrow()
    n, words = np.zeros(cells), np.zeros(cells)
    at = found.column("cell").to_numpy()
    n[at], words[at] = found.column("n").to_numpy(), found.column("words").to_numpy()
    for w, times in known:
        n[zlib.crc32(w) % cells] -= times
        words[zlib.crc32(w) % cells] -= 1
    # A cell without words counts as one with one word, seen once, for texts that were not in the corpus.
    n, words = np.maximum(n, 1), np.maximum(words, 1)
    bucket = np.arange(cells) % buckets
    shares = np.log(n / words / np.bincount(bucket, n, buckets)[bucket])
    return Model([w for w, _ in known], buckets, shares.astype(np.float32), initial(side)), int(total)


def _id_type(model: Model) -> type:
    return np.uint16 if model.weights["word_bias"].size < 1 << 16 else np.int32


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, h (a hash of the row), n_words, codes (32-bit numbers) and ids (numbers of 16 bits, or 32 if the vocabulary needs them) of each row of ``docs`` (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast((model.known, model.first, len(model.shares), model.buckets))
    raw = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("h"), text_bytes().alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, first, cells, buckets = shared.value
        codes = Codes({w: i for i, w in enumerate(known)}, first, cells)
        for part, texts in _parts(batches, 2):
            found = [codes.of(t) for t in texts]
            ids = [folded(f, first, buckets) for f in found]
            columns = [part.column(0), part.column(1), pa.array([len(f) for f in found], pa.int64()), pa.array([f.tobytes() for f in found], pa.binary()), pa.array([f.astype(small).tobytes() for f in ids], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "h", "n_words", "codes", "ids"])

    small = _id_type(model)
    return in_small_batches(raw).mapInArrow(run, f"doc_id {kind}, h bigint, n_words bigint, codes binary, ids binary")


def _averaged(copies: DataFrame, size: int, lanes: int) -> np.ndarray:
    """The mean of weight blocks (block, lane, windows, moved: int32 bytes), by two levels of groups of the square root of the lanes."""

    def weigh(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for windows, chunk in zip(table.column("windows").to_pylist(), table.column("moved").to_pylist(), strict=True):
            total += np.frombuffer(chunk, np.int32).astype(np.int64) * windows
        return summed(table, total)

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for chunk in table.column("sums").to_pylist():
            total += np.frombuffer(chunk, np.int64)
        return summed(table, total)

    def summed(table: pa.Table, total: np.ndarray) -> pa.Table:
        return pa.table({"block": table.column("block").slice(0, 1), "windows": pa.array([sum(table.column("windows").to_pylist())], pa.int64()), "sums": pa.array([total.tobytes()], pa.binary())})

    schema = "block int, windows bigint, sums binary"
    level = copies.withColumn("lane", F.col("lane") % (math.isqrt(lanes) + 1)).groupBy("block", "lane").applyInArrow(weigh, schema).groupBy("block").applyInArrow(add, schema)
    out, windows = np.zeros(-(-size // BLOCK) * BLOCK, np.float64), 0
    for r in level.collect():
        windows = r["windows"]
        out[r["block"] * BLOCK : (r["block"] + 1) * BLOCK] = np.frombuffer(r["sums"], np.int64)
    return out[:size] / UNIT / max(windows, 1) if windows else np.empty(0)


def trained(rows: DataFrame, model: Model, total: int) -> Model:
    """``model`` fitted to all ``rows`` (``encoded``, written) with ``total`` words. Without words the weights stay as they start."""
    session, size = rows.sparkSession.sparkContext, len(flat(model.weights))
    lanes = max(1, -(-total // max(LANE_WORDS, LANE_SHARE * size)))
    dealt = rows.where("n_words > 0").select(F.pmod("h", F.lit(lanes)).cast("int").alias("lane"), "h", "ids")
    for r in range(ROUNDS if total else 0):
        copies = dealt.repartitionByRange(lanes, "lane").groupBy("lane").applyInArrow(_fitter(session.broadcast(model), r), "block int, lane int, windows bigint, moved binary")
        moved = _averaged(copies, size, lanes)
        if not len(moved):
            break
        model = Model(model.known, model.buckets, model.shares, shaped(flat(model.weights) + moved, len(model.weights["class_bias"])))
    return model


def _fitter(shared: Broadcast, shift: int) -> Callable[[pa.Table], pa.Table]:
    """Trains a copy of the shared model on a lane (lane, h, ids), and returns by how much its weights moved."""

    def fit(table: pa.Table) -> pa.Table:
        m = shared.value
        small, bytes_ = _id_type(m), pc.sum(pc.binary_length(table.column("ids"))).as_py()
        trainer, start = Trainer(m.weights, bytes_ // np.dtype(small).itemsize), flat(m.weights)
        # Rows with equal hashes are equal, so the order of the hashes is the same in each run.
        held, words, ids = [], 0, table.column("ids")
        for i in np.argsort(table.column("h").to_numpy(), kind="stable").tolist():
            held.append(np.frombuffer(ids[i].as_py(), small).astype(np.int32))
            words += len(held[-1])
            if words >= PART_WORDS:
                trainer.texts(held, shift)
                held, words = [], 0
        if held:
            trainer.texts(held, shift)
        # Differences from the start are small, so whole multiples fit in 32 bits and their sums times the windows in 64.
        moved = np.rint((flat(trainer.net.w).astype(np.float64) - start) * UNIT).astype(np.int32)
        moved = np.concatenate([moved, np.zeros(-len(moved) % BLOCK, np.int32)]).reshape(-1, BLOCK)
        n, lane = len(moved), table.column("lane")[0].as_py()
        return pa.table({"block": pa.array(range(n), pa.int32()), "lane": pa.array([lane] * n, pa.int32()), "windows": pa.array([trainer.windows] * n, pa.int64()), "moved": pa.array([b.tobytes() for b in moved], pa.binary())})

    return fit


def train(docs: DataFrame) -> Model:
    """Fit the network to all ``docs`` (doc_id, text)."""
    model, total = vocabulary(docs)
    return trained(materialise(encoded(docs, model), "lm-codes", "zstd"), model, total)


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, log_likelihood (sum) and mean_log_likelihood of each of ``rows`` (``encoded`` with the vocabulary of ``model``)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part, codes in _parts(batches, 2, 64):
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(m.scores([np.frombuffer(c, np.int32) for c in codes]))], names=["doc_id", "n_words", "log_likelihood"])

    out = in_small_batches(rows.select("doc_id", "n_words", "codes")).mapInArrow(run, f"doc_id {kind}, n_words bigint, log_likelihood double")
    return out.withColumn("mean_log_likelihood", F.when(F.col("n_words") > 0, F.col("log_likelihood") / F.col("n_words")))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The scores of each row of ``docs`` (doc_id, text; other columns are ignored), see ``scored``.

    Null and empty texts: no words, sum 0, mean null. Null or repeated doc_ids
    stay as they are.
    """
    return scored(encoded(docs, model), model)


def score_documents(docs: DataFrame) -> DataFrame:
    """Train on ``docs`` and score each of its rows: see ``score``. Each text is cut into words twice, to count and to encode."""
    model, total = vocabulary(docs)
    rows = materialise(encoded(docs, model), "lm-codes", "zstd")
    return scored(rows, trained(rows, model, total))
