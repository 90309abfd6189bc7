"""Best-fit packing of tokenised documents into sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers from 1 to the capacity, and pieces of one length are
interchangeable. So the plan is made for the histogram of lengths, which has
at most ``capacity`` entries however many documents there are: the reduction
fixes sets that dominate all alternatives, with their multiplicity; best fit
in decreasing order packs the rest. The plan is a list of runs over the rank of
a piece among all pieces by length; each task finds its pieces' runs by
bisection. Ranks come from one range shuffle, which the ids go through with their pieces.
"""

from __future__ import annotations

import base64
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import global_rank, in_small_batches, materialise, text_bytes
from coffer.llm.tokencount import SPECIAL

END_ID = 2
SPECIAL_ID = 50_256
CAPACITY = 1024
#: Of the scratch tables, which hold every id.
CODEC = "zstd"


@cache
def _library(vocabulary: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary)


@cache
def bpe(vocabulary: str):
    """The rank encoder of a ``tokenizers`` file, whose ranks lie beside it as .tiktoken."""
    import tiktoken

    from public_tokenizers import PATTERN

    with open(vocabulary.removesuffix(".json") + ".tiktoken", "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding(vocabulary, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: SPECIAL_ID})


def encode(text: str, vocabulary: str) -> np.ndarray:
    """A text's ids, as the ``tokenizers`` file gives them without added tokens. The rank encoder is the same map, several times faster; texts on which its matcher gives up go to the library."""
    try:
        if SPECIAL in text:
            return np.array(bpe(vocabulary).encode(text, allowed_special="all"), np.uint32)
        return bpe(vocabulary).encode_to_numpy(text, disallowed_special=())
    except (ValueError, RuntimeError, OverflowError):
        return np.array(_library(vocabulary).encode(text, add_special_tokens=False).ids, np.uint32)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """Start and length of the pieces of n ids: whole sequences, but for the first piece."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def encode_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, with_ids: bool = False, small: bool = False) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text): doc_id, piece, start, length, ids_crc32 and, if asked for, ids, or small_ids: the same as bytes, two for an id if none of the piece needs four.

    A document's ids end with id 2; null text has only that; bytes that are no UTF-8
    count as U+FFFD. ids_crc32 is over
    the ids as little-endian unsigned 32-bit numbers.
    """
    raw = docs.select("doc_id", text_bytes().alias("text"))
    kind = raw.schema["doc_id"].dataType
    fields = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids + ["small_ids"] * small

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows: list[list] = [[] for _ in fields]
                source, held, tight = [], [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = np.append(encode(text.decode("utf-8", "replace"), vocabulary).astype("<u4"), np.array([END_ID], "<u4"))
                    data = ids.tobytes()
                    held.append(ids)
                    for k, (start, length) in enumerate(cut(len(ids), capacity)):
                        source.append(i)
                        rows[1].append(k)
                        rows[2].append(start)
                        rows[3].append(length)
                        if small:
                            own = ids[start : start + length]
                            tight.append(own.astype("<u2" if own.max() < 1 << 16 else "<u4").tobytes())
                        rows[4].append(zlib.crc32(memoryview(data)[4 * start : 4 * (start + length)]))
                columns = [part.column(0).take(pa.array(source, pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(rows[i], pa.int64()) for i in (2, 3, 4))]
                if with_ids:  # a document's pieces lie one after another
                    ends = np.cumsum([0, *rows[3]])
                    columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(held).view(np.int32))))
                if small:
                    columns.append(pa.array(tight, pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=fields)

    schema = f"doc_id {kind.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids + ", small_ids binary" * small
    return in_small_batches(raw).mapInArrow(run, schema)


class Plan:
    """Bins for a histogram of lengths, as runs: (length, how many pieces, first sequence, offset); piece i of a run goes to sequence first + i."""

    def __init__(self, histogram: dict[int, int], capacity: int = CAPACITY) -> None:
        if any(not 0 < w <= capacity for w in histogram):
            raise ValueError("a length is out of range")
        self.capacity, self.sequences, self.fixed = capacity, 0, 0
        self.left = {w: n for w, n in histogram.items() if n}
        self.sizes = sorted(self.left)
        self.runs: list[tuple[int, int, int, int]] = []
        self._reduce()
        self.fixed = self.sequences
        self._best_fit()

    def _close(self, lengths: tuple[int, ...], bins: int) -> None:
        """Fill ``bins`` new sequences with these lengths each."""
        at = 0
        for w in lengths:
            self.runs.append((w, bins, self.sequences, at))
            at += w
            self.left[w] -= bins
            if not self.left[w]:
                del self.left[w]
                self.sizes.remove(w)
        self.sequences += bins

    def _largest(self, room: int) -> int | None:
        i = bisect_left(self.sizes, room + 1)
        return self.sizes[i - 1] if i else None

    def _smallest(self, count: int, without: int) -> list[int]:
        """The ``count`` smallest pieces, one of length ``without`` set aside."""
        out: list[int] = []
        for w in self.sizes:
            out += [w] * min(count, self.left[w] - (w == without))
            if len(out) >= count:
                break
        return out[:count]

    def _best_pair(self, room: int, without: int) -> int:
        """The largest sum of two pieces that is at most ``room``, or 0."""
        sizes = [w for w in self.sizes if self.left[w] > (w == without)]
        best, lo, hi = 0, 0, len(sizes) - 1
        while lo <= hi:
            a, b = sizes[lo], sizes[hi]
            if a + b > room:
                hi -= 1
                continue
            if a != b or self.left[a] - (a == without) > 1:
                best = max(best, a + b)
            lo += 1
        return best

    def _dominating(self, w: int) -> tuple[int, ...] | None:
        """A set with ``w`` that dominates every set that could hold a piece of length w, or None.

        Set F dominates set G if G's pieces can be spread over F's so that each
        share is at most as long as the piece it replaces.
        """
        room = self.capacity - w
        other = self._smallest(3, w)
        if not other or other[0] > room:
            return (w,)  # nothing fits beside it
        mate = self._largest(room)
        if mate == w and self.left[w] < 2:
            mate = self._largest(w - 1)
        if mate is None:
            return (w,)
        if w + mate == self.capacity:
            return (w, mate)  # whatever fits beside w is at most as long as the mate together
        if len(other) < 2 or other[0] + other[1] > room:
            return (w, mate)  # one piece at most fits beside it, and this is the longest
        if (len(other) < 3 or sum(other) > room) and self._best_pair(room, w) <= mate:
            return (w, mate)  # two pieces at most, and together no longer than the mate
        return None

    def _reduce(self) -> None:
        """Fix dominating sets until none is left; each one shrinks the instance for the next."""
        again = True
        while again:
            again = False
            for w in sorted(self.sizes, reverse=True):
                while w in self.left and (found := self._dominating(w)):
                    self._close(found, self._repeat(found))
                    again = True

    def _repeat(self, found: tuple[int, ...]) -> int:
        """How often the set stays dominating: while its pieces last, as what is left only shrinks."""
        if len(found) == 1:
            return self.left[found[0]] if self.capacity < found[0] + min(self.sizes) else 1
        a, b = found
        return self.left[a] // 2 if a == b else min(self.left[a], self.left[b])

    def _best_fit(self) -> None:
        """Longest first, each into the open sequence with the least room that holds it. Sequences filled alike are one group."""
        groups: dict[int, list[list[int]]] = {}  # room -> [first sequence, how many]
        rooms: list[int] = []

        def put(room: int, first: int, bins: int) -> None:
            if room and bins:
                if room not in groups:
                    insort(rooms, room)
                    groups[room] = []
                groups[room].append([first, bins])

        for w in sorted(self.left, reverse=True):
            n = self.left[w]
            while n:
                i = bisect_left(rooms, w)
                if i < len(rooms):
                    room = rooms[i]
                    first, bins = groups[room].pop()
                    if not groups[room]:
                        del groups[room]
                        rooms.pop(i)
                    used = min(n, bins)
                    self.runs.append((w, used, first, self.capacity - room))
                    put(room - w, first, used)
                    put(room, first + used, bins - used)
                    n -= used
                else:
                    each = self.capacity // w
                    bins, per = (n // each, each) if n >= each else (1, n)
                    for k in range(per):
                        self.runs.append((w, bins, self.sequences, k * w))
                    put(self.capacity - per * w, self.sequences, bins)
                    self.sequences += bins
                    n -= bins * per
        self.left = {}


def run_table(histogram: dict[int, int], plan: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For pieces ranked by length: where each run begins, the sequence of its first piece, and its offset."""
    base, at = {}, 0
    for w in sorted(histogram):
        base[w] = at
        at += histogram[w]
    begins, firsts, offsets = [], [], []
    for w, n, first, offset in sorted(plan.runs, key=lambda r: (r[0], r[2], r[3])):
        begins.append(base[w])
        firsts.append(first)
        offsets.append(offset)
        base[w] += n
    return np.array(begins, np.int64), np.array(firsts, np.int64), np.array(offsets, np.int64)


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (doc_id, piece, start, length, ids_crc32 and, if there, small_ids, which become ids, the last column).

    ``pieces`` is read more than once: pass a written table. Only the histogram
    of lengths (at most ``capacity`` rows) comes to the driver. Equal rows can
    change places. Empty input gives no rows.
    """
    ranked, n = global_rank(pieces, ["length", "doc_id", "piece", "ids_crc32"], "pack-order", codec=CODEC)
    histogram = {int(r["length"]): int(r["count"]) for r in pieces.groupBy("length").count().collect()}
    begins, firsts, offsets = run_table(histogram, Plan(histogram, capacity))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column(batch.num_columns - 1).to_numpy()
            run = np.searchsorted(begins, rank, side="right") - 1
            whole = [batch.column(i) for i in range(batch.num_columns - 1)]
            placed = [*whole[:5], pa.array(firsts[run] + rank - begins[run]), pa.array(offsets[run])]
            if small:
                lengths = whole[3].to_numpy()
                values = [np.frombuffer(b, f"<u{len(b) // n}").astype(np.int32) for b, n in zip(whole[5].to_pylist(), lengths.tolist(), strict=True)]
                ends = pa.array(np.cumsum([0, *lengths]), pa.int32())
                placed.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.empty(0, np.int32), *values]))))
            yield pa.RecordBatch.from_arrays(placed, names=[*columns, "sequence_id", "offset"] + ["ids"] * len(small))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    small = ["small_ids"] if "small_ids" in pieces.columns else []
    kinds = ", ".join(f"`{c}` {pieces.schema[c].dataType.simpleString()}" for c in columns)
    schema = f"{kinds}, sequence_id bigint, offset bigint" + ", ids array<int>" * len(small)
    return in_small_batches(ranked.select(*columns, *small, "global_rank")).mapInArrow(place, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY) -> DataFrame:
    """Pack ``docs`` (doc_id, text; other columns are ignored) into sequences of at most ``capacity`` tokens.

    Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset, ids; one
    row for each piece, at least one for each document. A sequence is the ids of
    its rows in the order of their offsets. Null or repeated doc_ids: each row
    is a document of its own.
    """
    return pack(materialise(encode_pieces(docs, vocabulary, capacity, small=True), "pack-pieces", CODEC), capacity)


def digests(packed: DataFrame) -> DataFrame:
    """``packed`` with length and ids_crc32 made anew from its ids, and without the ids."""
    columns = [c for c in packed.columns if c != "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(len(columns))
            data, ends = memoryview(ids.flatten().to_numpy().astype("<u4").tobytes()), np.cumsum([0, *ids.value_lengths().to_pylist()]) * 4
            made = {"length": pa.array(np.diff(ends) // 4, pa.int64()), "ids_crc32": pa.array([zlib.crc32(data[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.int64())}
            yield pa.RecordBatch.from_arrays([made.get(c, batch.column(i)) for i, c in enumerate(columns)], names=columns)

    kinds = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in columns)
    return in_small_batches(packed.select(*columns, "ids")).mapInArrow(run, kinds)
