"""Token counts by compiled finite-state transducers.

Byte-level BPE is a cascade of two deterministic machines. The first cuts a
text into pieces as the library's pattern does: 13 states over 12 character
classes, whose transitions say whether a piece begins at this character, at the
one before, or neither. A batch of texts is one stream with end marks, cut into
chunks of equal length. All chunks step through this machine side by side from
every state, which gives each chunk's map from entry to exit state; a prefix
scan composes the maps, so each chunk's true entry state is known without
reading from the left, and a second pass emits the cuts.

The second machine reads the bytes of a piece and is compiled from the merges.
A transition carries how many tokens the next byte adds: the tokens of the
piece so far with the byte, less those without, which can be negative. What
makes this finite: the tokens of a prefix end in the one token that is a suffix
of the prefix and that no merge would have joined with the token before it. So
a state is, for each suffix that can still grow into a token, its place in the
trie of tokens, the token before it, and how many tokens ended there. States
and transitions are compiled when a text first takes them, and paths of whole
pieces are kept.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coffer.llm.common import in_small_batches, text_bytes

SPECIAL = "<|endoftext|>"
#: Characters in a chunk, and in the part of a batch that is held at once.
CHUNK, PART = 256, 2_000_000
#: Pieces up to this length are kept as paths, up to so many in a worker; and so are states of the second machine.
LONGEST_PATH, MOST_PATHS, MOST_STATES = 64, 400_000, 250_000
#: Tokens below a node of the trie up to which all are tried.
MANY = 64

# Character classes.
LETTER, NUMBER, SPACE, BLANK, OTHER, QUOTE, STMD, R, V, L, E, END = range(12)
# States: before anything, in letters, numbers, other; one space, one blank, a run of white space
# that ends in a space or a blank; a quote that begins a piece, then r, v or l; after a contraction.
START, IN_LETTERS, IN_NUMBERS, IN_OTHER, ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, CONTRACTED = range(13)
STATES, CLASSES = 13, 12
HERE, BEFORE = 1, 2

LETTERS = (LETTER, STMD, R, V, L, E)


def compile_cutter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and cut flags for each state and class.

    The pattern: contractions ('s 't 'm 'd 're 've 'll); runs of letters, numbers
    or other characters, each with one space before it if there is one; white
    space, where the last of a run that is followed by more text stands alone
    or, if it is a space, goes with what follows.
    """
    after, cuts = np.zeros((STATES, CLASSES), np.uint8), np.zeros((STATES, CLASSES), np.uint8)
    fresh = {**dict.fromkeys(LETTERS, IN_LETTERS), NUMBER: IN_NUMBERS, SPACE: ONE_SPACE, BLANK: ONE_BLANK, OTHER: IN_OTHER, QUOTE: QUOTED, END: START}
    joined = fresh | {QUOTE: IN_OTHER}  # what a space takes along: a quote begins no contraction then

    def put(state: int, c: int, to: int, flags: int) -> None:
        after[state, c], cuts[state, c] = to, flags

    for s in range(STATES):
        for c in range(CLASSES):
            put(s, c, fresh[c], HERE)
    for c in LETTERS:
        put(IN_LETTERS, c, IN_LETTERS, 0)
    put(IN_NUMBERS, NUMBER, IN_NUMBERS, 0)
    for c in (OTHER, QUOTE):
        put(IN_OTHER, c, IN_OTHER, 0)
        put(QUOTED, c, IN_OTHER, 0)
    for s in (ONE_SPACE, ONE_BLANK, RUN_SPACE, RUN_BLANK):
        put(s, SPACE, RUN_SPACE, 0)
        put(s, BLANK, RUN_BLANK, 0)
    for c in (*LETTERS, NUMBER, OTHER, QUOTE):
        put(ONE_SPACE, c, joined[c], 0)
        put(RUN_SPACE, c, joined[c], BEFORE)
        put(RUN_BLANK, c, fresh[c], BEFORE | HERE)
    for c, to in ((STMD, CONTRACTED), (R, QUOTED_R), (V, QUOTED_V), (L, QUOTED_L)):
        put(QUOTED, c, to, 0)
    for s, last in ((QUOTED_R, E), (QUOTED_V, E), (QUOTED_L, L)):
        for c in range(CLASSES):
            put(s, c, after[IN_LETTERS, c], BEFORE | cuts[IN_LETTERS, c])
        put(s, last, CONTRACTED, 0)
    return after, cuts


@cache
def class_table() -> np.ndarray:
    """The class of each code point, as the library's own pattern engine has it."""
    from tokenizers import Regex, pre_tokenizers

    table = np.full(0x110000, OTHER, np.uint8)
    points = np.array([c for c in range(0x110000) if not 0xD800 <= c < 0xE000])
    everything = "".join(map(chr, points.tolist()))
    for pattern, kind in ((r"[^\p{L}]+", LETTER), (r"[^\p{N}]+", NUMBER), (r"\S+", BLANK)):
        # What is left when all runs without the class are removed.
        for _, (first, last) in pre_tokenizers.Split(Regex(pattern), "removed").pre_tokenize_str(everything):
            table[points[first:last]] = kind
    for chars, kind in ((" ", SPACE), ("'", QUOTE), ("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E)):
        for c in chars:
            table[ord(c)] = kind
    return table


def compose_maps(maps: np.ndarray) -> np.ndarray:
    """Inclusive prefix composition of state maps (chunks, states), by doubling: row i takes the first chunk's entry to chunk i's exit."""
    out, step = maps.copy(), 1
    while step < len(out):
        out[step:] = np.take_along_axis(out[step:], out[:-step], axis=1)
        step *= 2
    return out


class Cutter:
    """The first transducer, run over a stream of classes."""

    def __init__(self) -> None:
        after, self.cuts = compile_cutter()
        self.after, self.cuts = after.ravel(), self.cuts.ravel()

    def run(self, classes: np.ndarray) -> np.ndarray:
        """Where pieces begin in a stream that ends with END; END marks are pieces themselves."""
        n = len(classes)
        chunks = -(-n // CHUNK)
        lanes = np.full(chunks * CHUNK, END, np.uint8)
        lanes[:n] = classes
        lanes = np.ascontiguousarray(lanes.reshape(chunks, CHUNK).T)
        state = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
        for t in range(CHUNK):
            state = self.after[state.astype(np.uint16) * CLASSES + lanes[t]]
        exits = compose_maps(np.ascontiguousarray(state.T))[:, START]
        now = np.concatenate([[START], exits[:-1]]).astype(np.uint8)
        flags = np.empty((CHUNK, chunks), np.uint8)
        for t in range(CHUNK):
            at = now.astype(np.uint16) * CLASSES + lanes[t]
            flags[t], now = self.cuts[at], self.after[at]
        flags = flags.T.ravel()[:n]
        begins = (flags & HERE).astype(bool)
        begins[:-1] |= (flags[1:] & BEFORE).astype(bool)
        return np.flatnonzero(begins)


def byte_symbols() -> dict[str, int]:
    """The bytes that the characters of a byte-level vocabulary stand for: printable Latin-1 characters for themselves, and those from 256 on, in order, for the other bytes."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printable))}


class Merges:
    """The merges of a ``tokenizers`` file. Tokens are numbered by rank: bytes first, then the merges in their order."""

    def __init__(self, vocabulary: str) -> None:
        with open(vocabulary, encoding="utf-8") as file:
            rules = json.load(file)["model"]["merges"]
        symbols = byte_symbols()
        self.bytes = [bytes([b]) for b in range(256)]
        number = {t: i for i, t in enumerate(self.bytes)}
        self.left, self.right = list(range(256)), list(range(256))
        self.joined: dict[tuple[int, int], int] = {}
        for rule in rules:
            a, b = (number[bytes(symbols[c] for c in part)] for part in (rule if isinstance(rule, list) else rule.split(" ")))
            made = self.bytes[a] + self.bytes[b]
            self.joined[a, b] = number[made] = len(self.bytes)
            self.bytes.append(made)
            self.left.append(a)
            self.right.append(b)

    def edge(self, token: int, inner: list[int]) -> list[tuple[int, int]]:
        """What stands at one end of ``token`` while it is built, each with the merge that ends it; the token itself last, with none."""
        out, ends = [], len(self.bytes)
        while True:
            out.append((token, ends))
            if token < 256:
                return out[::-1]
            token, ends = inner[token], token

    def stay_apart(self, a: int, b: int) -> bool:
        """Do the tokens a and b, one after the other, stay two? They do if no merge across the border comes before both its parts are gone. Of equal merges the left one comes first."""
        for x, x_ends in self.edge(a, self.right):
            for y, y_ends in self.edge(b, self.left):
                merge = self.joined.get((x, y))
                if merge is not None and merge < x_ends and merge <= y_ends:
                    return False
        return True


class Emitter(dict):
    """The second transducer: (state << 8 | byte) -> (next state << 8 | tokens added + 128)."""

    def __init__(self, merges: Merges) -> None:
        super().__init__()
        self.merges = merges
        #: Tokens in the order of their bytes: those below a node of the trie lie side by side.
        self.sorted = sorted(range(len(merges.bytes)), key=merges.bytes.__getitem__)
        self.child: list[dict[int, int]] = [{}]
        self.token, self.below = [-1], [[0, len(self.sorted)]]
        for place, t in enumerate(self.sorted):
            node = 0
            for b in merges.bytes[t]:
                kids = self.child[node]
                if b not in kids:
                    kids[b] = len(self.token)
                    self.child.append({})
                    self.token.append(-1)
                    self.below.append([place, place])
                node = kids[b]
                self.below[node][1] = place + 1
            self.token[node] = t
            self.below[node][0] = place + 1
        self.forget()

    def forget(self) -> None:
        """Back to the start state alone: nothing before the piece, nothing read."""
        self.clear()
        self.apart: dict[int, bool] = {}
        self.hopes: dict[int, bool] = {}
        self.states: list[tuple] = [((0, -1, 0),)]
        self.numbers = {self.states[0]: 0}

    def _stay_apart(self, before: int, token: int) -> bool:
        known = self.apart.get(before << 20 | token)
        if known is None:
            known = self.apart[before << 20 | token] = self.merges.stay_apart(before, token)
        return known

    def _can_grow(self, before: int, node: int) -> bool:
        """Can a longer token at ``node`` follow ``before``? Where many could, taken for granted."""
        known = self.hopes.get(before << 20 | node)
        if known is None:
            first, end = self.below[node]
            known = self.hopes[before << 20 | node] = end - first > MANY or any(self._stay_apart(before, self.sorted[i]) for i in range(first, end))
        return known

    def __missing__(self, at: int) -> int:
        """Compile a transition. A state lists (node of the trie, token before the suffix, its tokens less those of all), longest suffix first."""
        byte, added, last, grown = at & 255, 0, -1, []
        for node, before, tokens in self.states[at >> 8]:
            child = self.child[node].get(byte)
            if child is None:
                continue
            if last < 0 and self.token[child] >= 0 and (before < 0 or self._stay_apart(before, self.token[child])):
                added, last = tokens + 1, self.token[child]
            if self.child[child] and (before < 0 or self._can_grow(before, child)):
                grown.append((child, before, tokens))
        state = (*[(node, before, tokens - added) for node, before, tokens in grown], (0, last, 0))
        number = self.numbers.setdefault(state, len(self.states))
        if number == len(self.states):
            self.states.append(state)
        self[at] = arc = number << 8 | added + 128
        return arc

    def emitted(self, piece: bytes) -> int:
        """Tokens of a piece: the sum along its path."""
        if len(self.states) > MOST_STATES:
            self.forget()
        state, tokens = 0, 0
        for byte in piece:
            arc = self[state << 8 | byte]
            state = arc >> 8
            tokens += (arc & 255) - 128
        return tokens


class Paths(dict):
    """Piece -> its tokens, kept when met and emptied when large."""

    def __init__(self, emitter: Emitter) -> None:
        super().__init__()
        self.emitter = emitter

    def __missing__(self, piece: str) -> int:
        emitted = self.emitter.emitted(piece.encode())
        if len(piece) <= LONGEST_PATH:
            if len(self) >= MOST_PATHS:
                self.clear()
            self[piece] = emitted
        return emitted


class Counter:
    """Counts the tokens of texts with both transducers."""

    def __init__(self, vocabulary: str) -> None:
        self.cutter, self.paths = Cutter(), Paths(Emitter(Merges(vocabulary)))

    def count(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text, as the library counts them; an <|endoftext|> inside a text is one token."""
        parts, owner, extra = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut = text.split(SPECIAL) if SPECIAL in text else [text]
            extra[i] = len(cut) - 1
            parts += cut
            owner += [i] * len(cut)
        lengths = np.array([len(p) for p in parts], np.int64)
        stream = "\0".join(parts) + "\0"
        classes = class_table()[np.frombuffer(stream.encode("utf-32-le"), np.uint32)]
        ends = np.cumsum(lengths + 1) - 1
        classes[ends] = END
        begins = self.cutter.run(classes)
        stops = np.append(begins[1:], len(stream))
        real = classes[begins] != END
        begins, stops = begins[real], stops[real]
        pieces = [stream[a:b] for a, b in zip(begins.tolist(), stops.tolist(), strict=True)]
        emitted = np.fromiter(map(self.paths.__getitem__, pieces), np.int64, len(pieces))
        total = np.zeros(len(begins) + 1, np.int64)
        np.cumsum(emitted, out=total[1:])
        last = np.searchsorted(begins, ends)
        by_part = np.diff(total[last], prepend=0)
        return extra + np.bincount(owner, weights=by_part, minlength=len(texts)).astype(np.int64)


@cache
def counter(vocabulary: str) -> Counter:
    """One for each Python worker, kept between tasks."""
    return Counter(vocabulary)


def in_parts(texts: list[str], size: int = PART) -> Iterator[list[str]]:
    """Consecutive texts, up to ``size`` characters or one text at a time."""
    part, held = [], 0
    for text in texts:
        if part and held + len(text) > size:
            yield part
            part, held = [], 0
        part.append(text)
        held += len(text)
    if part:
        yield part


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512) -> DataFrame:
    """Tokens of each row of ``docs`` (doc_id, text; other columns are ignored).

    ``vocabulary``: path of a byte-level BPE ``tokenizers`` file on each executor. Returns doc_id, n_bytes, n_tokens,
    over_limit (n_tokens > limit). Null texts count as empty: no tokens. Bytes that
    are no UTF-8 count as U+FFFD in tokens and as themselves in n_bytes. Null or
    repeated doc_ids: one row out for each row in.
    """
    raw = docs.select("doc_id", text_bytes().alias("text"))
    kind = raw.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary)
        for batch in batches:
            done = 0
            raw_texts = batch.column(1).to_pylist()
            for part in in_parts([t.decode("utf-8", "replace") for t in raw_texts]):
                tokens = count.count(part)
                n_bytes = [len(t) for t in raw_texts[done : done + len(part)]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), pa.array(n_bytes, pa.int64()), pa.array(tokens, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])
                done += len(part)

    out = in_small_batches(raw).mapInArrow(run, f"doc_id {kind}, n_bytes bigint, n_tokens bigint")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
