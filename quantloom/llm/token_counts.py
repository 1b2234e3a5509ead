"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic machines share the work.

1. A boundary machine reads character classes and marks where a pre-token begins. Texts are cut into
   chunks of equal length; each chunk is run from every state at once, and the chunk maps
   (start state -> end state) compose through a parallel prefix scan, which gives each chunk its true
   start state.
2. A merge machine reads the bytes of a pre-token; every transition carries the change in the number of
   emitted tokens. Its states are compiled on demand. By the pair property of BPE (a token sequence is an
   encoding exactly if every adjacent pair encodes to itself), the last token of each prefix is fixed, so
   a state need only hold, for each suffix that can still grow into a token, the last token before it and
   the count relative to now.

Defined cases: null text counts as empty (no tokens); very long texts are counted whole, chunk by chunk; the special string counts as one token; every
input row gives one output row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import SPECIAL, byte_letters, slices, text_bytes
from quantloom.llm.token_output import default_tokenizer

CHUNK = 256
LIMIT = 512
#: Beyond so many states the machine starts afresh, which bounds its memory.
MOST_STATES = 250_000

# Character classes of the boundary machine.
BLANK, SPACE, DIGIT, QUOTE, OTHER, LETTER, ST, R, V, L, E = range(11)
_CLASSES = 11
_CONTRACTION_LETTERS = {"s": ST, "t": ST, "m": ST, "d": ST, "r": R, "v": V, "l": L, "e": E}


def boundary_machine() -> tuple[np.ndarray, np.ndarray]:
    """(next, marks) over states x classes. A mark's bits: 1 a pre-token begins at this character, 2 at the
    one before it, 4 at the one two before (the start of a contraction's letters, once it failed).

    States: what stands before. 0 nothing; 1 letters; 2 digits; 3 other signs; 4 one blank that began a run;
    5 white space ending in another character, first of its run; 6 a run of two or more ending in a blank;
    7 such a run ending in another character; 8 a quote that may begin a contraction; 9, 10, 11 that quote
    and r, v or l; 12 a whole contraction.
    """
    letters = (LETTER, ST, R, V, L, E)
    following, marks = np.zeros((13, _CLASSES), np.int8), np.zeros((13, _CLASSES), np.int8)
    for state in range(13):
        for c in range(_CLASSES):
            kind = "letter" if c in letters else {DIGIT: "digit", QUOTE: "other", OTHER: "other"}.get(c, "white")
            run = {1: "letter", 2: "digit", 3: "other", 8: "other", 9: "letter", 10: "letter", 11: "letter"}.get(state)
            mark = 0
            if kind == "white":
                inside = state in (4, 5, 6, 7)
                goes = (6 if c == BLANK else 7) if inside else (4 if c == BLANK else 5)
                mark = 0 if inside else 1
            else:
                goes = {"letter": 1, "digit": 2, "other": 3}[kind]
                if state in (4, 6):  # the last blank joins what follows
                    mark = 2 if state == 6 else 0
                elif state in (5, 7):
                    mark = 1 | (2 if state == 7 else 0)
                elif state == 8 and c in (ST, R, V, L):
                    goes, mark = {ST: 12, R: 9, V: 10, L: 11}[c], 1 if c != ST else 0
                elif (state in (9, 10) and c == E) or (state == 11 and c == L):
                    goes, mark = 12, 8  # it is a contraction: the mark at its letter goes
                elif run != kind:
                    mark = 1
                if c == QUOTE and state in (0, 1, 2, 5, 7, 9, 10, 11, 12):
                    goes = 8
            following[state, c], marks[state, c] = goes, mark
    return following, marks


class BoundaryMachine:
    def __init__(self, tokenizer):
        self.pre = tokenizer.pre_tokenizer
        self.following, self.marks = boundary_machine()
        self.classes = np.full(0x110000, -1, np.int8)
        for letter, c in _CONTRACTION_LETTERS.items():
            self.classes[ord(letter)] = c
        self.classes[32], self.classes[39] = BLANK, QUOTE

    def classify(self, points: np.ndarray) -> np.ndarray:
        """Classes as the library's own pre-tokenizer treats each character."""
        out = self.classes[points]
        for p in np.unique(points[out < 0]).tolist():
            one = lambda before: len(self.pre.pre_tokenize_str(before + chr(p))) == 1  # noqa: B023, E731
            self.classes[p] = LETTER if one("a") else DIGIT if one("1") else OTHER if one("!") else SPACE
        return self.classes[points]

    def starts(self, points: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where pre-tokens begin; ``first``: where texts begin (the machine starts anew there)."""
        n, states = len(points), len(self.following)
        classes = self.classify(points).astype(np.int64)
        # a text's first character resets the machine: its row of the table is the start state's
        table = np.concatenate([self.following, np.repeat(self.following[:1], states, axis=0)], axis=1).astype(np.int64)
        marked = np.concatenate([self.marks, np.repeat(self.marks[:1], states, axis=0)], axis=1)
        symbols = classes
        symbols[first] += _CLASSES
        chunks = -(-n // CHUNK)
        grid = np.full(chunks * CHUNK, 0, np.int64)
        grid[:n] = symbols
        grid = grid.reshape(chunks, CHUNK).T.copy()
        ends = np.repeat(np.arange(states)[None, :], chunks, axis=0)
        for row in grid:  # every chunk from every state
            ends = table[ends, row[:, None]]
        # prefix scan: compose the maps of chunks 0..k by doubling
        step = 1
        while step < chunks:
            ends[step:] = np.take_along_axis(ends[step:], ends[:-step].copy(), axis=1)
            step *= 2
        state = np.zeros(chunks, np.int64)
        state[1:] = ends[:-1, 0]
        out = np.empty((CHUNK, chunks), np.int8)
        for k, row in enumerate(grid):
            out[k] = marked[state, row]
            state = table[state, row]
        out = out.T.reshape(-1)[:n]
        begin = (out & 1) > 0
        begin[:-1] |= (out[1:] & 2) > 0
        begin[:-1] &= (out[1:] & 8) == 0  # 're, 've, 'll: no cut before their first letter
        # the character after a contraction begins a pre-token, which state 12 marks itself
        begin[first] = True
        return begin


class MergeMachine:
    """BPE over the bytes of one pre-token, compiled to a transducer state by state.

    A state is a tuple of (suffix, token before it, tokens since then); suffixes that no token can complete
    any more are left out. Transitions stand in an open-addressing table of plain arrays.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list):
        base = byte_letters()
        back = {c: b for b, c in base.items()}
        decode = lambda token: bytes(back[c] for c in token)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.rank = {(decode(a), decode(b)): i for i, (a, b) in enumerate(pairs)}
        self.halves = {a + b: (i, a, b) for (a, b), i in self.rank.items()}
        self.tokens = {decode(t) for t in vocabulary if all(c in back for c in t)}
        self.ordered = sorted(self.tokens)
        self.growing = {t[:k] for t in self.tokens for k in range(1, len(t))}
        self.fits = lru_cache(1 << 17)(self._fits)
        self.open = lru_cache(1 << 18)(self._open)
        self.reset()

    def reset(self) -> None:
        self.known: dict = {}
        self.meaning: list = []
        self.transitions, self.bits = 0, 16
        self._allot()
        self.state(((b"", None, 0),))

    def _allot(self) -> None:
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.goes, self.emits = np.zeros(1 << self.bits, np.int32), np.zeros(1 << self.bits, np.int8)

    def state(self, meaning) -> int:
        number = self.known.setdefault(meaning, len(self.meaning))
        if number == len(self.meaning):
            self.meaning.append(meaning)
        return number

    def _fits(self, before: bytes | None, token: bytes) -> bool:
        """Whether the two are neighbours in an encoding: no merge joins their touching parts before both are whole."""
        if before is None:
            return len(token) == 1 or token in self.halves
        none, limit = (-1, b"", b""), 1 << 30
        while True:
            if self.rank.get((before, token), limit) < limit:
                return False
            left, right = self.halves.get(before, none), self.halves.get(token, none)
            if left[0] < 0 and right[0] < 0:
                return True
            if left[0] > right[0]:
                limit, before = left[0], left[2]
            else:
                limit, token = right[0] + 1, right[1]

    def _open(self, before: bytes | None, suffix: bytes) -> bool:
        """Whether some longer token that starts with ``suffix`` can follow ``before``."""
        i = bisect_right(self.ordered, suffix)
        while i < len(self.ordered) and self.ordered[i].startswith(suffix):
            if self._fits(before, self.ordered[i]):
                return True
            i += 1
        return False

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        """The transition from ``state`` on ``byte``: the next state and the change in emitted tokens."""
        c = bytes([byte])
        last = grown = None
        kept = []
        for suffix, before, behind in self.meaning[state]:
            longer = suffix + c
            if last is None and longer in self.tokens and self.fits(before, longer):
                last, grown = longer, 1 - behind
            if longer in self.growing and self.open(before, longer):
                kept.append((longer, before, behind))
        return self.state((*((s, b, d + grown) for s, b, d in kept), (b"", last, 0))), grown

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _put(self, keys: np.ndarray, goes: np.ndarray, emits: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.goes[slot[mine]], self.emits[slot[mine]] = goes[mine], emits[mine]
            keys, goes, emits, slot = keys[~mine], goes[~mine], emits[~mine], (slot[~mine] + 1) & ((1 << self.bits) - 1)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the transitions, -1 where they are not compiled yet."""
        slot = self._slot(keys)
        there = self.keys[slot]
        rest = np.flatnonzero(there != keys)
        while len(rest):
            empty = there[rest] < 0
            slot[rest[empty]] = -1
            rest = rest[~empty]
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            there[rest] = self.keys[slot[rest]]
            rest = rest[there[rest] != keys[rest]]
        return slot

    def _add(self, keys: np.ndarray) -> None:
        made = np.array([self.compile(k >> 8, k & 255) for k in keys.tolist()], np.int64).reshape(-1, 2)
        self.transitions += len(keys)
        if self.transitions * 4 > 1 << self.bits:
            held, goes, emits = (x[self.keys >= 0] for x in (self.keys, self.goes, self.emits))
            while self.transitions * 4 > 1 << self.bits:
                self.bits += 1
            self._allot()
            self._put(held, goes, emits)
        self._put(keys, made[:, 0], made[:, 1])

    def count(self, raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Tokens of each pre-token raw[starts : starts + lengths]."""
        if len(self.meaning) > MOST_STATES:
            self.reset()
        order = np.argsort(-lengths, kind="stable")
        at, left = starts[order], lengths[order]
        totals, state = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        alive = len(order) - np.searchsorted(left[::-1], np.arange(int(left[0]) if len(left) else 0), "right")
        for k, n in enumerate(alive.tolist()):
            keys = state[:n] * 256 + raw[at[:n] + k]
            slot = self._find(keys)
            missing = slot < 0
            if missing.any():
                self._add(np.unique(keys[missing]))
                slot = self._find(keys)
            totals[:n] += self.emits[slot]
            state[:n] = self.goes[slot]
        out = np.empty_like(totals)
        out[order] = totals
        return out


class TokenCounter:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        self.boundaries = BoundaryMachine(Tokenizer.from_file(path))
        self.merges = MergeMachine(model["vocab"], model["merges"])

    def count(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Tokens of each text."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(n, np.int64)
        text = raw.tobytes()
        lead = np.flatnonzero((raw & 0xC0) != 0x80)  # first byte of each character
        points = np.frombuffer(text.decode().encode("utf-32-le"), np.uint32).astype(np.int64)
        begins = offsets[:-1][np.diff(offsets) > 0]
        special, p = [], text.find(SPECIAL)
        while p >= 0:
            special.append(p)
            p = text.find(SPECIAL, p + len(SPECIAL))
        special = np.array([p for p in special if np.searchsorted(offsets, p, "right") == np.searchsorted(offsets, p + len(SPECIAL) - 1, "right")], np.int64)
        after = special + len(SPECIAL)
        cuts = np.unique(np.concatenate([begins, special, after[after < len(raw)]]))
        begin = self.boundaries.starts(points, np.searchsorted(lead, cuts))
        starts = lead[np.flatnonzero(begin)]
        lengths = np.diff(starts, append=len(raw))
        document = np.searchsorted(offsets, starts, "right") - 1
        inside = np.zeros(len(starts), bool)
        if len(special):
            k = np.searchsorted(special, starts, "right") - 1
            inside = (k >= 0) & (starts < special[np.maximum(k, 0)] + len(SPECIAL))
        counts = np.zeros(len(starts), np.int64)
        plain = np.flatnonzero(~inside)
        counts[plain] = self.merges.count(raw, starts[plain], lengths[plain])
        if len(special):
            counts[np.searchsorted(starts, special)] = 1
        return np.bincount(document, counts, n).astype(np.int64)


_held: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    """One pair of machines per Python worker."""
    if path not in _held:
        _held[path] = TokenCounter(path)
    return _held[path]


def token_counts(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None, limit: int = LIMIT) -> DataFrame:
    """One row per document: id, n_bytes, n_tokens, over_limit."""
    path = tokenizer or default_tokenizer()

    def count(batches):
        for batch in batches:
            for part in slices(batch, 1, 1_500_000):
                raw, offsets = text_bytes(part.column(1))
                tokens = counter(path).count(raw, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(tokens), pa.array(tokens > limit)], ["id", "n_bytes", "n_tokens", "over_limit"])

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(count, f"id {id_type}, n_bytes long, n_tokens long, over_limit boolean").withColumnRenamed("id", id_col)


def op7_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
