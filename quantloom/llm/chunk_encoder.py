"""Whole-text encoding with the tokenizers library, each distinct piece encoded once per worker.

The byte-level pre-tokenizer never joins a character with the white space after it, so a text's ids are
the concatenation of the ids of its pieces "white space, then a word". Pieces are found and hashed as
byte arrays; the library encodes only those that the worker has not met. Texts with white space outside
ASCII or with the special string, and pieces of over 64 bytes, go to the library as they are.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

SPECIAL = b"<|endoftext|>"
LONGEST = 64
SLOT_BITS = 21
MOST_PIECES = 800_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(20_24)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_POWER = _rng.integers(1, 2**63, LONGEST, dtype=np.uint64) | np.uint64(1)
#: UTF-8 of the white space outside ASCII: first byte -> following bytes, as one number.
_WIDE_SPACES = np.array([int.from_bytes(chr(c).encode(), "big") << (24 - 8 * len(chr(c).encode())) for c in [0x85, 0xA0, 0x1680, 0x180E, *range(0x2000, 0x200C), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]])


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts and the offsets of each (null: empty), without making Python strings."""
    if pa.types.is_large_string(column.type):
        column = column.cast(pa.string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batch: pa.RecordBatch, text_index: int, most: int = 1_500_000):
    """Cut a batch so that each part holds about ``most`` bytes of text (one row at least)."""
    raw, offsets = text_bytes(batch.column(text_index))
    a = 0
    while a < batch.num_rows:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        yield batch.slice(a, b - a)
        a = b


def odd_texts(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts hold white space outside ASCII (or control separators) or the special string."""
    at = [np.flatnonzero((raw >= 0x1C) & (raw <= 0x1F))]
    lead = np.flatnonzero((raw == 0xC2) | ((raw >= 0xE1) & (raw <= 0xE3)) | (raw == 0xEF))
    if len(lead):
        padded = np.append(raw, [0, 0]).astype(np.int64)
        code = (padded[lead] << 16) | (padded[lead + 1] << 8) | np.where(padded[lead] == 0xC2, 0, padded[lead + 2])
        at.append(lead[np.isin(code, _WIDE_SPACES)])
    whole, p = raw.tobytes(), -1
    while (p := whole.find(SPECIAL, p + 1)) >= 0:
        at.append(np.array([p]))
    odd = np.zeros(len(offsets) - 1, bool)
    at = np.concatenate(at)
    odd[np.searchsorted(offsets, at, "right") - 1] = True
    return odd


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {b: chr(b) for b in plain}, 0
    for b in range(256):
        if b not in out:
            out[b], n = chr(256 + n), n + 1
    return out


_LETTERS = byte_letters()
#: One blank at most, then letters of Latin-1 in UTF-8: a single pre-token.
_ONE_WORD = re.compile(rb" ?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")


class ChunkEncoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.reset()

    def reset(self) -> None:
        self.keys = np.zeros(1 << SLOT_BITS, np.uint64)
        self.values = np.zeros(1 << SLOT_BITS, np.int32)
        self.start, self.length, self.pool = (np.zeros(n, np.int32) for n in (1 << 16, 1 << 16, 1 << 18))
        self.pieces = self.used = 0

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            there = self.keys[slot]
            hit = there == keys[rest]
            out[rest[hit]] = self.values[slot[hit]]
            more = ~hit & (there != 0)
            rest, slot = rest[more], (slot[more] + 1) & ((1 << SLOT_BITS) - 1)
        return out

    def _put(self, keys: np.ndarray, values: np.ndarray) -> None:
        slot = self._slot(keys)
        while len(keys):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], (slot[~mine] + 1) & ((1 << SLOT_BITS) - 1)

    def _library(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece; one pre-token of letters goes to the library's merge model without an Encoding around it."""
        tokenize, plain = self.tokenizer.model.tokenize, _ONE_WORD.fullmatch
        out = [[t.id for t in tokenize(p.decode("latin-1").translate(_LETTERS))] if plain(p) else None for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        for i, e in zip(rest, self.tokenizer.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    def _encode(self, pieces: list[bytes]) -> np.ndarray:
        """Encode the pieces and keep their ids; their numbers."""
        first = self.pieces
        for a in range(0, len(pieces), 50_000):
            found = self._library(pieces[a : a + 50_000])
            lengths = np.fromiter(map(len, found), np.int32, len(found))
            flat = np.fromiter((i for ids in found for i in ids), np.int32, int(lengths.sum()))
            for name, need in (("start", self.pieces + len(found)), ("length", self.pieces + len(found)), ("pool", self.used + len(flat))):
                held = getattr(self, name)
                if need > len(held):
                    setattr(self, name, np.concatenate([held, np.zeros(max(need, len(held)), np.int32)]))
            self.start[self.pieces : self.pieces + len(found)] = self.used + np.cumsum(lengths) - lengths
            self.length[self.pieces : self.pieces + len(found)] = lengths
            self.pool[self.used : self.used + len(flat)] = flat
            self.pieces += len(found)
            self.used += len(flat)
        return np.arange(first, self.pieces, dtype=np.int32)

    def encode(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and the number of ids of each text."""
        n = len(offsets) - 1
        if not len(raw):
            return np.zeros(0, np.int32), np.zeros(n, np.int64)
        if self.pieces > MOST_PIECES:
            self.reset()
        space = _SPACE[raw]
        begin = space.copy()
        begin[1:] &= ~space[:-1]
        odd = odd_texts(raw, offsets)
        for d in np.flatnonzero(odd):
            begin[offsets[d] : offsets[d + 1]] = False
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(begin)
        lengths = np.diff(starts, append=len(raw))
        document = np.searchsorted(offsets, starts, "right") - 1
        place = np.arange(len(raw), dtype=np.int32) - np.repeat(starts.astype(np.int32), lengths)
        hashes = np.add.reduceat(_BYTE[raw] * _POWER[np.minimum(place, LONGEST - 1, out=place)], starts) | np.uint64(1)
        alone = (lengths > LONGEST) | odd[document]
        index = np.full(len(starts), -1, np.int32)
        plain = np.flatnonzero(~alone)
        index[plain] = self._find(hashes[plain])
        text = raw.tobytes()
        new = plain[index[plain] < 0]
        if len(new):
            keys, first, back = np.unique(hashes[new], return_index=True, return_inverse=True)
            pieces = [text[a : a + k] for a, k in zip(starts[new[first]].tolist(), lengths[new[first]].tolist(), strict=True)]
            numbers = self._encode(pieces)
            self._put(keys, numbers)
            index[new] = numbers[back]
        lone = np.flatnonzero(alone)
        if len(lone):
            index[lone] = self._encode([text[a : a + k] for a, k in zip(starts[lone].tolist(), lengths[lone].tolist(), strict=True)])
        counts = self.length[index].astype(np.int64)
        ends = np.cumsum(counts)
        ids = self.pool[np.repeat(self.start[index] - (ends - counts), counts) + np.arange(ends[-1])]
        return ids, np.bincount(document, counts, n).astype(np.int64)


_held: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """One encoder per Python worker."""
    if path not in _held:
        _held[path] = ChunkEncoder(path)
    return _held[path]
