"""BPE encoding and decoding with content-defined chunks, for tokenizers that drop white space.

A rolling hash over the last bytes cuts texts into chunks where their content says so, so a passage that
many documents share falls into the same chunks wherever it stands. Each worker encodes and decodes a
chunk once and keeps both results. A chunk's own words are those with white space on both sides inside it;
the words at its ends depend on its neighbours. So every join is repaired: what stands between the last
white space before it and the first one after it is encoded anew, over as many chunks as that takes. At white space the
tokens of the repaired part and of the chunks agree exactly, whatever stands beyond: normalization, pre-tokens,
merges and special strings never reach across ASCII white space in such a tokenizer (checked when it is loaded).

Chunks and words are looked up by their bytes, so equal hashes of different chunks change nothing.

Defined cases: null text counts as empty (no tokens, empty decoded text); very long texts are encoded whole; special
strings become their ids, as the library has it; each input row gives one output row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quantloom.llm.chunk_encoder import slices, text_bytes

WINDOW = 16
#: A cut where so many leading bits of the rolling hash are 0: a chunk has 2^CUT_BITS bytes on average.
CUT_BITS = 7
LONGEST_CHUNK = 2048
BLOCK = 1 << 20
#: A worker's memory: chunks and words kept, and the bytes of the longest word kept.
MOST_CHUNKS = 100_000
MOST_WORDS = 400_000
LONGEST_WORD = 256

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_rng = np.random.default_rng(13)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64)
_STEP = int(_rng.integers(1, 2**62)) * 8 + 5


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class RollingHash:
    """Cuts of a byte array, from the hash of the WINDOW bytes before each."""

    def __init__(self):
        self.up = np.cumprod(np.full(BLOCK, _STEP, np.uint64))
        self.down = np.cumprod(np.full(BLOCK, pow(_STEP, -1, 1 << 64), np.uint64))

    def cuts(self, raw: np.ndarray) -> np.ndarray:
        out = []
        for a in range(0, len(raw), BLOCK - WINDOW):
            part = raw[a : a + BLOCK]
            total = np.cumsum(_BYTE[part] * self.up[: len(part)])
            rolled = (total[WINDOW:] - total[:-WINDOW]) * self.down[WINDOW : len(part)]
            out.append(np.flatnonzero(rolled >> np.uint64(64 - CUT_BITS) == 0) + a + WINDOW + 1)
        return np.concatenate(out) if out else np.zeros(0, np.int64)


class ChunkCoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            if json.load(f).get("decoder") is not None:
                raise ValueError(f"{path}: tokens are joined by blanks here, but the tokenizer has a decoder")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        ids = lambda text: self.tokenizer.encode(text, add_special_tokens=False).ids
        for space in " \t\n\x0b\x0c\r":
            if ids(f"a{space}{space}́b's{space}1") != ids("a") + ids("́b's") + ids("1"):
                raise ValueError(f"{path}: the tokenizer keeps white space")
        self.names = {i: name for name, i in self.tokenizer.get_vocab(with_added_tokens=True).items()}
        self.rolling = RollingHash()
        self.words: dict[bytes, tuple[bytes, bytes]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes]] = {}

    def _result(self, ids: list[int]) -> tuple[bytes, bytes]:
        """Ids as little-endian 32-bit integers, and the decoded text."""
        return np.array(ids, "<u4").tobytes(), " ".join(map(self.names.__getitem__, ids)).encode()

    def _join(self, parts) -> tuple[bytes, bytes]:
        """Results one after another; a part without tokens takes no blank."""
        parts = [p for p in parts if p[0]]
        return b"".join([p[0] for p in parts]), b" ".join([p[1] for p in parts])

    def _meet(self, pieces: list[bytes]) -> dict[bytes, tuple[bytes, bytes]]:
        """Encode the words of ``pieces`` that are not kept; the results of those too long to keep."""
        if len(self.words) > MOST_WORDS:
            self.words.clear()
        new = list({w for p in pieces for w in p.split()}.difference(self.words))
        long = {}
        for a in range(0, len(new), 20_000):
            part = new[a : a + 20_000]
            for word, e in zip(part, self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False), strict=True):
                (self.words if len(word) <= LONGEST_WORD else long)[word] = self._result(e.ids)
        return long

    def code(self, raw: np.ndarray, offsets: np.ndarray) -> list[tuple[bytes, bytes]]:
        """(ids, decoded text) of each text."""
        text = raw.tobytes()
        cuts = np.unique(np.concatenate([self.rolling.cuts(raw), offsets]))
        gaps = np.diff(cuts)
        if len(gaps) and gaps.max() > LONGEST_CHUNK:
            far = np.flatnonzero(gaps > LONGEST_CHUNK)
            cuts = np.union1d(cuts, np.concatenate([np.arange(cuts[i], cuts[i + 1], LONGEST_CHUNK) for i in far]))
        spaces = np.flatnonzero(_SPACE[raw])
        first, last = np.searchsorted(spaces, cuts[:-1]), np.searchsorted(spaces, cuts[1:]) - 1
        inner = np.flatnonzero(first < last)  # chunks with words between two white spaces of their own
        begin, end = spaces[first[inner]], spaces[last[inner]]
        document = np.searchsorted(offsets, begin, "right") - 1
        edges = np.searchsorted(document, np.arange(len(offsets)))
        begin, end = begin.tolist(), end.tolist()
        order, chunks, joins = [], [], []  # pieces in order of the text: chunk, join, chunk, ..., join
        for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
            mine = []
            for i in range(edges[d], edges[d + 1]):
                mine += [text[a : begin[i]], text[begin[i] : end[i]]]
                a = end[i]
            mine.append(text[a:b])
            joins += mine[::2]
            chunks += mine[1::2]
            order.append(mine)
        if len(self.chunks) > MOST_CHUNKS:
            self.chunks.clear()
        new = list(set(chunks).difference(self.chunks))
        long = self._meet(new + joins)
        found = {**self.words, **long} if long else self.words
        encode = lambda piece: self._join([found[w] for w in piece.split()])
        for piece in new:
            self.chunks[piece] = encode(piece)
        return [self._join([self.chunks[p] if i % 2 else encode(p) for i, p in enumerate(mine)]) for mine in order]


_held: dict[str, ChunkCoder] = {}


def coder(path: str) -> ChunkCoder:
    """One coder per Python worker."""
    if path not in _held:
        _held[path] = ChunkCoder(path)
    return _held[path]


def encode_decode(docs: DataFrame, id_col="doc_id", text_col="text", tokenizer: str | None = None) -> DataFrame:
    """One row per document: id, ids (little-endian 32-bit integers, as binary) and decoded (text)."""
    path = tokenizer or default_tokenizer()

    def run(batches):
        for batch in batches:
            for part in slices(batch, 1):
                rows = coder(path).code(*text_bytes(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.binary()).cast(pa.string())], ["id", "ids", "decoded"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def op13_chunk_bpe(spark, sf_dir: str) -> DataFrame:
    rows = encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
