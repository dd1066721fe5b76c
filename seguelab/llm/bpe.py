"""Byte-pair encoding with a priority queue of merge ranks over a linked list of symbols, and decoding."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, text_slices

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The public split pattern of the 50k byte-level vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Encoded pieces that a worker remembers; beyond them it starts afresh, which costs time and changes nothing else.
MEMORY_PIECES = 500_000


def read_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    """Symbol -> rank from a file of base64 symbols and ranks."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: the pair of least rank, the leftmost of equals, merges until no pair has a rank."""
    n = len(piece)
    if n == 1:
        return [ranks[piece]]
    end = list(range(1, n + 1))  # of the symbol that starts here; 0: it has been merged into an earlier one
    before = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapify(heap)
    while heap:
        _, i, stop = heappop(heap)
        j = end[i]
        if not j or j >= n or end[j] != stop:  # stale: one of the two symbols has changed since
            continue
        end[i], end[j] = stop, 0
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


def gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes starts[0], starts[0] + 1, ... (lengths[0] of them), starts[1], ..."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    at = np.cumsum(lengths) - lengths
    return np.repeat(starts - at, lengths) + np.arange(total)


class Coder:
    """Encodes and decodes runs of texts."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        size = max(ranks.values(), default=-1) + 1
        symbols: list[bytes] = [b""] * size
        for s, r in ranks.items():
            symbols[r] = s
        self.length = np.array([len(s) for s in symbols], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(symbols), np.uint8)
        self._forget()

    def _forget(self) -> None:
        self.codes: dict[str, int] = {}
        self.pool = np.zeros(1 << 16, np.int32)
        self.used, self.places, self.sizes = 0, np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            ids = merge(piece.encode(), self.ranks)
            while self.used + len(ids) > len(self.pool):
                self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
            k = len(self.codes)
            if k >= len(self.places):
                self.places, self.sizes = (np.concatenate([x, np.zeros_like(x)]) for x in (self.places, self.sizes))
            self.pool[self.used : self.used + len(ids)] = ids
            self.places[k], self.sizes[k] = self.used, len(ids)
            self.used += len(ids)
            self.codes[piece] = k

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and the number of each text's."""
        split = [self.split(t) for t in texts]
        pieces = [p for s in split for p in s]
        if len(self.codes) > MEMORY_PIECES:
            self._forget()
        self._learn([p for p in dict.fromkeys(pieces) if p not in self.codes])
        code = np.fromiter(map(self.codes.__getitem__, pieces), np.int64, len(pieces))
        sizes = self.sizes[code]
        ids = self.pool[gather(self.places[code], sizes)]
        ends = np.cumsum([len(s) for s in split], dtype=np.int64)
        total = np.concatenate([[0], np.cumsum(sizes)])
        return ids, np.diff(total[ends], prepend=0) if len(texts) else np.zeros(0, np.int64)

    def decode(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the ids' symbols, one after the other."""
        return self.bytes[gather(self.start[ids], self.length[ids])]


_CODERS: dict[tuple[int, str], Coder] = {}


def _coder(shared, pattern: str) -> Coder:
    """A worker keeps its coder from task to task."""
    key = (shared.id, pattern) if hasattr(shared, "id") else (id(shared), pattern)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(shared.value, pattern)
    return _CODERS[key]


class _Shared:
    """A stand-in for a broadcast value that carries a stable name."""

    def __init__(self, broadcast, name: str):
        self.broadcast, self.id = broadcast, name

    @property
    def value(self):
        return self.broadcast.value


def _share(df: DataFrame, vocabulary: str) -> _Shared:
    ranks = read_ranks(vocabulary)
    return _Shared(df.sparkSession.sparkContext.broadcast(ranks), vocabulary)


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, the columns named in ``keep``, n_tokens, tokens, round_trip) for every row.

    ``round_trip`` tells whether the decoded tokens are the text's bytes again.
    A null text has null tokens, n_tokens 0 and a null round_trip; an empty one
    has no tokens.  Ids may be null or repeated.  A very long text is encoded
    whole.  An empty table gives an empty result.  The vocabulary (of a fixed
    size) is read on the driver and sent to the workers once.
    """
    shared = _share(docs, vocabulary)
    kept = [free_name(docs, f"keep_{k}") for k in range(len(keep))]
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), *(F.col(f"`{c}`").alias(n) for c, n in zip(keep, kept, strict=True)))
    fields = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[2:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, pattern)
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, buf, off in text_slices(texts):
                part = texts.slice(lo, hi - lo)
                null = np.asarray(part.is_null())
                ids, count = coder.encode(["" if t is None else t for t in part.to_pylist()])
                size = np.concatenate([[0], np.cumsum(coder.length[ids])])
                ends = np.concatenate([[0], np.cumsum(count)])
                back = coder.decode(ids)
                if len(back) == len(buf) and np.array_equal(back, buf):
                    same = np.ones(hi - lo, bool)
                else:
                    same = np.array([np.array_equal(back[size[ends[k]] : size[ends[k + 1]]], buf[off[k] : off[k + 1]]) for k in range(hi - lo)], bool)
                places = pa.array(ends.astype(np.int32), pa.int32(), mask=np.append(null, False)) if null.any() else ends.astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(c.slice(lo, hi - lo) for c in batch.columns[2:]), pa.array(count.astype(np.int64)), pa.ListArray.from_arrays(places, pa.array(ids, pa.int32())), pa.array(same, mask=null)],
                    names=["doc_id", *kept, "n_tokens", "tokens", "round_trip"],
                )

    out = rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}{fields}, n_tokens long, tokens array<int>, round_trip boolean")
    return out.select("doc_id", *(F.col(f"`{n}`").alias(c) for c, n in zip(keep, kept, strict=True)), "n_tokens", "tokens", "round_trip")


def decode_documents(encoded: DataFrame, vocabulary: str = VOCABULARY, id_col: str = "doc_id", tokens_col: str = "tokens") -> DataFrame:
    """(doc_id, text) from (doc_id, tokens); null tokens give a null text, bytes that aren't UTF-8 become U+FFFD."""
    shared = _share(encoded, vocabulary)
    rows = encoded.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{tokens_col}`").alias("tokens"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(shared, PATTERN)
        for batch in batches:
            texts = [None if t is None else coder.decode(np.array(t, np.int64)).tobytes().decode(errors="replace") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, text string")
