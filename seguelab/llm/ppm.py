"""Language-model scores by prediction by partial matching over bytes, with escape method C and symbol exclusion.

The pretrained model is the trie of all byte contexts up to ``ORDER`` of the whole
corpus.  So that no document is scored by its own counts, there are two tries: a
document belongs to one of two folds by the hash of its text (copies fall
together) and is scored by the trie of the other fold.

Where the trie is fixed, the code length of a byte depends on the bytes of its
context alone.  So each distinct (context, byte) is scored once, and a document's
code length is a sum over its distinct ones.  The start of a text is a symbol
of its own in contexts.

Texts are dealt into chunks of a bounded size with the distinct entries of each,
which is all that is shuffled: they are counted for the model, meet its scores by
a join, and come back to their chunk before its texts.  Neither the driver nor a
worker ever holds the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log2

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop_table, materialize, text_slices

ORDER = 4
#: Bytes of text whose distinct entries a worker holds at a time; a longer text is a chunk of its own.
CHUNK_BYTES = 32 << 20
#: Entries in a row of a chunk's list.
_PACK = 1024
_W = 9  # bits of a symbol: 0 before the text starts, else the byte and one
_ROWS = 1 << 16


class Trie:
    """A byte-context trie that learns as it goes; for adaptive scores and as the plain form of the pretrained ones."""

    def __init__(self, order: int = ORDER):
        self.order, self.counts = order, {}

    def learn(self, context: tuple[int, ...], symbol: int) -> None:
        for k in range(self.order + 1):
            node = self.counts.setdefault(context[len(context) - k :], {})
            node[symbol] = node.get(symbol, 0) + 1

    def bits(self, context: tuple[int, ...], symbol: int) -> float:
        total, seen = 0.0, frozenset()
        for k in range(self.order, -1, -1):
            node = self.counts.get(context[len(context) - k :])
            if not node:
                continue
            left = {s: n for s, n in node.items() if s not in seen}
            whole = sum(left.values()) + len(left)
            if symbol in left:
                return total - log2(left[symbol] / whole)
            if left:
                total -= log2(len(left) / whole)
            seen = seen | node.keys()
        return total + log2(256 - len(seen))


def contexts(text: bytes, order: int = ORDER) -> Iterator[tuple[tuple[int, ...], int]]:
    padded = (0,) * order + tuple(b + 1 for b in text)
    for i in range(order, len(padded)):
        yield padded[i - order : i], padded[i]


def adaptive_bits(text: bytes, order: int = ORDER) -> float:
    """The code length of a text by a trie that starts empty and learns each byte after it is coded."""
    trie, total = Trie(order), 0.0
    for context, symbol in contexts(text, order):
        total += trie.bits(context, symbol)
        trie.learn(context, symbol)
    return total


def grams(buf: np.ndarray, off: np.ndarray, order: int = ORDER) -> np.ndarray:
    """uint64 of each byte's symbol (lowest bits) and those of its context, the nearest first."""
    symbol = buf.astype(np.uint64) + np.uint64(1)
    out, start, stop = symbol.copy(), off[:-1], off[1:]
    for k in range(1, order + 1):
        before = np.zeros(len(buf), np.uint64)
        before[k:] = symbol[:-k] if k < len(buf) else symbol[:0]
        for j in range(k):
            at = start + j
            before[at[at < stop]] = 0
        out |= before << np.uint64(_W * k)
    return out


def _runs(sorted_keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    head = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)
    return sorted_keys[head], np.diff(np.append(head, len(sorted_keys)))


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts


def _lists(offsets: np.ndarray, values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def _coder(order: int, chunk_bytes: int):
    """Each text with its chunk, and at a chunk's end its distinct entries (gram * 2 + fold) with their counts."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, size, held, parts = TaskContext.get().partitionId() << 32, 0, 0, []

        def entries():
            keys, counts = _merged(parts)
            for lo in range(0, len(keys), _PACK * 256):
                k, n = keys[lo : lo + _PACK * 256].astype(np.int64), counts[lo : lo + _PACK * 256].astype(np.int64)
                ends = np.append(np.arange(0, len(k), _PACK), len(k))
                rows = len(ends) - 1
                yield pa.RecordBatch.from_arrays([pa.array(np.full(rows, chunk)), pa.nulls(rows, kind), pa.nulls(rows, pa.string()), pa.nulls(rows, pa.int8()), _lists(ends, pa.array(k)), _lists(ends, pa.array(n))], names=names)

        names, kind = ["chunk", "doc_id", "text", "fold", "entries", "counts"], None
        for batch in batches:
            texts, folds, ids = batch.column(0), batch.column(1), batch.column(2)
            kind = ids.type
            number = column(batch, "fold").astype(np.uint64)
            for lo, hi, buf, off in text_slices(texts, 1 << 21):
                key = grams(buf, off, order) << np.uint64(1) | np.repeat(number[lo:hi], np.diff(off))
                key.sort()
                parts.append(_runs(key))
                held, size = held + len(parts[-1][0]), size + len(buf)
                n = hi - lo
                empty = pa.nulls(n, pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), ids.slice(lo, n), texts.slice(lo, n), folds.slice(lo, n), empty, empty], names=names)
                if held > 6_000_000:
                    parts = [_merged(parts)]
                    held = len(parts[0][0])
                if size >= chunk_bytes:
                    yield from entries()
                    chunk, size, held, parts = chunk + 1, 0, 0, []
        if parts:
            yield from entries()

    return code


def _low_counts(counted: DataFrame, order: int) -> np.ndarray:
    """int64[fold, nearest context symbol, symbol], of a size that the alphabet bounds."""
    mask = (1 << _W) - 1
    small = counted.groupBy("fold", F.col("gram").bitwiseAND(F.lit(mask)).alias("s"), F.shiftright("gram", _W).bitwiseAND(F.lit(mask)).alias("c")).agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((2, mask + 1, mask + 1), np.int64)
    out[small["fold"], small["c"], small["s"]] = small["n"]
    return out


def _level(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For contexts and symbols ``key`` with counts ``n``: each entry's count, and its context's number, total and distinct symbols."""
    uniq, inverse = np.unique(key, return_inverse=True)
    count = np.bincount(inverse, n, minlength=len(uniq))
    _, node = np.unique(uniq >> np.uint64(_W), return_inverse=True)
    total, kinds = np.bincount(node, count), np.bincount(node, count > 0)
    return count[inverse], node[inverse], total[node][inverse], kinds[node][inverse]


def code_lengths(gram: np.ndarray, n: np.ndarray, low: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Bits of each (context, symbol) under the trie with the counts ``n`` of these entries.

    ``low``: int64[context symbol, symbol] of the whole corpus.  All entries that share
    their two nearest context symbols must be here (their one symbol where the
    order is 1).
    """
    gram = gram.astype(np.uint64)
    s = (gram & np.uint64((1 << _W) - 1)).astype(np.int64)
    c = (gram >> np.uint64(_W) & np.uint64((1 << _W) - 1)).astype(np.int64)
    zero = low.sum(axis=0)
    levels = []
    for k in range(order, 1, -1):
        levels.append(_level(gram & np.uint64((1 << _W * (k + 1)) - 1), n))
    if order >= 1:
        levels.append((low[c, s].astype(float), None, low.sum(axis=1)[c].astype(float), (low > 0).sum(axis=1)[c].astype(float)))
    levels.append((zero[s].astype(float), None, np.full(len(s), float(zero.sum())), np.full(len(s), float((zero > 0).sum()))))
    bits, open_ = np.zeros(len(gram)), np.ones(len(gram), bool)
    seen_kinds, seen_total = np.zeros(len(gram)), np.zeros(len(gram))  # of the order above, counted in this one
    for i, (count, node, total, kinds) in enumerate(levels):
        left, whole = kinds - seen_kinds, total - seen_total + kinds - seen_kinds
        with np.errstate(divide="ignore", invalid="ignore"):
            hit = open_ & (count > 0)
            bits[hit] -= np.log2(count[hit] / whole[hit])
            escape = open_ & ~hit & (left > 0)
            bits[escape] -= np.log2(left[escape] / whole[escape])
        open_ &= ~hit
        if i + 1 < len(levels):
            below = levels[i + 1][0]
            seen_kinds = kinds
            if node is not None:
                key = node.astype(np.uint64) << np.uint64(_W) | s.astype(np.uint64)
                _, one = np.unique(key, return_index=True)
                one = one[count[one] > 0]
                seen_total = np.bincount(node[one], below[one], minlength=int(node.max(initial=-1)) + 1)[node]
            else:
                seen_total = ((low > 0) * zero).sum(axis=1)[c].astype(float)
    bits[open_] += np.log2(256 - np.minimum((zero > 0).sum(), 255))
    return bits


def _scorer_of_entries(low: np.ndarray, order: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(column(b, "gram"), column(b, "a"), column(b, "b")) for b in batches if b.num_rows]
        if not parts:
            return
        gram, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
        for fold, own, other in ((0, a, b), (1, b, a)):
            bits = code_lengths(gram, other.astype(float), low[1 - fold], order)
            has = np.flatnonzero(own > 0)
            for lo in range(0, len(has), 1 << 18):
                at = has[lo : lo + (1 << 18)]
                yield pa.RecordBatch.from_arrays([pa.array(gram[at] * 2 + fold), pa.array(bits[at])], names=["entry", "bits"])

    return score


def _folded(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    return docs.select(text.alias("text"), F.pmod(F.xxhash64(text), F.lit(2)).cast("byte").alias("fold"), F.col(f"`{id_col}`").alias("doc_id"))


def code_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The texts with their chunks, and the chunks' distinct entries, written to the shared folder."""
    if not 1 <= order <= 5:
        raise ValueError("the order must be from 1 to 5")
    rows = _folded(docs, id_col, text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    return materialize(rows.mapInArrow(_coder(order, chunk_bytes), f"chunk long, doc_id {kind}, text string, fold byte, entries array<long>, counts array<long>"), "coded")


def _entries(coded: DataFrame) -> DataFrame:
    return coded.filter("entries is not null").select("chunk", F.explode(F.arrays_zip("entries", "counts")).alias("x")).select("chunk", F.col("x.entries").alias("entry"), F.col("x.counts").alias("n"))


def train(coded: DataFrame, order: int = ORDER) -> DataFrame:
    """(entry, bits) for each (context, byte) that occurs in a fold, under the trie of the other; entry = gram * 2 + fold."""
    of = lambda fold: F.sum(F.when(F.col("entry").bitwiseAND(F.lit(1)) == fold, F.col("n")).otherwise(0))
    counted = materialize(_entries(coded).groupBy(F.shiftright("entry", 1).alias("gram")).agg(of(0).alias("a"), of(1).alias("b")), "counts")
    long = counted.select("gram", F.explode(F.array(F.struct(F.lit(0).alias("fold"), F.col("a").alias("n")), F.struct(F.lit(1).alias("fold"), F.col("b").alias("n")))).alias("x")).select("gram", "x.fold", "x.n").filter("n > 0")
    low = _low_counts(long, order)
    near = F.shiftright("gram", _W).bitwiseAND(F.lit((1 << 2 * _W) - 1 if order > 1 else (1 << _W) - 1))
    model = materialize(counted.repartition(near).mapInArrow(_scorer_of_entries(low, order), "entry long, bits double"), "model")
    drop_table(counted)
    return model


def _rows(batch: pa.RecordBatch, order: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, sizes, entry, row, count) of runs of a batch's rows; entries are in order."""
    folds = column(batch, "fold").astype(np.uint64)
    for low in range(0, batch.num_rows, _ROWS):
        for lo, hi, buf, off in text_slices(batch.column(0).slice(low, _ROWS), 1 << 21):
            size = np.diff(off)
            key = grams(buf, off, order) << np.uint64(1) | np.repeat(folds[low + lo : low + hi], size)
            if order <= 4:
                key = key << np.uint64(16) | np.repeat(np.arange(hi - lo, dtype=np.uint64), size)
                key.sort()
                key, count = _runs(key)
                yield low + lo, low + hi, size, (key >> np.uint64(16)).astype(np.int64), (key & np.uint64(_ROWS - 1)).astype(np.int64), count
            else:
                row = np.repeat(np.arange(hi - lo), size)
                at = np.argsort(key, kind="stable")
                yield low + lo, low + hi, size, key[at].astype(np.int64), row[at], np.ones(len(at), np.int64)


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(chunk, entry, bits) as lists by chunk."""
    held, count = [], 0

    def out():
        chunk, entry, bits = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.argsort(chunk, kind="stable")
        chunk, entry, bits = chunk[at], entry[at], bits[at]
        head = np.concatenate([[True], chunk[1:] != chunk[:-1]])
        head |= (np.arange(len(chunk)) - np.maximum.accumulate(np.where(head, np.arange(len(chunk)), 0))) % _PACK == 0
        start = np.flatnonzero(head)
        ends = np.append(start, len(chunk))
        return pa.RecordBatch.from_arrays([pa.array(chunk[start]), _lists(ends, pa.array(entry)), _lists(ends, pa.array(bits.astype(np.float32)))], names=["chunk", "entries", "bits"])

    for batch in batches:
        if batch.num_rows:
            held.append(tuple(column(batch, k) for k in ("chunk", "entry", "bits")))
            count += batch.num_rows
        if count > 2_000_000:
            yield out()
            held, count = [], 0
    if held:
        yield out()


def _scorer_of_texts(order: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts, ready = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            chunks, is_text = column(batch, "chunk"), column(batch, "is_text").astype(bool)
            edge = np.append(np.flatnonzero(np.concatenate([[True], (chunks[1:] != chunks[:-1]) | (is_text[1:] != is_text[:-1])])), len(chunks))
            for start, stop in zip(edge[:-1], edge[1:], strict=True):
                part = batch.slice(start, stop - start)
                if chunks[start] != current:
                    current, parts, ready = chunks[start], [], None
                if not is_text[start]:
                    parts.append(tuple(part.column(part.schema.get_field_index(k)).flatten().to_numpy() for k in ("entries", "bits")))
                    continue
                if ready is None:
                    entries, bits = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64), np.zeros(0, np.float32))
                    at = np.argsort(entries, kind="stable")
                    ready, parts = (entries[at], bits[at].astype(np.float64)), []
                for lo, hi, size, entry, row, count in _rows(part, order):
                    total = np.bincount(row, ready[1][np.searchsorted(ready[0], entry)] * count, minlength=hi - lo) if len(entry) else np.zeros(hi - lo)
                    yield pa.RecordBatch.from_arrays([part.column(part.schema.get_field_index("doc_id")).slice(lo, hi - lo), pa.array(size), pa.array(np.round(total, 2))], names=["doc_id", "n_bytes", "bits"])

    return run


def score_documents(coded: DataFrame, model: DataFrame, order: int = ORDER) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte) for every row, by a model that :func:`train` made from the same texts."""
    kind = coded.schema["doc_id"].dataType.simpleString()
    met = _entries(coded).select("chunk", "entry").join(model, "entry").mapInArrow(_pack, "chunk long, entries array<long>, bits array<float>")
    lists = met.select(F.lit(None).cast("string").alias("text"), F.lit(None).cast("byte").alias("fold"), F.lit(None).cast(kind).alias("doc_id"), "chunk", F.lit(False).alias("is_text"), "entries", "bits")
    texts = coded.filter("text is not null").select("text", "fold", "doc_id", "chunk", F.lit(True).alias("is_text"), F.lit(None).cast("array<long>").alias("entries"), F.lit(None).cast("array<float>").alias("bits"))
    dealt = lists.unionByName(texts).repartition("chunk").sortWithinPartitions("chunk", "is_text")
    scored = dealt.mapInArrow(_scorer_of_texts(order), f"doc_id {kind}, n_bytes long, bits double")
    return scored.select("doc_id", "n_bytes", "bits", F.when(F.col("n_bytes") > 0, F.round(F.col("bits") / F.col("n_bytes"), 4)).alias("bits_per_byte"))


def code_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_bytes, bits, bits_per_byte): each row's code length under the trie of the other fold's whole texts.

    A null or empty text has 0 bytes, 0 bits and a null rate.  Null and repeated
    ids and repeated rows are scored row by row; copies count in the trie as often
    as they occur.  Ids keep their type; a very long text is scored whole.  Where
    the other fold is empty, each byte takes 8 bits.  An empty table gives an empty
    result; other columns are ignored.
    """
    coded = code_texts(docs, id_col, text_col, order, chunk_bytes)
    return score_documents(coded, train(coded, order), order)


def adaptive_code_length(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER) -> DataFrame:
    """As :func:`code_length`, each text by a trie of its own that starts empty (a Python loop over the bytes: for small tables)."""
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode() for t in batch.column(1).to_pylist()]
            bits = [round(adaptive_bits(t, order), 2) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array(bits, pa.float64()), pa.array([round(b / len(t), 4) if t else None for b, t in zip(bits, texts, strict=True)], pa.float64())], names=["doc_id", "n_bytes", "bits", "bits_per_byte"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, bits double, bits_per_byte double")
