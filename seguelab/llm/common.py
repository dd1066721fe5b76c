"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_table, materialize  # noqa: F401


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or ``name_1``, ``name_2`` ... where the table has such a column already (case is ignored)."""
    taken, candidate, n = {c.lower() for c in df.columns}, name, 0
    while candidate.lower() in taken:
        n += 1
        candidate = f"{name}_{n}"
    return candidate


def keyed_text(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) alone, under names of our own, so that no other column can clash; ids keep their type."""
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def hex_fraction(digest: Column) -> Column:
    """The first 52 bits of a hexadecimal digest as a number in [0, 1)."""
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


# --- vectorised text -------------------------------------------------------

MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_CODE = np.arange(256, dtype=np.uint8)
LOWER = np.where((_CODE >= 65) & (_CODE <= 90), _CODE + 32, _CODE).astype(np.uint8)
IS_WORD = ((_CODE >= 48) & (_CODE <= 57)) | ((_CODE >= 65) & (_CODE <= 90)) | ((_CODE >= 97) & (_CODE <= 122)) | (_CODE >= 128)
IS_TOKEN = ~np.isin(_CODE, np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8))
_EXACT_TABLE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64) | np.uint64(1)
_LOWER_TABLE = _EXACT_TABLE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and their inverses."""
    if "p" not in _POWERS or len(_POWERS["p"]) < n:
        size = max(n, 1 << 20)
        for key, base in (("p", _BASE), ("i", pow(_BASE, -1, 2**64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[key] = np.multiply.accumulate(steps)
    return _POWERS["p"], _POWERS["i"]


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    return x


def text_slices(texts: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows of about ``most_bytes``; a longer text is a run of its own.

    A null text counts as empty.
    """
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    n = len(texts)
    if n == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    _, places, data = texts.buffers()
    off = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + most_bytes, side="right")) - 1)
        yield lo, hi, raw[off[lo] : off[hi]], off[lo : hi + 1] - off[lo]
        lo = hi


def runs(flag: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes within each text, and the texts' places in the list of runs."""
    n = len(flag)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = flag[:-1]
    start = np.flatnonzero(flag & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = flag[1:]
    end = np.flatnonzero(flag & (~after | edge[1:])) + 1
    return start, end, np.searchsorted(start, off)


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray = _LOWER_TABLE) -> np.ndarray:
    """A 64-bit hash of each span of bytes; equal spans have equal hashes."""
    n = len(buf)
    power, inverse = _powers(n + 1)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(table[buf] * power[:n], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def words(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a run of texts, and each text's first word (one more entry at the end).

    A word is a run of ASCII letters, digits and bytes of other characters; case of ASCII letters is ignored.
    """
    start, end, first = runs(IS_WORD[buf], off)
    return span_hashes(buf, start, end), start, end, first


def rows_of(first: np.ndarray) -> np.ndarray:
    """The text of each word, from the texts' first words."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)
