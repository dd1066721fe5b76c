"""Near-duplicate documents by MinHash, with odd sketches to verify the banded candidates.

The k samples of a document's MinHash signature are folded into a parity bitmap
(an odd sketch): each (sample number, value) flips one bit.  The exclusive or of
two bitmaps is the bitmap of the samples on which the documents differ, so its
population count estimates their Jaccard similarity, precisely when it is high.

Texts of one signature are one node.  Nodes of a band meet in its bucket: each is
compared with the bucket's least node, and one that differs from it with all
others.  Buckets are counted, never gathered: all of it is joins and aggregates
on short rows, and the second comparison goes by parts of a bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, drop_table, free_name, keyed_text, materialize, mix, rows_of, text_slices, words
from .components import components, unite

SAMPLES, ROWS, BITS, SHINGLE, THRESHOLD = 128, 4, 512, 3, 0.5
#: Members of a bucket that meet in one task; the parts of a larger bucket meet one by one.
PART_ROWS = 4096
_RNG = np.random.default_rng(7919)
_MULTIPLY = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _RNG.integers(0, 2**32, SAMPLES, dtype=np.uint64).astype(np.uint32)
_SALT = mix(np.arange(1, SAMPLES + 1, dtype=np.uint64))
_FACTORS = mix(np.arange(1000, 1064, dtype=np.uint64)) | np.uint64(1)


def shingles(h: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's word shingles and the texts' first ones; a text of fewer words has one shingle of them all."""
    count = np.diff(first)
    row = rows_of(first)
    total = np.zeros(len(h), np.uint64)
    for k in range(size):
        part = np.zeros(len(h), np.uint64)
        if k < len(h):
            part[: len(h) - k] = np.where(row[k:] == row[: len(row) - k], h[k:], np.uint64(k + 1))
            if k:
                part[len(h) - k :] = np.uint64(k + 1)
        total += part * _FACTORS[k]
    place = np.arange(len(h)) - first[:-1][row]
    keep = (place + size <= count[row]) | (place == 0)
    n = np.where(count > 0, np.maximum(count - size + 1, 1), 0)
    return mix(total[keep]), np.concatenate([[0], np.cumsum(n)])


def signatures(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """uint32[texts, SAMPLES] for texts with shingles only (``first`` must rise strictly)."""
    x = (h >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(first) - 1, SAMPLES), np.uint32)
    if len(out):
        for j in range(SAMPLES):
            y = x * _MULTIPLY[j]
            y += _ADD[j]
            out[:, j] = np.minimum.reduceat(y, first[:-1])
    return out


def odd_sketches(sig: np.ndarray) -> np.ndarray:
    """uint8[texts, BITS / 8]."""
    n = len(sig)
    bit = mix(sig.astype(np.uint64) ^ _SALT) >> np.uint64(64 - BITS.bit_length() + 1)
    flat = (np.arange(n, dtype=np.int64)[:, None] * BITS + bit.astype(np.int64)).ravel()
    return np.packbits(np.bincount(flat, minlength=n * BITS).reshape(n, BITS).astype(np.uint8) & 1, axis=1)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """int64[texts, bands]; the band's number is part of its key."""
    n = len(sig)
    parts = sig.reshape(n, SAMPLES // ROWS, ROWS).astype(np.uint64)
    key = np.full((n, SAMPLES // ROWS), np.uint64(0))
    for k in range(ROWS):
        key = mix(key * _FACTORS[k] + parts[:, :, k] + np.uint64(k + 1))
    return mix(key + _FACTORS[: SAMPLES // ROWS]).view(np.int64)


def similarity(difference: np.ndarray) -> np.ndarray:
    """The Jaccard similarity that a population count of an exclusive or stands for."""
    share = np.minimum(2.0 * difference / BITS, 1 - 1e-9)
    return np.maximum(0.0, 1 + BITS * np.log1p(-share) / (4 * SAMPLES))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1)
        for lo, hi, buf, off in text_slices(texts):
            h, _, _, first = words(buf, off)
            g, at = shingles(h, first, SHINGLE)
            has = np.diff(at) > 0
            if not has.any():
                continue
            sig = signatures(g, np.concatenate([at[:-1][has], at[-1:]]))
            node = np.zeros(len(sig), np.uint64)
            for j in range(SAMPLES):
                node = mix(node + sig[:, j] + np.uint64(j))
            lists = band_keys(sig), np.ascontiguousarray(odd_sketches(sig)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).filter(pa.array(has)), pa.array(node.view(np.int64)), *(pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32), pa.array(x.ravel())) for x in lists)],
                names=["id", "node", "bands", "sketch"],
            )


def most_different(threshold: float) -> int:
    """The most differing bits of two sketches that still stand for the threshold; -1 if none do."""
    return int(np.count_nonzero(similarity(np.arange(BITS + 1)) >= threshold)) - 1


def _difference(a: str, b: str) -> Column:
    return reduce(lambda x, y: x + y, (F.bit_count(F.col(a)[k].bitwiseXOR(F.col(b)[k])) for k in range(BITS // 64)))


def verify_rest(node: np.ndarray, rest: np.ndarray, sketch: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its group), of a bucket's rows, those of ``rest`` compared with all others; unlinked nodes are left out."""
    order = np.argsort(node, kind="stable")
    node, rest, sketch = node[order], rest[order], sketch[order]
    head = np.concatenate([[True], node[1:] != node[:-1]])
    group = np.cumsum(head) - 1
    asks = np.zeros(int(head.sum()), bool)
    asks[group[rest]] = True
    node, sketch = node[head], sketch[head]
    root, wanted = np.arange(len(node)), np.flatnonzero(asks)
    for lo in range(0, len(wanted), 256):
        a = wanted[lo : lo + 256]
        for start in range(0, len(node), 4096):
            i, j = np.nonzero(np.bitwise_count(sketch[a][:, None] ^ sketch[None, start : start + 4096]).sum(axis=2, dtype=np.int64) <= most)
            root = unite(root, a[i], start + j)
    linked = np.flatnonzero(root != np.arange(len(node)))
    return node[linked], node[root[linked]]


def _verifier(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            node, rest, sketch = (np.concatenate(x) for x in zip(*(h[1:] for h in held), strict=True))
            a, b = verify_rest(node, rest, sketch, most)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.stack([column(batch, k) for k in ("key", "part", "rest_part")], axis=1)
            listed = batch.column(batch.schema.get_field_index("sketch"))
            parts = column(batch, "node"), column(batch, "rest").astype(bool), listed.flatten().to_numpy().view(np.uint64).reshape(-1, BITS // 64)
            edge = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])), len(key))
            for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                if held and held[0][0] != tuple(key[lo]):
                    yield flush()
                    held.clear()
                held.append((tuple(key[lo]), *(p[lo:hi] for p in parts)))
        if held:
            yield flush()

    return run


def _links(kept: DataFrame, threshold: float, part_rows: int) -> tuple[DataFrame, list[DataFrame]]:
    """(a, b): edges that connect the nodes which share a band and whose sketches stand for at least the threshold; and the tables that they are read from."""
    most = most_different(threshold)
    members = kept.select("node", F.explode("bands").alias("key"))
    buckets = members.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("n")).filter("n > 1")
    # one short row for each bucket: hashed, so that the bands, many to each text, needn't be sorted
    met = materialize(members.join(buckets.hint("shuffle_hash"), "key").filter("node <> leader"), "buckets")
    sketches = kept.select("node", "sketch")
    pairs = met.select("node", "leader").distinct().join(sketches.withColumnRenamed("sketch", "own"), "node")
    pairs = pairs.join(sketches.select(F.col("node").alias("leader"), F.col("sketch").alias("other")), "leader")
    judged = materialize(pairs.select("node", "leader", (_difference("own", "other") <= most).alias("near")), "judged")
    near = judged.filter("near").select(F.col("node").alias("a"), F.col("leader").alias("b"))
    rest = materialize(met.join(judged.filter("not near"), ["node", "leader"]).select("key", "node", "n"), "rest")
    if rest.isEmpty():
        return near, [met, judged, rest]
    pieces = lambda n: F.ceil(F.col(n) / part_rows).cast("int")
    place = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    sizes = rest.groupBy("key").agg(F.max("n").alias("n"), F.count("*").alias("r")).select("key", pieces("n").alias("parts"), pieces("r").alias("rest_parts"))
    known = met.join(sizes, "key").select("key", "node", place("parts").alias("part"), each("rest_parts").alias("rest_part"), F.lit(False).alias("rest"))
    asked = rest.join(sizes, "key").select("key", "node", each("parts").alias("part"), place("rest_parts").alias("rest_part"), F.lit(True).alias("rest"))
    order = ("key", "part", "rest_part")
    grouped = known.unionByName(asked).join(sketches, "node").repartition(*order).sortWithinPartitions(*order)
    return near.union(grouped.mapInArrow(_verifier(most), "a long, b long")), [met, judged, rest]


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, part_rows: int = PART_ROWS) -> DataFrame:
    """(doc_id, kept_id): every document that duplicates an earlier one, with the one of its group that stays, the least id.

    Documents are near duplicates where a chain of pairs leads from one to the
    other whose estimated Jaccard similarity over three-word shingles is at
    least ``threshold``.  Words are compared without the case of ASCII letters
    and without punctuation.

    * A null, empty or wordless text duplicates nothing; a null id is left out.
    * A text of one or two words is one shingle.
    * Rows with the same id and text count once; an id with several texts is
      in the groups of all of them.
    * Ids keep their type; a very long text is read whole.
    * An empty table gives an empty result; other columns are ignored.
    """
    rows = keyed_text(docs, id_col, text_col).filter("id is not null and text is not null")
    kind = rows.schema["id"].dataType.simpleString()
    signed = materialize(rows.mapInArrow(_sign, f"id {kind}, node long, bands array<long>, sketch array<long>"), "signatures")
    kept = materialize(signed.groupBy("node").agg(F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "distinct")
    owners = signed.select("id", "node")
    several = owners.groupBy("id").agg(F.min("node").alias("b"), F.max("node").alias("c")).filter("b <> c").select("id", "b")
    of_one_id = owners.join(several, "id").select(F.col("node").alias("a"), "b")
    links, tables = _links(kept, threshold, part_rows)
    groups = components(links.union(of_one_id))
    for table in (kept, *tables):
        drop_table(table)
    placed = owners.join(groups, "node", "left").select("id", F.coalesce("root", "node").alias("root"))
    least = placed.groupBy("root").agg(F.min("id").alias("kept_id"), F.count("*").alias("n")).filter("n > 1").select("root", "kept_id")
    return placed.join(least, "root").filter("id <> kept_id").select(F.col("id").alias("doc_id"), "kept_id").distinct()


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that :func:`near_duplicates` lists; one document of each group stays.

    Rows that repeat an id count as copies: the one of the least text (a null one
    first), then of the least hash of all columns, stays.  Rows with a null id and
    rows with a null, empty or wordless text of an id of their own stay.  Columns
    are those of ``docs``.
    """
    drops = near_duplicates(docs, id_col, text_col, threshold)
    gone = free_name(docs, "gone")
    match = F.col(f"`{id_col}`") == F.col(gone)
    left = docs.join(drops.select(F.col("doc_id").alias(gone)), match, "left_anti")
    again = materialize(docs.groupBy(F.col(f"`{id_col}`").alias(gone)).count().filter(f"count > 1 and `{gone}` is not null").select(gone), "repeated")
    if again.isEmpty():
        return left
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    first = left.join(again, match, "left_semi").groupBy(F.col(f"`{id_col}`")).agg(F.min_by(row, F.struct(F.col(f"`{text_col}`"), F.xxhash64(row))).alias(gone))
    return left.join(again, match, "left_anti").union(first.select(*(F.col(gone)[c].alias(c) for c in docs.columns)))
