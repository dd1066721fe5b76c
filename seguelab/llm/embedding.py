"""Near-duplicate embeddings by a subspace pigeonhole join.

Unit vectors are rotated and split into blocks of a few coordinates.  Two vectors
within a squared distance t must be within t times a block's share of the
coordinates in at least one block.  So each block is range-joined on its own
under that budget, over a grid on its first coordinates, and what any block finds
is verified exactly.  A pair counts in its nearest block alone, so that no list
of pairs is made or compared: tasks return each vector's number of links and the
least member of the group that it belongs to there.

Where the threshold is so low that blocks would prune little, all pairs meet in
products of matrices, in a task for each two parts of the table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product
from math import ceil, erf, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, drop_table, materialize, mix
from .components import components, unite

THRESHOLD, BLOCK, SEED = 0.95, 8, 11
#: Rows of a cell that meet in one task; the parts of a larger cell meet in pairs.
PART_ROWS = 32_768
#: Share of all pairs that the blocks may find; beyond it a product of all pairs costs less.
MOST_FOUND = 0.05
#: Coordinates of the grid at most: a cell has neighbours in 3 to that power.
MOST_GRID = 5
_TILE, _WIDE, _MARGIN = 512, 8192, 1e-5


def rotation(size: int, seed: int = SEED) -> np.ndarray:
    """A random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))
    return q * np.sign(np.diag(r))


def _matrix(raw: pa.Array, size: int) -> np.ndarray:
    return np.frombuffer(raw.buffers()[2], np.float32)[raw.offset * size :][: len(raw) * size].reshape(-1, size)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def grid_size(n: int, size: int, block: int, limit: float, most: int = PART_ROWS) -> int:
    """On how many of a block's coordinates the grid lies, so that the cells of ``n`` evenly spread vectors stay below ``most`` rows, visitors included."""
    width = 2 * sqrt(limit * block / size)
    share = 0.5 * erf(width * sqrt(size) / sqrt(2))  # of a cell at the middle, along one coordinate
    grid = 1
    while grid < min(block, size % block or block, MOST_GRID) and n * (1.55 * share) ** grid > most:
        grid += 1
    return grid


def found_share(size: int, block: int, limit: float) -> float:
    """About how many of the pairs of evenly spread vectors the blocks find: chi-squares of each block's coordinates within its budget."""
    widths = [min(block, size - start) for start in range(0, size, block)]
    below = lambda d: 1 - exp(-limit * d / 4) * sum((limit * d / 4) ** k / factorial(k) for k in range((d + 1) // 2))
    return sum(map(below, widths))


def _cells(rotated: np.ndarray, block: int, grid: int, limit: float) -> Iterator[tuple[int, bool, np.ndarray, np.ndarray]]:
    """(block, visitor, rows, keys): each vector's cell in each block, and the later neighbour cells that hold anything within the block's budget."""
    size = rotated.shape[1]
    for b, start in enumerate(range(0, size, block)):
        own = rotated[:, start : start + block]
        radius = sqrt(limit * own.shape[1] / size) + 1e-6
        own = own[:, :grid]
        cell = np.floor(own / (2 * radius)).astype(np.int64)
        within = own - cell * 2 * radius
        for step in product((-1, 0, 1), repeat=own.shape[1]):
            if step < (0,) * len(step):
                continue
            move = np.array(step)
            gap = np.where(move == 0, 0.0, np.where(move > 0, 2 * radius - within, within))
            at = np.flatnonzero((gap**2).sum(axis=1) <= radius**2)
            key = np.full(len(at), np.uint64(b + 1))
            for k in range(own.shape[1]):
                key = mix(key * np.uint64(0x9E3779B97F4A7C15) + (cell[at, k] + step[k]).astype(np.uint64))
            yield b, any(step), at, key.view(np.int64)


def _spread(size: int, block: int, grid: int, limit: float, count: bool):
    """The rows of all cells; ``count``: the cells' sizes alone."""
    turn = rotation(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 2048):
                part = batch.slice(low, 2048)
                raw = _matrix(part.column(2), size)
                found = list(_cells(_unit(raw) @ turn, block, grid, limit))
                key = np.concatenate([k for *_, k in found])
                if count:
                    key, n = np.unique(key, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n.astype(np.int64))], names=["key", "n"])
                    continue
                at = np.concatenate([a for _, _, a, _ in found])
                flat = np.ascontiguousarray(raw[at]).view(np.uint8)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(key),
                        pa.array(np.concatenate([np.full(len(a), b, np.int16) for b, _, a, _ in found])),
                        pa.array(np.concatenate([np.full(len(a), v) for _, v, a, _ in found])),
                        part.column(0).take(pa.array(at)),
                        part.column(1).take(pa.array(at)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer((np.arange(len(at) + 1) * 4 * size).astype(np.int32)), pa.py_buffer(flat)]),
                    ],
                    names=["key", "block", "visitor", "node", "weight", "vector"],
                )

    return run


def _near(own: np.ndarray, left: np.ndarray, right: np.ndarray, budget: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of rows of ``left`` and ``right`` whose block coordinates may be within the budget; ``same``: of one list, each pair once."""
    if not len(left) or not len(right):
        return
    last = own[:, -1]
    left = left[np.argsort(last[left], kind="stable")]
    right = left if same else right[np.argsort(last[right], kind="stable")]
    square, one = (own**2).sum(axis=1, keepdims=True), np.ones((len(own), 1), np.float32)
    a, b = np.hstack([own, square, one]).astype(np.float32), np.hstack([-2 * own, one, square]).astype(np.float32)
    reach, places = sqrt(budget) + 1e-4, last[right]
    for lo in range(0, len(left), _TILE):
        rows = left[lo : lo + _TILE]
        start = lo if same else int(np.searchsorted(places, last[rows[0]] - reach))
        stop = int(np.searchsorted(places, last[rows[-1]] + reach, side="right"))
        for at in range(start, stop, _WIDE):
            columns = right[at : min(at + _WIDE, stop)]
            i, j = np.nonzero(a[rows] @ b[columns].T <= budget + _MARGIN)
            if same:
                later = at + j > lo + i
                i, j = i[later], j[later]
            if len(i):
                yield rows[i], columns[j]


def _turned(unit: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """``unit @ turn`` summed in one order, so that a vector has the same coordinates in every task."""
    out = np.zeros((len(unit), turn.shape[1]))
    for k in range(len(turn)):
        out += unit[:, k : k + 1] * turn[k]
    return out


def cell_links(b: int, part: np.ndarray, visitor: np.ndarray, weight: np.ndarray, x: np.ndarray, turn: np.ndarray, block: int, limit: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the rows of a cell of block ``b``, the weight of those that each is linked to and whose nearest block is ``b``, and the least row of its group.

    ``part``: 0 and 1 where the rows are two parts of a larger cell, of which pairs
    across the parts count alone; 0 for all otherwise.
    """
    unit, n = _unit(x), len(x)
    own = (unit @ turn[:, b * block : (b + 1) * block]).astype(np.float32)
    budget = limit * own.shape[1] / len(turn)
    home, guest = [np.flatnonzero(~visitor & (part == p)) for p in (0, 1)], [np.flatnonzero(visitor & (part == p)) for p in (0, 1)]
    if part.any():
        meetings = [(home[0], np.concatenate([home[1], guest[1]]), False), (home[1], guest[0], False)]
    else:
        meetings = [(home[0], home[0], True), (home[0], guest[0], False)]
    links, root = np.zeros(n, np.int64), np.arange(n)
    turned, known = np.zeros((n, len(turn))), np.zeros(n, bool)
    starts = np.arange(0, len(turn), block)
    for left, right, same in meetings:
        for i, j in _near(own, left, right, budget, same):
            for lo in range(0, len(i), 1 << 16):
                c, d = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
                hit = (unit[c] * unit[d]).sum(axis=1) >= threshold
                c, d = c[hit], d[hit]
                new = np.unique(np.concatenate([c, d]))
                new = new[~known[new]]
                turned[new], known[new] = _turned(unit[new], turn), True
                share = np.add.reduceat((turned[c] - turned[d]) ** 2, starts, axis=1) / np.diff(np.append(starts, len(turn)))
                nearest = share.argmin(axis=1) == b
                c, d = c[nearest], d[nearest]
                if len(c):
                    links += np.bincount(c, weight[d], minlength=n).astype(np.int64) + np.bincount(d, weight[c], minlength=n).astype(np.int64)
                    root = unite(root, c, d)
    return links, root


def part_links(part: np.ndarray, weight: np.ndarray, x: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """As :func:`cell_links` of all pairs of a part, or of those across two: a cosine within the margin of the threshold is computed again in doubles."""
    unit, n, same = _unit(x), len(x), not part.any()
    left = np.flatnonzero(part == 0)
    right = left if same else np.flatnonzero(part == 1)
    a, b = unit[left].astype(np.float32), unit[right].astype(np.float32)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for lo in range(0, len(left), _TILE):
        for at in range(lo if same else 0, len(right), _WIDE):
            s = a[lo : lo + _TILE] @ b[at : at + _WIDE].T
            i, j = np.nonzero(s >= threshold - _MARGIN)
            if same:
                later = at + j > lo + i
                i, j = i[later], j[later]
            c, d, hit = left[lo + i], right[at + j], s[i, j] >= threshold + _MARGIN
            open_ = np.flatnonzero(~hit)
            for k in range(0, len(open_), 1 << 16):
                few = open_[k : k + (1 << 16)]
                hit[few] = (unit[c[few]] * unit[d[few]]).sum(axis=1) >= threshold
            c, d = c[hit], d[hit]
            if len(c):
                links += np.bincount(c, weight[d], minlength=n).astype(np.int64) + np.bincount(d, weight[c], minlength=n).astype(np.int64)
                root = unite(root, c, d)
    return links, root


def _join(size: int, block: int, limit: float, threshold: float, whole: bool = False):
    """``whole``: all pairs of the parts meet, without blocks."""
    turn = rotation(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def groups():
            """The rows of each meeting of parts, though it may span batches."""
            held: list[tuple] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                key = np.stack([column(batch, k) for k in ("key", "low", "high")], axis=1)
                parts = column(batch, "part"), column(batch, "block"), column(batch, "visitor").astype(bool), column(batch, "node"), column(batch, "weight"), _matrix(batch.column(batch.schema.get_field_index("vector")), size)
                edge = np.append(np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]).any(axis=1)])), len(key))
                for lo, hi in zip(edge[:-1], edge[1:], strict=True):
                    if held and held[0][0] != tuple(key[lo]):
                        yield held[0][0], [np.concatenate(p) for p in zip(*(h[1:] for h in held), strict=True)]
                        held = []
                    held.append((tuple(key[lo]), *(p[lo:hi] for p in parts)))
            if held:
                yield held[0][0], [np.concatenate(p) for p in zip(*(h[1:] for h in held), strict=True)]

        for (_, low, high), (part, blocks, visitor, node, weight, x) in groups():
            if len(node) < 2:
                continue
            for b in np.unique(blocks):  # blocks whose cells' keys collide stay apart
                at = np.flatnonzero(blocks == b)
                across = (part[at] == high).astype(np.int8) if low < high else np.zeros(len(at), np.int8)
                links, root = part_links(across, weight[at], x[at], threshold) if whole else cell_links(int(b), across, visitor[at], weight[at], x[at], turn, block, limit, threshold)
                has = np.flatnonzero(links)
                if len(has):
                    yield pa.RecordBatch.from_arrays([pa.array(node[at][has]), pa.array(node[at][root[has]]), pa.array(links[has])], names=["node", "root", "links"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", block: int = BLOCK, part_rows: int = PART_ROWS) -> DataFrame:
    """(vec_id, class_id, n_links) for every vector: the least id of its group, and how many others have at least the threshold's cosine to it.

    A group is what chains of such links connect; a vector without a link is a
    group of its own.  Exact: each link is found by at least one block, and every
    cosine is computed from the given numbers.  Copies are compared once and count
    with their number.  A cell of more than ``part_rows`` rows meets in pairs of
    parts, so no task holds more than two of them.  Under a threshold at which the
    blocks would find more than ``MOST_FOUND`` of all pairs, all pairs meet so.

    * Null ids and null vectors are left out, as are vectors with a null, NaN or
      infinite entry, those of length zero and those without direction.
    * Where lengths differ, the most frequent one counts (of equals the smaller);
      other vectors are left out.
    * Rows that repeat id and vector count once; an id with several vectors has a
      row for each of them, and these count as others to one another.
    * Ids keep their type.  An empty table gives an empty result; other columns
      are ignored.
    """
    if not 0 < threshold <= 1:
        raise ValueError("the threshold must be in (0, 1]")
    v = F.col(f"`{vector_col}`").cast("array<float>")
    rows = vectors.select(F.col(f"`{id_col}`").alias("id"), v.alias("vector")).filter("id is not null and vector is not null and size(vector) > 0")
    kind = rows.schema["id"].dataType.simpleString()
    fit = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(1e18))) & F.exists("vector", lambda x: F.abs(x) > F.lit(1e-18))
    rows = rows.filter(fit)
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if sizes is None:
        return vectors.sparkSession.createDataFrame([], f"vec_id {kind}, class_id {kind}, n_links long")
    size, limit = int(sizes["n"]), 2 - 2 * threshold
    entries = rows.filter(F.size("vector") == size).distinct()
    nodes = materialize(entries.groupBy("vector").agg(F.min("id").alias("least"), F.count("*").alias("weight")).withColumn("node", F.monotonically_increasing_id()), "vectors")
    n, whole = nodes.count(), found_share(size, block, limit) > MOST_FOUND
    slim = nodes.select("node", "weight", "vector").mapInArrow(_packed, "node long, weight long, vector binary")
    hot = None
    if whole:
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        parts = max(-(-n // (2 * part_rows)), min(ceil(sqrt(8 * cores)), -(-n // _TILE)))
        cells = slim.select(F.lit(0).cast("long").alias("key"), F.lit(0).cast("short").alias("block"), F.lit(False).alias("visitor"), "*", F.lit(parts).alias("parts"))
    else:
        grid = grid_size(n, size, block, limit, part_rows)
        spread = lambda count, schema: slim.mapInArrow(_spread(size, block, grid, limit, count), schema)
        parts = F.ceil(F.col("n") / part_rows).cast("int")
        hot = materialize(spread(True, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") > part_rows).select("key", parts.alias("parts")), "hot_cells")
        cells = spread(False, "key long, block short, visitor boolean, node long, weight long, vector binary").join(hot, "key", "left")
        cells = cells.withColumn("parts", F.coalesce("parts", F.lit(1)))
    cells = cells.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    met = cells.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("key", F.least("part", "other").alias("low"), F.greatest("part", "other").alias("high"), "part", "block", "visitor", "node", "weight", "vector")
    order = ("key", "low", "high")
    placed = met.repartition(parts * (parts + 1), *order) if whole else met.repartition(*order)
    found = materialize(placed.sortWithinPartitions(*order).mapInArrow(_join(size, block, limit, threshold, whole), "node long, root long, links long"), "links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    least = groups.join(nodes.select("node", "least"), "node").groupBy("root").agg(F.min("least").alias("class"))
    side = groups.join(least, "root").join(links, "node").select("node", "class", "links")
    classed = nodes.join(side, "node", "left").select("vector", F.coalesce("class", "least").alias("class_id"), (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = entries.join(classed, "vector").select(F.col("id").alias("vec_id"), "class_id", "n_links")
    if hot is not None:
        drop_table(hot)
    return out


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lists of numbers as bytes."""
    for batch in batches:
        listed = batch.column(2)
        flat = listed.flatten().to_numpy(zero_copy_only=False).astype(np.float32)
        ends = (4 * (listed.offsets.to_numpy() - listed.offsets[0].as_py())).astype(np.int32)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.Array.from_buffers(pa.binary(), len(listed), [None, pa.py_buffer(ends), pa.py_buffer(flat)])], names=["node", "weight", "vector"])


def links_sql(threshold: float = THRESHOLD) -> str:
    """DuckDB SQL for :func:`near_duplicates`."""
    return f"""
with recursive v as (select distinct vec_id, embedding::DOUBLE[] as e, row_number() over () as k from (select distinct vec_id, embedding from embeddings where vec_id is not null and embedding is not null)),
l as (select a.k as a, b.k as b from v a join v b on a.k <> b.k where list_cosine_similarity(a.e, b.e) >= {threshold}),
r as (select k, vec_id as root from v union select l.b, r.root from r join l on l.a = r.k)
select v.vec_id, min(r.root) as class_id, (select count(*) from l where l.a = v.k) as n_links from v join r using (k) group by v.vec_id, v.k"""
