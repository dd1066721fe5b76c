"""Keep-first and keep-last, upserts, lookups and their precedence, adjacency, proximity, cleanup."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import TEMPORARY
from ..functions.values import blank, filled, has
from ..session import materialize

# --- order and identity ------------------------------------------------------


def number_rows(df: DataFrame, keys: Sequence[Column], out: str = "row_idx", start: int = 0) -> DataFrame:
    """A running number over the whole table in the order of the keys, without a single-partition window.

    Rows are range-partitioned and sorted by the keys, and each is written with its
    partition and its place there.  That table alone gives both the partitions'
    sizes and the rows, so that the numbers have no gap whatever partitions another
    run would have made.  The partitions' offsets are a broadcast of one row for
    each partition.  Rows of equal keys go by a hash of all columns, so that a
    frequent key is no partition of its own; equal rows go in any order.
    """
    named = df.withColumns({f"_k{i}": k for i, k in enumerate(keys)}).withColumn("_tie", F.xxhash64(*(F.col(f"`{c}`").cast("string") if dt.startswith(("map", "variant")) else F.col(f"`{c}`") for c, dt in df.dtypes))).withColumn("_same", F.monotonically_increasing_id())
    order = [*(f"_k{i}" for i in range(len(keys))), "_tie", "_same"]
    placed = named.repartitionByRange(*order).sortWithinPartitions(*order).select(*(F.col(f"`{c}`") for c in df.columns), F.monotonically_increasing_id().alias("_at"))
    table = materialize(placed, "numbered")
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = table.groupBy(part.alias("part")).agg(F.count("*").alias("n")).select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_off"))
    numbered = table.join(F.broadcast(offsets), part == F.col("_part"))
    return numbered.select(*(F.col(f"`{c}`") for c in df.columns), (place + F.col("_off") + F.lit(start)).alias(out))


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last row of each key in the given order."""
    return _keep(df, keys, [F.desc(c) for c in order])


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return _keep(df, keys, [F.col(c) for c in order])


def _keep(df: DataFrame, keys, order) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


# --- unions and upserts ------------------------------------------------------


def union_ragged(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that a table lacks are null."""
    first, *rest = tables
    for t in rest:
        first = first.unionByName(t, allowMissingColumns=True)
    return first


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """New rows replace the old ones of the same key."""
    return union_ragged(old.join(new.select(*keys).distinct(), list(keys), "left_anti"), new)


def replace_partition(old: DataFrame, new: DataFrame, key: str = "video_id") -> DataFrame:
    """All old rows of the keys that come anew go, whatever else identifies them."""
    return upsert(old, new, [key])


def import_missing(old: DataFrame, legacy: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows stay; legacy rows come in where their key is new."""
    return union_ragged(old, legacy.join(old.select(*keys).distinct(), list(keys), "left_anti"))


# --- lookups -----------------------------------------------------------------


def fill_from(df: DataFrame, lookup: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Columns of the lookup's last row of each key: new ones are added, old ones filled where they are blank."""
    side = keep_last(lookup, [key], order).drop(*order)
    return _merge(df, side, key, lambda old, new: F.coalesce(filled(old), filled(new)))


def overlay(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    """Columns of the lookup win wherever they are filled."""
    return _merge(df, lookup, key, lambda old, new: F.coalesce(filled(new), old))


def _merge(df: DataFrame, side: DataFrame, key: str, pick) -> DataFrame:
    names = [c for c in side.columns if c != key]
    renamed = side.select(F.col(f"`{key}`").alias("_key"), *(F.col(f"`{c}`").alias(f"_s_{c}") for c in names))
    joined = df.join(renamed, F.col(f"`{key}`") == F.col("_key"), "left")
    old = [pick(F.col(f"`{c}`"), F.col(f"`_s_{c}`")).alias(c) if c in names else F.col(f"`{c}`") for c in df.columns]
    return joined.select(*old, *(F.col(f"`_s_{c}`").alias(c) for c in names if not has(df, c)))


def probe_cache(wanted: DataFrame, cache: DataFrame, key: str, signature: str, expected: str, complete: Column, order: Sequence[str]) -> DataFrame:
    """The wanted keys with ``hit``: exact (same signature), fallback (another signature, last one, complete) or none."""
    exact = keep_last(cache.filter(F.col(signature) == expected), [key], order).select(F.col(key).alias("_e"))
    other = keep_last(cache.withColumn("_c", complete), [key], order).filter("_c").select(F.col(key).alias("_f"))
    joined = wanted.join(exact, F.col(key) == F.col("_e"), "left").join(other, F.col(key) == F.col("_f"), "left")
    hit = F.when(F.col("_e").isNotNull(), "exact").when(F.col("_f").isNotNull(), "fallback").otherwise("none")
    return joined.select(*(F.col(f"`{c}`") for c in wanted.columns), hit.alias("hit"))


def valid_keys(cache: DataFrame, key: str, signature: Column, expected: Column | str) -> DataFrame:
    """Keys all of whose rows carry the expected signature."""
    return cache.groupBy(key).agg(F.bool_and(F.coalesce(signature == expected, F.lit(False))).alias("_ok")).filter("_ok").select(key)


def merge_tasks(rows: DataFrame, key: str, order: str, context: str = "context_text") -> DataFrame:
    """One task for each key: the longest context (the first of equals), of other columns the first filled value."""
    others = [c for c in rows.columns if c not in (key, order, context)]
    first = [F.min_by(F.col(f"`{c}`"), F.when(~blank(F.col(f"`{c}`")), F.col(order))).alias(c) for c in others]
    longest = F.max_by(F.col(context), F.struct(F.length(F.coalesce(F.col(context), F.lit(""))), -F.col(order))).alias(context)
    return rows.groupBy(key).agg(longest, *first)


# --- adjacency ---------------------------------------------------------------


def adjacent_pairs(rows: DataFrame, partition: str, order: Sequence[str], good: Column, columns: Sequence[str]) -> DataFrame:
    """(partition, from_*, to_*) of neighbours that are both good; rows that aren't are never bridged."""
    w = Window.partitionBy(partition).orderBy(*order)
    fields = F.struct(good.alias("_good"), *(F.col(f"`{c}`") for c in columns))
    paired = rows.withColumn("_a", fields)
    paired = paired.withColumn("_b", F.lead("_a").over(w)).filter("_a._good and _b._good")
    return paired.select(partition, *(F.col(f"_a.{c}").alias(f"from_{c}") for c in columns), *(F.col(f"_b.{c}").alias(f"to_{c}") for c in columns))


def skipped_pairs(rows: DataFrame, partition: str) -> Column:
    """How many neighbours there are: rows less partitions."""
    return F.count("*") - F.count_distinct(partition)


# --- proximity ---------------------------------------------------------------


def greedy_matches(lines: Sequence[tuple[int, int]], chapters: Sequence[tuple[int, int]], tolerance: int) -> list[int | None]:
    """The place of each line's chapter among (position, seconds) in order, or none."""
    used, out = set(), []
    for n, (_, t) in enumerate(lines):
        near = [(abs(c - t), k) for k, (_, c) in enumerate(chapters) if k not in used and abs(c - t) <= tolerance]
        pick = min(near)[1] if near else n if len(lines) == len(chapters) else None
        used.add(pick)
        out.append(pick)
    return out


def match_nearest(lines: DataFrame, chapters: DataFrame, key: str = "video_id", tolerance: int = 5) -> DataFrame:
    """(key, position, chapter): each line's chapter, one to one and greedily in the lines' order.

    The nearest unused chapter within the tolerance, the first of equals; else, where
    there are as many lines as chapters, the chapter at the same place (even if it is used).
    Rows come sorted by key; a worker holds one key's at a time.
    """
    side = lambda df, kind: df.select(key, F.lit(kind).alias("kind"), F.col("position").cast("int").alias("position"), F.col("timestamp_s").cast("int").alias("t"))
    rows = side(lines, 0).unionByName(side(chapters, 1)).repartition(key).sortWithinPartitions(key, "kind", "position")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, mine, theirs, out = None, [], [], []

        def close() -> None:
            for (p, _), k in zip(mine, greedy_matches(mine, theirs, tolerance), strict=True):
                out.append((current, p, None if k is None else theirs[k][0]))

        for pdf in frames:
            for name, kind, p, t in zip(pdf[key].tolist(), pdf["kind"].tolist(), pdf["position"].tolist(), pdf["t"].tolist(), strict=True):
                if name != current:
                    close()
                    current, mine, theirs = name, [], []
                (theirs if kind else mine).append((p, t))
            yield _matched(out, key)
            out.clear()
        close()
        yield _matched(out, key)

    return rows.mapInPandas(run, f"{key} {lines.schema[key].dataType.simpleString()}, position int, chapter int")


def _matched(rows: list[tuple], key: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[key, "position", "chapter"]).astype({"chapter": "Int32"})


def nearest_free(lines: DataFrame, chapters: DataFrame, key: str = "video_id", tolerance: int = 5) -> DataFrame:
    """As :func:`match_nearest` where no two lines compete: an interval join and one aggregate, all in Spark."""
    l, c = lines.alias("l"), chapters.alias("c")  # noqa: E741
    near = l.join(c, (F.col(f"l.{key}") == F.col(f"c.{key}")) & (F.abs(F.col("l.timestamp_s") - F.col("c.timestamp_s")) <= tolerance), "left")
    gap = F.struct(F.abs(F.col("l.timestamp_s") - F.col("c.timestamp_s")), F.col("c.position"))
    return near.groupBy(F.col(f"l.{key}").alias(key), F.col("l.position").alias("position")).agg(F.min_by(F.col("c.position"), gap).alias("chapter"))


# --- cleanup -----------------------------------------------------------------


def is_temporary(name: Column) -> Column:
    return F.lower(name).rlike(TEMPORARY)


def cleanup_plan(files: DataFrame, features: DataFrame, name: str = "name", key: str = "video_id", bytes_: str = "length") -> DataFrame:
    """Each file with ``action``: temp (delete), featured (delete) or keep."""
    known = features.select(F.col(key).alias("_id")).distinct()
    marked = files.withColumn("_stem", F.substring_index(F.col(name), ".", 1)).join(known, F.col("_stem") == F.col("_id"), "left")
    action = F.when(is_temporary(F.col(name)), "temp").when(F.col("_id").isNotNull(), "featured").otherwise("keep")
    return marked.select(name, bytes_, action.alias("action"))


def cleanup_summary(plan: DataFrame, bytes_: str = "length") -> DataFrame:
    size = lambda a: F.coalesce(F.sum(F.when(F.col("action") == a, F.col(bytes_))), F.lit(0)).alias(f"{a}_bytes")
    return plan.agg(*(F.count_if(F.col("action") == a).alias(f"{a}_files") for a in ("temp", "featured", "keep")), *(size(a) for a in ("temp", "featured")))
