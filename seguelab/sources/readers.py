"""Sources: CSV, SQLite through Spark's Python data source interface, JSON folders, item lists and settings."""

from __future__ import annotations

import json
import sqlite3
import tomllib
from collections.abc import Iterator, Mapping, Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text as X
from ..functions.values import known_first, trim_headers
from ..operators.caches import FEATURE_KEY, normalise_features
from ..operators.relations import keep_first, number_rows

ROWS_A_PART = 100_000
DEFAULTS: dict = {
    "analysis": {"edge_seconds": 30.0, "silence_top_db": 35.0, "flow_profile": "deep-dj", "resource_profile": "default"},
    "generation": {"num_playlists": 1, "genre_clusters": 8, "beam_width": 8, "candidate_width": 25, "allow_reuse": False},
    "model": {"weight": 0.0, "negative_ratio": 1.0, "seed": 42},
    "training": {"max_search_results": 5},
}


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; types are inferred, header names trimmed."""
    return trim_headers(spark.read.option("header", True).option("inferSchema", True).csv(path))


class SqliteSource(DataSource):
    """``spark.read.format("sqlite_table")`` with the options ``path`` and ``table``; ranges of row ids are read in parallel."""

    @classmethod
    def name(cls) -> str:
        return "sqlite_table"

    def schema(self) -> str:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            columns = db.execute(f"pragma table_info('{self.options.get('table', 'data')}')").fetchall()
        kinds = {"INTEGER": "bigint", "INT": "bigint", "REAL": "double", "DOUBLE": "double", "FLOAT": "double"}
        return ", ".join(f"`{c[1]}` {kinds.get(c[2].upper(), 'string')}" for c in columns)

    def reader(self, schema) -> DataSourceReader:
        return SqliteReader(self.options["path"], self.options.get("table", "data"), schema)


class SqliteReader(DataSourceReader):
    def __init__(self, path: str, table: str, schema):
        self.path, self.table, self.schema = path, table, schema

    def partitions(self) -> Sequence[InputPartition]:
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.table}"').fetchone()
        return [] if low is None else [InputPartition((a, a + ROWS_A_PART)) for a in range(low, high + 1, ROWS_A_PART)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        low, high = partition.value
        names = ", ".join(f'"{f.name}"' for f in self.schema.fields)
        text = [f.dataType.simpleString() == "string" for f in self.schema.fields]
        with sqlite3.connect(f"file:{self.path}?mode=ro", uri=True) as db:
            for row in db.execute(f'select {names} from "{self.table}" where rowid >= ? and rowid < ? order by rowid', (low, high)):
                yield tuple(None if v is None else str(v) if t else v for v, t in zip(row, text, strict=True))


def read_sqlite(spark: SparkSession, path: str, columns: Sequence[str] = (), table: str = "data") -> DataFrame:
    """A SQLite table: known columns first, then the others by name; a missing file or table is an empty one."""
    there = Path(path).exists()
    if there:
        with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
            there = db.execute("select count(*) from sqlite_master where type = 'table' and name = ?", (table,)).fetchone()[0] > 0
    if not there:
        return spark.createDataFrame([], ", ".join(f"`{c}` string" for c in columns) or "_ string")
    spark.dataSource.register(SqliteSource)
    return known_first(spark.read.format("sqlite_table").option("path", path).option("table", table).load(), columns, fill=True)


def cache_path(path: str | None, default: str) -> str:
    """Where a cache's database is: a CSV file's sibling, the path itself, or the path with a suffix."""
    p = Path(path or default)
    if p.suffix.lower() in (".sqlite", ".db"):
        return str(p)
    return str(p.with_suffix(".sqlite") if p.suffix.lower() == ".csv" else p.with_name(p.name + ".sqlite"))


def read_cache(spark: SparkSession, path: str, columns: Sequence[str], table: str = "data") -> DataFrame:
    """A cache from its database, from its CSV sibling where there is none, empty where there is neither."""
    base, csv = cache_path(path, path), Path(path).with_suffix(".csv")
    if Path(base).exists() or not csv.exists():
        return read_sqlite(spark, base, columns, table)
    return known_first(read_csv(spark, str(csv)), columns, fill=True)


def read_feature_cache(spark: SparkSession, path: str) -> DataFrame:
    """A feature cache in its present form; one without ids gives a warning and is empty."""
    return normalise_features(read_cache(spark, path, FEATURE_KEY, "audio_features"))


def read_json_objects(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """(name, the schema's columns) of the JSON files of a folder, the name without its suffix; what isn't an object is left out."""
    rows = spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    names = [c for c in rows.columns if c != "_corrupt_record"]
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    return rows.select(stem.alias("name"), *names, "_corrupt_record").filter("_corrupt_record is null").drop("_corrupt_record")


def read_json_object(path: str) -> dict | None:
    """One small document's object; none where there is no file or it holds something else."""
    if not Path(path).exists():
        return None
    value = json.loads(Path(path).read_text(encoding="utf-8"))
    return value if isinstance(value, dict) else None


def list_videos(entries: DataFrame, limit: int | None = None) -> DataFrame:
    """(video_id, video_title, video_url) of a channel's entries (n, id, title, url): ids once, in order, at most ``limit``."""
    rows = entries.withColumn("id", X.text_or_empty(F.col("id"))).filter("id <> ''")
    first = keep_first(rows, ["id"], ["n"])
    url = F.col("url") if "url" in entries.columns else F.lit("")
    listed = first.select("n", F.col("id").alias("video_id"), X.text_or_empty(F.col("title")).alias("video_title"), X.video_url(F.col("id"), url).alias("video_url"))
    return (listed if limit is None else listed.orderBy("n").limit(limit)).drop("n")


def read_legacy_json(spark: SparkSession, folder: str, features: Mapping[str, str]) -> DataFrame:
    """(video_id, cache_version, features): one JSON file for each id, its name; files without an object ``features`` are skipped."""
    inner = ", ".join(f"`{k}`: {v}" for k, v in features.items())
    schema = f"cache_version int, settings struct<edge_seconds: double, silence_top_db: double, flow_profile: string>, features struct<{inner}>"
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(f"{folder}/*.json")
    stem = F.regexp_replace(F.col("_metadata.file_name"), r"\.json$", "")
    sign = F.format_string("v1|edge=%s|silence=%s|flow=%s", *(F.regexp_replace(F.col(f"settings.{c}").cast("string"), r"\.0$", "") for c in ("edge_seconds", "silence_top_db", "flow_profile")))
    return rows.select(stem.alias("video_id"), sign.alias("analysis_signature"), "features").filter("features is not null").select("video_id", "analysis_signature", "features.*")


def read_items(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """A listing from JSON lines: entries without id go, of repeated ids the first stays, tags are joined; at most ``limit`` entries."""
    rows = spark.read.json(path)
    tags = F.array_join("tags", ", ").alias("tags") if dict(rows.dtypes).get("tags", "").startswith("array") else F.lit("").alias("tags")
    rows = rows.filter("id is not null and id <> ''").withColumn("_n", F.monotonically_increasing_id())
    first = keep_first(rows, ["id"], ["_n"])
    picked = first.select(F.col("id").alias("video_id"), *(F.col(f"`{c}`") for c in rows.columns if c not in ("id", "tags", "_n")), tags, "_n")
    return number_rows(picked, [F.col("_n")], "row_idx").filter(F.lit(True) if limit is None else F.col("row_idx") < limit).drop("_n")


def merged(base: Mapping, over: Mapping) -> dict:
    """Nested settings; the second's win."""
    return {k: merged(base[k], over[k]) if isinstance(base.get(k), Mapping) and isinstance(over.get(k), Mapping) else over.get(k, base.get(k)) for k in [*base, *(k for k in over if k not in base)]}


def read_settings(path: str | None = None) -> dict:
    """The defaults with a TOML file's settings over them."""
    if path is None or not Path(path).exists():
        return merged(DEFAULTS, {})
    with open(path, "rb") as f:
        return merged(DEFAULTS, tomllib.load(f))


def setting(settings: Mapping, dotted: str, default=None):
    for k in dotted.split("."):
        if not isinstance(settings, Mapping) or k not in settings:
            return default
        settings = settings[k]
    return settings


def training_sources(settings: Mapping, channel_url: str | None = None) -> list[dict[str, str]]:
    """The channels and videos to read: the one given, else those of the settings; a video's id tells the kinds apart."""
    import re

    listed = [channel_url] if channel_url else [*setting(settings, "training.channels", []), *setting(settings, "training.videos", [])]
    kind = lambda u: "video" if re.search(r"[?&]v=|youtu\.be/|/shorts/|/live/", u) or re.fullmatch(r"[A-Za-z0-9_-]{11}", u) else "channel"
    return [{"kind": kind(u), "url": u} for u in dict.fromkeys(listed)]


def resource_settings(profile: str | None = None, download_workers: int = 4, analysis_workers: int = 4) -> dict:
    """Workers by profile: ``background`` has one of each in a process of its own, any other name counts as ``default``."""
    name = (profile or "default").strip().lower()
    quiet = name == "background"
    least = lambda n: 1 if quiet else max(int(n or 1), 1)
    return {"resource_profile": name if quiet else "default", "download_workers": least(download_workers), "analysis_workers": least(analysis_workers), "force_process_pool": quiet}


def repaired_cookie_lines(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(n, line) of a cookie table's usable lines, and one row of how many were repaired and dropped.

    ``lines``: n, line.  Comments, blank lines and those of seven fields stay.  A line
    of four fields takes the next one where that starts with a tab and makes seven
    of them; all others go, as does a next one that was taken.
    """
    fields = lambda c: F.size(F.split(c, "\t"))
    follows = Window.orderBy("n")  # a file of one user's cookies
    rows = lines.withColumn("line", F.regexp_replace(F.coalesce("line", F.lit("")), "[\r\n]+$", "")).withColumn("after", F.lead("line").over(follows))
    good = (F.col("line") == "") | F.col("line").startswith("#") | (fields(F.col("line")) == 7)
    broken = ~good & (fields(F.col("line")) == 4) & F.coalesce(F.col("after").startswith("\t") & (fields(F.col("after")) == 4) & (fields(F.concat("line", "after")) == 7), F.lit(False))
    marked = rows.withColumns({"good": good, "joins": broken})
    # of lines that each could take the next one, every second does
    run = marked.withColumn("start", F.when(~F.col("joins"), F.col("n"))).withColumn("since", F.max("start").over(follows.rowsBetween(Window.unboundedPreceding, 0)))
    turn = F.row_number().over(Window.partitionBy("since").orderBy("n"))
    placed = run.withColumn("turn", F.when(F.col("joins"), turn - F.when(F.col("since").isNull(), 0).otherwise(1))).withColumn("joins", F.coalesce(F.col("joins") & (F.col("turn") % 2 == 1), F.lit(False)))
    placed = placed.withColumn("taken", F.coalesce(F.lag("joins").over(follows), F.lit(False)))
    kept = placed.filter("(good or joins) and not taken").select("n", F.when(F.col("joins"), F.concat("line", "after")).otherwise(F.col("line")).alias("line"))
    return kept, placed.agg(F.count_if("joins").alias("repaired"), F.count_if(F.expr("not good and not joins and not taken")).alias("dropped"))
