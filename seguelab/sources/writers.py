"""Sinks: CSV, keyed SQLite tables, reports, batches for a remote list."""

from __future__ import annotations

import json
import logging
import os
import sqlite3
import tempfile
from collections.abc import Callable, Iterable, Mapping, Sequence
from datetime import datetime
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import known_first
from ..operators.caches import FEATURE_KEY, migrate_features, normalise_features
from ..operators.relations import duplicate_keys
from ..operators.tracklists import compact_pairs
from .readers import cache_path, read_cache, read_legacy_json


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A folder with a CSV file; an empty table still gives a header."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_sqlite(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str] = (), table: str = "data") -> None:
    """A whole table into a SQLite file, replaced in one step; a key that occurs twice is an error.

    Rows stream to the driver one partition at a time, for tables that fit one file.
    """
    df = known_first(df, [c for c in columns if c in df.columns])
    if keys and not duplicate_keys(df, keys).isEmpty():
        raise ValueError(f"a key of {list(keys)} occurs twice")
    kinds = {"bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER", "double": "REAL", "float": "REAL", "boolean": "INTEGER"}
    handle, temp = tempfile.mkstemp(dir=Path(path).resolve().parent, suffix=".tmp")
    os.close(handle)
    try:
        with sqlite3.connect(temp) as db:
            db.execute(f'create table "{table}" (' + ", ".join(f'"{n}" {kinds.get(t, "TEXT")}' for n, t in df.dtypes) + ")")
            rows = (tuple(v if isinstance(v, int | float | str | bytes) or v is None else str(v) for v in r) for r in df.toLocalIterator())
            db.executemany(f'insert into "{table}" values (' + ", ".join("?" * len(df.columns)) + ")", rows)
            if keys:
                db.execute(f'create unique index "{table}_key" on "{table}" (' + ", ".join(f'"{k}"' for k in keys) + ")")
        db.close()
        os.replace(temp, path)
    except BaseException:
        Path(temp).unlink(missing_ok=True)
        raise


def write_json(value, path: str) -> None:
    """Whole or not at all."""
    temp = Path(path).with_suffix(".tmp")
    temp.write_text(json.dumps(value, ensure_ascii=False, indent=2), encoding="utf-8")
    os.replace(temp, path)


def write_pairs(pairs: DataFrame, path: str) -> None:
    """Training pairs in their compact form."""
    write_csv(compact_pairs(pairs), path)


def write_reports(reports: Sequence[DataFrame], path: str) -> bool:
    """The reports together; nothing where all are empty."""
    full = [r for r in reports if not r.isEmpty()]
    if not full:
        return False
    out = full[0]
    for r in full[1:]:
        out = out.unionByName(r)
    write_csv(out, path)
    return True


def send_list(paths: DataFrame, send: Callable[[str, int], bool], video: str = "video_id") -> int:
    """Send a list's items in order to a remote one; an item that fails takes no position.  Returns how many were sent."""
    sent = 0
    for row in paths.filter(F.trim(F.coalesce(F.col(video), F.lit(""))) != "").orderBy("playlist_name", "position").select(video).toLocalIterator():
        sent += bool(send(row[0], sent))
    return sent


RATE_LIMIT = ("http error 429", "too many requests", "rate limit")


def says_rate_limit(text: str) -> bool:
    return any(flag in (text or "").lower() for flag in RATE_LIMIT)


def pause_seconds(attempt: int, base: float = 2.0, most: float = 30.0) -> float:
    """The pause before the next try: doubled each time, at most so long."""
    return min(max(base, 0.0) * 2.0 ** max(attempt, 0), most) if base > 0 else 0.0


def with_retry(call: Callable, tries: int = 5, statuses=(403, 429), pause: Callable[[float], None] | None = None, base: float = 2.0, most: float = 30.0):
    """Repeat a call that fails with a passing status or a text that tells of a rate limit, after 2, 4, 8 ... seconds."""
    import time

    for k in range(tries):
        try:
            return call()
        except Exception as e:
            status = getattr(e, "status", None)
            if k + 1 == tries or not (status in statuses or (status or 0) >= 500 or says_rate_limit(str(e))):
                raise
            (pause or time.sleep)(pause_seconds(k, base, most))


def write_feature_cache(cache: DataFrame, path: str) -> None:
    """A feature cache in its present form, replaced in one step."""
    write_sqlite(normalise_features(cache), path, FEATURE_KEY, FEATURE_KEY, "audio_features")


def load_feature_cache(spark, path: str, legacy_features: Mapping[str, str] | None = None) -> DataFrame:
    """The feature cache of a path: its database, else its CSV sibling, with what only the legacy JSON folder beside it holds.

    Where anything came from elsewhere, the database is written anew.
    """
    base = cache_path(path, path)
    folder, csv = Path(base).with_suffix(""), Path(base).with_suffix(".csv")
    legacy = read_legacy_json(spark, str(folder), legacy_features) if legacy_features and folder.is_dir() else None
    cache, imported = migrate_features(read_cache(spark, str(csv) if csv.exists() else base, FEATURE_KEY, "audio_features"), legacy)
    if imported or (csv.exists() and not Path(base).exists()):
        write_feature_cache(cache, base)
    return cache


def write_cache(df: DataFrame, path: str, keys: Sequence[str], columns: Sequence[str]) -> None:
    """A cache as a database, or as a CSV file where its path says so, known columns first."""
    if str(path).lower().endswith((".sqlite", ".db")):
        write_sqlite(df, path, keys, columns)
    else:
        write_csv(known_first(df, columns), path)


def report_path(output: str) -> str:
    """Where the report of an output goes: beside it."""
    p = Path(output)
    return str(p.with_name(f"{p.stem}_transition_report.csv"))


def error_log_path(output: str, started: datetime) -> str:
    return f"{os.path.splitext(output)[0]}_errors_{started:%Y%m%d_%H%M%S}.log"


class ErrorLog(logging.Handler):
    """Collects a session's warnings and errors and writes them as a text file."""

    def __init__(self, level: int = logging.WARNING):
        super().__init__(level)
        self.entries: list[tuple[str, str, str, str]] = []

    def emit(self, record: logging.LogRecord) -> None:
        at = datetime.fromtimestamp(record.created)
        self.entries.append((f"{at:%Y-%m-%d %H:%M:%S}", record.levelname, record.name, record.getMessage()))

    def count(self, *levels: str) -> int:
        return sum(e[1] in levels for e in self.entries)

    def write(self, path: str, started: datetime, finished: datetime, failed: bool) -> None:
        head = ["Training Scrape Session Errors", f"run_started={started:%Y-%m-%d %H:%M:%S}", f"run_finished={finished:%Y-%m-%d %H:%M:%S}", f"run_status={'failed' if failed else 'success'}", f"captured_entries={len(self.entries)}", ""]
        body = [" | ".join(e) for e in [("timestamp", "level", "logger", "message"), *self.entries]] if self.entries else ["No warnings or errors were captured for this session."]
        Path(path).parent.mkdir(parents=True, exist_ok=True)
        Path(path).write_text("\n".join([*head, *body, ""]), encoding="utf-8")


def delete_files(paths: Iterable[str]) -> int:
    """Delete each file once, as far as it can be; how many went.  For the driver's own files, after what they were for is written."""
    gone = 0
    for path in dict.fromkeys(p.strip() for p in paths if p and p.strip()):
        try:
            os.remove(path)
            gone += 1
        except OSError:
            continue
    return gone


def apply_cleanup(plan: DataFrame, root: str, dry_run: bool = False) -> int:
    """Delete what :func:`~seguelab.operators.relations.cleanup_plan` marks in a folder, and the folders that are then empty."""
    names = [r["name"] for r in plan.filter("action <> 'keep'").select("name").toLocalIterator()]
    if dry_run:
        return len(names)
    gone = delete_files(str(Path(root, n)) for n in names)
    for folder in sorted((p for p in Path(root).rglob("*") if p.is_dir()), reverse=True):
        if not any(folder.iterdir()):
            folder.rmdir()
    return gone
