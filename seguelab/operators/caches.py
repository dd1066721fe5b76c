"""Keyed caches and the chains that read and renew them: features of tracks, source tracks of videos, resolutions, metadata.

A cache is a table; a chain returns what it was asked for and the renewed cache,
so that a caller writes it wherever it lives.  What a cache holds under the
expected signature is never worked out again: the work is what an anti-join leaves.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.features import add_moods
from ..functions.values import analysed, col_or, has, known_first
from ..session import materialize
from .audio import analyse, extract
from .relations import fill_from, import_missing, keep_first, keep_last, merge_tasks, overlay, replace_partition, union_ragged, upsert
from .tracklists import LEAST_LINES, attach_features, best_candidates, scrape_summary, source_rows, transition_pairs, wanted_tracks

FEATURE_KEY = ["video_id", "analysis_signature"]
#: Settings and texts that older feature caches held beside the features.
OUTDATED = "cache_version edge_seconds silence_top_db flow_profile title artist uploader channel description tags category url context_text".split()
TRACK_KEY = ["video_id", "position"]
SOURCE_CACHE = [*TRACK_KEY, *"source_signature channel_handle description_length track_source chapter_title chapter_timestamp_s timestamp_s track_raw artist_guess title_guess".split()]
RESOLUTION_CACHE = [*TRACK_KEY, "resolution_signature", "resolution_status", *(f"resolved_{n}" for n in ("video_id", "title", "artist", "duration_seconds"))]
RESOLVED = [*RESOLUTION_CACHE[3:7], "resolved_url", "resolved_duration_seconds"]
SOURCE_VERSION = RESOLUTION_VERSION = 4
MOST_RESULTS = 5
CONTEXT = "title artist uploader channel description tags category".split()


def _text(df: DataFrame, name: str) -> Column:
    return X.text_or_empty(col_or(df, name, None))


# --- features ----------------------------------------------------------------


def _plain_number(c: Column, missing: str = "-1") -> Column:
    """A setting as it stands in a signature: without a trailing ``.0``."""
    return F.coalesce(F.regexp_replace(c.cast("string").try_cast("double").cast("string"), r"\.0$", ""), F.lit(missing))


def _own_signature(df: DataFrame) -> Column:
    """The row's signature, or the one that its settings' columns stand for."""
    part = lambda name: _plain_number(col_or(df, name, None))
    made = F.concat(F.lit("v"), part("cache_version"), F.lit("|edge="), part("edge_seconds"), F.lit("|silence="), part("silence_top_db"), F.lit("|flow="), _text(df, "flow_profile"))
    return F.coalesce(F.nullif(_text(df, "analysis_signature"), F.lit("")), made)


def normalise_features(cache: DataFrame, order: Sequence[str] = ()) -> DataFrame:
    """A feature cache in its present form: trimmed ids, a signature in every row, the last row of each key, moods, known columns first.

    A table without ids is no cache: it gives a warning and an empty one.  Rows with
    a blank id go.  ``order``: columns that order the rows; without them the table's own order.
    """
    if not has(cache, "video_id"):
        warnings.warn("a feature cache without video_id is left out", stacklevel=2)
        return cache.sparkSession.createDataFrame([], "video_id string, analysis_signature string")
    rows = cache.withColumns({"analysis_signature": _own_signature(cache), "video_id": _text(cache, "video_id")}).filter("video_id <> ''")
    if not order:
        rows, order = rows.withColumn("_order", F.monotonically_increasing_id()), ["_order"]
    last = keep_last(rows, FEATURE_KEY, order).drop(*OUTDATED, *order)
    return known_first(add_moods(last), FEATURE_KEY)


def upsert_features(cache: DataFrame, fresh: DataFrame) -> DataFrame:
    """The normalised cache with the fresh rows in place of those of their keys."""
    return known_first(upsert(normalise_features(cache), normalise_features(fresh), FEATURE_KEY), FEATURE_KEY)


def migrate_features(cache: DataFrame, legacy: DataFrame | None) -> tuple[DataFrame, int]:
    """The normalised cache with the legacy rows whose keys it lacks, and how many those are: more than none means that it should be written."""
    old = normalise_features(cache)
    if legacy is None:
        return old, 0
    new = normalise_features(legacy)
    missing = new.join(old.select(*FEATURE_KEY), FEATURE_KEY, "left_anti").count()
    return (known_first(import_missing(old, new, FEATURE_KEY), FEATURE_KEY) if missing else old), missing


def analyse_tracks(
    tracks: DataFrame,
    cache: DataFrame,
    files: DataFrame,
    signature: str | None = None,
    extractor: Callable[[bytes], dict[str, float]] = extract,
    deep: bool = True,
    refresh: bool = False,
    any_signature: bool = False,
    max_tracks: int | None = None,
    order: str = "track_idx",
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tracks with their features, the renewed cache, and one row of counters.

    A track that has its features keeps them; others take those of the cache under
    this signature, then (``any_signature``) a complete analysis under another one;
    the rest is read from ``files`` (video_id, path, content), once for each id.
    ``max_tracks`` bounds the rows looked at, by ``order``; all rows come back.  A
    file that can't be read leaves its track without features.
    """
    signature = signature or X.analysis_signature(flow="deep-dj" if deep else "standard")
    known = materialize(normalise_features(cache), "features")
    looked = tracks if max_tracks is None else tracks.orderBy(order).limit(max_tracks)
    looked = looked.withColumns({"video_id": _text(tracks, "video_id"), "_done": analysed(tracks, deep)})
    open_ = materialize(looked.filter("not _done and video_id <> ''").select("video_id").distinct(), "open")
    exact = known.filter(F.col("analysis_signature") == signature).join(open_, "video_id", "left_semi")
    if refresh:
        exact = exact.limit(0)
    reused = exact
    if any_signature and not refresh:
        last = keep_last(known.withColumn("_n", F.monotonically_increasing_id()), ["video_id"], ["_n"]).drop("_n")
        rest = last.filter(analysed(last, deep)).join(exact.select("video_id"), "video_id", "left_anti")
        reused = union_ragged(exact, rest.join(open_, "video_id", "left_semi"))
    reused = materialize(reused.withColumn("_rank", F.lit(0)), "reused")
    todo = open_.join(reused.select("video_id"), "video_id", "left_anti")
    read = materialize(analyse(keep_first(files, ["video_id"], ["path"]).join(todo, "video_id", "left_semi"), extractor), "analysed")
    fresh = read.filter("status = 'ok'").drop("path", "status").withColumn("analysis_signature", F.lit(signature))
    registry = union_ragged(reused, add_moods(fresh).withColumn("_rank", F.lit(1))).drop("analysis_signature")
    out = fill_from(tracks, registry, "video_id", ["_rank"])
    counts = looked.agg(F.count_if("_done").alias("reused_from_table"), F.count_if(F.expr("video_id = ''")).alias("without_id"))
    counts = counts.crossJoin(reused.agg(F.count("*").alias("reused_from_cache"))).crossJoin(read.agg(F.count_if(F.col("status") == "ok").alias("analysed"), F.count_if(F.col("status") != "ok").alias("failed")))
    return out, upsert_features(known, fresh), counts


def track_tasks(tracks: DataFrame, order: str = "track_idx", url: str = "url") -> DataFrame:
    """One task for each id that has to be analysed: its address, its longest context and the first filled value of each text."""
    context = X.context_text(*(_text(tracks, c) for c in CONTEXT))
    address = F.coalesce(F.nullif(_text(tracks, url), F.lit("")), X.video_url(F.col("video_id"), F.lit("")))
    rows = tracks.select("video_id", F.col(order).alias("_order"), address.alias("url"), *(_text(tracks, c).alias(c) for c in CONTEXT), context.alias("context_text")).filter(X.text_or_empty(F.col("video_id")) != "")
    return merge_tasks(rows, "video_id", "_order")


# --- source tracks -----------------------------------------------------------


def source_signature(url: Column | str, label: Column | str, label_source: Column | str, version: int = SOURCE_VERSION) -> Column:
    return X.signature(version, url, label, label_source)


def compact_sources(rows: DataFrame) -> DataFrame:
    """Source tracks as a cache keeps them: a signature in place of the channel's address and labels, seconds in place of time codes."""
    made = F.when(col_or(rows, "source_cache_version", None).cast("string").try_cast("double").isNull() | (col_or(rows, "source_cache_version", None).cast("string").try_cast("double") == SOURCE_VERSION), source_signature(_text(rows, "channel_url"), _text(rows, "label"), _text(rows, "label_source")))
    made = F.coalesce(F.nullif(_text(rows, "source_signature"), F.lit("")), made, F.lit("outdated"))
    seconds = col_or(rows, "timestamp_s", None).cast("int")
    if has(rows, "timestamp"):
        seconds = F.coalesce(seconds, X.strict_seconds(F.col("timestamp")))
    own = {"source_signature": made, "timestamp_s": seconds, "description_length": col_or(rows, "description_length", None).cast("int"), "chapter_timestamp_s": col_or(rows, "chapter_timestamp_s", None).cast("int"), "position": F.col("position").cast("int"), "video_id": F.col("video_id")}
    return rows.select(*(own.get(c, _text(rows, c)).alias(c) for c in SOURCE_CACHE))


def restore_sources(cached: DataFrame, videos: DataFrame, url: str, label: str, label_source: str) -> DataFrame:
    """The cached source tracks of listed videos (video_id, video_title, video_url), whole again."""
    side = videos.select(F.col("video_id").alias("_id"), _text(videos, "video_title").alias("video_title"), X.video_url(F.col("video_id"), _text(videos, "video_url")).alias("video_url"))
    rows = cached.join(side, F.col("video_id") == F.col("_id")).drop("_id", "source_signature")
    code = F.coalesce(X.time_code(F.col("timestamp_s")), F.lit(""))
    return rows.withColumns({"channel_url": F.lit(url), "label": F.lit(label), "label_source": F.lit(label_source), "source_cache_version": F.lit(SOURCE_VERSION), "timestamp": code})


def scrape_channel(videos: DataFrame, metadata: DataFrame, cache: DataFrame, url: str, label: str, label_source: str, refresh: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The source tracks of a channel's listed videos, the renewed cache, and one row of counters.

    Videos whose cached rows all carry this channel's signature come from the cache;
    the others' track lists are read from ``metadata`` (video_id, title, description,
    chapters, ...) and replace what the cache had of them.  A video of fewer than
    two tracks gives none; one without metadata is skipped.
    """
    listed = materialize(keep_first(videos.withColumn("_n", F.monotonically_increasing_id()), ["video_id"], ["_n"]).drop("_n"), "listed")
    held = materialize(compact_sources(cache), "sources")
    good = F.bool_and(F.col("source_signature") == source_signature(F.lit(url), F.lit(label), F.lit(label_source)))
    valid = held.groupBy("video_id").agg(good.alias("_ok")).filter("_ok").select("video_id")
    known = held.join(valid.filter(F.lit(not refresh)), "video_id", "left_semi").join(listed.select("video_id"), "video_id", "left_semi")
    known = materialize(known, "known")
    pending = listed.join(known.select("video_id").distinct(), "video_id", "left_anti")
    side = metadata.drop("video_url", "video_title", "channel_url")
    fresh = materialize(source_rows(pending.select("video_id", _text(listed, "video_url").alias("video_url")).join(side, "video_id").withColumn("channel_url", F.lit(url)), label, label_source, SOURCE_VERSION), "fresh")
    # a video is known or fresh, and has enough fresh rows or none
    enough = known.groupBy("video_id").count().filter(F.col("count") >= LEAST_LINES).select("video_id")
    rows = restore_sources(known.join(enough, "video_id", "left_semi"), listed, url, label, label_source).select(*fresh.columns).unionByName(fresh)
    counts = listed.agg(F.count("*").alias("videos_scanned")).crossJoin(rows.agg(F.count_distinct("video_id").alias("videos_with_tracklist"), F.count("*").alias("tracks_parsed")))
    counts = counts.withColumn("videos_skipped", F.col("videos_scanned") - F.col("videos_with_tracklist")).crossJoin(known.agg(F.count_distinct("video_id").alias("videos_from_cache")))
    return rows, replace_partition(held, compact_sources(fresh)), counts


# --- resolutions -------------------------------------------------------------


def resolution_signature(query: Column, most: int = MOST_RESULTS, version: int = RESOLUTION_VERSION) -> Column:
    return X.signature(version, str(max(1, int(most))), query)


def compact_resolutions(rows: DataFrame) -> DataFrame:
    """Resolutions as a cache keeps them: a signature in place of the query, its number of results and the version."""
    asked = F.coalesce(F.nullif(_text(rows, "normalized_search_query"), F.lit("")), X.plain_query(_text(rows, "search_query")))
    whole = lambda name, default: F.coalesce(col_or(rows, name, None).cast("string").try_cast("double").cast("int"), F.lit(default)).cast("string")
    version = whole("resolution_cache_version", RESOLUTION_VERSION)
    made = F.concat(F.lit("v"), version, F.lit("|"), F.substring(F.sha1(F.concat_ws("||", version, F.greatest(whole("search_max_results", MOST_RESULTS).cast("int"), F.lit(1)).cast("string"), asked)), 1, 16))
    own = {"resolution_signature": F.coalesce(F.nullif(_text(rows, "resolution_signature"), F.lit("")), made), "resolved_duration_seconds": col_or(rows, "resolved_duration_seconds", None).cast("int"), "position": F.col("position").cast("int"), "video_id": F.col("video_id")}
    return rows.select(*(own.get(c, _text(rows, c)).alias(c) for c in RESOLUTION_CACHE))


def restore_resolutions(cached: DataFrame) -> DataFrame:
    """(video_id, position, the resolved columns): addresses follow from ids; what wasn't resolved is null."""
    there = F.col("resolved_video_id") != ""
    values = {c: F.when(there, F.col(c)) for c in ("resolved_video_id", "resolved_title", "resolved_artist", "resolved_duration_seconds")}
    values |= {"resolved_url": F.when(there, X.video_url(F.col("resolved_video_id"), F.lit(""))), "resolution_status": F.col("resolution_status")}
    return cached.select(*TRACK_KEY, *(values[c].alias(c) for c in RESOLVED))


def asked_tracks(rows: DataFrame, most: int = MOST_RESULTS) -> DataFrame:
    """The rows with the query that each leads to, and its signature; a name that leads to none has an empty one."""
    query = F.coalesce(F.try_element_at(X.search_queries(F.col("track_raw")), F.lit(1)), F.lit(""))
    named = rows.withColumn("search_query", query).withColumn("normalized_search_query", X.plain_query(F.col("search_query")))
    return named.withColumns({"search_max_results": F.lit(max(1, int(most))), "resolution_cache_version": F.lit(RESOLUTION_VERSION), "resolution_signature": resolution_signature(F.col("normalized_search_query"), most)})


def valid_resolutions(cache: DataFrame, asked: DataFrame) -> DataFrame:
    """The cache's rows that answer what is asked now: by their signature, or where they have none, by query, number of results and version."""
    own = asked.select(*(F.col(c).alias(f"_{c}") for c in TRACK_KEY), *(F.col(c).alias(f"_{c}") for c in ("search_query", "normalized_search_query", "search_max_results", "resolution_cache_version", "resolution_signature")))
    met = cache.join(own, (F.col("video_id") == F.col("_video_id")) & (F.col("position").cast("int") == F.col("_position")))
    number = lambda name: col_or(cache, name, None).cast("string").try_cast("double")
    older = (number("resolution_cache_version") == F.col("_resolution_cache_version")) & (number("search_max_results") == F.col("_search_max_results")) & (_text(cache, "search_query") == F.col("_search_query")) & (_text(cache, "normalized_search_query") == F.col("_normalized_search_query"))
    same = F.when(_text(cache, "resolution_signature") != "", _text(cache, "resolution_signature") == F.col("_resolution_signature")).otherwise(F.coalesce(older, F.lit(False)))
    return met.filter(same).select(*(F.col(f"`{c}`") for c in cache.columns))


def resolve_tracks(rows: DataFrame, candidates: DataFrame, cache: DataFrame | None = None, most: int = MOST_RESULTS, refresh: bool = False, fold=X.folded) -> tuple[DataFrame, DataFrame]:
    """Track rows with their resolution, and the renewed cache.

    What the cache answers isn't looked up again; a name that leads to no query is
    ``ignored``; all others meet the candidates, each distinct query once.
    """
    asked = materialize(asked_tracks(rows, most), "asked")
    empty = asked.sparkSession.createDataFrame([], f"video_id {rows.schema['video_id'].dataType.simpleString()}, position int")
    held = compact_resolutions(cache if cache is not None else empty)
    known = restore_resolutions(compact_resolutions(valid_resolutions(cache, asked))) if cache is not None and not refresh else restore_resolutions(held.limit(0))
    known = materialize(known.dropDuplicates(TRACK_KEY), "known")
    todo = asked.join(known.select(*TRACK_KEY), TRACK_KEY, "left_anti")
    nothing = todo.filter("search_query = ''").select(*TRACK_KEY, F.lit("ignored").alias("resolution_status"))
    found = union_ragged(best_candidates(todo.filter("search_query <> ''"), candidates, fold=fold), nothing)
    fresh = materialize(known_first(found, [*TRACK_KEY, *RESOLVED], fill=True).select(*TRACK_KEY, *RESOLVED), "found")
    out = asked.join(known.unionByName(fresh), TRACK_KEY, "left")
    return out.drop("resolution_signature"), upsert(held, compact_resolutions(fresh.join(asked.select(*TRACK_KEY, "resolution_signature"), TRACK_KEY)), TRACK_KEY)


# --- metadata ----------------------------------------------------------------


def value_text(c: Column, kind: T.DataType) -> Column:
    """A text, a list of texts or of objects with a name, or an object with a name, as one text."""
    if isinstance(kind, T.StructType):
        names = [n for n in ("name", "title", "label") if n in kind.fieldNames()]
        return F.coalesce(*(F.nullif(X.text_or_empty(c[n]), F.lit("")) for n in names), F.lit(""))
    if isinstance(kind, T.ArrayType):
        return F.array_join(F.filter(F.transform(F.coalesce(c, F.array().cast(kind)), lambda x: value_text(x, kind.elementType)), lambda x: x != ""), ", ")
    return X.text_or_empty(c)


def _compact_items(c: Column, kind: T.ArrayType) -> Column:
    """A list's items with the fields that track lists use, blank ones as nulls."""
    fields = {f.name: f.dataType for f in kind.elementType.fields}
    blank_to_null = lambda x: F.nullif(X.text_or_empty(x), F.lit(""))

    def read(item: Column) -> Column:
        parts = [blank_to_null(item[n]).alias(n) for n in ("title", "track", "name", "song", "artist") if n in fields]
        if "artists" in fields:
            one = lambda a: value_text(a, fields["artists"].elementType)
            parts.append(F.filter(F.transform(item["artists"], one), lambda x: x != "").alias("artists"))
        parts += [item[n].alias(n) for n in ("start_time", "start_time_ms", "timestamp", "time_text") if n in fields]
        return F.struct(*parts)

    return F.transform(c, read)


def compact_metadata(metadata: DataFrame) -> DataFrame:
    """Videos' metadata with what the chains use: texts trimmed, tags and categories as lists, chapters and track lists with their own fields."""
    kinds = {f.name: f.dataType for f in metadata.schema.fields}
    out = [F.col("video_id")]
    out += [_text(metadata, n).alias(n) for n in ("title", "description", "uploader_id", "channel_id", "artist", "uploader", "channel") if n in kinds]
    listed = lambda n: F.filter(F.transform(F.coalesce(F.col(n), F.array().cast(kinds[n])), lambda x: X.text_or_empty(x)), lambda x: x != "")
    if "tags" in kinds:
        out.append(listed("tags").alias("tags"))
    category = value_text(F.col("category"), kinds["category"]) if "category" in kinds else F.lit("")
    categories = listed("categories") if "categories" in kinds else F.array().cast("array<string>")
    if "categories" in kinds or "category" in kinds:
        out.append(F.when((F.size(categories) == 0) & (category != ""), F.array(category)).otherwise(categories).alias("categories"))
    if "chapters" in kinds:
        full = F.filter(F.col("chapters"), lambda c: c["start_time"].isNotNull() | (X.text_or_empty(c["title"]) != ""))
        out.append(F.transform(full, lambda c: F.struct(c["start_time"].alias("start_time"), F.nullif(X.text_or_empty(c["title"]), F.lit("")).alias("title"))).alias("chapters"))
    out += [_compact_items(F.col(n), kinds[n]).alias(n) for n in ("music_tracks", "tracks", "tracklist", "music_sections") if n in kinds]
    return metadata.select(*out)


def read_through(wanted: DataFrame, cache: DataFrame, fetch: Callable[[DataFrame], DataFrame], refresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """Metadata of the wanted ids from the cache, the others from ``fetch`` (a table of ids to one of metadata), and the renewed cache."""
    ids = wanted.select("video_id").distinct()
    held = compact_metadata(cache)
    have = held.limit(0) if refresh else held
    fresh = materialize(compact_metadata(fetch(ids.join(have.select("video_id"), "video_id", "left_anti"))), "metadata")
    renewed = upsert(held, fresh, ["video_id"])
    return renewed.join(ids, "video_id", "left_semi"), renewed


def track_metadata(wanted: DataFrame, metadata: DataFrame) -> DataFrame:
    """(video_id, title, artist, uploader, channel, description, tags, category, url) of each wanted track.

    From the video's metadata where there is any, else from the track itself; an id
    that isn't a video's has no uploader and no channel.
    """
    kinds = {f.name: f.dataType for f in metadata.schema.fields}
    texts = [n for n in ("title", "artist", "uploader", "channel", "description", "tags", "category", "categories", "webpage_url", "url") if n in kinds]
    side = metadata.select(F.col("video_id").alias("_id"), *(value_text(F.col(n), kinds[n]).alias(f"_{n}") for n in texts)).dropDuplicates(["_id"])
    rows = wanted.join(side, (F.col("video_id") == F.col("_id")) & F.col("video_id").rlike(X.VIDEO_ID), "left")
    theirs = lambda n: F.nullif(F.col(f"_{n}"), F.lit("")) if n in texts else F.lit(None).cast("string")
    own = lambda n: F.nullif(_text(wanted, n), F.lit(""))
    person = F.when(F.col("video_id").rlike(X.VIDEO_ID), own("artist"))
    made = {
        "title": F.coalesce(theirs("title"), own("title")),
        "artist": F.coalesce(own("artist"), theirs("artist"), theirs("uploader"), theirs("channel")),
        "uploader": F.coalesce(theirs("uploader"), person),
        "channel": F.coalesce(theirs("channel"), theirs("uploader"), person),
        "description": theirs("description"),
        "tags": theirs("tags"),
        "category": F.coalesce(theirs("categories"), theirs("category")),
        "url": X.video_url(F.col("video_id"), F.coalesce(theirs("webpage_url"), theirs("url"), own("url"), F.lit(""))),
    }
    return rows.select("video_id", *(F.coalesce(c, F.lit("")).alias(n) for n, c in made.items()))


def enrich(wanted: DataFrame, metadata: DataFrame) -> DataFrame:
    """The wanted tracks with their metadata's filled values over their own."""
    return overlay(wanted, track_metadata(wanted, metadata), "video_id")


# --- the analysis of resolved tracks -----------------------------------------


def analyse_resolved(
    tracks: DataFrame, metadata: DataFrame, features: DataFrame, files: DataFrame, resolutions: DataFrame | None = None, deep: bool = True, **settings
) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame]:
    """Resolved tracks with the features of their videos, the renewed feature and resolution caches, and one row of counters.

    Each resolved video is enriched and analysed once; a resolved track whose video
    has no whole analysis becomes ``analysis_failed``, in the resolution cache too.
    """
    wanted = materialize(enrich(wanted_tracks(tracks), metadata).withColumn("track_idx", F.monotonically_increasing_id()), "wanted")
    whole, cache, _ = analyse_tracks(wanted, features, files, deep=deep, **settings)
    whole = materialize(whole.drop("track_idx", "title", "artist", "url"), "analysed_tracks")
    out = materialize(attach_features(tracks, whole, deep), "tracks")
    failed = F.count_if(F.col("resolution_status") == "analysis_failed")
    counts = wanted.agg(F.count("*").alias("tracks_analyzed")).crossJoin(out.agg(F.count_if(analysed(out, deep)).alias("tracks_with_features"), failed.alias("tracks_analysis_failed")))
    renewed = None if resolutions is None else upsert(compact_resolutions(resolutions), compact_resolutions(out), TRACK_KEY)
    return out, cache, renewed, counts


# --- the whole chain ---------------------------------------------------------


def training_pairs(videos: DataFrame, candidates: DataFrame, features: DataFrame, deep: bool = True) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The chain without caches: videos' tracks, their resolution, their features, adjacent pairs.  Returns tracks, pairs and one row of counters."""
    resolved, _ = resolve_tracks(source_rows(videos), candidates)
    tracks = materialize(attach_features(resolved, features, deep), "tracks")
    pairs = transition_pairs(tracks, deep)
    return tracks, pairs, scrape_summary(videos, tracks, pairs)


def training_run(
    channels: Sequence[tuple[DataFrame, dict[str, str]]], metadata: DataFrame, candidates: DataFrame, files: DataFrame, sources: DataFrame, resolutions: DataFrame, features: DataFrame, deep: bool = True, refresh: bool = False, **settings
) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """The chain over several channels with all caches: the pairs, the renewed caches by name, one row of counters.

    ``channels``: each one's listing (video_id, video_title, video_url) and its url, label and label_source.
    """
    rows, scanned = None, None
    for listing, config in channels:
        own, sources, _ = scrape_channel(listing, metadata, sources, config["url"], config["label"], config["label_source"], refresh)
        sources = materialize(sources, "sources")
        rows, scanned = (own, listing.select("video_id")) if rows is None else (rows.unionByName(own), scanned.union(listing.select("video_id")))
    if rows is None:
        raise ValueError("no channel to read")
    resolved, resolutions = resolve_tracks(rows, candidates, resolutions, refresh=refresh)
    tracks, features, resolutions, counts = analyse_resolved(materialize(resolved, "resolved"), metadata, features, files, materialize(resolutions, "resolutions"), deep, refresh=refresh, **settings)
    pairs = transition_pairs(tracks, deep)
    summary = scrape_summary(scanned, tracks, pairs).drop("tracks_analysis_failed").crossJoin(counts).withColumn("channels_scanned", F.lit(len(channels)))
    return pairs, {"sources": sources, "resolutions": resolutions, "features": features}, summary


# --- statistics --------------------------------------------------------------


def cache_statistics(sources: DataFrame, resolutions: DataFrame, documents: DataFrame) -> DataFrame:
    """One row: how many rows and files the caches hold, and their bytes before and after compaction.

    ``documents``: (kind, bytes_before, bytes_after) of each cached JSON document.
    """
    kinds = ("channel_videos", "search_results", "video_metadata")
    a = documents.agg(*(F.count_if(F.col("kind") == k).alias(f"{k}_files") for k in kinds), *(F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("bytes_before", "bytes_after")))
    return a.crossJoin(sources.agg(F.count("*").alias("source_track_rows"))).crossJoin(resolutions.agg(F.count("*").alias("resolution_rows")))
