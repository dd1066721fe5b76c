"""From semi-structured text to labelled pairs: track lists, resolution against candidates, adjacent pairs, and the whole chain."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from ..functions.values import analysed, col_or, has
from .relations import adjacent_pairs, keep_first

LONGEST_SECONDS = 900
UNAVAILABLE = ("[deleted video]", "[private video]")
LISTS = ("music_tracks", "tracks", "tracklist", "music_sections")
LABEL, LABEL_SOURCE = "excellent", "youtube_mix_curation"
LEAST_LINES = 2
RESOLVED_COLUMNS = ("resolution_status", "resolved_video_id", "resolved_title", "resolved_artist", "resolved_url", "resolved_duration_seconds")


# --- track lists -------------------------------------------------------------


def _total(code: Column) -> Column:
    return F.aggregate(F.transform(F.split(code, ":"), lambda x: x.cast("int")), F.lit(0), lambda a, x: a * 60 + x)


def _cut(lines: Column) -> Column:
    """The structs (timestamp, timestamp_s, track_raw) of an array that have a name, each with its name split at the separators: once, as what a step names isn't worked out wherever it is used."""
    named = F.filter(lines, lambda x: x["track_raw"] != "")
    return F.transform(named, lambda x: F.struct(x["timestamp"].alias("timestamp"), x["timestamp_s"].alias("timestamp_s"), x["track_raw"].alias("track_raw"), F.split(x["track_raw"], X.SEPARATOR).alias("cut")))


def _numbered(df: DataFrame, keep: Sequence[str], lines: Column) -> DataFrame:
    """The structs (timestamp, timestamp_s, track_raw) of an array, numbered from 1, with the guesses of both sides."""
    rows = df.select(*keep, F.posexplode(_cut(lines)).alias("p", "x"))
    sides = X.cut_sides(F.col("x.cut"))
    return rows.select(*keep, (F.col("p") + 1).alias("position"), "x.timestamp", "x.timestamp_s", "x.track_raw", sides["right"].alias("artist_guess"), sides["left"].alias("title_guess"))


def description_lines(df: DataFrame, text: str = "description", keep: Sequence[str] = ("video_id",)) -> DataFrame:
    """(keep, position, timestamp, timestamp_s, track_raw, artist_guess, title_guess) of the lines that start with a time code.

    The whole list is made within its row, so that nothing is shuffled.  Lines
    without a name after the code don't count; positions number those that do.
    """
    return _numbered(df, keep, _described(text))


def _described(text: str) -> Column:
    found = F.filter(F.split(F.coalesce(F.col(text), F.lit("")), r"\r\n|\r|\n"), lambda x: x.rlike(X.TIME_LINE))

    def read(line: Column) -> Column:
        return F.struct(F.regexp_extract(line, X.TIME_LINE, 1).alias("code"), X.track_text(F.regexp_extract(line, X.TIME_LINE, 2)).alias("name"))

    def judge(x: Column) -> Column:
        return F.struct(x["code"].alias("timestamp"), _total(x["code"]).alias("timestamp_s"), F.when(X.too_short(x["name"]), "").otherwise(x["name"]).alias("track_raw"))

    # in two steps: what a step names is worked out once, not wherever it is used
    return F.transform(F.transform(found, read), judge)


def chapter_lines(df: DataFrame, chapters: str = "chapters", keep: Sequence[str] = ("video_id",)) -> DataFrame:
    """As :func:`description_lines` from an array of (start_time, title); starts round half to even."""
    full = F.filter(F.coalesce(F.col(chapters), F.array()), lambda c: c["start_time"].isNotNull())

    def read(c: Column) -> Column:
        at = F.bround(c["start_time"].cast("double"), 0).cast("int")
        return F.struct(X.time_code(at).alias("timestamp"), at.alias("timestamp_s"), X.track_text(c["title"]).alias("track_raw"))

    return _numbered(df, keep, F.transform(full, read))


def _item_label(item: Column, fields: Mapping[str, T.DataType]) -> Column:
    """``title - artists`` of a list's item, from whichever fields it has."""
    get = lambda n: F.nullif(F.trim(item[n].cast("string")), F.lit("")) if n in fields else F.lit(None).cast("string")
    title = F.coalesce(get("title"), get("track"), get("name"))
    artist = get("artist")
    if isinstance(fields.get("artists"), T.ArrayType):
        inner = fields["artists"].elementType
        name = (lambda a: a["name"]) if isinstance(inner, T.StructType) else (lambda a: a.cast("string"))
        names = F.filter(F.transform(item["artists"], lambda a: F.trim(name(a))), lambda a: a.isNotNull() & (a != ""))
        artist = F.coalesce(F.nullif(F.array_join(names, ", "), F.lit("")), artist)
    joined = F.when(artist.isNotNull() & ~F.contains(F.lower(title), F.lower(artist)), F.concat(title, F.lit(" - "), artist)).otherwise(title)
    song = get("song")
    return F.coalesce(joined, F.when(artist.isNotNull(), F.concat(song, F.lit(" - "), artist)).otherwise(song), artist, F.lit(""))


def _item_seconds(item: Column, fields: Mapping[str, T.DataType]) -> Column:
    known = {"start_time": lambda c: X.loose_seconds(c), "start_time_ms": lambda c: F.bround(c.cast("string").try_cast("double") / 1000, 0).cast("int"), "timestamp": lambda c: X.loose_seconds(c), "time_text": lambda c: X.loose_seconds(c)}
    return F.coalesce(*(f(item[n]) for n, f in known.items() if n in fields), F.lit(None).cast("int"))


def _item_reader(fields: Mapping[str, T.DataType]):
    """Of one parameter, as a second one would be the item's place."""

    def read(item: Column) -> Column:
        at = _item_seconds(item, fields)
        return F.struct(X.time_code(at).alias("timestamp"), at.alias("timestamp_s"), X.track_text(_item_label(item, fields)).alias("track_raw"))

    return read


def watch_lines(df: DataFrame, keep: Sequence[str] = ("video_id",), chapters: str = "chapters") -> DataFrame:
    """As :func:`chapter_lines`; where a row has no chapters, from its other lists in their order, the first of equal (time, name)."""
    return _numbered(_listed(df, chapters), keep, F.col("_listed"))


def _listed(df: DataFrame, chapters: str = "chapters") -> DataFrame:
    """The table with the lines of :func:`watch_lines` as an array ``_listed``; each of the lists is made once for its row."""
    empty = F.array().cast("array<struct<timestamp:string,timestamp_s:int,track_raw:string>>")
    lists = [c for c in LISTS if has(df, c)]
    if has(df, chapters):
        own = F.filter(F.coalesce(F.col(chapters), F.array()), lambda c: c["start_time"].isNotNull())
        at = lambda c: F.bround(c["start_time"].cast("double"), 0).cast("int")
        own = F.transform(own, lambda c: F.struct(X.time_code(at(c)).alias("timestamp"), at(c).alias("timestamp_s"), X.track_text(c["title"]).alias("track_raw")))
        own = F.filter(own, lambda x: x["track_raw"] != "")
    else:
        own = empty
    if not lists:
        return df.withColumn("_listed", own)
    others = empty
    for name in lists:
        fields = {f.name: f.dataType for f in df.schema[name].dataType.elementType.fields}
        others = F.concat(others, F.filter(F.transform(F.coalesce(F.col(name), F.array()), _item_reader(fields)), lambda x: x["timestamp_s"].isNotNull() & (x["track_raw"] != "")))
    key = lambda x: F.concat_ws("|", x["timestamp_s"].cast("string"), F.lower(x["track_raw"]))
    made = df.withColumns({"_own": own, "_others": others})
    made = made.withColumn("_keys", F.transform("_others", key))
    first = F.filter("_others", lambda x, i: F.array_position("_keys", key(x)) == i + 1)
    return made.withColumn("_listed", F.when(F.size("_own") > 0, F.col("_own")).otherwise(first)).drop("_own", "_others", "_keys")


def _nearest_chapters(lines: Column, chapters: Column, tolerance: int = 5) -> Column:
    """As :func:`~seguelab.operators.relations.match_nearest` within a row: for each line the place of its chapter from 0, or -1."""

    def pick(taken: Column, line: Column) -> Column:
        gaps = F.transform(chapters, lambda c, k: F.struct(F.abs(c["timestamp_s"] - line["timestamp_s"]).alias("gap"), k.alias("k")))
        near = F.filter(gaps, lambda x: (x["gap"] <= tolerance) & ~F.array_contains(taken, x["k"]))
        same = F.when(F.size(lines) == F.size(chapters), F.size(taken))
        return F.concat(taken, F.array(F.coalesce(F.array_min(near)["k"], same, F.lit(-1))))

    none = F.transform(lines, lambda _: F.lit(-1))
    return F.when(F.size(chapters) == 0, none).otherwise(F.aggregate(lines, F.array().cast("array<int>"), pick))


def source_rows(videos: DataFrame, label: str = LABEL, label_source: str = LABEL_SOURCE, version: int = 4) -> DataFrame:
    """One row for each track of each video, from its description if that has two lines or more, else from its chapters.

    ``videos``: video_id, video_url, channel_url, title, uploader_id, description,
    chapters (and other lists), a row for each video.  A described track takes the
    nearest chapter within five seconds, one to one.  Videos with fewer than two
    tracks give none, nor do those without an id.  Each video's list is made within
    its row, so that nothing is shuffled.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")) if has(videos, c) else F.lit("")
    handle = F.coalesce(F.nullif(text("uploader_id"), F.lit("")), F.nullif(X.channel_handle(text("channel_url")), F.lit("")), text("channel_id"))
    meta = {"channel_url": text("channel_url"), "channel_handle": handle, "label": F.lit(label), "label_source": F.lit(label_source), "source_cache_version": F.lit(version), "video_title": text("title"), "video_url": X.video_url(F.col("video_id"), text("video_url")), "description_length": F.length(text("description"))}
    rows = _listed(videos.filter("video_id is not null")).select("video_id", *(c.alias(n) for n, c in meta.items()), _cut(_described("description")).alias("_told"), _cut(F.col("_listed")).alias("_chapters"))
    told, chapters = F.col("_told"), F.col("_chapters")
    rows = rows.withColumn("_met", F.when(F.size(told) >= LEAST_LINES, _nearest_chapters(told, chapters)))

    def line(x: Column, i: Column, source: Column, title: Column, at: Column) -> Column:
        own = [x[n].alias(n) for n in ("timestamp", "timestamp_s", "track_raw", "cut")]
        return F.struct(source.alias("track_source"), title.alias("chapter_title"), at.cast("int").alias("chapter_timestamp_s"), (i + 1).alias("position"), *own)

    def described(x: Column, i: Column) -> Column:
        k = F.col("_met")[i]
        there, chapter = k >= 0, F.get(chapters, k)
        return line(x, i, F.when(there, "description+chapters").otherwise("description"), F.when(there, chapter["track_raw"]).otherwise(""), F.when(there, chapter["timestamp_s"]))

    of_chapters = F.transform(chapters, lambda x, i: line(x, i, F.lit("chapters"), x["track_raw"], x["timestamp_s"]))
    lines = F.when(F.size(told) >= LEAST_LINES, F.transform(told, described)).when(F.size(chapters) >= LEAST_LINES, of_chapters)
    out = rows.select("video_id", *meta, F.explode(lines).alias("x"))
    sides = X.cut_sides(F.col("x.cut"))
    own = ["track_source", "chapter_title", "chapter_timestamp_s", "position", "timestamp", "timestamp_s", "track_raw"]
    return out.select("video_id", *meta, *(f"x.{n}" for n in own), sides["right"].alias("artist_guess"), sides["left"].alias("title_guess"))


# --- resolution --------------------------------------------------------------


def add_match(df: DataFrame, track: str, title: str, artist: str, duration: str, fold=X.folded) -> DataFrame:
    """``overlap`` and ``match_score`` of a candidate's title and artist for a track's text.

    The tokens that a track leads one to expect are looked for in title and artist;
    which side is the artist counts by the better way round.
    """
    name = lambda c: X.text_or_empty(F.col(c))
    clean = X.track_text(F.col(track))
    sides = X.track_sides(clean)
    texts = {"q1": clean, "q2": X.search_text(F.col(track)), "l": sides["left"], "r": sides["right"], "t": name(title), "a": name(artist), "at": F.trim(F.concat_ws(" ", name(artist), name(title)))}
    wide = df.withColumns({f"_m_{k}": X.match_text(c, fold) for k, c in texts.items()}).withColumns({"_left": sides["left"], "_q2": texts["q2"], "_q1": clean})
    tok = {k: X.tokens(F.col(f"_m_{k}")) for k in texts}
    wide = wide.withColumns({f"_k_{k}": v for k, v in tok.items()})
    k = lambda n: F.col(f"_k_{n}")
    every, wanted = F.array_union(k("t"), k("a")), F.array_union(k("q1"), k("q2"))
    both, own = X.overlap(wanted, every), X.overlap(wanted, k("t"))
    o = X.overlap
    way = F.greatest(0.65 * o(k("l"), k("a")) + 0.35 * o(k("r"), k("t")), 0.65 * o(k("r"), k("a")) + 0.35 * o(k("l"), k("t")), 0.5 * o(k("l"), every) + 0.5 * o(k("r"), every))
    oriented = F.when(F.col("_left") != "", way).otherwise(F.lit(0.0))

    def exact(n: str) -> Column:
        q, whole = F.col(f"_m_{n}"), F.col("_m_at")
        return F.when(q == "", 0.0).when(F.contains(whole, q), 0.6).when(F.forall(k(n), lambda x: F.contains(whole, x)), 0.3).otherwise(0.0)

    seconds = F.col(duration)
    penalty = F.when(name(title).rlike(X.NOISE) & (both < 0.85), 0.7).otherwise(0.0) + F.when(seconds.isNull(), 0.05).otherwise(0.0)
    score = 1.1 * both + 0.9 * own + 1.2 * oriented + F.greatest(exact("q1"), exact("q2")) + F.when(seconds <= 600, 0.15).otherwise(0.0) - penalty
    made = [X.overlap(wanted, k("at")).alias("overlap"), score.alias("match_score"), (F.size(wanted) > 0).alias("expects")]
    return wide.select(*(F.col(f"`{c}`") for c in df.columns), *made)


def best_candidates(rows: DataFrame, candidates: DataFrame, keys: Sequence[str] = ("video_id", "position"), track: str = "track_raw", fold=X.folded) -> DataFrame:
    """The keys with the status and the chosen candidate of each track.

    ``candidates``: query (as from :func:`~seguelab.functions.text.plain_query`), rank, id, title,
    uploader, duration, availability, url.  Distinct queries meet them by an equi-join;
    of a candidate that several of a track's queries find, the first counts.  Tracks
    of one text are judged once: as only a row's own video is no candidate for it,
    each row's choice is among its text's best two.
    """
    keys = list(keys)
    asked = rows.select(F.col(track).alias("_track")).distinct().select("_track", F.posexplode(X.search_queries(F.col("_track"))).alias("_variant", "_q")).withColumn("_query", X.plain_query(F.col("_q")))
    side = candidates.select(F.col("query").alias("_query"), F.col("rank").alias("_rank"), F.trim("id").alias("_id"), X.text_or_empty(F.col("title")).alias("_title"), X.text_or_empty(F.col("uploader")).alias("_artist"), F.col("duration").cast("int").alias("_duration"), F.lower(X.text_or_empty(F.col("availability"))).alias("_availability"), X.text_or_empty(F.col("url")).alias("_url"))
    met = keep_first(asked.join(side, "_query").filter("_id <> ''"), ["_track", "_id"], ["_variant", "_rank"])
    gone = F.lower("_title").isin(*UNAVAILABLE) | F.col("_availability").isin("private", "unavailable")
    scored = add_match(met.withColumn("_gone", gone), "_track", "_title", "_artist", "_duration", fold)
    long = F.coalesce(F.col("_duration"), F.lit(LONGEST_SECONDS + 1))
    plain = (F.coalesce(F.col("_duration") <= LONGEST_SECONDS, F.lit(False))).cast("int")
    order = Window.partitionBy("_track").orderBy("_gone", F.when(F.col("expects"), -F.col("match_score")).otherwise(-plain), F.when(F.col("expects"), -F.col("overlap")), F.when(F.col("expects"), long), "_variant", "_rank")
    top = scored.withColumn("_n", F.row_number().over(order)).filter("_n <= 2")
    weak = F.col("expects") & ((F.col("match_score") < 1.05) | ((F.col("overlap") < 0.5) & (F.col("match_score") < 1.45)))
    status = F.when(F.col("_gone"), "unavailable").when(weak, "no_match").otherwise("resolved")
    picks = top.groupBy("_track").agg(F.array_sort(F.collect_list(F.struct("_n", "_id", status.alias("_status"), "_title", "_artist", "_url", "_duration"))).alias("_picks"))
    # a key with a null has no candidates
    video = F.col("video_id").cast("string") if "video_id" in keys else F.lit("")
    whole = reduce(lambda a, b: a & b, (F.col(f"`{k}`").isNotNull() for k in keys))
    own = F.when(whole, F.try_element_at(F.filter("_picks", lambda x: x["_id"] != video), F.lit(1)))
    met = rows.select(*keys, F.col(track).alias("_asked")).join(picks, F.col("_asked") == F.col("_track"), "left").select(*keys, own.alias("_x"))
    good = F.col("_x._status") == "resolved"
    return met.select(*keys, F.coalesce("_x._status", F.lit("no_match")).alias("resolution_status"), F.when(good, F.col("_x._id")).alias("resolved_video_id"), F.when(good, F.col("_x._title")).alias("resolved_title"), F.when(good, F.col("_x._artist")).alias("resolved_artist"), F.when(good, X.video_url(F.col("_x._id"), F.col("_x._url"))).alias("resolved_url"), F.when(good, F.col("_x._duration")).alias("resolved_duration_seconds"))


def wanted_tracks(resolved: DataFrame) -> DataFrame:
    """One row for each resolved video, the first in the order of lists: what has to be analysed."""
    good = resolved.filter((F.col("resolution_status") == "resolved") & (F.trim("resolved_video_id") != ""))
    first = keep_first(good, ["resolved_video_id"], ["video_id", "position"])
    unknown = [F.lit("").alias(c) for c in ("uploader", "channel", "description", "tags", "category")]
    return first.select(F.col("resolved_video_id").alias("video_id"), F.col("resolved_title").alias("title"), F.col("resolved_artist").alias("artist"), F.col("resolved_url").alias("url"), *unknown)


def attach_features(resolved: DataFrame, features: DataFrame, deep: bool = True) -> DataFrame:
    """Tracks with the features of their resolved videos; resolved ones without a full analysis become ``analysis_failed``."""
    names = [c for c in features.columns if c not in resolved.columns and c != "video_id"]
    side = features.select(F.col("video_id").alias("_id"), *(F.col(f"`{c}`") for c in names))
    joined = resolved.join(side, F.col("resolved_video_id") == F.col("_id"), "left").drop("_id")
    failed = (F.col("resolution_status") == "resolved") & ~analysed(joined, deep)
    return joined.withColumn("resolution_status", F.when(failed, "analysis_failed").otherwise(F.col("resolution_status")))


# --- pairs -------------------------------------------------------------------


def transition_pairs(tracks: DataFrame, deep: bool = True) -> DataFrame:
    """Adjacent tracks of each video that are both resolved and analysed; a gap is never bridged."""
    good = F.coalesce(F.col("resolution_status") == "resolved", F.lit(False)) & analysed(tracks, deep)
    meta = [c for c in ("label", "label_source", "channel_handle", "channel_url", "video_title", "video_url", "description_length") if has(tracks, c)]
    own = [c for c in tracks.columns if c not in (*meta, "video_id", "source_cache_version", "resolution_signature")]
    pairs = adjacent_pairs(tracks, "video_id", ["position"], good, [*own, *meta])
    kept = [F.coalesce(F.nullif(F.col(f"from_{c}"), F.lit("")), F.lit({"label": LABEL, "label_source": LABEL_SOURCE}[c])).alias(c) if c in ("label", "label_source") else F.col(f"from_{c}").alias(c) for c in meta]
    sides = [F.col(f"{s}_{c}").alias(f"{s}_video_id" if c == "resolved_video_id" else f"{s}_{c}") for c in own for s in ("from", "to")]
    gap = F.greatest(F.col("to_timestamp_s") - F.col("from_timestamp_s"), F.lit(0)).alias("transition_duration_s")
    return pairs.select("video_id", *kept, gap, *sides)


def scrape_summary(videos: DataFrame, tracks: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row of counters: videos, parsed, resolved, unavailable, unresolved and failed tracks, pairs and skipped pairs."""
    status = F.col("resolution_status")
    a = videos.agg(F.count("*").alias("videos_scanned"))
    b = tracks.agg(
        F.count_distinct("video_id").alias("videos_with_tracklist"),
        F.count("*").alias("tracks_parsed"),
        F.count_if(status.isin("resolved", "analysis_failed")).alias("tracks_resolved"),
        F.count_if(status == "unavailable").alias("tracks_unavailable"),
        F.count_if(~status.isin("resolved", "analysis_failed")).alias("tracks_unresolved"),
        F.count_if(status == "analysis_failed").alias("tracks_analysis_failed"),
    )
    c = pairs.agg(F.count("*").alias("positive_pairs"))
    joined = a.crossJoin(b).crossJoin(c)
    skipped = F.col("tracks_parsed") - F.col("videos_with_tracklist") - F.col("positive_pairs")
    return joined.withColumns({"videos_skipped": F.col("videos_scanned") - F.col("videos_with_tracklist"), "pairs_skipped": skipped})


def share_text(part: Column, whole: Column) -> Column:
    """A percentage with one decimal, ``n/a`` of nothing."""
    return F.when(whole > 0, F.format_string("%.1f%%", F.lit(100.0) * part / whole)).otherwise("n/a")


def summary_text(summary: DataFrame, output: str = "", errors: str = "") -> DataFrame:
    """The counters as a report of a line for each stage; a counter that the table lacks is 0."""
    n = lambda c: F.coalesce(col_or(summary, c, 0).cast("long"), F.lit(0))
    shown = lambda name, c, whole=None: F.concat(F.lit(f"{name}="), n(c).cast("string"), *([F.lit(" ("), share_text(n(c), whole), F.lit(")")] if whole is not None else []))
    line = lambda head, *parts: F.concat(F.lit(f"- {head}: "), F.concat_ws(" ", *parts))
    base = F.when(n("tracks_resolved") > 0, n("tracks_resolved")).otherwise(n("tracks_analyzed"))
    lines = [
        F.lit("Training Scrape Report"),
        F.lit(f"- Output CSV: {output}"),
        F.lit(f"- Session Errors: {errors}"),
        line("Sources", shown("channels_scanned", "channels_scanned"), shown("channels_failed", "channels_failed", n("channels_scanned"))),
        line("Videos", shown("scanned", "videos_scanned"), shown("with_tracklist", "videos_with_tracklist", n("videos_scanned")), shown("skipped", "videos_skipped", n("videos_scanned"))),
        line("Tracks", shown("parsed", "tracks_parsed"), *(shown(k, f"tracks_{k}", n("tracks_parsed")) for k in ("resolved", "unresolved", "unavailable"))),
        line("Analysis", shown("analyzed_unique", "tracks_analyzed"), shown("with_features", "tracks_with_features", base), shown("analysis_failed", "tracks_analysis_failed", base)),
        line("Pairs", shown("positive", "positive_pairs"), shown("skipped", "pairs_skipped"), F.concat(F.lit("kept_rate="), share_text(n("positive_pairs"), n("positive_pairs") + n("pairs_skipped")))),
        line("Logged issues", shown("warnings", "warning_count"), shown("errors", "error_count")),
    ]
    return summary.select(F.concat_ws("\n", *lines).alias("report"))


#: What the export of training pairs holds, in this order: a pair's own columns, then those of both sides.
_EXPORT_PAIR = "video_id label label_source channel_handle channel_url video_title video_url".split()
_BOTH = lambda *names: [f"{side}_{n}" for n in names for side in ("from", "to")]
_EACH = lambda *names: [f"{side}_{n}" for side in ("from", "to") for n in names]
EXPORT_COLUMNS = [
    *_EXPORT_PAIR, *_BOTH("position"), "transition_duration_s", *_BOTH("track_raw"), *_EACH("artist_guess", "title_guess"), *_BOTH("track_source", "video_id"),
    *_EACH(*(f"resolved_{n}" for n in ("title", "artist", "url", "duration_seconds"))), *_BOTH("uploader", "channel", "category", "tags", "description"),
]


def compact_pairs(pairs: DataFrame) -> DataFrame:
    """For export: the listed columns that are there, in their order, descriptions on one line; of an empty table all of them."""
    every = pairs.isEmpty()
    there = [c for c in EXPORT_COLUMNS if every or has(pairs, c)]
    shown = lambda c: X.one_line(F.col(c)) if c.endswith("_description") else F.col(c)
    return pairs.select(*((shown(c) if has(pairs, c) else F.lit(None).cast("string")).alias(c) for c in there))
