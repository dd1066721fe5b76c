"""Caches and the chains that read and renew them, on a few literal tables and generated sound files."""

import io
import sqlite3
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelab.functions import text as X
from seguelab.operators import audio, caches
from seguelab.operators import tracklists as T
from seguelab.sources import readers, writers

FILES = "video_id string, path string, content binary"
URL, LABEL, SOURCE = "https://www.youtube.com/@mix_a/videos", "excellent", "mix_a"


def sound(pitch=220.0, seconds=2.0, rate=8000, quiet=0.2):
    """A tone that rises at once and falls away, with silence at both ends."""
    t = np.arange(int(seconds * rate)) / rate
    y = np.sin(2 * np.pi * pitch * t) * np.minimum(1, (seconds - t) / seconds * 2) * 0.8
    y = np.concatenate([np.zeros(int(quiet * rate)), y, np.zeros(int(quiet * rate))])
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1), w.setsampwidth(2), w.setframerate(rate)
        w.writeframes((y * 32767).astype("<i2").tobytes())
    return out.getvalue()


def features_of(df):
    return {c: 1.0 for c in ("tempo", "key", "mode", "intro_tempo", "outro_tempo", "intro_seconds_used", "outro_seconds_used", "intro_attack_time_s", "intro_flux_peak", "outro_abruptness", "outro_release_time_s")} | df


def feature_table(spark, rows):
    names = sorted({k for r in rows for k in r})
    kinds = {c: "double" if c not in ("video_id", "analysis_signature", "flow_profile", "title") else "string" for c in names}
    return spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], ", ".join(f"{c} {kinds[c]}" for c in names))


def test_feature_cache_in_its_present_form(spark):
    sign = X.analysis_signature()
    rows = [{"video_id": " a ", "analysis_signature": sign, "tempo": 100.0}, {"video_id": "a", "analysis_signature": sign, "tempo": 120.0}, {"video_id": "a", "analysis_signature": "v1|edge=15|silence=35|flow=deep-dj", "tempo": 90.0}]
    rows += [{"video_id": "b", "edge_seconds": 30.0, "silence_top_db": 35.0, "flow_profile": "deep-dj", "cache_version": 1.0, "tempo": 80.0, "title": "gone"}, {"video_id": " ", "tempo": 1.0}]
    out = caches.normalise_features(feature_table(spark, rows).coalesce(1))
    got = {(r.video_id, r.analysis_signature): r.tempo for r in out.collect()}
    assert got == {("a", sign): 120.0, ("a", "v1|edge=15|silence=35|flow=deep-dj"): 90.0, ("b", sign): 80.0}
    assert out.columns[:2] == caches.FEATURE_KEY and not {"title", "edge_seconds"} & set(out.columns) and "sentiment_warmth" in out.columns
    again = caches.upsert_features(out, feature_table(spark, [{"video_id": "b", "analysis_signature": sign, "tempo": 81.0}]))
    assert {(r.video_id, r.tempo) for r in again.collect()} == {("a", 120.0), ("a", 90.0), ("b", 81.0)}
    with pytest.warns(UserWarning):
        assert caches.normalise_features(spark.range(3)).count() == 0


def test_legacy_rows_come_in_where_their_key_is_new(spark, tmp_path):
    (tmp_path / "f").mkdir()
    for name, text in (("one", '{"cache_version": 1, "settings": {"edge_seconds": 30, "silence_top_db": 35, "flow_profile": "deep-dj"}, "features": {"tempo": 150.0}}'), ("two", '{"cache_version": 1, "settings": {"edge_seconds": 30, "silence_top_db": 35, "flow_profile": "deep-dj"}, "features": {"tempo": 202.0}}'), ("three", "[1]")):
        (tmp_path / "f" / f"{name}.json").write_text(text)
    base = str(tmp_path / "f.sqlite")
    writers.write_feature_cache(feature_table(spark, [{"video_id": "one", "analysis_signature": X.analysis_signature(), "tempo": 101.0}]), base)
    cache = writers.load_feature_cache(spark, base, {"tempo": "double"})
    assert {(r.video_id, r.tempo) for r in cache.collect()} == {("one", 101.0), ("two", 202.0)}
    with sqlite3.connect(base) as db:  # written anew
        assert sorted(db.execute("select video_id, tempo from audio_features").fetchall()) == [("one", 101.0), ("two", 202.0)]
    assert {r.video_id for r in readers.read_feature_cache(spark, base).collect()} == {"one", "two"}
    assert readers.read_json_object(str(tmp_path / "f" / "three.json")) is None and readers.read_json_object(str(tmp_path / "none.json")) is None
    assert {r.name for r in readers.read_json_objects(spark, str(tmp_path / "f"), "cache_version int").filter("cache_version = 1").collect()} == {"one", "two"}


def test_tracks_are_analysed_once(spark):
    """Features of the table stay, then the cache's, then another signature's, then the files'; a bad file leaves a gap."""
    tracks = spark.createDataFrame([(0, "dup", "first row", None), (1, "dup", "second row", None), (2, "cached", "", None), (3, "other", "", None), (4, "bad", "", None), (5, "", "", None), (6, "file-less", "", None)], "track_idx int, video_id string, description string, tempo double")
    cache = feature_table(spark, [features_of({"video_id": "cached", "analysis_signature": X.analysis_signature(), "tempo": 111.0}), features_of({"video_id": "other", "analysis_signature": "v1|edge=15|silence=35|flow=deep-dj", "tempo": 99.0})])
    files = spark.createDataFrame([("dup", "/a/dup.wav", sound()), ("bad", "/a/bad.wav", b"no sound"), ("cached", "/a/cached.wav", sound())], FILES)
    calls = spark.sparkContext.accumulator(0)

    def counted(data):
        calls.add(1)
        return audio.extract(data)

    out, renewed, counts = caches.analyse_tracks(tracks, cache, files, extractor=counted, any_signature=True)
    got = {r.track_idx: r for r in out.collect()}
    assert got[0].tempo == got[1].tempo and got[0].tempo is not None and (got[0].description, got[1].description) == ("first row", "second row")
    assert got[2].tempo == 111.0 and got[3].tempo == 99.0 and got[4].tempo is None and got[5].tempo is None and got[6].tempo is None
    assert counts.first().asDict() == {"reused_from_table": 0, "without_id": 1, "reused_from_cache": 2, "analysed": 1, "failed": 1}
    assert calls.value == 2  # dup and bad, each once
    assert {(r.video_id, r.analysis_signature) for r in renewed.collect()} == {("cached", X.analysis_signature()), ("other", "v1|edge=15|silence=35|flow=deep-dj"), ("dup", X.analysis_signature())}
    again, _, counts = caches.analyse_tracks(out, renewed, files, any_signature=True)
    assert counts.first().reused_from_table == 4 and counts.first().analysed == 0
    assert caches.analyse_tracks(tracks, cache, files, refresh=True, max_tracks=3)[2].first().asDict() == {"reused_from_table": 0, "without_id": 0, "reused_from_cache": 0, "analysed": 2, "failed": 0}


def test_tasks_merge_what_rows_know(spark):
    rows = spark.createDataFrame([(0, "v", "", "", "short"), (1, "v", "Song", "Who", "a longer description"), (2, " ", "x", "", "")], "track_idx int, video_id string, title string, artist string, description string")
    task = caches.track_tasks(rows).collect()
    assert len(task) == 1 and (task[0].title, task[0].artist, task[0].url) == ("Song", "Who", "https://www.youtube.com/watch?v=v") and task[0].context_text == "song | who | a longer description"


LISTED = "video_id string, video_title string, video_url string"
META = "video_id string, title string, description string, uploader_id string"
CANDIDATES = "query string, rank int, id string, title string, uploader string, duration int, availability string, url string"


def mixes(spark):
    listing = spark.createDataFrame([("mix-a", "Mix A", ""), ("mix-b", "Mix B", ""), ("mix-a", "again", ""), ("mix-c", "One line", "")], LISTED)
    told = {"mix-a": "00:00 Song A - Artist A\n03:00 Song B - Artist B\n06:00 Song C - Artist C", "mix-b": "00:00 Song A - Artist A\n02:00 -\n04:00 Gone - Nobody", "mix-c": "00:00 Song A - Artist A"}
    metadata = spark.createDataFrame([(k, f"title {k}", v, "@who") for k, v in told.items()], META)
    found = [(f"song {c} - artist {c}", 1, f"video-song-{c}", f"Song {c.upper()}", f"Artist {c.upper()}", 200, "", "") for c in "abc"] + [("gone - nobody", 1, "video-gone-x", "[Deleted video]", "", None, "", "")]
    files = spark.createDataFrame([(f"video-song-{c}", f"/{c}.wav", sound(200 + 20 * k)) for k, c in enumerate("ab")] + [("video-song-c", "/c.wav", b"bad")], FILES)
    return listing, metadata, spark.createDataFrame(found, CANDIDATES), files


def test_the_chain_with_its_caches(spark):
    listing, metadata, candidates, files = mixes(spark)
    none = spark.createDataFrame([], "video_id string, position int")
    run = lambda sources, resolutions, features, **more: caches.training_run([(listing, {"url": URL, "label": LABEL, "label_source": SOURCE})], metadata, candidates, files, sources, resolutions, features, **more)
    pairs, kept, counts = run(none, none, spark.createDataFrame([], "video_id string, analysis_signature string"))
    got = [(r.video_id, r.from_position, r.to_position, r.from_video_id, r.to_video_id, r.label, r.label_source) for r in pairs.collect()]
    assert got == [("mix-a", 1, 2, "video-song-a", "video-song-b", LABEL, SOURCE)]  # the third track's file is bad: no pair, no bridge
    row = counts.first().asDict()
    assert {k: row[k] for k in ("tracks_parsed", "tracks_resolved", "tracks_unavailable", "positive_pairs", "tracks_analyzed", "tracks_with_features", "tracks_analysis_failed")} == {"tracks_parsed": 5, "tracks_resolved": 4, "tracks_unavailable": 1, "positive_pairs": 1, "tracks_analyzed": 3, "tracks_with_features": 3, "tracks_analysis_failed": 1}
    sources, resolutions = kept["sources"].collect(), {(r.video_id, r.position): r.resolution_status for r in kept["resolutions"].collect()}
    assert kept["sources"].columns == caches.SOURCE_CACHE and kept["resolutions"].columns == caches.RESOLUTION_CACHE and len(sources) == 5
    assert resolutions == {("mix-a", 1): "resolved", ("mix-a", 2): "resolved", ("mix-a", 3): "analysis_failed", ("mix-b", 1): "resolved", ("mix-b", 2): "unavailable"}
    assert {r.video_id for r in kept["features"].collect()} == {"video-song-a", "video-song-b"}
    # a second run works nothing out: no metadata, no candidates and no files are there
    blank = lambda df: df.limit(0)
    again, later, _ = caches.training_run([(listing, {"url": URL, "label": LABEL, "label_source": SOURCE})], blank(metadata), blank(candidates), blank(files), *(kept[k] for k in ("sources", "resolutions", "features")))
    own = [c for c in pairs.columns if c in again.columns and c != "video_title" and not c.endswith(("description", "uploader", "channel"))]  # what only the metadata told is not there
    assert sorted(map(str, again.select(own).collect())) == sorted(map(str, pairs.select(own).collect()))
    assert {(r.video_id, r.position): r.resolution_status for r in later["resolutions"].collect()} == resolutions
    exported = T.compact_pairs(pairs)
    assert exported.columns == [c for c in T.EXPORT_COLUMNS if c in pairs.columns] and not any(c.endswith("tempo") for c in exported.columns)
    assert T.compact_pairs(pairs.limit(0)).columns == T.EXPORT_COLUMNS


def test_sources_of_another_label_are_read_again(spark):
    listing, metadata, *_ = mixes(spark)
    none = spark.createDataFrame([], "video_id string, position int")
    rows, cache, counts = caches.scrape_channel(listing, metadata, none, URL, LABEL, SOURCE)
    assert counts.first().asDict() == {"videos_scanned": 3, "videos_with_tracklist": 2, "tracks_parsed": 5, "videos_skipped": 1, "videos_from_cache": 0}
    same, _, counts = caches.scrape_channel(listing, metadata.limit(0), cache, URL, LABEL, SOURCE)
    names = [c for c in rows.columns if c != "video_title"]
    assert counts.first().videos_from_cache == 2 and sorted(map(str, same.select(names).collect())) == sorted(map(str, rows.select(names).collect()))
    other, renewed, counts = caches.scrape_channel(listing, metadata, cache, URL, "good", SOURCE)
    assert counts.first().videos_from_cache == 0 and {r.label for r in other.collect()} == {"good"} and renewed.count() == 5


def test_resolutions_of_other_settings_are_not_valid(spark):
    rows = spark.createDataFrame([("m", 1, "Alone - Singer"), ("m", 2, "Other - Singer"), ("m", 3, "--"), ("m", 4, "Third - Singer")], "video_id string, position int, track_raw string")
    old = "video_id string, position int, resolution_signature string, search_query string, normalized_search_query string, search_max_results string, resolution_cache_version string, resolution_status string, resolved_video_id string, resolved_title string, resolved_artist string, resolved_duration_seconds int"
    sign = rows.limit(1).select(caches.resolution_signature(F.lit("alone - singer"))).first()[0]
    cache = spark.createDataFrame([("m", 1, sign, "", "", "", "", "resolved", "kept-video-1", "Alone", "Singer", 100), ("m", 2, "", "Other - Singer", "other - singer", "3", "4", "resolved", "old-video-2", "x", "y", 1), ("m", 4, "", "Third - Singer", "third - singer", "5", "4", "no_match", "", "", "", None)], old)
    candidates = spark.createDataFrame([("other - singer", 1, "new-video-2", "Other", "Singer", 200, "", "")], CANDIDATES)
    out, renewed = caches.resolve_tracks(rows, candidates, cache)
    got = {r.position: (r.resolution_status, r.resolved_video_id) for r in out.collect()}
    assert got == {1: ("resolved", "kept-video-1"), 2: ("resolved", "new-video-2"), 3: ("ignored", None), 4: ("no_match", None)}
    assert {(r.position, r.resolved_video_id) for r in renewed.collect()} == {(1, "kept-video-1"), (2, "new-video-2"), (3, ""), (4, "")}
    assert {r.resolved_video_id for r in caches.resolve_tracks(rows, candidates, cache, refresh=True)[0].collect()} == {None, "new-video-2"}


def test_metadata_compact_and_read_through(spark):
    kind = "video_id string, title string, formats string, tags array<string>, category array<struct<name:string>>, chapters array<struct<start_time:double,title:string,end_time:double>>, tracks array<struct<song:string,artists:array<struct<name:string>>,start_time:double,extra:string>>"
    rows = [("aaaaaaaaaaa", " T ", "big", [" x ", ""], [("Music",), ("",)], [(0.0, " One ", 5.0), (None, " ", None)], [(" S ", [("A",), (" ",)], 1.0, "e")])]
    meta = spark.createDataFrame(rows, kind)
    one = caches.compact_metadata(meta).first()
    assert (one.title, one.tags, one.categories) == ("T", ["x"], ["Music"]) and "formats" not in one.asDict()
    assert [tuple(c) for c in one.chapters] == [(0.0, "One")] and [(t.song, t.artists, t.start_time) for t in one.tracks] == [("S", ["A"], 1.0)]
    asked = []

    def fetch(ids):
        asked.extend(r.video_id for r in ids.collect())
        return meta.join(ids, "video_id", "left_semi")

    got, cache = caches.read_through(meta.select("video_id"), caches.compact_metadata(meta.limit(0)), fetch)
    again, _ = caches.read_through(meta.select("video_id"), cache, fetch)
    assert asked == ["aaaaaaaaaaa"] and got.count() == again.count() == 1
    wanted = spark.createDataFrame([("aaaaaaaaaaa", "mine", "Who", "", "", "", "", "", ""), ("short", "t", "p", "", "", "", "", "", "")], "video_id string, title string, artist string, url string, uploader string, channel string, description string, tags string, category string")
    out = {r.video_id: r for r in caches.enrich(wanted, caches.compact_metadata(meta)).collect()}
    assert (out["aaaaaaaaaaa"].title, out["aaaaaaaaaaa"].artist, out["aaaaaaaaaaa"].uploader, out["aaaaaaaaaaa"].tags, out["aaaaaaaaaaa"].category) == ("T", "Who", "Who", "x", "Music")
    assert (out["short"].title, out["short"].uploader) == ("t", "")


def test_statistics_of_caches(spark):
    docs = spark.createDataFrame([("search_results", 10, 4), ("search_results", 20, 6), ("video_metadata", 5, 5), ("else", 0, 0)], "kind string, bytes_before long, bytes_after long")
    row = caches.cache_statistics(spark.range(3), spark.range(2), docs).first().asDict()
    assert row == {"channel_videos_files": 0, "search_results_files": 2, "video_metadata_files": 1, "bytes_before": 35, "bytes_after": 15, "source_track_rows": 3, "resolution_rows": 2}
