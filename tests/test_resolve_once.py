"""A text that many tracks share meets its candidates once; a row's own video is never its choice."""

from seguelab.operators import caches as C
from seguelab.operators import tracklists as T
from seguelab.plans import chains

CANDIDATES = "query string, rank int, id string, title string, uploader string, duration int, availability string, url string"


def test_a_text_is_judged_once(spark, monkeypatch):
    rows = spark.createDataFrame([(f"v{i}", i % 3, "Song A - Artist A") for i in range(20)] + [(None, 1, "Song A - Artist A"), ("v1", 9, "nobody asked"), ("v1", 10, None)], "video_id string, position int, track_raw string")
    found = spark.createDataFrame([("song a - artist a", k, f"v{k}", "Song A", "Artist A", 200, "", "") for k in (1, 2, 3)] + [("another", 1, "v9", "Another", "", 1, "", "")], CANDIDATES)
    seen, match = [], T.add_match
    monkeypatch.setattr(T, "add_match", lambda df, *a: seen.append(df.count()) or match(df, *a))
    got = {(r.video_id, r.position): (r.resolution_status, r.resolved_video_id) for r in T.best_candidates(rows, found).collect()}
    assert seen == [3] and len(got) == 23
    assert all(got[f"v{i}", i % 3] == ("resolved", "v2" if i == 1 else "v1") for i in range(20))
    assert [got[k] for k in ((None, 1), ("v1", 9), ("v1", 10))] == [("no_match", None)] * 3


def test_tracks_of_one_file_are_spread(spark, monkeypatch, tmp_path):
    """What a track leads to is worked out in several tasks, though its table is one small file."""
    spark.range(3000).selectExpr("id as p_partkey", "concat('part ', id % 7) as p_name", "'b' as p_brand", "1 as p_size").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    seen, resolve = [], C.resolve_tracks
    monkeypatch.setattr(C, "resolve_tracks", lambda rows, *a: seen.append(rows.rdd.getNumPartitions()) or resolve(rows, *a))
    assert chains.resolve_cached(spark, str(tmp_path)).count() == 3000 and seen[0] > 1
