"""Operators against literal expectations, and the light queries against their SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

from seguelab.functions import text as X
from seguelab.functions.values import human_bytes, rating
from seguelab.operators import relations as R
from seguelab.operators import search as L
from seguelab.operators import tracklists as T
from seguelab.plans import records
from seguelab.sources import readers, writers

SF = "/root/testdata/sf0.001"


def test_rating_bands(spark):
    df = spark.createDataFrame([(None,), (0.82,), (0.67,), (0.52,), (0.40,), (0.12,)], "s double")
    assert [r[0] for r in df.select(rating(F.col("s"))).collect()] == ["start", "excellent", "strong", "good", "mixed", "rough"]


def test_description_lines(spark):
    text = "Tracks\n00:45 - Song A - Artist A\nnoise\n01:02:03 Song B - Artist B\n00:00 -"
    rows = T.description_lines(spark.createDataFrame([("v", text), ("w", None)], "video_id string, description string")).collect()
    assert [(r.position, r.timestamp_s, r.title_guess, r.artist_guess) for r in rows] == [(1, 45, "Song A", "Artist A"), (2, 3723, "Song B", "Artist B")]


def test_chapters_round_and_number(spark):
    df = spark.createDataFrame([("v", [(0.0, "Song A"), (185.0, "Song B"), (None, "x")])], "video_id string, chapters array<struct<start_time:double,title:string>>")
    assert [(r.timestamp, r.track_raw) for r in T.chapter_lines(df).collect()] == [("00:00", "Song A"), ("03:05", "Song B")]


def test_three_part_name_has_no_sides(spark):
    s = spark.range(1).select(X.track_sides(F.lit("Track A - Artist A - Extra")).alias("s"), X.track_text(F.lit("03:25 UMBASA x ARELICE - LUNA")).alias("t")).first()
    assert (s.s.left, s.s.right, s.t) == ("", "", "UMBASA x ARELICE - LUNA")


def test_resolution_avoids_unavailable_and_noise(spark):
    rows = spark.createDataFrame([("m", 1, "Alone - Singer"), ("m", 2, "Nothing here")], "video_id string, position int, track_raw string")
    c = [("alone - singer", 1, "a", "Alone tutorial", "Teacher", 300, None, ""), ("alone - singer", 2, "b", "Alone", "Singer", 200, None, ""), ("alone - singer", 3, "c", "[private video]", "", 100, None, ""), ("nothing here", 1, "d", "x", "y", 5, "private", "")]
    got = {r.position: (r.resolution_status, r.resolved_video_id) for r in T.best_candidates(rows, spark.createDataFrame(c, "query string, rank int, id string, title string, uploader string, duration int, availability string, url string")).collect()}
    assert got == {1: ("resolved", "b"), 2: ("unavailable", None)}


def test_pairs_never_bridge_a_gap(spark):
    rows = spark.createDataFrame([("v", 1, True), ("v", 2, False), ("v", 3, True), ("v", 4, True)], "video_id string, position int, ok boolean")
    assert [(r.from_position, r.to_position) for r in R.adjacent_pairs(rows, "video_id", ["position"], F.col("ok"), ["position"]).collect()] == [(3, 4)]


def test_greedy_proximity_is_one_to_one(spark):
    a = spark.createDataFrame([("v", 1, 0), ("v", 2, 3)], "video_id string, position int, timestamp_s int")
    b = spark.createDataFrame([("v", 1, 1), ("v", 2, 90), ("v", 3, 200)], "video_id string, position int, timestamp_s int")
    assert [(r.position, r.chapter) for r in R.match_nearest(a, b).orderBy("position").collect()] == [(1, 1), (2, None)]


def test_report_ranks_among_the_unused(spark):
    m = [[0, 0.55, 0.85], [0.20, 0, 0.70], [0.90, 0.40, 0]]
    edges = spark.createDataFrame([(i, j, float(m[i][j])) for i in range(3) for j in range(3)], "from_idx long, to_idx long, score double")
    paths = spark.createDataFrame([("p", k + 1, k) for k in range(3)], "playlist_name string, position int, track_idx long")
    r = L.report_steps(paths, edges.filter("from_idx <> to_idx")).orderBy("from_position").first()
    assert (r.transition_rating, r.transition_rank_from_source, r.best_index, round(r.score_gap_to_best, 6)) == ("good", 2, 2, 0.30)


def test_beam_finds_the_best_of_a_small_pool():
    tracks = {i: {"quality": 0.0, "artist": f"a{i}", "mix": "m", "genre": "unknown"} for i in range(4)}
    edges = {0: [(1, 0.9), (2, 0.1)], 1: [(2, 0.9), (3, 0.2)], 2: [(3, 0.9)], 3: []}
    assert L.beam(tracks, edges, 4, 8, 25, {}) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        L.beam(tracks, {0: [], 1: [], 2: [], 3: []}, 2, 8, 25, {})


def test_bytes_in_words(spark):
    assert [r[0] for r in spark.createDataFrame([(512,), (2048,), (-1,)], "n long").select(human_bytes(F.col("n"))).collect()] == ["512.0 B", "2.0 KB", "0.0 B"]


def test_sqlite_round_trip_and_key_check(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", None, 1.5)], "id string, n long, x double")
    path = str(tmp_path / "t.sqlite")
    writers.write_sqlite(df, path, ["id"])
    assert sorted(tuple(r) for r in readers.read_sqlite(spark, path, ["id"]).collect()) == [("a", 1, 0.5), ("b", None, 1.5)]
    with pytest.raises(ValueError):
        writers.write_sqlite(df.union(df), path, ["id"])
    assert readers.read_sqlite(spark, str(tmp_path / "none.sqlite"), ["id"]).count() == 0


@pytest.mark.parametrize("name", [n for n, (_, sql) in records.QUERIES.items() if sql])
def test_query_has_the_rows_of_its_sql(spark, name):
    query, sql = records.QUERIES[name]
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents", "labels", "conversations"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = query(spark, SF)
    names = sorted(df.columns)
    show = lambda v: round(v, 5) + 0.0 if isinstance(v, float) else v
    key = lambda r: tuple(map(str, r))
    mine = sorted((tuple(show(r[c]) for c in names) for r in df.collect()), key=key)
    theirs = sorted((tuple(map(show, r)) for r in con.execute(f"select {', '.join(names)} from ({sql})").fetchall()), key=key)
    assert mine == theirs
