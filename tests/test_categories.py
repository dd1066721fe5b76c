"""Categories, clusters, track lists of metadata and greedy matching."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelab.functions import text as X
from seguelab.operators import genre as G
from seguelab.operators import relations as R
from seguelab.operators import tracklists as T
from seguelab.plans import scores


def test_genre_text_and_keywords(spark):
    rows = [("Deep-House_Session!", "house_techno"), ("hip hop", "hip_hop_rap"), ("R&B night", "rnb_soul"), ("夜", "unknown"), (None, "unknown"), ("popular", "unknown")]
    df = spark.createDataFrame([(k, t) for k, (t, _) in enumerate(rows)], "i int, t string")
    got = df.select("i", X.genre_text(F.col("t")).alias("text"), G.keyword_genre("t").alias("g")).orderBy("i").collect()
    assert [r.g.genre for r in got] == [g for _, g in rows] and got[0].text == "deep house session" and got[2].text == "r&b night"
    # two keywords, of which one has two words: 1.15 and 1, no other genre
    assert got[0].g.confidence == pytest.approx(min(0.98, 0.60 + 0.12 * 2.15 + 0.08 * 2.15)) and got[2].g.confidence == pytest.approx(0.60 + 0.12 + 0.08)
    # a genre whose keyword is listed twice counts twice
    assert got[1].g.confidence == pytest.approx(min(0.98, 0.60 + 0.12 * 2.3 + 0.08 * 2.3))


def test_the_cascade_of_genres(spark):
    rows = [(0, "rock", "nothing", 0.5), (1, "", "techno night", 0.5), (2, None, "nothing", 0.5), (3, "odd", "jazz & sax", 0.5)]
    df = spark.createDataFrame(rows, "track_idx long, style string, title string, energy double")
    got = {r.track_idx: r for r in G.resolve_genres(df, "style", clusters=2).collect()}
    assert (got[0].genre_primary, got[0].genre_source) == ("rock", "input_column") and got[0].genre_confidence >= 0.92
    assert (got[1].genre_primary, got[1].genre_source) == ("house_techno", "metadata_heuristic") and (got[3].genre_primary, got[3].mix_group) == ("jazz", "jazz")
    assert got[2].genre_source == "audio_heuristic" and got[2].genre_confidence <= 0.90
    for r in got.values():
        assert r.mix_group == (r.genre_primary if r.genre_confidence >= 0.55 else r.style_cluster) and (r.genre_primary == "unknown") == (r.genre_confidence < 0.55)
    done = spark.createDataFrame([(0, "c", "g", 0.9, "s", "m")], "track_idx long, style_cluster string, genre_primary string, genre_confidence double, genre_source string, mix_group string")
    assert G.ensure_genres(done) is done and G.ensure_genres(done.withColumn("mix_group", F.lit(None).cast("string"))) is not done


def test_clusters_hold_what_is_near(spark):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(0, 0.02, (20, 2)), rng.normal(1, 0.02, (20, 2))])
    df = spark.createDataFrame([(k, float(a), float(b)) for k, (a, b) in enumerate(x)], "track_idx long, energy double, danceability double")
    got = {r.track_idx: r.style_cluster for r in G.add_style_clusters(df, 2).collect()}
    assert len({got[k] for k in range(20)}) == len({got[k] for k in range(20, 40)}) == 1 and got[0] != got[20]
    again = {r.track_idx: r.style_cluster for r in G.add_style_clusters(df, 2).collect()}
    assert got == again and all(c.startswith("cluster_") for c in got.values())
    assert {r.style_cluster for r in G.add_style_clusters(df.limit(1)).collect()} == {"cluster_00"} and {r.style_cluster for r in G.add_style_clusters(df.select("track_idx")).collect()} == {"cluster_00"}


def test_lists_of_watch_metadata(spark):
    item = "struct<track:string,song:string,artist:string,artists:array<struct<name:string>>,start_time:double,start_time_ms:long,timestamp:string,time_text:string>"
    rows = [("v", [], [("Song A", None, "Artist A", None, 0.0, None, None, None), (None, "Song B", None, [("X",), ("Y",)], None, 185_000, None, None)], [("Song A", None, "Artist A", None, None, None, "0:00", None), ("Song C", None, None, None, None, None, None, "04:10"), ("no time", None, None, None, None, None, None, None)])]
    df = spark.createDataFrame(rows, f"video_id string, chapters array<struct<start_time:double,title:string>>, music_tracks array<{item}>, tracklist array<{item}>")
    got = [(r.position, r.timestamp, r.track_raw) for r in T.watch_lines(df).orderBy("position").collect()]
    assert got == [(1, "00:00", "Song A - Artist A"), (2, "03:05", "Song B - X, Y"), (3, "04:10", "Song C")]
    with_chapters = df.withColumn("chapters", F.expr("array(struct(10.0D as start_time, 'Own' as title))"))
    assert [r.track_raw for r in T.watch_lines(with_chapters).collect()] == ["Own"]


def test_greedy_matches_by_removal(spark):
    rng = np.random.default_rng(7)
    lines, chapters, want = [], [], []
    for v in range(25):
        a, b = sorted(rng.integers(0, 60, rng.integers(0, 6))), sorted(rng.integers(0, 60, rng.integers(0, 6)))
        lines += [(f"v{v}", k + 1, int(t)) for k, t in enumerate(a)]
        chapters += [(f"v{v}", k + 1, int(t)) for k, t in enumerate(b)]
        left = list(enumerate(b, 1))
        for k, t in enumerate(a):
            best = min(((abs(c - t), n) for n, c in left if abs(c - t) <= 5), default=None)
            pick = best[1] if best else k + 1 if len(a) == len(b) else None
            left = [x for x in left if x[0] != pick]
            want.append((f"v{v}", k + 1, pick))
    schema = "video_id string, position int, timestamp_s int"
    got = [tuple(r) for r in R.match_nearest(spark.createDataFrame(lines, schema), spark.createDataFrame(chapters, schema)).collect()]
    assert sorted(got) == sorted(want)


def test_time_codes_and_errors(spark):
    df = spark.createDataFrame([("01:02",), ("1:02:03",), (None,)], "t string")
    assert [r[0] for r in df.select(X.seconds(F.col("t"))).collect()] == [62, 3723, None]
    with pytest.raises(Exception, match="not a time code"):
        spark.createDataFrame([("abc",)], "t string").select(X.seconds(F.col("t"))).collect()
    strict = spark.createDataFrame([("61:00",), ("10:61",), ("59:59",), ("x",)], "t string").select(X.strict_seconds(F.col("t"))).collect()
    assert [r[0] for r in strict] == [None, None, 3599, None]


def test_prototypes_that_sql_holds_equal(spark, tmp_path):
    """The sums of two prototypes' differences may be one bit apart where exp makes them equal: the earlier counts, as in SQL."""
    rows = spark.createDataFrame([(25353, 20, 3908.82), (38055, 15, 5788.79)], "s_suppkey long, s_nationkey int, s_acctbal double")
    rows.coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    query, sql = scores.QUERIES["genre_prototype"]
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    got = sorted(tuple(r) for r in query(spark, str(tmp_path)).collect())
    assert got == sorted(con.execute(sql).fetchall()) and got[0][1] == "rock"
