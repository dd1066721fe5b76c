"""The list queries order their pools whole."""

from collections import Counter

import duckdb

from seguelab.operators import blocks
from seguelab.plans import lists

NATIONS = {i: i * i % 3 for i in range(11)}


def test_lists_hold_the_whole_pool(spark, monkeypatch):
    rows = [(i, n, f"artist {i % 4}", "a" if i % 2 else "b", "rock", "rock", 0.95, "metadata", "") for i, n in NATIONS.items()]
    tracks = spark.createDataFrame(rows, "track_idx long, s_nationkey int, artist string, tags string, genre_primary string, mix_group string, genre_confidence double, genre_source string, style_cluster string").cache()
    edges = spark.createDataFrame([(i, j, 0.0 if i == j else (i * 7 + j * 3) % 10 / 10) for i in NATIONS for j in NATIONS], "from_idx long, to_idx long, score double").cache()
    monkeypatch.setattr(lists, "pool", lambda *_: tracks)
    monkeypatch.setattr(lists, "_edges", lambda *_: edges)
    own = lists.beam_by_nation(spark, "").collect()
    size = Counter(NATIONS.values())
    assert sorted(r.track_idx for r in own) == list(range(11)) and all(NATIONS[r.track_idx] == r.pool for r in own)
    assert {(r.pool, r.position) for r in own} == {(n, k) for n, c in size.items() for k in range(1, c + 1)}
    path = lists.beam_playlist(spark, "").collect()
    assert sorted(r.track_idx for r in path) == list(range(11)) and sorted(r.position for r in path) == list(range(1, 12))
    several = lists.multi_playlist(spark, "").collect()
    assert set(Counter(r.playlist_name for r in several).values()) == {3} and len({r.track_idx for r in several}) == 9


def test_the_quality_of_lists_takes_their_steps_alone(spark, monkeypatch, tmp_path):
    """As in SQL, without a look at all pairs."""
    monkeypatch.setattr(blocks, "meet", None)
    rows = [(i, i % 2, float(i * 37 % 11)) for i in range(7)]
    spark.createDataFrame(rows, "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    query, sql = lists.QUERIES["quality_summary"]
    con = duckdb.connect()
    con.execute(f"create view supplier as select * from '{tmp_path}/supplier.parquet/*.parquet'")
    want = con.execute(sql).fetchall()
    assert [tuple(r) for r in query(spark, str(tmp_path)).collect()] == want and want[0][0] > 0
