"""Blocks of all pairs against the table of all pairs."""

import pytest
from pyspark.sql import functions as F

from seguelab.operators import blocks, graph, pairs
from seguelab.operators import search as L
from seguelab.plans import scores
from seguelab.plans.pool import pool

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tracks(spark):
    return pool(spark, "/root/testdata/sf0.01").filter("track_idx < 45").cache()


@pytest.fixture
def small(monkeypatch):
    """Several blocks on both sides, and several tiles in each."""
    monkeypatch.setattr(blocks, "BLOCK_BYTES", 5000)
    monkeypatch.setattr(blocks, "_LEFT_ROWS", 3)
    monkeypatch.setattr(blocks, "_RIGHT_ROWS", 4)


def plan(df):
    return df._jdf.queryExecution().toString()


def rows(df):
    return sorted(tuple(round(v, 8) if isinstance(v, float) else v for v in r) for r in df.collect())


def test_best_edges_of_blocks(tracks, small):
    edges = pairs.score_pairs(tracks).withColumn("score", F.round("score", 9))
    assert rows(pairs.pool_scores(tracks).top(6)) == rows(pairs.top_edges(edges, 6))


def test_top_edges_make_no_table_of_pairs(spark):
    assert "NestedLoop" not in plan(scores.top_edges(spark, SF)) and "CartesianProduct" not in plan(scores.top_edges(spark, SF))


def test_quality_of_blocks(spark, tracks, small):
    assert rows(pairs.pool_scores(tracks, digits=None).quality()) == rows(L.outgoing_quality(pairs.score_pairs(tracks)))
    assert "NestedLoop" not in plan(scores.outgoing_quality(spark, SF))


def test_all_pairs_are_spread_over_the_cores(spark):
    slim = spark.range(4000).coalesce(1)
    assert pairs.cross(slim).rdd.getNumPartitions() > 1 and pairs.cross(slim.filter("id < 9")).count() == 81


def test_rounding_by_numbers_is_rounding_by_texts(spark):
    x = F.col("id") / 200000
    df = spark.range(400001).select((x / 2).alias("x"), F.rand(7).alias("y"))
    assert df.filter((pairs.rounded(F.col("x"), 6) != F.round("x", 6)) | (pairs.rounded(F.col("y"), 6) != F.round("y", 6)) | (pairs.rounded(F.col("y"), 9) != F.round("y", 9))).isEmpty()


def test_a_pool_is_looked_at_once_for_a_list(tracks, small, monkeypatch):
    made, met, meet = pairs.pool_scores(tracks), [], blocks.meet
    monkeypatch.setattr(blocks, "meet", lambda *a: met.append(1) or meet(*a))
    L.generate_lists(tracks, made, 45, width=3, candidates=3)
    assert met == [1]
    found = made.leaders(6).select("from_idx", F.posexplode("best").alias("k", "b"), "quality").cache()
    assert rows(found.select("from_idx", "b.to", (-F.col("b.minus")).alias("score"))) == rows(made.top(6).select("from_idx", "to_idx", "score"))
    assert rows(found.select("from_idx", F.round("quality", 9)).distinct()) == rows(made.quality().select("from_idx", F.round("quality", 9)))


def paths_of(spark, tracks):
    """Two lists, one of which repeats tracks, also of the other."""
    ids = sorted(r[0] for r in tracks.select("track_idx").collect())
    made = [("a", k + 1, i) for k, i in enumerate(ids[::2])] + [("b", k + 1, i) for k, i in enumerate([*ids[1::2], *ids[3:14], ids[4], ids[4]])]
    return spark.createDataFrame(made, "playlist_name string, position int, track_idx long")


def test_report_of_blocks(spark, tracks, small):
    paths = paths_of(spark, tracks)
    edges = pairs.score_pairs(tracks).withColumn("score", F.round("score", 9))
    assert rows(L.report_steps(paths, pairs.pool_scores(tracks))) == rows(L.report_steps(paths, edges))


def test_step_scores_need_their_steps_alone(spark, tracks):
    paths = paths_of(spark, tracks)
    edges = pairs.score_pairs(tracks).withColumn("score", F.round("score", 9))
    made = L.step_scores(paths, pairs.pool_scores(tracks))
    assert rows(made.na.fill(-1.0)) == rows(L.step_scores(paths, edges).na.fill(-1.0)) and "NestedLoop" not in plan(made)


@pytest.mark.parametrize("near", [2, 256])
def test_lists_of_a_single_pool_by_scores(tracks, small, monkeypatch, near):
    """``near`` of 2: the search outlives the edges that it has at hand."""
    monkeypatch.setattr(L, "NEAR", near)
    edges = pairs.score_pairs(tracks).withColumn("score", F.round("score", 9))
    n = tracks.count()
    for size, lists in ((n, 1), (n // 3, 3)):
        mine, theirs = (L.generate_lists(tracks, e, size, lists, width=3, candidates=3)[0] for e in (pairs.pool_scores(tracks), edges))
        assert rows(mine) == rows(theirs)


def test_lists_of_several_pools_by_scores(tracks, small, monkeypatch):
    monkeypatch.setattr(L, "NEAR", 4)
    own = tracks.select((F.col("track_idx") % 3).cast("int").alias("pool"), "track_idx", "artist", F.col("tags").alias("mix"), F.lit("unknown").alias("genre"))
    edges = pairs.score_pairs(tracks).withColumn("score", F.round("score", 9)).withColumn("pool", (F.col("from_idx") % 3).cast("int")).filter("from_idx % 3 = to_idx % 3")
    assert rows(L.beam_lists(own, pairs.pool_scores(tracks), None, candidates=4)) == rows(L.beam_lists(own, edges, None, candidates=4))


def blend_case(spark, n=40):
    import numpy as np

    rng = np.random.default_rng(3)
    v = rng.random((n, 6))
    v[5] = v[9] = v[11]
    v[7] = 0
    made = [(i * 3, int(rng.integers(12)), int(rng.integers(2)), [float(x) for x in v[i]]) for i in range(n)]
    return spark.createDataFrame(made, "track_idx long, key int, mode int, vector array<double>").cache()


def test_blended_pairs_and_their_nearest(spark, small):
    tracks = blend_case(spark)
    whole = graph.blend(graph.cosine_pairs(tracks, "track_idx", "vector"), graph.key_pairs(tracks))
    made = graph.blended_pairs(tracks)
    assert rows(made) == rows(whole) and "SortMergeJoin" not in plan(made)
    edges = whole.withColumn("score", F.round("score", 9))
    units = graph.blended_rows(tracks)
    assert rows(graph.blended_top(units, 5)) == rows(graph.sparsify(edges, 5))
    tours = graph.tree_tours(graph.sparsify(edges, 5)).cache()
    assert rows(graph.improved_blended(tours, units)) == rows(graph.improved_tours(tours, edges))
