"""Tours, searches, the pair model, sound features and streams against plain versions and literal cases."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelab.functions import features as X
from seguelab.operators import audio, graph, pairs, search
from seguelab.operators import model as M
from seguelab.sources import readers, writers
from seguelab.streaming import pairs as S
from test_caches import sound

# --- graphs ------------------------------------------------------------------


def plain_tour(edges, start=0):
    """Prim by exhaustion for the weight, Kruskal with sets for the order, recursion for the walk."""
    groups, near = [], {}
    for w, i, j in sorted(((w, i, j) for i, j, w in edges), key=lambda e: (-e[0], e[1], e[2])):
        a, b = (next((g for g in groups if x in g), {x}) for x in (i, j))
        if a is b or a == b:
            continue
        groups = [g for g in groups if g not in (a, b)] + [a | b]
        near.setdefault(i, []).append(j)
        near.setdefault(j, []).append(i)
    path = []

    def walk(v):
        path.append(v)
        for u in near.get(v, []):
            if u not in path:
                walk(u)

    walk(start)
    return path


def plain_two_opt(path, s, rounds=5):
    path = list(path)
    for _ in range(rounds):
        better = False
        for i in range(1, len(path) - 2):
            for j in range(i + 1, len(path) - 1):
                a, b, c, d = path[i - 1], path[i], path[j], path[j + 1]
                if s[a][c] + s[b][d] > s[a][b] + s[c][d]:
                    path[i : j + 1] = path[i : j + 1][::-1]
                    better = True
        if not better:
            break
    return path


def symmetric(n, seed, digits=1):
    rng = np.random.default_rng(seed)
    s = np.round(rng.random((n, n)), digits)
    s = (s + s.T) / 2
    np.fill_diagonal(s, 1.0)
    return s


def test_tours_of_several_pools(spark):
    rows, want = [], {}
    for pool, n in ((0, 14), (1, 9), (2, 3)):
        s = symmetric(n, pool)
        rows += [(pool, i, j, float(s[i, j])) for i in range(n) for j in range(n)]
        sparse = [(i, j, float(s[i, j])) for i in range(n) for j in sorted(range(n), key=lambda j: (-s[i, j], j))[:6] if i < j]
        tour = plain_tour(sparse)
        want[pool] = (tour, plain_two_opt(tour, s))
    edges = spark.createDataFrame(rows, "pool int, from_idx long, to_idx long, score double").repartition(3)
    w = [graph.sparsify(edges.filter(F.col("pool") == p).drop("pool"), 5).withColumn("pool", F.lit(p)) for p in want]
    tours = graph.tree_tours(w[0].union(w[1]).union(w[2]))
    better = graph.improved_tours(tours, edges)
    for df, k in ((tours, 0), (better, 1)):
        got = {}
        for r in df.orderBy("pool", "position").collect():
            got.setdefault(r.pool, []).append(r.track_idx)
        assert got == {p: t[k] for p, t in want.items()}


def test_nearest_by_blocks(spark):
    rng = np.random.default_rng(4)
    x = np.round(rng.standard_normal((70, 5)), 1)
    x[7] = x[3]
    x[9] = 0
    df = spark.createDataFrame([(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(None, [1.0] * 5), (99, None)], "vec_id long, embedding array<double>")
    u = x / np.where(np.linalg.norm(x, axis=1) == 0, 1, np.linalg.norm(x, axis=1))[:, None]
    s = np.round(u @ u.T, 12)
    want = {(i, j) for i in range(70) for j in sorted((j for j in range(70) if j != i), key=lambda j: (-s[i, j], j))[:4]}
    for size in (1 << 20, 600):
        assert {(r.from_idx, r.to_idx) for r in graph.cosine_top(df, 4, block_bytes=size).collect()} == want


def test_components_of_the_variance(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((40, 3)) @ np.array([[3, 1, 0.5], [0, 1, 0.2], [0, 0, 0.1]])
    df = spark.createDataFrame([(k, *map(float, r)) for k, r in enumerate(x)], "i int, a double, b double, c double")
    q = np.percentile(x, [25, 50, 75], axis=0)
    z = (x - q[1]) / (q[2] - q[0])
    z -= z.mean(axis=0)
    _, values, vectors = np.linalg.svd(z, full_matrices=False)
    kept = int(np.searchsorted(np.cumsum(values**2) / (values**2).sum(), 0.95) + 1)
    vectors = vectors[:kept] * np.sign(vectors[np.arange(kept), np.abs(vectors[:kept]).argmax(axis=1)])[:, None]
    got = np.array([r.components for r in X.principal_components(df, ["a", "b", "c"]).orderBy("i").collect()])
    assert got.shape == (40, kept) and got == pytest.approx(z @ vectors.T, abs=1e-6)


# --- search ------------------------------------------------------------------


def plain_beam(tracks, score, size, width, candidates, usage):
    """The search by whole matrices: all unused tracks are sorted at each step."""
    n = len(tracks)
    quality = [score[i].mean() + 0.75 * score[i].max() for i in range(n)]
    seed = lambda i: quality[i] + 0.05 / (1 + usage.get(tracks[i]["mix"], 0)) + (0.04 if tracks[i]["genre"] != "unknown" else 0)
    states = [(0.0, [i]) for i in sorted(range(n), key=lambda i: (seed(i), i), reverse=True)[: max(2 * width, 1)]]
    for _ in range(1, size):
        found = []
        for total, path in states:
            left = [j for j in np.argsort(-score[path[-1]], kind="stable") if j not in path][:candidates]
            for j in left:
                t = [tracks[k] for k in path]
                mixes, artists, genres = Counter(x["mix"] for x in t), Counter(x["artist"] for x in t if x["artist"]), frozenset(x["genre"] for x in t) - {"unknown"}
                found.append((total + search.step_gain(float(score[path[-1], j]), tracks[j], t[-1], mixes, artists, genres, len(path), size, usage), [*path, int(j)]))
        states = sorted(found, key=lambda s: -s[0])[:width]
    return states[0][1]


@pytest.mark.parametrize("size, lists", [(12, 1), (4, 3)])
def test_lists_against_the_plain_search(spark, size, lists):
    rng = np.random.default_rng(size)
    n = 12
    score = np.round(rng.random((n, n)), 2)
    np.fill_diagonal(score, 0)
    rows = [(i, f" Artist {i % 4}", "unused", f"g{i % 3}", f"g{i % 3}" if i % 2 else "Unknown", 0.9 if i % 5 else 0.2, "metadata") for i in range(n)]
    df = spark.createDataFrame(rows, "track_idx long, artist string, style_cluster string, mix_group string, genre_primary string, genre_confidence double, genre_source string")
    tracks = [{"artist": f"artist {i % 4}", "mix": f"g{i % 3}", "genre": f"g{i % 3}" if i % 2 and i % 5 else "unknown"} for i in range(n)]
    edges = spark.createDataFrame([(i, j, float(score[i, j])) for i in range(n) for j in range(n)], "from_idx long, to_idx long, score double")
    paths, _ = search.generate_lists(df, edges, size, lists, width=3, candidates=5)
    got = {}
    for r in paths.orderBy("playlist_name", "position").collect():
        got.setdefault(r.playlist_name, []).append(r.track_idx)
    left, usage = list(range(n)), Counter()
    for k in range(lists):
        path = plain_beam([tracks[i] for i in left], score[np.ix_(left, left)], size, 3, 5, usage)
        own = [left[i] for i in path]
        assert got[f"playlist_{k + 1:02d}"] == own
        usage.update(tracks[i]["mix"] for i in own)
        left = [i for i in left if i not in own]


@pytest.mark.parametrize("given", [{"size": 0}, {"size": 2, "width": 0}, {"size": 2, "candidates": 0}, {"size": 2, "lists": 0}, {"size": 9}, {"size": 3, "lists": 2}])
def test_impossible_lists_are_errors(spark, given):
    df = spark.createDataFrame([(i, "a", "c", "m", "g", 0.9, "s") for i in range(4)], "track_idx long, artist string, style_cluster string, mix_group string, genre_primary string, genre_confidence double, genre_source string")
    with pytest.raises(ValueError):
        search.generate_lists(df, None, **given)


def test_numbered_and_named_lists(spark):
    one = spark.createDataFrame([(0, "10"), (1, "2"), (2, "1")], "track_idx long, sort_order string")
    assert [r.track_idx for r in search.ordered_paths(one, "sort_order").orderBy("position").collect()] == [2, 1, 0]
    two = spark.createDataFrame([(0, 2, 2), (1, 1, 2), (2, 1, 1), (3, 2, 1)], "track_idx long, playlist_index int, position int")
    assert [(r.playlist_name, r.track_idx) for r in search.ordered_paths(two).orderBy("playlist_name", "position").collect()] == [("1", 2), ("1", 1), ("2", 3), ("2", 0)]
    with pytest.raises(ValueError):
        search.ordered_paths(two, "none")


def test_lines_for_a_terminal(spark):
    df = spark.createDataFrame([("p", 1, "A", "T", None, "start"), ("p", 2, " ", "U", 0.8234, "excellent"), ("p", 3, None, None, 0.1, "rough")], "playlist_name string, position int, artist string, title string, transition_score_from_previous double, transition_rating_from_previous string")
    assert [r.line for r in search.ordered_lines(df).orderBy("position").collect()] == ["  01. A - T [start]", "  02. U [excellent 0.823]", "  03. <unknown track> [rough 0.100]"]
    report = spark.createDataFrame([(0.9,), (0.5,)], "transition_score double")
    assert search.summary_line("x", report).first()[0] == "x: avg 0.700, min 0.500, strong-or-better 50% across 2 transitions."
    assert search.summary_line("x", report.limit(0)).first()[0].endswith("not enough tracks to rate transitions.")


# --- the pair model ----------------------------------------------------------


def labelled(spark, n=24):
    rng = random.Random(3)
    rows = [(f"v{k % 5}", "excellent", 100.0 + k, 101.0 + k + rng.random(), f"song {k}", f"song {k + 1}", "rock" if k % 2 else "pop", "rock" if k % 2 else "pop", "00:10" if k % 3 else None, "00:40") for k in range(n)]
    return spark.createDataFrame(rows, "video_id string, label string, from_tempo double, to_tempo double, from_resolved_title string, to_resolved_title string, from_genre_primary string, to_genre_primary string, from_lead_s string, to_lead_s string")


def test_negatives_come_from_other_videos(spark):
    pairs_ = labelled(spark).cache()
    for ratio, want in ((1.0, 24), (2.5, 60), (0.2, 5)):
        neg = M.negatives(pairs_, ratio).collect()
        assert len(neg) == want
        home = {(r.to_tempo): r.video_id for r in pairs_.collect()}
        assert all(home[r.to_tempo] != r.video_id for r in neg)
    alone = pairs_.filter("video_id = 'v0'")
    assert M.negatives(alone).count() == alone.count() and M.negatives(pairs_.limit(1)).count() == 0
    most = pairs_.withColumn("video_id", F.when(F.col("from_tempo") > 101, "hot").otherwise("rare"))  # nearly all rows of one video
    home = {r.to_tempo: r.video_id for r in most.collect()}
    assert all(home[r.to_tempo] != r.video_id for r in M.negatives(most, 3.0).collect())
    with pytest.raises(ValueError):
        M.training_set(pairs_.limit(0))
    with pytest.raises(ValueError):
        M.training_set(pairs_, 0.0)


def test_features_of_pairs(spark):
    p = labelled(spark)
    spec = M.infer_spec(p)
    assert spec.numeric == ["lead_s", "tempo"] and spec.text == ["genre_primary", "resolved_title"]
    row = M.pair_features(p, spec).first().asDict()
    assert (row["from_lead_s"], row["to_lead_s"], row["delta_lead_s"], row["mean_lead_s"]) == (0.0, 40.0, 40.0, 20.0)  # what is missing counts as 0
    assert (row["same_genre_primary"], row["from_len_resolved_title"], row["len_delta_resolved_title"]) == (1.0, 6.0, 0.0)


@pytest.mark.parametrize("kind", ["forest", "mlp"])
def test_models_score_and_come_back(spark, tmp_path, kind):
    model = M.train(labelled(spark), kind=kind, trees=12, epochs=25, ratio=1.5)
    pool = spark.createDataFrame([(0, 100.0, "song 1", "pop"), (1, 101.0, "song 2", "pop"), (2, 180.0, "x", "jazz")], "track_idx long, tempo double, title string, genre string")
    scores = {(r.from_idx, r.to_idx): r.score for r in model.score_pool(pool).collect()}
    assert len(scores) == 9 and all(0 <= s <= 1 for s in scores.values()) and all(scores[i, i] == 0 for i in range(3))
    assert scores[0, 1] > scores[0, 2]
    path = f"file://{tmp_path}/model"
    assert M.PairModel.load_if_exists(path) is None and M.PairModel.load_if_exists(None) is None
    model.save(path)
    again = {(r.from_idx, r.to_idx): r.score for r in M.PairModel.load_if_exists(path).score_pool(pool).collect()}
    assert again == pytest.approx(scores, abs=1e-6) and model.summary["positive"] == 24 and model.summary["negative"] == 36
    with pytest.raises(ValueError):
        M.train(labelled(spark), kind="tree")


def test_the_rarer_class_repeats(spark):
    rows = spark.range(300).select(F.when(F.col("id") < 70, 0.0).otherwise(1.0).alias(M.TARGET), F.col("id").cast("double").alias("x"))
    balance = {r[M.TARGET]: r["count"] for r in M.class_balance(M.repeated_minority(rows, {0.0: 70, 1.0: 230})).collect()}
    assert balance[1.0] == 230 and abs(balance[0.0] - 230) < 25


def test_a_models_score_is_one_more_component(spark):
    df = spark.createDataFrame([(0, 0.5, 0.4), (1, 0.7, 0.9)], "track_idx long, outro_energy double, intro_energy double")
    model = spark.createDataFrame([(0, 1, 1.0), (1, 0, 0.0)], "from_idx long, to_idx long, score double")
    plain = {(r.from_idx, r.to_idx): r.score for r in pairs.score_pairs(df, components=True).collect()}
    with_model = {(r.from_idx, r.to_idx): r.score for r in pairs.score_pairs(df, model=model, model_weight=0.3).collect()}
    whole = sum(pairs.WEIGHTS[k] for k in ("groove", "sentiment", "tonal"))
    assert with_model[0, 1] == pytest.approx((plain[0, 1] * whole + 0.3) / (whole + 0.3)) and with_model[1, 0] == pytest.approx(plain[1, 0] * whole / (whole + 0.3)) and with_model[0, 0] == 0
    with pytest.raises(ValueError):
        pairs.score_pairs(df, model_weight=-1)


# --- sound -------------------------------------------------------------------


def test_features_of_generated_sounds():
    low, high = (audio.extract(sound(p, 3.0), edge_seconds=1.0) for p in (220.0, 1760.0))
    assert low["spectral_centroid"] < high["spectral_centroid"] and low["key"] == high["key"]  # an A three octaves higher
    assert low["intro_leading_silence_s"] == pytest.approx(0.2, abs=0.3) and low["intro_seconds_used"] == pytest.approx(1.0)
    assert low["intro_attack_time_s"] < 0.3 and low["outro_release_time_s"] > 0.3
    assert set(low) == set(audio.COLUMNS) and all(np.isfinite(v) for v in low.values())
    plain = audio.extract(sound(), deep=False)
    assert np.isnan(plain["intro_beat_stability"]) and np.isfinite(plain["outro_abruptness"])
    with pytest.raises(ValueError):
        audio.extract(sound(seconds=0.0, quiet=0.0))


@pytest.mark.parametrize("key, mode", [(0, 1), (9, 0), (5, 1)])
def test_keys_of_their_own_profiles(key, mode):
    assert audio.estimate_key(X.key_profiles()[mode][key]) == (key, mode)


def test_a_folder_of_sounds(spark, tmp_path):
    for name, data in (("a.wav", sound()), ("a.m4a", b"x"), ("b.wav", b"broken"), ("c.wav.part", sound())):
        (tmp_path / name).write_bytes(data)
    out = {r.video_id: r for r in audio.analyse_directory(spark, str(tmp_path)).collect()}
    assert {k: r.status for k, r in out.items()} == {"a": "ok", "b": "failed"} and 0 <= out["a"].energy <= 1 and out["b"].energy is None
    known = spark.createDataFrame([("a", out["a"].analysis_signature), ("b", "other")], "video_id string, analysis_signature string")
    again = audio.analyse_directory(spark, str(tmp_path), known).filter("status is not null").collect()
    assert [r.video_id for r in again] == ["b"]


# --- streams -----------------------------------------------------------------


def run_stream(writer, tmp_path):
    query = writer.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/state").start()
    query.awaitTermination()


def test_upserts_over_a_stream(spark, tmp_path):
    schema, source, table = "k string, n int, v string", tmp_path / "in", f"{tmp_path}/table"
    read = lambda: spark.read.parquet(table) if (tmp_path / "table").exists() else None
    for rows in ([("a", 1, "old"), ("a", 2, "new"), ("b", 1, "b")], [("b", 5, "later"), ("c", 1, "c")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        run_stream(S.upsert_stream(stream, read, lambda df: df.write.mode("overwrite").parquet(table), ["k"], ["n"]), tmp_path)
    assert {(r.k, r.v) for r in spark.read.parquet(table).collect()} == {("a", "new"), ("b", "later"), ("c", "c")}


def test_bands_and_neighbours_of_a_stream(spark, tmp_path):
    schema = "user string, at timestamp, kind string, score double"
    rows = [("u", f"2024-01-01 00:0{k}:00", "abc"[k % 3], 0.9 if k % 2 else None) for k in range(6)] + [("w", "2024-01-01 00:00:30", "x", 0.4), ("u", "2024-01-02 00:00:00", "z", 0.1)]
    df = spark.createDataFrame(rows, "user string, at string, kind string, score double").withColumn("at", F.col("at").cast("timestamp"))
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run_stream(S.rating_counts(stream, "score", "at").writeStream.outputMode("append").format("memory").queryName("bands"), tmp_path / "a")
    assert {(r.band, r["count"]) for r in spark.table("bands").collect() if r.window.start.day == 1} == {("excellent", 3), ("start", 3), ("mixed", 1)}
    run_stream(S.transition_counts(stream, "user", "at", "kind").writeStream.outputMode("append").format("memory").queryName("steps"), tmp_path / "b")
    got = [(r.user, r.from_kind, r.to_kind, r.seconds) for r in spark.table("steps").collect()]
    assert sorted(got)[:5] == sorted([("u", "abc"[k % 3], "abc"[(k + 1) % 3], 60.0) for k in range(5)] + [("u", "c", "z", 86100.0)])[:5] and len(got) == 6


# --- sources and sinks -------------------------------------------------------


def test_settings_and_files(spark, tmp_path):
    assert readers.resource_settings("Background", 8, 8) == {"resource_profile": "background", "download_workers": 1, "analysis_workers": 1, "force_process_pool": True}
    assert readers.resource_settings("odd", 0, 3) == {"resource_profile": "default", "download_workers": 1, "analysis_workers": 3, "force_process_pool": False}
    lines = ["# head", "a\tb\tc\td\te\tf\tg", "a\tb\tc\td", "\te\tf\tg", "one\ttwo", "", "a\tb\tc\td"]
    kept, counts = readers.repaired_cookie_lines(spark.createDataFrame(list(enumerate(lines)), "n int, line string"))
    assert [r.line for r in kept.orderBy("n").collect()] == ["# head", "a\tb\tc\td\te\tf\tg", "a\tb\tc\td\te\tf\tg", ""] and counts.first().asDict() == {"repaired": 1, "dropped": 2}
    entries = spark.createDataFrame([(0, "a", " A "), (1, "", "x"), (2, "a", "again"), (3, "b", None)], "n int, id string, title string")
    assert [(r.video_id, r.video_title) for r in readers.list_videos(entries, 2).orderBy("video_id").collect()] == [("a", "A"), ("b", "")]
    (tmp_path / "x").mkdir()
    for n in ("a.wav", "b.wav", "c.part"):
        (tmp_path / n).write_text("12")
    plan = spark.createDataFrame([("a.wav", "featured"), ("b.wav", "keep"), ("c.part", "temp")], "name string, action string")
    assert writers.apply_cleanup(plan, str(tmp_path), dry_run=True) == 2 and writers.apply_cleanup(plan, str(tmp_path)) == 2
    assert sorted(p.name for p in tmp_path.iterdir()) == ["b.wav"]


def test_retries_and_the_error_log(tmp_path):
    import logging
    from datetime import datetime

    pauses, calls = [], []

    def call():
        calls.append(1)
        if len(calls) < 4:
            raise RuntimeError("HTTP Error 429: Too Many Requests")
        return "done"

    assert writers.with_retry(call, pause=pauses.append) == "done" and pauses == [2.0, 4.0, 8.0]
    assert writers.pause_seconds(9) == 30.0 and writers.pause_seconds(1, base=0) == 0
    with pytest.raises(KeyError):
        writers.with_retry(lambda: {}["x"], pause=pauses.append)
    log, name = writers.ErrorLog(), logging.getLogger("seguelab.test")
    name.addHandler(log)
    name.info("no"), name.warning("first"), name.error("second %s", 2)
    path = writers.error_log_path(str(tmp_path / "out.csv"), datetime(2024, 1, 2, 3, 4, 5))
    assert path.endswith("out_errors_20240102_030405.log") and writers.report_path("a/out.csv") == "a/out_transition_report.csv"
    log.write(path, datetime(2024, 1, 2), datetime(2024, 1, 3), failed=False)
    text = open(path, encoding="utf-8").read()
    assert "run_status=success" in text and "captured_entries=2" in text and text.count(" | seguelab.test | ") == 2 and (log.count("WARNING"), log.count("ERROR", "CRITICAL")) == (1, 1)


def test_the_summary_as_text(spark):
    from seguelab.operators import tracklists as T

    row = spark.createDataFrame([(2, 1, 4, 3, 1, 8, 7, 0, 1, 6, 6, 1, 3, 2)], "channels_scanned int, channels_failed int, videos_scanned int, videos_with_tracklist int, videos_skipped int, tracks_parsed int, tracks_resolved int, tracks_unresolved int, tracks_unavailable int, tracks_analyzed int, tracks_with_features int, tracks_analysis_failed int, positive_pairs int, pairs_skipped int")
    text = T.summary_text(row, "o.csv", "e.log").first()[0].split("\n")
    assert text[0] == "Training Scrape Report" and text[3] == "- Sources: channels_scanned=2 channels_failed=1 (50.0%)"
    assert "kept_rate=60.0%" in text[7] and text[8] == "- Logged issues: warnings=0 errors=0" and "unavailable=1 (12.5%)" in text[5]
