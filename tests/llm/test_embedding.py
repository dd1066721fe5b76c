"""Groups and numbers of links of embeddings against brute force."""

import numpy as np
import pytest

from seguelab.llm import embedding

SCHEMA = "vec_id long, embedding array<float>"


def brute(entries, threshold):
    """entries: {(id, vector)}; rows (id, least id of the group, links)."""
    entries = list(entries)
    x = np.array([v for _, v in entries], np.float32).astype(float)
    u = x / np.sqrt((x * x).sum(axis=1))[:, None]
    near = (u[:, None] * u[None]).sum(axis=2) >= threshold
    np.fill_diagonal(near, False)
    root = list(range(len(entries)))
    for _ in entries:
        root = [min([root[i], *(root[j] for j in np.flatnonzero(near[i]))]) for i in range(len(entries))]
    least = {r: min(entries[i][0] for i in range(len(entries)) if root[i] == r) for r in set(root)}
    return sorted((entries[i][0], least[root[i]], int(near[i].sum())) for i in range(len(entries)))


def clustered(n, groups, noise, seed):
    rng = np.random.default_rng(seed)
    centers = rng.standard_normal((groups, 64))
    return centers[rng.integers(0, groups, n)] + noise * rng.standard_normal((n, 64))


def rows_of(x):
    return [(k, [float(v) for v in r]) for k, r in enumerate(x.astype(np.float32))]


def got(df, *args, **kwargs):
    return sorted(tuple(r) for r in embedding.near_duplicates(df, *args, **kwargs).select("vec_id", "class_id", "n_links").collect())


@pytest.mark.parametrize("n, groups, noise, threshold, part", [(300, 40, 0.2, 0.95, 32_768), (300, 6, 0.22, 0.95, 32), (120, 12, 0.03, 0.999, 8)])
def test_groups_against_brute_force(spark, n, groups, noise, threshold, part):
    rows = rows_of(clustered(n, groups, noise, n + groups))
    want = brute({(i, tuple(v)) for i, v in rows}, threshold)
    assert any(k for _, _, k in want)
    assert got(spark.createDataFrame(rows, SCHEMA), threshold, part_rows=part) == want


def test_copies_ties_and_repeated_ids(spark):
    a, b, c = np.eye(64)[0], np.eye(64)[1], 0.6 * np.eye(64)[0] + 0.8 * np.eye(64)[1]
    rows = [(5, a), (3, 2 * a), (3, 2 * a), (9, a), (9, b), (7, c), (8, np.eye(64)[2])]
    rows = [(i, [float(x) for x in np.asarray(v, np.float32)]) for i, v in rows]
    want = brute({(i, tuple(v)) for i, v in rows}, 0.95)
    assert got(spark.createDataFrame(rows, SCHEMA)) == want
    assert (5, 3, 2) in want and sum(i == 9 for i, _, _ in want) == 2


def test_ties_at_the_threshold(spark):
    exact = [(k, [float(x) for x in np.eye(4)[k] + np.eye(4)[3]]) for k in range(4)]  # cosines of 1/2 and sqrt(1/2), at the threshold
    half = brute({(i, tuple(v)) for i, v in exact}, 0.5)
    assert got(spark.createDataFrame(exact, SCHEMA), 0.5) == half


def test_a_third_of_all_rows_are_copies(spark):
    x = clustered(90, 90, 0.0, 8)
    rows = rows_of(np.concatenate([x, np.repeat(x[:1], 45, axis=0)]))
    want = brute({(i, tuple(v)) for i, v in rows}, 0.95)
    assert got(spark.createDataFrame(rows, SCHEMA), part_rows=16) == want and any(i == 0 and k >= 45 for i, _, k in want)


def test_what_is_left_out(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0] * 64), (2, [1.0] * 64), (None, [1.0] * 64), (3, None), (4, []), (5, [0.0] * 64), (6, [nan] + [1.0] * 63), (7, [inf] + [1.0] * 63), (8, [None] + [1.0] * 63), (9, [1.0] * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert got(df) == [(1, 1, 1), (2, 1, 1)]
    assert got(df.filter("vec_id = 3")) == [] and got(df.limit(0)) == []


def test_text_ids_and_clashing_columns(spark):
    rows = [("u-2", [1.0] * 8), ("u-1", [1.0] * 8), ("v", [1.0, -1.0] * 4)]
    df = spark.createDataFrame(rows, "vec_id string, embedding array<double>").selectExpr("*", "1 as node", "2 as key", "3 as class_id", "4 as id", "5 as vector")
    assert got(df) == [("u-1", "u-1", 1), ("u-2", "u-1", 1), ("v", "v", 0)]


@pytest.mark.parametrize("part", [32, 32_768])
def test_a_low_threshold_meets_all_pairs_without_cells(spark, monkeypatch, part):
    def fail(*_):
        raise AssertionError("cells of a threshold that prunes little")

    assert embedding.found_share(64, 8, 2 - 2 * 0.95) < embedding.MOST_FOUND < embedding.found_share(64, 8, 2 - 2 * 0.42)
    monkeypatch.setattr(embedding, "_spread", fail)
    rows = rows_of(clustered(300, 250, 0.4, 4))
    rows += [(300 + k, v) for k, (_, v) in enumerate(rows[:5])]
    want = brute({(i, tuple(v)) for i, v in rows}, 0.42)
    assert any(k for _, _, k in want) and any(not k for _, _, k in want)
    assert got(spark.createDataFrame(rows, SCHEMA), 0.42, part_rows=part) == want
