"""The weak-label classifier against plain versions of its parts and of the whole, and against held-out labels."""

import math

import numpy as np
import pyarrow as pa
import pytest

from seguelab.llm import classifier as C
from seguelab.llm.common import text_slices

DOCS = "doc_id long, text string"
SF = "/root/testdata/sf0.01"


def plain_em(rows, rounds=200):
    """rows: one vote pattern for each document; the probability of good of each."""
    k = len(rows[0])
    good, bad, prior = [[0.2, 0.75, 0.05] for _ in range(k)], [[0.2, 0.4, 0.4] for _ in range(k)], 0.8
    p = [prior] * len(rows)
    for _ in range(rounds):
        after = []
        for r in rows:
            a, b = math.log(prior), math.log(1 - prior)
            for j, v in enumerate(r):
                a, b = a + math.log(good[j][v]), b + math.log(bad[j][v])
            after.append(1 / (1 + math.exp(b - a)))
        done, p = max(abs(x - y) for x, y in zip(after, p, strict=True)) < 1e-9, after
        if done:
            break
        prior = min(max(sum(p) / len(p), 1e-6), 1 - 1e-6)
        for j in range(k):
            for table, w in ((good, p), (bad, [1 - x for x in p])):
                n = [sum(x for x, r in zip(w, rows, strict=True) if r[j] == v) / len(rows) + 1e-6 for v in range(3)]
                table[j] = [x / sum(n) for x in n]
    return p


def test_expectation_maximisation():
    rng = np.random.default_rng(1)
    truth = rng.random(400) < 0.75
    rows = np.array([[0 if rng.random() < 0.2 else (1 if (t if rng.random() < 0.85 - 0.05 * j else not t) else 2) for j in range(5)] for t in truth])
    patterns, place, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
    got = C.estimate(patterns, counts.astype(float))[0][place.ravel()]
    assert got == pytest.approx(plain_em(rows.tolist()), abs=1e-5)
    assert ((got > 0.5) == truth).mean() > 0.85


def test_logistic_fit():
    rng = np.random.default_rng(2)
    docs = [{int(x): 0.2 for x in rng.integers(0, 6, 3)} for _ in range(30)]
    target = rng.random(30)
    row, place, value = (np.array(x) for x in zip(*((i, k, v) for i, d in enumerate(docs) for k, v in d.items()), strict=True))
    w, b = C.fit(row, place, value.astype(float), target, rounds=40)
    plain, m, v = [0.0] * 7, [0.0] * 7, [0.0] * 7
    for t in range(1, 41):
        g = [1e-5 * x for x in plain]
        for d, y in zip(docs, target, strict=True):
            e = 1 / (1 + math.exp(-(sum(plain[k] * x for k, x in d.items()) + plain[6]))) - y
            for k, x in d.items():
                g[k] += e * x / 30
            g[6] += e / 30
        for k in range(7):
            m[k], v[k] = 0.9 * m[k] + 0.1 * g[k], 0.999 * v[k] + 0.001 * g[k] ** 2
            plain[k] -= 0.3 * (m[k] / (1 - 0.9**t)) / (math.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    assert w[:6] == pytest.approx(plain[:6], abs=1e-4) and b == pytest.approx(plain[6], abs=1e-4)


def whole(texts):
    """(score, keep, toxicity, toxic) of each text without Spark: all documents vote and train."""
    slices = [(buf, off) for _, _, buf, off in text_slices(pa.array(texts))]
    votes = np.concatenate([C.votes(*s)[0] for s in slices])
    toxic = np.concatenate([C.toxic_votes(*s) for s in slices])
    n = np.concatenate([C.votes(*s)[1] for s in slices])

    def model(votes, features, target_of):
        voted = np.flatnonzero((votes > 0).any(axis=1))
        target = target_of(np.array(plain_em(votes[voted].tolist())))
        table = [{k: x for k, x in features[i]} for i in voted]
        row, place, value = (np.array(x) for x in zip(*((i, k, x) for i, d in enumerate(table) for k, x in d.items()), strict=True))
        return C.fit(row, place, value.astype(float), target)

    shares, roots = [], []
    for buf, off in slices:
        f, first = C.features(buf, off)
        for i in range(len(off) - 1):
            part = f[first[i] : first[i + 1]].ravel()
            k, c = np.unique(part, return_counts=True)
            shares.append(list(zip(k.tolist(), (c / max(first[i + 1] - first[i], 1)).tolist(), strict=True)))
        r, p, v = C.word_roots(buf, off)
        roots += [list(zip(p[r == i].tolist(), v[r == i].tolist(), strict=True)) for i in range(len(off) - 1)]
    w, b = model(votes, shares, lambda p: p)
    u, c = model(toxic, roots, lambda p: 1 - p)
    sigmoid = lambda z: 1 / (1 + math.exp(-z))
    out = []
    for i in range(len(texts)):
        good = sigmoid(sum(w[k] * x for k, x in shares[i]) + b) if n[i] else 0.0
        bad = sigmoid(sum(u[k] * x for k, x in roots[i]) + c) if n[i] else 0.0
        out.append((good, good >= 0.5 and bad < 0.5, bad, bad >= 0.5))
    return out


def test_the_whole_on_a_small_table(spark):
    rng = np.random.default_rng(3)
    fill = "the river and a field of barley in the morning with some people on the road to that town as it was for years".split()
    texts = [" ".join(rng.permutation(fill * 3)) + "." for _ in range(40)]
    texts += ["#### $$$ %% AA BB CC " * 5 + " ".join(rng.permutation(fill)) for _ in range(8)]
    texts += [" ".join(rng.permutation([*fill * 2, "idiot", "scum", "moron", "trash"])) for _ in range(8)]
    texts += ["", None, " \n"]
    got = C.classify(spark.createDataFrame([(k, t) for k, t in enumerate(texts)], DOCS).repartition(3)).orderBy("doc_id").collect()
    want = whole(texts)
    for r, (good, keep, bad, toxic) in zip(got, want, strict=True):
        assert r.score == pytest.approx(good, abs=2e-3) and r.toxicity == pytest.approx(bad, abs=2e-3)
        if abs(good - 0.5) > 0.01 and abs(bad - 0.5) > 0.01:
            assert (r.keep, r.toxic) == (keep, toxic)
    assert sum(r.toxic for r in got) == 8 and not any(r.keep for r in got[40:48])


def test_held_out_labels(spark):
    """No label has a part in the training: all of them are held out."""
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rows = C.classify(docs).join(labels, "doc_id").collect()
    bad, fine = [r for r in rows if r.quality == 0], [r for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(rows) > 300 and np.mean([not r.keep for r in bad]) > 0.95 and np.mean([r.keep for r in fine]) > 0.95


def test_odd_tables(spark):
    rows = [("u-1", "The town on the river is as old as the road to it."), ("u-1", "LOUD #### $$$$ %%%%"), ("u-2", "x " * 60_000), (None, "a"), ("u-3", "")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as id", "2 as pattern", "3 as score", "true as toxic")
    first, again = (sorted((r.doc_id or "", r.score, r.toxicity) for r in C.classify(df).collect()) for _ in range(2))
    assert first == again and len(first) == 5 and [r[0] for r in first] == ["", "u-1", "u-1", "u-2", "u-3"]
    blank = spark.createDataFrame([(1, None), (2, "  ")], DOCS)
    assert all(r.score == 0 and not r.keep for r in C.classify(blank).collect())
