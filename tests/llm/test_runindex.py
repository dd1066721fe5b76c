"""Repeated passages and the run-length index against brute force."""

import numpy as np
import pytest

from seguelab.llm import runindex

DOCS = "doc_id long, text string"


def brute_spans(texts, least=50):
    """texts: {id: words}; (id, start, end) of the runs of words of passages that another text has."""
    out = set()
    for i, a in texts.items():
        mark = [False] * len(a)
        others = {tuple(b[k : k + least]) for j, b in texts.items() if j != i for k in range(len(b) - least + 1)}
        for k in range(len(a) - least + 1):
            if tuple(a[k : k + least]) in others:
                mark[k : k + least] = [True] * least
        k = 0
        while k < len(a):
            e = k
            while e < len(a) and mark[e]:
                e += 1
            if e > k:
                out.add((i, k, e))
            k = max(e, k + 1)
    return out


def plain_statistics(sequences, owner):
    """For each place of each sequence the longest match with a sequence of another owner."""
    out = []
    for s, o in zip(sequences, owner, strict=True):
        for i in range(len(s)):
            best = 0
            for t, p in zip(sequences, owner, strict=True):
                if p != o:
                    for j in range(len(t)):
                        k = 0
                        while i + k < len(s) and j + k < len(t) and s[i + k] == t[j + k]:
                            k += 1
                        best = max(best, k)
            out.append(best)
        out.append(0)
    return out


@pytest.mark.parametrize("seed, letters, owners", [(1, 2, 3), (2, 4, 6), (3, 3, 2), (4, 1, 3), (5, 30, 12)])
@pytest.mark.parametrize("least", [1, 4])
def test_statistics_streamed_from_the_runs(seed, letters, owners, least):
    rng = np.random.default_rng(seed)
    sequences = [list(rng.integers(0, letters, rng.integers(1, 15))) for _ in range(12)]
    sequences += [list(s) for s in sequences[:4]]
    owner = rng.integers(0, owners, len(sequences))
    index = runindex.RunIndex(np.concatenate(sequences).astype(np.uint32), np.array([len(s) for s in sequences]))
    want = [v if v >= least else 0 for v in plain_statistics(sequences, owner)]
    assert index.matching_statistics(owner, least).tolist() == want


def test_runs_are_those_of_the_transform():
    rng = np.random.default_rng(8)
    base = list(rng.integers(0, 50, 40))
    sequences = [base[k % 3 :] for k in range(40)]
    index = runindex.RunIndex(np.concatenate(sequences).astype(np.uint32), np.array([len(s) for s in sequences]))
    symbol = index.symbol
    order = sorted(range(index.n), key=lambda i: (symbol[i : index.stop[i] + 1].tolist(), i))
    last = [int(symbol[i - 1]) if i else 0 for i in order]
    starts = [k for k in range(index.n) if k == 0 or last[k] != last[k - 1] or last[k] == 0]
    assert index.starts.tolist() == starts and index.symbols.tolist() == [last[k] for k in starts]
    assert len(starts) < index.n / 8  # the index is as small as the collection is repetitive
    places = np.arange(index.n)
    before, after = dict(zip(order[1:], order[:-1], strict=True)), dict(zip(order[:-1], order[1:], strict=True))
    assert index.preceding(places)[0].tolist() == [before.get(i, -1) for i in places] and index.following(places)[0].tolist() == [after.get(i, -1) for i in places]


def collection(seed):
    rng = np.random.default_rng(seed)
    fresh = lambda n: [f"t{x}" for x in rng.integers(0, 10**9, n)]
    shared, licence = fresh(70), fresh(60)
    texts = {1: fresh(30) + shared + fresh(20), 2: shared + fresh(40), 3: fresh(90), 4: fresh(10) + shared[5:58] + fresh(9), 5: shared[:49], 6: fresh(60)}
    texts[7] = list(texts[6])
    texts |= {k: fresh(5) + licence + fresh(k % 7) + licence[k % 5 :] + fresh(3) for k in range(10, 30)}  # a third and more of the texts, some with it twice
    texts[31] = shared + shared + fresh(3)
    texts[32] = ["same"] * 150
    return texts


@pytest.mark.parametrize("places", [runindex.ANCHOR_PLACES, 3])
def test_repeated_passages_against_brute_force(spark, places):
    texts = collection(3)
    rows = [(i, " ".join(w).upper() if i == 2 else ", ".join(w)) for i, w in texts.items()] + [(8, None), (9, ""), (None, " ".join(texts[1])), (1, ", ".join(texts[1]))]
    df = spark.createDataFrame(rows, DOCS).selectExpr("*", "1 as same", "2 as id", "3 as hot").repartition(3)
    got = {(r.doc_id, r.start_word, r.end_word) for r in runindex.repeated_passages(df, anchor_places=places).collect()}
    assert got == brute_spans(texts)


def test_ids_of_several_texts_and_of_text(spark):
    rng = np.random.default_rng(4)
    a, b = ([f"t{x}" for x in rng.integers(0, 10**9, 80)] for _ in range(2))
    rows = [("u-1", " ".join(a)), ("u-1", " ".join(["x", *a])), ("u-2", " ".join(b)), ("u-3", " ".join(b))]
    got = {tuple(r)[:3] for r in runindex.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {("u-1", 0, 80), ("u-1", 1, 81), ("u-2", 0, 80), ("u-3", 0, 80)}
    assert runindex.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string").limit(0)).count() == 0


def test_a_very_long_text(spark):
    words = [f"w{k * k % 100_003}x{k % 7}" for k in range(120_000)]
    rows = [(1, " ".join(words)), (2, " ".join(["a", *words[70_000:70_060], "b"]))]
    got = {tuple(r)[:3] for r in runindex.repeated_passages(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {(1, 70_000, 70_060), (2, 1, 61)}
