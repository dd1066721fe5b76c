"""Near duplicates against brute force over all pairs: exact Jaccard, and the sketches' own estimates."""

import numpy as np
import pyarrow as pa
import pytest

from seguelab.llm import minhash
from seguelab.llm.common import text_slices, words

DOCS = "doc_id long, text string"


def shingle_set(text, size=3):
    w = text.lower().split()
    return {tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def groups(ids, linked):
    """{id: least id of its group}."""
    root = {i: i for i in ids}
    moved = True
    while moved:
        moved = False
        for a, b in linked:
            low = min(root[a], root[b])
            for x in (a, b):
                if root[x] != low:
                    root[x], moved = low, True
    return root


def corpus(seed, bases, copies, changed):
    """Texts of 120 words over a large vocabulary, with copies of which a share of the words is changed."""
    rng = np.random.default_rng(seed)
    texts = []
    for _ in range(bases):
        base = [f"w{x}" for x in rng.integers(0, 5000, 120)]
        for _ in range(copies):
            new = list(base)
            for k in rng.choice(120, int(120 * changed * rng.random()), replace=False):
                new[k] = f"v{rng.integers(0, 10**9)}"
            texts.append(" ".join(new))
    return texts


def by_sketches(texts, threshold):
    """Groups by all pairs that share a band and whose sketches stand for the threshold."""
    sig, sketch = [], []
    for lo, hi, buf, off in text_slices(pa.array(texts)):
        h, _, _, first = words(buf, off)
        g, at = minhash.shingles(h, first, minhash.SHINGLE)
        sig.append(minhash.signatures(g, at))
    sig = np.concatenate(sig)
    sketch, bands = minhash.odd_sketches(sig), minhash.band_keys(sig)
    linked = []
    for i in range(len(texts)):
        for j in range(i):
            bits = sum(bin(int(a) ^ int(b)).count("1") for a, b in zip(sketch[i], sketch[j], strict=True))
            if (bands[i] == bands[j]).any() and float(minhash.similarity(np.array(bits))) >= threshold:
                linked.append((i, j))
    return groups(range(len(texts)), linked)


def found(df, **kwargs):
    return {r.doc_id: r.kept_id for r in minhash.near_duplicates(df, **kwargs).collect()}


@pytest.mark.parametrize("seed, bases, copies, changed, threshold, part", [(1, 25, 4, 0.35, 0.5, 4096), (2, 3, 25, 0.5, 0.75, 3)])
def test_all_pairs_of_sketches(spark, seed, bases, copies, changed, threshold, part):
    texts = corpus(seed, bases, copies, changed)
    want = {i: r for i, r in by_sketches(texts, threshold).items() if r != i}
    assert want and found(spark.createDataFrame(list(enumerate(texts)), DOCS), threshold=threshold, part_rows=part) == want


def test_exact_jaccard(spark):
    """Near copies are found, and nothing that shares little; in between the estimate decides."""
    texts = corpus(3, 40, 2, 0.12) + corpus(4, 40, 1, 0.0)
    sets = [shingle_set(t) for t in texts]
    got = found(spark.createDataFrame(list(enumerate(texts)), DOCS))
    near = [(i, j) for i in range(len(texts)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.7]
    far = [(i, j) for i, j in got.items() if jaccard(sets[i], sets[j]) < 0.3]
    assert near and not far and all(got.get(i, i) == got.get(j, j) for i, j in near)


def test_sketches_estimate_high_similarities():
    rng = np.random.default_rng(5)
    error = []
    for same in (100, 110, 120, 126):
        a = rng.integers(0, 2**32, (300, minhash.SAMPLES), dtype=np.uint64).astype(np.uint32)
        b = a.copy()
        b[:, same:] = rng.integers(0, 2**32, (300, minhash.SAMPLES - same), dtype=np.uint64).astype(np.uint32)
        bits = np.bitwise_count(minhash.odd_sketches(a) ^ minhash.odd_sketches(b)).sum(axis=1)
        error.append(np.abs(minhash.similarity(bits) - same / minhash.SAMPLES).mean())
    assert error == sorted(error, reverse=True) and error[-1] < 0.01 and error[0] < 0.05


def test_a_third_of_all_are_copies(spark):
    texts = corpus(6, 30, 1, 0.0)
    rows = [(100 + k, t) for k, t in enumerate(texts)] + [(k, texts[0]) for k in range(15)]
    assert found(spark.createDataFrame(rows, DOCS)) == {k: 0 for k in [*range(1, 15), 100]}


def test_near_copies_of_each_text_of_an_id(spark):
    text = lambda k: " ".join(f"w{k}x{j * 7 % 90}" for j in range(90))
    rows = [(1, text(k)) for k in range(4)] + [(10 + k, text(k).replace(f"w{k}x14 ", "changed ")) for k in range(4)] + [(99, text(9))]
    assert found(spark.createDataFrame(rows, DOCS)) == {10 + k: 1 for k in range(4)}


def test_text_ids_short_and_long_texts_and_clashes(spark):
    long = " ".join(f"x{k % 70_001}" for k in range(200_000))
    rows = [("u-2", "One, two"), ("u-1", "one two"), ("z", "one"), ("l-1", long), ("l-2", long + " end"), ("n", None), ("e", ""), ("p", "..."), (None, "one two")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as id", "2 as node", "3 as key", "4 as gone", "5 as kept_id")
    assert found(df) == {"u-2": "u-1", "l-2": "l-1"}
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id or "" for r in left.collect()) == ["", "e", "l-1", "n", "p", "u-1", "z"]


def test_of_a_repeated_id_one_row_stays(spark):
    rows = [(1, "b c d e"), (1, "a b c d"), (1, "a b c d"), (2, None), (2, None), (2, "q r s t"), (None, "x"), (None, "x")]
    for df in (spark.createDataFrame(rows, DOCS), spark.createDataFrame(rows[::-1], DOCS).repartition(3)):
        left = sorted((r.doc_id or 0, r.text or "") for r in minhash.drop_near_duplicates(df).collect())
        assert left == [(0, "x"), (0, "x"), (1, "a b c d"), (2, "")]
    assert minhash.drop_near_duplicates(df.limit(0)).count() == 0 and minhash.near_duplicates(df.limit(0)).count() == 0
