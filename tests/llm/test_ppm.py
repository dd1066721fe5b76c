"""Code lengths by prediction by partial matching against the plain trie."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seguelab.llm import ppm


def plain(texts, folds, order):
    tries = [ppm.Trie(order), ppm.Trie(order)]
    for t, f in zip(texts, folds, strict=True):
        for c, s in ppm.contexts((t or "").encode(), order):
            tries[f].learn(c, s)
    return [sum(tries[1 - f].bits(c, s) for c, s in ppm.contexts((t or "").encode(), order)) for t, f in zip(texts, folds, strict=True)]


def folds_of(df):
    text = F.coalesce("text", F.lit(""))
    return [r.f for r in df.select("n", F.pmod(F.xxhash64(text), F.lit(2)).alias("f")).orderBy("n").collect()]


@pytest.mark.parametrize("order, chunk", [(4, 1 << 20), (4, 300), (1, 200), (5, 300)])
def test_against_the_plain_trie(spark, order, chunk):
    rng = np.random.default_rng(order)
    words = ["the", "cat", "sat", "ran", "größer", "日本", "zz", "a"]
    texts = [" ".join(rng.choice(words, rng.integers(1, 30))) for _ in range(40)]
    texts += [texts[0], texts[0], None, "", "\x00\xff", " ".join(texts[:20])]
    ids = [f"u-{k}" for k in range(len(texts) - 1)] + [None]
    df = spark.createDataFrame([(k, i, t, "x") for k, (i, t) in enumerate(zip(ids, texts, strict=True))], "n int, doc_id string, text string, entry string")
    want = plain(texts, folds_of(df), order)
    got = {r.doc_id: r for r in ppm.code_length(df.repartition(3), order=order, chunk_bytes=chunk).collect()}
    assert len(got) == len(texts)
    for i, t, bits in zip(ids, texts, want, strict=True):
        n = len((t or "").encode())
        assert got[i].n_bytes == n and got[i].bits == pytest.approx(bits, abs=0.02)
        assert got[i].bits_per_byte == (pytest.approx(bits / n, abs=0.02) if n else None)


def test_repeated_rows_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "one two three")] * 5 + [(2, None)], "doc_id long, text string")
    rows = ppm.code_length(df).collect()
    assert sorted(r.doc_id for r in rows) == [1, 1, 1, 1, 1, 2] and {r.bits for r in rows if r.doc_id == 1} == {104.0}  # the other fold is empty
    assert ppm.code_length(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ppm.code_length(df, order=6)


def test_texts_like_the_corpus_take_fewer_bits(spark):
    rng = np.random.default_rng(9)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi") for b in ("ta", "re", "su", "no")]
    rows = [(k, " ".join(rng.choice(words, 60))) for k in range(60)] + [(100 + k, "".join(map(chr, rng.integers(33, 127, 300)))) for k in range(6)]
    rate = {r.doc_id: r.bits_per_byte for r in ppm.code_length(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert max(rate[k] for k in range(60)) + 1 < min(rate[100 + k] for k in range(6))


def test_adaptive_lengths(spark):
    texts = ["abababababababab", "qwertyuiopasdfgh", "", None]
    got = [r for r in ppm.adaptive_code_length(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()]
    assert got[0].bits < got[1].bits and got[0].bits == pytest.approx(ppm.adaptive_bits(texts[0].encode()), abs=0.01)
    assert got[2].bits == got[3].bits == 0 and got[3].bits_per_byte is None
