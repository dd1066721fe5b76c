"""The training-data operators against plain versions, on small tables with nulls, empty texts, repeats and clashing columns."""

import numpy as np
import pytest

from seguelab.llm import bpe, chat, minhash, mixing, pii, quality_rules

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [f"w{k}x" for k in range(400)]


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], DOCS)


def passage(start, n):
    return " ".join(WORDS[(start * 7 + k * 3) % 400] + str((start + k) % 11) for k in range(n))


def test_near_duplicates_and_odd_cases(spark):
    base, other = passage(1, 120), passage(200, 120)
    df = docs(spark, [(5, base, "a"), (2, base, "a"), (9, base.replace("w4x", "changed"), "b"), (7, other, "b"), (8, None, "b"), (10, "", "b"), (None, base, "a"), (7, other, "b")])
    assert {(r.doc_id, r.kept_id) for r in minhash.near_duplicates(df).collect()} == {(5, 2), (9, 2)}
    left = minhash.drop_near_duplicates(df)
    assert left.columns == df.columns and sorted(r.doc_id or -1 for r in left.collect()) == [-1, 2, 7, 8, 10]
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def plain_merge(piece, ranks):
    parts = [bytes([b]) for b in piece]
    while True:
        found = [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not found:
            return [ranks[p] for p in parts]
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]


def test_bpe_merges_and_round_trip(spark):
    ranks = bpe.read_ranks()
    for piece in (b"a", b" hello", b"aaaaaaaaab", "größer".encode(), b"mississippi" * 3):
        assert bpe.merge(piece, ranks) == plain_merge(piece, ranks)
    rows = [(1, "Hello, wörld! 123\n\n x", "s"), (2, "", "s"), (3, None, "s")]
    out = bpe.encode_documents(docs(spark, rows))
    got = {r.doc_id: r for r in out.collect()}
    assert got[1].round_trip and got[2].n_tokens == 0 and got[3].tokens is None
    assert {r.doc_id: r.text for r in bpe.decode_documents(out).collect()} == {1: rows[0][1], 2: "", 3: None}


def test_mixing_rates_and_clashes(spark):
    df = docs(spark, [(k, "one two three four", "big") for k in range(90)] + [(100 + k, "one two", None) for k in range(10)]).selectExpr("*", "1 as copy_no", "2 as mix_rate")
    out = mixing.mix_sources(df, number=True)
    assert out.columns == [*df.columns, "copy_no_1"]
    rows = out.collect()
    assert sum(r.source is None for r in rows) in range(90, 101) and sum(r.source == "big" for r in rows) < 75
    assert mixing.mix_sources(df.limit(0)).count() == 0


def test_chats_keep_the_maximal(spark):
    turns = [(1, 0, "user", "hi"), (1, 1, "assistant", "yo"), (2, 0, "user", "hi"), (3, 0, "user", "hi"), (3, 1, "assistant", "yo"), (4, 0, "user", None), (None, 0, "user", "x")]
    got = {r.conv_id: r.rendered for r in chat.format_chats(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {1, 4} and got[1] == "<|user|>\nhi<|end|>\n<|assistant|>\nyo<|end|>\n"


@pytest.mark.parametrize(
    "text, want",
    [
        ("write jane.doe (at) example (dot) com now", "write [EMAIL] now"),
        ("mail jаne@exаmple.com", "mail [EMAIL]"),
        ("from 10.1.2.3 today", "from [IP] today"),
        ("call +1 (555) 123-4567!", "call [PHONE]!"),
        ("dial five five five one two three four please", "dial [PHONE] please"),
        ("nothing to see at home", "nothing to see at home"),
    ],
)
def test_pii_behind_disguises(text, want):
    assert pii.redact(text, pii.find_spans(text)) == want


def test_quality_rules_keep_the_clean(spark):
    good = "This is a text of plain words, and it is fine."
    df = docs(spark, [(1, good, "s"), (2, "", "s"), (3, None, "s"), (4, "a### b### c### d###", "s"), (5, "go go go go go go", "s"), (6, "LOUD WORDS ARE ALL HERE NOW", "s")]).selectExpr("*", "1 as quality")
    got = {r.doc_id: r.broken for r in quality_rules.quality_report(df).collect()}
    assert got[1] == "" and got[2] == got[3] == "length" and "symbols" in got[4] and "repeated_words" in got[5] and "shouting" in got[6]
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and [r.doc_id for r in kept.collect()] == [1]
