"""Encoding, chats and quality rules: generated cases against plain versions, and the odd tables."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seguelab.llm import bpe, chat, quality_rules

PLAIN = st.text(st.sampled_from("abcdeé ßß日本'\n\t 0123.,!\U0001f600\x00"), max_size=60)


@pytest.fixture(scope="module")
def coders():
    import tiktoken

    ranks = bpe.read_ranks()
    return bpe.Coder(ranks), tiktoken.Encoding("plain", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(PLAIN, max_size=5))
def test_encoding_is_the_public_one_and_decodes(coders, texts):
    coder, plain = coders
    ids, sizes = coder.encode(texts)
    assert ids.tolist() == [i for t in texts for i in plain.encode_ordinary(t)] and sizes.tolist() == [len(plain.encode_ordinary(t)) for t in texts]
    assert coder.decode(ids).tobytes().decode() == "".join(texts)


@settings(max_examples=200, deadline=None)
@given(piece=st.binary(min_size=1, max_size=40))
def test_merges_of_any_bytes(coders, piece):
    ranks = coders[0].ranks
    parts = [bytes([b]) for b in piece]
    while found := [(ranks[a + b], k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]:
        k = min(found)[1]
        parts[k : k + 2] = [parts[k] + parts[k + 1]]
    assert bpe.merge(piece, ranks) == [ranks[p] for p in parts]


def test_a_worker_forgets_and_encodes_alike(coders, monkeypatch):
    monkeypatch.setattr(bpe, "MEMORY_PIECES", 3)
    coder, plain = bpe.Coder(coders[0].ranks), coders[1]
    for k in range(5):
        text = f"one two {k} three four five {k * k}"
        assert coder.encode([text])[0].tolist() == plain.encode_ordinary(text)


def test_encoded_tables(spark, coders):
    long = "word and wörd " * 40_000
    rows = [("u-1", long, "a"), ("u-1", long, "a"), (None, "x", None), ("u-2", None, "b"), ("u-3", "", "b")]
    df = spark.createDataFrame(rows, "doc_id string, text string, tokens string").selectExpr("*", "1 as keep_0", "2 as n_tokens")
    out = bpe.encode_documents(df, keep=("keep_0",))
    got = out.collect()
    assert out.columns == ["doc_id", "keep_0", "n_tokens", "tokens", "round_trip"] and len(got) == 5 and all(r.keep_0 == 1 for r in got)
    assert [r.tokens for r in got if r.doc_id == "u-1"] == [coders[1].encode_ordinary(long)] * 2
    assert sorted(r.text or "" for r in bpe.decode_documents(out).collect()) == sorted(t or "" for _, t, _ in rows)
    assert bpe.encode_documents(df.limit(0)).count() == 0 and bpe.decode_documents(out.limit(0)).count() == 0


def plain_chats(turns):
    """Maximal conversations by comparing all of them whole."""
    digest = lambda r, t: hashlib.md5(f"{r or ''}\x1f{t or ''}".encode()).hexdigest()
    convs = {}
    for c, n, r, t in {x for x in turns if x[0] is not None}:
        convs.setdefault(c, set()).add((n is not None, n or 0, digest(r, t), r or "", t or ""))
    lists = {c: [x[3:] for x in sorted(v)] for c, v in convs.items()}
    kept = {}
    for c, v in sorted(lists.items()):
        if not any(len(w) > len(v) and w[: len(v)] == v for w in lists.values()) and v not in [lists[k] for k in kept]:
            kept[c] = "".join(f"<|{r}|>\n{t}<|end|>\n" for r, t in v)
    return kept


TURN = st.tuples(st.one_of(st.none(), st.integers(0, 5)), st.one_of(st.none(), st.integers(0, 3)), st.sampled_from(["user", "assistant", None]), st.sampled_from(["hi", "yo", "", None]))


def test_chats_against_plain_comparison(spark):
    """One table of many generated logs: ids of different logs can't meet, as each has its own first turn."""
    logs = []

    @settings(max_examples=40, deadline=None, database=None)
    @given(st.lists(TURN, max_size=14))
    def make(turns):
        logs.append(turns)

    make()
    rows, want = [], {}
    for k, turns in enumerate(logs):
        own = [(None if c is None else 10 * k + c, n, r, t) for c, n, r, t in turns]
        own += [(c, -1, "system", f"log {k}") for c in {x[0] for x in own}]
        rows += own
        want |= plain_chats(own)
    df = spark.createDataFrame(rows + rows[:7], "conv_id long, turn int, role string, text string").selectExpr("*", "1 as n", "2 as d", "3 as line", "4 as total")
    got = {r.conv_id: r.rendered for r in chat.format_chats(df.repartition(4)).collect()}
    assert got == want


def test_odd_chats(spark):
    long = "z" * 300_000
    rows = [("c-2", 1, "user", long), ("c-1", 1, "user", long), ("c-3", 1, "user", long), ("c-3", 2, "assistant", "ok")]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")
    assert [(r.conv_id, r.n_turns) for r in chat.format_chats(df).collect()] == [("c-3", 2)]
    assert [r.conv_id for r in chat.format_chats(df.filter("conv_id <> 'c-3'")).collect()] == ["c-1"]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_odd_rows_of_the_quality_report(spark):
    good = "This is a text of plain words, and it is fine to read. "
    rows = [(None, good), ("u-1", good * 3000), ("u-1", good * 3000), ("u-2", None), ("u-3", "\n\n"), ("u-4", " \t ")]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as quality", "'x' as broken", "true as keep")
    got = quality_rules.quality_report(df).collect()
    assert len(got) == 6 and {(r.doc_id, r.keep) for r in got} == {(None, True), ("u-1", True), ("u-2", False), ("u-3", False), ("u-4", False)}
    assert {r.broken for r in got if not r.keep} == {"length"}
    assert quality_rules.keep_good(df).columns == df.columns and quality_rules.keep_good(df).count() == 3
    assert quality_rules.quality_report(df.limit(0)).count() == 0 and quality_rules.keep_good(df.limit(0)).count() == 0
