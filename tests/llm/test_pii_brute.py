"""Redaction of tables against a scan of every text, and of generated disguises."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from seguelab.llm import pii

PIECES = [
    "jane", "doe", ".", "@", " at ", " dot ", "(at)", "[dot]", "( . )", "{AT}", "<at>", "example", "com", "org", "555", "123-4567", "+1 ", "five ", "FIVE", "drei-", "cinq, ", "oh ",
    "4111 1111 1111 1111", "10.0.0.1", "token=", "password: ", "abcdEFGH1234", "sk-", "ghp_", "AKIA", "ABCDEFGHIJKLMNOP", "а", "０", "​", "­", "\n", " ", "_", "-", "x", "é", "日本", "٥", "․",
]
TEXTS = st.lists(st.sampled_from(PIECES), max_size=14).map("".join)


def plain_redact(text):
    """Each character by the span it lies in, from the spans alone."""
    out, k = [], 0
    for a, b, kind in pii.find_spans(text):
        out += [text[k:a], f"[{kind.upper()}]"]
        k = b
    return "".join(out) + text[k:]


def scan(texts):
    import pyarrow as pa

    got = []
    for _, _, values, spans in pii._scan(pa.array(texts, pa.string())):
        got += list(zip(values, spans, strict=True))
    return got


@settings(max_examples=600, deadline=None)
@given(st.lists(TEXTS, min_size=1, max_size=4))
def test_the_prefilter_skips_nothing(texts):
    for text, (value, spans) in zip(texts, scan(texts), strict=True):
        want = pii.find_spans(text)
        assert spans == want and value == (plain_redact(text) if want else None)


@settings(max_examples=300, deadline=None)
@given(TEXTS)
def test_spans_are_places_in_the_source(text):
    spans = pii.find_spans(text)
    assert all(0 <= a < b <= len(text) for a, b, _ in spans) and all(b <= c for (_, b, _), (c, _, _) in zip(spans, spans[1:], strict=False))
    plain, at, src, new = pii.normalise(text)
    assert len(at) == len(src) == len(new) and at[-1] == len(plain) and src[-1] == len(text) and at == sorted(at) and src == sorted(src)


LONG = "filler words and more " * 20_000


@pytest.mark.parametrize("text, want", [
    ("write " + "j" * 300 + "@example.com now", "write [EMAIL] now"),
    ("write jane@" + "a." * 40 + "example.com now", "write [EMAIL] now"),
    ("write jane@" + "a" * 200 + ".com now", "write [EMAIL] now"),
    (LONG + "jane (at) example (dot) com", LONG + "[EMAIL]"),
])
def test_whole_runs(text, want):
    assert plain_redact(text) == want and scan([text])[0][0] == want


def test_tables_with_odd_rows(spark):
    texts = [None, "", "plain", "mail jane (AT) example.com", LONG + "+1 (555) 123-4567", "mail jane (AT) example.com", "ghp_" + "a1" * 40]
    rows = [(f"u-{k}" if k != 2 else None, t) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id string, text string").selectExpr("*", "1 as n_found", "2 as own_0", "3 as spans")
    got = {r.doc_id: r for r in pii.redact_documents(df.repartition(3)).collect()}
    for i, t in rows:
        spans = pii.find_spans(t or "")
        assert got[i].n_found == len(spans) and [(s.start, s.end, s.kind) for s in got[i].spans] == spans
        assert got[i].text == (None if t is None else plain_redact(t))
    whole = pii.redact_column(df)
    assert whole.columns == df.columns
    assert sorted(map(str, whole.collect())) == sorted(str(r) for r in df.collect() for r in [r.__class__(**(r.asDict() | {"text": None if r.text is None else plain_redact(r.text)}))])
    assert pii.redact_documents(df.limit(0)).count() == 0 and pii.redact_column(df.limit(0)).count() == 0
