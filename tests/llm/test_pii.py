"""Redaction through the table operators, each text alone and among neighbours."""

import pytest

from seguelab.llm import pii

BRACKETED = [
    "write to jane [AT] example.org today",
    "write to jane ( at ) example.com today",
    "write to jane {at} example.com today",
    "write to jane <at> example.com today",
    "write to jane (aT) example.com today",
    "write to jane at example[.]com today",
    "write to jane at example(.)com today",
    "write to jane at example ( DOT ) com today",
]
OTHER = ["plain words", "snake_case words", "a sk- word (at) home", "call ၅၅၅-၁၂၃-၄၅၆၇ now", "call ߅߅߅-߁߂߃-߄߅߆߇ now", "seven five five one two three four", ""]


def scanned(texts):
    import pyarrow as pa

    return [v[k] for _, _, v, _ in pii._scan(pa.array(texts)) for k in range(len(v))]


@pytest.mark.parametrize("text", BRACKETED + OTHER)
def test_prefilter_skips_nothing(text):
    spans = pii.find_spans(text)
    want = pii.redact(text, spans) if spans else None
    assert scanned([text]) == [want]
    for neighbour in ("plain words", "snake_case", "a sk- word", "home (at) last"):
        assert scanned([neighbour, text, neighbour])[1] == want


def test_bracketed_signs_in_tables(spark):
    for texts in [[t] for t in BRACKETED[:2]] + [BRACKETED + OTHER]:
        got = {r.doc_id: r for r in pii.redact_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
        for k, t in enumerate(texts):
            spans = pii.find_spans(t)
            assert got[k].text == pii.redact(t, spans) and [(s.start, s.end, s.kind) for s in got[k].spans] == spans
            assert t not in BRACKETED or "[EMAIL]" in got[k].text


TEN, SEVEN = "five five five oh one two three four five six", "five five five one two three four"
CARD = "four one one one one one one one one one one one one one one one"


@pytest.mark.parametrize("numbers", [f"{TEN}, {TEN}", f"{TEN}\n{TEN}", f"{SEVEN}, {SEVEN}, {SEVEN}", f"{CARD} - one two three four", ", ".join([CARD] * 5)])
def test_adjacent_spelled_numbers_go_whole(numbers):
    assert scanned([f"call {numbers} please"]) == ["call [PHONE] please"]


@pytest.mark.parametrize("text, want", [
    ("token = " + "eyJhbGci.0aZ_-/+" * 300 + " end", "token = [SECRET] end"),
    ("password: " + "a1" * 257 + "\nend", "password: [SECRET]\nend"),
    ("see sk-" + "a1B2-_" * 500 + " end", "see [SECRET] end"),
    ("see ghp_" + "a1B2" * 500 + " end", "see [SECRET] end"),
])
def test_long_secrets_leave_no_tail(text, want):
    assert scanned([text]) == [want]
