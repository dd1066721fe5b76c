"""Personal data behind disguises, found in a normalised stream and mapped back to the source characters.

Transducers rewrite a text: look-alike characters to ASCII (one to one),
invisible characters to nothing, spelled digits to digits and written-out at and
dot signs to the signs.  Detectors run on the rewritten text, and a table of
pieces maps what they find to the characters it was made from.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import _LOWER_TABLE, free_name, span_hashes, text_slices, words

# --- look-alikes -------------------------------------------------------------

_PAIRS = dict(
    zip(
        "аАвВсСеЕнНіІјЈкКмМоОрРѕЅтТуУхХһɡԁԛԝӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧαονρυχι",
        "aABBcCeEHHiIjJkKmMoOpPsStTyYxXhgdqwlABEZHIKMNOPTYXaovpuxi",
        strict=True,
    )
)
_PAIRS["в"], _PAIRS["н"] = "b", "h"
_PAIRS |= {chr(0xFEE0 + c): chr(c) for c in range(0x21, 0x7F)}  # fullwidth forms
_PAIRS |= {chr(b + k): str(k) for b in (0x660, 0x6F0, 0x966) for k in range(10)}  # other scripts' digits
_PAIRS |= {"‐": "-", "‑": "-", "‒": "-", "–": "-", "．": ".", "。": ".", "․": ".", "﹒": ".", "﹫": "@", " ": " ", " ": " ", " ": " ", " ": " "}
LOOK_ALIKE = str.maketrans(_PAIRS)
_LOOKS = re.compile("[" + "".join(map(re.escape, sorted(_PAIRS))) + "]")
_INVISIBLE = "​‌‍⁠﻿­"

# --- disguises ---------------------------------------------------------------

DIGIT_WORDS: dict[str, str] = {}
for _language in ("zero one two three four five six seven eight nine", "null eins zwei drei vier fünf sechs sieben acht neun", "zéro un deux trois quatre cinq six sept huit neuf", "cero uno dos tres cuatro cinco seis siete ocho nueve"):
    DIGIT_WORDS |= {w: str(k) for k, w in enumerate(_language.split())}
DIGIT_WORDS["oh"] = "0"
_DIGIT = "(?:" + "|".join(sorted(map(re.escape, DIGIT_WORDS), key=len, reverse=True)) + ")"
_ONE_DIGIT = re.compile(rf"(?<!\w){_DIGIT}(?!\w)", re.I)
_OPEN, _CLOSE = r"[\(\[\{<]", r"[\)\]\}>]"
DISGUISES = re.compile(
    rf"(?P<digits>(?<!\w){_DIGIT}(?:[\s,.-]{{1,3}}{_DIGIT})+(?!\w))"
    rf"|(?P<at>[ \t]{{0,3}}{_OPEN}[ \t]{{0,2}}(?:at|@)[ \t]{{0,2}}{_CLOSE}[ \t]{{0,3}}|(?<=\w)[ \t]{{1,3}}at[ \t]{{1,3}}(?=[\w-]{{1,63}}[ \t]{{0,3}}(?:{_OPEN}[ \t]{{0,2}}(?:dot|\.)[ \t]{{0,2}}{_CLOSE}|[ \t]dot[ \t])))"
    rf"|(?P<dot>[ \t]{{0,3}}{_OPEN}[ \t]{{0,2}}(?:dot|\.)[ \t]{{0,2}}{_CLOSE}[ \t]{{0,3}}|(?<=\w)[ \t]{{1,3}}dot[ \t]{{1,3}}(?=\w))"
    rf"|(?P<nothing>[{_INVISIBLE}]+)",
    re.I,
)
_BRACKETED = re.compile(rf"{_OPEN}[ \t]{{0,2}}(?:at|@|dot|\.)[ \t]{{0,2}}{_CLOSE}|[{_INVISIBLE}]", re.I)
_SPELLED = re.compile(rf"(?<!\w){_DIGIT}[\s,.-]{{1,3}}{_DIGIT}(?!\w)|[ \t]dot[ \t]", re.I)


def normalise(text: str) -> tuple[str, list[int], list[int], list[bool]]:
    """The rewritten text and its pieces: where each starts in it, where in ``text``, and whether it is a rewritten one.

    The lists have one more entry, for the end.
    """
    plain = text.translate(LOOK_ALIKE) if _LOOKS.search(text) else text
    out, at, src, new, done, length = [], [], [], [], 0, 0

    def add(piece: str, start: int, made: bool) -> None:
        nonlocal length
        at.append(length)
        src.append(start)
        new.append(made)
        out.append(piece)
        length += len(piece)

    if _BRACKETED.search(plain) or _SPELLED.search(plain):
        for m in DISGUISES.finditer(plain):
            if m.start() > done:
                add(plain[done : m.start()], done, False)
            if m.lastgroup == "digits":
                last = m.start()
                for d in _ONE_DIGIT.finditer(plain, m.start(), m.end()):
                    if d.start() > last:
                        add("", last, True)
                    add(DIGIT_WORDS[d.group().lower()], d.start(), True)
                    last = d.end()
                if last < m.end():
                    add("", last, True)
            else:
                add({"at": "@", "dot": ".", "nothing": ""}[m.lastgroup], m.start(), True)
            done = m.end()
    if done < len(plain):
        add(plain[done:], done, False)
    at.append(length)
    src.append(len(text))
    new.append(False)
    return "".join(out), at, src, new


def source_span(start: int, end: int, at: list[int], src: list[int], new: list[bool]) -> tuple[int, int]:
    """The source characters that the characters [start, end) of the rewritten text were made from."""
    i = bisect_right(at, start) - 1
    j = bisect_right(at, end - 1) - 1
    first = src[i] if new[i] else src[i] + start - at[i]
    last = src[j + 1] if new[j] else src[j] + end - at[j]
    return first, last


# --- detectors ---------------------------------------------------------------

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}(?![A-Za-z0-9-])")
_NUMBERS = re.compile(
    r"(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\d){7,12}(?!\w))"
    r"|(?P<account>(?<![\w.])\d(?:[ -]?\d){12,18}(?!\w))"
)
_SPELLED_NUMBER = re.compile(r"(?<!\w)\d{7,}(?!\w)")  # no upper bound: spelled numbers after one another are one run
_SECRET = re.compile(r"(?<![A-Za-z0-9])(?:api[_ -]?key|access[_ -]?key|secret|token|passwd|password|key)[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?P<value>[A-Za-z0-9+/_.=-]{8,})", re.I)
_KEYS = re.compile(r"(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk-[A-Za-z0-9_-]{20,})(?![A-Za-z0-9])")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Whole runs, however long; an at sign ends a run, so that each character is looked at once or twice."""
    place = text.find("@")
    while place >= 0:
        start = place
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < place and text[start] in ".%+-":
            start += 1
        if start < place and (m := _DOMAIN.match(text, place + 1)):
            yield start, m.end()
        place = text.find("@", place + 1)


def _valid_card(digits: str) -> bool:
    total = sum(d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(map(int, reversed(digits))))
    return 13 <= len(digits) <= 19 and total % 10 == 0


def find_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in characters of the source, in order and apart; of overlapping finds the earlier one, then the longer one stays."""
    plain, at, src, new = normalise(text)
    found = [(a, b, "email") for a, b in _emails(plain)]
    for m in _NUMBERS.finditer(plain):
        kind = m.lastgroup
        if kind == "account" and _valid_card(re.sub(r"\D", "", m.group())):
            kind = "card"
        found.append((m.start(), m.end(), kind))
    found += [(m.start("value"), m.end("value"), "secret") for m in _SECRET.finditer(plain)]
    found += [(m.start(), m.end(), "secret") for m in _KEYS.finditer(plain)]
    if any(new):
        made = [a for a, b, k in zip(at, at[1:], new, strict=False) if k and b > a]
        if made:
            for m in _SPELLED_NUMBER.finditer(plain):
                i = bisect_right(made, m.end() - 1)
                if i and made[i - 1] >= m.start():
                    found.append((m.start(), m.end(), "phone"))
    spans: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(((*source_span(a, b, at, src, new), k) for a, b, k in found), key=lambda s: (s[0], -s[1], s[2])):
        if not spans or a >= spans[-1][1]:
            spans.append((a, b, kind))
    return spans


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    if not spans:
        return text
    bounds = [0, *(x for a, b, _ in spans for x in (a, b)), len(text)]
    parts = [text[a:b] for a, b in list(pairwise(bounds))[::2]]
    return "".join(p for k, (_, _, kind) in enumerate(spans) for p in (parts[k], f"[{kind.upper()}]")) + parts[-1]


# --- which texts can hold any of it ------------------------------------------

def _hashes(listed: list[bytes]) -> np.ndarray:
    joined = b" ".join(listed)
    ends = np.cumsum([len(w) + 1 for w in listed]) - 1
    return np.sort(span_hashes(np.frombuffer(joined, np.uint8), ends - np.array([len(w) for w in listed]), ends, _LOWER_TABLE))


_DOT = _hashes([b"dot"])[0]
_DIGITS = _hashes([v.encode() for w in DIGIT_WORDS for v in {w, w.upper(), w.capitalize()}])
_DIGIT_FLAG, _AT_FLAG = (np.isin(np.arange(256), list(x)) for x in (b"0123456789", b"@"))
_SETTER = np.isin(np.arange(256), list(b"=:"))
#: First bytes of the look-alikes, of the invisible characters and spaces, and of all other scripts' digits.
_LEADS = np.isin(np.arange(256), [0xC2, *range(0xC9, 0xD6), 0xD9, 0xDB, 0xDF, 0xE0, 0xE1, 0xE2, 0xE3, 0xEA, 0xEF, 0xF0])
#: The keys' prefixes, and _BRACKETED in bytes (its invisible characters are among _LEADS).
_MARKS = re.compile(rb"gh[pousr]_|sk-|AKIA|[\(\[\{<][ \t]{0,2}(?i:at|@|dot|\.)[ \t]{0,2}[\)\]\}>]")


def _has(flag: np.ndarray, off: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flag, dtype=np.int64)])
    return total[off[1:]] > total[off[:-1]]


def may_hold(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """For each text whether any detector could find anything.  A text without what this looks for has nothing.

    Every find needs a digit, an at sign, an assignment sign, a look-alike, the
    word dot, two spelled digits, a bracketed at or dot sign or a key's prefix.
    A text's verdict depends on nothing but the text.
    """
    out = _has((_DIGIT_FLAG | _AT_FLAG | _SETTER | _LEADS)[buf], off)
    h, _, _, first = words(buf, off)
    word = h == _DOT
    at = np.minimum(np.searchsorted(_DIGITS, h), len(_DIGITS) - 1)
    digit = _DIGITS[at] == h
    pair = np.zeros(len(h), bool)
    if len(h) > 1:
        pair[:-1] = digit[:-1] & digit[1:]
    out |= _has(word | pair, first)
    raw = buf.tobytes()
    for k in np.flatnonzero(~out):
        out[k] = _MARKS.search(raw, off[k], off[k + 1]) is not None
    return out


_SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _scan(texts: pa.Array) -> Iterator[tuple[int, int, list, list]]:
    for lo, hi, buf, off in text_slices(texts):
        values: list = [None] * (hi - lo)
        spans: list = [[] for _ in range(hi - lo)]
        for k in np.flatnonzero(may_hold(buf, off)):
            text = texts[lo + int(k)].as_py()
            if text and (s := find_spans(text)):
                spans[k], values[k] = s, redact(text, s)
        yield lo, hi, values, spans


def redact_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_found, spans, text) for every row: the text with each find replaced by its kind in brackets.

    ``spans`` lists kind, start and end in characters of the source text.  A
    null text stays null and has no finds.  Ids may be null or repeated; texts
    are scanned whole; other columns are ignored; an empty table gives an empty
    result.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            for lo, hi, values, spans in _scan(texts):
                changed = pa.array([v is not None for v in values])
                text = pc.if_else(changed, pa.array(values, texts.type), texts.slice(lo, hi - lo))
                listed = pa.array([[{"kind": k, "start": a, "end": b} for a, b, k in s] for s in spans], _SPAN_TYPE)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array([len(s) for s in spans], pa.int32()), listed, text], names=["doc_id", "n_found", "spans", "text"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_found int, spans {_SPANS}, text string")


def redact_column(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the finds in one column replaced, all columns and rows kept."""
    names = [free_name(docs, f"own_{k}") for k in range(len(docs.columns))]
    where = docs.columns.index(text_col)
    rows = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, names, strict=True)))
    rows = rows.withColumn(names[where], F.col(names[where]).cast("string"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(where)
            for lo, hi, values, _ in _scan(texts):
                changed = pa.array([v is not None for v in values])
                columns = [c.slice(lo, hi - lo) for c in batch.columns]
                columns[where] = pc.if_else(changed, pa.array(values, texts.type), columns[where])
                yield pa.RecordBatch.from_arrays(columns, names=names)

    out = rows.mapInArrow(run, rows.schema)
    return out.select(*(F.col(n).alias(c) for c, n in zip(docs.columns, names, strict=True)))
