"""Track text, time codes, addresses, tokens and signatures as column expressions.

Each rewriting is a list of regular-expression steps that Spark and DuckDB both
understand, so the same list yields the expression and its SQL.
"""

from __future__ import annotations

import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

DASH = "-–—"
EDGE = f" {DASH}|:;,."
Steps = list[tuple[str, str]]

TIME_LINE = rf"^\s*((?:[0-9]{{1,2}}:)?[0-9]{{1,2}}:[0-9]{{2}})\s*(?:[{DASH}|]\s*)?(\S.*?)\s*$"
SEPARATOR = rf"\s[{DASH}]\s"
_SITES = r"https?://|www\.|(?:open\.)?spotify\.com/|soundcloud\.com/|youtu(?:be\.com|\.be)/"
_EMPTY = r"\(\s*\)|\[\s*\]|\{\s*\}"
CLEAN: Steps = [
    (rf"^\s*(?:[0-9]{{1,2}}:)?[0-9]{{1,2}}:[0-9]{{2}}\s*(?:[{DASH}|]\s*)?", ""),
    (rf"(?i)(?:{_SITES})\S+", ""),
    (_EMPTY, ""),
    (rf"[(\[{{]\s*([{DASH}|:;,.])", "$1"),
    (rf"([{DASH}|:;,.])\s*[)\]}}]", "$1"),
    (r"\s{2,}", " "),
]
_EXTRA = "|".join(
    [r"[0-9]{4}(?:-[0-9]{2,4})?", r"official(?:\s+(?:audio|video))?", "lyric video", "lyrics?", "visualizer", "4k special", r"slowed(?:\s+by\s+me)?", "sped up", "nightcore", "full version", r"ver\.?.*?"]
)
SIMPLIFY: Steps = [(rf"(?i)\s*[(\[]\s*(?:{_EXTRA})\s*[)\]]", ""), (_EMPTY, ""), (r"\s{2,}", " ")]
NOISE = r"(?i)\b(?:1 hour|2 hour|3 hour|amv|benchmark|compilation|edit|gameplay|gaming test|mix(?:\s+[0-9]+)?|night drive|playlist|reaction|review|tutorial|walkthrough)\b"
FILLER = tuple(sorted("and audio by feat featuring ft full lyric lyrics music official prod the topic ver version video visualizer".split()))
VIDEO_ID = r"^[A-Za-z0-9_-]{11}$"
ID_PATTERNS = (r"[?&]v=([^&#?/]+)", r"youtu\.be/([^&#?/]+)", r"/shorts/([^&#?/]+)", r"/live/([^&#?/]+)")
TEMPORARY = r"\.(part|tmp|temp|ytdl)(\.|$)"


def _apply(c: Column, steps: Steps) -> Column:
    return reduce(lambda x, s: F.regexp_replace(x, s[0], s[1]), steps, c)


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _apply_sql(c: str, steps: Steps) -> str:
    return reduce(lambda x, s: f"regexp_replace({x}, {quote(s[0])}, {quote(s[1].replace('$1', chr(92) + '1'))}, 'g')", steps, c)


def text_or_empty(c: Column) -> Column:
    return F.trim(F.coalesce(c.cast("string"), F.lit("")))


# --- track names -------------------------------------------------------------


def track_text(c: Column) -> Column:
    """A track's name without time code, addresses, empty or dangling brackets and separators at the ends."""
    body = F.trim(_apply(text_or_empty(c), CLEAN), F.lit(EDGE))
    return F.trim(F.regexp_replace(body, r"\s{2,}", " "))


def track_text_sql(c: str) -> str:
    return f"trim(regexp_replace(trim({_apply_sql(f'''trim(coalesce({c}, ''))''', CLEAN)}, {quote(EDGE)}), '\\s{{2,}}', ' ', 'g'))"


def search_text(c: Column) -> Column:
    """The track's name without bracketed remarks such as a year or "official video"."""
    return F.trim(F.trim(_apply(track_text(c), SIMPLIFY), F.lit(EDGE)))


def search_text_sql(c: str) -> str:
    return f"trim(trim({_apply_sql(track_text_sql(c), SIMPLIFY)}, {quote(EDGE)}))"


def search_queries(c: Column) -> Column:
    """The distinct, filled ones of the clean and the simplified name."""
    return F.array_distinct(F.filter(F.array(track_text(c), search_text(c)), lambda x: x != ""))


def plain_query(c: Column) -> Column:
    return F.lower(F.regexp_replace(F.trim(c), r"\s+", " "))


def track_sides(clean: Column) -> Column:
    """struct(left, right) of a name with just one separator; empty texts otherwise."""
    return cut_sides(F.split(clean, SEPARATOR))


def cut_sides(cut: Column) -> Column:
    """As :func:`track_sides` of a name that is split at its separators already."""
    left, right = F.trim(F.element_at(cut, 1)), F.trim(F.try_element_at(cut, F.lit(2)))
    one = (F.size(cut) == 2) & (left != "") & (right != "")
    return F.struct(F.when(one, left).otherwise("").alias("left"), F.when(one, right).otherwise("").alias("right"))


def too_short(clean: Column) -> Column:
    """Whether a clean text is no track's name."""
    return F.length(clean) < 2


@F.pandas_udf(StringType())
def _folded(c: pd.Series) -> pd.Series:
    return c.map(lambda x: unicodedata.normalize("NFKC", x).casefold(), na_action="ignore")


def folded(c: Column) -> Column:
    """Compatibility-normalised and case-folded; a text of ASCII alone goes to Python as a null only."""
    plain = c.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.lower(c)).otherwise(_folded(F.when(~plain, c)))


def match_text(c: Column, fold=folded) -> Column:
    """The clean name folded, with single spaces for everything but letters, digits and underscores."""
    return F.trim(F.regexp_replace(fold(track_text(c)), r"[^\p{L}\p{M}\p{N}_]+", " "))


def tokens(matched: Column) -> Column:
    """The distinct words of a text from :func:`match_text`, without fillers and single ASCII characters."""
    words = F.filter(F.array_distinct(F.split(matched, " ")), lambda x: (x != "") & ~x.isin(*FILLER) & ((F.length(x) >= 2) | ~x.rlike(r"^[\x00-\x7F]*$")))
    return words


def overlap(expected: Column, actual: Column) -> Column:
    """The share of the expected tokens that are there; 0 where none is expected."""
    return F.when(F.size(expected) > 0, F.size(F.array_intersect(expected, actual)) / F.size(expected)).otherwise(F.lit(0.0))


def label(artist: Column, title: Column, video_id: Column, none: str = "") -> Column:
    """``artist - title``, or what there is of title, artist and id."""
    a, t, v = (F.nullif(F.trim(x.cast("string")), F.lit("")) for x in (artist, title, video_id))
    return F.coalesce(F.when(a.isNotNull() & t.isNotNull(), F.concat_ws(" - ", a, t)), t, a, v, F.lit(none))


def genre_text(c: Column) -> Column:
    """Lower case letters, digits, ampersands and single spaces."""
    c = F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[_-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[^a-z0-9& ]+", " "), " +", " "))


def genre_text_sql(c: str) -> str:
    return f"trim(regexp_replace(regexp_replace(regexp_replace(lower(coalesce({c}, '')), '[_-]', ' ', 'g'), '[^a-z0-9& ]+', ' ', 'g'), ' +', ' ', 'g'))"


def one_line(c: Column) -> Column:
    """The lines of a text, spaces squeezed and blank ones left out, joined by bars."""
    lines = F.transform(F.split(F.coalesce(c, F.lit("")), r"\r\n|\r|\n"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), " | ")


def context_text(*columns: Column) -> Column:
    """The filled values, spaces squeezed, joined by bars and folded."""
    parts = [F.nullif(F.trim(F.regexp_replace(c.cast("string"), r"\s+", " ")), F.lit("")) for c in columns]
    return F.lower(F.concat_ws(" | ", *parts))


# --- time codes --------------------------------------------------------------


def seconds(code: Column) -> Column:
    """Seconds of ``mm:ss`` or ``h:mm:ss``; anything else is an error."""
    n = F.transform(F.split(F.trim(code), ":"), lambda x: x.try_cast("int"))
    ok = F.size(n).isin(2, 3) & F.forall(n, lambda x: x.isNotNull())
    total = F.aggregate(n, F.lit(0), lambda a, x: a * 60 + x)
    return F.when(code.isNull(), F.lit(None).cast("int")).when(ok, total).otherwise(F.raise_error(F.concat(F.lit("not a time code: "), code)).cast("int"))


def strict_seconds(code: Column) -> Column:
    """Seconds where minutes and seconds are below 60; null otherwise."""
    good = r"^\s*(?:([0-9]+):)?([0-5]?[0-9]):([0-5][0-9])\s*$"
    part = lambda k: F.coalesce(F.nullif(F.regexp_extract(code, good, k), F.lit("")).cast("int"), F.lit(0))
    return F.when(code.rlike(good), part(1) * 3600 + part(2) * 60 + part(3))


def time_code(total: Column) -> Column:
    """``mm:ss``, or ``h:mm:ss`` from an hour on; never below zero."""
    s = F.greatest(total.cast("int"), F.lit(0))
    h, m, r = (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60
    return F.when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).when(s.isNotNull(), F.format_string("%02d:%02d", m, r))


def duration_text(total: Column) -> Column:
    """As :func:`time_code`, but minutes without a leading zero below an hour; empty where there is none."""
    s = F.greatest(total.cast("int"), F.lit(0))
    h, m, r = (s / 3600).cast("int"), (s % 3600 / 60).cast("int"), s % 60
    return F.when(total.isNull(), F.lit("")).when(s >= 3600, F.format_string("%d:%02d:%02d", h, m, r)).otherwise(F.format_string("%d:%02d", m, r))


def loose_seconds(c: Column) -> Column:
    """Whole seconds from a number or a time code in text, halves to even; null otherwise."""
    text = F.trim(c.cast("string"))
    return F.when(text.contains(":"), F.when(text.rlike(r"^[0-9]+:[0-9]+(:[0-9]+)?$"), F.aggregate(F.transform(F.split(text, ":"), lambda x: x.try_cast("int")), F.lit(0), lambda a, x: a * 60 + x))).otherwise(F.bround(text.try_cast("double"), 0).cast("int"))


# --- addresses ---------------------------------------------------------------


def channel_handle(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"youtube\.com/(@[^/?#]+)", 1)


def video_url(video_id: Column, url: Column) -> Column:
    u = text_or_empty(url)
    return F.when(u.rlike("^https?://"), u).otherwise(F.concat(F.lit("https://www.youtube.com/watch?v="), video_id))


def video_id(value: Column) -> Column:
    """The id itself, or the first that the known forms of addresses hold; empty otherwise."""
    v = text_or_empty(value)
    found = [F.nullif(F.regexp_extract(v, p, 1), F.lit("")) for p in ID_PATTERNS]
    return F.when(v.rlike(VIDEO_ID), v).otherwise(F.coalesce(*found, F.lit("")))


def playlist_id(value: Column) -> Column:
    """What ``list=`` holds, or the trimmed value; nothing at all is an error."""
    v = text_or_empty(value)
    out = F.when(v.contains("list="), F.regexp_extract(v, "list=([^&]*)", 1)).otherwise(v)
    return F.when(out != "", out).otherwise(F.raise_error(F.lit("no playlist id")).cast("string"))


# --- signatures --------------------------------------------------------------


def signature(version: int, *parts: Column | str) -> Column:
    """``v<version>|`` and 16 digits of the SHA-1 of the version and the parts, joined by double bars."""
    columns = [F.lit(str(version)), *(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts)]
    return F.concat(F.lit(f"v{version}|"), F.substring(F.sha1(F.concat_ws("||", *columns)), 1, 16))


def analysis_signature(edge_seconds: float = 30, silence_db: float = 35, flow: str = "deep-dj", version: int = 1) -> str:
    return f"v{version}|edge={edge_seconds:g}|silence={silence_db:g}|flow={flow}"


def slug(text: str) -> str:
    kept = "".join(ch if ch.isalnum() else "-" for ch in text.strip().lower())
    return "-".join(p for p in kept.split("-") if p) or "item"
