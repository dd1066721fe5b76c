"""Missing values, loose numbers, column names, bounded and banded scores."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FEATURES = (
    "acousticness danceability energy harmonic_ratio key liveness loudness mode onset_strength rms "
    "spectral_bandwidth spectral_centroid spectral_flatness spectral_rolloff speechiness tempo valence zcr"
).split()
EXTRA_NUMBERS = {"genre_confidence", "intro_leading_silence_s", "intro_seconds_used", "outro_seconds_used", "outro_trailing_silence_s"}
NUMBER_PREFIXES = ("intro_", "outro_", "sentiment_")
ANALYSED = ("tempo", "key", "mode", "intro_tempo", "outro_tempo", "intro_seconds_used", "outro_seconds_used")
ANALYSED_DEEP = (*ANALYSED, "intro_attack_time_s", "intro_flux_peak", "outro_abruptness", "outro_release_time_s")
BANDS = ((0.80, "excellent"), (0.65, "strong"), (0.50, "good"), (0.35, "mixed"))
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def has(df: DataFrame, name: str) -> bool:
    return name in df.columns


def col_or(df: DataFrame, name: str, default) -> Column:
    """The column, or a literal where the table lacks it (decided when the plan is built)."""
    return F.col(f"`{name}`") if has(df, name) else F.lit(default)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: make it null, once, on the way in."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*(F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns))


def blank(c: Column) -> Column:
    """Null, or nothing but spaces."""
    return c.isNull() | (F.trim(c.cast("string")) == "")


def filled(c: Column) -> Column:
    """The value, null where it is blank."""
    return F.when(~blank(c), c)


def number(c: Column) -> Column:
    """A double from loose text, null where it doesn't parse; type suffixes as in ``1d`` don't count as numbers."""
    text = F.trim(c.cast("string"))
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def is_feature_name(name: str) -> bool:
    low = name.strip().lower()
    return low in FEATURES or low in EXTRA_NUMBERS or low.startswith(NUMBER_PREFIXES)


def coerce_features(df: DataFrame) -> DataFrame:
    """Known features, by name or prefix, as doubles."""
    return df.select(*(number(F.col(f"`{c}`")).alias(c) if is_feature_name(c) else F.col(f"`{c}`") for c in df.columns))


def rename_features(df: DataFrame) -> DataFrame:
    """Known features under their lower-case names; two columns of one such name are an error."""
    names = [c.strip().lower() if c.strip().lower() in FEATURES else c for c in df.columns]
    twice = {n for n in names if n in FEATURES and names.count(n) > 1}
    if twice:
        raise ValueError(f"columns clash after renaming: {sorted(twice)}")
    return df.toDF(*names)


def trim_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*(c.strip() for c in df.columns))


def clip(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Within the bounds; for values that aren't null, so that nested ones stay small expressions."""
    return F.least(F.greatest(c, F.lit(float(low))), F.lit(float(high)))


def clip_or_null(c: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.when(c.isNotNull(), clip(c, low, high))


def min_max(c: Column, low: float, high: float) -> Column:
    """Where a value lies between fixed bounds, 0 to 1; 0 for missing values and where the bounds don't rise."""
    if high <= low:
        return F.lit(0.0)
    return clip((F.coalesce(c.cast("double"), F.lit(0.0)) - F.lit(float(low))) / F.lit(float(high - low)))


def rating(score: Column) -> Column:
    """The band of a transition's score; no score means the start of a list."""
    out = F.when(score.isNull() | F.isnan(score.cast("double")), F.lit("start"))
    for least, name in BANDS:
        out = out.when(score >= F.lit(least), F.lit(name))
    return out.otherwise(F.lit("rough"))


def rating_sql(score: str) -> str:
    return f"case when {score} is null then 'start' " + " ".join(f"when {score} >= {b}::DOUBLE then '{n}'" for b, n in BANDS) + " else 'rough' end"


def group_name(c: Column) -> Column:
    """A group's first name in lower case: up to a comma, semicolon, slash or bar; ``unknown`` where there is none."""
    return F.coalesce(F.nullif(F.trim(F.element_at(F.split(F.lower(F.trim(c)), "[,;/|]"), 1)), F.lit("")), F.lit("unknown"))


def present(df: DataFrame, columns: Iterable[str]) -> Column:
    """Whether all the columns have values; a column that the table lacks has none."""
    return reduce(lambda a, b: a & b, (F.col(f"`{c}`").isNotNull() if has(df, c) else F.lit(False) for c in columns), F.lit(True))


def analysed(df: DataFrame, deep: bool = True) -> Column:
    return present(df, ANALYSED_DEEP if deep else ANALYSED)


def first_column(df: DataFrame, candidates: Iterable[str]) -> str | None:
    return next((c for c in candidates if has(df, c)), None)


def known_first(df: DataFrame, known: Iterable[str], fill: bool = False) -> DataFrame:
    """Known columns in their order, then the others by name; ``fill`` adds the missing known ones as nulls."""
    known = list(known)
    front = [F.col(f"`{c}`") if has(df, c) else F.lit(None).cast("string").alias(c) for c in known if fill or has(df, c)]
    return df.select(*front, *(F.col(f"`{c}`") for c in sorted(c for c in df.columns if c not in known)))


def weighted_mean(parts: Mapping[str, Column | None], weights: Mapping[str, float]) -> Column:
    """Of the parts that are there, by their weights, within 0 and 1."""
    there = {k: v for k, v in parts.items() if v is not None}
    if not there:
        raise ValueError("no component to combine")
    total = sum(weights[k] for k in there)
    return clip(reduce(lambda a, b: a + b, (F.lit(float(weights[k])) * v for k, v in there.items())) / F.lit(float(total)))


def human_bytes(c: Column) -> Column:
    """Bytes with a unit and one decimal; below zero counts as zero."""
    c = F.greatest(c, F.lit(0)).cast("double")
    out, units = None, ("KB", "MB", "GB", "TB")
    for k in range(len(units), 0, -1):
        test, shown = c >= F.lit(1024.0**k), F.format_string(f"%.1f {units[k - 1]}", F.bround(c / F.lit(1024.0**k), 1))
        out = F.when(test, shown) if out is None else out.when(test, shown)
    return out.otherwise(F.format_string("%.1f B", c))
