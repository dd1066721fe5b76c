"""Derived features: scaling by whole-column statistics, mood, tempo, keys and components."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from .values import NUMBER, clip, has, min_max, number

MOODS = ("sentiment_valence", "sentiment_arousal", "sentiment_tension", "sentiment_warmth")
MOOD_PREFIXES = ("", "intro_", "outro_")


def with_statistics(df: DataFrame, **statistics: Column) -> DataFrame:
    """The table with each aggregate of the whole table as a column, by a broadcast of its one row."""
    return df.crossJoin(F.broadcast(df.agg(*(v.alias(k) for k, v in statistics.items()))))


def feature(df: DataFrame, name: str, default: float = 0.0) -> Column:
    """A loose number, the default where it is missing or the table lacks the column."""
    if not has(df, name):
        return F.lit(float(default))
    c = F.col(f"`{name}`")
    return F.coalesce(c.cast("double") if isinstance(df.schema[name].dataType, NumericType) else number(c), F.lit(float(default)))


def feature_sql(df: DataFrame, name: str, default: float = 0.0) -> str:
    """As :func:`feature`, as SQL text."""
    if not has(df, name):
        return f"{float(default)}D"
    text = f"trim(cast(`{name}` as string))"
    value = f"cast(`{name}` as double)" if isinstance(df.schema[name].dataType, NumericType) else f"if({text} rlike r'{NUMBER}', try_cast({text} as double), null)"
    return f"coalesce({value}, {float(default)}D)"


# --- scaling -----------------------------------------------------------------


def add_log_tempo(df: DataFrame, tempo: str = "tempo", out: str = "log_tempo") -> DataFrame:
    """log2 of the tempo, the median where it is missing; 0 where the table lacks it."""
    if not has(df, tempo):
        return df.withColumn(out, F.lit(0.0))
    t = number(F.col(f"`{tempo}`"))
    return with_statistics(df, _middle=F.percentile(t, F.lit(0.5))).withColumn(out, F.log2(F.coalesce(t, F.col("_middle")) + F.lit(1e-6))).drop("_middle")


def add_adaptive(df: DataFrame, columns: Mapping[str, tuple[str, float, bool]]) -> DataFrame:
    """Columns scaled by their 5th and 95th percentile (by the extremes where these are equal) into 0..1.

    ``columns``: new name -> (column, default for missing values, whether to invert).
    A constant column becomes its default.  All statistics come from one pass.
    """
    stats = {}
    for k, (name, default, _) in enumerate(columns.values()):
        v = feature(df, name, default)
        stats |= {f"_q{k}": F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))), f"_lo{k}": F.min(v), f"_hi{k}": F.max(v)}
    wide = with_statistics(df, **stats)
    made = {}
    for k, (out, (name, default, invert)) in enumerate(columns.items()):
        v, q = feature(df, name, default), F.col(f"_q{k}")
        inner = q[1] > q[0]
        lo, hi = F.when(inner, q[0]).otherwise(F.col(f"_lo{k}")), F.when(inner, q[1]).otherwise(F.col(f"_hi{k}"))
        scaled = F.when(hi > lo, clip((v - lo) / (hi - lo))).otherwise(F.lit(min(max(float(default), 0.0), 1.0)))
        made[out] = F.lit(1.0) - scaled if invert else scaled
    return wide.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *(c.alias(k) for k, c in made.items()))


def add_robust(df: DataFrame, columns: Sequence[str], suffix: str = "_scaled") -> DataFrame:
    """(x - median) / interquartile range, by 1 where the range is 0; missing values count as 0."""
    stats = {f"_q{k}": F.percentile(feature(df, c), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))) for k, c in enumerate(columns)}
    wide = with_statistics(df, **stats)
    made = []
    for k, c in enumerate(columns):
        q = F.col(f"_q{k}")
        width = q[2] - q[0]
        made.append(((feature(df, c) - q[1]) / F.when(width == 0, F.lit(1.0)).otherwise(width)).alias(c + suffix))
    return wide.select(*(F.col(f"`{c}`") for c in df.columns), *made)


def principal_components(df: DataFrame, columns: Sequence[str], retained: float = 0.95, out: str = "components") -> DataFrame:
    """Robustly scaled columns projected on the components that retain the share of the variance (an array column).

    The covariance is one aggregate of the whole table, its eigenvectors a small
    driver computation; the projection is column arithmetic.  Signs: a component's
    largest weight is positive.  A single column is only scaled.
    """
    scaled = add_robust(df, columns, "_pc")
    names = [c + "_pc" for c in columns]
    if len(names) == 1:
        return scaled.withColumn(out, F.array(F.col(f"`{names[0]}`"))).drop(*names)
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = scaled.agg(*(F.avg(f"`{n}`").alias(f"m{k}") for k, n in enumerate(names)), *(F.covar_pop(f"`{names[i]}`", f"`{names[j]}`").alias(f"c{i}_{j}") for i, j in pairs)).first()
    mean = np.array([row[f"m{k}"] or 0.0 for k in range(len(names))])
    cov = np.zeros((len(names), len(names)))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"] or 0.0
    value, vector = np.linalg.eigh(cov)
    value, vector = np.maximum(value[::-1], 0), vector[:, ::-1]
    share = np.cumsum(value) / max(value.sum(), 1e-300)
    kept = int(np.searchsorted(share, retained) + 1) if value.sum() > 0 else 1
    vector = vector[:, :kept] * np.sign(vector[np.abs(vector).argmax(axis=0), np.arange(vector.shape[1])][:kept])
    made = [sum(((F.col(f"`{n}`") - F.lit(float(mean[i]))) * F.lit(float(vector[i, k])) for i, n in enumerate(names)), F.lit(0.0)) for k in range(vector.shape[1])]
    return scaled.withColumn(out, F.array(*made)).drop(*names)


# --- mood --------------------------------------------------------------------


def mood_columns(df: DataFrame, prefix: str = "") -> dict[str, Column]:
    """Valence, arousal, tension and warmth from the descriptors of a prefix."""
    f = lambda name, default=0.0: feature(df, prefix + name, default)
    within = lambda name, lo, hi: min_max(f(name), lo, hi)
    onset, bright, flat = within("onset_strength", 0, 5), within("spectral_centroid", 1000, 5000), within("spectral_flatness", 0, 0.5)
    crossings, pace, major = within("zcr", 0, 0.2), within("tempo", 60, 180), clip(f("mode", 1.0))
    harmonic, valence = f("harmonic_ratio"), f("valence")
    rest = lambda c: F.lit(1.0) - c
    mixed = lambda *terms: clip(sum((F.lit(w) * c for w, c in terms[1:]), F.lit(terms[0][0]) * terms[0][1]))
    rough = mixed((0.45, flat), (0.35, crossings), (0.20, rest(harmonic)))
    return {
        f"{prefix}sentiment_valence": mixed((0.55, valence), (0.20, major), (0.15, bright), (0.10, rest(rough))),
        f"{prefix}sentiment_arousal": mixed((0.35, f("energy")), (0.20, f("danceability")), (0.20, onset), (0.15, pace), (0.10, bright)),
        f"{prefix}sentiment_tension": mixed((0.35, rough), (0.25, onset), (0.20, rest(valence)), (0.20, rest(harmonic))),
        f"{prefix}sentiment_warmth": mixed((0.35, harmonic), (0.25, f("acousticness")), (0.25, rest(bright)), (0.15, rest(f("speechiness")))),
    }


def add_moods(df: DataFrame, prefixes: Sequence[str] = MOOD_PREFIXES) -> DataFrame:
    """The moods of each prefix; those that are there without a null in any row stay as they are."""
    made: dict[str, Column] = {}
    full = [p for p in prefixes if all(has(df, p + m) for m in MOODS)]
    nulls = df.agg(*(F.count_if(F.greatest(*(F.col(f"`{p}{m}`").isNull().cast("int") for m in MOODS)) > 0).alias(f"n{k}") for k, p in enumerate(full))).first() if full else []
    done = {p for p, n in zip(full, nulls, strict=True) if not n}
    for p in prefixes:
        if p not in done:
            made |= mood_columns(df, p)
    return df.select(*(F.col(f"`{c}`") for c in df.columns if c not in made), *(c.alias(k) for k, c in made.items()))


# --- keys --------------------------------------------------------------------

_MAJOR = "6.35 2.23 3.48 2.33 4.38 4.09 2.52 5.19 2.39 3.66 2.29 2.88"
_MINOR = "6.33 2.68 3.52 5.38 2.60 3.53 2.54 4.75 3.98 2.69 3.34 3.17"


def key_profiles() -> np.ndarray:
    """float[mode, key, 12]: the unit probe-tone profiles (mode 1 is major), rolled left by the key."""
    both = np.array([[float(x) for x in m.split()] for m in (_MINOR, _MAJOR)])
    both /= np.linalg.norm(both, axis=1, keepdims=True)
    return np.stack([np.stack([np.roll(m, -k) for k in range(12)]) for m in both])


def key_table() -> list[tuple[int, int, float]]:
    """(code, code, similarity) of the 24 keys; a code is mode * 12 + key."""
    p = key_profiles().reshape(24, 12)
    s = np.clip(p @ p.T, 0, 1)
    return [(i, j, float(s[i, j])) for i in range(24) for j in range(24)]


def key_code(df: DataFrame, key: str, mode: str) -> Column:
    """mode * 12 + key; key 0 and mode 1 where they are missing; modes other than 1 are minor."""
    k = F.pmod(feature(df, key, 0.0).cast("int"), F.lit(12))
    return F.when(feature(df, mode, 1.0).cast("int") == 1, k + 12).otherwise(k)


def key_similarity(a: Column, b: Column) -> Column:
    """The similarity of two key codes, from a literal table of 24 by 24."""
    table = F.array(*(F.lit(s) for _, _, s in key_table()))
    return F.element_at(table, (a * 24 + b + 1).cast("int"))
