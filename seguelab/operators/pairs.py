"""Directed scores of all pairs of tracks: how one ends against how the other begins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.features import MOODS, add_adaptive, add_moods, feature, key_code, key_similarity
from ..functions.values import clip, has, weighted_mean
from ..session import materialize
from .blocks import LEAST_ROWS, PairScores

TIMBRE = ("acousticness", "harmonic_ratio", *(f"mfcc{k}" for k in range(1, 6)), "spectral_bandwidth", "spectral_centroid", "spectral_rolloff")
GROOVE = ("danceability", "energy", "loudness", "onset_strength", "tempo")
HANDOFF = ("intro_attack_time_s", "intro_flux_peak", "intro_rise_slope", "outro_abruptness", "outro_release_time_s", "outro_tail_silence_s")
#: How an ending's feature meets a beginning's: weight and scale of their difference.
STRUCTURE = {
    ("onset_density", "onset_density"): (0.20, 0.28),
    ("flux_peak", "flux_peak"): (0.16, 0.25),
    ("beat_stability", "beat_stability"): (0.18, 0.22),
    ("tail_silence_s", "pad_silence_s"): (0.14, 0.30),
    ("downbeat_strength", "downbeat_strength"): (0.16, 0.20),
    ("chroma_stability", "chroma_stability"): (0.16, 0.20),
}
WEIGHTS = {"edge_flow": 0.30, "structure": 0.20, "timbre": 0.20, "groove": 0.10, "sentiment": 0.10, "tonal": 0.10}
#: Bytes of compact features that are broadcast to all others; a larger pool is joined by blocks.
BROADCAST_BYTES = 64 << 20


def similarity(a: Column, b: Column, scale: float = 0.25) -> Column:
    """exp(-|a - b| / scale)."""
    return F.exp(-F.abs(a - b) / F.lit(max(float(scale), 1e-6)))


def aligned(df: DataFrame, names: Sequence[str], a: str = "outro_", b: str = "intro_") -> list[str]:
    """The features that the table has on both sides."""
    return [n for n in names if has(df, a + n) and has(df, b + n)]


def add_side_scales(df: DataFrame, names: Sequence[str], a: str = "outro_", b: str = "intro_") -> DataFrame:
    """``e_<name>`` and ``b_<name>``: both sides scaled by the median and interquartile range of the two together."""
    if not names:
        return df
    side = lambda p: F.struct(*(feature(df, p + n).alias(n) for n in names))
    stacked = df.select(F.explode(F.array(side(a), side(b))).alias("x"))
    stats = stacked.agg(*(F.percentile(F.col(f"x.{n}"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"_q_{n}") for n in names))
    wide = df.crossJoin(F.broadcast(stats))
    made = []
    for n in names:
        q = F.col(f"_q_{n}")
        width = F.when(q[2] == q[0], F.lit(1.0)).otherwise(q[2] - q[0])
        made += [((feature(df, p + n) - q[1]) / width).alias(f"{s}_{n}") for p, s in ((a, "e"), (b, "b"))]
    return wide.select(*(F.col(f"`{c}`") for c in df.columns), *made)


def closeness(names: Sequence[str], left: str = "l", right: str = "r") -> Column:
    """exp of minus the mean difference of the scaled sides."""
    total = sum((F.abs(F.col(f"{left}.e_{n}") - F.col(f"{right}.b_{n}")) for n in names), F.lit(0.0))
    return F.exp(-total / F.lit(float(len(names))))


def edge_flow(l: str = "l", r: str = "r") -> Column:  # noqa: E741
    """How an ending hands over to a beginning; of columns that :func:`prepare` made."""
    e, b = (lambda n: F.col(f"{l}.n_outro_{n}")), (lambda n: F.col(f"{r}.n_intro_{n}"))
    one = F.lit(1.0)
    hard = clip(F.lit(0.60) * (one - b("attack_time_s")) + F.lit(0.40) * b("flux_peak"))
    gradual = clip(F.lit(0.55) * b("attack_time_s") + F.lit(0.30) * (one - b("rise_slope")) + F.lit(0.15) * (one - b("flux_peak")))
    unready = clip(one - F.greatest(e("tail_silence_s"), F.lit(0.6) * e("release_time_s")))
    gains = F.lit(0.28) * e("abruptness") * hard + F.lit(0.24) * e("release_time_s") * gradual + F.lit(0.18) * e("tail_silence_s") * hard
    locks = F.lit(0.15) * e("downbeat_strength") * b("downbeat_strength") + F.lit(0.15) * e("chroma_stability") * b("chroma_stability")
    return clip(gains + locks - F.lit(0.12) * unready * hard)


def structure(l: str = "l", r: str = "r") -> Column:  # noqa: E741
    """How alike an ending and a beginning are in their rhythm and texture."""
    return clip(sum((F.lit(w) * similarity(F.col(f"{l}.n_outro_{e}"), F.col(f"{r}.n_intro_{b}"), s) for (e, b), (w, s) in STRUCTURE.items()), F.lit(0.0)))


def prepare(df: DataFrame, index: str = "track_idx") -> tuple[DataFrame, dict[str, object]]:
    """One narrow row for each track with all that its pairs need, and the components that are there."""
    df = materialize(add_moods(df), "moods")
    names = {"timbre": aligned(df, TIMBRE), "groove": aligned(df, GROOVE), "sentiment": aligned(df, MOODS)}
    has_flow = all(has(df, c) for c in HANDOFF)
    has_structure = all(has(df, f"outro_{e}") and has(df, f"intro_{b}") for e, b in STRUCTURE)
    adaptive = {}
    if has_flow or has_structure:
        for e, b in STRUCTURE:
            adaptive |= {f"n_outro_{e}": (f"outro_{e}", 0.0, False), f"n_intro_{b}": (f"intro_{b}", 0.0, False)}
        adaptive |= {f"n_{c}": (c, 0.0, False) for c in HANDOFF}
    every = list(dict.fromkeys(n for v in names.values() for n in v))
    wide = add_side_scales(add_adaptive(df, adaptive) if adaptive else df, every)
    slim = wide.select(
        F.col(f"`{index}`").alias("idx"),
        key_code(df, "outro_key", "outro_mode").alias("e_key"),
        key_code(df, "intro_key", "intro_mode").alias("b_key"),
        *(F.col(k) for k in adaptive),
        *(F.col(f"{s}_{n}") for n in every for s in "eb"),
    )
    return materialize(slim, "tracks"), {"edge_flow": has_flow, "structure": has_structure, **names}


def cross(slim: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """All ordered pairs of rows, as ``l`` and ``r``: the broadcast of a pool of a checked size in bytes, or a product by blocks.

    The left side of a broadcast is spread over the cores: a pool is a small file,
    all pairs of which would else be one task.
    """
    texts = [F.coalesce(F.octet_length(F.col(f"`{f.name}`")), F.lit(0)) for f in slim.schema.fields if f.dataType.simpleString() == "string"]
    row = F.lit(16 * len(slim.columns)) + sum(texts, F.lit(0))
    size = slim.agg(F.sum(row).alias("bytes"), F.count("*").alias("n")).first()
    if (size["bytes"] or 0) > most:
        return slim.alias("l").crossJoin(slim.hint("shuffle_replicate_nl").alias("r"))
    return spread(slim, size["n"]).alias("l").crossJoin(F.broadcast(slim).alias("r"))


def spread(df: DataFrame, n: int) -> DataFrame:
    """A table of ``n`` rows that take long each, in a few parts for each core."""
    parts = min(4 * df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS))
    return df.repartition(parts) if parts > 1 else df


def rounded(c: Column, digits: int) -> Column:
    """As ``F.round`` of numbers from 0 to 1, which goes by decimal texts: they are made only where the number is all but a half."""
    scaled = c * F.lit(10.0**digits)
    near = F.rint(scaled)
    return F.when(F.abs(F.abs(scaled - near) - F.lit(0.5)) > F.lit(1e-5), near / F.lit(10.0**digits)).otherwise(F.round(c, digits))


def pool_scores(df: DataFrame, index: str = "track_idx", digits: int | None = 9) -> PairScores:
    """The scores of all ordered pairs, as :func:`score_pairs` without a model has them, for what needs no table of them."""
    return PairScores(*prepare(df, index), digits)


def score_pairs(df: DataFrame, index: str = "track_idx", model: DataFrame | None = None, model_weight: float = 0.0, components: bool = False) -> DataFrame:
    """(from_idx, to_idx, score) of all ordered pairs, 0 where both are the same track.

    The score is the weighted mean of the components that the table's columns allow.
    ``model``: (from_idx, to_idx, score) of a trained model, one more component.
    A failure of the model is an error.  ``components`` adds each component's column.
    """
    if model_weight < 0:
        raise ValueError("the model's weight must not be negative")
    slim, there = prepare(df, index)
    return score_met(cross(slim), there, model, model_weight, components)


def score_met(pairs: DataFrame, there: dict[str, object], model: DataFrame | None = None, model_weight: float = 0.0, components: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    """The scores of given pairs of prepared rows ``l`` and ``r``."""
    parts: dict[str, Column | None] = {
        "edge_flow": edge_flow() if there["edge_flow"] else None,
        "structure": structure() if there["structure"] else None,
        **{k: closeness(there[k]) if there[k] else None for k in ("timbre", "groove", "sentiment")},
        "tonal": key_similarity(F.col("l.e_key"), F.col("r.b_key")),
    }
    made = pairs.select(*keep, F.col("l.idx").alias("from_idx"), F.col("r.idx").alias("to_idx"), *(c.alias(k) for k, c in parts.items() if c is not None))
    weights = dict(WEIGHTS)
    parts = {k: F.col(k) for k, c in parts.items() if c is not None}
    if model is not None and model_weight > 0:
        made = made.join(model.select("from_idx", "to_idx", F.col("score").alias("model")), ["from_idx", "to_idx"], "left")
        parts["model"], weights["model"] = F.coalesce(F.col("model"), F.lit(0.0)), float(model_weight)
    score = F.when(F.col("from_idx") == F.col("to_idx"), F.lit(0.0)).otherwise(weighted_mean(parts, weights))
    return made.select(*keep, "from_idx", "to_idx", score.alias("score"), *(F.col(k) for k in parts if components))


def score_steps(steps: DataFrame, scores: PairScores) -> DataFrame:
    """``steps`` (from_idx, to_idx and more) with the ``score`` of each."""
    keep = [c for c in steps.columns if c not in ("from_idx", "to_idx")]
    met = steps.join(scores.slim.alias("l"), F.col("from_idx") == F.col("l.idx")).join(scores.slim.alias("r"), F.col("to_idx") == F.col("r.idx"))
    out = score_met(met.drop("from_idx", "to_idx"), scores.there, keep=keep)
    return out if scores.digits is None else out.withColumn("score", F.round("score", scores.digits))


def top_edges(edges: DataFrame, most: int) -> DataFrame:
    """Each track's best edges, lower indexes first among equals."""
    order = Window.partitionBy("from_idx").orderBy(F.desc("score"), "to_idx")
    return edges.filter("from_idx <> to_idx").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).drop("rank")


def tonal_pairs(df: DataFrame, index: str = "track_idx", key: str = "key", mode: str = "mode", to_key: str | None = None, to_mode: str | None = None) -> DataFrame:
    """(from_idx, to_idx, score): how well the keys of each ordered pair agree."""
    slim = df.select(F.col(f"`{index}`").alias("idx"), key_code(df, key, mode).alias("e"), key_code(df, to_key or key, to_mode or mode).alias("b"))
    return cross(slim).select(F.col("l.idx").alias("from_idx"), F.col("r.idx").alias("to_idx"), key_similarity(F.col("l.e"), F.col("r.b")).alias("score"))
