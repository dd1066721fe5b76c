"""Categories of tracks: weighted keywords, votes of text fields, nearest prototypes, clusters, and their cascade."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.features import add_log_tempo, add_moods, add_robust, feature_sql
from ..functions.values import clip, has
from ..session import materialize

CONFIDENT = 0.55
UNKNOWN = "unknown"
_KEYWORDS = """
pop: dance pop; electropop; pop; synthpop; teen pop
rock: arena rock; classic rock; grunge; hard rock; rock
indie_alt: alt; alternative; dream pop; indie; lofi indie; new wave; post punk; shoegaze
electronic: breakbeat; dnb; downtempo; drum and bass; edm; electro; electronic; electronica; synthwave
house_techno: deep house; house; minimal; progressive house; tech house; techno; trance
hip_hop_rap: boom bap; drill; hip hop; hip hop; rap; trap
rnb_soul: funk; motown; neo soul; r&b; rnb; soul
jazz: bebop; blue note; bossa; fusion; jazz; sax; swing
ambient_chill: ambient; chill; chillout; drone; lofi; meditation; new age; study beats
folk_acoustic: acoustic; americana; country folk; folk; singer songwriter; singer songwriter
latin_world: afrobeat; afrobeats; bossa nova; brazil; cumbia; flamenco; latin; reggaeton; salsa; world
classical_score: classical; film score; instrumental score; opera; orchestral; piano; score; soundtrack
metal_punk: death metal; emo; hardcore; metal; punk; screamo; thrash
"""
#: Genre -> keywords; one that is listed twice counts twice.
KEYWORDS = {g.strip(): [w.strip() for w in ws.split(";")] for g, ws in (line.split(":") for line in _KEYWORDS.strip().splitlines())}
FIELDS = {"title": 0.75, "artist": 0.55, "uploader": 0.50, "channel": 0.45, "tags": 0.95, "category": 0.90, "description": 0.35, "genre": 1.00, "genres": 1.00}
PROTOTYPE_FEATURES = ("danceability", "energy", "acousticness", "speechiness", "tempo_norm", "sentiment_valence", "sentiment_arousal", "sentiment_warmth", "harmonic_ratio")
_PROTOTYPES = """
pop 65 60 20 12 55 65 62 45 45
rock 45 78 15 8 55 48 72 35 38
indie_alt 42 58 28 8 46 42 50 48 50
electronic 72 74 8 8 63 56 76 28 32
house_techno 82 80 4 5 72 56 82 22 25
hip_hop_rap 76 62 12 45 48 46 66 34 30
rnb_soul 62 48 18 16 42 58 48 72 60
jazz 38 36 66 8 44 54 34 68 78
ambient_chill 28 22 52 5 24 50 18 72 70
folk_acoustic 36 30 82 8 34 58 26 78 76
latin_world 74 68 28 14 62 68 72 52 55
classical_score 12 24 90 2 26 42 22 62 88
metal_punk 34 90 4 12 68 28 88 18 22
"""
PROTOTYPES = {p[0]: tuple(int(x) / 100 for x in p[1:]) for p in (line.split() for line in _PROTOTYPES.strip().splitlines())}
STYLE_FEATURES = "danceability energy speechiness acousticness liveness valence log_tempo spectral_centroid spectral_bandwidth spectral_flatness harmonic_ratio sentiment_valence sentiment_arousal sentiment_tension sentiment_warmth".split()
RESOLVED = ("style_cluster", "genre_primary", "genre_confidence", "genre_source", "mix_group")


def _best_two(scores: Sequence[tuple[str, str]], picked: str) -> str:
    """SQL for ``picked``, of the sorted scores ``r``: r[0].n is the best name, -r[0].s and -r[1].s are the best two scores; of equals the earlier in the list.

    Text, not column objects: hundreds of these would take longer to make than to run.
    """
    rows = ", ".join(f"struct(-({c}) as s, {k} as k, '{n}' as n)" for k, (n, c) in enumerate(scores))
    return f"transform(array(array_sort(array({rows}))), r -> {picked})[0]"


def _clip_sql(c: str, high: float = 1.0) -> str:
    return f"least(greatest({c}, 0D), {high}D)"


_NO_GENRE = f"struct('{UNKNOWN}' as genre, 0D as confidence)"


def keyword_genre(name: str) -> Column:
    """struct(genre, confidence) of a column's text; unknown and 0 where no keyword is in it.

    A genre's weight is the sum of its keywords' in the text: 1, and 0.15 for each
    further word of a keyword.
    """
    text = f"regexp_replace(regexp_replace(regexp_replace(lower(coalesce(cast(`{name}` as string), '')), '[_-]', ' '), '[^a-z0-9& ]+', ' '), ' +', ' ')"
    hit = lambda w: f"if(contains(x, ' {w} '), {1 + 0.15 * w.count(' ')}D, 0D)"
    found = _clip_sql("0.60D + 0.12D * -r[0].s + 0.08D * (-r[0].s + r[1].s)", 0.98)
    best = _best_two([(g, " + ".join(map(hit, ws))) for g, ws in KEYWORDS.items()], f"if(r[0].s < 0, struct(r[0].n as genre, {found} as confidence), {_NO_GENRE})")
    return F.expr(f"transform(array(concat(' ', trim({text}), ' ')), x -> {best})[0]")


def add_field_votes(df: DataFrame, out: str = "vote") -> DataFrame:
    """struct(genre, confidence) by the weighted votes of the text fields that the table has."""
    fields = [f for f in FIELDS if has(df, f)]
    if not fields:
        return df.withColumn(out, F.struct(F.lit(UNKNOWN).alias("genre"), F.lit(0.0).alias("confidence")))
    wide = df.withColumns({f"_m{k}": keyword_genre(f) for k, f in enumerate(fields)})
    votes = F.array(*(F.struct(F.col(f"_m{k}.genre").alias("g"), (F.col(f"_m{k}.confidence") * FIELDS[f]).alias("s"), F.lit(k).alias("k")) for k, f in enumerate(fields)))
    known = F.filter(votes, lambda v: v["g"] != UNKNOWN)
    names = F.array_distinct(F.transform(known, lambda v: v["g"]))
    sums = F.transform(names, lambda g: F.struct((-F.aggregate(F.filter(known, lambda v: v["g"] == g), F.lit(0.0), lambda a, v: a + v["s"])).alias("s"), F.array_position(names, g).alias("k"), g.alias("g")))
    wide = wide.withColumn("_r", F.array_sort(sums))
    best, second = -F.col("_r")[0]["s"], F.coalesce(-F.try_element_at("_r", F.lit(2))["s"], F.lit(0.0))
    found = F.struct(F.col("_r")[0]["g"].alias("genre"), clip(F.lit(0.50) + F.lit(0.20) * best + F.lit(0.15) * (best - second), 0, 0.95).alias("confidence"))
    picked = F.when(F.size("_r") > 0, found).otherwise(F.struct(F.lit(UNKNOWN).alias("genre"), F.lit(0.0).alias("confidence")))
    return wide.withColumn(out, picked).drop("_r", *(f"_m{k}" for k in range(len(fields))))


def _library_exp(x: pd.Series) -> pd.Series:
    """exp of the numbers of arrays by the C library.

    SQL engines take theirs from it; Spark's own differs from it in the last bit at
    times, and so keeps scores apart that are equal there.
    """
    return x.map(lambda v: [math.exp(a) for a in v])


def nearest_prototype(df: DataFrame) -> Column:
    """struct(genre, confidence) of the prototype with the least mean difference over the nine features."""
    value = {n: _clip_sql(f"({feature_sql(df, 'tempo')} - 60D) / 120D") if n == "tempo_norm" else feature_sql(df, n) for n in PROTOTYPE_FEATURES}
    powers = []
    for p in PROTOTYPES.values():
        total = " + ".join(f"abs({value[n]} - {x}D)" for n, x in zip(PROTOTYPE_FEATURES, p, strict=True))
        powers.append(f"-({total}) / {float(len(p))}D")
    names = F.array(*map(F.lit, PROTOTYPES))
    scores = F.pandas_udf(_library_exp, T.ArrayType(T.DoubleType()))(F.expr(f"array({', '.join(powers)})"))
    ranked = F.array_sort(F.transform(scores, lambda s, k: F.struct((-s).alias("s"), k.alias("k"))))
    best, second = (lambda r: -r[0]["s"]), (lambda r: -r[1]["s"])
    found = lambda r: clip(F.lit(0.30) + F.lit(0.45) * best(r) + F.lit(0.35) * (best(r) - second(r)), 0, 0.90)
    return F.transform(F.array(ranked), lambda r: F.struct(names[r[0]["k"]].alias("genre"), found(r).alias("confidence")))[0]


def add_style_clusters(df: DataFrame, clusters: int = 8, seed: int = 42, index: str = "track_idx") -> DataFrame:
    """``style_cluster``: k-means over robustly scaled features; a single cluster where there are no features or rows to part."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import VectorAssembler

    wide = df if has(df, "log_tempo") else add_log_tempo(df)
    names = [n for n in STYLE_FEATURES if has(wide, n) and (n != "log_tempo" or has(df, "tempo") or has(df, "log_tempo"))]
    if not names:
        return df.withColumn("style_cluster", F.lit("cluster_00"))
    scaled = add_robust(wide, names, "_style")
    # no more clusters than there are different rows
    n = scaled.select(*(F.col(f"`{c}_style`") for c in names)).distinct().limit(max(2, clusters)).count()
    if n <= 1:
        return df.withColumn("style_cluster", F.lit("cluster_00"))
    table = VectorAssembler(inputCols=[c + "_style" for c in names], outputCol="_features").transform(scaled)
    model = KMeans(k=min(max(2, clusters), n), seed=seed, featuresCol="_features", predictionCol="_cluster").fit(table.select("_features"))
    return model.transform(table).withColumn("style_cluster", F.format_string("cluster_%02d", "_cluster")).select(*(F.col(f"`{c}`") for c in df.columns if c != "style_cluster"), "style_cluster")


def resolve_genres(df: DataFrame, genre_column: str | None = None, clusters: int = 8) -> DataFrame:
    """``style_cluster``, ``genre_primary``, ``genre_confidence``, ``genre_source`` and ``mix_group`` of each row.

    An explicit column comes first, then the votes of the text fields, then the
    nearest prototype.  Below the confidence bound the genre is unknown and the
    mix group is the style cluster.
    """
    wide = materialize(add_style_clusters(materialize(add_moods(df), "moods"), clusters), "clusters")
    explicit = list(dict.fromkeys(c for c in (genre_column, "genre", "genres") if c and has(df, c)))
    wide = wide.withColumns({f"_x{k}": keyword_genre(c) for k, c in enumerate(explicit)})
    wide = materialize(add_field_votes(wide, "_vote").withColumn("_near", nearest_prototype(wide)), "genres")
    genre, confidence, source = F.col("_near.genre"), F.col("_near.confidence"), F.lit("audio_heuristic")
    steps = [("_vote", F.col("_vote.confidence"), "metadata_heuristic")] + [(f"_x{k}", F.least(F.lit(1.0), F.greatest(F.col(f"_x{k}.confidence"), F.lit(0.92))), "input_column") for k in reversed(range(len(explicit)))]
    for name, sure, label in steps:
        known = F.col(f"{name}.genre") != UNKNOWN
        genre, confidence, source = (F.when(known, a).otherwise(b) for a, b in ((F.col(f"{name}.genre"), genre), (sure, confidence), (F.lit(label), source)))
    wide = wide.withColumns({"_g": genre, "_c": confidence, "_s": source})
    sure = F.col("_c") >= CONFIDENT
    kept = [F.col(f"`{c}`") for c in wide.columns if not c.startswith(("_x", "_vote", "_near", "_g", "_c", "_s")) and c not in RESOLVED]
    return wide.select(*kept, "style_cluster", F.when(sure, F.col("_g")).otherwise(UNKNOWN).alias("genre_primary"), F.col("_c").alias("genre_confidence"), F.col("_s").alias("genre_source"), F.when(sure, F.col("_g")).otherwise(F.col("style_cluster")).alias("mix_group"))


def ensure_genres(df: DataFrame, genre_column: str | None = None, clusters: int = 8) -> DataFrame:
    """As :func:`resolve_genres`, but resolved columns without a null are used as they are where no column is named."""
    if genre_column is None and all(has(df, c) for c in RESOLVED):
        nulls = df.filter(" or ".join(f"`{c}` is null" for c in RESOLVED)).isEmpty()
        if nulls:
            return df
    return resolve_genres(df, genre_column, clusters)
