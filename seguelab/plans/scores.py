"""Queries on features, pair scores, genres, similarity graphs and the pair model."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import features as X
from ..operators import genre as G
from ..operators import graph as S
from ..operators import model as M
from ..operators import pairs as P
from ..operators import search as L
from .pool import keyword_sql, moods_sql, moods_table_sql, pair_scores_sql, pool, pool_sql, prototype_sql, votes_sql
from .records import adjacent_pairs, table

COMPONENTS = ("edge_flow", "structure", "timbre", "groove", "sentiment", "tonal")
VECTOR = ("energy", "danceability", "valence", "acousticness", "speechiness", "harmonic_ratio")


def _rounded(df, *names, digits=6):
    return df.select(*(F.round(c, digits).alias(c) if c in names else F.col(c) for c in df.columns))


def _near(df, *names, digits=6):
    """As :func:`_rounded`, of numbers from 0 to 1 in tables of all pairs."""
    return df.select(*(P.rounded(F.col(c), digits).alias(c) if c in names else F.col(c) for c in df.columns))


def mood_features(spark, sf_dir):
    names = [p + m for p in X.MOOD_PREFIXES for m in X.MOODS]
    return _rounded(X.add_moods(pool(spark, sf_dir)).select("track_idx", *names), *names)


MOODS = "select track_idx, " + ", ".join(f"round({v}, 6) as {k}" for p in X.MOOD_PREFIXES for k, v in moods_sql(p).items()) + f" from {pool_sql()}"


def pair_scores(spark, sf_dir):
    return _near(P.score_pairs(pool(spark, sf_dir), components=True), "score", *COMPONENTS)


PAIR_SCORES = pair_scores_sql() + " select from_idx, to_idx, " + ", ".join(f"round({c}, 6) as {c}" for c in ("score", *COMPONENTS)) + " from pair_scores"


def top_edges(spark, sf_dir):
    return _rounded(P.pool_scores(pool(spark, sf_dir)).top(25), "score")


TOP = pair_scores_sql() + """, e as (select from_idx, to_idx, round(score, 9) as score from pair_scores where from_idx <> to_idx)
select from_idx, to_idx, round(score, 6) as score from e qualify row_number() over (partition by from_idx order by score desc, to_idx) <= 25"""


def outgoing_quality(spark, sf_dir):
    return _rounded(P.pool_scores(pool(spark, sf_dir), digits=None).quality(), "quality")


QUALITY = pair_scores_sql() + " select from_idx, round(avg(score) + 0.75::DOUBLE * max(score), 6) as quality from pair_scores group by 1"


def tonal_similarity(spark, sf_dir):
    return _near(P.tonal_pairs(pool(spark, sf_dir, ("track_idx", "key", "mode", "intro_key", "intro_mode")), to_key="intro_key", to_mode="intro_mode"), "score")


def _tonal_sql(key: str, mode: str) -> str:
    table_ = "[" + ", ".join(f"{s!r}::DOUBLE" for _, _, s in X.key_table()) + "]"
    return f"""with p as (select track_idx, case when mode = 1 then key + 12 else key end as e, case when {mode} = 1 then {key} + 12 else {key} end as b from {pool_sql()})
select l.track_idx as from_idx, r.track_idx as to_idx, round({table_}[l.e * 24 + r.b + 1], 6) as score from p l cross join p r"""


def key_similarity(spark, sf_dir):
    return _near(S.key_pairs(pool(spark, sf_dir, ("track_idx", "key", "mode"))), "score")


def key_table(spark, sf_dir):
    """The 24 keys against each other, and how many tracks have each."""
    tracks = pool(spark, sf_dir, ("track_idx", "key", "mode"))
    rows = tracks.groupBy(X.key_code(tracks, "key", "mode").alias("code")).agg(F.count("*").alias("n"))
    return rows.select("code", "n", F.round(X.key_similarity(F.col("code"), F.lit(12)), 6).alias("to_c_major"))


KEY_TABLE = "with t as (select case when mode = 1 then key + 12 else key end as code from " + pool_sql(("track_idx", "key", "mode")) + ") select code, count(*) as n, round([" + ", ".join(f"{s!r}::DOUBLE" for _, _, s in X.key_table()) + "][code * 24 + 12 + 1], 6) as to_c_major from t group by code"


def pairwise_similarity(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    made = P.similarity(F.col("a.n_nationkey") / 25, F.col("b.n_regionkey") / 5, 0.25)
    return n.alias("a").crossJoin(F.broadcast(n).alias("b")).select(F.col("a.n_nationkey").alias("from_idx"), F.col("b.n_nationkey").alias("to_idx"), F.round(made, 6).alias("score"))


PAIRWISE = "select a.n_nationkey as from_idx, b.n_nationkey as to_idx, round(exp(-abs(a.n_nationkey / 25::DOUBLE - b.n_regionkey / 5::DOUBLE) / 0.25::DOUBLE), 6) as score from nation a cross join nation b"


# --- genres ------------------------------------------------------------------


def genre_keyword(spark, sf_dir):
    g = G.keyword_genre("title")
    return pool(spark, sf_dir, ("track_idx", "title")).select("track_idx", g.alias("g")).select("track_idx", "g.genre", F.round("g.confidence", 6).alias("confidence"))


#: The other text fields, from the titles and tags in another order; a list of titles and one of tags.
_MORE = {"uploader": "concat('dj ', tags)", "channel": "title", "category": "split(tags, ' ')[0]", "description": "concat_ws(' / ', title, tags, artist)", "genre": "if(track_idx % 3 = 0, tags, '')", "genres": "if(track_idx % 5 = 0, title, '')"}
_MORE_SQL = _MORE | {"category": "string_split(tags, ' ')[1]", "genre": "case when track_idx % 3 = 0 then tags else '' end", "genres": "case when track_idx % 5 = 0 then title else '' end"}
_TEXTS = ("track_idx", "title", "artist", "tags")


def genre_votes(spark, sf_dir):
    """The votes of all nine text fields."""
    rows = pool(spark, sf_dir, _TEXTS).selectExpr("*", *(f"{v} as {k}" for k, v in _MORE.items()))
    return G.add_field_votes(rows).select("track_idx", "vote.genre", F.round("vote.confidence", 6).alias("confidence"))


def genre_prototype(spark, sf_dir):
    rows = X.add_moods(pool(spark, sf_dir))
    return rows.select("track_idx", G.nearest_prototype(rows).alias("g")).select("track_idx", "g.genre", F.round("g.confidence", 6).alias("confidence"))


def genre_resolve(spark, sf_dir):
    return G.resolve_genres(pool(spark, sf_dir)).select("track_idx", "genre_primary", F.round("genre_confidence", 6).alias("genre_confidence"), "genre_source")


RESOLVE = f"""with m as (select * from {moods_table_sql()}), v as (select * from {votes_sql(pool_sql())}), p as (select * from {prototype_sql('m')}),
c as (select track_idx, case when v.genre <> 'unknown' then v.genre else p.genre end as g, case when v.genre <> 'unknown' then v.confidence else p.confidence end as c, case when v.genre <> 'unknown' then 'metadata_heuristic' else 'audio_heuristic' end as s from v join p using (track_idx))
select track_idx, case when c >= 0.55::DOUBLE then g else 'unknown' end as genre_primary, round(c, 6) as genre_confidence, s as genre_source from c"""


def style_clusters(spark, sf_dir):
    return G.add_style_clusters(X.add_moods(pool(spark, sf_dir))).groupBy("style_cluster").agg(F.count("*").alias("n"))


# --- graphs ------------------------------------------------------------------


def cosine_topk(spark, sf_dir):
    return _rounded(S.cosine_top(table(spark, sf_dir, "embeddings"), 10), "score")


COSINE = """with s as (select a.vec_id as from_idx, b.vec_id as to_idx, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 12) as score from embeddings a join embeddings b on a.vec_id <> b.vec_id)
select from_idx, to_idx, round(score, 6) as score from s qualify row_number() over (partition by from_idx order by score desc, to_idx) <= 10"""


def _vectors(spark, sf_dir):
    return pool(spark, sf_dir, ("track_idx", "key", "mode", *VECTOR)).withColumn("vector", F.array(*VECTOR))


def blend_symmetric(spark, sf_dir):
    return _near(_near(S.blended_pairs(_vectors(spark, sf_dir)), "score", digits=9), "score")


def _nearest(spark, sf_dir):
    rows = S.blended_rows(_vectors(spark, sf_dir))
    return rows, S.blended_top(rows, 20)


def knn_sparsify(spark, sf_dir):
    return _rounded(_nearest(spark, sf_dir)[1], "w")


def _blend_sql() -> str:
    t = "[" + ", ".join(f"{s!r}::DOUBLE" for _, _, s in X.key_table()) + "]"
    return f"""with p as (select track_idx, [{', '.join(VECTOR)}] as v, case when mode = 1 then key + 12 else key end as e from {pool_sql(("track_idx", "key", "mode", *VECTOR))}),
x as (select l.track_idx as i, r.track_idx as j, (2 * list_cosine_similarity(l.v, r.v) + {t}[l.e * 24 + r.e + 1]) / 3 as s from p l cross join p r),
b as (select a.i as from_idx, a.j as to_idx, round(greatest(0::DOUBLE, least(1::DOUBLE, (a.s + z.s) / 2)), 9) as score from x a join x z on a.i = z.j and a.j = z.i)"""


BLEND = _blend_sql() + " select from_idx, to_idx, round(score, 6) as score from b"
KNN = _blend_sql() + ", k as (select * from b qualify row_number() over (partition by from_idx order by score desc, to_idx) <= 21) select from_idx as i, to_idx as j, round(score, 6) as w from k where from_idx < to_idx"


def mst_tour(spark, sf_dir):
    return S.tree_tours(_nearest(spark, sf_dir)[1]).select("position", "track_idx")


def two_opt_tour(spark, sf_dir):
    """The tour improved; a pool is one list."""
    rows, edges = _nearest(spark, sf_dir)
    return S.improved_blended(S.tree_tours(edges), rows).select("position", "track_idx")


def principal_components(spark, sf_dir):
    return X.principal_components(pool(spark, sf_dir, ("track_idx", *VECTOR, "tempo")), [*VECTOR, "tempo"]).select("track_idx", F.transform("components", lambda c: F.round(c, 6)).alias("components"))


# --- the pair model ----------------------------------------------------------


def _labelled(spark, sf_dir):
    turns = adjacent_pairs(spark, sf_dir)
    sides = [F.length(f"{s}_text").cast("double").alias(f"{s}_tempo") for s in ("from", "to")]
    return turns.select(F.col("conv_id").cast("string").alias("video_id"), *sides, F.col("from_role").alias("from_genre_primary"), F.col("to_role").alias("to_genre_primary"))


def negatives(spark, sf_dir):
    return M.negatives(_labelled(spark, sf_dir))


def class_balance(spark, sf_dir):
    return M.class_balance(M.training_set(_labelled(spark, sf_dir)))


BALANCE = "with n as (select count(*) as n from (select lead(turn) over (partition by conv_id order by turn) as t from conversations) where t is not null) select unnest([0::DOUBLE, 1::DOUBLE]) as transition_target, n as count from n"


def _tracks(spark, sf_dir):
    return pool(spark, sf_dir, ("track_idx", "tempo", "tags")).select("track_idx", "tempo", F.col("tags").alias("genre_primary"))


def forest_scores(spark, sf_dir):
    model = M.train(_labelled(spark, sf_dir))
    return _near(model.score_pool(_tracks(spark, sf_dir)), "score")


def perceptron_scores(spark, sf_dir):
    model = M.train(_labelled(spark, sf_dir), kind="mlp")
    return _near(model.score_pool(_tracks(spark, sf_dir)), "score")


QUERIES = {
    "mood_features": (mood_features, MOODS),
    "pair_scores": (pair_scores, PAIR_SCORES),
    "top_edges": (top_edges, TOP),
    "outgoing_quality": (outgoing_quality, QUALITY),
    "tonal_similarity": (tonal_similarity, _tonal_sql("intro_key", "intro_mode")),
    "key_similarity": (key_similarity, _tonal_sql("key", "mode")),
    "key_table": (key_table, KEY_TABLE),
    "pairwise_similarity": (pairwise_similarity, PAIRWISE),
    "genre_keyword": (genre_keyword, f"select track_idx, g.genre, round(g.confidence, 6) as confidence from (select track_idx, {keyword_sql('title')} as g from {pool_sql(("track_idx", "title"))})"),
    "genre_votes": (genre_votes, f"select track_idx, genre, round(confidence, 6) as confidence from {votes_sql('(select *, ' + ', '.join(f'{v} as {k}' for k, v in _MORE_SQL.items()) + ' from ' + pool_sql(_TEXTS) + ')', tuple(G.FIELDS))}"),
    "genre_prototype": (genre_prototype, f"select track_idx, genre, round(confidence, 6) as confidence from {prototype_sql(moods_table_sql())}"),
    "genre_resolve": (genre_resolve, RESOLVE),
    "style_clusters": (style_clusters, None),
    "cosine_topk": (cosine_topk, COSINE),
    "blend_symmetric": (blend_symmetric, BLEND),
    "knn_sparsify": (knn_sparsify, KNN),
    "mst_tour": (mst_tour, None),
    "two_opt_tour": (two_opt_tour, None),
    "principal_components": (principal_components, None),
    "negatives": (negatives, None),
    "class_balance": (class_balance, BALANCE),
    "forest_scores": (forest_scores, None),
    "perceptron_scores": (perceptron_scores, None),
}
