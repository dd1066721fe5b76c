"""Queries on the cache chains: features, resolutions and source tracks that caches hold in part."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.values import ANALYSED
from ..operators import caches as C
from ..operators.pairs import spread
from ..operators.tracklists import compact_pairs
from . import texts
from .pool import MOOD_INPUTS, moods_sql
from .records import table

SIGN = X.analysis_signature()
OTHER = X.analysis_signature(edge_seconds=15)


# --- features ----------------------------------------------------------------


def _cache(spark, sf_dir):
    """Orders as analyses of their customers: some under settings' columns alone, some under other settings, some incomplete."""
    status = F.col("o_orderstatus")
    rows = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("  "), F.col("o_custkey").cast("string")).alias("video_id"),
        F.when(status == "F", F.lit(SIGN)).when(status == "O", F.lit("")).otherwise(F.lit(OTHER)).alias("analysis_signature"),
        *(F.lit(v).alias(n) for n, v in (("edge_seconds", 15.0), ("silence_top_db", 35.0), ("flow_profile", "deep-dj"), ("cache_version", 1), ("title", "gone"))),
        *(F.when((status != "O") | (F.col("o_orderkey") % 7 != 0) | F.lit(n == "tempo"), F.round(F.col("o_totalprice") / 1000, 3)).alias(n) for n in ANALYSED),
        "o_orderkey",
    )
    return rows


_CACHE = f"""ca as (select o_custkey::VARCHAR as video_id, case when o_orderstatus = 'F' then '{SIGN}' else '{OTHER}' end as analysis_signature, round(o_totalprice / 1000, 3) as tempo,
case when o_orderstatus <> 'O' or o_orderkey % 7 <> 0 then round(o_totalprice / 1000, 3) end as key, o_orderkey from orders),
no as (select * from ca qualify row_number() over (partition by video_id, analysis_signature order by o_orderkey desc) = 1)"""


def feature_cache(spark, sf_dir):
    """A loose cache in its present form."""
    out = C.normalise_features(_cache(spark, sf_dir), ["o_orderkey"])
    return out.select("video_id", "analysis_signature", "tempo", "key", *(F.round(c, 8).alias(c) for c in ("sentiment_arousal", "sentiment_warmth")))


_MOODS = moods_sql("", "coalesce(key, 1::DOUBLE)")
FEATURE_CACHE = f"""with {_CACHE}, m as (select *, {', '.join(f'0::DOUBLE as {n}' for n in MOOD_INPUTS if n != 'tempo')} from no)
select video_id, analysis_signature, tempo, key, round({_MOODS['sentiment_arousal']}, 8) as sentiment_arousal, round({_MOODS['sentiment_warmth']}, 8) as sentiment_warmth from m"""


def _extract(data: bytes) -> dict[str, float]:
    n = int(data)
    if n % 11 == 0:
        raise ValueError("not a sound")
    return {c: float(n % 100) for c in ANALYSED}


def analyse_tracks(spark, sf_dir):
    """Customers as tracks: some analysed already, others in the cache under these or other settings, others in files, of which some are bad."""
    own = F.col("c_custkey") % 5 == 0
    tracks = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("track_idx"), F.when(F.col("c_custkey") % 13 == 0, F.lit(" ")).otherwise(F.col("c_custkey").cast("string")).alias("video_id"), *(F.when(own, F.lit(50.0)).alias(n) for n in ANALYSED))
    cache = C.normalise_features(_cache(spark, sf_dir).filter("o_orderkey % 3 = 0"), ["o_orderkey"])
    key = F.col("p_partkey").cast("string")
    files = table(spark, sf_dir, "part").select(key.alias("video_id"), F.concat(F.lit("/"), key, F.lit(".wav")).alias("path"), key.cast("binary").alias("content"))
    out = C.analyse_tracks(tracks, cache, files, SIGN, _extract, deep=False, any_signature=True)[0]
    return out.select("track_idx", "tempo", "outro_tempo")


ANALYSE = f"""with {_CACHE.replace('from orders', 'from orders where o_orderkey % 3 = 0')},
e as (select * from no where analysis_signature = '{SIGN}'), l as (select * from no where analysis_signature = '{OTHER}' and key is not null and video_id not in (select video_id from e)),
t as (select c_custkey, case when c_custkey % 13 = 0 then '' else c_custkey::VARCHAR end as v from customer),
r as (select c_custkey as track_idx, case when c_custkey % 5 = 0 then 50::DOUBLE when e.video_id is not null then e.tempo when l.video_id is not null then l.tempo when p_partkey is not null and p_partkey % 11 <> 0 then (p_partkey % 100)::DOUBLE end as tempo
from t left join e on e.video_id = v left join l on l.video_id = v left join part on p_partkey::VARCHAR = v)
select track_idx, tempo, tempo as outro_tempo from r"""


# --- resolutions -------------------------------------------------------------


def resolve_cached(spark, sf_dir):
    """Tracks of which the cache answers a quarter, another quarter under other settings, and some lead to no query."""
    asked = spread(texts._asked(spark, sf_dir), table(spark, sf_dir, "part").count())
    n = F.col("video_id").cast("long")
    asked = asked.withColumn("track_raw", F.when(n % 50 == 7, F.lit(" -- ")).otherwise(F.col("track_raw")))
    sign = C.resolution_signature(X.plain_query(X.track_text(F.col("track_raw"))))
    held = asked.filter(n % 4 < 2).select("video_id", "position", F.when(n % 4 == 0, sign).otherwise(F.lit("v3|0")).alias("resolution_signature"), F.lit("resolved").alias("resolution_status"), F.concat(F.lit("kept"), "video_id").alias("resolved_video_id"))
    out = C.resolve_tracks(asked, texts._candidates(spark, sf_dir), held)[0]
    return out.select(F.col("video_id").cast("long").alias("p_partkey"), "search_query", "resolution_status", "resolved_video_id")


RESOLVE_CACHED = f"""with r as ({texts.RESOLVE})
select p.p_partkey, case when p.p_partkey % 50 = 7 then '' else p_name || ' official audio' end as search_query, case when p.p_partkey % 4 = 0 then 'resolved' when p.p_partkey % 50 = 7 then 'ignored' else r.resolution_status end as resolution_status,
case when p.p_partkey % 4 = 0 then 'kept' || p.p_partkey::VARCHAR when p.p_partkey % 50 = 7 then null else r.resolved_video_id end as resolved_video_id from part p join r using (p_partkey)"""


# --- source tracks -----------------------------------------------------------

_URL, _LABEL, _SOURCE = "https://www.youtube.com/@someone/videos", "excellent", "a mix"


def scrape_cached(spark, sf_dir):
    """Orders as a channel's videos: the cache has a third of them, half of these under another label."""
    videos = texts._lines(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string"))
    listing = videos.select("video_id", F.lit("a video").alias("video_title"), F.lit("").alias("video_url"))
    sign = C.source_signature(F.lit(_URL), F.when(F.col("k") % 2 == 0, F.lit(_LABEL)).otherwise(F.lit("good")), F.lit(_SOURCE))
    held = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k")).filter("k % 3 = 0").select(F.col("k").cast("string").alias("video_id"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position"), sign.alias("source_signature"))
    held = held.withColumns({"track_raw": F.concat(F.lit("kept "), "position"), "timestamp_s": F.col("position") * 90})
    rows = C.scrape_channel(listing, videos, held, _URL, _LABEL, _SOURCE)[0]
    return rows.select(F.col("video_id").cast("long").alias("video_id"), "position", "timestamp", "timestamp_s", "track_raw", "label")


SCRAPE = f"""with {texts._DESCRIPTIONS}, v as (select distinct l_orderkey as video_id from lineitem),
kept as (select video_id, unnest([1, 2]) as position from v where video_id % 6 = 0 and video_id in (select o_orderkey from orders)),
fresh as (select video_id, position, timestamp, timestamp_s, track_raw, count(*) over (partition by video_id) as n from tl where video_id not in (select video_id from kept))
select video_id, position::INTEGER as position, timestamp, timestamp_s, track_raw, '{_LABEL}' as label from fresh where n >= 2
union all select video_id, position::INTEGER, case position when 1 then '01:30' else '03:00' end, (position * 90)::INTEGER, 'kept ' || position::VARCHAR, '{_LABEL}' from kept"""


def compact_export(spark, sf_dir):
    """What the export of training pairs keeps: listed columns in their order, descriptions on one line."""
    d = table(spark, sf_dir, "documents")
    pairs = d.select(F.col("doc_id").cast("string").alias("video_id"), F.lit(1.5).alias("from_tempo"), F.col("text").alias("from_description"), F.col("lang").alias("from_category"), F.lit("x").alias("label"))
    return compact_pairs(pairs)


EXPORT = texts.ONE_LINE.replace("select doc_id,", "select doc_id::VARCHAR as video_id, 'x' as label, lang as from_category,").replace(" as line ", " as from_description ")


QUERIES = {
    "feature_cache": (feature_cache, FEATURE_CACHE),
    "analyse_tracks": (analyse_tracks, ANALYSE),
    "resolve_cached": (resolve_cached, RESOLVE_CACHED),
    "scrape_cached": (scrape_cached, SCRAPE),
    "compact_export": (compact_export, EXPORT),
}
