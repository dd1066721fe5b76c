"""Queries on adjacency, keys, caches and columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import features as X
from ..functions.values import ANALYSED, clip_or_null, coerce_features, filled, group_name, human_bytes, nan_to_null, rating, rating_sql, rename_features
from ..operators import relations as R
from ..operators.model import Spec, pair_features
from ..operators.search import export_batches
from ..operators.tracklists import attach_features

NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- adjacency ---------------------------------------------------------------


def _turns(spark, sf_dir):
    return table(spark, sf_dir, "conversations")


def adjacent_pairs(spark, sf_dir):
    return R.adjacent_pairs(_turns(spark, sf_dir), "conv_id", ["turn"], F.lit(True), ["turn", "role", "text"])


def adjacent_pairs_no_bridge(spark, sf_dir):
    return R.adjacent_pairs(_turns(spark, sf_dir), "conv_id", ["turn"], F.col("role") != "system", ["turn", "role", "text"])


_LEAD = "select *, lead(turn) over w as to_turn, lead(role) over w as to_role, lead(text) over w as to_text from conversations window w as (partition by conv_id order by turn)"
ADJACENT = f"select conv_id, turn as from_turn, role as from_role, text as from_text, to_turn, to_role, to_text from ({_LEAD}) where to_turn is not null"
NO_BRIDGE = ADJACENT + " and role <> 'system' and to_role <> 'system'"


def transition_summary(spark, sf_dir):
    """The first whole query: neighbours, their score and band, a summary by roles."""
    pairs = adjacent_pairs(spark, sf_dir)
    a, b = F.length("from_text").cast("double"), F.length("to_text").cast("double")
    scored = pairs.select("from_role", "to_role", F.when(F.greatest(a, b) > 0, F.least(a, b) / F.greatest(a, b)).alias("score")).withColumn("band", rating(F.col("score")))
    r = lambda c: F.round(c, 6)
    return scored.groupBy("from_role", "to_role").agg(F.count("*").alias("num_transitions"), r(F.avg("score")).alias("avg_score"), r(F.min("score")).alias("min_score"), r(F.max("score")).alias("max_score"), r(F.avg((F.col("band") == "excellent").cast("double"))).alias("excellent_share"), r(F.avg((F.col("score") >= 0.65).cast("double"))).alias("strong_share"))


SUMMARY = f"""with p as ({ADJACENT}), l as (select *, length(from_text)::DOUBLE as a, length(to_text)::DOUBLE as b from p),
s as (select from_role, to_role, case when greatest(a, b) > 0 then least(a, b) / greatest(a, b) end as score from l)
select from_role, to_role, count(*) as num_transitions, round(avg(score), 6) as avg_score, round(min(score), 6) as min_score, round(max(score), 6) as max_score,
round(avg(case when {rating_sql('score')} = 'excellent' then 1::DOUBLE else 0::DOUBLE end), 6) as excellent_share, round(avg((score >= 0.65::DOUBLE)::INTEGER::DOUBLE), 6) as strong_share from s group by 1, 2"""


def event_transition_pairs(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "value")
    pairs = R.adjacent_pairs(rows, "user_id", ["us", "event_id"], F.lit(True), ["event_id", "event_type", "us", "value"])
    score = clip_or_null(F.col("to_value") / 100)
    return pairs.select("user_id", "from_event_id", "to_event_id", "from_event_type", "to_event_type", (F.greatest(F.col("to_us") - F.col("from_us"), F.lit(0))).alias("gap_us"), rating(score).alias("band"))


EVENTS = f"""with e as (select *, epoch_us(ts) as us from events), l as (select *, lead(event_id) over w as to_event_id, lead(event_type) over w as to_event_type, lead(us) over w as to_us, lead(value) over w as to_value from e window w as (partition by user_id order by us, event_id)),
s as (select *, greatest(0::DOUBLE, least(1::DOUBLE, to_value / 100)) as score from l where to_event_id is not null)
select user_id, event_id as from_event_id, to_event_id, event_type as from_event_type, to_event_type, greatest(to_us - us, 0)::BIGINT as gap_us, {rating_sql('case when to_value is null then null else score end')} as band from s"""


def pair_features_query(spark, sf_dir):
    return pair_features(adjacent_pairs(spark, sf_dir).drop("from_text", "to_text"), Spec(["turn"], ["role"]), ("conv_id",))


PAIR_FEATURES = f"""select conv_id, from_turn::DOUBLE as from_turn, to_turn::DOUBLE as to_turn, (to_turn - from_turn)::DOUBLE as delta_turn, abs(to_turn - from_turn)::DOUBLE as abs_delta_turn, (from_turn + to_turn) * 0.5::DOUBLE as mean_turn,
length(from_role)::DOUBLE as from_len_role, length(to_role)::DOUBLE as to_len_role, (length(to_role) - length(from_role))::DOUBLE as len_delta_role, abs(length(to_role) - length(from_role))::DOUBLE as len_abs_delta_role, (from_role <> '' and from_role = to_role)::INTEGER::DOUBLE as same_role from ({ADJACENT})"""


def skipped_pairs(spark, sf_dir):
    return _turns(spark, sf_dir).groupBy("role").agg(R.skipped_pairs(None, "conv_id").alias("neighbours"), F.count("*").alias("n"))


SKIPPED = "select role, count(*) - count(distinct conv_id) as neighbours, count(*) as n from conversations group by role"


# --- columns -----------------------------------------------------------------


def _loose(spark, sf_dir):
    shapes = F.array(F.col("value").cast("string"), F.concat(F.lit("  "), F.col("value").cast("string")), F.concat(F.col("event_id").cast("string"), F.lit("d")), F.lit("n/a"), F.concat(F.lit("1_"), F.col("event_id").cast("string")), F.lit("-.5e1"), F.lit(None).cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.element_at(shapes, (F.pmod("event_id", F.lit(7)) + 1).cast("int")).alias("Tempo "), F.col("event_type").alias("kind"))


_LOOSE = "(select event_id, [value::VARCHAR, '  ' || value::VARCHAR, event_id::VARCHAR || 'd', 'n/a', '1_' || event_id::VARCHAR, '-.5e1', null][event_id % 7 + 1] as t, event_type as kind from events)"


def coerce_numeric(spark, sf_dir):
    return coerce_features(rename_features(_loose(spark, sf_dir)))


COERCE = f"select event_id, case when regexp_matches(trim(t), '{NUMBER}') then try_cast(trim(t) as double) end as tempo, kind from {_LOOSE}"


def log_feature_median_fill(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") > 0, F.col("c_acctbal")).alias("tempo"))
    return X.add_log_tempo(rows).select("c_custkey", F.round("log_tempo", 6).alias("log_tempo"))


LOG = "with c as (select c_custkey, case when c_acctbal > 0 then c_acctbal end as t from customer), m as (select median(t) as m from c) select c_custkey, round(log2(coalesce(t, m) + 1e-6), 6) as log_tempo from c cross join m"


def adaptive_norm(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"), F.lit(3.0).alias("same"))
    out = X.add_adaptive(rows, {"price": ("p_retailprice", 0.0, False), "small": ("p_size", 0.5, True), "flat": ("same", 0.25, False)})
    return out.select("p_partkey", *(F.round(c, 6).alias(c) for c in ("price", "small", "flat")))


ADAPTIVE = """with s as (select quantile_cont(p_retailprice, 0.05) as a, quantile_cont(p_retailprice, 0.95) as b, quantile_cont(p_size::DOUBLE, 0.05) as c, quantile_cont(p_size::DOUBLE, 0.95) as d from part)
select p_partkey, round(greatest(0::DOUBLE, least(1::DOUBLE, (p_retailprice - a) / (b - a))), 6) as price, round(1 - greatest(0::DOUBLE, least(1::DOUBLE, (p_size - c) / (d - c))), 6) as small, 0.25::DOUBLE as flat from part cross join s"""


def robust_scale(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.lit(2.0).alias("same"))
    return X.add_robust(rows, ["c_acctbal", "same"]).select("c_custkey", F.round("c_acctbal_scaled", 6).alias("c_acctbal_scaled"), "same_scaled")


ROBUST = "with s as (select quantile_cont(c_acctbal, 0.25) as a, quantile_cont(c_acctbal, 0.5) as m, quantile_cont(c_acctbal, 0.75) as b from customer) select c_custkey, round((c_acctbal - m) / (b - a), 6) as c_acctbal_scaled, 0::DOUBLE as same_scaled from customer cross join s"


def rating_bands(spark, sf_dir):
    rows = nan_to_null(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, F.lit(float("nan"))).otherwise(F.round(F.col("l_quantity") / 50, 6)).alias("score"), "l_shipdate"))
    return rows.groupBy(rating(F.col("score")).alias("band")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("avg_score"))


RATING = f"with s as (select case when l_linenumber = 1 then null else round(l_quantity / 50, 6) end as score from lineitem) select {rating_sql('score')} as band, count(*) as n, round(avg(score), 6) as avg_score from s group by 1"


def group_names(spark, sf_dir):
    """Text groups and sizes in words."""
    p = table(spark, sf_dir, "part")
    joined = F.element_at(F.array(F.concat("p_name", F.lit("; x")), F.concat(F.lit(" "), F.upper("p_type"), F.lit(" / other")), F.lit("  "), F.lit(None).cast("string")), (F.pmod("p_partkey", F.lit(4)) + 1).cast("int"))
    return p.select("p_partkey", group_name(joined).alias("mix_group"), human_bytes(F.col("p_partkey") * F.col("p_partkey") * 13).alias("bytes"))


GROUPS = """select p_partkey, coalesce(nullif(trim(string_split_regex(lower(trim([p_name || '; x', ' ' || upper(p_type) || ' / other', '  ', null][p_partkey % 4 + 1])), '[,;/|]')[1]), ''), 'unknown') as mix_group,
case when b >= 1024::DOUBLE ** 3 then printf('%.1f GB', b / 1024::DOUBLE ** 3) when b >= 1024::DOUBLE ** 2 then printf('%.1f MB', b / 1024::DOUBLE ** 2) when b >= 1024 then printf('%.1f KB', b / 1024) else printf('%.1f B', b) end as bytes
from (select *, (p_partkey * p_partkey * 13)::DOUBLE as b from part)"""


# --- keys and caches ---------------------------------------------------------

_OLD = "(select c_custkey as k, c_nationkey as g, c_mktsegment as v, c_acctbal as w from customer)"
_NEW = "(select p_partkey as k, p_size as g, p_brand as v, p_retailprice as w from part)"


def _old(spark, sf_dir):
    """The customers are the cache, the parts come anew: their keys overlap."""
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"), F.col("c_mktsegment").alias("v"), F.col("c_acctbal").alias("w"))


def _new(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("g"), F.col("p_brand").alias("v"), F.col("p_retailprice").alias("w"))


def upsert_by_key(spark, sf_dir):
    return R.upsert(_old(spark, sf_dir), _new(spark, sf_dir), ["k"])


def replace_partition(spark, sf_dir):
    return R.replace_partition(_old(spark, sf_dir), _new(spark, sf_dir), "g")


def anti_import(spark, sf_dir):
    return R.import_missing(_old(spark, sf_dir), _new(spark, sf_dir), ["k"])


def keep_last(spark, sf_dir):
    return R.keep_last(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def keep_first(spark, sf_dir):
    return R.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], ["event_id"])


def duplicate_keys(spark, sf_dir):
    return R.duplicate_keys(table(spark, sf_dir, "events"), ["user_id", "event_type"])


def union_ragged(spark, sf_dir):
    return R.union_ragged(table(spark, sf_dir, "nation"), table(spark, sf_dir, "region"))


def _sides(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, F.lit(" ")).otherwise(F.col("c_mktsegment")).alias("segment"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).otherwise("").alias("segment"), F.col("o_totalprice").alias("price"), "o_orderkey")
    return left, right


def coalesce_join(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return R.fill_from(left, right, "c_custkey", ["o_orderkey"])


def overlay_join(spark, sf_dir):
    left, right = _sides(spark, sf_dir)
    return R.overlay(left, R.keep_last(right, ["c_custkey"], ["o_orderkey"]).drop("o_orderkey"), "c_custkey")


_SIDES = """l as (select c_custkey, case when c_custkey % 4 = 0 then ' ' else c_mktsegment end as segment from customer),
r as (select o_custkey, case when o_orderkey % 5 <> 0 then o_orderpriority else '' end as segment, o_totalprice as price from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)"""
COALESCE = f"with {_SIDES} select l.c_custkey, coalesce(case when trim(l.segment) <> '' then l.segment end, case when trim(r.segment) <> '' then r.segment end) as segment, r.price from l left join r on c_custkey = o_custkey"
OVERLAY = f"with {_SIDES} select l.c_custkey, coalesce(case when trim(r.segment) <> '' then r.segment end, l.segment) as segment, r.price from l left join r on c_custkey = o_custkey"


def cache_probe(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("sig"), "o_orderkey", "o_totalprice")
    return R.probe_cache(table(spark, sf_dir, "customer").select("c_custkey"), cache, "c_custkey", "sig", "F", F.col("o_totalprice") > 100000, ["o_orderkey"])


PROBE = """with e as (select distinct o_custkey as k from orders where o_orderstatus = 'F'), f as (select o_custkey as k, o_totalprice as p from orders qualify row_number() over (partition by o_custkey order by o_orderkey desc) = 1)
select c_custkey, case when e.k is not null then 'exact' when f.p > 100000 then 'fallback' else 'none' end as hit from customer left join e on e.k = c_custkey left join f on f.k = c_custkey"""


def valid_keys(spark, sf_dir):
    return R.valid_keys(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus"), "O")


def left_join_features(spark, sf_dir):
    """Documents as resolved tracks, their labels as what an analysis gives; one without labels has no whole analysis."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tracks = docs.select(F.col("doc_id").cast("string").alias("resolved_video_id"), "lang", F.when(F.col("lang") == "fr", "no_match").otherwise("resolved").alias("resolution_status"))
    features = labels.select(F.col("doc_id").cast("string").alias("video_id"), *(F.col(c).cast("double").alias(n) for n, c in zip(ANALYSED, ("quality", "toxic") * len(ANALYSED), strict=False)))
    joined = attach_features(tracks, features, deep=False)
    return joined.select(F.col("resolved_video_id").cast("long").alias("doc_id"), "lang", "resolution_status", *ANALYSED[:2])


def merge_tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("props").alias("context_text"), filled(F.when(F.col("event_type") == "click", "").otherwise(F.col("event_type"))).alias("kind"))
    return R.merge_tasks(rows, "user_id", "event_id")


MERGE = """select user_id, arg_max(props, length(props) * 1000000000::BIGINT - event_id) as context_text, arg_min(event_type, event_id) filter (where event_type <> 'click') as kind from events group by user_id"""


def proximity_join(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.col("event_id").alias("position"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp_s"), "event_type")
    return R.nearest_free(e.filter("event_type = 'click'"), e.filter("event_type <> 'click'"), tolerance=600)


PROXIMITY = """with e as (select user_id as video_id, event_id as position, epoch(date_trunc('second', ts))::BIGINT as t, event_type from events),
j as (select l.video_id, l.position, c.position as chapter, abs(l.t - c.t) as gap from e l left join e c on l.video_id = c.video_id and c.event_type <> 'click' and abs(l.t - c.t) <= 600 where l.event_type = 'click')
select video_id, position, chapter from j qualify row_number() over (partition by video_id, position order by gap, chapter) = 1"""


def proximity_greedy(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("timestamp_s"), "event_type", "event_id")
    start = F.lit(1704067200)
    w = Window.partitionBy("video_id", F.col("event_type") == "click").orderBy("timestamp_s", "event_id")
    rows = e.withColumns({"position": F.row_number().over(w), "timestamp_s": F.col("timestamp_s") - start})
    return R.match_nearest(rows.filter("event_type = 'click'"), rows.filter("event_type <> 'click'"), tolerance=600)


def cleanup(spark, sf_dir):
    files = table(spark, sf_dir, "part").select(F.concat(F.col("p_partkey").cast("string"), F.element_at(F.array(F.lit(".wav"), F.lit(".webm.part"), F.lit(".m4a")), (F.pmod("p_partkey", F.lit(3)) + 1).cast("int"))).alias("name"), F.col("p_size").cast("long").alias("length"))
    known = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("video_id"))
    return R.cleanup_summary(R.cleanup_plan(files, known))


CLEANUP = """with f as (select p_partkey, ['.wav', '.webm.part', '.m4a'][p_partkey % 3 + 1] as s, p_size::BIGINT as n from part), k as (select distinct l_partkey from lineitem where l_quantity > 45),
a as (select n, case when s = '.webm.part' then 'temp' when l_partkey is not null then 'featured' else 'keep' end as a from f left join k on p_partkey = l_partkey)
select count(*) filter (where a = 'temp') as temp_files, count(*) filter (where a = 'featured') as featured_files, count(*) filter (where a = 'keep') as keep_files, coalesce(sum(n) filter (where a = 'temp'), 0)::BIGINT as temp_bytes, coalesce(sum(n) filter (where a = 'featured'), 0)::BIGINT as featured_bytes from a"""


def batch_of_50(spark, sf_dir):
    paths = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").cast("string").alias("playlist_name"), F.col("l_partkey").alias("p")).agg(F.count("*").alias("n"))
    rows = paths.select("playlist_name", F.row_number().over(Window.partitionBy("playlist_name").orderBy("p")).alias("position"), F.when(F.col("n") == 1, F.col("p").cast("string")).otherwise("").alias("video_id"))
    return export_batches(rows).select("playlist_name", "batch", F.array_join("video_ids", ",").alias("video_ids"))


BATCH = """with a as (select l_suppkey::VARCHAR as playlist_name, l_partkey as p, count(*) as n from lineitem group by 1, 2), b as (select *, row_number() over (partition by playlist_name order by p) as position from a)
select playlist_name, ((position - 1) // 50)::INTEGER as batch, coalesce(string_agg(case when n = 1 then p::VARCHAR end, ',' order by position), '') as video_ids from b group by 1, 2"""


def row_numbers(spark, sf_dir):
    return R.number_rows(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), [-F.col("c_acctbal"), F.col("c_custkey")], "row_idx")


QUERIES = {
    "transition_summary": (transition_summary, SUMMARY),
    "adjacent_pairs": (adjacent_pairs, ADJACENT),
    "adjacent_pairs_no_bridge": (adjacent_pairs_no_bridge, NO_BRIDGE),
    "event_transition_pairs": (event_transition_pairs, EVENTS),
    "pair_features": (pair_features_query, PAIR_FEATURES),
    "skipped_pairs": (skipped_pairs, SKIPPED),
    "coerce_numeric": (coerce_numeric, COERCE),
    "log_feature_median_fill": (log_feature_median_fill, LOG),
    "adaptive_norm": (adaptive_norm, ADAPTIVE),
    "robust_scale": (robust_scale, ROBUST),
    "rating_bands": (rating_bands, RATING),
    "group_names": (group_names, GROUPS),
    "upsert_by_key": (upsert_by_key, f"select * from {_OLD} o where k not in (select k from {_NEW}) union all select * from {_NEW}"),
    "replace_partition": (replace_partition, f"select * from {_OLD} o where g not in (select g from {_NEW}) union all select * from {_NEW}"),
    "anti_import": (anti_import, f"select * from {_OLD} union all select * from {_NEW} n where k not in (select k from {_OLD})"),
    "keep_last": (keep_last, "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id desc) = 1"),
    "keep_first": (keep_first, "select user_id, event_type, event_id, value from events qualify row_number() over (partition by user_id, event_type order by event_id) = 1"),
    "duplicate_keys": (duplicate_keys, "select user_id, event_type, count(*) as count from events group by 1, 2 having count(*) > 1"),
    "union_ragged": (union_ragged, "select * from nation union all by name select * from region"),
    "coalesce_join": (coalesce_join, COALESCE),
    "overlay_join": (overlay_join, OVERLAY),
    "cache_probe": (cache_probe, PROBE),
    "valid_keys": (valid_keys, "select o_custkey from orders group by 1 having bool_and(coalesce(o_orderstatus = 'O', false))"),
    "left_join_features": (left_join_features, "select doc_id, lang, case when lang = 'fr' then 'no_match' when quality is null or toxic is null then 'analysis_failed' else 'resolved' end as resolution_status, quality::DOUBLE as tempo, toxic::DOUBLE as key from documents left join labels using (doc_id)"),
    "merge_tasks": (merge_tasks, MERGE),
    "proximity_join": (proximity_join, PROXIMITY),
    "proximity_greedy": (proximity_greedy, None),
    "cleanup": (cleanup, CLEANUP),
    "batch_of_50": (batch_of_50, BATCH),
    "row_numbers": (row_numbers, "select c_custkey, c_acctbal, row_number() over (order by -c_acctbal, c_custkey) - 1 as row_idx from customer"),
}
