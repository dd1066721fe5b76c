"""Queries on ordered lists and their reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.values import rating_sql
from ..operators import pairs as P
from ..operators import search as L
from ..operators.blocks import PairScores
from .pool import pair_scores_sql, pool
from .records import table


def _edges(spark, sf_dir):
    """All scores with nine digits, none of them written."""
    return P.pool_scores(pool(spark, sf_dir))


def _paths(spark, sf_dir):
    """Each nation's suppliers in the order of their balance."""
    return L.ordered_paths(pool(spark, sf_dir, ("track_idx", "s_nationkey", "s_acctbal")).select("track_idx", F.concat(F.lit("list "), F.col("s_nationkey").cast("string")).alias("playlist_name"), F.col("s_acctbal").alias("position")))


def order_paths(spark, sf_dir):
    return _paths(spark, sf_dir)


PATHS = "select 'list ' || s_nationkey::VARCHAR as playlist_name, (row_number() over (partition by s_nationkey order by s_acctbal, s_suppkey))::INTEGER as position, s_suppkey as track_idx from supplier"


def order_paths_mixed(spark, sf_dir):
    """Loose keys: numbers in text, blanks and words; lists without a name are numbered."""
    c = table(spark, sf_dir, "customer")
    key = F.element_at(F.array(F.concat(F.lit(" "), F.col("c_acctbal").cast("string")), F.lit("later"), F.lit("")), (F.pmod("c_custkey", F.lit(3)) + 1).cast("int"))
    name = F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_mktsegment"))
    return L.ordered_paths(c.select("c_custkey", key.alias("position"), name.alias("playlist_name")), index="c_custkey")


MIXED = """with c as (select c_custkey, case when c_custkey % 3 = 0 then c_acctbal end as k, case when c_mktsegment <> 'MACHINERY' then c_mktsegment end as g from customer),
n as (select g, row_number() over (order by g nulls last) as number from (select distinct g from c))
select coalesce(c.g, printf('playlist_%02d', number)) as playlist_name, (row_number() over (partition by c.g order by k is null, k, c_custkey))::INTEGER as position, c_custkey as track_idx from c join n on c.g is not distinct from n.g"""


def input_order(spark, sf_dir):
    return L.ordered_paths(table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", index="c_custkey")


def playlist_table(spark, sf_dir):
    rows = pool(spark, sf_dir, ("track_idx", "title"))
    out = L.playlist_table(rows, _paths(spark, sf_dir), _edges(spark, sf_dir))
    return out.withColumn("transition_score_from_previous", F.round("transition_score_from_previous", 6))


PLAYLIST = pair_scores_sql() + f""", pa as ({PATHS}), l as (select *, lag(track_idx) over (partition by playlist_name order by position) as prev, dense_rank() over (order by playlist_name) as playlist_index from pa)
select l.playlist_index::INTEGER as playlist_index, l.position, l.playlist_name, round(e.score, 6) as transition_score_from_previous, {rating_sql('round(e.score, 9)')} as transition_rating_from_previous, l.track_idx, t.title
from l join m t using (track_idx) left join pair_scores e on e.from_idx = prev and e.to_idx = l.track_idx"""


def _report(spark, sf_dir):
    return L.transition_report(pool(spark, sf_dir, ("track_idx", "title", "artist")), _paths(spark, sf_dir), _edges(spark, sf_dir))


def transition_report(spark, sf_dir):
    r = _report(spark, sf_dir)
    return r.select(*(F.round(c, 6).alias(c) if c in ("transition_score", "best_possible_next_score", "score_gap_to_best") else F.col(c) for c in r.columns))


_REPORT = pair_scores_sql() + f""", e as (select from_idx, to_idx, round(score, 9) as score from pair_scores), pa as ({PATHS}),
stp as (select playlist_name, position as k, track_idx as f, lead(track_idx) over (partition by playlist_name order by position) as t from pa),
w as (select stp.*, e.to_idx, e.score, e.to_idx = stp.t as chosen from stp join e on e.from_idx = stp.f left join pa u on u.playlist_name = stp.playlist_name and u.track_idx = e.to_idx and u.position <= stp.k where stp.t is not null and u.track_idx is null),
r as (select *, row_number() over y as rn, count(*) over (partition by playlist_name, k) as n, first_value(to_idx) over y as best_idx, first_value(score) over y as best from w window y as (partition by playlist_name, k order by score desc, to_idx rows between unbounded preceding and unbounded following)),
lb as (select track_idx, artist || ' - ' || title as label from m),
report as (select 'recommended_order' as report_name, playlist_name, k::INTEGER as from_position, (k + 1)::INTEGER as to_position, f as from_index, t as to_index, a.label as from_label, b.label as to_label, score as transition_score, {rating_sql('score')} as transition_rating,
rn as transition_rank_from_source, n as remaining_candidates, c.label as best_possible_next_label, best as best_possible_next_score, best - score as score_gap_to_best
from r join lb a on a.track_idx = f join lb b on b.track_idx = t join lb c on c.track_idx = best_idx where chosen)"""
REPORT = _REPORT + " select * replace (round(transition_score, 6) as transition_score, round(best_possible_next_score, 6) as best_possible_next_score, round(score_gap_to_best, 6) as score_gap_to_best) from report"


def report_summary(spark, sf_dir):
    s = L.report_summary(_report(spark, sf_dir))
    return s.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in s.dtypes))


REPORT_SUMMARY = _REPORT + """ select report_name, playlist_name, count(*) as num_transitions, round(avg(transition_score), 6) as avg_transition_score, round(min(transition_score), 6) as min_transition_score, round(max(transition_score), 6) as max_transition_score,
round(avg((transition_rating = 'excellent')::INTEGER::DOUBLE), 6) as excellent_share, round(avg((transition_score >= 0.65::DOUBLE)::INTEGER::DOUBLE), 6) as strong_or_better_share, round(avg(transition_rank_from_source), 6) as avg_rank_from_source from report group by 1, 2"""


def quality_summary(spark, sf_dir):
    """Of the report's steps, whose scores alone it takes: no ranks, for which all pairs would be scored."""
    s = L.quality_summary(L.scored_steps(_paths(spark, sf_dir), _edges(spark, sf_dir)), "own")
    return s.select(*(F.round(c, 6).alias(c) for c in s.columns))


QUALITY_SUMMARY = _REPORT + " select round(avg(transition_score), 6) as avg_score, round(min(transition_score), 6) as min_score, round(avg((transition_score >= 0.65::DOUBLE)::INTEGER::DOUBLE), 6) as strong_share from report"


def beam_playlist(spark, sf_dir):
    """The whole pool in order."""
    rows = pool(spark, sf_dir)
    paths, _ = L.generate_lists(rows, _edges(spark, sf_dir), rows.count())
    return paths


def multi_playlist(spark, sf_dir):
    """Three lists of equal shares of the pool; up to two tracks remain where three don't divide it."""
    rows = pool(spark, sf_dir)
    paths, _ = L.generate_lists(rows, _edges(spark, sf_dir), rows.count() // 3, lists=3)
    return paths


def beam_by_nation(spark, sf_dir):
    """One list of all its suppliers for each nation, all in parallel: pools are tasks."""
    rows = pool(spark, sf_dir, ("track_idx", "s_nationkey", "artist", "tags"))
    tracks = rows.select(F.col("s_nationkey").alias("pool"), "track_idx", "artist", F.col("tags").alias("mix"), F.lit("unknown").alias("genre"))
    edges = _edges(spark, sf_dir)
    if isinstance(edges, PairScores):
        return L.beam_lists(tracks, edges, None)
    nation = rows.select(F.col("track_idx").alias("i"), F.col("s_nationkey").alias("pool"))
    edges = edges.join(nation.withColumnRenamed("i", "from_idx"), "from_idx").join(nation.select(F.col("i").alias("to_idx"), F.col("pool").alias("q")), "to_idx").filter("pool = q").drop("q")
    return L.beam_lists(tracks, edges, None)


QUERIES = {
    "order_paths": (order_paths, PATHS),
    "order_paths_mixed_keys": (order_paths_mixed, MIXED),
    "input_order": (input_order, "select 'input_order' as playlist_name, row_number() over (order by c_acctbal, c_custkey) as position, c_custkey as track_idx from customer"),
    "playlist_table": (playlist_table, PLAYLIST),
    "transition_report": (transition_report, REPORT),
    "report_summary": (report_summary, REPORT_SUMMARY),
    "quality_summary": (quality_summary, QUALITY_SUMMARY),
    "beam_playlist": (beam_playlist, None),
    "multi_playlist": (multi_playlist, None),
    "beam_by_nation": (beam_by_nation, None),
}
