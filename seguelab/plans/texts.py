"""Queries on track lists, track names, time codes, addresses, signatures and resolution."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import caches
from ..operators import tracklists as T
from ..session import materialize
from .records import table

_LINE = "[' - Part ' || p || ' - Supplier ' || s, ' Part ' || p || ' (Official Video) https://example.com/x', ' | Song ' || p || ' – Artist ' || s || ' ( ) ', ' - '][k % 4 + 1]"


def _lines(spark, sf_dir):
    """A description for each order: a line for each item, some without a name or a time."""
    li = table(spark, sf_dir, "lineitem")
    p, s = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    kinds = F.array(F.concat(F.lit(" - Part "), p, F.lit(" - Supplier "), s), F.concat(F.lit(" Part "), p, F.lit(" (Official Video) https://example.com/x")), F.concat(F.lit(" | Song "), p, F.lit(" – Artist "), s, F.lit(" ( ) ")), F.lit(" - "))
    line = F.concat(F.format_string("%02d:%02d", (F.col("l_linenumber") * 3).cast("int"), (F.col("l_suppkey") % 60).cast("int")), F.element_at(kinds, (F.pmod(F.col("l_partkey"), F.lit(4)) + 1).cast("int")))
    rows = li.groupBy(F.col("l_orderkey").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", line.alias("line")))).alias("x"))
    return rows.select("video_id", F.concat(F.lit("Track list\n"), F.array_join(F.transform("x", lambda x: x["line"]), "\n")).alias("description"))


_DESCRIPTIONS = f"""d as (select l_orderkey as video_id, unnest(list({{'n': l_linenumber, 'p': l_partkey, 's': l_suppkey}} order by l_linenumber, l_partkey, l_suppkey)) as x, generate_subscripts(list(l_linenumber), 1) as i from lineitem group by 1),
ln as (select video_id, i, x.n * 3 as mi, x.s % 60 as se, x.p % 4 as k, {_LINE.replace('|| p', '|| x.p::VARCHAR').replace('|| s', '|| x.s::VARCHAR').replace('k % 4', 'x.p % 4')} as rest from d),
cl as (select *, printf('%02d:%02d', mi, se) as ts, {X.track_text_sql('rest')} as track_raw from ln),
tl as (select video_id, row_number() over (partition by video_id order by i) as position, ts as timestamp, (mi * 60 + se)::INTEGER as timestamp_s, track_raw, len(regexp_extract_all(track_raw, '{X.SEPARATOR}')) as seps from cl where length(track_raw) >= 2)"""


def tracklist_lines(spark, sf_dir):
    return T.description_lines(_lines(spark, sf_dir))


LINES = f"with {_DESCRIPTIONS} select video_id, position::INTEGER as position, timestamp, timestamp_s, track_raw, case when seps = 1 then trim(string_split_regex(track_raw, '{X.SEPARATOR}')[2]) else '' end as artist_guess, case when seps = 1 then trim(string_split_regex(track_raw, '{X.SEPARATOR}')[1]) else '' end as title_guess from tl"


def source_rows(spark, sf_dir):
    """Descriptions against chapters a few seconds off."""
    d = _lines(spark, sf_dir)
    chapters = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("video_id")).agg(F.array_sort(F.collect_list(F.struct((F.col("l_linenumber") * 180 + F.col("l_suppkey") % 60 + F.col("l_partkey") % 9).cast("double").alias("start_time"), F.concat(F.lit("Chapter "), F.col("l_partkey").cast("string")).alias("title")))).alias("chapters"))
    return T.source_rows(d.join(chapters, "video_id").withColumns({"video_id": F.col("video_id").cast("string"), "title": F.lit("a mix"), "channel_url": F.lit("https://www.youtube.com/@someone/videos")}))


_NAMES = ("'00:45 - ' || p_name || ' - ' || p_brand", "p_name || ' (Official Audio) [2019]'", "'12:01:02 ' || p_name || ' GRÖßE Straße É (slowed by me) - '", "p_name || ' - ' || p_brand || ' – x'", "'( - ' || p_name || ' ) https://youtu.be/abc ;'", "'  '")


def _names(spark, sf_dir):
    n, b = F.col("p_name"), F.col("p_brand")
    lit = F.lit
    shapes = F.array(F.concat(lit("00:45 - "), n, lit(" - "), b), F.concat(n, lit(" (Official Audio) [2019]")), F.concat(lit("12:01:02 "), n, lit(" GRÖßE Straße É (slowed by me) - ")), F.concat(n, lit(" - "), b, lit(" – x")), F.concat(lit("( - "), n, lit(" ) https://youtu.be/abc ;")), lit("  "))
    return table(spark, sf_dir, "part").select("p_partkey", F.element_at(shapes, (F.pmod("p_partkey", F.lit(6)) + 1).cast("int")).alias("raw"))


_NAME_TABLE = f"(select p_partkey, [{', '.join(_NAMES)}][p_partkey % 6 + 1] as raw from part)"


def track_text_clean(spark, sf_dir):
    clean = X.track_text(F.col("raw"))
    s = X.track_sides(clean)
    return _names(spark, sf_dir).select("p_partkey", clean.alias("clean"), X.search_text(F.col("raw")).alias("simple"), F.array_join(X.search_queries(F.col("raw")), "|").alias("queries"), s["left"].alias("left_side"), s["right"].alias("right_side"), X.too_short(clean).alias("too_short"))


CLEAN = f"""with a as (select p_partkey, {X.track_text_sql('raw')} as clean, {X.search_text_sql('raw')} as simple from {_NAME_TABLE}), b as (select *, string_split_regex(clean, '{X.SEPARATOR}') as s from a)
select p_partkey, clean, simple, case when clean = '' then '' when simple = clean or simple = '' then clean else clean || '|' || simple end as queries, case when len(s) = 2 then trim(s[1]) else '' end as left_side, case when len(s) = 2 then trim(s[2]) else '' end as right_side, length(clean) < 2 as too_short from b"""


def time_codes(spark, sf_dir):
    s = (F.col("l_partkey") * F.col("l_linenumber") - 50).cast("int")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", s.alias("s"))
    code = X.time_code(F.col("s"))
    return rows.select("s", code.alias("code"), X.duration_text(F.col("s")).alias("duration"), X.seconds(code).alias("seconds"), X.strict_seconds(code).alias("strict"), X.loose_seconds(F.concat(F.col("s").cast("string"), F.lit(".5"))).alias("loose")).distinct()


TIMES = """with a as (select distinct (l_partkey * l_linenumber - 50)::INTEGER as s from lineitem), b as (select s, greatest(s, 0) as t from a)
select s, case when t >= 3600 then printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) else printf('%02d:%02d', t // 60, t % 60) end as code,
case when t >= 3600 then printf('%d:%02d:%02d', t // 3600, t % 3600 // 60, t % 60) else printf('%d:%02d', t // 60, t % 60) end as duration, t as seconds, t as strict,
round_even((s::VARCHAR || '.5')::DOUBLE, 0)::INTEGER as loose from b"""


def url_ids(spark, sf_dir):
    u = F.col("url")
    eleven = F.substring(F.md5(u), 1, 11)
    shapes = F.array(F.concat(F.lit("https://www.youtube.com/watch?list=PL1&v="), eleven, F.lit("&t=3")), F.concat(F.lit("https://youtu.be/"), eleven, F.lit("?x")), F.concat(F.lit("https://www.youtube.com/@h"), eleven, F.lit("/videos")), F.concat(F.lit("/shorts/"), eleven), eleven, u)
    rows = table(spark, sf_dir, "pages").select("page_id", F.element_at(shapes, (F.pmod("page_id", F.lit(6)) + 1).cast("int")).alias("u"))
    return rows.select("page_id", X.video_id(F.col("u")).alias("video_id"), X.channel_handle(F.col("u")).alias("handle"), X.playlist_id(F.col("u")).alias("playlist"), X.video_url(X.video_id(F.col("u")), F.col("u")).alias("link"))


URLS = """with a as (select page_id, url, substr(md5(url), 1, 11) as e from pages), b as (select page_id, ['https://www.youtube.com/watch?list=PL1&v=' || e || '&t=3', 'https://youtu.be/' || e || '?x', 'https://www.youtube.com/@h' || e || '/videos', '/shorts/' || e, e, url][page_id % 6 + 1] as u from a),
c as (select page_id, trim(u) as u, case when regexp_matches(u, '^[A-Za-z0-9_-]{11}$') then u else coalesce(nullif(regexp_extract(u, '[?&]v=([^&#?/]+)', 1), ''), nullif(regexp_extract(u, 'youtu\\.be/([^&#?/]+)', 1), ''), nullif(regexp_extract(u, '/shorts/([^&#?/]+)', 1), ''), nullif(regexp_extract(u, '/live/([^&#?/]+)', 1), ''), '') end as video_id from b)
select page_id, video_id, regexp_extract(u, 'youtube\\.com/(@[^/?#]+)', 1) as handle, case when contains(u, 'list=') then regexp_extract(u, 'list=([^&]*)', 1) else u end as playlist, case when regexp_matches(u, '^https?://') then u else 'https://www.youtube.com/watch?v=' || video_id end as link from c"""


def signature_hash(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", X.signature(4, F.col("o_orderkey"), F.col("o_orderstatus"), "5").alias("signature"))


SIGNATURE = "select o_orderkey, 'v4|' || substr(sha1('4||' || o_orderkey::VARCHAR || '||' || o_orderstatus || '||5'), 1, 16) as signature from orders"


def one_line_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", X.one_line(F.col("text")).alias("line"))


ONE_LINE = r"select doc_id, array_to_string(list_filter(list_transform(string_split_regex(coalesce(text, ''), '\r\n|\r|\n'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), ' | ') as line from documents"


def context_text(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.context_text(F.col("c_name"), F.lit("  "), F.concat(F.lit(" A  "), F.col("c_mktsegment"))).alias("context"))


def token_overlap(spark, sf_dir):
    rows = _names(spark, sf_dir).withColumn("m", X.match_text(F.col("raw")))
    brand = table(spark, sf_dir, "part").select("p_partkey", X.match_text(F.concat("p_name", F.lit(" by größe STRASSE "), "p_type")).alias("n"))
    return rows.join(brand, "p_partkey").select("p_partkey", F.round(X.overlap(X.tokens(F.col("m")), X.tokens(F.col("n"))), 6).alias("overlap"))


#: The tables hold no other character than the sharp s that folds to something else than its lower case.
_MATCH = lambda c: rf"trim(regexp_replace(replace(lower({X.track_text_sql(c)}), 'ß', 'ss'), '[^\p{{L}}\p{{M}}\p{{N}}_]+', ' ', 'g'))"
_TOKENS = lambda c: f"list_filter(list_distinct(string_split({c}, ' ')), lambda x: x <> '' and x not in ({', '.join(map(X.quote, X.FILLER))}) and strlen(x) >= 2)"  # bytes: a single character counts where it is not ASCII
_OVERLAP = lambda e, a: f"(case when len({e}) > 0 then len(list_intersect({e}, {a}))::DOUBLE / len({e}) else 0::DOUBLE end)"
OVERLAP = f"""with a as (select p_partkey, {_MATCH('raw')} as m from {_NAME_TABLE}), b as (select p_partkey, {_MATCH("p_name || ' by größe STRASSE ' || p_type")} as n from part),
t as (select p_partkey, {_TOKENS('m')} as x, {_TOKENS('n')} as y from a join b using (p_partkey)) select p_partkey, round({_OVERLAP('x', 'y')}, 6) as overlap from t"""


def _candidates(spark, sf_dir):
    """What a search would give: for each part's name its brand's parts as titles, with a length; one in some is gone."""
    p = table(spark, sf_dir, "part")
    q = p.select(F.col("p_name").alias("qn")).distinct()
    side = p.groupBy("p_name", "p_brand").agg(F.min("p_partkey").alias("id"), F.min("p_size").alias("size"))
    return q.join(side, F.col("qn") == F.col("p_name")).select(X.plain_query(F.concat("qn", F.lit(" official audio"))).alias("query"), F.col("id").alias("rank"), F.concat(F.lit("v"), F.col("id").cast("string")).alias("id"), F.concat("p_name", F.when(F.col("size") > 25, F.lit(" playlist")).otherwise(F.lit(""))).alias("title"), F.concat("p_brand", F.lit(" Größe")).alias("uploader"), F.when(F.col("size") != 7, F.col("size") * 40).alias("duration"), F.when(F.col("size") == 3, F.lit("private")).alias("availability"), F.lit("").alias("url"))


def _asked(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("video_id"), F.lit(1).alias("position"), F.concat("p_name", F.lit(" official audio")).alias("track_raw"))


def resolve_top1(spark, sf_dir):
    rows = T.best_candidates(_asked(spark, sf_dir), _candidates(spark, sf_dir))
    return rows.select(F.col("video_id").cast("long").alias("p_partkey"), "resolution_status", "resolved_video_id", "resolved_title", "resolved_artist", "resolved_duration_seconds")


_CANDIDATES = """ca as (select p_name as qn, min(p_partkey) as rk, 'v' || min(p_partkey)::VARCHAR as id, p_name || case when min(p_size) > 25 then ' playlist' else '' end as title, p_brand || ' Größe' as artist, case when min(p_size) <> 7 then min(p_size) * 40 end as duration, coalesce(min(p_size) = 3, false) as gone from part group by p_name, p_brand)"""
_SIDE = lambda c, k: f"case when len(string_split_regex({c}, '{X.SEPARATOR}')) = 2 then trim(string_split_regex({c}, '{X.SEPARATOR}')[{k}]) else '' end"


def _scored(track: str) -> str:
    """The candidates of ``ca`` scored for a track's text; a text with one separator counts by the better way round."""
    both, o = "list_distinct(list_concat(x, y))", _OVERLAP
    way = f"case when le <> '' then greatest(0.65::DOUBLE * {o('lt', 'y')} + 0.35::DOUBLE * {o('rt', 'x')}, 0.65::DOUBLE * {o('rt', 'y')} + 0.35::DOUBLE * {o('lt', 'x')}, 0.5::DOUBLE * {o('lt', both)} + 0.5::DOUBLE * {o('rt', both)}) else 0::DOUBLE end"
    return f"""{_CANDIDATES},
tr as (select *, {X.track_text_sql(track)} as clean from ca),
mt as (select *, {_SIDE('clean', 1)} as le, {_SIDE('clean', 2)} as ri, {_MATCH('clean')} as mq, {_MATCH('title')} as ti, {_MATCH('artist')} as ar, {_MATCH("artist || ' ' || title")} as al from tr),
tk as (select *, {_TOKENS('mq')} as e, {_TOKENS('ti')} as x, {_TOKENS('ar')} as y, {_TOKENS('al')} as z, {_TOKENS(_MATCH('le'))} as lt, {_TOKENS(_MATCH('ri'))} as rt from mt),
ov as (select *, {o('e', both)} as o1, {o('e', 'x')} as o2, {o('e', 'z')} as o3, {way} as way from tk),
sc as (select *, 1.1::DOUBLE * o1 + 0.9::DOUBLE * o2 + 1.2::DOUBLE * way + case when contains(al, mq) then 0.6::DOUBLE when len(list_filter(e, lambda w: not contains(al, w))) = 0 then 0.3::DOUBLE else 0::DOUBLE end + case when duration <= 600 then 0.15::DOUBLE else 0::DOUBLE end
 - case when regexp_matches(title, {X.quote(X.NOISE)}) and o1 < 0.85::DOUBLE then 0.7::DOUBLE else 0::DOUBLE end - case when duration is null then 0.05::DOUBLE else 0::DOUBLE end as score from ov)"""


_SCORED = _scored("qn || ' official audio'")
RESOLVE = f"""with {_SCORED}, r as (select * from sc qualify row_number() over (partition by qn order by gone, score desc, o3 desc, coalesce(duration, 901), rk) = 1),
st as (select *, case when gone then 'unavailable' when score < 1.05::DOUBLE or (o3 < 0.5::DOUBLE and score < 1.45::DOUBLE) then 'no_match' else 'resolved' end as s from r)
select p_partkey, s as resolution_status, case when s = 'resolved' then id end as resolved_video_id, case when s = 'resolved' then title end as resolved_title, case when s = 'resolved' then artist end as resolved_artist, case when s = 'resolved' then duration::INTEGER end as resolved_duration_seconds from part join st on p_name = qn"""


def candidate_match(spark, sf_dir):
    """Candidates for tracks with a separator and without one."""
    c = _candidates(spark, sf_dir)
    other = F.concat(F.regexp_replace("query", " official audio$", ""), F.lit(" – "), F.col("uploader"))
    c = c.withColumn("track", F.when(F.col("rank") % 3 == 0, F.col("query")).when(F.col("rank") % 3 == 1, other).otherwise(F.concat(F.col("uploader"), F.lit(" - "), F.col("query"))))
    return T.add_match(c, "track", "title", "uploader", "duration").select("id", F.round("overlap", 6).alias("overlap"), F.round("match_score", 6).alias("match_score"))


_TRACK = "case when rk % 3 = 0 then lower(qn) || ' official audio' when rk % 3 = 1 then lower(qn) || ' – ' || artist else artist || ' - ' || lower(qn) || ' official audio' end"
MATCH = f"with {_scored(_TRACK)} select id, round(o3, 6) as overlap, round(score, 6) as match_score from sc"


def training_pairs(spark, sf_dir):
    """The whole chain: descriptions, resolution, features, adjacent pairs; its counters."""
    videos = _lines(spark, sf_dir).withColumn("video_id", F.col("video_id").cast("string")).withColumn("chapters", F.array().cast("array<struct<start_time:double,title:string>>"))
    rows = T.source_rows(videos)
    names = rows.select(F.col("track_raw").alias("title")).distinct()
    found = names.select(X.plain_query(X.track_text(F.col("title"))).alias("query"), F.lit(1).alias("rank"), F.concat(F.lit("w"), F.substring(F.md5("title"), 1, 10)).alias("id"), "title", F.lit("").alias("uploader"), F.lit(200).alias("duration"), F.lit("").alias("availability"), F.lit("").alias("url")).dropDuplicates(["query"])
    found = materialize(found, "found")
    features = found.select(F.col("id").alias("video_id"), *(F.lit(1.0).alias(c) for c in ("tempo", "key", "mode", "intro_tempo", "outro_tempo", "intro_seconds_used", "outro_seconds_used")))
    return caches.training_pairs(videos, found, features, deep=False)[2]


QUERIES = {
    "tracklist_lines": (tracklist_lines, LINES),
    "source_rows": (source_rows, None),
    "track_text_clean": (track_text_clean, CLEAN),
    "time_codes": (time_codes, TIMES),
    "url_ids": (url_ids, URLS),
    "signature_hash": (signature_hash, SIGNATURE),
    "one_line_text": (one_line_text, ONE_LINE),
    "context_text": (context_text, "select c_custkey, lower(c_name || ' | A ' || c_mktsegment) as context from customer"),
    "token_overlap": (token_overlap, OVERLAP),
    "candidate_match": (candidate_match, MATCH),
    "resolve_top1": (resolve_top1, RESOLVE),
    "training_pairs": (training_pairs, None),
}
