"""A pool of tracks made from the suppliers: every feature an exact function of a row's numbers, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.features import key_table
from ..functions.text import genre_text_sql, quote
from ..operators.genre import FIELDS, KEYWORDS, PROTOTYPE_FEATURES, PROTOTYPES
from ..operators.pairs import GROOVE, HANDOFF, STRUCTURE, TIMBRE, WEIGHTS
from ..session import materialize

WIDE = {"spectral_centroid": (500.0, 6000.0), "spectral_bandwidth": (400.0, 4000.0), "spectral_rolloff": (1000.0, 9000.0), "spectral_flatness": (0.0, 0.6), "zcr": (0.0, 0.3), "tempo": (50.0, 190.0), "loudness": (-40.0, 0.0), "onset_strength": (0.0, 6.0)}
MOOD_INPUTS = "onset_strength spectral_centroid spectral_flatness zcr tempo harmonic_ratio valence energy danceability acousticness speechiness".split()
_BASES = list(dict.fromkeys([*TIMBRE, *GROOVE, *MOOD_INPUTS]))
_EDGES = list(dict.fromkeys([*(f"outro_{e}" for e, _ in STRUCTURE), *(f"intro_{b}" for _, b in STRUCTURE), *HANDOFF]))
NAMES = [f"{p}{b}" for p in ("", "intro_", "outro_") for b in _BASES] + _EDGES
TITLES = ("Deep House Session", "Hip-Hop Story", "Piano in the Rain", "Night Drive", "Punk Rock Summer", "Lofi Study Beats", "Jazz & Blue Note", "Unnamed", "Singer Songwriter Folk", "Latin Salsa World", "Neo Soul R&B", "Trance, techno")
TAGS = ("house; techno", "rap", "classical", "", "punk", "lofi chill", "jazz", "soul", "country folk", "salsa", "funk", "electronic dance pop")


def _bounds(name: str) -> tuple[float, float]:
    base = name.removeprefix("intro_").removeprefix("outro_")
    return WIDE.get(base, (0.0, 1.0))


_KEYS = (("key", 12), ("mode", 2), ("intro_key", 12), ("intro_mode", 2), ("outro_key", 12), ("outro_mode", 2))


def pool(spark: SparkSession, sf_dir: str, columns: Sequence[str] | None = None) -> DataFrame:
    """The pool's table; of named columns no others are made."""
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey", "s_acctbal", F.round(F.col("s_acctbal") * 100).cast("long").alias("cents"))
    h = lambda k, m: f"pmod(cents * {2 * k + 3} + s_suppkey * {(k + 7) * 13}, {m})"
    pick = lambda values, k: f"element_at(array({', '.join(map(quote, values))}), cast({h(k, len(values))} + 1 as int))"
    wanted = lambda n: columns is None or n in columns
    made = {"track_idx": "s_suppkey", "s_nationkey": "s_nationkey", "s_acctbal": "s_acctbal", "artist": "concat('artist ', s_nationkey)", "title": pick(TITLES, 300), "tags": pick(TAGS, 301)}
    made |= {n: f"cast({h(200 + k, m)} as int)" for k, (n, m) in enumerate(_KEYS)}
    made |= {n: f"{lo}D + {hi - lo}D * (cast({h(k, 997)} as double) / 996D)" for k, n in enumerate(NAMES) for lo, hi in (_bounds(n),)}
    table = s.selectExpr(*(f"{c} as `{n}`" for n, c in made.items() if wanted(n)))
    return materialize(table, "pool") if columns is None else table


def pool_sql(columns: Sequence[str] | None = None) -> str:
    wanted = lambda n: columns is None or n in columns
    h = lambda k, m: f"(((cents * {2 * k + 3} + s_suppkey * {(k + 7) * 13}) % {m} + {m}) % {m})"
    pick = lambda values, k: f"[{', '.join(map(quote, values))}][{h(k, len(values))} + 1]"
    made = {"track_idx": "s_suppkey", "s_nationkey": "s_nationkey", "s_acctbal": "s_acctbal", "artist": "'artist ' || s_nationkey::VARCHAR", "title": pick(TITLES, 300), "tags": pick(TAGS, 301)}
    made |= {n: f"{h(200 + k, m)}::INTEGER" for k, (n, m) in enumerate(_KEYS)}
    made |= {n: f"{lo}::DOUBLE + {hi - lo}::DOUBLE * ({h(k, 997)}::DOUBLE / 996.0::DOUBLE)" for k, n in enumerate(NAMES) for lo, hi in (_bounds(n),)}
    return f"(select {', '.join(f'{c} as {n}' for n, c in made.items() if wanted(n))} from (select *, round(s_acctbal * 100)::BIGINT as cents from supplier))"


# --- the scorer in SQL -------------------------------------------------------


def clip_sql(c: str, high: float = 1.0) -> str:
    return f"greatest(0::DOUBLE, least({high}::DOUBLE, {c}))"


def norm_sql(c: str, lo: float, hi: float) -> str:
    return clip_sql(f"({c} - {float(lo)}::DOUBLE) / {float(hi - lo)}::DOUBLE")


def mix_sql(*terms: tuple[float, str]) -> str:
    return clip_sql(" + ".join(f"{w}::DOUBLE * {c}" for w, c in terms))


def moods_sql(prefix: str, mode: str | None = None) -> dict[str, str]:
    p, mode = prefix, mode or f"{prefix}mode"
    onset, bright, flat = norm_sql(p + "onset_strength", 0, 5), norm_sql(p + "spectral_centroid", 1000, 5000), norm_sql(p + "spectral_flatness", 0, 0.5)
    rest = lambda c: f"(1::DOUBLE - {c})"
    rough = mix_sql((0.45, flat), (0.35, norm_sql(p + "zcr", 0, 0.2)), (0.20, rest(p + "harmonic_ratio")))
    return {
        f"{p}sentiment_valence": mix_sql((0.55, p + "valence"), (0.20, clip_sql(f"{mode}::DOUBLE")), (0.15, bright), (0.10, rest(rough))),
        f"{p}sentiment_arousal": mix_sql((0.35, p + "energy"), (0.20, p + "danceability"), (0.20, onset), (0.15, norm_sql(p + "tempo", 60, 180)), (0.10, bright)),
        f"{p}sentiment_tension": mix_sql((0.35, rough), (0.25, onset), (0.20, rest(p + "valence")), (0.20, rest(p + "harmonic_ratio"))),
        f"{p}sentiment_warmth": mix_sql((0.35, p + "harmonic_ratio"), (0.25, p + "acousticness"), (0.25, rest(bright)), (0.15, rest(p + "speechiness"))),
    }


def moods_table_sql() -> str:
    made = {k: v for p in ("", "intro_", "outro_") for k, v in moods_sql(p).items()}
    return f"(select *, {', '.join(f'{v} as {k}' for k, v in made.items())} from {pool_sql()})"


def adaptive_sql(c: str) -> str:
    """Of a column, by window-free statistics in the one-row table ``st``."""
    return f"case when q95_{c} > q05_{c} then {clip_sql(f'({c} - q05_{c}) / (q95_{c} - q05_{c})')} when hi_{c} > lo_{c} then {clip_sql(f'({c} - lo_{c}) / (hi_{c} - lo_{c})')} else 0::DOUBLE end"


def pair_scores_sql() -> str:
    moods = [f"sentiment_{m}" for m in ("valence", "arousal", "tension", "warmth")]
    closer = {"timbre": TIMBRE, "groove": GROOVE, "sentiment": moods}
    stats = [f"quantile_cont({c}, 0.05) as q05_{c}, quantile_cont({c}, 0.95) as q95_{c}, min({c}) as lo_{c}, max({c}) as hi_{c}" for c in _EDGES]
    every = [n for v in closer.values() for n in v]
    sides = [f"quantile_cont(v_{n}, [0.25, 0.5, 0.75]) as z_{n}" for n in every]
    both = " union all ".join(f"select {', '.join(f'{p}_{n} as v_{n}' for n in every)} from m" for p in ("outro", "intro"))
    scale = lambda p, n: f"({p}_{n} - z_{n}[2]) / (case when z_{n}[3] = z_{n}[1] then 1::DOUBLE else z_{n}[3] - z_{n}[1] end)"
    code = lambda p: f"(case when {p}_mode = 1 then {p}_key + 12 else {p}_key end)"
    prep = [f"{adaptive_sql(c)} as n_{c}" for c in _EDGES] + [f"{scale('outro', n)} as e_{n}, {scale('intro', n)} as b_{n}" for n in every] + [f"{code('outro')} as e_key, {code('intro')} as b_key"]
    e, b = (lambda n: f"l.n_outro_{n}"), (lambda n: f"r.n_intro_{n}")
    rest = lambda c: f"(1::DOUBLE - {c})"
    hard = mix_sql((0.60, rest(b("attack_time_s"))), (0.40, b("flux_peak")))
    gradual = mix_sql((0.55, b("attack_time_s")), (0.30, rest(b("rise_slope"))), (0.15, rest(b("flux_peak"))))
    unready = clip_sql(f"1::DOUBLE - greatest({e('tail_silence_s')}, 0.6::DOUBLE * {e('release_time_s')})")
    flow = clip_sql(
        f"0.28::DOUBLE * {e('abruptness')} * {hard} + 0.24::DOUBLE * {e('release_time_s')} * {gradual} + 0.18::DOUBLE * {e('tail_silence_s')} * {hard}"
        f" + 0.15::DOUBLE * {e('downbeat_strength')} * {b('downbeat_strength')} + 0.15::DOUBLE * {e('chroma_stability')} * {b('chroma_stability')} - 0.12::DOUBLE * {unready} * {hard}"
    )
    structure = clip_sql(" + ".join(f"{w}::DOUBLE * exp(-abs({e(x)} - {b(y)}) / {s}::DOUBLE)" for (x, y), (w, s) in STRUCTURE.items()))
    near = lambda names: "exp(-(" + " + ".join(f"abs(l.e_{n} - r.b_{n})" for n in names) + f") / {float(len(names))}::DOUBLE)"
    table = "[" + ", ".join(f"{s!r}::DOUBLE" for _, _, s in key_table()) + "]"
    parts = {"edge_flow": flow, "structure": structure, **{k: near(v) for k, v in closer.items()}, "tonal": f"{table}[l.e_key * 24 + r.b_key + 1]"}
    total = " + ".join(f"{WEIGHTS[k]}::DOUBLE * {k}" for k in parts)
    return f"""with m as (select * from {moods_table_sql()}),
st as (select {', '.join(stats)} from m), sd as (select {', '.join(sides)} from ({both})),
p as (select track_idx as idx, {', '.join(prep)} from m cross join st cross join sd),
x as (select l.idx as from_idx, r.idx as to_idx, {', '.join(f'{v} as {k}' for k, v in parts.items())} from p l cross join p r),
pair_scores as (select from_idx, to_idx, case when from_idx = to_idx then 0::DOUBLE else {clip_sql(f'({total}) / {sum(WEIGHTS[k] for k in parts)}::DOUBLE')} end as score, {', '.join(parts)} from x)"""


# --- genres in SQL -----------------------------------------------------------


def _best_sql(scores: list[tuple[str, str]]) -> str:
    return "list_sort([" + ", ".join(f"{{'s': -({c}), 'k': {k}, 'n': {quote(n)}}}" for k, (n, c) in enumerate(scores)) + "])"


def keyword_sql(c: str) -> str:
    """(genre, confidence) as a struct."""
    text = f"(' ' || {genre_text_sql(c)} || ' ')"
    hit = lambda w: f"(case when contains(x, {quote(f' {w} ')}) then {1 + 0.15 * w.count(' ')}::DOUBLE else 0::DOUBLE end)"
    best = _best_sql([(g, " + ".join(map(hit, ws))) for g, ws in KEYWORDS.items()])
    found = clip_sql("0.60::DOUBLE + 0.12::DOUBLE * -b[1].s + 0.08::DOUBLE * (-b[1].s + b[2].s)", 0.98)
    return f"(select case when -b[1].s > 0 then {{'genre': b[1].n, 'confidence': {found}}} else {{'genre': 'unknown', 'confidence': 0::DOUBLE}} end from (select {best} as b from (select {text} as x)))"


def votes_sql(table: str, fields: tuple[str, ...] = ("title", "artist", "tags")) -> str:
    """``track_idx, genre, confidence`` of the fields' votes."""
    order = [f for f in FIELDS if f in fields]
    rows = " union all ".join(f"select track_idx, {k} as k, v.genre as g, v.confidence * {FIELDS[f]}::DOUBLE as s from (select track_idx, {keyword_sql(f)} as v from {table}) where v.genre <> 'unknown'" for k, f in enumerate(order))
    found = clip_sql("0.50::DOUBLE + 0.20::DOUBLE * s + 0.15::DOUBLE * (s - coalesce(s2, 0::DOUBLE))", 0.95)
    return f"""(with v as ({rows}), g as (select track_idx, g, sum(s order by k) as s, min(k) as k from v group by track_idx, g),
o as (select *, lead(s) over w as s2, row_number() over w as rn from g window w as (partition by track_idx order by s desc, k))
select t.track_idx, coalesce(o.g, 'unknown') as genre, case when o.g is null then 0::DOUBLE else {found} end as confidence from {table} t left join (select * from o where rn = 1) o using (track_idx))"""


def prototype_sql(table: str) -> str:
    value = {n: norm_sql("tempo", 60, 180) if n == "tempo_norm" else n for n in PROTOTYPE_FEATURES}
    scores = [(g, "exp(-(" + " + ".join(f"abs({value[n]} - {x}::DOUBLE)" for n, x in zip(PROTOTYPE_FEATURES, p, strict=True)) + f") / {float(len(p))}::DOUBLE)") for g, p in PROTOTYPES.items()]
    found = clip_sql("0.30::DOUBLE + 0.45::DOUBLE * -b[1].s + 0.35::DOUBLE * (-b[1].s + b[2].s)", 0.90)
    return f"(select track_idx, b[1].n as genre, {found} as confidence from (select track_idx, {_best_sql(scores)} as b from {table}))"
