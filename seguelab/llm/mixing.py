"""Mixing sources to target weights, by whole repetitions and one seeded Bernoulli copy."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, hex_fraction, materialize

SEED = 17
_TOKEN = "[^ \\t\\n\\r]+"


def token_count(text: Column) -> Column:
    """Runs of characters other than space, tab and line breaks; 0 for a null text."""
    return F.coalesce(F.regexp_count(text, F.lit(_TOKEN)), F.lit(0)).cast("long")


def source_rates(docs: DataFrame, weights: Mapping[str, float] | None = None, budget: int | None = None, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, tokens, rate): the rate is how often a source's documents repeat so that its tokens are its share of the budget.

    ``weights``: target weight by source, in any unit; a source without one gets
    0.  None: all sources weigh the same.  ``budget``: tokens of the mixture; None:
    as many as the input has.  A null source is a source (named None in ``weights``).
    A source without tokens has rate 0, and its weight goes to the others.
    """
    tokens = docs.select(F.col(f"`{source_col}`").cast("string").alias("source"), token_count(F.col(f"`{text_col}`")).alias("n")).groupBy("source").agg(F.sum("n").alias("tokens"))
    if weights is None:
        weight = F.lit(1.0)
    else:
        if any(not 0 <= float(v) < float("inf") for v in weights.values()):
            raise ValueError("weights must be finite and not negative")
        weight = F.lit(0.0)
        for k, v in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(weight)
    weighted = materialize(tokens.withColumn("weight", F.when(F.col("tokens") > 0, weight).otherwise(F.lit(0.0))), "rates")
    whole = weighted.agg(F.sum("weight").alias("all_weight"), F.sum("tokens").alias("all_tokens"))
    goal = F.lit(float(budget)) if budget is not None else F.col("all_tokens").cast("double")
    rate = F.when((F.col("tokens") > 0) & (F.col("all_weight") > 0), F.col("weight") / F.col("all_weight") * goal / F.col("tokens").cast("double")).otherwise(F.lit(0.0))
    return weighted.crossJoin(F.broadcast(whole)).select("source", "tokens", rate.alias("rate"))


def mix_sources(
    docs: DataFrame,
    weights: Mapping[str, float] | None = None,
    budget: int | None = None,
    seed: int = SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    number: bool = False,
) -> DataFrame:
    """Each row floor(rate) times, and once more with the rate's fraction as probability; the columns are those of ``docs``.

    The draw is a hash of the seed and the id, so that it is the same in every
    run and on every cluster, and rows that share an id (or have none) share it.
    ``number`` adds ``copy_no`` (1, 2, ...; ``copy_no_1`` where that name is taken).
    Tokens are counted over all rows, repeated ones too.  An empty table gives an
    empty result.
    """
    rates = materialize(source_rates(docs, weights, budget, source_col, text_col), "rates")
    key, rate, copies, copy_no = (free_name(docs, x) for x in ("mix_source", "mix_rate", "mix_copies", "copy_no"))
    # a written table has a known size, by which Spark broadcasts it or splits the rows of a frequent source
    side = rates.select(F.col("source").alias(key), F.col("rate").alias(rate))
    r = F.col(f"`{rate}`")
    draw = hex_fraction(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null")))))
    counted = docs.join(side, F.col(f"`{source_col}`").cast("string").eqNullSafe(F.col(f"`{key}`"))).withColumn(copies, (F.floor(r) + (draw < r - F.floor(r)).cast("long")).cast("int"))
    emitted = counted.filter(F.col(f"`{copies}`") > 0).select(*(F.col(f"`{c}`") for c in docs.columns), F.explode(F.sequence(F.lit(1), F.col(f"`{copies}`"))).alias(copy_no))
    return emitted if number else emitted.drop(copy_no)


def mix_sql(seed: int = SEED, table: str = "documents") -> str:
    """DuckDB SQL for :func:`mix_sources` with equal weights and numbered copies."""
    return f"""
with t as (select source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r]+')))::BIGINT as tokens from {table} group by source),
w as (select *, case when tokens > 0 then 1::DOUBLE else 0::DOUBLE end as weight from t),
r as (select source, case when tokens > 0 then weight / (sum(weight) over ()) * (sum(tokens) over ())::DOUBLE / tokens::DOUBLE else 0::DOUBLE end as rate from w),
c as (select d.*, (floor(rate) + case when ('0x' || substr(md5('{seed}:' || coalesce(doc_id::VARCHAR, 'null')), 1, 13))::BIGINT::DOUBLE / {2**52}::DOUBLE < rate - floor(rate) then 1 else 0 end)::BIGINT as n
  from {table} d join r on d.source is not distinct from r.source)
select * exclude (n), unnest(range(1, n + 1))::INTEGER as copy_no from c where n > 0"""
