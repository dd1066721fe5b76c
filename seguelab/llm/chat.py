"""Chat formatting: logged conversations that are prefixes of longer ones collapse, the maximal ones are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

END = "<|end|>"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _turns(turns: DataFrame) -> DataFrame:
    return turns.select(F.col("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).filter("conv_id is not null")


def _digest() -> Column:
    return F.md5(F.concat(_text("role"), F.lit("\x1f"), _text("text")))


def _bits(digest: Column, start: int) -> Column:
    return F.conv(F.substring(digest, start, 15), 16, 10).cast("long")


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, n, total, a, b): the rolling hash (a, b) of the first n of a conversation's turns.

    The hash is the exclusive or of one digest for each turn and its place, so
    one running window yields those of all prefixes.
    """
    light = _turns(turns).select("conv_id", "turn", _digest().alias("d")).repartition("conv_id").dropDuplicates(["conv_id", "turn", "d"])
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "d")
    placed = light.withColumn("n", F.row_number().over(order)).withColumn("h", F.md5(F.concat_ws(":", F.col("n").cast("string"), "d")))
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select("conv_id", "n", F.count("*").over(Window.partitionBy("conv_id")).alias("total"), F.bit_xor(_bits(F.col("h"), 1)).over(running).alias("a"), F.bit_xor(_bits(F.col("h"), 17)).over(running).alias("b"))


def maximal_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that are no prefix of a longer one; of equal ones the least id stays."""
    hashes = prefix_hashes(turns)
    whole = hashes.filter("n = total").groupBy("n", "a", "b").agg(F.min("conv_id").alias("conv_id"))
    inner = hashes.filter("n < total").select("n", "a", "b")
    return whole.join(inner, ["n", "a", "b"], "left_anti").select("conv_id", F.col("n").cast("long").alias("n_turns"))


def format_chats(turns: DataFrame, end: str = END) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations, each turn as ``<|role|>``, its text and an end mark.

    Turns go by number, then by the digest of role and text, a null number
    first.  A repeated row counts once; turns that share a number all stay.  A null
    role or text counts as empty, a conversation without id is left out.  Ids keep
    their type.  A very long text is rendered whole.  An empty table gives an empty result;
    other columns are ignored.
    """
    kept = maximal_conversations(turns)
    rows = _turns(turns).withColumn("d", _digest()).join(kept, "conv_id")
    line = F.concat(F.lit("<|"), _text("role"), F.lit("|>\n"), _text("text"), F.lit(end), F.lit("\n"))
    lists = rows.groupBy("conv_id", "n_turns").agg(F.array_sort(F.collect_set(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**63))).alias("turn"), "d", line.alias("line")))).alias("lines"))
    return lists.select("conv_id", "n_turns", F.array_join(F.transform("lines", lambda x: x["line"]), "").alias("rendered"))


SQL = f"""
with t as (select distinct conv_id, turn, md5(coalesce(role, '') || chr(31) || coalesce(text, '')) as d,
  '<|' || coalesce(role, '') || '|>' || chr(10) || coalesce(text, '') || '{END}' || chr(10) as line from conversations where conv_id is not null),
p as (select *, row_number() over (partition by conv_id order by turn nulls first, d) as n, count(*) over (partition by conv_id) as total from t),
h as (select conv_id, n, total, string_agg(d, '') over (partition by conv_id order by n rows unbounded preceding) as prefix from p),
whole as (select min(conv_id) as conv_id, n, prefix from h where n = total group by n, prefix),
kept as (select conv_id, n from whole w where not exists (select 1 from h where h.n = w.n and h.prefix = w.prefix and h.total > h.n))
select k.conv_id, k.n::BIGINT as n_turns, string_agg(p.line, '' order by p.n) as rendered from kept k join p using (conv_id) group by 1, 2"""
