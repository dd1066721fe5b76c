"""The corpus pipeline: documents in, the mixture's tokens out.

Every stage takes empty tables, repeated rows and columns of other names; null
and empty values have the result that its docstring states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seguelab.llm import bpe, minhash, mixing, pii, quality_rules
from seguelab.llm.common import drop_table, materialize


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that break a quality rule go; a null or empty text breaks the length rule.

    Ids may be null or repeated: each row is judged by its text alone, read whole.
    """
    return quality_rules.keep_good(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one of the least id.

    Rows with a null id stay, as do texts without words.  Of rows that repeat an id
    the one of the least text stays.  Long texts are compared whole.
    """
    return minhash.drop_near_duplicates(docs)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; ``n_chars``, where there is such a column, follows the text.

    All rows stay, in all columns; a null text stays null and has a null length.
    """
    out = pii.redact_column(docs)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources repeat, or are thinned, until all have the same share of the tokens.

    A null source is a source; rows that share an id, or have none, share their
    draw.  A source without tokens goes.
    """
    return mixing.mix_sources(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens, round_trip) for every row; ``lang`` and ``source`` where there are such columns.

    A null text has null tokens and a null round trip, an empty one no tokens.
    """
    return bpe.encode_documents(docs, keep=tuple(c for c in ("lang", "source") if c in docs.columns))


#: Near duplicates go before PII is replaced, so that the replacement makes no two documents alike; the mixture is weighed by what is left.
STAGES = [("quality_rules", keep_good), ("minhash_near_dedup", drop_near_duplicates), ("pii", redact), ("mixing", mix), ("bpe", tokenise)]

#: SQL can't express the near duplicates; tests/llm/test_pipeline.py holds every stage and the whole against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each but the last is written to the shared folder and read again by the next."""
    return run_on(spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir)


def run_on(spark: SparkSession, docs: DataFrame, sf_dir: str = "") -> DataFrame:
    """As :func:`run` over a table of documents; a stage's table goes when the next one's is written."""
    written = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
        if written is not None:
            drop_table(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
