"""Quality rules: a table of thresholds compiled into one projection of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name

STOP_WORDS = (
    "the", "and", "of", "to", "in", "is", "that", "for", "with", "on", "was", "it", "a", "an", "are", "as", "by", "this", "from", "at", "be", "or",
    "der", "die", "das", "und", "den", "von", "zu", "mit", "sich", "des", "auf", "für", "ist", "im", "dem", "nicht", "ein", "eine", "als", "auch",
    "le", "la", "les", "et", "des", "du", "un", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "avec",
    "el", "los", "las", "y", "en", "que", "se", "por", "con", "para", "una", "su", "al", "es", "lo", "como", "del",
)
SYMBOLS = "#*$%&{}<>|~^="

#: (rule, metric, least, most, words from which it holds).  None: no bound.
THRESHOLDS: tuple[tuple[str, str, float | None, float | None, int], ...] = (
    ("length", "n_words", 1, 200_000, 0),
    ("word_length", "mean_word_length", 2.0, 12.0, 1),
    ("symbols", "symbol_ratio", None, 0.05, 1),
    ("letters", "alpha_word_ratio", 0.7, None, 1),
    ("shouting", "upper_word_ratio", None, 0.5, 5),
    ("stop_words", "stop_word_ratio", 0.04, None, 50),
    ("repeated_words", "repeat_ratio", None, 0.2, 5),
    ("repeated_lines", "repeated_line_ratio", None, 0.6, 1),
    ("bullets", "bullet_line_ratio", None, 0.9, 10),
    ("ellipses", "ellipsis_line_ratio", None, 0.3, 10),
)

_SYMBOL_CLASS = "[" + "".join("\\" + c for c in SYMBOLS) + "]"
METRICS = ("n_words", "mean_word_length", "symbol_ratio", "alpha_word_ratio", "upper_word_ratio", "stop_word_ratio", "repeat_ratio", "repeated_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _one_of(words: tuple[str, ...]) -> str:
    """A regular expression of the words as a tree of their letters, the longer ones first."""
    tree: dict = {}
    for word in words:
        node = tree
        for c in word:
            node = node.setdefault(c, {})
        node[""] = {}

    def build(node: dict) -> str:
        rest = [c + build(x) for c, x in sorted(node.items()) if c]
        return ("(?:" + "|".join(rest) + ")" + ("?" if "" in node else "")) if rest else ""

    return build(tree)


#: Whole words in one pass over a text: nothing but spaces or an end on both sides.
_START, _STOP, _CHARACTER = "(?<![^ \\t\\n\\r])", "(?![^ \\t\\n\\r])", "[^ \\t\\n\\r]"
_STOP_WORD = f"{_START}{_one_of(tuple(sorted(set(STOP_WORDS))))}[.,;:!?]*+{_STOP}"
_REPEATED = f"{_START}({_CHARACTER}++)(?=[ \\t\\n\\r]++\\1{_STOP})"
_NO_SMALL = f"{_START}[^ \\t\\n\\ra-z]++{_STOP}"


def _metrics(p: Column) -> dict[str, Column]:
    """Of a struct of the text ``t``, its filled lines ``l`` and its number of words ``n``."""
    text, lines, n = p["t"], p["l"], p["n"]
    chars, n_lines = F.length(text), F.size(lines)
    share = lambda count, whole: F.when(whole > 0, F.round(count.cast("double") / whole, 6)).otherwise(F.lit(0.0))
    count = lambda array, test: F.size(F.filter(array, test))
    found = lambda pattern: F.regexp_count(text, F.lit(pattern))
    shouted = F.regexp_extract_all(text, F.lit(_NO_SMALL), F.lit(0))
    return {
        "n_words": n.cast("long"),
        "mean_word_length": share(chars - F.length(F.regexp_replace(text, "[^ \\t\\n\\r]++", "")), n),
        "symbol_ratio": share(found(_SYMBOL_CLASS), chars),
        "alpha_word_ratio": share(found(f"\\p{{L}}{_CHARACTER}*+"), n),
        "upper_word_ratio": share(count(shouted, lambda x: (x == F.upper(x)) & (x != F.lower(x))), n),
        "stop_word_ratio": share(F.regexp_count(F.lower(text), F.lit(_STOP_WORD)), n),
        "repeat_ratio": share(found(_REPEATED), n),
        "repeated_line_ratio": share(n_lines - F.size(F.array_distinct(lines)), n_lines),
        "bullet_line_ratio": share(count(lines, lambda x: x.startswith("-") | x.startswith("*") | x.startswith("•")), n_lines),
        "ellipsis_line_ratio": share(count(lines, lambda x: x.endswith("...") | x.endswith("…")), n_lines),
    }


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: neither a filter nor a merged projection computes it again."""
    return F.transform(F.array(value), use)[0]


def _rule(metric: Column, n_words: Column, least: float | None, most: float | None, from_words: int) -> Column:
    """Whether a document breaks the rule."""
    broken = F.lit(False)
    if least is not None:
        broken = broken | (metric < F.lit(float(least)))
    if most is not None:
        broken = broken | (metric > F.lit(float(most)))
    return broken & (n_words >= from_words) if from_words else broken


def measured(docs: DataFrame, text_col: str, thresholds=THRESHOLDS) -> tuple[DataFrame, str]:
    """``docs`` with a struct of the metrics, the broken rules and the verdict, and the struct's name."""
    text, out = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), free_name(docs, "quality")
    parts = F.struct(text.alias("t"), F.filter(F.split(text, "\n"), lambda x: x != "").alias("l"), F.regexp_count(text, F.lit(_CHARACTER + "++")).alias("n"))

    def judge(m: Column) -> Column:
        broken = F.array_compact(F.array(*(F.when(_rule(m[k], m["n_words"], lo, hi, n), F.lit(rule)) for rule, k, lo, hi, n in thresholds)))
        return F.struct(*(m[k].alias(k) for k in METRICS), F.array_join(broken, ",").alias("broken"))

    return docs.withColumn(out, _let(parts, lambda p: _let(F.struct(*(c.alias(k) for k, c in _metrics(p).items())), judge))), out


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """(doc_id, each metric, broken, keep) for every row; ``broken`` lists the rules broken, ``keep`` is whether there are none.

    Words are runs of characters other than space, tab and line breaks; a line
    with no characters doesn't count.  A null text counts as empty; an empty
    text has no words and breaks the length rule.  A ratio over nothing is 0.
    Null ids, repeated rows and other columns make no difference to a row's
    verdict; an empty table gives an empty result.
    """
    judged, q = measured(docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text")), "text", thresholds)
    return judged.select("doc_id", *(f"{q}.{k}" for k in METRICS), f"{q}.broken", (F.col(f"{q}.broken") == "").alias("keep"))


def keep_good(docs: DataFrame, text_col: str = "text", thresholds=THRESHOLDS) -> DataFrame:
    """The rows of ``docs`` that break no rule, with the columns of ``docs``; for special cases see :func:`quality_report`."""
    judged, q = measured(docs, text_col, thresholds)
    return judged.filter(F.col(f"`{q}`.broken") == "").drop(q)


def _sql_rule(metric: str, least, most, from_words: int) -> str:
    tests = [f"{metric} {op} {float(x)}::DOUBLE" for op, x in (("<", least), (">", most)) if x is not None]
    return f"(({' or '.join(tests)}) and n_words >= {from_words})"


def report_sql(table: str = "documents", thresholds=THRESHOLDS) -> str:
    """DuckDB SQL for :func:`quality_report`."""
    share = lambda count, whole: f"case when {whole} > 0 then round(({count})::DOUBLE / ({whole}), 6) else 0::DOUBLE end"
    stop = ", ".join(f"'{x}'" for x in sorted(set(STOP_WORDS)))
    n, n_lines = "len(w)", "len(l)"
    metrics = {
        "n_words": "len(w)",
        "mean_word_length": share("length(array_to_string(w, ''))", n),
        "symbol_ratio": share(f"len(regexp_extract_all(t, '{_SYMBOL_CLASS}'))", "length(t)"),
        "alpha_word_ratio": share("len(list_filter(w, lambda x: regexp_matches(x, '\\p{L}')))", n),
        "upper_word_ratio": share("len(list_filter(w, lambda x: x = upper(x) and x <> lower(x)))", n),
        "stop_word_ratio": share(f"len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') in ({stop})))", n),
        "repeat_ratio": share("len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1]))", n),
        "repeated_line_ratio": share("len(l) - len(list_distinct(l))", n_lines),
        "bullet_line_ratio": share("len(list_filter(l, lambda x: x[1] in ('-', '*', '•')))", n_lines),
        "ellipsis_line_ratio": share("len(list_filter(l, lambda x: suffix(x, '...') or suffix(x, '…')))", n_lines),
    }
    rules = ", ".join(f"case when {_sql_rule(k, lo, hi, fw)} then '{rule}' end" for rule, k, lo, hi, fw in thresholds)
    return f"""
with a as (select doc_id, coalesce(text, '') as t from {table}),
b as (select doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '') as w, list_filter(string_split(t, chr(10)), lambda x: x <> '') as l from a),
c as (select doc_id, {', '.join(f'{v} as {k}' for k, v in metrics.items())} from b),
d as (select *, array_to_string(list_filter([{rules}], lambda x: x is not null), ',') as broken from c)
select *, broken = '' as keep from d"""
