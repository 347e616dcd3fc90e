"""Quality rules: a threshold table compiled into one projection.

Every rule is a row (name, metric, low, high, least_words): the metric must lie in [low, high] for texts of at
least ``least_words`` words.  ``compile_rules`` turns the table into Catalyst expressions; no user function runs.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


class Rule(NamedTuple):
    name: str
    metric: str
    low: float
    high: float
    least_words: int


STOP_WORDS = "the be to of and that have with is it in for on as was by this are le la les de des et un une en du que der die das und ein eine von zu den im mit el los las y por para con se del al est est dans pour qui au aux es ist nicht".split()

#: Production thresholds.  Very short texts are judged by the rules that say something about them only.
RULES = (
    Rule("words", "n_words", 1, 10_000_000, 0),
    Rule("word_length", "mean_word_length", 1, 25, 1),
    Rule("symbols", "symbol_ratio", 0, 0.06, 5),
    Rule("capitals", "capital_ratio", 0, 0.5, 20),
    Rule("repeats", "repeat_ratio", 0, 0.2, 20),
    Rule("stop_words", "stop_word_ratio", 0.02, 1, 60),
    Rule("bullet_lines", "bullet_line_ratio", 0, 0.9, 20),
    Rule("ellipsis_lines", "ellipsis_line_ratio", 0, 0.3, 20),
)
METRICS = ("n_words", "mean_word_length", "symbol_ratio", "capital_ratio", "repeat_ratio", "stop_word_ratio", "bullet_line_ratio", "ellipsis_line_ratio")


def _ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part.cast("double") / whole, 6)).otherwise(F.lit(0.0))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with one ``q`` struct of metrics; all columns of ``docs`` stay."""
    raw = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(raw, "[ \\t\\n\\r]+"), lambda w: w != "")
    lines = F.split(raw, "\\n")
    inner = docs.select(F.struct("*").alias("__row"), raw.alias("__t"), words.alias("__w"), lines.alias("__l"))
    w, t, ln = F.col("__w"), F.col("__t"), F.col("__l")
    stops = list(dict.fromkeys(STOP_WORDS))
    counted = inner.select(
        "__row",
        F.size(w).alias("n"),
        F.size(ln).alias("nl"),
        F.length(F.regexp_replace(t, "[ \\t\\n\\r]+", "")).alias("solid"),
        F.regexp_count(t, F.lit("[#$%&*|!~^=<>{}\\\\\\[\\]@]")).alias("symbols"),
        F.regexp_count(t, F.lit("[A-ZÀ-ÖØ-Þ]")).alias("capitals"),
        F.size(F.filter(F.zip_with(F.slice(w, F.lit(2), F.greatest(F.size(w) - 1, F.lit(0))), w, lambda a, b: a == b), lambda same: same)).alias("repeats"),
        F.size(F.filter(w, lambda x: F.lower(x).isin(stops))).alias("stops"),
        F.size(F.filter(ln, lambda x: x.rlike("^ *[-*•]"))).alias("bullets"),
        F.size(F.filter(ln, lambda x: x.rlike("(\\.\\.\\.|…) *$"))).alias("ellipses"),
    )
    n, solid, nl = F.col("n"), F.col("solid"), F.col("nl")
    q = F.struct(
        n.cast("double").alias("n_words"),
        _ratio(solid, n).alias("mean_word_length"),
        _ratio(F.col("symbols"), solid).alias("symbol_ratio"),
        _ratio(F.col("capitals"), solid).alias("capital_ratio"),
        _ratio(F.col("repeats"), n).alias("repeat_ratio"),
        _ratio(F.col("stops"), n).alias("stop_word_ratio"),
        _ratio(F.col("bullets"), nl).alias("bullet_line_ratio"),
        _ratio(F.col("ellipses"), nl).alias("ellipsis_line_ratio"),
    )
    return counted.select("__row", q.alias("q"))


def compile_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules that the metrics in ``q`` break, in table order, joined by commas ('' if none)."""
    broken = [F.when((F.col("q.n_words") >= r.least_words) & ~F.col(f"q.{r.metric}").between(r.low, r.high), F.lit(r.name)) for r in rules]
    return F.concat_ws(",", *broken)


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: doc_id, the metrics, ``broken`` and ``keep``.

    Null or blank text has 0 words and breaks the rule ``words``.  A null doc_id stays null.  Repeated rows are
    judged each by itself, texts are read whole, an empty table gives an empty result, further columns are ignored.
    """
    judged = metrics(docs.select("doc_id", "text")).select(F.col("__row.doc_id").alias("doc_id"), "q", compile_rules(rules).alias("broken"))
    return judged.select("doc_id", *[F.col(f"q.{m}").alias(m) for m in METRICS], "broken", (F.col("broken") == "").alias("keep"))


def keep_good(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents that break no rule, with their own columns.

    Null, empty and blank texts break ``words`` and go; null ids stay if the text is good; repeated rows stay or go
    together; texts are read whole; an empty table gives an empty result; further columns of any name are kept.
    """
    # The filter is on the output of a generator, so that it isn't pushed below the projection, which would then be
    # evaluated anew for every rule.
    judged = metrics(docs).select("__row", F.explode(F.array("q")).alias("q"))
    return judged.where(compile_rules(rules) == "").select("__row.*")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    stops = ", ".join(f"'{s}'" for s in dict.fromkeys(STOP_WORDS))
    ratio = "CASE WHEN {1} > 0 THEN round(CAST({0} AS DOUBLE) / {1}, 6) ELSE 0.0 END AS {2}"
    made = [("solid", "n", "mean_word_length"), ("symbols", "solid", "symbol_ratio"), ("capitals", "solid", "capital_ratio"), ("repeats", "n", "repeat_ratio"), ("stops", "n", "stop_word_ratio"), ("bullets", "nl", "bullet_line_ratio"), ("ellipses", "nl", "ellipsis_line_ratio")]
    broken = ", ".join(f"CASE WHEN n_words >= {r.least_words} AND NOT ({r.metric} BETWEEN {r.low} AND {r.high}) THEN '{r.name}' END" for r in RULES)
    return f"""
WITH a AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
b AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[ \\t\\n\\r]+'), lambda x: x <> '') AS w, string_split(t, chr(10)) AS l FROM a),
c AS (SELECT doc_id, len(w) AS n, len(l) AS nl, length(regexp_replace(t, '[ \\t\\n\\r]+', '', 'g')) AS solid,
 len(regexp_extract_all(t, '[#$%&*|!~^=<>{{}}\\\\\\[\\]@]')) AS symbols, len(regexp_extract_all(t, '[A-ZÀ-ÖØ-Þ]')) AS capitals,
 len(list_filter(list_zip(w[2:], w[:-2]), lambda p: p[1] = p[2])) AS repeats,
 len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
 len(list_filter(l, lambda x: regexp_matches(x, '^ *[-*•]'))) AS bullets,
 len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…) *$'))) AS ellipses FROM b),
d AS (SELECT doc_id, CAST(n AS DOUBLE) AS n_words, {", ".join(ratio.format(*m) for m in made)} FROM c)
SELECT *, concat_ws(',', {broken}) AS broken, concat_ws(',', {broken}) = '' AS keep FROM d"""


SQL = _sql()
