"""Quality rules: a threshold table compiled into one projection of built-in functions.

Operator 7. ``measures`` adds the measured columns, ``verdict`` turns a table of thresholds into one boolean
column, ``quality_rules`` does both. No shuffle, no user function; a row is judged on its own, so hot sources
and copies need no care.

Defined results: a null text counts as an empty one (zero everywhere, rejected). Null in any other column is
kept as it is. Repeated rows are judged alike. An empty table gives an empty result. Columns of the input with
the name of a result column are replaced by the result.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm.common import let, table, words_of

SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four languages of the corpus.
STOP_WORDS = """
the of and to in is that for it with as on by this be are at from or an
de la le les des un une et en que qui dans du pour par avec au pas sur el los las del y se es una con
der die das und zu den von mit ist im ein eine nicht auf für dem sich auch als
""".split()


class Rule(NamedTuple):
    """A row of the threshold table: the measure has to lie in [low, high]; None leaves an end open."""

    measure: str
    low: float | None
    high: float | None


#: Production thresholds. Ratios are per word, except dup_line_ratio, which is per line with a word.
RULES = (
    Rule("n_words", 50, 100_000),
    Rule("repeat_word_ratio", None, 0.5),
    Rule("mean_word_length", 2, 14),
    Rule("symbol_ratio", None, 0.2),
    Rule("stop_word_ratio", 0.02, None),
    Rule("dup_line_ratio", None, 0.6),
)


def _repeat_words(words: Column) -> Column:
    """Words inside a 3-word window that the text holds twice or more."""

    def windows(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.struct(F.concat_ws(" ", w[i], w[i + 1], w[i + 2]).alias("g"), i.alias("i")))

    def repeated(s: Column) -> Column:
        twice = F.filter(s, lambda x, j: ((j > 0) & (F.get(s, j - 1)["g"] == x["g"])) | F.coalesce(F.get(s, j + 1)["g"] == x["g"], F.lit(False)))
        starts = F.sort_array(F.transform(twice, lambda x: x["i"]))
        fold = F.aggregate(
            starts,
            F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n")),
            lambda acc, i: F.struct(i.alias("last"), (acc["n"] + F.least(F.lit(3), i - acc["last"])).alias("n")),
        )
        return fold["n"]

    # Words are bound once: inside a lambda the optimiser would have them split again for each window.
    return let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).otherwise(let(F.sort_array(windows(w)), repeated)))


def measures(docs: DataFrame) -> DataFrame:
    """The input's columns with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, n_stop_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ("_words", "_lines", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_stop_words")
    rows = docs.drop(*[c for c in docs.columns if c.lower() in names])
    bare = F.translate(text, " \t\x0b\x0c\r", "")
    # A line is told apart by its text as it stands; one without a word doesn't count.
    full = F.filter(F.split(text, "\n"), lambda x: F.translate(x, " \t\x0b\x0c\r", "") != "")
    folded = F.transform(F.col("_words"), lambda w: F.lower(w))
    return (
        rows.withColumn("_words", words_of(F.col("text")))
        .withColumn("_lines", full)
        .withColumns(
            {
                "n_words": F.size("_words").cast("long"),
                "word_chars": F.char_length(F.translate(bare, "\n", "")).cast("long"),
                "n_symbols": (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).cast("long"),
                "n_lines": F.size("_lines").cast("long"),
                "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
                "n_repeat_words": _repeat_words(F.col("_words")),
                "n_stop_words": F.size(F.filter(folded, lambda w: w.isin(*sorted(set(STOP_WORDS))))).cast("long"),
            }
        )
        .drop("_words", "_lines")
    )


def _ratio(part: str, whole: str) -> Column:
    return F.when(F.col(whole) > 0, F.col(part) / F.col(whole)).otherwise(F.lit(0.0))


MEASURES = {
    "n_words": lambda: F.col("n_words").cast("double"),
    "mean_word_length": lambda: _ratio("word_chars", "n_words"),
    "symbol_ratio": lambda: _ratio("n_symbols", "n_words"),
    "stop_word_ratio": lambda: _ratio("n_stop_words", "n_words"),
    "dup_line_ratio": lambda: _ratio("n_dup_lines", "n_lines"),
    "repeat_word_ratio": lambda: _ratio("n_repeat_words", "n_words"),
}


def verdict(rules=RULES) -> Column:
    """True where every rule of the table holds."""
    held = F.lit(True)
    for rule in rules:
        value = MEASURES[rule.measure]()
        if rule.low is not None:
            held = held & (value >= F.lit(float(rule.low)))
        if rule.high is not None:
            held = held & (value <= F.lit(float(rule.high)))
    return held


def quality_rules(docs: DataFrame, rules=RULES) -> DataFrame:
    """All columns of the input, the measures, base_failed and kept."""
    rows = measures(docs.drop(*[c for c in docs.columns if c.lower() in ("base_failed", "kept")]))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    # The row number, always true, keeps a filter on the verdict above the measures: below, they'd be computed for each use.
    return rows.withColumns({"base_failed": failed, "kept": ~failed & verdict(rules) & (F.monotonically_increasing_id() >= 0)})


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_stop_words", "base_failed", "kept")


_STOPS = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))
ORACLE_SQL = rf"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), k AS (SELECT row_number() OVER () AS r, * FROM t),
g AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM k WHERE len(w) >= 3),
h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM h WHERE c > 1) GROUP BY r),
m AS (
  SELECT k.doc_id, len(w)::BIGINT AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
    coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(w, lambda x: lower(x) IN ({_STOPS})))::BIGINT AS n_stop_words
  FROM k LEFT JOIN rep ON rep.r = k.r
), f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_stop_words, base_failed,
  NOT base_failed AND n_words <= 100000 AND word_chars / n_words BETWEEN 2 AND 14 AND n_symbols / n_words <= 0.2
    AND n_stop_words / n_words >= 0.02 AND n_dup_lines / n_lines <= 0.6 AS kept
FROM f
"""
