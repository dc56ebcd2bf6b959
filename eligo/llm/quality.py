"""Quality rules: a threshold table compiled into one Spark projection of length, symbol, stop-word and line ratios.
No user function is evaluated."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Common words of the supported languages, two letters or more.
STOP_WORDS = (
    "the of and to in is that for it was on with as by at from are this be or an "
    "der die das und ist von zu den mit im ein eine nicht auf für des dem "
    "le la les de des et est un une du en que qui dans pour par au avec sur "
    "el los las del y se por una su al lo con para como"
).split()
#: White space as the contract has it.
SPACE = r"[\x20\x09-\x0D]+"


class Rule(NamedTuple):
    """A document fails where the measure lies outside [low, high]; None is no bound."""

    name: str
    measure: str
    low: float | None = None
    high: float | None = None


RULES = (
    Rule("mean_word_length", "word_chars / n_words", 3.0, 7.5),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.1),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.06, None),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.3),
    Rule("repeat_word_ratio", "n_repeat_words / n_words", None, 0.5),
    Rule("letter_word_ratio", "n_letter_words / n_words", 0.8, None),
    Rule("shout_ratio", "n_shouts / n_words", None, 0.1),
    Rule("ellipsis_line_ratio", "n_ellipsis_lines / n_lines", None, 0.3),
    Rule("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9),
)


def _repeat_words(words: Column, n: Column) -> Column:
    """Words in three-word windows found twice or more. Windows are sorted with their places, so that equal ones are
    neighbours; in linear-logarithmic time at any length of text."""
    windows = F.when(
        n >= 3,
        F.sort_array(F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.struct(F.concat_ws(" ", F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("w"), i.alias("i")))),
    )
    return windows


def measures(docs: DataFrame, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """The counts that rules may use, one row for each row of docs, with the columns `keep`. Null text is empty."""
    base = docs.select(*keep, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    split = base.select(*keep, "__text", F.filter(F.split("__text", SPACE), lambda w: w != "").alias("__words"), F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("__lines"))
    sized = split.select("*", F.size("__words").alias("__n"))
    sorted_windows = sized.select("*", _repeat_words(F.col("__words"), F.col("__n")).alias("__w"))

    places = sorted_windows.select("*", F.transform(F.filter("__w", lambda x, i: F.coalesce(F.when(i > 0, F.get(F.col("__w"), i - 1)["w"] == x["w"]), F.lit(False)) | F.coalesce(F.get(F.col("__w"), i + 1)["w"] == x["w"], F.lit(False))), lambda x: x["i"]).alias("__at"))
    covered = F.size(F.array_distinct(F.concat("__at", F.transform("__at", lambda i: i + 1), F.transform("__at", lambda i: i + 2))))
    lower = F.lower(F.col("__text"))
    stop = F.regexp_count(lower, F.lit(r"(?<![\p{L}\p{N}])(?:" + "|".join(STOP_WORDS) + r")(?![\p{L}\p{N}])"))
    long = lambda c: c.cast("long")
    return places.select(
        *keep,
        long(F.col("__n")).alias("n_words"),
        long(F.aggregate("__words", F.lit(0), lambda a, w: a + F.length(w))).alias("word_chars"),
        long(F.regexp_count("__text", F.lit(r"[#*$%&|<>]"))).alias("n_symbols"),
        long(F.size("__lines") - F.size(F.array_distinct("__lines"))).alias("n_dup_lines"),
        long(F.greatest(F.coalesce(covered, F.lit(0)), F.lit(0))).alias("n_repeat_words"),
        long(F.size("__lines")).alias("n_lines"),
        long(stop).alias("n_stop_words"),
        long(F.size(F.filter("__words", lambda w: w.rlike(r"\p{L}")))).alias("n_letter_words"),
        long(F.regexp_count("__text", F.lit(r"[!?]{2,}"))).alias("n_shouts"),
        long(F.size(F.filter("__lines", lambda x: x.rlike(r"(?:\.\.\.|…)[\x20\x09-\x0D]*$")))).alias("n_ellipsis_lines"),
        long(F.size(F.filter("__lines", lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]")))).alias("n_bullet_lines"),
    )


def failed_rules(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one expression: names of the rules that a row of measures fails. 0/0 fails nothing."""

    def fails(r: Rule) -> Column:
        ratio = F.expr(r.measure.replace(" / ", " / nullif(") + ", 0)")
        bounds = [c for c in (ratio < r.low if r.low is not None else None, ratio > r.high if r.high is not None else None) if c is not None]
        test = bounds[0] if len(bounds) == 1 else bounds[0] | bounds[1]
        return F.when(F.coalesce(test, F.lit(False)), F.lit(r.name))

    return F.filter(F.array(*[fails(r) for r in rules]), lambda x: x.isNotNull())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words")
    found = measures(docs, keep=("doc_id",)).withColumn("base_failed", base).withColumn("failed", failed_rules())
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & (F.size("failed") == 0)).alias("kept"))


OP5_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, text FROM d
), win AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
), named AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS k FROM win
), twice AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM named) WHERE n > 1
), rep AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY doc_id
), m AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}\p{{N}}]+'), lambda x: list_contains({STOP_WORDS!r}, x))) AS n_stop,
    len(list_filter(words, lambda x: regexp_matches(x, '\p{{L}}'))) AS n_letter,
    len(regexp_extract_all(text, '[!?]{{2,}}')) AS n_shouts,
    len(list_filter(lines, lambda x: regexp_matches(x, '(?:\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis,
    len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words)
    AND word_chars / n_words BETWEEN 3.0 AND 7.5 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.06
    AND n_dup_lines / n_lines <= 0.3 AND n_repeat_words / n_words <= 0.5 AND n_letter / n_words >= 0.8 AND n_shouts / n_words <= 0.1
    AND n_ellipsis / n_lines <= 0.3 AND n_bullet / n_lines <= 0.9 AS kept
FROM m
"""
