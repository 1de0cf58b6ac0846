"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

Each measure is a column expression over the text; each rule bounds one measure. No row leaves its
partition and no user function runs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import SPACES, table, text_of, words_of

#: The symbols that count, capital letters, and frequent short words of four languages.
SYMBOLS = "#*$%&|<>"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STOP_WORDS = (
    "the of and to in is it that was for on are as with by at be this from an or "
    "der die das und ist ein eine von den des mit für auf zu nicht sich im dem auch "
    "le la les de des et est un une dans que qui pour sur du au en ce pas "
    "el los las del y que por con para una se no es al su lo"
).split()


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``least`` and ``most``; None leaves a side open."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", least=2.0, most=14.0),
    Rule("symbols_per_word", most=0.3),
    Rule("capital_share", most=0.4),
    Rule("stop_word_share", least=0.06),
    Rule("dup_line_share", most=0.5),
    Rule("repeat_word_share", most=0.5),
)


def _dup_lines(lines: Column) -> Column:
    return F.size(lines) - F.size(F.array_distinct(lines))


def _placed_windows(words: Column) -> Column:
    """All 3-word windows of a text with their positions, in order of the windows."""
    n = F.size(words)
    starts = F.when(n >= 3, F.sequence(F.lit(0), n - 3)).otherwise(F.array().cast("array<int>"))
    count = F.greatest(n - 2, F.lit(0))
    pairs = F.zip_with(words, F.slice(words, 2, n), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    windows = F.zip_with(
        F.slice(pairs, F.lit(1), count),
        F.slice(words, F.lit(3), count),
        lambda p, c: F.struct(p.a.alias("a"), p.b.alias("b"), c.alias("c")),
    )
    # The hash goes first, so that most comparisons of the sort are of two numbers.
    hashed = lambda w, i: F.struct(F.xxhash64(w.a, w.b, w.c).alias("h"), w.alias("w"), i.alias("i"))
    return F.sort_array(F.zip_with(windows, starts, hashed))


def _repeat_words(placed: Column) -> Column:
    """Words inside windows that are found twice or more: those that equal a neighbour in the order."""
    after = F.zip_with(placed, F.slice(placed, F.lit(2), F.size(placed)), lambda x, y: F.when(x.w == y.w, F.array(x.i, y.i)))
    again = F.array_distinct(F.flatten(F.filter(after, lambda x: x.isNotNull())))
    return F.size(F.array_distinct(F.flatten(F.transform(again, lambda i: F.array(i, i + 1, i + 2)))))


def measures(docs: DataFrame) -> DataFrame:
    """Counts and ratios of each text, beside ``doc_id``.

    Null is the empty text, whose counts and ratios are 0. Repeated rows stay repeated; other columns
    are not read.
    """
    parts = docs.select("doc_id", text_of().alias("_text")).select(
        "doc_id",
        "_text",
        words_of(F.col("_text")).alias("_words"),
        F.filter(F.split("_text", "\n"), lambda line: F.length(F.translate(line, " \t\n\x0b\x0c\r", "")) > 0).alias("_lines"),
    )
    counted = parts.withColumn("_placed", _placed_windows(F.col("_words"))).select(
        "doc_id",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.regexp_replace("_text", SPACES, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        _dup_lines(F.col("_lines")).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("_placed")).cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.length("_text") - F.length(F.translate("_text", CAPITALS, ""))).cast("long").alias("n_capitals"),
        F.size(F.filter("_words", lambda w: F.lower(w).isin(*dict.fromkeys(STOP_WORDS)))).cast("long").alias("n_stop_words"),
    )

    def share(count: str, of: str) -> Column:
        return F.col(count) / F.greatest(F.col(of), F.lit(1))

    return counted.select(
        "*",
        share("word_chars", "n_words").alias("mean_word_chars"),
        share("n_symbols", "n_words").alias("symbols_per_word"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_stop_words", "n_words").alias("stop_word_share"),
        share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_word_share"),
    )


def compiled(rules: tuple[Rule, ...]) -> Column:
    """All rules as one condition."""
    passed = F.lit(True)
    for rule in rules:
        if rule.least is not None:
            passed = passed & (F.col(rule.measure) >= rule.least)
        if rule.most is not None:
            passed = passed & (F.col(rule.measure) <= rule.most)
    return passed


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document with its counts, ``base_failed`` and ``kept``; see :func:`measures`."""
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measures(docs).select("*", base.alias("base_failed"), (~base & compiled(rules)).alias("kept"))


CONTRACT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).select(*CONTRACT)


def oracle() -> str:
    """The same counts and rules, the windows counted by grouping."""
    bounds = [f"{r.measure} >= {r.least}" for r in RULES if r.least is not None]
    bounds += [f"{r.measure} <= {r.most}" for r in RULES if r.most is not None]
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
pos AS (SELECT k, words, unnest(range(1, len(words) - 1)) AS i FROM d WHERE len(words) >= 3),
wins AS (SELECT k, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS w FROM pos),
again AS (SELECT k, i FROM (SELECT k, i, count(*) OVER (PARTITION BY k, w) AS n FROM wins) WHERE n > 1),
covered AS (SELECT k, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT k, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY k),
m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words,
         length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_capitals,
         len(list_filter(words, lambda x: lower(x) IN ({stops}))) AS n_stop_words
  FROM d LEFT JOIN covered USING (k)),
r AS (
  SELECT *, word_chars / greatest(n_words, 1) AS mean_word_chars, n_symbols / greatest(n_words, 1) AS symbols_per_word,
         n_capitals / greatest(word_chars, 1) AS capital_share, n_stop_words / greatest(n_words, 1) AS stop_word_share,
         n_dup_lines / greatest(n_lines, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_word_share,
         n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {" AND ".join(bounds)} AS kept
FROM r
"""
