"""Lines that many documents share: explode normalised lines, hash, count documents per hash, drop, reassemble.

A line's key is the line without white space at its ends, with A-Z lower-cased. Only 128-bit hashes of
keys travel with ids and positions, never lines: documents are put together again where they stand, from
the runs of lines between the dropped positions. Counting first makes one row per key and document, then
one per key, both combined before the shuffle, so a line of a third of all documents is one row per task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import Tables, lookup, table, text_of
from bagwise.plans.scratch import stored

#: White space at the ends of a line, and the letters a key has in lower case.
ENDS = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class LineSettings:
    """Keys of at least ``least_chars`` code points in at least ``least_docs`` documents are dropped."""

    least_chars: int = 20
    least_docs: int = 3


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(ENDS)), UPPER, LOWER)


def _identity() -> list[Column]:
    """What tells documents apart in joins: the id, also a null one, and the text, as an id may be repeated."""
    own = F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.lit("-"))
    return [own.alias("_llm_id"), F.xxhash64(text_of()).alias("_llm_text")]


def long_lines(docs: DataFrame, settings: LineSettings) -> DataFrame:
    """``_llm_id, _llm_text, doc_id, pos, key`` of every line whose key is long enough to be judged."""
    split = docs.select(*_identity(), "doc_id", F.posexplode(lines_of(text_of())).alias("pos", "_line"))
    keyed = split.select("_llm_id", "_llm_text", "doc_id", "pos", line_key(F.col("_line")).alias("_key"))
    long = keyed.where(F.length("_key") >= settings.least_chars)
    return long.select("_llm_id", "_llm_text", "doc_id", "pos", F.unhex(F.md5("_key")).alias("key"))


def common_lines(lines: DataFrame, settings: LineSettings) -> DataFrame:
    """``key, holder`` of the keys that too many documents hold; the holder, the largest id, keeps its lines.

    Rows that repeat an id are one document. A null id is a document that is never the largest.
    """
    once = lines.select("key", "doc_id").distinct()
    held = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
    return held.where(F.col("n") >= settings.least_docs).select("key", "holder")


def _kept_text(lines: Column, dropped: Column) -> Column:
    """The lines but for those at the dropped positions (ascending), joined again: the runs between them."""
    first = F.concat(F.array(F.lit(0)), F.transform(dropped, lambda at: at + 1))
    past = F.concat(dropped, F.array(F.size(lines)))
    runs = F.filter(F.arrays_zip(first.alias("first"), past.alias("past")), lambda r: r["past"] > r["first"])
    joined = F.transform(runs, lambda r: F.array_join(F.slice(lines, r["first"] + 1, r["past"] - r["first"]), "\n"))
    return F.array_join(joined, "\n")


def without_common_lines(docs: DataFrame, settings: LineSettings = LineSettings()) -> DataFrame:
    """The documents with all their columns, ``text`` without common lines, and ``n_lines, n_dropped``.

    Null or empty text is one empty line; a text without common lines stays as it is, one of which all
    lines go is empty. Rows that repeat an id share in one document's count, and each is cut by its own
    text. An empty table gives an empty result; other columns are handed through (own columns named
    ``n_lines`` or ``n_dropped`` are replaced). Runs jobs when called.
    """
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    tables = Tables(docs.sparkSession)
    lines = tables.keep("lines", long_lines(docs, settings))
    common = tables.keep("common", common_lines(lines, settings))
    met = lookup(lines, common, ["key"], "inner").where(~F.col("doc_id").eqNullSafe(F.col("holder")))
    # At most a document's own lines come together here; repeated rows list a position twice.
    places = F.array_sort(F.collect_set("pos")).alias("_llm_dropped")
    dropped = stored(met.groupBy("_llm_id", "_llm_text").agg(places), "dropped")
    tables.drop("lines", "common")
    held = lookup(docs.select("*", *_identity()), dropped, ["_llm_id", "_llm_text"])
    # One element stands for a variable: the lines are split once, not once per run.
    own = F.struct(lines_of(text_of()).alias("lines"), F.col("_llm_dropped").alias("dropped"))
    cut = F.transform(F.array(own), lambda d: F.struct(F.size(d["lines"]).alias("n"), _kept_text(d["lines"], d["dropped"]).alias("text")))
    count = F.length(text_of()) - F.length(F.replace(text_of(), F.lit("\n"), F.lit(""))) + 1
    whole = F.struct(count.cast("int").alias("n"), text_of().alias("text"))
    done = F.when(F.col("_llm_dropped").isNull(), whole).otherwise(cut[0])
    n_dropped = F.coalesce(F.size("_llm_dropped"), F.lit(0)).cast("long").alias("n_dropped")
    out = held.withColumn("_llm_done", done)
    own_names = [F.col("_llm_done.text").alias(c) if c == "text" else F.col(f"`{c}`") for c in names]
    return out.select(*own_names, F.col("_llm_done.n").cast("long").alias("n_lines"), n_dropped)


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = without_common_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT k, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS pos FROM d),
n AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{UPPER}', '{LOWER}') AS key FROM l),
common AS (
  SELECT key, max(doc_id) AS holder FROM n WHERE length(key) >= {LineSettings.least_chars}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {LineSettings.least_docs}),
judged AS (SELECT n.*, coalesce(common.key IS NOT NULL AND n.doc_id <> holder, false) AS goes FROM n LEFT JOIN common USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (goes) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT goes), '')) AS kept_sha256
FROM judged GROUP BY k, doc_id
"""
