"""How far the sources of each language diverge in their terms, from in-mapper stripes.

Each task folds whole documents into stripes: per language and term the number of documents that hold it
and its count in every source. After so many bytes of text a task hands its stripes on and starts afresh.
Stripes are merged by key from sorted partitions as they stream by, so a frequent term is a few rows a task.

Divergences come straight from the merged stripes. A pair of sources sums f over all kept terms, but most
terms occur in few sources, so the sum is put together from what differs from "in neither": the terms of
one source, by a histogram of their counts, and a correction for terms of both, folded from the stripes
inside tasks. All of it is integer arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bagwise.llm.common import lookup, table
from bagwise.llm.line_dedup import LOWER, UPPER
from bagwise.plans.scratch import stored

#: Bytes in lower case, with a space for each that is no ASCII letter and not beyond ASCII.
TERM_BYTES = bytes(b if chr(b).isalpha() or b >= 0x80 else 0x20 for b in bytes(range(256)).lower())
#: Bytes of text after which a task hands its stripes on; rows it merges, and pairs it works out, at a time.
UNIT = 12 << 20
ROWS = 20_000
PAIRS = 1 << 20
STRIPE = "lang string, term string, docs long, sources array<string>, counts array<long>"
STRIPE_NAMES = ["lang", "term", "docs", "sources", "counts"]


@dataclass(frozen=True)
class AuditSettings:
    """Terms of at least ``least_docs`` documents of their language; probabilities in units of 1 / ``unit``."""

    least_docs: int = 10
    smoothing: int = 2
    unit: int = 1_000_000_000
    top: int = 10


def runs(*keys: np.ndarray) -> np.ndarray:
    """Where each run of equal neighbours begins."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    changes = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return np.flatnonzero(np.r_[True, changes])


def _lists(values: pa.Array, starts: np.ndarray, total: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[starts, total].astype(np.int32)), values)


def stripes_of(langs: list[str], sources: list[str], texts: list[bytes]) -> pa.RecordBatch:
    """The stripes of some documents."""
    lists = pc.ascii_split_whitespace(pa.array([t.translate(TERM_BYTES).strip() for t in texts], pa.string()))
    terms = lists.flatten().dictionary_encode()
    term = terms.indices.to_numpy().astype(np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
    if len(terms.dictionary):
        some = pc.binary_length(terms.dictionary).to_numpy() > 0  # a text without terms is one empty one
        term, doc = term[some[term]], doc[some[term]]
    # Groups are numbered by language first, so those of a language are neighbours.
    groups = sorted(set(zip(langs, sources)))
    number = {g: i for i, g in enumerate(groups)}
    group = np.array([number[g] for g in zip(langs, sources)], np.int64)
    lang_of = np.unique([lang for lang, _ in groups], return_inverse=True)[1]
    # A count for every term of a document, then sums for every term of a group.
    width = len(terms.dictionary)
    pairs, counts = np.unique(doc * width + term, return_counts=True)
    key = pairs % max(width, 1) * len(groups) + group[pairs // max(width, 1)]
    order = np.argsort(key, kind="stable")
    key, counts = key[order], counts[order]
    at = runs(key)
    entries, docs = key[at], np.diff(np.r_[at, len(key)])
    counts = np.add.reduceat(counts, at) if len(at) else counts
    term, of = entries // len(groups), entries % len(groups)
    stripe = runs(term, lang_of[of])
    docs = np.add.reduceat(docs, stripe) if len(stripe) else docs
    names = [pa.array([g[i] for g in groups], pa.string()) for i in (0, 1)]
    columns = [
        names[0].take(pa.array(of[stripe])),
        terms.dictionary.take(pa.array(term[stripe])),
        pa.array(docs, pa.int64()),
        _lists(names[1].take(pa.array(of)), stripe, len(of)),
        _lists(pa.array(counts, pa.int64()), stripe, len(of)),
    ]
    return pa.RecordBatch.from_arrays(columns, STRIPE_NAMES)


def merge_stripes(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
    """One stripe for each run of rows; ``starts`` says where runs begin."""
    lists, counts = rows.column("sources"), rows.column("counts").flatten().to_numpy()
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, rows.num_rows]))
    entry = np.repeat(run, np.diff(lists.offsets.to_numpy()))
    sources = lists.flatten().dictionary_encode()
    key = entry * len(sources.dictionary) + sources.indices.to_numpy()
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = runs(key)
    entry = key[at] // max(len(sources.dictionary), 1)
    first = np.searchsorted(entry, np.arange(len(starts)))
    columns = [
        rows.column("lang").take(pa.array(starts)),
        rows.column("term").take(pa.array(starts)),
        pa.array(np.add.reduceat(rows.column("docs").to_numpy(), starts) if len(starts) else [], pa.int64()),
        _lists(sources.dictionary.take(pa.array(key[at] % max(len(sources.dictionary), 1))), first, len(at)),
        _lists(pa.array(np.add.reduceat(counts[order], at) if len(at) else [], pa.int64()), first, len(at)),
    ]
    return pa.RecordBatch.from_arrays(columns, STRIPE_NAMES)


def _sources(docs: DataFrame) -> list[Column]:
    return [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]


def task_stripes(docs: DataFrame) -> DataFrame:
    """Stripes of each task's documents; a term comes once per task and handing-on."""

    def folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = ([], [], []), 0
        for batch in batches:
            texts = batch.column("text").cast(pa.binary())
            langs, sources = (batch.column(c).to_pylist() for c in ("lang", "source"))
            for lang, source, text in zip(langs, sources, texts):
                for values, value in zip(held, (lang, source, text.as_py())):
                    values.append(value)
                size += len(held[2][-1])
                if size >= UNIT:
                    yield stripes_of(*held)
                    held, size = ([], [], []), 0
        if held[0]:
            yield stripes_of(*held)

    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    return docs.select(*_sources(docs), text).mapInArrow(folded, STRIPE)


def merged_stripes(parts: DataFrame, settings: AuditSettings) -> DataFrame:
    """One stripe per kept term of a language. A task holds a batch of rows, and of a longer run one row."""

    def kept(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        docs = np.add.reduceat(rows.column("docs").to_numpy(), starts)
        ends = np.r_[starts[1:], rows.num_rows]
        some = docs >= settings.least_docs
        lengths = (ends - starts)[some]
        inside = np.repeat(starts[some] - np.r_[0, np.cumsum(lengths)[:-1]], lengths) + np.arange(lengths.sum())
        return merge_stripes(rows.take(pa.array(inside)), np.r_[0, np.cumsum(lengths)[:-1]].astype(np.int64)[: some.sum()])

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.concat_batches([held, batch]) if held is not None else batch
            codes = [rows.column(c).dictionary_encode().indices.to_numpy() for c in ("lang", "term")]
            starts = runs(*codes)
            last = int(starts[-1])
            if last:
                yield kept(rows.slice(0, last), starts[:-1])
            held = rows.slice(last)
            if held.num_rows > ROWS:
                held = merge_stripes(held, np.zeros(1, np.int64))
        if held is not None:
            yield kept(held, np.zeros(1, np.int64))

    return parts.repartition("lang", "term").sortWithinPartitions("lang", "term").mapInArrow(merged, STRIPE)


def _probability(count: Column, total: Column, terms: Column, settings: AuditSettings) -> Column:
    """``1 + floor(unit (count + s) / (total + s terms))``, null without kept terms; wide enough for any count."""
    s = settings.smoothing
    above = (count + s).cast("decimal(20,0)") * F.lit(settings.unit).cast("decimal(10,0)")
    below = (total + s * terms).cast("decimal(20,0)")
    return F.when(terms > 0, F.call_function("div", above, below) + 1)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _f(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def _summed(keys: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, values = keys[order], values[order]
    at = runs(keys)
    return keys[at], np.add.reduceat(values, at) if len(at) else values


def pair_parts(lengths: np.ndarray, number: np.ndarray, p: np.ndarray, z: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys ``number << 32 | number`` and values of all pairs within stripes, some pairs at a time.

    Each entry meets the later ones of its stripe.
    """
    ends = np.repeat(np.cumsum(lengths), lengths)
    later = ends - np.arange(len(ends)) - 1
    upto = np.cumsum(later)
    at = 0
    while at < len(ends):
        done = upto[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(upto, done + PAIRS, side="right")))
        n = later[at:stop]
        a = np.repeat(np.arange(at, stop), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]], n)
        value = _f(p[a], p[b]) - _f(p[a], z[b]) - _f(z[a], p[b]) + _f(z[a], z[b])
        low, high = np.minimum(number[a], number[b]), np.maximum(number[a], number[b])
        yield _summed(low << 32 | high, value)
        at = stop


def _both(stripes: DataFrame) -> DataFrame:
    """``lang, source, item, value``: what a term of both sources adds to their sums beyond either's own part.

    With p for the term's probability in a source and z for that of an absent term, it is
    f(p, p') - f(p, z') - f(z, p') + f(z, z'). Tasks add it up by pair and return both ways round.
    """

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers: dict[tuple[str, str], int] = {}
        keys, values = np.empty(0, np.int64), np.empty(0, np.int64)

        def rows() -> Iterator[pa.RecordBatch]:
            names = list(numbers)
            for at in range(0, len(keys), ROWS):
                some = [(names[k >> 32], names[k & 0xFFFFFFFF], v) for k, v in zip(keys[at : at + ROWS].tolist(), values[at : at + ROWS].tolist())]
                both = [(a[0], a[1], b[1], v) for a, b, v in some] + [(a[0], b[1], a[1], v) for a, b, v in some]
                columns = [pa.array(c, t) for c, t in zip(zip(*both), [pa.string()] * 3 + [pa.int64()])]
                yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "item", "value"])

        for batch in batches:
            entries = batch.column("entries")
            flat, lengths = entries.flatten(), np.diff(entries.offsets.to_numpy())
            langs = batch.column("lang").dictionary_encode()
            sources = flat.field("source").dictionary_encode()
            # Numbers for the (language, source) pairs that occur; a pair of codes is looked up once.
            codes = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths) * max(len(sources.dictionary), 1) + sources.indices.to_numpy()
            found, where = np.unique(codes, return_inverse=True)
            of = [(langs.dictionary[int(c) // len(sources.dictionary)].as_py(), sources.dictionary[int(c) % len(sources.dictionary)].as_py()) for c in found]
            number = np.array([numbers.setdefault(g, len(numbers)) for g in of], np.int64)[where]
            p, z = (flat.field(c).to_numpy() for c in ("p", "z"))
            for k, v in pair_parts(lengths, number, p, z):
                keys, values = _summed(np.r_[keys, k], np.r_[values, v])
                if len(keys) > PAIRS:
                    yield from rows()
                    keys, values = keys[:0], values[:0]
        if len(keys):
            yield from rows()

    return stripes.select("lang", "entries").mapInArrow(met, "lang string, source string, item string, value long")


def _pairs(scored: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value`` of every pair of sources of a language, in one sum of three parts."""
    stripe = F.collect_list(F.struct("source", "p", "z")).alias("entries")
    shared = scored.groupBy("lang", "term").agg(stripe).where(F.size("entries") > 1)
    histogram = scored.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("n"))
    # As many entries as there are different counts of terms in the source.
    listed = histogram.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "n")).alias("counts"))
    sided = stored(groups.join(listed, ["lang", "source"], "left"), "sides")
    items = groups.select("lang", F.col("source").alias("item"), F.col("z").alias("z_item"))
    met = lookup(sided, items, ["lang"], "inner").where(F.col("source") != F.col("item"))
    neither = _divergence(F.col("z"), F.col("z_item"))
    own = F.aggregate(
        F.coalesce("counts", F.array().cast("array<struct<p:bigint,n:bigint>>")),
        F.lit(0).cast("long"),
        lambda total, c: total + c["n"] * (_divergence(c["p"], F.col("z_item")) - neither),
    )
    one = met.select("lang", "source", "item", F.coalesce(F.col("terms") * neither, F.lit(0)).alias("base"), F.coalesce(own, F.lit(0)).alias("own"))
    ways = F.array(
        F.struct("source", "item", (F.col("base") + F.col("own")).alias("value")),
        F.struct(F.col("item").alias("source"), F.col("source").alias("item"), F.col("own").alias("value")),
    )
    return one.select("lang", F.inline(ways)).unionByName(_both(shared)).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def audited(docs: DataFrame, settings: AuditSettings = AuditSettings()) -> DataFrame:
    """``lang, source, part, item, value, rank`` for every (lang, source) group of the documents.

    Part ``pair``: every other source of the language, by divergence. Part ``term``: the ``top`` terms that
    the group uses more than its language. Null text, lang and source are empty ones; an empty text, or one
    without terms, still makes its group. Rows that repeat an id are documents of their own. An empty table
    gives an empty result; other columns are not read. Runs jobs when called.
    """
    stripes = stored(merged_stripes(task_stripes(docs), settings), "stripes")
    everywhere = F.aggregate("counts", F.lit(0).cast("long"), lambda total, n: total + n)
    entries = stripes.select(
        "lang", "term", everywhere.alias("lang_count"), F.inline(F.arrays_zip(F.col("sources").alias("source"), F.col("counts").alias("count")))
    )
    totals = entries.groupBy("lang", "source").agg(F.sum("count").alias("total"))
    langs = stripes.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum(everywhere).alias("lang_total"))
    groups = docs.select(*_sources(docs)).distinct().join(totals, ["lang", "source"], "left").join(langs, "lang", "left")
    counted = groups.na.fill(0, ["total", "terms", "lang_total"])
    z = _probability(F.lit(0).cast("long"), F.col("total"), F.col("terms"), settings)
    groups = stored(counted.withColumn("z", z), "groups")

    of = lookup(entries, groups, ["lang", "source"], "inner")
    p = _probability(F.col("count"), F.col("total"), F.col("terms"), settings)
    q = _probability(F.col("lang_count"), F.col("lang_total"), F.col("terms"), settings)
    scored = stored(of.select("lang", "source", "term", "z", p.alias("p"), q.alias("q")), "scored")
    over = scored.where(F.col("p") > F.col("q")).select("lang", "source", F.col("term").alias("item"), _divergence(F.col("p"), F.col("q")).alias("value"))
    pairs = _pairs(scored.select("lang", "source", "term", "p", "z"), groups.select("lang", "source", "terms", "z"))
    place = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item")))

    def ranked(part: str, rows: DataFrame) -> DataFrame:
        return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", place.cast("int").alias("rank"))

    first = over.withColumn("rank", place).where(F.col("rank") <= settings.top)
    return ranked("pair", pairs).unionByName(first.select("lang", "source", F.lit("term").alias("part"), "item", "value", F.col("rank").cast("int").alias("rank")))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"))


def oracle(settings: AuditSettings = AuditSettings()) -> str:
    def p(n: str, total: str) -> str:
        return f"1 + ({settings.unit}::HUGEINT * ({n} + {settings.smoothing})) // ({total} + {settings.smoothing} * v)"

    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(coalesce(text, ''), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS found FROM documents),
t AS (SELECT k, lang, source, translate(unnest(found), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT k) >= {settings.least_docs}),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (
  SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v FROM (SELECT DISTINCT lang, source FROM d)
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source) USING (lang, source)
  LEFT JOIN (SELECT lang, count(*) AS v FROM kept GROUP BY lang) USING (lang)),
p AS (SELECT lang, source, term, coalesce(n, 0) AS n, {p('coalesce(n, 0)', 'total')} AS p
      FROM g JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, {p('n', 'total')} AS q
      FROM (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term)
      JOIN (SELECT lang, sum(total) AS total, max(v) AS v FROM g GROUP BY lang) USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
         FROM p a JOIN p b USING (lang, term) WHERE a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM parts)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM r WHERE part = 'pair' OR rank <= {settings.top}
"""
