"""Near duplicates by min-max hashing.

A document is the set of its distinct shingles of five words. Every permutation gives two values of a
signature, the smallest and the largest hash of the set; each agrees between two sets with a chance of
their Jaccard similarity, so a signature costs half the hash evaluations. Bands of four permutations
(eight values) put documents into buckets.

Documents with equal sets are one class and go through the search as one. In a bucket, every member is
compared with the bucket's smallest id; after the components of those links are known, members outside
the largest component of a bucket are compared with the members of the others. Buckets of equal members
are one bucket. A pair of a bucket is left out only if both are in one component already, or if sketches
of the sets prove them unlike: parities of hashed shingle counts, which never differ more than the sets
do. So components are those of all linked pairs of the buckets, without listing a group's pairs.
Similarities are of full sets, compared by Spark.

Hardly any band key is met twice. So keys alone are counted first, and only rows of repeated keys go on:
by a broadcast of those keys while it is small, as measured, and else in one exchange by key. Sketches are
written once, no table carries them further, and each table goes after its last reader.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import LOOKUP_BYTES, Tables, lookup, table, text_batches, without
from bagwise.plans.lookup import Salting, even_shares, measured_bytes
from bagwise.plans.scratch import settle, stored

ROWS = 128
#: Words whose hashes a task remembers before it starts afresh.
REMEMBERED = 200_000
MASK = (1 << 64) - 1
#: Counts of shingles by hash, of which a sketch keeps the parities; a power of two.
PARITIES = 1024


@dataclass(frozen=True)
class NearSettings:
    """Five-word shingles, 75 % similarity; 96 bands of 4 permutations, two values each.

    At a similarity of exactly 0.75 a pair meets in no band with a chance of ``(1 - 0.75 ** 8) ** 96``,
    4 in 100,000, at 0.8 of 2 in 100 million; documents that share a third of their text meet in a band
    with a chance of 1 in 100. ``most_bits``, off by default, also leaves out second-round pairs that
    differ in more of their 768 signature bits; of a linked pair's an eighth differs, and more than 150
    do with a chance below one in ten million.
    """

    shingle: int = 5
    percent: int = 75
    bands: int = 96
    per_band: int = 4
    seed: int = 5
    most_bits: int | None = None


class Shingler:
    """Hashes of the distinct shingles of a text, ascending. Words are hashed once while remembered."""

    def __init__(self, width: int):
        self.width, self.words = width, {}
        odd = np.random.default_rng(width).integers(0, 1 << 63, width, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.factors = odd

    def _hashes(self, words: list[bytes]) -> np.ndarray:
        known = self.words
        if len(known) > REMEMBERED:
            known.clear()
        out = list(map(known.get, words))
        for i, h in enumerate(out):
            if h is None:
                out[i] = known[words[i]] = xxhash.xxh3_64_intdigest(words[i])
        return np.array(out, dtype=np.uint64)

    def __call__(self, text: str | None) -> np.ndarray:
        # bytes.lower changes A-Z alone, and bytes.split cuts at exactly the white space of the contract.
        words = (text or "").encode("utf-8", "surrogatepass").lower().split()
        if not words:
            return np.empty(0, np.uint64)
        h = self._hashes(words)
        k = min(self.width, len(words))
        n = len(words) - k + 1
        mixed = np.full(n, np.uint64(k), np.uint64)
        with np.errstate(over="ignore"):
            for j in range(k):
                mixed += h[j : j + n] * self.factors[j]
        return np.unique(_scrambled(mixed))


def _scrambled(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class MinMax:
    """Band keys of a set: per permutation the smallest and the largest image, mixed per band."""

    def __init__(self, settings: NearSettings):
        rng = np.random.default_rng(settings.seed)
        n = settings.bands * settings.per_band
        self.a = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, MASK, n, dtype=np.uint64, endpoint=True)
        self.bands, self.per_band = settings.bands, settings.per_band

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        low = np.full(len(self.a), MASK, np.uint64)
        high = np.zeros(len(self.a), np.uint64)
        with np.errstate(over="ignore"):
            for at in range(0, len(hashes), 512):
                part = hashes[at : at + 512]
                image = np.multiply.outer(self.a, part)
                image += self.b[:, None]
                np.minimum(low, image.min(axis=1), out=low)
                np.maximum(high, image.max(axis=1), out=high)
        return np.stack([low, high], axis=1)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A key per band, and the sketch: the lowest bit of every value, then the parities."""
        values = self.signature(hashes).reshape(self.bands, self.per_band * 2)
        low_bits = _words((values & np.uint64(1)).astype(np.uint8).ravel())
        parity = np.bincount((hashes & np.uint64(PARITIES - 1)).astype(np.int64), minlength=PARITIES) & 1
        key = np.arange(1, self.bands + 1, dtype=np.uint64)
        for j in range(values.shape[1]):
            key = _scrambled(key ^ values[:, j])
        return key.view(np.int64), np.concatenate([low_bits, _words(parity.astype(np.uint8))])


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits in as many 64-bit words as they fill."""
    out = np.zeros(-(-len(bits) // 64) * 8, np.uint8)
    out[: -(-len(bits) // 8)] = np.packbits(bits)
    return out.view(np.int64)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int64()))


def sketch(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """``doc_id, n_shingles, same, bands, bits``; ``same`` is a 128-bit digest of the set, null for an empty one."""
    none = np.empty(0, np.int64)

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler, minmax = Shingler(settings.shingle), MinMax(settings)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingler(t) for t in part.column("text").to_pylist()]
                same = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
                keys, bits = zip(*[minmax(s) if len(s) else (none, none) for s in sets])
                sizes = pa.array([len(s) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), sizes, pa.array(same, pa.binary()), _lists(keys), _lists(bits)],
                    ["doc_id", "n_shingles", "same", "bands", "bits"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        sketched, f"doc_id {kind}, n_shingles long, same binary, bands array<long>, bits array<long>"
    )


def shingle_sets(docs: DataFrame, settings: NearSettings) -> DataFrame:
    """``doc_id, shingles``: the full set of each document."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(settings.shingle)
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                sets = [shingler(t).view(np.int64) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(sets)], ["doc_id", "shingles"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(made, f"doc_id {kind}, shingles array<long>")


def linked(docs: DataFrame, pairs: DataFrame, settings: NearSettings, tables: Tables, name: str) -> DataFrame:
    """Those of the pairs ``a, b`` whose full sets are similar enough, kept as a table.

    Only texts in a pair are read into sets. The set of ``a`` goes to where ``b``'s set is, in salted
    copies if many pairs share it.
    """
    ids = tables.keep("paired", pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    with text_batches(docs.sparkSession):
        sets = tables.keep("sets", shingle_sets(lookup(docs.select("doc_id", "text"), ids, ["doc_id"], "inner"), settings))
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("_sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("_sb"))
    both = lookup(lookup(pairs, left, ["a"], "inner"), right, ["b"], "inner")
    common = F.size(F.array_intersect("_sa", "_sb"))
    total = F.size("_sa") + F.size("_sb") - common
    links = tables.keep(name, both.where(100 * common >= settings.percent * total).select("a", "b"))
    tables.drop("paired", "sets")
    return links


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every linked node: the smallest id its component holds.

    Every round hooks each root onto its smallest neighbour, follows hooks to their ends by doubling,
    and replaces the links' ends by their roots. Links inside a component vanish, so rounds shrink.
    """
    tables, roots, turn = Tables(links.sparkSession), None, 0
    edges = tables.keep("edges", _oriented(links))
    while not edges.isEmpty():
        lowest = edges.groupBy("hi").agg(F.min("lo").alias("lo")).select(F.col("hi").alias("node"), F.col("lo").alias("root"))
        hook, held = tables.keep("hooks", lowest), "hooks"
        while True:
            onward = hook.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            jumped = lookup(hook, onward, ["root"])
            if jumped.where(F.col("_next").isNotNull()).isEmpty():
                break
            turn += 1
            hook = tables.keep(f"hooks{turn}", jumped.select("node", F.coalesce("_next", "root").alias("root")))
            tables.drop(held)
            held = f"hooks{turn}"
        turn += 1
        if roots is None:
            roots = tables.keep(f"roots{turn}", hook)
        else:
            further = hook.select(F.col("node").alias("root"), F.col("root").alias("_next"))
            moved = lookup(roots, further, ["root"]).select("node", F.coalesce("_next", "root").alias("root"))
            roots = tables.keep(f"roots{turn}", moved.unionByName(hook))
            tables.drop(own)
        own = f"roots{turn}"
        rest = tables.keep(f"edges{turn}", _oriented(_relabelled(edges, hook)))
        tables.drop(held, "edges" if "edges" in tables.paths else before)
        edges, before = rest, f"edges{turn}"
    if roots is None:
        kind = links.schema["a"].dataType.simpleString()
        return links.sparkSession.createDataFrame([], f"node {kind}, root {kind}")
    return roots


def _oriented(links: DataFrame) -> DataFrame:
    a, b = links.columns
    ends = links.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))
    return ends.distinct()


def _relabelled(edges: DataFrame, hook: DataFrame) -> DataFrame:
    for end in ("lo", "hi"):
        keyed = hook.select(F.col("node").alias(end), F.col("root").alias("_root"))
        edges = lookup(edges, keyed, [end]).withColumn(end, F.coalesce("_root", end)).select("lo", "hi")
    return edges


def _bucket_join(members: DataFrame, keyed: DataFrame, sizes: DataFrame) -> DataFrame:
    """Join bucket members to rows per bucket; members of large buckets are spread over salts."""
    share = even_shares(members)
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    slot = max(1, total // share)
    hot = settle(sizes.where(F.col("n") > slot).select("key", F.ceil(F.col("n") / slot).cast("int").alias("_salts")))
    salting = Salting(["key"], hot, share)
    joined = salting.rows(members).join(salting.copies(keyed), ["key", "_salt"])
    return joined.drop("_salt")


def _members(sketches: DataFrame, copies: DataFrame, tables: Tables) -> DataFrame:
    """``key, doc_id, n_shingles`` of the bands that two classes or more share, a class being its smallest id."""
    own = lookup(sketches.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull()), copies, ["same"])
    first = own.where(F.col("first").isNull() | (F.col("doc_id") == F.col("first")))
    banded = first.select(F.explode("bands").alias("key"), "doc_id", "n_shingles")
    repeated = tables.keep("repeated", banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    if measured_bytes(repeated.select("key")) <= LOOKUP_BYTES:
        met = banded.join(F.broadcast(repeated.select("key")), "key")
    else:
        met = _bucket_join(banded, repeated.select("key"), repeated)
    # Rows that repeat an id and a set are one member.
    members = tables.keep("banded", met.select("key", "doc_id", "n_shingles").distinct())
    tables.drop("repeated")
    return members


def _bridges(told: DataFrame, copies: DataFrame) -> DataFrame:
    """``a, b``: an id that several sets bear, and the names of those sets' classes."""
    known = told.where(F.col("same").isNotNull() & F.col("doc_id").isNotNull())
    mixed = known.groupBy("doc_id").agg(F.min("same").alias("_low"), F.max("same").alias("_high")).where("_low <> _high")
    sets = lookup(known.select("doc_id", "same"), mixed.select("doc_id"), ["doc_id"], "inner")
    return lookup(sets, copies, ["same"], "inner").select(F.col("doc_id").alias("a"), F.col("first").alias("b")).distinct()


def near_groups(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id, kept``.

    Fewer than five words are one shingle; without words a document is in a component of its own. Rows
    that repeat an id are one document, linked with what any of its texts is linked with. A null id is
    never smallest and is found by equal sets only: alone, its component is null. An empty table gives
    an empty result; other columns are not read. Runs jobs when called.
    """
    tables = Tables(docs.sparkSession)
    with text_batches(docs.sparkSession):
        sketches = tables.keep("sketches", sketch(docs, settings))
    told = tables.keep("told", sketches.select("doc_id", "n_shingles", "same"))
    # Equal sets are one class, named by its smallest id.
    per_set = told.where(F.col("same").isNotNull()).groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    copies = tables.keep("copies", per_set.where("copies > 1").select("same", "first"))
    banded = _members(sketches, copies, tables)
    mark = F.bit_xor(F.xxhash64("doc_id")).alias("_mark")
    sizes = banded.groupBy("key").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "n_shingles")).alias("first"), mark
    )
    # Close copies meet in many bands: of buckets with equal members, one is as good as all. Only the
    # bands of one first document are told apart by the 64-bit mark, so a clash is out of reach.
    alike = sizes.where("n > 1").groupBy("n", "first", "_mark").agg(F.min("key").alias("key"))
    buckets = tables.keep("buckets", alike.select("key", "n", "first"))
    heads = buckets.select("key", F.col("first.doc_id").alias("a"), F.col("first.n_shingles").alias("_na"))
    members = tables.keep("members", _bucket_join(banded, heads, buckets).select("key", "doc_id", "n_shingles", "a", "_na"))
    tables.drop("banded", "buckets")

    near = 100 * F.least("_na", "n_shingles") >= settings.percent * F.greatest("_na", "n_shingles")
    pairs = members.where((F.col("a") != F.col("doc_id")) & near).select("a", F.col("doc_id").alias("b")).distinct()
    tried = tables.keep("pairs", pairs)
    links = linked(docs, tried, settings, tables, "links").unionByName(tables.keep("bridges", _bridges(told, copies)))
    roots = components(links)
    # All other pairs of a bucket that could still join two components: none is left after these.
    further = _untried(members, sketches, roots, tried, settings, tables)
    tables.drop("members", "pairs", "sketches")
    found = linked(docs, further, settings, tables, "found")
    if not found.isEmpty():
        roots = components(links.unionByName(found))
    tables.drop("links", "bridges", "untried", "found")

    of = roots.select(F.col("node").alias("first"), "root")
    # A class of one document that nothing links to needs no row here.
    alone = told.where(F.col("doc_id").isNotNull()).select("same", F.col("doc_id").alias("first"))
    single = lookup(alone, of, ["first"], "inner").select("same", F.col("root").alias("_root"))
    several = lookup(copies, of, ["first"]).select("same", F.coalesce("root", "first").alias("_root"))
    by_set = stored(single.unionByName(several).groupBy("same").agg(F.min("_root").alias("_root")), "sets")
    tables.drop("copies")
    out = lookup(told, by_set, ["same"])
    component = F.coalesce("_root", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def _untried(
    members: DataFrame, sketches: DataFrame, roots: DataFrame, tried: DataFrame, settings: NearSettings, tables: Tables
) -> DataFrame:
    """Pairs of bucket members in different components that have not been compared.

    One of the two is outside the bucket's largest component. Pairs whose sizes or sketches rule a link
    out are dropped by the join itself.
    """
    of = roots.select(F.col("node").alias("doc_id"), "root")
    placed = lookup(members.select("key", "doc_id", "n_shingles"), of, ["doc_id"])
    placed = placed.withColumn("root", F.coalesce("root", "doc_id"))
    counts = placed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("m"))
    largest = counts.groupBy("key").agg(F.max(F.struct("m", "root")).alias("top"), F.count(F.lit(1)).alias("c"), F.sum("m").alias("n"))
    mixed = tables.keep("mixed", largest.where("c > 1").select("key", F.col("top.root").alias("_top"), "n"))
    within = tables.keep("within", _bucket_join(placed, mixed.select("key", "_top"), mixed))
    ids = tables.keep("ids", within.select("doc_id").distinct())
    bits = lookup(sketches.select("doc_id", "n_shingles", "bits"), ids, ["doc_id"], "inner")
    bits = tables.keep("bits", bits.distinct())
    inside = tables.keep("inside", lookup(within, bits, ["doc_id", "n_shingles"], "inner"))
    outside = inside.where(F.col("root") != F.col("_top")).select(
        "key", F.col("doc_id").alias("_o"), F.col("n_shingles").alias("_na"), F.col("root").alias("_ro"), F.col("bits").alias("_bo")
    )
    near = 100 * F.least("_na", "n_shingles") >= settings.percent * F.greatest("_na", "n_shingles")
    first = -(-2 * settings.bands * settings.per_band // 64)

    def apart(words: range) -> Column:
        return sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("_bo")[i])) for i in words), F.lit(0))

    # Sets of n and m shingles are linked if they differ in (n + m) * (100 - p) / (100 + p) or fewer.
    p = settings.percent
    unlike = (100 + p) * apart(range(first, first + PARITIES // 64)) > (100 - p) * (F.col("n_shingles") + F.col("_na"))
    new = (F.col("root") != F.col("_ro")) & near & ~unlike
    if settings.most_bits is not None:
        new = new & (apart(range(first)) <= settings.most_bits)
    met = _bucket_join(inside, outside, mixed).where(new)
    pairs = met.select(F.least("doc_id", "_o").alias("a"), F.greatest("doc_id", "_o").alias("b")).distinct()
    out = tables.keep("untried", pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"))
    tables.drop("mixed", "within", "ids", "bits", "inside")
    return out


def keep_distinct(docs: DataFrame, settings: NearSettings = NearSettings()) -> DataFrame:
    """One document of each component, that with the smallest id, with all its columns."""
    return without(docs, stored(near_groups(docs, settings).where("NOT kept").select("doc_id"), "dropped"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir, "documents"))
