"""Centroid clustering of integer vectors by a bisector tournament.

Vectors and centroids are integers, so every comparison is exact. Of two centroids a < b, b is nearer to x
exactly if ``x · 2(b - a) > |b|² - |a|²``: the sign of one linear form. The normals and thresholds of all
pairs are computed once per round; each vector holds a champion, first centroid 0, that meets the others
in turn, and each of the k - 1 tests eliminates one. On a zero the smaller number, always the champion's,
stays. Only the winner's distance is computed.

A round is one pass: each task adds up its vectors per cluster, Spark adds up the tasks' sums, and k rows
come back for the exact means. Nothing else reaches the driver; tasks hold one slice of vectors, one sum
per cluster, and the normals, ``k² · components`` numbers.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import table
from bagwise.operators.kernels import grouped
from bagwise.plans.scratch import stored

#: Vectors a task takes at a time.
SLICE = 2048
#: Up to this size of components, doubles hold every linear form of up to 256 components exactly.
EXACT = 1 << 21
LARGEST_LONG = (1 << 63) - 1


@dataclass(frozen=True)
class ClusterSettings:
    """``k`` centroids over vectors of ``components`` numbers, scaled to integers; ``rounds`` of updates."""

    k: int = 40
    components: int = 64
    scale: int = 256
    rounds: int = 5
    seed: int = 2


def _whole(value: float, scale: int) -> int:
    """``floor(scale * value)`` without overflow: doubles beyond 2^53 are integers."""
    return int(value) * scale if abs(value) >= 1 << 53 else math.floor(value * scale)


def integers(matrix: np.ndarray, scale: int) -> np.ndarray:
    """The integers of each component: as doubles where those are exact, else as Python's numbers."""
    with np.errstate(over="ignore"):
        scaled = np.floor(matrix * float(scale))
    if not scaled.size or np.abs(scaled).max() <= EXACT:
        return scaled
    return np.frompyfunc(lambda v: _whole(v, scale), 1, 1)(matrix)


def usable_rows(column: pa.Array, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold a full vector of finite numbers, and those vectors."""
    full = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), components), False).to_numpy(zero_copy_only=False))
    # A null component comes as NaN.
    matrix = column.take(pa.array(full)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(full), components)
    finite = np.isfinite(matrix).all(axis=1)
    return full[finite], matrix[finite]


class Tournament:
    """Nearest centroids by linear tests between pairs; among equals, the smallest number."""

    def __init__(self, centroids: list[list[int]]):
        values = np.array(centroids, dtype=object).reshape(len(centroids), len(centroids[0]) if centroids else 0)
        squares = (values * values).sum(axis=1)
        small = max((abs(v) for row in centroids for v in row), default=0) <= EXACT and values.shape[1] <= 256
        self._kinds = [np.float64] if small else []
        self._tables = {}
        for kind in [*self._kinds, object]:
            c = values.astype(kind)
            # normals[b][a] and thresholds[b][a] say whether b is nearer than a.
            normals = [2 * (c[b] - c[:b]) for b in range(len(c))]
            thresholds = [(squares[b] - squares[:b]).astype(kind) for b in range(len(c))]
            self._tables[kind] = c, normals, thresholds

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest centroid of each row, and the squared distance to it."""
        kind = np.float64 if x.dtype != object and np.float64 in self._kinds else object
        if kind is object and x.dtype != object:
            x = np.frompyfunc(int, 1, 1)(x)
        centroids, normals, thresholds = self._tables[kind]
        champion = np.zeros(len(x), np.int64)
        for rival in range(1, len(centroids)):
            side = (x * normals[rival][champion]).sum(axis=1) if kind is object else np.einsum("ij,ij->i", x, normals[rival][champion])
            champion[side > thresholds[rival][champion]] = rival
        away = x - centroids[champion]
        return champion, (away * away).sum(axis=1) if kind is object else np.einsum("ij,ij->i", away, away)


def _slices(batches: Iterator[pa.RecordBatch], settings: ClusterSettings) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            rows, matrix = usable_rows(part.column("_vector"), settings.components)
            if len(rows):
                yield part, rows, integers(matrix, settings.scale)


def _doubles(vectors: DataFrame, *names: str) -> DataFrame:
    return vectors.select(*names, F.col("embedding").cast("array<double>").alias("_vector"))


def _usable(vector: Column, settings: ClusterSettings) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & (F.size(vector) == settings.components) & finite


def first_centroids(vectors: DataFrame, settings: ClusterSettings) -> list[list[int]]:
    """The ``k`` usable vectors with the smallest hashes of their ids, null ids last; equal ids by content."""
    usable = _doubles(vectors, "vec_id").where(_usable(F.col("_vector"), settings))
    digest = F.sha2(F.concat(F.lit(f"{settings.seed}:"), F.col("vec_id").cast("string")), 256)
    first = usable.orderBy(digest.asc_nulls_last(), "_vector").limit(settings.k).select("_vector").collect()
    return [[_whole(v, settings.scale) for v in r[0]] for r in first]


def cluster_sums(vectors: DataFrame, centroids: list[list[int]], settings: ClusterSettings) -> dict[int, tuple[int, list[int]]]:
    """Of every non-empty cluster the number of its vectors and their sums: ``k`` rows at most."""

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament, counts, sums = Tournament(centroids), {}, {}
        for _, _, x in _slices(batches, settings):
            order, starts, found = grouped(tournament(x)[0])
            totals = np.add.reduceat(x[order], starts, axis=0)
            for c, n, total in zip(found.tolist(), np.diff(np.r_[starts, len(x)]).tolist(), totals):
                counts[c] = counts.get(c, 0) + n
                sums[c] = sums.get(c, 0) + np.frompyfunc(int, 1, 1)(total)
        if counts:
            listed = [[Decimal(v) for v in sums[c]] for c in counts]
            columns = [pa.array(counts.keys(), pa.int32()), pa.array(counts.values(), pa.int64()), pa.array(listed, pa.list_(pa.decimal128(38, 0)))]
            yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "sums"])

    parts = _doubles(vectors).mapInArrow(summed, "cluster int, n long, sums array<decimal(38,0)>")
    totals = [F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(settings.components)]
    rows = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *totals).collect()
    return {r.cluster: (r.n, [int(r[f"s{i}"]) for i in range(settings.components)]) for r in rows}


def fitted_centroids(vectors: DataFrame, settings: ClusterSettings) -> list[list[int]]:
    """Centroids after all rounds. A mean is rounded down, component by component; an empty cluster stays put."""
    centroids = first_centroids(vectors, settings)
    for _ in range(settings.rounds if centroids else 0):
        found = cluster_sums(vectors, centroids, settings)
        centroids = [[s // found[c][0] for s in found[c][1]] if c in found else old for c, old in enumerate(centroids)]
    return centroids


def assigned(vectors: DataFrame, centroids: list[list[int]], settings: ClusterSettings) -> DataFrame:
    """``vec_id, cluster, distance`` of every usable vector; a distance beyond a long is null."""

    def met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tournament = Tournament(centroids)
        for part, rows, x in _slices(batches, settings):
            champion, distance = tournament(x)
            away = [d if d <= LARGEST_LONG else None for d in map(int, distance)]
            ids = part.column("vec_id").take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([ids, pa.array(champion.astype(np.int32)), pa.array(away, pa.int64())], ["vec_id", "cluster", "distance"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    return _doubles(vectors, "vec_id").mapInArrow(met, f"vec_id {kind}, cluster int, distance long")


def clustered(vectors: DataFrame, settings: ClusterSettings = ClusterSettings()) -> DataFrame:
    """One row per usable vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors that are null, of another length, or hold a null or non-finite component are left out. Rows
    that repeat an id, null ids included, are vectors of their own. With fewer usable vectors than ``k``
    there are fewer centroids; without any, or for an empty table, no rows. Components of any size are
    compared exactly; distances and sums that no long holds are null. Other columns are not read. Runs
    jobs when called: one pass for the first centroids, one per round, and one for the result.
    """
    spark = vectors.sparkSession
    centroids = fitted_centroids(vectors, settings)
    rows = stored(assigned(vectors, centroids, settings), "assigned")
    known = F.when(F.count("distance") == F.count(F.lit(1)), F.sum(F.col("distance").cast("decimal(38,0)")))
    # At most k rows, and their sums.
    inertias = {r.cluster: r.inertia for r in rows.groupBy("cluster").agg(known.alias("inertia")).collect()}
    total = sum(inertias.values()) if None not in inertias.values() else None
    digest = lambda c: hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()
    fits = lambda n: int(n) if n is not None and n <= LARGEST_LONG else None
    facts = spark.createDataFrame(
        [(c, fits(n), fits(total), digest(c)) for c, n in inertias.items()],
        "cluster int, cluster_inertia long, inertia long, centroid_sha256 string",
    )
    return rows.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def op12_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"))


def oracle(settings: ClusterSettings = ClusterSettings()) -> str:
    """All rounds written out, with distances to all centroids."""
    k, dim = settings.k, settings.components

    def nearest(n: int) -> str:
        away = "list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
        return f"a{n} AS MATERIALIZED (SELECT v.k, any_value(v.x) AS x, min({away} * {k} + c.c) AS best FROM v CROSS JOIN c{n} c GROUP BY v.k)"

    def moved(n: int) -> str:
        return f"""
s{n} AS (SELECT best % {k} AS c, unnest(x) AS x, generate_subscripts(x, 1) AS pos FROM a{n}),
m{n} AS (SELECT c, list(mean ORDER BY pos) AS x FROM (
  SELECT c, pos, floor(sum(x)::DOUBLE / count(*))::BIGINT AS mean FROM s{n} GROUP BY c, pos) GROUP BY c),
c{n + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{n} c LEFT JOIN m{n} m ON c.c = m.c)"""

    rounds = ",\n".join(f"{nearest(n)},{moved(n)}" for n in range(settings.rounds))
    last = settings.rounds
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS k, vec_id, list_transform(embedding, lambda x: floor({settings.scale} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dim}),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h) - 1 AS c, x
  FROM (SELECT sha256('{settings.seed}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {k})),
{rounds},
{nearest(last)},
d AS (SELECT vec_id, (best % {k})::INTEGER AS cluster, (best // {k})::BIGINT AS distance FROM a{last} JOIN v USING (k))
SELECT vec_id, cluster, distance,
       (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM d JOIN c{last} c ON d.cluster = c.c
"""
