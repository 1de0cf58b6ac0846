"""Quality classifier: random Fourier features, ridge regression by summed normal equations, isotonic calibration.

Statistics of each text are taken once and stored; labels, which are few, meet those narrow rows. Every
task sums its rows' part of the normal equations; sums are added in a fixed number of slots, so what
reaches the driver is a few matrices whatever the corpus. Scores of a part of the labelled rows that the
regression has not seen are calibrated over a histogram of fixed resolution.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bagwise.llm.common import lookup, table, text_batches, text_of, without
from bagwise.llm.quality_rules import STOP_WORDS
from bagwise.plans.scratch import stored

FOLDS = 5
SLOTS = 16
#: Rows of text turned into Python strings at a time.
ROWS = 256
#: Resolution and range of the histogram of raw scores.
BINS, LOW, HIGH = 2000, -1.0, 2.0

_STOPS = frozenset(w.encode() for w in STOP_WORDS)
STATISTICS = (
    "bytes words lines word_bytes word_spread short_words long_words stop_words distinct_words distinct_pairs "
    "top_word distinct_lines line_words capitals digits symbols marks stops commas high_bytes entropy"
).split()


@dataclass(frozen=True)
class ClassifierSettings:
    features: int = 256
    ridge: float = 1e-3
    #: Width of the kernel: exp(-gamma |x - y|^2) on standardised statistics.
    gamma: float = 1.0 / len(STATISTICS)
    seed: int = 17
    threshold: float = 0.3


def statistics(text: str) -> np.ndarray:
    """Numbers that describe a text, none of which say what it is about; an empty text has zeros."""
    data = text.encode("utf-8", "surrogatepass")
    out = np.zeros(len(STATISTICS))
    words = data.split()
    if not words:
        return out
    bytes_ = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size, n = len(data), len(words)
    lengths = np.fromiter(map(len, words), np.int64, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    p = bytes_[bytes_ > 0] / size
    letters = max(1, int(bytes_[65:91].sum() + bytes_[97:123].sum()))
    seen = Counter(words)
    out[:] = (
        np.log1p(size),
        np.log1p(n),
        np.log1p(len(lines)),
        lengths.mean(),
        lengths.std(),
        (lengths <= 3).mean(),
        (lengths >= 12).mean(),
        sum(map(_STOPS.__contains__, data.lower().split())) / n,
        len(seen) / n,
        len(set(zip(words, words[1:]))) / max(1, n - 1),
        max(seen.values()) / n,
        len(set(lines)) / len(lines),
        np.log1p(n / len(lines)),
        bytes_[65:91].sum() / letters,
        bytes_[48:58].sum() / size,
        bytes_[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / n,
        bytes_[[33, 63]].sum() / n,
        bytes_[46] / n,
        bytes_[44] / n,
        bytes_[128:].sum() / size,
        -(p * np.log2(p)).sum(),
    )
    return out


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            rows = [statistics(t) for t in part.column("_text").to_pylist()]
            flat = pa.array(np.concatenate(rows), pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(STATISTICS))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, flat)], ["doc_id", "x"])


def describe(docs: DataFrame) -> DataFrame:
    """``doc_id, fold, x``: the statistics of each whole text and the fold its id falls into."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", text_of().alias("_text")).mapInArrow(_described, f"doc_id {kind}, x array<double>")
    return rows.select("doc_id", fold_of(F.col("doc_id")).alias("fold"), "x")


def fold_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo the folds; a null id counts as an empty one."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


class Kernel:
    """Standardise, clip and map to cosines whose inner products approximate a Gaussian kernel."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, settings: ClassifierSettings):
        rng = np.random.default_rng(settings.seed)
        self.mean, self.spread = mean, np.where(spread > 1e-9, spread, 1.0)
        self.w = rng.normal(size=(len(mean), settings.features)) * np.sqrt(2 * settings.gamma)
        self.b = rng.uniform(0, 2 * np.pi, settings.features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.spread, -6, 6) @ self.w + self.b
        return np.hstack([np.cos(z) * np.sqrt(2 / len(self.b)), np.ones((len(x), 1))])


def _sums(total: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    """A task's sums as one row, or none if it had no rows."""
    if total is not None:
        slot = pa.array([TaskContext.get().partitionId() % SLOTS], pa.int32())
        yield pa.RecordBatch.from_arrays([slot, pa.array([total.tobytes()], pa.binary())], ["slot", "sums"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        for blob in batch.column("sums").to_pylist():
            part = np.frombuffer(blob)
            total = part.copy() if total is None else total + part
    yield from _sums(total)


def _normal_equations(kernel: Kernel, rows: DataFrame) -> np.ndarray:
    """Sum over the rows of z zᵀ, z y, as one matrix with a last column for y."""

    def summed(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                z = kernel(_matrix(batch))
                zy = np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
                total = z.T @ zy if total is None else total + z.T @ zy
        yield from _sums(total)

    kind = "slot int, sums binary"
    parts = rows.select("x", "y").mapInArrow(summed, kind).repartition(SLOTS, "slot")
    sums = parts.mapInArrow(_added, kind).collect()
    size = len(kernel.b) + 1
    total = np.zeros((size, size + 1))
    for row in sums:
        total += np.frombuffer(row["sums"]).reshape(total.shape)
    return total


def isotonic(x: np.ndarray, good: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool neighbours until shares of good rows rise with x; centres and shares of the pools."""
    pools: list[list[float]] = []
    for a, g, m in zip(x, good, n):
        pools.append([a * m, g, m])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            top = pools.pop()
            pools[-1] = [u + v for u, v in zip(pools[-1], top)]
    p = np.array(pools)
    return p[:, 0] / p[:, 2], p[:, 1] / p[:, 2]


class Classifier:
    """A fitted model: raw ridge score, then the calibration curve."""

    def __init__(self, kernel: Kernel | None, beta: np.ndarray | None):
        self.kernel, self.beta = kernel, beta
        self.knots = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))

    def raw(self, x: np.ndarray) -> np.ndarray:
        if self.kernel is None:
            return np.full(len(x), 0.5)
        return np.clip(self.kernel(x) @ self.beta, LOW, HIGH)

    def score(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # A thousandth of the raw score keeps rows of one pool in their order.
        return 0.999 * np.interp(raw, *self.knots) + 0.001 * (raw - LOW) / (HIGH - LOW)


def labelled_rows(described: DataFrame, labels: DataFrame) -> DataFrame:
    """The described documents outside fold 0 that have a label, as ``fold, x, y``.

    Null labels are no labels; several of one document are averaged and rounded. Only ``doc_id`` and
    ``quality`` are read.
    """
    known = labels.where("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id")
    y = stored(known.agg((F.avg("quality") >= 0.5).cast("double").alias("y")), "labels")
    return lookup(described.where("fold <> 0"), y, ["doc_id"], "inner").select("fold", "x", "y")


def fit(described: DataFrame, labels: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> Classifier:
    """Fit on three folds of the labelled rows and calibrate on the fourth.

    Without labels every raw score is a half. With none in the calibrating fold, all labelled rows
    calibrate.
    """
    rows = stored(labelled_rows(described, labels), "labelled")
    last = F.col("fold") == FOLDS - 1
    fitted, calibrating = rows.where(~last), rows.where(last)
    if fitted.isEmpty():
        fitted = rows
    if calibrating.isEmpty():
        calibrating = rows
    k = range(len(STATISTICS))
    moments = fitted.agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(F.col("x")[i]) for i in k], *[F.stddev_pop(F.col("x")[i]) for i in k]
    ).first()
    if moments[0] == 0:
        return Classifier(None, None)
    values = np.array(moments[1:], dtype=float)
    kernel = Kernel(values[: len(STATISTICS)], values[len(STATISTICS) :], settings)
    sums = _normal_equations(kernel, fitted)
    size = len(sums)
    penalty = settings.ridge * moments[0] * np.eye(size)
    penalty[-1, -1] = 0
    model = Classifier(kernel, np.linalg.solve(sums[:, :size] + penalty, sums[:, size]))

    def binned(batches):
        for batch in batches:
            at = (model.raw(_matrix(batch)) - LOW) / (HIGH - LOW) * BINS
            yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), batch.column("y")], ["bin", "y"])

    counts = calibrating.select("x", "y").mapInArrow(binned, "bin int, y double").groupBy("bin")
    bins = counts.agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("good")).orderBy("bin").toPandas()
    centre = LOW + (bins["bin"].to_numpy() + 0.5) * (HIGH - LOW) / BINS
    model.knots = isotonic(centre, bins["good"].to_numpy(float), bins["n"].to_numpy(float))
    return model


def classify(docs: DataFrame, labels: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """One row per document: ``doc_id, held_out, score, predicted``.

    Null text is the empty text, which is scored like any other. Repeated rows are scored alike. An
    empty table gives an empty result. Ids, languages and sources are no part of a score.
    """
    with text_batches(docs.sparkSession):
        described = stored(describe(docs), "described")
    model = fit(described, labels, settings)

    def scored(batches):
        for batch in batches:
            score = pa.array(model.score(_matrix(batch)) if batch.num_rows else np.empty(0))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("fold"), score], ["doc_id", "fold", "score"])

    kind = described.schema["doc_id"].dataType.simpleString()
    scores = described.mapInArrow(scored, f"doc_id {kind}, fold int, score double")
    good = (F.col("score") >= settings.threshold).cast("int")
    return scores.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", good.alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, settings: ClassifierSettings = ClassifierSettings()) -> DataFrame:
    """The documents that the classifier accepts, with all their columns."""
    rejected = classify(docs, labels, settings).where("predicted = 0").select("doc_id")
    return without(docs, stored(rejected, "rejected"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
