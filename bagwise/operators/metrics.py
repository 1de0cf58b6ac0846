"""Ranking and classification metrics over bag scores.

Inputs have one row per bag and epoch (``label``, ``p``, ``pred``), never one per instance. Scores are
first counted per distinct value, so what is ordered is smaller still, and it is ordered by ranges.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bagwise.plans.ordered import SLICE, in_slices, join_by, running_totals
from bagwise.plans.scratch import settle


def _by_score(scores: DataFrame, by: Sequence[str], p: str, label: str) -> DataFrame:
    return scores.groupBy(*by, F.col(p).alias("score")).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) != 1).alias("neg")
    )


def auc(scores: DataFrame, by: Sequence[str] = (), *, p: str = "p", label: str = "label") -> DataFrame:
    """Area under the ROC curve per group; null where a group has one class only. Runs a job when called."""
    order = [F.col("score")]
    sliced = in_slices(_by_score(scores, by, p, label), order)
    below = running_totals(sliced, order, {"neg_upto": F.col("neg")}, by)
    wins = F.sum(F.col("pos") * (F.col("neg_upto") - F.col("neg") / 2))
    return below.groupBy(*by).agg(F.try_divide(wins, F.sum("pos") * F.sum("neg")).alias("auc"))


def _next_counts(sliced: DataFrame, by: Sequence[str], order: Column) -> DataFrame:
    """Add the following score's ``pos`` and ``neg`` (null for the last), across range borders."""
    within = Window.partitionBy(*by, SLICE).orderBy(order)
    pair = F.struct("pos", "neg")
    firsts = sliced.groupBy(*by, SLICE).agg(F.min_by(pair, "_rank").alias("_first"))
    following = Window.partitionBy(*by).orderBy(SLICE)
    heads = firsts.select(*by, SLICE, F.lead("_first").over(following).alias("_head"))
    with_next = sliced.withColumn("_next", F.lead(pair).over(within))
    return join_by(with_next, heads, [*by, SLICE]).withColumn("_next", F.coalesce("_next", "_head")).drop("_head")


def _ranked(scores: DataFrame, by: Sequence[str], p: str, label: str) -> DataFrame:
    """Distinct scores in falling order with what stands behind each: ``pos, neg, tp, fp, nth, _next``."""
    falling = F.col("score").desc()
    sliced = in_slices(_by_score(scores, by, p, label), [falling]).withColumn("_rank", -F.col("score"))
    with_next = _next_counts(sliced, by, falling)
    return running_totals(with_next, [falling], {"tp": F.col("pos"), "fp": F.col("neg"), "nth": F.lit(1)}, by)


def _curve(totals: DataFrame, everyone: DataFrame, by: Sequence[str], drop_collinear: bool) -> DataFrame:
    bend = F.col("_next").isNull() | (F.col("_next") != F.struct("pos", "neg")) | (F.col("nth") == 1)
    kept = totals.where(bend) if drop_collinear else totals
    start = everyone.select(*by, F.lit(float("inf")).alias("score"), F.lit(0).alias("tp"), F.lit(0).alias("fp"))
    points = start.unionByName(kept.select(*by, "score", "tp", "fp"))
    sums = everyone.select(*by, "n_pos", "n_neg")
    joined = join_by(points, sums, by) if by else points.select("*", *_scalars(everyone, "n_pos", "n_neg"))
    return joined.select(
        *by,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("fp"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("tp"), F.col("n_pos")).alias("tpr"),
    )


def _everyone(totals: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per group its class counts and, from the falling order, how often a positive beats a negative."""
    ahead = F.col("pos") * (F.col("neg") / 2 - F.col("fp"))
    return totals.groupBy(*by).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), F.sum(ahead).alias("_ahead"))


def roc_curve(
    scores: DataFrame, by: Sequence[str] = (), *, p: str = "p", label: str = "label", drop_collinear: bool = True
) -> DataFrame:
    """``threshold, fpr, tpr`` per group, from (0, 0) at an infinite threshold to (1, 1).

    A rate of a class that does not occur is null. Inner points on a straight line are dropped. Runs a
    job when called, which orders the scores.
    """
    by = list(by)
    totals = _ranked(scores, by, p, label)
    return _curve(totals, _everyone(totals, by), by, drop_collinear)


@dataclass(frozen=True)
class Reports:
    """``confusion`` (label, pred, n), ``auc`` and ``roc`` (threshold, fpr, tpr), each by the same keys."""

    confusion: DataFrame
    auc: DataFrame
    roc: DataFrame


def keyed_reports(
    scores: DataFrame, by: Sequence[str], *, p: str = "p", label: str = "label", pred: str = "pred", drop_collinear: bool = True
) -> Reports:
    """All reports of every group from one ranking of the scores; a null key is a group too."""
    by = list(by)
    totals = _ranked(scores, by, p, label)
    everyone = settle(_everyone(totals, by))
    wins = F.col("_ahead") + F.col("n_pos") * F.col("n_neg")
    area = F.try_divide(wins, F.col("n_pos") * F.col("n_neg")).alias("auc")
    return Reports(
        confusion_matrix(scores, by, label=label, pred=pred), everyone.select(*by, area), _curve(totals, everyone, by, drop_collinear)
    )


def _scalars(one_row: DataFrame, *names: str) -> list[Column]:
    return [one_row.select(n).scalar().alias(n) for n in names]


def confusion_matrix(
    scores: DataFrame, by: Sequence[str] = (), *, normalize: bool = False, label: str = "label", pred: str = "pred"
) -> DataFrame:
    """``label, pred, n`` for all four cells per group; ``share`` of the label's row instead with ``normalize``."""
    cells = [(y, q) for y in (0, 1) for q in (0, 1)]
    counts = scores.groupBy(*by).agg(
        *[F.count_if((F.col(label) == y) & (F.col(pred) == q)).alias(f"c{y}{q}") for y, q in cells]
    )
    value = "share" if normalize else "n"

    def cell(y: int, q: int) -> Column:
        n = F.col(f"c{y}{q}")
        return F.try_divide(n, F.col(f"c{y}0") + F.col(f"c{y}1")) if normalize else n

    rows = [F.struct(F.lit(y).alias("label"), F.lit(q).alias("pred"), cell(y, q).alias(value)) for y, q in cells]
    return counts.select(*by, F.inline(F.array(*rows)))
