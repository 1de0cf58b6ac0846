"""Evaluation of a trained scorer on labelled bags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from bagwise.operators.bags import require_instances, require_unique
from bagwise.operators.metrics import auc, confusion_matrix, roc_curve
from bagwise.operators.model import AttentionModel
from bagwise.operators.pooling import attention_weights, score_bags
from bagwise.plans.lookup import lookup_join
from bagwise.plans.scratch import settle


@dataclass(frozen=True)
class Evaluation:
    """Bag scores (settled), metrics over them, and lazy attention per instance."""

    scores: DataFrame
    auc: DataFrame
    confusion: DataFrame
    roc: DataFrame
    attention: DataFrame


def label_scores(scores: DataFrame, bags: DataFrame) -> DataFrame:
    """Bag scores with their true labels, matched by bag."""
    return lookup_join(scores, bags.select("bag_id", "label"), ["bag_id"], "inner")


def evaluate(instances: DataFrame, bags: DataFrame, model: AttentionModel, at: float = 0.5) -> Evaluation:
    """Score the bags and compare with their labels; a bag without instances, or listed twice, is an error."""
    bags = settle(bags)
    require_unique(bags)
    scores = settle(label_scores(score_bags(instances, model, at), bags))
    require_instances(bags, scores)
    return Evaluation(
        scores, auc(scores), confusion_matrix(scores), roc_curve(scores), attention_weights(instances, model, scores)
    )
