"""Cross-validation over bags: all fold models train and validate in shared scans."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from bagwise.functions.columns import threshold
from bagwise.operators.folds import cv_summary, kfold_assign
from bagwise.operators.metrics import Reports, keyed_reports
from bagwise.operators.model import AttentionModel
from bagwise.operators.prepare import feature_dim
from bagwise.plans.scratch import settle
from bagwise.plans.training import Trained, TrainSettings, bag_states, fold_models, labelled_rows, train_models


@dataclass(frozen=True)
class CrossValidation:
    """``scores`` of held-out bags, reports by fold, the ``summary`` of their AUCs, and the trained fold models."""

    trained: Trained
    scores: DataFrame
    reports: Reports
    summary: DataFrame

    @property
    def fold_aucs(self) -> DataFrame:
        return self.reports.auc


def cross_validate(
    instances: DataFrame,
    bags: DataFrame,
    settings: TrainSettings = TrainSettings(),
    *,
    k: int = 10,
    fold_seed: int = 42,
    models: dict[int, AttentionModel] | None = None,
) -> CrossValidation:
    """Train k fresh models, each without one fold, and score each fold by the model that missed it."""
    assigned = settle(kfold_assign(bags.select("bag_id", "label"), k, fold_seed))
    if models is None:
        models = fold_models(feature_dim(instances), range(k), settings)
    trained = train_models(instances, assigned, models, replace(settings, run_id=f"{settings.run_id}-cv"))
    rows = labelled_rows(instances, assigned, settings.budget)
    held_out = bag_states(rows, trained.models, held_out=True).select("fold", "bag_id", "label", "p")
    scores = settle(held_out.withColumn("pred", threshold("p")))
    reports = keyed_reports(scores, ["fold"])
    return CrossValidation(trained, scores, reports, cv_summary(reports.auc))
