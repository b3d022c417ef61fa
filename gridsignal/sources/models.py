"""Storage of fitted models."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.ml.classification import GBTClassificationModel, LogisticRegressionModel, RandomForestClassificationModel
from pyspark.sql import SparkSession

from gridsignal.operators.forest import Forest

KINDS = {
    "forest": RandomForestClassificationModel,
    "boosted": GBTClassificationModel,
    "logistic": LogisticRegressionModel,
}


def save_model(model, path: str) -> None:
    """Write a fitted model, replacing an older one."""
    if isinstance(model, Forest):
        model.save(path)
        return
    model.write().overwrite().save(path)


def load_model(kind: str, path: str):
    """Read a model of the given kind."""
    if kind == "forest":
        try:
            return Forest.load(SparkSession.active(), path)
        except AnalysisException:  # no table of nodes: Spark's own
            pass
    return KINDS[kind].load(path)
