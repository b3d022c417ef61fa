"""Classification metrics, exact and grouped.

Ranking metrics fold rows to one entry per distinct score first (map-side combined, so a score shared by very many
rows is one row afterwards) and then use two-level running totals over ranges of the score. ``by`` holds fold,
threshold or replicate keys; every metric is computed for all groups in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridsignal.operators.groups import attach
from gridsignal.operators.ordering import over_blocks, range_chunks, running_totals
from gridsignal.session import settle


def _score_table(df: DataFrame, score: str, label: str, by: Sequence[str], weight: str | None = None) -> tuple[DataFrame, str]:
    """Positives and negatives per distinct score, written once in ranges of the score: what follows reads this table."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    one = F.lit(1).cast("long") if weight is None else F.col(weight)
    y = F.col(label).cast("long")
    folded = rows.groupBy(*by, score).agg(F.sum(y * one).alias("_pos"), F.sum((1 - y) * one).alias("_neg"))
    return range_chunks(folded, [score]), "_chunk"


def ranking_metrics(
    df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (), weight: str | None = None
) -> DataFrame:
    """``(by, positives, negatives, auc, ap)``: ties count one half, AP is the step sum; NULL with a single class.

    ``weight`` names a column that says how many rows a row stands for.
    """
    by = list(by)
    folded, chunk = _score_table(df, score, label, by, weight)
    ranked = running_totals(
        folded, by, chunk, [score], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, descending=True
    )
    p, n = F.sum("_pos"), F.sum("_neg")
    lost = F.sum(F.col("_pos") * (F.col("_fp") - F.col("_neg") / 2.0))
    steps = F.sum(F.col("_pos") * F.col("_tp") / (F.col("_tp") + F.col("_fp")))
    return ranked.groupBy(*by).agg(
        p.alias("positives"),
        n.alias("negatives"),
        F.when((p > 0) & (n > 0), 1.0 - lost / (p.cast("double") * n)).alias("auc"),
        F.when(p > 0, steps / p).alias("ap"),
    )


def roc_auc(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve."""
    return ranking_metrics(df, score, label, by).select(*by, "auc")


def average_precision(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Average precision by the step rule."""
    return ranking_metrics(df, score, label, by).select(*by, "ap")


def roc_curve(
    df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = (), drop_intermediate: bool = False
) -> DataFrame:
    """ROC points ``(by, threshold, fpr, tpr)`` at each distinct score, and (0, 0) with no threshold.

    ``drop_intermediate`` leaves out points on a straight line between their neighbours.
    """
    by = list(by)
    folded, chunk = _score_table(df, score, label, by)
    totals = {"_tp": F.col("_pos"), "_fp": F.col("_neg")}
    if drop_intermediate:
        totals["_at"] = F.lit(1).cast("long")
    points = running_totals(folded, by, chunk, [score], totals, descending=True)
    points = attach(points, by, {"_P": F.sum("_pos"), "_N": F.sum("_neg")}, source=folded)
    if drop_intermediate:

        def corners(block, w):
            same = (F.lead("_pos", 1).over(w) == F.col("_pos")) & (F.lead("_neg", 1).over(w) == F.col("_neg"))
            return block.withColumn("_inner", F.coalesce(same, F.lit(False)) & (F.col("_at") > 1))

        points = over_blocks(points, by, "_at", 0, 1, corners).where(~F.col("_inner"))
    curve = points.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        (F.col("_fp") / F.col("_N")).alias("fpr"),
        (F.col("_tp") / F.col("_P")).alias("tpr"),
    )
    origin = folded.groupBy(*by).agg(F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")).withColumn(
        "threshold", F.lit(None).cast("double")
    )
    return curve.unionByName(origin)


def pr_curve(df: DataFrame, score: str = "p", label: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """Precision and recall at each distinct score, and the final point (1, 0) with no threshold."""
    by = list(by)
    folded, chunk = _score_table(df, score, label, by)
    points = running_totals(
        folded, by, chunk, [score], {"_tp": F.col("_pos"), "_fp": F.col("_neg")}, descending=True
    )
    points = attach(points, by, {"_P": F.sum("_pos")}, source=folded)
    curve = points.select(
        *by,
        F.col(score).cast("double").alias("threshold"),
        (F.col("_tp") / (F.col("_tp") + F.col("_fp"))).alias("precision"),
        (F.col("_tp") / F.col("_P")).alias("recall"),
    )
    end = folded.groupBy(*by).agg(F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")).withColumn(
        "threshold", F.lit(None).cast("double")
    )
    return curve.unionByName(end)


def confusion(
    df: DataFrame, label: str = "y", pred: str = "pred", classes: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """Counts for every pair of true and predicted class, absent pairs as 0; one pass with conditional counts."""
    pairs = [(a, b) for a in classes for b in classes]
    counted = df.groupBy(*by).agg(
        *[F.count_if((F.col(label) == a) & (F.col(pred) == b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)]
    )
    rows = F.array(
        *[F.struct(F.lit(a).alias("y"), F.lit(b).alias("pred"), F.col(f"_{i}").alias("n")) for i, (a, b) in enumerate(pairs)]
    )
    return counted.select(*by, F.explode(rows).alias("_row")).select(*by, "_row.*")


def confusion_matrix(
    df: DataFrame, label: str = "y", pred: str = "pred", classes: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """Confusion counts with one row per true class and one column per predicted class."""
    long = confusion(df, label, pred, classes, by)
    return long.groupBy(*by, "y").agg(*[F.sum(F.when(F.col("pred") == c, F.col("n"))).alias(f"pred_{c}") for c in classes])


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def per_class(confused: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class from confusion rows; 0 where undefined."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(0)
    true_side = confused.select(*by, F.col("y").alias("class"), hit.alias("_tp"), F.col("n").alias("_support"), F.lit(0).cast("long").alias("_called"))
    pred_side = confused.select(*by, F.col("pred").alias("class"), F.lit(0).cast("long").alias("_tp"), F.lit(0).cast("long").alias("_support"), F.col("n").alias("_called"))
    sums = true_side.unionByName(pred_side).groupBy(*by, "class").agg(
        F.sum("_tp").alias("tp"), F.sum("_support").alias("support"), F.sum("_called").alias("called")
    )
    scored = sums.withColumns(
        {"precision": _ratio(F.col("tp"), F.col("called")), "recall": _ratio(F.col("tp"), F.col("support"))}
    )
    both = F.col("precision") + F.col("recall")
    return scored.withColumn("f1", _ratio(2.0 * F.col("precision") * F.col("recall"), both))


def _summary(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    names = ["precision", "recall", "f1"]
    return rows.groupBy(*by).agg(
        F.sum("support").alias("support"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        *[F.avg(m).alias(f"macro_{m}") for m in names],
        *[(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in names],
    )


def classification_report(
    df: DataFrame, label: str = "y", pred: str = "pred", classes: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """Report rows: each class, accuracy, macro and weighted means."""
    rows = per_class(confusion(df, label, pred, classes, by), by)
    cells = rows.select(*by, F.col("class").cast("string").alias("row"), "precision", "recall", "f1", "support")
    total = _summary(rows, by)
    none = F.lit(None).cast("double")
    accuracy = total.select(*by, F.lit("accuracy").alias("row"), none.alias("precision"), none.alias("recall"), F.col("accuracy").alias("f1"), "support")
    means = [
        total.select(*by, F.lit(f"{kind} avg").alias("row"), *[F.col(f"{kind}_{m}").alias(m) for m in ("precision", "recall", "f1")], "support")
        for kind in ("macro", "weighted")
    ]
    return cells.unionByName(accuracy).unionByName(means[0]).unionByName(means[1])


def weighted_metrics(
    df: DataFrame, label: str = "y", pred: str = "pred", classes: Sequence[int] = (0, 1), by: Sequence[str] = ()
) -> DataFrame:
    """Accuracy and support-weighted precision, recall and F1; 0 where undefined."""
    total = _summary(per_class(confusion(df, label, pred, classes, by), by), by)
    return total.select(
        *by,
        "accuracy",
        F.col("weighted_precision").alias("precision"),
        F.col("weighted_recall").alias("recall"),
        F.col("weighted_f1").alias("f1_score"),
    )


def binary_metrics(
    df: DataFrame, score: str = "p", label: str = "y", pred: str = "pred", by: Sequence[str] = ()
) -> DataFrame:
    """AUC, AP, precision, recall and F1 of the positive class, one row per group."""
    by = list(by)
    y, hard = F.col(label) == 1, F.col(pred) == 1
    counts = df.groupBy(*by).agg(
        F.count_if(y & hard).alias("_tp"), F.count_if(hard).alias("_called"), F.count_if(y).alias("_support")
    )
    counts = counts.withColumns(
        {"precision": _ratio(F.col("_tp"), F.col("_called")), "recall": _ratio(F.col("_tp"), F.col("_support"))}
    )
    counts = counts.withColumn(
        "f1", _ratio(2.0 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )
    ranks = ranking_metrics(df, score, label, by)
    wide = ["auc", "ap", "precision", "recall", "f1"]
    if by:
        return ranks.join(counts, by).select(*by, *wide)
    row = counts.agg(F.first(F.struct("precision", "recall", "f1"))).scalar()
    return ranks.withColumn("_c", row).select("auc", "ap", "_c.*")
