"""Evaluation metrics, all derived from one small confusion table.

The only pass over the rows is a count per (phase, truth, prediction), combined
on the map side; every metric is arithmetic on at most classes² rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow import lookups as L
from vigilflow.functions.lookup import class_group

_NORM = 1e-8


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Counts ``n`` per truth and prediction."""
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(
        F.count(F.lit(1)).alias("n")
    )


def normalised(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Append the share of each cell in its true class."""
    total = F.sum("n").over(Window.partitionBy(*by, "truth"))
    return cells.withColumn("share", F.col("n") / (total + _NORM))


def wide(cells: DataFrame, classes: list[str]) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    return cells.groupBy("truth").pivot("pred", classes).agg(F.sum("n")).na.fill(0)


def to_groups(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """The same table on level-1 groups."""
    return cells.groupBy(*by, class_group("truth").alias("truth"), class_group("pred").alias("pred")).agg(
        F.sum("n").alias("n")
    )


def _divide(top: Column, bottom: Column) -> Column:
    """Division with 0 for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))


def per_class(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Support, hits, precision, recall and F1 of every class seen on either side."""
    side = F.explode(
        F.array(
            F.struct(F.col("truth").alias("class"), F.col("n").alias("real"), F.lit(0).cast("long").alias("said")),
            F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("real"), F.col("n").alias("said")),
        )
    )
    hit = F.when((F.col("truth") == F.col("pred")) & (F.col("s.real") > 0), F.col("n")).otherwise(0)
    counted = (
        cells.select(*by, "truth", "pred", "n", side.alias("s"))
        .groupBy(*by, F.col("s.class").alias("class"))
        .agg(F.sum("s.real").alias("support"), F.sum("s.said").alias("predicted"), F.sum(hit).alias("hits"))
    )
    precision = _divide(F.col("hits"), F.col("predicted"))
    recall = _divide(F.col("hits"), F.col("support"))
    return counted.select(
        *by, "class", "support", "predicted", "hits",
        precision.alias("precision"), recall.alias("recall"),
        _divide(2 * F.col("hits"), F.col("support") + F.col("predicted")).alias("f1"),
    )


def summary(cells: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Accuracy, weighted precision/recall/F1, macro F1, hard-label AUC, false alarms.

    The AUC of hard labels is the support-weighted mean of (TPR + TNR) / 2; it is
    null when some class has no positive or no negative row.  The false alarm rate is
    null without benign rows.
    """
    classes = per_class(cells, by)
    total = F.sum("support").over(Window.partitionBy(*by)) if by else F.sum("support").over(Window.partitionBy(F.lit(0)))
    rows = classes.withColumn("_all", total)
    negatives = F.col("_all") - F.col("support")
    quiet = negatives - (F.col("predicted") - F.col("hits"))
    area = F.when(
        (F.col("support") > 0) & (negatives > 0),
        (F.col("recall") + quiet / negatives) / 2,
    )
    weight = F.col("support")

    def weighted(c: Column) -> Column:
        return F.sum(c * weight) / F.sum(weight)

    benign = F.col("class").cast("string") == L.BENIGN
    return rows.groupBy(*by).agg(
        F.sum("support").alias("rows"),
        (F.sum("hits") / F.sum("support")).alias("accuracy"),
        weighted(F.col("precision")).alias("precision_weighted"),
        weighted(F.col("recall")).alias("recall_weighted"),
        weighted(F.col("f1")).alias("f1_weighted"),
        F.avg("f1").alias("f1_macro"),
        F.when(F.count(area) == F.count(F.lit(1)), weighted(area)).alias("auc"),
        F.sum(F.when(benign & (weight > 0), (weight - F.col("hits")) / weight)).alias("false_alarm_rate"),
    )


def report(df: DataFrame, truth: str = "truth", pred: str = "pred", by: tuple[str, ...] = ()) -> DataFrame:
    """Full evaluation: class metrics plus level-1 accuracy and F1 per phase."""
    cells = confusion(df, truth, pred, by)
    fine = summary(cells, by)
    coarse = summary(to_groups(cells, by), by).select(
        *by, F.col("accuracy").alias("level1_accuracy"), F.col("f1_weighted").alias("level1_f1")
    )
    return fine.join(coarse, list(by)) if by else fine.crossJoin(coarse)


def batch_accuracy(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Share of rows predicted right, 4 decimals; null without any label."""
    right = F.when(F.col(truth).eqNullSafe(F.col(pred)), 1).otherwise(0)
    share = F.round(F.sum(right) / F.count(F.lit(1)), 4)
    return df.agg(F.when(F.count(truth) > 0, share).alias("accuracy"))


def class_distribution(df: DataFrame, label: str = "Label") -> DataFrame:
    """Rows per class and the share of the largest class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share_of_max", F.col("n") / F.max("n").over(Window.partitionBy(F.lit(0))))


def classes_present(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Every class on either side, and whether it is a target class."""
    both = df.select(F.explode(F.array(truth, pred)).alias("class")).distinct()
    return both.withColumn("is_target", F.col("class").isin(L.TARGET_CLASSES))
