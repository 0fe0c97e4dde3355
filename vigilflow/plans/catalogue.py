"""Catalogue tables: classes, groups, severities, features."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from vigilflow import lookups as L


def class_table(spark: SparkSession) -> DataFrame:
    """Every class with code, group, severity and the other classes of its group."""
    rows = [
        (code, name, L.CLASS_TO_GROUP[name], L.SEVERITY[name], [m for m in L.GROUP_MEMBERS[L.CLASS_TO_GROUP[name]] if m != name])
        for code, name in enumerate(L.TARGET_CLASSES)
    ]
    return spark.createDataFrame(rows, "code int, class string, group string, severity string, peers array<string>")


def feature_table(ranks: DataFrame, top: int = 30) -> DataFrame:
    """The best ranked features (ranks come from a table of one row per feature)."""
    return ranks.orderBy("rank").limit(top).select(F.col("feature").alias("name"), "rank")
