"""Evaluate a scored table and store the report."""

from __future__ import annotations

from pyspark.sql import DataFrame

from vigilflow.operators import metrics
from vigilflow.sources.sinks import write_report


def evaluate(scored: DataFrame, truth: str = "truth", pred: str = "pred", by: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Summary, per-class table and normalised confusion of one evaluation."""
    cells = metrics.confusion(scored, truth, pred, by)
    return {
        "summary": metrics.report(scored, truth, pred, by),
        "classes": metrics.per_class(cells, by),
        "confusion": metrics.normalised(cells, by),
    }


def save_evaluation(parts: dict[str, DataFrame], path: str) -> None:
    for name, frame in parts.items():
        write_report(frame, f"{path}/{name}")
