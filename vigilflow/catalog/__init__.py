"""Named queries over the given tables and the SQL that checks them."""

from vigilflow.catalog.registry import ORACLES, QUERIES
from vigilflow.catalog import (  # noqa: F401  (each module registers its queries)
    alert_queries, analytics_queries, capture_queries, cleaning_queries, feature_queries,
    history_queries, metric_queries, model_queries, sampling_queries, stream_queries,
)

__all__ = ["ORACLES", "QUERIES"]
