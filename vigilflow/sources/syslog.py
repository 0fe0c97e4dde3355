"""Switch messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from vigilflow.functions.messages import syslog_tier


def tag_messages(messages: DataFrame) -> DataFrame:
    """Trim the text and append its ``tier``.  Input: switch, msg (batch or stream)."""
    return messages.withColumn("msg", F.trim("msg")).withColumn("tier", syslog_tier("msg"))
