"""Response planning: who is answered, how often, and with which actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.functions.devices import response_plan
from vigilflow.functions.lookup import blank_to_null
from vigilflow.functions.network import monitored, switch_for_ip
from vigilflow.functions.severity import reaches
from vigilflow.operators.timeline import greedy_marks

BLOCK_SECONDS = 300


def eligible(df: DataFrame, minimum: str = "high") -> DataFrame:
    """Attacks that may trigger a response, with the switch in charge.

    The severity is the model's own, not the escalated one.
    """
    vlan = F.coalesce(F.col("vlan_id"), F.lit(0))
    source = F.coalesce(blank_to_null("src_ip"), F.lit("-"))
    return (
        df.filter(F.col("is_attack") & (source != "-") & ~monitored(vlan) & reaches("severity", minimum))
        .withColumn("switch_ip", switch_for_ip("src_ip"))
        .filter(F.col("switch_ip").isNotNull())
    )


def suppress_repeats(
    df: DataFrame,
    keys: tuple[str, ...] = ("src_ip", "group_pred"),
    at: str = "created_at",
    tie: str = "id",
    seconds: int = BLOCK_SECONDS,
    **tuning,
) -> DataFrame:
    """First event per key, then nothing until strictly more than ``seconds`` later.

    Suppressed events do not extend the block.  Of events at the same time the
    one with the smallest ``tie`` counts.  Gives the keys, time and tie (row id) of
    the events that fire; wider columns can be joined to these few rows.
    """
    stamped = df.select(*keys, tie, F.unix_micros(F.col(at).cast("timestamp")).alias("_t"))
    marks = greedy_marks(stamped, keys, "_t", seconds * 1_000_000, tie, **tuning)
    return marks.select(tie, *keys, F.timestamp_micros("_t").cast(df.schema[at].dataType).alias(at))


def plan(df: DataFrame, at: Column, interface: Column | None = None) -> DataFrame:
    """Append the ordered actions; ``interface`` is the source's access port if known."""
    port = interface if interface is not None else F.lit(None).cast("string")
    return df.withColumn(
        "actions", response_plan("group_pred", "flow_direction", "src_ip", "vlan_id", port, at)
    )


def shared_contacts(flows: DataFrame, group: str = "Bot") -> DataFrame:
    """Sources that contacted a destination a bot has contacted.

    One row per (destination, source), with the number of flows and whether the
    source itself was seen as a bot there; no pairs of sources are built.
    """
    contacts = flows.groupBy("dst_ip", "src_ip").agg(
        F.count(F.lit(1)).alias("flows"), F.count_if(F.col("group_pred") == group).alias("bot_flows")
    )
    control = contacts.groupBy("dst_ip").agg(F.sum("bot_flows").alias("all_bot_flows")).filter("all_bot_flows > 0")
    return contacts.join(control, "dst_ip", "left_semi").select(
        "dst_ip", "src_ip", "flows", (F.col("bot_flows") > 0).alias("is_bot")
    )
