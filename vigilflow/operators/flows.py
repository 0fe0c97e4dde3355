"""Packets to bidirectional flows with idle and active timeouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.operators.joins import match
from vigilflow.operators.timeline import carry_forward, greedy_marks, with_previous
from vigilflow.session import cut_lineage

IDLE_SECONDS = 15
ACTIVE_SECONDS = 30
FLAGS = ("syn", "ack", "fin", "rst", "psh", "urg", "ece")
_US = 1_000_000
KEY = ["ip_a", "port_a", "ip_b", "port_b", "protocol"]


def bidirectional_key(df: DataFrame) -> DataFrame:
    """Append a key that is equal for both directions of a conversation; no port (ICMP) counts as port 0."""
    port = lambda e: F.coalesce(F.col(f"{e}_port"), F.lit(0))
    ends = [F.struct(F.col(f"{e}_ip").alias("ip"), port(e).alias("port")) for e in ("src", "dst")]
    low, high = F.least(*ends), F.greatest(*ends)
    return df.withColumns({"ip_a": low["ip"], "port_a": low["port"], "ip_b": high["ip"], "port_b": high["port"]})


def assign_flows(
    packets: DataFrame,
    keys: list[str] | None = None,
    at: str = "ts",
    tie: str = "packet_id",
    idle: float = IDLE_SECONDS,
    active: float = ACTIVE_SECONDS,
    **tuning,
) -> DataFrame:
    """Append ``flow_start`` (microseconds) to every packet.

    A flow ends after a gap longer than ``idle``; a longer one is cut at the first
    packet more than ``active`` after its own start.  Both are one greedy mark
    problem, the idle gaps being forced marks.
    """
    keys = keys or KEY
    block = int(max(idle, active) * 4 * _US)
    timed = packets.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp")))
    timed = timed.withColumn("_b", F.floor(F.col("_t") / block))
    lagged = with_previous(timed, keys, ["_t", tie], "_t", "_b", "_prev")
    gaps = lagged.withColumn(
        "_idle", F.col("_prev").isNull() | (F.col("_t") - F.col("_prev") > int(idle * _US))
    )
    # The marks read these narrow rows several times; stored, the two shuffles run once.
    gaps = cut_lineage(packets.sparkSession, gaps.select(*keys, "_t", tie, "_idle"))
    starts = greedy_marks(gaps, keys, "_t", int(active * _US), tie, forced="_idle", **tuning)
    flagged = match(timed, starts.select(*keys, "_t", F.col("_t").alias("_s")), [*keys, "_t"], "left")
    return carry_forward(flagged, keys, ["_t", tie], "_s", "_b", "flow_start").drop("_s", "_b")


def aggregate_flows(assigned: DataFrame, keys: list[str] | None = None, tie: str = "packet_id") -> DataFrame:
    """Flow records: counts, bytes, sizes, inter-arrival times and flags by direction.

    The direction of the first packet is src2dst.  Expects ``assign_flows`` output
    with src_ip, src_port, dst_ip, dst_port and bytes; TCP flag columns (0/1) are optional.
    """
    keys = keys or KEY
    flow = [*keys, "flow_start"]
    order = F.struct("_t", tie)
    ends = ["src_ip", "src_port", "dst_ip", "dst_port"]
    whole = Window.partitionBy(*flow).orderBy("_t", tie)
    first = {f"_{c}": F.first(c).over(whole) for c in ends}
    rows = assigned.withColumns(first).withColumn(
        "_fwd", F.col("src_ip").eqNullSafe(F.col("_src_ip")) & F.col("src_port").eqNullSafe(F.col("_src_port"))
    )
    same = Window.partitionBy(*flow, "_fwd").orderBy("_t", tie)
    rows = rows.withColumns(
        {
            "_gap": (F.col("_t") - F.lag("_t").over(whole)) / 1000.0,
            "_own_gap": (F.col("_t") - F.lag("_t").over(same)) / 1000.0,
        }
    )
    sides = {
        "bidirectional": (F.lit(True), "_gap"),
        "src2dst": (F.col("_fwd"), "_own_gap"),
        "dst2src": (~F.col("_fwd"), "_own_gap"),
    }
    measures: list[Column] = []
    for name, (mine, gap) in sides.items():
        size, wait, when = (F.when(mine, F.col(c)) for c in ("bytes", gap, "_t"))
        measures += [
            F.count_if(mine).alias(f"{name}_packets"),
            F.coalesce(F.sum(size), F.lit(0)).alias(f"{name}_bytes"),
            F.coalesce((F.max(when) - F.min(when)) / 1000.0, F.lit(0.0)).alias(f"{name}_duration_ms"),
        ]
        for value, unit in ((size, "ps"), (wait, "piat_ms")):
            for stat, f in (("min", F.min), ("max", F.max), ("mean", F.avg), ("stddev", F.stddev_samp)):
                measures.append(F.coalesce(f(value), F.lit(0.0)).alias(f"{name}_{stat}_{unit}"))
        for flag in FLAGS:
            if flag in assigned.columns:
                measures.append(F.coalesce(F.sum(F.when(mine, F.col(flag))), F.lit(0)).alias(f"{name}_{flag}_packets"))
    return rows.groupBy(*flow).agg(*[F.min_by(f"_{c}", order).alias(c) for c in ends], *measures)


def packets_to_flows(packets: DataFrame, **options) -> DataFrame:
    """All steps: direction-free key, flow starts, flow records."""
    return aggregate_flows(assign_flows(bidirectional_key(packets), **options))
