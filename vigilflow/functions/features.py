"""Flow features: the 71 flow-meter columns and the 20 engineered ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow import lookups as L
from vigilflow.functions.numbers import finite_or, ratio, safe_float

EPSILON = 1e-8
SIDES = (("Fwd", "src2dst"), ("Bwd", "dst2src"))
STATISTICS = ("Max", "Min", "Mean", "Std")
# Features no exporter here can measure; they are always 0.
UNMEASURED = [
    "Init_Win_bytes_forward", "Init_Win_bytes_backward",
    "Fwd Avg Bytes/Bulk", "Fwd Avg Packets/Bulk", "Fwd Avg Bulk Rate",
    "Bwd Avg Bytes/Bulk", "Bwd Avg Packets/Bulk", "Bwd Avg Bulk Rate",
    "Active Mean", "Active Std", "Active Max", "Active Min",
    "Idle Mean", "Idle Std", "Idle Max", "Idle Min",
]
# Bit positions of the TCP flags.
TCP_FLAG_BITS = {"FIN": 0, "SYN": 1, "RST": 2, "PSH": 3, "ACK": 4, "URG": 5}


# Base features the engineered ones are computed from.
BASE_FEATURES = [
    "Total Fwd Packets", "Total Backward Packets", "Total Length of Fwd Packets", "Total Length of Bwd Packets",
    "Flow Duration", "SYN Flag Count", "ACK Flag Count", "FIN Flag Count", "RST Flag Count", "PSH Flag Count",
    "URG Flag Count", "Min Packet Length", "Max Packet Length", "Flow IAT Mean", "Flow IAT Std",
    "Fwd Packet Length Mean", "Fwd Packet Length Std", "Fwd Header Length", "Active Mean", "Idle Mean",
]


def engineer(df: DataFrame) -> DataFrame:
    """Append (or replace) the 20 engineered features.

    Columns that ``df`` lacks, and null or non-finite cells, count as 0.  The base
    cells are cleaned once in a projection of their own.
    """
    present = {name: f"_base{i}" for i, name in enumerate(BASE_FEATURES) if name in df.columns}
    cleaned = df.withColumns(
        {alias: finite_or(F.col(f"`{name}`").cast("double"), F.lit(0.0)) for name, alias in present.items()}
    )
    return cleaned.withColumns(_engineered(present)).drop(*present.values())


def _engineered(present: dict[str, str]) -> dict[str, Column]:
    """Feature expressions over the cleaned base columns; absent ones are 0."""

    def base(name: str) -> Column:
        return F.col(present[name]) if name in present else F.lit(0.0)

    def flag(name: str) -> Column:
        return base(f"{name} Flag Count")

    fwd, bwd = base("Total Fwd Packets"), base("Total Backward Packets")
    fwd_bytes = base("Total Length of Fwd Packets") + EPSILON
    bwd_bytes = base("Total Length of Bwd Packets") + EPSILON
    length = base("Flow Duration")
    packets = fwd + bwd + EPSILON
    over = F.try_divide

    raw = {f"{n.lower()}_flag_ratio": over(flag(n), packets) for n in ("SYN", "FIN", "PSH", "RST")}
    raw["ack_syn_ratio"] = over(flag("ACK"), flag("SYN") + EPSILON)
    seen = [(flag(n) > 0).cast("double") for n in ("SYN", "ACK", "FIN", "RST", "PSH", "URG")]
    raw["flag_diversity"] = sum(seen[1:], seen[0])
    raw["bytes_per_pkt_fwd"] = over(fwd_bytes, fwd + EPSILON)
    raw["bytes_per_pkt_bwd"] = over(bwd_bytes, bwd + EPSILON)
    raw["pkt_size_ratio"] = over(
        base("Min Packet Length") + EPSILON, base("Max Packet Length") + EPSILON
    )
    raw["fwd_bwd_pkt_ratio"] = over(fwd, bwd + EPSILON)
    raw["fwd_bwd_byte_ratio"] = over(fwd_bytes, bwd_bytes)
    raw["bwd_fwd_byte_ratio"] = over(bwd_bytes, fwd_bytes)
    raw["pkts_per_duration"] = over(packets, length + EPSILON)
    raw["bytes_per_duration"] = over(fwd_bytes + bwd_bytes, length + EPSILON)
    raw["duration_log"] = F.log1p(length)
    raw["slow_indicator"] = over(length, packets)
    for out, stem in (("iat_cv", "Flow IAT"), ("fwd_pkt_len_cv", "Fwd Packet Length")):
        raw[out] = over(base(f"{stem} Std"), base(f"{stem} Mean") + EPSILON)
    # The byte total already carries one epsilon; the second is intended.
    raw["header_payload_ratio"] = over(base("Fwd Header Length"), fwd_bytes + EPSILON)
    raw["active_idle_ratio"] = over(base("Active Mean"), base("Idle Mean") + EPSILON)
    return {
        name: finite_or(raw[name], F.lit(0.0)).cast("float") for name in L.ENGINEERED_FEATURES
    }


def _shared(features: dict, fwd, bwd, fwd_bytes, bwd_bytes, duration_ms, protocol) -> None:
    """Features that every source derives in the same way."""
    seconds = duration_ms / 1000.0
    header = F.when(protocol == 6, F.lit(40.0)).otherwise(F.lit(28.0))
    features["Flow Duration"] = duration_ms * 1000.0
    features["Total Fwd Packets"], features["Total Backward Packets"] = fwd, bwd
    features["Total Length of Fwd Packets"] = fwd_bytes
    features["Total Length of Bwd Packets"] = bwd_bytes
    features["Flow Bytes/s"] = ratio(fwd_bytes + bwd_bytes, seconds)
    features["Flow Packets/s"] = ratio(fwd + bwd, seconds)
    for side, packets, volume in (("Fwd", fwd, fwd_bytes), ("Bwd", bwd, bwd_bytes)):
        features[f"{side} Packets/s"] = ratio(packets, seconds)
        features[f"{side} Header Length"] = header * packets
        features[f"Subflow {side} Packets"] = packets
        features[f"Subflow {side} Bytes"] = volume
    features["act_data_pkt_fwd"] = fwd
    for name in UNMEASURED:
        features[name] = F.lit(0.0)


def mirror_features(df: DataFrame) -> dict[str, Column]:
    """71 features of a mirrored (bidirectional, millisecond) flow record."""
    have = set(df.columns)

    def field(name: str) -> Column:
        return safe_float(F.col(name)) if name in have else F.lit(0.0)

    def micros(name: str) -> Column:
        return field(name) * 1000.0

    features: dict[str, Column] = {}
    _shared(
        features,
        field("src2dst_packets"), field("dst2src_packets"),
        field("src2dst_bytes"), field("dst2src_bytes"),
        field("bidirectional_duration_ms"), field("protocol").cast("int"),
    )
    for side, record in SIDES:
        for stat in STATISTICS:
            kind = "stddev" if stat == "Std" else stat.lower()
            features[f"{side} Packet Length {stat}"] = field(f"{record}_{kind}_ps")
            features[f"{side} IAT {stat}"] = micros(f"{record}_{kind}_piat_ms")
        features[f"{side} IAT Total"] = micros(f"{record}_duration_ms")
        features[f"Avg {side} Segment Size"] = field(f"{record}_mean_ps")
    for stat in STATISTICS:
        kind = "stddev" if stat == "Std" else stat.lower()
        features[f"Flow IAT {stat}"] = micros(f"bidirectional_{kind}_piat_ms")
    for flag in (*TCP_FLAG_BITS, "ECE"):
        features[f"{flag} Flag Count"] = sum(
            (field(f"{record}_{flag.lower()}_packets") for _, record in SIDES), F.lit(0.0)
        )
    spread = field("bidirectional_stddev_ps")
    features["Min Packet Length"] = field("bidirectional_min_ps")
    features["Max Packet Length"] = field("bidirectional_max_ps")
    features["Packet Length Mean"] = field("bidirectional_mean_ps")
    features["Packet Length Std"] = spread
    features["Packet Length Variance"] = spread * spread
    features["Average Packet Size"] = field("bidirectional_mean_ps")
    features["min_seg_size_forward"] = field("src2dst_min_ps")
    features["Destination Port"] = field("dst_port")
    return features


def map_mirror_flows(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows of mirrored flows; flows without packets are dropped."""
    features = mirror_features(df)
    busy = features["Total Fwd Packets"] + features["Total Backward Packets"] != 0
    return df.filter(busy).select(*keep, *[c.alias(n) for n, c in features.items()])


def netflow_features(df: DataFrame) -> dict[str, Column]:
    """71 features of an exported (one-way, averaged) flow record."""
    have = set(df.columns)

    def field(name: str) -> Column:
        return F.coalesce(F.col(name).cast("double"), F.lit(0.0)) if name in have else F.lit(0.0)

    fwd, bwd = field("pkts"), field("out_pkts")
    fwd_bytes, bwd_bytes = field("octets"), field("out_octets")
    # Exporters may declare these fields wider than the values they hold.
    flags = F.coalesce(field("tcp_flags").try_cast("long"), F.lit(0).cast("long"))
    features: dict[str, Column] = {}
    _shared(features, fwd, bwd, fwd_bytes, bwd_bytes, field("duration_ms"),
            F.coalesce(field("proto").try_cast("long"), F.lit(0).cast("long")))
    mean = {"Fwd": ratio(fwd_bytes, fwd), "Bwd": ratio(bwd_bytes, bwd)}
    # A record without packets still shows its bytes, as if of one packet.
    overall = F.try_divide(fwd_bytes + bwd_bytes, F.when(fwd + bwd > 0, fwd + bwd).otherwise(F.lit(1.0)))
    for side in mean:
        for stat in STATISTICS:
            features[f"{side} Packet Length {stat}"] = F.lit(0.0) if stat == "Std" else mean[side]
            features[f"{side} IAT {stat}"] = F.lit(0.0)
        features[f"Avg {side} Segment Size"] = mean[side]
    for stat in STATISTICS:
        features[f"Flow IAT {stat}"] = F.lit(0.0)
    features["Fwd IAT Total"] = features["Flow Duration"]
    features["Bwd IAT Total"] = F.lit(0.0)
    for flag, bit in TCP_FLAG_BITS.items():
        features[f"{flag} Flag Count"] = (
            F.shiftright(flags, bit).bitwiseAND(F.lit(1)).cast("double")
        )
    features["ECE Flag Count"] = F.lit(0.0)
    features["Min Packet Length"] = F.when(fwd > 0, mean["Fwd"]).otherwise(mean["Bwd"])
    for name in ("Max Packet Length", "Packet Length Mean", "Average Packet Size"):
        features[name] = overall
    features["Packet Length Std"] = features["Packet Length Variance"] = F.lit(0.0)
    features["min_seg_size_forward"] = mean["Fwd"]
    features["Destination Port"] = field("dst_port")
    return features


def map_netflow(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature rows of exported flow records."""
    return df.select(*keep, *[c.alias(n) for n, c in netflow_features(df).items()])


def align_features(df: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Exactly the model's features in its order: missing or null is 0, float32."""
    have = set(df.columns)
    cells = [
        (finite_or(F.col(f"`{n}`").cast("double"), F.lit(0.0)) if n in have else F.lit(0.0))
        .cast("float")
        .alias(n)
        for n in names
    ]
    return df.select(*keep, *cells)
