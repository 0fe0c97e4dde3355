"""Flow-export datagrams (v5, v9, IPFIX) from a payload table to flow records.

Input columns: exporter, recv_ts, packet_no (order of equal times), payload.
v5 and all record decoding are column expressions.  Only the walk over the
variable-length sets of a v9/IPFIX datagram is a small Arrow-batched helper.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from vigilflow import lookups as L
from vigilflow.functions.features import map_netflow
from vigilflow.functions.network import flow_direction, resolve_vlans
from vigilflow.operators.joins import BROADCAST_BYTES, match, planned_bytes
from vigilflow.session import cut_lineage, fresh_folder

RECORD = [
    "src_ip", "dst_ip", "src_port", "dst_port", "pkts", "octets", "out_pkts", "out_octets",
    "duration_ms", "proto", "tcp_flags", "vlan_id", "src_vlan", "dst_vlan",
]
SET_SCHEMA = (
    "exporter string, recv_ts timestamp, packet_no long, set_no int, source_id long, template_id int, "
    "layout array<struct<type: int, pos: int, len: int>>, record_size int, body binary"
)


def unsigned(data: Column, start: Column | int, size: Column | int) -> Column:
    """Big-endian unsigned number; null when out of long range."""
    begin = F.lit(start) if isinstance(start, int) else start
    if isinstance(size, int):
        return F.coalesce(F.conv(F.nullif(F.hex(F.substring(data, begin + 1, F.lit(size))), F.lit("")), 16, 10), F.lit("0")).try_cast("long")
    raw = F.ltrim(F.hex(F.substring(data, begin + 1, size)), F.lit("0"))
    number = F.when(raw == "", F.lit("0")).otherwise(F.conv(raw, 16, 10))
    return F.when(F.length(raw) <= 16, number.try_cast("long"))


def wide_number(digits: Column) -> Column:
    """Unsigned number from hex digits as decimal(38, 0): exact for up to 15 significant bytes, else null."""
    raw = F.ltrim(digits, F.lit("0"))
    low = F.conv(F.coalesce(F.nullif(F.right(raw, F.lit(16)), F.lit("")), F.lit("0")), 16, 10).cast("decimal(20,0)")
    high = F.conv(F.substring(raw, F.lit(1), F.length(raw) - 16), 16, 10).cast("decimal(17,0)")
    both = (high * F.lit(str(2**64)).cast("decimal(20,0)") + low).cast("decimal(38,0)")
    return F.when(F.length(raw) <= 16, low.cast("decimal(38,0)")).when(F.length(raw) <= 30, both)


def dotted(data: Column, start: Column | int) -> Column:
    """IPv4 address in text form."""
    begin = F.lit(start) if isinstance(start, int) else start
    return F.concat_ws(".", *[unsigned(data, begin + i, 1).cast("string") for i in range(4)])


def version(payload: Column | str = "payload") -> Column:
    data = F.col(payload) if isinstance(payload, str) else payload
    return F.when(F.length(data) >= 2, unsigned(data, 0, 2))


def decode_v5(packets: DataFrame) -> DataFrame:
    """Records of v5 datagrams: fixed 48-byte layout, stops where bytes run out."""
    data = F.col("payload")
    whole = F.floor((F.length(data) - 24) / 48)
    count = F.least(unsigned(data, 2, 2), whole).cast("int")
    fit = packets.filter((F.length(data) >= 24) & (version() == 5) & (count > 0))
    slots = F.sequence(F.lit(0), count - 1)
    record = F.transform(slots, lambda i: F.substring(data, i * 48 + 25, F.lit(48)))
    rows = fit.select("exporter", "recv_ts", "packet_no", F.posexplode(record).alias("record_no", "r"))
    r = F.col("r")
    first, last = unsigned(r, 24, 4), unsigned(r, 28, 4)
    zero = F.lit(0).cast("long")
    big = lambda c: c.cast("decimal(38,0)")
    fields = {
        "src_ip": dotted(r, 0), "dst_ip": dotted(r, 4),
        "src_port": unsigned(r, 32, 2), "dst_port": unsigned(r, 34, 2),
        "pkts": big(unsigned(r, 16, 4)), "octets": big(unsigned(r, 20, 4)),
        "out_pkts": big(zero), "out_octets": big(zero),
        "duration_ms": F.greatest(last - first, zero).cast("double"),
        "proto": unsigned(r, 38, 1), "tcp_flags": unsigned(r, 37, 1),
        "vlan_id": zero, "src_vlan": zero, "dst_vlan": zero,
    }
    return rows.select(
        "exporter", "recv_ts", "packet_no", F.lit(0).alias("set_no"), "record_no",
        *[fields[name].alias(name) for name in RECORD],
    )


def walk_sets(data: bytes) -> Iterator[tuple[int, int, bytes]]:
    """(source id, set id, body) of every set in a v9 or IPFIX datagram.

    In v9 the header count bounds the number of sets; IPFIX runs to the end.
    """
    kind = int.from_bytes(data[:2], "big") if len(data) >= 2 else 0
    head = {9: 20, 10: 16}.get(kind)
    if head is None or len(data) < head:
        return
    source = int.from_bytes(data[head - 4 : head], "big")
    left = int.from_bytes(data[2:4], "big") if kind == 9 else len(data)
    at = head
    while left > 0 and at + 4 <= len(data):
        set_id, size = struct.unpack_from(">HH", data, at)
        if size < 4:
            return
        yield source, set_id, data[at + 4 : at + size]
        at, left = at + size, left - 1


def walk_templates(body: bytes) -> Iterator[tuple[int, list[tuple[int, int, int]], int]]:
    """(template id, [(type, position, length)], record size) of a template set."""
    at = 0
    while at + 4 <= len(body):
        template, count = struct.unpack_from(">HH", body, at)
        at += 4
        if count == 0:
            return
        pairs = list(struct.iter_unpack(">HH", body[at : at + 4 * min(count, (len(body) - at) // 4)]))
        at += 4 * len(pairs)
        layout, pos = [], 0
        for kind, size in pairs:
            layout.append((kind, pos, size))
            pos += size
        yield template, layout, pos


def split_sets(packets: DataFrame, only: str | None = None) -> DataFrame:
    """One row per template definition or data set of v9/IPFIX datagrams.

    ``only``: 'data' gives data sets alone; 'templates' gives definitions and, without body, one row per exporter, source,
    template and hour that a batch has data sets of.
    """

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [part.split()[0] for part in SET_SCHEMA.replace("struct<type: int, pos: int, len: int>", "s").split(", ")]
        for batch in batches:
            rows, hours = [], set()
            for exporter, ts, number, data in batch.itertuples(index=False):
                own_template_set = 0 if data[:2] == b"\x00\x09" else 2
                step = 0
                for source, set_id, body in walk_sets(data):
                    if set_id == own_template_set:
                        for template, layout, size in walk_templates(body):
                            if only != "data":
                                fields = [{"type": t, "pos": p, "len": n} for t, p, n in layout]
                                rows.append((exporter, ts, number, step, source, template, fields, size, None))
                            step += 1
                    elif set_id >= 256:
                        if only == "templates":
                            hours.add((exporter, source, set_id, None if pd.isna(ts) else ts.floor("h")))
                        else:
                            rows.append((exporter, ts, number, step, source, set_id, None, None, body))
                        step += 1
            rows += [(exporter, hour, None, None, source, template, None, None, None) for exporter, source, template, hour in hours]
            yield pd.DataFrame(rows, columns=names).astype({"packet_no": "Int64", "set_no": "Int32", "record_size": "Int32"})

    chosen = packets.filter(version().isin(9, 10)).select("exporter", "recv_ts", "packet_no", "payload")
    return chosen.mapInPandas(split, SET_SCHEMA)


TEMPLATE = ["exporter", "source_id", "template_id"]
ORDER = ["recv_ts", "packet_no", "set_no"]


def template_versions(found: DataFrame) -> DataFrame:
    """(exporter, source_id, template_id, hour, _from, _to, layout, record_size): which definition holds when, by hour.

    ``found`` has definitions and the hours with data (``split_sets(only='templates')``).  A definition that
    repeats the one before is none of its own.  In each hour with data the latest earlier one holds from the
    start on; an interval ends where the next begins.  Windows are per key and hour, or over one row for each.
    """
    timed = found.withColumns({"hour": F.date_trunc("HOUR", "recv_ts"), "_t": F.when(F.col("layout").isNotNull(), F.struct("layout", "record_size"))})
    hours = timed.select(*TEMPLATE, "hour").distinct()
    at = F.struct(*ORDER)
    defined = timed.where(F.col("_t").isNotNull())
    local = Window.partitionBy(*TEMPLATE, "hour").orderBy(*ORDER)
    news = defined.withColumn("_before", F.lag("_t").over(local)).where(F.col("_before").isNull() | (F.col("_before") != F.col("_t")))
    news = news.select(*TEMPLATE, "hour", at.alias("_from"), "_t")
    last = defined.groupBy(*TEMPLATE, "hour").agg(F.max_by("_t", at).alias("_t"))
    each = match(hours, last, [*TEMPLATE, "hour"])
    before = Window.partitionBy(*TEMPLATE).orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    carried = each.select(*TEMPLATE, "hour", F.lit(None).cast(news.schema["_from"].dataType).alias("_from"), F.last("_t", ignorenulls=True).over(before).alias("_t"))
    every = news.unionByName(carried.where(F.col("_t").isNotNull()))
    following = Window.partitionBy(*TEMPLATE, "hour").orderBy(F.asc_nulls_first("_from"))
    return every.withColumn("_to", F.lead("_from").over(following)).select(*TEMPLATE, "hour", "_from", "_to", "_t.*")


def attach_templates(sets: DataFrame, versions: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Data sets with the latest template defined before them; others are dropped.

    ``versions`` is a stored table, so its size is that of its files.  Within ``limit`` bytes it is
    broadcast and no body moves; beyond it, both sides meet by key and hour.
    """
    data = sets.where(F.col("body").isNotNull()).drop("layout", "record_size").withColumn("hour", F.date_trunc("HOUR", "recv_ts"))
    renamed = versions.withColumnsRenamed({c: f"_{c}" for c in [*TEMPLATE, "hour"]})
    at = F.struct(*ORDER)
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in [*TEMPLATE, "hour"]]
    on += [F.col("_from").isNull() | (F.col("_from") <= at), F.col("_to").isNull() | (at < F.col("_to"))]
    side = F.broadcast(renamed) if planned_bytes(versions) <= limit else renamed.hint("merge")
    return data.join(side, on).select("exporter", "recv_ts", "packet_no", "set_no", "body", "layout", "record_size")


def decode_sets(ready: DataFrame) -> DataFrame:
    """Records of data sets that carry their template's layout."""
    count = F.floor(F.length("body") / F.col("record_size")).cast("int")
    code = {name: number for number, name in L.EXPORT_FIELDS.items()}

    def slot(name: str) -> Column:
        return F.try_element_at(F.filter("layout", lambda f: f["type"] == code[name]), F.lit(-1))

    slots = F.struct(*[slot(name).alias(name) for name in code])
    rows = (
        ready.filter("record_size > 0").filter(count > 0)
        .select(
            "exporter", "recv_ts", "packet_no", "set_no", slots.alias("slots"),
            F.posexplode(
                F.transform(
                    F.sequence(F.lit(0), count - 1),
                    lambda i: F.substring(F.col("body"), i * F.col("record_size") + 1, F.col("record_size")),
                )
            ).alias("record_no", "r"),
        )
    )
    r = F.col("r")

    # One lambda each for the plain numbers and the four counters keeps the generated code small.
    plain = [
        "L4_SRC_PORT", "L4_DST_PORT", "PROTOCOL", "TCP_FLAGS", "SRC_VLAN", "DST_VLAN",
        "FLOW_END_MS", "FLOW_START_MS", "LAST_SWITCHED", "FIRST_SWITCHED",
    ]
    rows = rows.withColumn("_numbers", F.transform(F.array(*[F.col(f"slots.{n}") for n in plain]), lambda s: unsigned(r, s["pos"], s["len"])))

    def number(name: str) -> Column:
        return F.get("_numbers", plain.index(name))

    def address(name: str) -> Column:
        s = F.col(f"slots.{name}")
        raw = F.lower(F.hex(F.substring(r, s["pos"] + 1, s["len"])))
        return F.nullif(F.when(s["len"] == 4, dotted(r, s["pos"])).otherwise(raw), F.lit(""))

    def counted(name: str) -> Column:
        return F.coalesce(number(name), F.lit(0).cast("long"))

    totals = ["IN_PKTS", "IN_BYTES", "OUT_PKTS", "OUT_BYTES"]
    places = [F.col(f"slots.{name}") for name in totals]
    digits = F.array(*[F.hex(F.substring(r, s["pos"] + 1, s["len"])) for s in places])
    rows = rows.withColumn("_totals", F.transform(digits, wide_number))

    def total(name: str) -> Column:
        return F.coalesce(F.get("_totals", totals.index(name)), F.lit(0).cast("decimal(38,0)"))

    src_vlan, dst_vlan = counted("SRC_VLAN"), counted("DST_VLAN")
    duration = F.coalesce(
        number("FLOW_END_MS") - number("FLOW_START_MS"),
        number("LAST_SWITCHED") - number("FIRST_SWITCHED"),
        F.lit(0),
    ).cast("double")
    fields = {
        "src_ip": address("IPV4_SRC_ADDR"), "dst_ip": address("IPV4_DST_ADDR"),
        "src_port": counted("L4_SRC_PORT"), "dst_port": counted("L4_DST_PORT"),
        "pkts": total("IN_PKTS"), "octets": total("IN_BYTES"),
        "out_pkts": total("OUT_PKTS"), "out_octets": total("OUT_BYTES"),
        "duration_ms": duration, "proto": counted("PROTOCOL"), "tcp_flags": counted("TCP_FLAGS"),
        "vlan_id": F.when(src_vlan != 0, src_vlan).otherwise(dst_vlan),
        "src_vlan": src_vlan, "dst_vlan": dst_vlan,
    }
    return rows.select(
        "exporter", "recv_ts", "packet_no", "set_no", "record_no", *[fields[n].alias(n) for n in RECORD]
    ).filter(F.col("src_ip").isNotNull() & F.col("dst_ip").isNotNull())


def stored_versions(packets: DataFrame) -> DataFrame:
    """The template versions of v9 and IPFIX datagrams, stored in the shared folder."""
    # The walk's few rows are read several times.
    return store_versions(packets.sparkSession, cut_lineage(packets.sparkSession, split_sets(packets, "templates")))


def store_versions(spark: SparkSession, found: DataFrame) -> DataFrame:
    """``template_versions``, stored in the shared folder."""
    folder = fresh_folder(spark, "templates")
    versions = template_versions(found)
    versions.write.parquet(folder)
    return spark.read.schema(versions.schema).parquet(folder)


def decode_templated(packets: DataFrame) -> DataFrame:
    """v9 and IPFIX records; both share the templates of an exporter.

    A first walk over the datagrams finds the definitions; the second one decodes, and moves no body.
    """
    return decode_sets(attach_templates(split_sets(packets, "data"), stored_versions(packets)))


def decode(packets: DataFrame) -> DataFrame:
    """Records of all versions; datagrams of other versions give none."""
    return decode_v5(packets).unionByName(decode_templated(packets))


def flow_envelopes(records: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Feature columns plus addresses, resolved VLANs, direction and input path."""
    vlans = resolve_vlans("src_ip", "dst_ip", "vlan_id", "src_vlan", "dst_vlan")
    ready = records.withColumns(vlans).withColumns(
        {
            "protocol": F.col("proto").try_cast("int"),
            "flow_direction": flow_direction("src_ip", "dst_ip"),
            "input_path": F.lit("netflow"),
        }
    )
    return map_netflow(
        ready,
        (*keep, "src_ip", "dst_ip", "src_port", "dst_port", "protocol", "vlan_id", "src_vlan", "dst_vlan",
         "flow_direction", "input_path"),
    )
