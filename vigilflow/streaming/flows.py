"""Streaming packets-to-flows: keyed state with event-time timers, open flows included.

Packets that the watermark has passed are settled: they are folded, in time order, into the flow record of their key.
All conversations of a bucket are folded by one call, in arrays.
Those after it wait in a small buffer, as earlier ones may still come.  Every micro-batch gives the flows that ended for good
and, provisionally, the ones still open as they would be without further packets; ``current_flows`` shows
the newest state of both.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilflow.operators.flows import ACTIVE_SECONDS, FLAGS, IDLE_SECONDS, KEY
from vigilflow.streaming.live import BATCH_SECONDS, write_batch
from vigilflow.streaming.state import BUCKETS

SIDES = ("bidirectional", "src2dst", "dst2src")
ENDS = ("src_ip", "src_port", "dst_ip", "dst_port")


# Of the sizes and of the waits of a side: number, least, greatest, mean and squared distance from it.
STATS = ("n", "low", "high", "mean", "m2")


def _joined(a: dict, b: dict) -> dict:
    """The moments of two sets of values."""
    n = a["n"] + b["n"]
    step, share = b["mean"] - a["mean"], b["n"] / np.maximum(n, 1)
    return {
        "n": n,
        "low": np.where(a["n"] == 0, b["low"], np.where(b["n"] == 0, a["low"], np.minimum(a["low"], b["low"]))),
        "high": np.where(a["n"] == 0, b["high"], np.where(b["n"] == 0, a["high"], np.maximum(a["high"], b["high"]))),
        "mean": np.where(a["n"] == 0, b["mean"], a["mean"] + step * share),
        "m2": a["m2"] + b["m2"] + step * step * a["n"] * share,
    }


class Sides:
    """Running records of many flows, one array per measure; of both directions and of either."""

    def __init__(self, arrays: dict[str, np.ndarray], flags: int):
        self.arrays, self._flags = arrays, flags

    @staticmethod
    def names(flags: int) -> dict[str, str]:
        """Measures of a flow and their types."""
        whole = ["packets", "first", "last", "bytes", *(f"flag{i}" for i in range(flags)), "ps_n", "wait_n"]
        real = [f"{unit}_{stat}" for unit in ("ps", "wait") for stat in STATS[1:]]
        return {f"{side}_{name}": kind for side in SIDES for names, kind in ((whole, "int64"), (real, "float64")) for name in names}

    @classmethod
    def none(cls, size: int, flags: int) -> Sides:
        return cls({name: np.zeros(size, kind) for name, kind in cls.names(flags).items()}, flags)

    @classmethod
    def of(cls, size: int, flow: np.ndarray, forward: np.ndarray, at: np.ndarray, sizes: np.ndarray, flags: np.ndarray) -> Sides:
        """Records of packets; those of a flow are neighbours, in time order."""
        out = cls.none(size, flags.shape[1])
        for side, mine in zip(SIDES, (np.ones(len(flow), bool), forward, ~forward)):
            if not mine.any():
                continue
            group, t, value, flag = flow[mine], at[mine], sizes[mine], flags[mine]
            new = np.concatenate([[True], group[1:] != group[:-1]])
            begin = np.flatnonzero(new)
            place, count = np.cumsum(new) - 1, np.diff(np.append(begin, len(group)))
            there = ~np.isnan(value)
            value = np.where(there, value, 0)
            first, last = t[begin], t[begin + count - 1]
            total, known = np.add.reduceat(value, begin), np.add.reduceat(there.astype("int64"), begin)
            mean = total / np.maximum(known, 1)
            waits = np.where(new, 0, np.diff(t, prepend=t[0]) / 1000.0)
            wait = (last - first) / 1000.0 / np.maximum(count - 1, 1)
            found = {
                "packets": count, "first": first, "last": last, "bytes": np.add.reduceat(value.astype("int64"), begin), "ps_n": known, "ps_mean": mean,
                "ps_low": np.minimum.reduceat(np.where(there, value, np.inf), begin), "ps_high": np.maximum.reduceat(np.where(there, value, -np.inf), begin),
                "ps_m2": np.add.reduceat(np.where(there, (value - mean[place]) ** 2, 0), begin),
                "wait_n": count - 1, "wait_mean": wait, "wait_low": np.minimum.reduceat(np.where(new, np.inf, waits), begin),
                "wait_high": np.maximum.reduceat(np.where(new, -np.inf, waits), begin), "wait_m2": np.add.reduceat(np.where(new, 0, (waits - wait[place]) ** 2), begin),
                **{f"flag{i}": np.add.reduceat(flag[:, i], begin) for i in range(flags.shape[1])},
            }
            for unit in ("ps", "wait"):
                for name in ("low", "high"):
                    found[f"{unit}_{name}"] = np.where(found[f"{unit}_n"] > 0, found[f"{unit}_{name}"], 0.0)
            for name, values in found.items():
                out.arrays[f"{side}_{name}"][group[begin]] = values
        return out

    def then(self, later: Sides) -> Sides:
        """The flows with the packets that came after."""
        out = {}
        for side in SIDES:
            a, b = ({n.removeprefix(f"{side}_"): v for n, v in x.arrays.items() if n.startswith(f"{side}_")} for x in (self, later))
            both, any_a = (a["packets"] > 0) & (b["packets"] > 0), a["packets"] > 0
            gap = np.where(both, (b["first"] - a["last"]) / 1000.0, 0.0)
            between = {"n": both.astype("int64"), "low": gap, "high": gap, "mean": gap, "m2": np.zeros(len(gap))}
            of = lambda x, unit: {stat: x[f"{unit}_{stat}"] for stat in STATS}
            found = {f"ps_{k}": v for k, v in _joined(of(a, "ps"), of(b, "ps")).items()}
            found |= {f"wait_{k}": v for k, v in _joined(_joined(of(a, "wait"), between), of(b, "wait")).items()}
            found |= {n: a[n] + b[n] for n in ("packets", "bytes", *(f"flag{i}" for i in range(self._flags)))}
            found |= {"first": np.where(any_a, a["first"], b["first"]), "last": np.where(b["packets"] > 0, b["last"], a["last"])}
            out |= {f"{side}_{n}": v for n, v in found.items()}
        return Sides(out, self._flags)

    def chosen(self, which: np.ndarray) -> Sides:
        return Sides({n: v[which] for n, v in self.arrays.items()}, self._flags)

    def shown(self) -> list[np.ndarray]:
        """Of each side packets, bytes, duration, then least, greatest, mean and deviation of sizes and waits (0 where there are none), flags."""
        out = []
        for side in SIDES:
            v = {n.removeprefix(f"{side}_"): x for n, x in self.arrays.items() if n.startswith(f"{side}_")}
            lasted = (v["last"] - v["first"]) / 1000.0
            means = {"ps": v["bytes"] / np.maximum(v["ps_n"], 1), "wait": lasted / np.maximum(v["wait_n"], 1)}
            out += [v["packets"], v["bytes"], lasted]
            for unit, mean in means.items():
                spread = np.where(v[f"{unit}_n"] > 1, np.sqrt(v[f"{unit}_m2"] / np.maximum(v[f"{unit}_n"] - 1, 1)), 0.0)
                out += [v[f"{unit}_low"], v[f"{unit}_high"], mean, spread]
            out += [v[f"flag{i}"] for i in range(self._flags)]
        return out


def _pack(table: pd.DataFrame) -> bytes:
    if table.empty:
        return b""
    rows, sink = pa.Table.from_pandas(table, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


class _Flows(StatefulProcessor):
    """Open flows and waiting packets of the conversations of a bucket, in two tables.

    Packets are rows (key_, src_, dst_, at_us, tie_, bytes, flags); an open flow has the key, start and ends of its first
    packet and its running record.  Only conversations with new packets, or with something due, are looked at.
    """

    def __init__(self, idle: int, active: int, columns: list[str], names: list[str]):
        self._idle, self._active, self._columns, self._names = idle, active, columns, names
        self._flags = columns[6:]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        fields = [T.StructField("flows", T.BinaryType()), T.StructField("waiting", T.BinaryType())]
        self._state = handle.getValueState("flows", T.StructType(fields))

    def _starts(self, code: np.ndarray, at: np.ndarray, seed_last: np.ndarray, seed_start: np.ndarray) -> np.ndarray:
        """Which packets, in order by conversation and time, begin a flow; ``seed_last`` is -1 where none is open."""
        new = np.concatenate([[True], code[1:] != code[:-1]])
        before = np.where(new, seed_last[code], np.concatenate([[0], at[:-1]]))
        cut = np.where(new & (before < 0), True, at - before > self._idle)
        # Within a run without gaps a flow ends by age.
        runs = np.flatnonzero(new | cut)
        ends = np.append(runs[1:], len(at))
        origin = np.where(cut[runs], at[runs], seed_start[code[runs]])
        aged = at[ends - 1] > origin + self._active
        if aged.any():
            times = at.tolist()
            for low, high, start in zip(runs[aged].tolist(), ends[aged].tolist(), origin[aged].tolist()):
                while (low := bisect_right(times, start + self._active, low, high)) < high:
                    cut[low], start = True, times[low]
        return cut

    def _advance(self, mark_ms: int, new: pd.DataFrame) -> Iterator[pd.DataFrame]:
        mark, flags = mark_ms * 1000, len(self._flags)
        measures = Sides.names(flags)
        tables = [bytes(x) for x in self._state.get()] if self._state.exists() else [b"", b""]
        flows, waiting = (pa.ipc.open_stream(x).read_all().to_pandas() if x else None for x in tables)
        if flows is None:
            flows = pd.DataFrame({n: np.empty(0, k) for n, k in {"key_": object, "src_": object, "dst_": object, "start": "int64", **measures}.items()})
        packets = new if waiting is None else pd.concat([waiting, new], ignore_index=True) if len(new) else waiting
        keys = pd.concat([flows["key_"], packets["key_"]], ignore_index=True).astype(object)
        code, keys = pd.factorize(keys, use_na_sentinel=False)
        flow_code, code = code[: len(flows)], code[len(flows) :]
        touched, at = np.zeros(len(keys), bool), packets["at_us"].to_numpy("int64")
        touched[code[len(packets) - len(new) :]] = True
        touched[code[at // 1000 + 1 <= mark_ms]] = True
        ends = np.minimum(flows["bidirectional_last"].to_numpy() + self._idle, flows["start"].to_numpy() + self._active)
        touched[flow_code[ends // 1000 + 1 <= mark_ms]] = True

        rest_flows, rest = flows[~touched[flow_code]], packets[~touched[code]]
        flows, flow_code = flows[touched[flow_code]].reset_index(drop=True), flow_code[touched[flow_code]]
        packets = packets[touched[code]].assign(_code=code[touched[code]]).sort_values(["_code", "at_us", "tie_"], kind="stable", ignore_index=True)
        code, at = packets["_code"].to_numpy(), packets["at_us"].to_numpy("int64")
        packets = packets.drop(columns="_code")

        seed, last, start = np.full(len(keys), -1), np.full(len(keys), -1, "int64"), np.zeros(len(keys), "int64")
        seed[flow_code], last[flow_code], start[flow_code] = np.arange(len(flows)), flows["bidirectional_last"], flows["start"]
        cut = self._starts(code, at, last, start) if len(at) else np.zeros(0, bool)
        # Numbers of flows: the open ones, then those that begin here.
        count = np.cumsum(cut)
        begun = np.flatnonzero(cut)
        place = np.searchsorted(code, np.arange(len(keys)))
        opened = (count - cut)[np.minimum(place, len(at) - 1)][code] if len(at) else count
        flow = np.where(count == opened, seed[code], len(flows) + count - 1)
        size = len(flows) + len(begun)
        head = lambda name: np.concatenate([flows[name].to_numpy(object), packets[name].to_numpy(object)[begun]])
        key, src, dst = keys[np.concatenate([flow_code, code[begun]])] if size else [], head("src_"), head("dst_")
        start = np.concatenate([flows["start"].to_numpy("int64"), at[begun]])
        side = pd.factorize(np.concatenate([src, packets["src_"].to_numpy(object)]))[0]
        forward = side[size:] == side[:size][flow] if len(at) else np.zeros(0, bool)
        sizes, marks = packets["bytes"].to_numpy("float64"), packets[self._flags].fillna(0).to_numpy("int64").reshape(len(at), flags)

        settled = at <= mark
        record = Sides.none(size, flags)
        for name, values in record.arrays.items():
            values[: len(flows)] = flows[name]
        part = lambda which: Sides.of(size, flow[which], forward[which], at[which], sizes[which], marks[which])
        record, later = record.then(part(settled)), part(~settled)
        # Whatever comes next is later than the watermark, so beyond either timeout.
        ended = (later.arrays["bidirectional_packets"] == 0) & (mark >= np.minimum(record.arrays["bidirectional_last"] + self._idle, start + self._active))
        shown = record.then(later)

        still = ~ended & (record.arrays["bidirectional_packets"] > 0)
        kept = pd.DataFrame({"key_": np.asarray(key, object)[still], "src_": src[still], "dst_": dst[still], "start": start[still], **record.chosen(still).arrays})
        flows = pd.concat([x for x in (rest_flows, kept) if len(x)], ignore_index=True) if len(rest_flows) or len(kept) else kept
        packets = packets[~settled]
        packets = pd.concat([x for x in (rest, packets) if len(x)], ignore_index=True) if len(rest) or len(packets) else packets
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if len(flows) or len(packets):
            self._state.update((_pack(flows), _pack(packets)))
            due = [np.minimum(flows["bidirectional_last"] + self._idle, flows["start"] + self._active).min()] if len(flows) else []
            due += [packets["at_us"].min()] if len(packets) else []
            self._handle.registerTimer(int(min(due)) // 1000 + 1)
        else:
            self._state.clear()
        if size:
            yield pd.DataFrame(dict(zip(self._names, [key, start, src, dst, *shown.shown(), ended])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        chunks = [chunk[self._columns] for chunk in rows if len(chunk)]
        if not chunks:
            return
        new = pd.concat(chunks, ignore_index=True)
        if new["at_us"].isna().any():
            raise ValueError("a packet has no time")
        yield from self._advance(timerValues.getCurrentWatermarkInMs(), new)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        none = pd.DataFrame({c: np.empty(0, object if c in ("key_", "src_", "dst_") else "float64") for c in self._columns})
        yield from self._advance(timerValues.getCurrentWatermarkInMs(), none)

    def close(self) -> None:
        pass


def _end_text(end: str) -> Column:
    """Port and address of an end as one text that keeps nulls."""
    port, ip = (F.col(f"{end}_{x}").cast("string") for x in ("port", "ip"))
    return F.concat(F.coalesce(port, F.lit("")), F.lit("|"), F.coalesce(F.concat(F.lit("="), ip), F.lit("")))


def live_flows(
    packets: DataFrame, keys: Sequence[str] = KEY, at: str = "ts", tie: str = "packet_id",
    idle: float = IDLE_SECONDS, active: float = ACTIVE_SECONDS, buckets: int = BUCKETS,
) -> DataFrame:
    """Flow records of a packet stream with a watermark on ``at``: ended ones (``closed``) and those still open.

    Columns as ``aggregate_flows`` gives them.  A gap of more than ``idle`` seconds ends a flow, and so does a packet
    more than ``active`` seconds after its start.  Rows at or before the watermark are late; Spark drops them.
    ``packets`` has the direction-free key of ``bidirectional_key``, or other ``keys``, a unique
    ``tie``, and may have TCP flags (0/1).  Null sizes count as no bytes, null flags as 0.
    """
    flags = [f for f in FLAGS if f in packets.columns]
    columns = ["key_", "src_", "dst_", "at_us", "tie_", "bytes", *flags]
    # Within the operator a key is its text: exact also where some are null.
    alone = len(keys) == 1
    text = F.col(keys[0]).cast("string") if alone else F.to_json(F.struct(*keys))
    timed = packets.withColumns({"key_": text, "src_": _end_text("src"), "dst_": _end_text("dst"), "at_us": F.unix_micros(at), "tie_": F.col(tie)})
    timed = timed.withColumn("bucket_", F.pmod(F.xxhash64("key_"), F.lit(buckets)).cast("int"))
    schema = T.StructType().add("key_", "string").add("flow_start", "long").add("src_", "string").add("dst_", "string")
    for side in SIDES:
        schema.add(f"{side}_packets", "long").add(f"{side}_bytes", "long").add(f"{side}_duration_ms", "double")
        for unit in ("ps", "piat_ms"):
            for stat in ("min", "max", "mean", "stddev"):
                schema.add(f"{side}_{stat}_{unit}", "double")
        for flag in flags:
            schema.add(f"{side}_{flag}_packets", "long")
    schema.add("closed", "boolean")
    processor = _Flows(round(idle * 1e6), round(active * 1e6), columns, schema.names)
    # The watermarked column itself travels with the rows; timers go by it.
    needed = timed.select(*dict.fromkeys(["bucket_", *columns, at]))
    rows = needed.groupBy("bucket_").transformWithStateInPandas(processor, schema, "Update", "EventTime")
    if alone:
        shown = [F.col("key_").cast(timed.schema[keys[0]].dataType).alias(keys[0])]
    else:
        rows = rows.withColumn("key_", F.from_json("key_", T.StructType([timed.schema[k] for k in keys])))
        shown = [F.col(f"key_.{k}").alias(k) for k in keys]
    ends = {}
    for end in ("src", "dst"):
        place, packed = F.locate("|", f"{end}_"), F.col(f"{end}_")
        ip = F.substring(packed, place + 2, F.length(packed))
        ends |= {f"{end}_ip": F.when(F.length(packed) > place, ip), f"{end}_port": F.nullif(F.substring(packed, F.lit(1), place - 1), F.lit(""))}
    shown_ends = [ends[e].cast(timed.schema[e].dataType).alias(e) for e in ENDS]
    return rows.select(*shown, "flow_start", *shown_ends, *schema.names[4:])


def follow_flows(flows: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store the flows each micro-batch ended or changed, by batch, so that a replay replaces them."""

    def each(batch: DataFrame, batch_id: int) -> None:
        write_batch(batch, path, batch_id)

    writer = flows.writeStream.outputMode("update").foreachBatch(each).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": f"{BATCH_SECONDS} seconds"}
    return writer.trigger(**trigger).start()


def current_flows(spark: SparkSession, path: str, keys: Sequence[str] = KEY) -> DataFrame:
    """All ended flows, and those open after the last micro-batch that changed their key.

    One aggregation per key and start: an ended flow replaces its provisional forms; a provisional one that a
    later batch of its key does not repeat has been merged into another.
    """
    rows = spark.read.parquet(path)
    measures = [c for c in rows.columns if c not in {*keys, "flow_start", "batch_id", "closed"}]
    newest = rows.groupBy(*keys, "flow_start").agg(
        F.max_by(F.struct(*measures, "closed", "batch_id"), F.struct("closed", "batch_id")).alias("_f")
    )
    changed = rows.groupBy(*keys).agg(F.max("batch_id").alias("_last"))
    renamed = changed.select(*(F.col(k).alias(f"_{k}") for k in keys), "_last")
    joined = newest.join(renamed, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys])
    kept = joined.where(F.col("_f.closed") | (F.col("_f.batch_id") == F.col("_last")))
    return kept.select(*keys, "flow_start", *(F.col(f"_f.{c}").alias(c) for c in measures), F.col("_f.closed").alias("closed"))
