"""Custom keyed state: repeat suppression, late truth, template cache.

Within a micro-batch the rows of a key come in no order, so they are put in time
order first; a micro-batch is bounded by its trigger.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from vigilflow.session import cut_lineage
from vigilflow.streaming.live import exists, start, write_batch

# A call into Python costs milliseconds, so it serves a bucket of keys; slots bound what a call rewrites.
BUCKETS, SLOTS = 256, 16
NEVER = np.iinfo("int64").max
# Times of datagrams without one, and of definitions known before a micro-batch.
NO_TIME, KNOWN = "TIMESTAMP '2262-01-01'", "TIMESTAMP '0001-01-01'"
SEEN = pa.schema([("id", pa.string()), ("attack_type", pa.string()), ("version", pa.int64()), ("expires", pa.int64())])


def _in_order(rows: Iterator[pd.DataFrame], order: list[str]) -> pd.DataFrame:
    """Rows of one key and micro-batch in time order (a timer-only call brings none)."""
    chunks = [chunk for chunk in rows if len(chunk)]
    if not chunks:
        return pd.DataFrame(columns=order)
    return pd.concat(chunks).sort_values(order, kind="stable")


class _Suppress(StatefulProcessor):
    """Last fired time per key; forgotten when the watermark has passed its block."""

    def __init__(self, seconds: int, names: list[str]):
        self._ttl = seconds * 1_000_000
        self._names = names

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", T.StructType([T.StructField("at", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_us", "id"])
        if batch.empty:
            return
        last = int(self._last.get()[0]) if self._last.exists() else None
        chosen = []
        for place, at in enumerate(batch["at_us"].tolist()):
            if last is None or at > last + self._ttl:
                chosen.append(place)
                last = at
        if chosen:
            self._last.update((last,))
            for timer in list(self._handle.listTimers()):
                self._handle.deleteTimer(timer)
            self._handle.registerTimer((last + self._ttl) // 1000 + 1)
        yield batch.iloc[chosen][self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._last.clear()
        return iter([])

    def close(self) -> None:
        pass


def suppress_repeats(stream: DataFrame, seconds: int = 300, keys: tuple[str, ...] = ("src_ip", "group_pred")) -> DataFrame:
    """First event per key, then none until strictly more than ``seconds`` later.

    The stream has ``id`` and a watermarked ``created_at``.  An event fires by event
    time; late rows beyond the watermark are dropped by Spark.
    """
    timed = stream.withColumn("at_us", F.unix_micros("created_at"))
    fields = [f for f in timed.schema.fields if f.name in (*keys, "id", "at_us")]
    schema = T.StructType(fields)
    processor = _Suppress(seconds, schema.names)
    fired = timed.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return fired.withColumn("created_at", F.timestamp_micros("at_us")).drop("at_us")


class _LateTruth(StatefulProcessor):
    """Emit an id once, and again only when a truth arrives for it; one call for all ids of a bucket.

    The ids of a bucket lie in slots, each one a table (id, attack_type, version, time to forget it).  Only slots
    that a micro-batch has ids of, or whose ids are due, are read and written.
    """

    def __init__(self, names: list[str], keep_ms: int):
        self._names, self._keep = names, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        table = T.StructType([T.StructField("table", T.BinaryType())])
        self._seen = handle.getMapState("seen", T.StructType([T.StructField("slot", T.IntegerType())]), table)
        self._due = handle.getValueState("due", table)

    def _read(self, slots: list[int]) -> pd.DataFrame:
        """The ids of stored slots."""
        tables = [pa.ipc.open_stream(bytes(self._seen.getValue((slot,))[0])).read_all() for slot in slots]
        places = np.repeat(slots, [t.num_rows for t in tables]).astype("int64")
        return pa.concat_tables(tables or [SEEN.empty_table()]).to_pandas().assign(slot=places)

    def _write(self, slot: int, table: pd.DataFrame) -> int:
        """Store a slot; gives the time at which the first of its ids is forgotten."""
        if table.empty:
            self._seen.removeKey((slot,))
            return NEVER
        rows, sink = pa.Table.from_pandas(table[["id", "attack_type", "version", "expires"]], SEEN, preserve_index=False), pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, SEEN) as out:
            out.write_table(rows)
        self._seen.updateValue((slot,), (sink.getvalue().to_pybytes(),))
        return int(table["expires"].min())

    def _set_due(self, due: np.ndarray) -> None:
        for timer in list(self._handle.listTimers()):
            self._handle.deleteTimer(timer)
        if (due < NEVER).any():
            self._due.update((due.tobytes(),))
            self._handle.registerTimer(int(due.min()))
        else:
            self._due.clear()

    def _get_due(self) -> np.ndarray:
        """When the first id of each slot is forgotten; a slot that is not stored never has one."""
        return np.frombuffer(bytes(self._due.get()[0]), "int64").copy() if self._due.exists() else np.full(SLOTS, NEVER)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = _in_order(rows, ["at_us"]).reset_index(drop=True)
        if batch.empty:
            return
        due, slots = self._get_due(), batch["slot"].to_numpy("int64")
        known = self._read([slot for slot in np.unique(slots).tolist() if due[slot] < NEVER])
        # Ids of the state and of the batch by common numbers.
        number, ids = pd.factorize(pd.concat([known["id"], batch["id"]], ignore_index=True).astype(object), use_na_sentinel=False)
        was, now = number[: len(known)], number[len(known) :]
        kind, place = np.full(len(ids), None, object), np.zeros(len(ids), "int64")
        version, expires = np.full(len(ids), -1, "int64"), np.zeros(len(ids), "int64")
        kind[was], version[was], expires[was], place[was] = known["attack_type"], known["version"], known["expires"], known["slot"]
        first = ~pd.Series(now).duplicated().to_numpy() & (version[now] < 0)
        truth = batch["ground_truth"].notna().to_numpy() & ~first
        fresh, since = now[first], batch["since_us"].to_numpy("int64")[first]
        kind[fresh], place[fresh], expires[fresh], version[fresh] = batch["attack_type"].to_numpy(object)[first], slots[first], since // 1000 + self._keep, 0
        shown = first | truth
        versions = np.where(truth, version[now] + pd.Series(truth).groupby(now).cumsum().to_numpy(), 0)
        np.maximum.at(version, now[shown], versions[shown])
        state = pd.DataFrame({"id": ids, "attack_type": kind, "version": version, "expires": expires})
        changed = np.unique(slots[shown])
        for slot in changed.tolist():
            due[slot] = self._write(slot, state[place == slot])
        if len(changed):
            self._set_due(due)
        yield batch.assign(attack_type=kind[now], version=versions)[shown][self._names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        due, mark = self._get_due(), timerValues.getCurrentWatermarkInMs()
        for slot in np.flatnonzero(due <= mark).tolist():
            table = self._read([slot])
            due[slot] = self._write(slot, table[table["expires"] > mark])
        self._set_due(due)
        return iter([])

    def close(self) -> None:
        pass


def merge_late_truth(stream: DataFrame, keep_hours: int = 24, buckets: int = BUCKETS) -> DataFrame:
    """Deduplicated results plus a newer version whenever a ground truth comes in.

    Input: id, attack_type, ground_truth, watermarked created_at.  Versions of an id count
    its rows as they come in, whatever their event times; the highest is the current row.
    Ids meet their state by ``buckets``, which is fixed for the life of a checkpoint.
    """
    timed = stream.select("id", "attack_type", "ground_truth", "created_at", F.unix_micros("created_at").alias("at_us"))
    kind = timed.schema["id"].dataType
    # An id without a time is kept from when it came in.
    timed = timed.withColumn("since_us", F.coalesce("at_us", F.unix_micros(F.current_timestamp())))
    # Within the operator an id is its text: exact also where some are null.
    timed = timed.withColumn("id", F.col("id").cast("string")).withColumn("_h", F.xxhash64("id"))
    timed = timed.withColumns({"bucket": F.pmod("_h", F.lit(buckets)).cast("int"), "slot": F.pmod(F.shiftright("_h", 32), F.lit(SLOTS)).cast("int")}).drop("_h")
    schema = T.StructType(
        [timed.schema["id"], timed.schema["attack_type"], timed.schema["ground_truth"], T.StructField("version", T.LongType())]
    )
    processor = _LateTruth(schema.names, keep_hours * 3_600_000)
    versions = timed.groupBy("bucket").transformWithStateInPandas(processor, schema, "Append", "EventTime")
    return versions.withColumn("id", F.col("id").cast(kind))


def follow_templated(packets: DataFrame, path: str, templates: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Store the records of streamed v9 and IPFIX datagrams, by batch, so that a replay replaces them.

    Input: exporter, recv_ts, packet_no, payload.  Within a micro-batch data sets meet the latest definition before them in
    time order (without a time: after all others), or else the one known from earlier micro-batches; those without any are dropped.
    ``templates`` keeps the newest definition of each (exporter, source id, template id), one snapshot per batch, so a
    replayed batch starts from the same one.  No body is gathered by exporter or kept as state.
    """
    from vigilflow.sources.netflow import ORDER, TEMPLATE, attach_templates, decode_sets, split_sets, store_versions

    def each(batch: DataFrame, batch_id: int) -> None:
        spark, before = batch.sparkSession, f"{templates}/batch={batch_id - 1}"
        rows = batch.withColumn("recv_ts", F.coalesce("recv_ts", F.expr(NO_TIME)))
        # The walk's few rows are read several times.
        found = cut_lineage(spark, split_sets(rows, "templates"))
        if exists(spark, before):
            known = spark.read.schema(found.select(*TEMPLATE, "layout", "record_size").schema).parquet(before)
            found = found.unionByName(known.withColumn("recv_ts", F.expr(KNOWN)), allowMissingColumns=True)
        records = decode_sets(attach_templates(split_sets(rows, "data"), store_versions(spark, found)))
        write_batch(records.withColumn("recv_ts", F.nullif("recv_ts", F.expr(NO_TIME))), path, batch_id)
        newest = F.max_by(F.struct("layout", "record_size"), F.struct(*ORDER)).alias("_t")
        kept = found.where(F.col("layout").isNotNull()).groupBy(*TEMPLATE).agg(newest).select(*TEMPLATE, "_t.*")
        kept.write.mode("overwrite").parquet(f"{templates}/batch={batch_id}")

    return start(packets, each, checkpoint, available_now)
