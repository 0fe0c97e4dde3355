"""Helpers of the training-data operators: stored tables, Arrow texts, vectorised hashes."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from vigilflow.session import checkpoint_root

SPACES = r"[\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
ARROW_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
TEXT_ROWS = 1000


def _file_system(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


@contextmanager
def arrow_batches(spark: SparkSession, rows: int | None = None, size: int | None = None) -> Iterator[None]:
    """Bounds the Arrow batches of the jobs run inside to ``rows`` rows and about ``size`` bytes; a batch lies beside the heap of its executor."""
    before = {ARROW_ROWS: spark.conf.get(ARROW_ROWS)}
    now = {ARROW_ROWS: str(min(int(before[ARROW_ROWS]), rows or int(before[ARROW_ROWS])))}
    if size:
        before[ARROW_BYTES], now[ARROW_BYTES] = spark.conf.get(ARROW_BYTES), f"{size}b"
    try:
        for key, value in now.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def stored(df: DataFrame, label: str, batch_rows: int | None = None, batch_bytes: int | None = None) -> DataFrame:
    """``df`` written as Parquet to a fresh folder of the shared checkpoint folder, read again.

    Cuts the lineage: a lost executor costs the running stage only.  Shuffle files of the steps before
    can go, which a collection of the driver's garbage allows.  The folder goes by ``release`` or when the driver ends.
    ``batch_rows`` and ``batch_bytes`` bound the Arrow batches of this step where rows hold whole texts or more.
    """
    spark = df.sparkSession
    folder = f"{checkpoint_root(spark)}/llm-{uuid.uuid4().hex}/{label}"
    with arrow_batches(spark, batch_rows, batch_bytes):
        df.write.parquet(folder)
    files, path = _file_system(spark, folder)
    files.deleteOnExit(path.getParent())
    give_back()
    give_back_jvm(spark)
    out = spark.read.schema(df.schema).parquet(folder)
    out.stored_at = folder
    return out


def release(*frames: DataFrame) -> None:
    """Deletes the tables of frames from ``stored`` that no frame in use depends on any more."""
    for frame in frames:
        files, path = _file_system(frame.sparkSession, frame.stored_at)
        files.delete(path.getParent(), True)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, one after the other, and the n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def blocks(batches: Iterator[pa.RecordBatch], text: str, size: int = BLOCK_BYTES, rows: int = 4096) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in slices of about ``size`` bytes of text and about ``rows`` rows (one row at least)."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False) + size / rows
        cuts = np.flatnonzero(np.diff(np.cumsum(sizes) // size, prepend=0)) if len(sizes) else []
        start = 0
        for cut in [*cuts, len(sizes)]:
            if cut > start:
                yield batch.slice(start, cut - start)
                start = cut


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit values (finalizer of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(seed: int) -> np.ndarray:
    """256 unsigned 64-bit values, the same on all machines."""
    return mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


NO_SPACE = np.array([b != 32 and not 9 <= b <= 13 for b in range(256)])
ALNUM = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def word_spans(raw: np.ndarray, ends: np.ndarray, letters: np.ndarray = NO_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each word and the number of its text; ``letters`` says which bytes words have."""
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = letters[raw]
    first = np.zeros(len(raw) + 1, bool)
    first[ends] = True
    before = np.zeros_like(inside)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first))
    stops = np.flatnonzero(before & (~inside | first))
    return starts, stops, np.searchsorted(ends, starts, side="right") - 1


MULTIPLIER = np.uint64(0x9E3779B97F4A7C15 | 1)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int = 7) -> np.ndarray:
    """Rolling-hash values (64 bits) of byte spans, from running sums over ``raw``, taken block by block where it is long."""
    if len(raw) <= 2 * BLOCK_BYTES or len(starts) < 2:
        return _span_hashes(raw, starts, stops, seed)
    order = np.argsort(starts, kind="stable")
    out = np.empty(len(starts), np.uint64)
    for part in np.split(order, np.flatnonzero(np.diff(starts[order] // BLOCK_BYTES)) + 1):
        low, high = starts[part[0]], stops[part].max()
        out[part] = _span_hashes(raw[low:high], starts[part] - low, stops[part] - low, seed)
    return out


def _span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, seed: int) -> np.ndarray:
    n = len(raw)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(byte_table(seed)[raw] * powers(MULTIPLIER, n), out=total[1:])
    value = (total[stops] - total[starts]) * powers(INVERSE, n + 1)[starts]
    return mix(value ^ (stops - starts).astype(np.uint64))


def give_back() -> None:
    """Returns memory that a task has freed, as its worker process goes on with other tasks."""
    import ctypes

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back_jvm(spark: SparkSession) -> None:
    """Collects the garbage of the driver's JVM and returns native memory that it has freed, as a session goes on with other queries.

    Many steps leave free memory in its allocator, beside the heap.  JVMs without the command keep it.
    """
    jvm, new_array = spark._jvm, spark.sparkContext._gateway.new_array
    jvm.System.gc()
    invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    values = new_array(jvm.java.lang.Object, 4)
    values[0], values[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), values)
    except Py4JJavaError:
        pass


def giving_back(step: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``step`` over the Arrow batches of a task, with ``give_back`` once it has ended."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from step(batches)
        give_back()

    return run


def packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Integers as zstd of their byte planes; ``rising``: of the differences of sorted unsigned values.

    The planes of many values are blocks of their own in the frame: bytes of one plane are more alike than those of all.
    """
    import zstandard

    if rising:
        values = np.diff(values, prepend=values.dtype.type(0))
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    whole = zstandard.ZstdCompressor(level=1)
    if len(values) < 1024:
        return whole.compress(planes.tobytes())
    frame = whole.compressobj(size=planes.size)
    parts = [frame.compress(plane.tobytes()) + frame.flush(zstandard.COMPRESSOBJ_FLUSH_BLOCK) for plane in planes]
    return b"".join([*parts, frame.flush()])


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    width = np.dtype(kind).itemsize
    values = np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).ravel()
    return np.cumsum(values, dtype=kind) if rising else values


def order_of(values: np.ndarray) -> np.ndarray:
    """An order that sorts unsigned 64-bit hashes: their leading bits are sorted with the places in the low bits, which is
    several times faster than an argsort; the few runs of equal leading bits are put right afterwards."""
    n = len(values)
    low = np.uint64(max(1, n).bit_length())
    mixed = np.sort((values >> low << low) | np.arange(n, dtype=np.uint64))
    order = (mixed & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
    found = values[order]
    wrong = np.flatnonzero(found[1:] < found[:-1])
    if len(wrong):
        lead = mixed >> low
        starts, stops = np.searchsorted(lead, lead[wrong]), np.searchsorted(lead, lead[wrong], side="right")
        for a, b in dict(zip(starts.tolist(), stops.tolist())).items():
            order[a:b] = order[a:b][np.argsort(found[a:b], kind="stable")]
    return order


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different hashes, sorted, and the place of each value among them."""
    order = order_of(values)
    found = values[order]
    new = np.append(True, found[1:] != found[:-1])[: len(found)]
    places = np.empty(len(values), np.int64)
    places[order] = np.cumsum(new) - 1
    return found[new], places
