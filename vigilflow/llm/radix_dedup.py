"""Removal of repeated byte strings by a depth-limited, most-significant-digit-first sort of suffixes.

Only the first ``depth`` bytes of a suffix count.  Three digits, the most significant first, split the
suffixes into groups; a group of one leaves at once, so each pass works on what the last one left.

* First digit: the gram of ``GRAMS[0]`` bytes that has the smallest hash of all in the prefix, with its
  distance from the suffix's start.  Neighbouring suffixes share it, so one row (an anchor, one in fifty
  positions) stands for a run of them.  Anchors that also agree in all that their prefixes can reach
  are repeated as a whole and need no further digit; what stays open are the ends of repeated strings.
* Second digit: the same with longer grams, over the open prefixes alone.
* Third digit: the rest of the ``depth`` bytes, suffix by suffix.  Equal groups are exactly the repeated strings.

Digits are compared by 64-bit hashes, two of them together from the second on.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import INVERSE, MULTIPLIER, blocks, byte_table, mix, powers, release, stored, utf8

DEPTH = 200
GRAMS = (100, 184)


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """``pick`` (minimum or maximum) over all windows of ``width`` values, by doubling."""
    out, reach = values, 1
    while 2 * reach <= width:
        out = pick(out[:-reach], out[reach:])
        reach *= 2
    return pick(out[: len(out) - (width - reach)], out[width - reach :]) if reach < width else out


class Hashes:
    """Rolling hashes of all byte strings of ``raw``."""

    def __init__(self, raw: np.ndarray):
        n = len(raw)
        self.total = np.zeros(n + 1, np.uint64)
        np.cumsum(byte_table(3)[raw] * powers(MULTIPLIER, n), out=self.total[1:])
        self.inverse = powers(INVERSE, n + 1)

    def grams(self, width: int) -> np.ndarray:
        return mix((self.total[width:] - self.total[:-width]) * self.inverse[: len(self.total) - width])

    def spans(self, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
        return mix((self.total[stops] - self.total[starts]) * self.inverse[starts] + (stops - starts).astype(np.uint64))


def anchors(
    hashes: Hashes, ends: np.ndarray, depth: int, gram: int, wanted: np.ndarray | None = None
) -> tuple[np.ndarray, ...]:
    """(position, text number, gram hash, context hash) of each anchor in texts end to end.

    ``wanted`` marks the prefixes to find anchors of (default: all that end within their text).  The context is
    all that prefixes around the anchor can reach, cut at the ends of the text.
    """
    size, width = len(hashes.total) - 1, depth - gram + 1
    if size < depth:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    grams = hashes.grams(gram)
    least = np.where(whole(ends, depth) if wanted is None else wanted, _slide(grams, width, np.minimum), np.uint64(0))
    padded = np.zeros(len(grams) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero(_slide(padded, width, np.maximum) == grams)
    text = np.searchsorted(ends, at, side="right") - 1
    left, right = np.maximum(ends[text], at - width + 1), np.minimum(ends[text + 1], at + depth)
    cut = mix((at - left).astype(np.uint64) * np.uint64(1 << 32) + (right - at).astype(np.uint64))
    return at, text, grams[at], hashes.spans(left, right) ^ cut


def whole(ends: np.ndarray, depth: int) -> np.ndarray:
    """Whether the prefix of ``depth`` bytes at each position ends within its text."""
    size = ends[-1]
    stop = np.repeat(ends[1:], np.diff(ends))[: size - depth + 1]
    return stop - np.arange(size - depth + 1) >= depth


def owned(hashes: Hashes, ends: np.ndarray, depth: int, gram: int, at: np.ndarray) -> np.ndarray:
    """Marks the prefixes whose first digit is the gram at one of the positions ``at``."""
    width = depth - gram + 1
    grams = hashes.grams(gram)
    least = _slide(grams, width, np.minimum)
    out = np.zeros(len(least), bool)
    starts = (at[:, None] - np.arange(width)[None, :]).ravel()
    own = np.repeat(grams[at], width)
    fits = (starts >= 0) & (starts < len(least))
    starts, own = starts[fits], own[fits]
    out[starts[least[starts] == own]] = True
    return out & whole(ends, depth)


def _signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


def first_digits(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """(key, _h, _at, _gram, _context) of the anchors of all texts."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            raw, ends = utf8(batch.column(text))
            at, row, gram, context = anchors(Hashes(raw), ends, depth, GRAMS[0])
            rows = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(rows), batch.column("_h").take(rows), pa.array(at - ends[row]), _signed(gram), _signed(context)],
                [key, "_h", "_at", "_gram", "_context"],
            )

    return docs.mapInArrow(run, f"`{key}` {kind}, _h long, _at long, _gram long, _context long")


def second_digits(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """The same for texts with a list ``_open`` of anchor positions, over the prefixes of these anchors.

    ``_left`` and ``_right`` hold the bytes of the context before and after the gram.
    """
    kind = docs.schema[key].dataType.simpleString()
    gram = GRAMS[1]
    reach = depth - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            raw, ends = utf8(batch.column(text))
            hashes = Hashes(raw)
            lists = batch.column("_open")
            at = lists.flatten().to_numpy() + np.repeat(ends[:-1], np.diff(lists.offsets.to_numpy()))
            wanted = owned(hashes, ends, depth, GRAMS[0], at)
            at, row, grams, context = anchors(hashes, ends, depth, gram, wanted)
            rows, data = pa.array(row), raw.tobytes()
            left = [data[a:b] for a, b in zip(np.maximum(ends[row], at - reach).tolist(), at.tolist())]
            right = [data[a:b] for a, b in zip((at + gram).tolist(), np.minimum(ends[row + 1], at + depth).tolist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(key).take(rows), batch.column("_h").take(rows), pa.array(at - ends[row]), _signed(grams),
                    _signed(context), pa.array(left, pa.binary()), pa.array(right, pa.binary()),
                ],
                [key, "_h", "_at", "_gram", "_context", "_left", "_right"],
            )

    schema = f"`{key}` {kind}, _h long, _at long, _gram long, _context long, _left binary, _right binary"
    return docs.mapInArrow(run, schema)


def radix_pass(rows: DataFrame, label: str) -> tuple[DataFrame, DataFrame]:
    """Splits anchors (stored, released here) by gram and context: those repeated with their context, and one row per
    context that stays open.

    Counts are combined on the map side; the joins are ones that AQE splits where a digit is hot.  A gram with one
    context only is settled; one where all contexts are repeated as well.
    """
    names = [c for c in rows.columns if c not in ("_gram", "_context")]
    counts = rows.groupBy("_gram").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_gram")
    counts = stored(counts, f"{label}-grams")  # stored keys let AQE split the rows of a hot one
    shared = stored(rows.join(counts.hint("merge"), "_gram", "left_semi"), f"{label}-shared")
    release(rows, counts)
    contexts = shared.groupBy("_gram", "_context").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*names)).alias("_one"))
    contexts = stored(contexts, f"{label}-contexts")
    names = [c for c in names if c not in ("_left", "_right")]
    known = contexts.where("_n > 1").select("_gram", "_context")
    settled = shared.join(known.hint("merge"), ["_gram", "_context"], "left_semi").select(*names)
    settled = stored(settled, f"{label}-settled")
    split = contexts.groupBy("_gram").agg(F.count(F.lit(1)).alias("_c"), F.min("_n").alias("_m")).where("_c > 1 and _m = 1")
    split = stored(split.select("_gram"), f"{label}-split")
    still = contexts.join(split.hint("merge"), "_gram", "left_semi").select("_gram", "_one.*")
    still = stored(still, f"{label}-open")
    release(shared, contexts, split)
    return settled, still


def _span(key: str, start: Column, stop: Column) -> list[Column]:
    return [F.col(key), F.col("_h"), start.alias("start"), stop.alias("stop")]


def repeated_spans(docs: DataFrame, key: str, text: str, depth: int) -> DataFrame:
    """(key, _h, start, stop), stored: byte spans that cover exactly the repeated strings; they may overlap and pass the ends."""
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    texts = texts.select("*", F.xxhash64("_text").alias("_h"))
    long = texts.where(F.octet_length("_text") >= depth)
    settled, still = radix_pass(stored(first_digits(long, key, "_text", depth), "first"), "first")
    done = [settled]
    spans = settled.select(*_span(key, F.col("_at") - (depth - GRAMS[0]), F.col("_at") + depth))

    # The open anchors of a text in one list, next to the text.
    lists = still.groupBy(F.col(key).alias("_key"), F.col("_h").alias("_hash")).agg(F.collect_list("_at").alias("_open"))
    both = long.join(lists.hint("merge"), F.col(key).eqNullSafe(F.col("_key")) & (F.col("_h") == F.col("_hash")))
    second = stored(second_digits(both.select(key, "_h", "_text", "_open"), key, "_text", depth), "second")
    release(still)
    settled, still = radix_pass(second, "second")
    done.append(settled)
    reach = depth - GRAMS[1]
    spans = spans.unionByName(settled.select(*_span(key, F.col("_at") - reach, F.col("_at") + depth)))

    # Last digit: each open prefix through ``depth`` bytes, as gram, bytes before and bytes after it.
    before, after = F.col("_o"), F.lit(reach) - F.col("_o")
    prefixes = still.select("*", F.explode(F.sequence(F.lit(0), F.lit(reach))).alias("_o"))
    prefixes = prefixes.where((F.octet_length("_left") >= before) & (F.octet_length("_right") >= after))
    parts = [F.col("_gram"), before, F.substring("_left", F.octet_length("_left") - before + 1, before), F.substring("_right", F.lit(1), after)]
    prefixes = stored(prefixes.select(key, "_h", "_at", "_o", *(F.xxhash64(F.lit(s), *parts).alias(n) for s, n in ((1, "_a"), (2, "_b")))), "third")
    release(still)
    equal = stored(prefixes.groupBy("_a", "_b").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_a", "_b"), "equal")
    repeated = prefixes.join(equal.hint("merge"), ["_a", "_b"], "left_semi")
    ends = repeated.groupBy(key, "_h", "_at").agg(F.min("_o").alias("_least"), F.max("_o").alias("_most"))
    last = ends.select(*_span(key, F.col("_at") - F.col("_most"), F.col("_at") - F.col("_least") + depth))
    spans = stored(spans.unionByName(last), "spans")
    release(*done, prefixes, equal)
    return spans


def merged(spans: list[dict], size: int) -> list[tuple[int, int]]:
    """Maximal runs covered by ``spans`` within [0, size)."""
    out: list[tuple[int, int]] = []
    for start, stop in sorted((max(0, s["start"]), min(size, s["stop"])) for s in spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], stop))
        else:
            out.append((start, stop))
    return out


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", depth: int = DEPTH, kept: bool = False) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_removed, n_spans, kept_sha256, and the bytes kept if ``kept``.

    Every byte goes that a string of ``depth`` bytes covers which also starts anywhere else, in the same text or another,
    overlapping or not, judged on the input.  Texts are their UTF-8 bytes (null: empty); strings never cross texts.  Rows
    equal in key and text are copies of one another.  The first spans of a text are merged in its own row, so memory
    holds one text and its spans.
    """
    if depth <= GRAMS[1]:
        raise ValueError(f"depth must be over {GRAMS[1]}")
    kind = docs.schema[key].dataType.simpleString()
    spans = repeated_spans(docs, key, text, depth)
    lists = spans.groupBy(F.col(key).alias("_key"), F.col("_h").alias("_hash")).agg(F.collect_list(F.struct("start", "stop")).alias("_spans"))
    texts = docs.select(F.col(key), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    same = F.col(key).eqNullSafe(F.col("_key")) & (F.xxhash64("_text") == F.col("_hash"))
    both = texts.join(lists.hint("merge"), same, "left").select(key, "_text", "_spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            rows = []
            for body, found in zip(batch.column("_text").cast(pa.binary()).to_pylist(), batch.column("_spans").to_pylist()):
                runs = merged(found or [], len(body))
                stays, at = [], 0
                for start, stop in runs:
                    stays.append(body[at:start])
                    at = stop
                rest = b"".join([*stays, body[at:]])
                rows.append((len(body), len(body) - len(rest), len(runs), hashlib.sha256(rest).hexdigest(), rest))
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            arrays = [pa.array(c, k) for c, k in zip(columns, kinds)][: 5 if kept else 4]
            yield pa.RecordBatch.from_arrays([batch.column(key), *arrays], [key, *NAMES[: 5 if kept else 4]])

    schema = f"`{key}` {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if kept else "")
    return both.mapInArrow(run, schema)


NAMES = ("n_bytes", "n_removed", "n_spans", "kept_sha256", "kept")
