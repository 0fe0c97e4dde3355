"""Benchmark decontamination by greedy string tiling of texts with test items.

Shared seeds (``MIN_MATCH`` words, found by Karp-Rabin hashes) pair texts with items.  Each pair is tiled: the longest
match of words that no tile covers yet becomes a tile, again and again, down to ``MIN_MATCH`` words.  Tiles may
stand in any order, so a passage whose parts were moved is still covered.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from vigilflow.llm.common import ALNUM, MULTIPLIER, blocks, mix, span_hashes, utf8, word_spans

MIN_MATCH = 5
COVERAGE = 0.5
BLOCK_CHARS = 16 << 20
SIEVE_BITS = 20


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of all words: lower case, letters and digits; ASCII marks and white space part them."""
    raw, ends = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, stops, text = word_spans(raw, ends, ALNUM)
    return span_hashes(raw, starts, stops), text


def seed_hashes(words: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Rolling hash of each ``n`` words within one text, and the position of the first."""
    if len(words) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        total = total * MULTIPLIER + words[k : len(words) - n + 1 + k]
    at = np.flatnonzero(text[n - 1 :] == text[: len(text) - n + 1])
    return mix(total[at]), at


@dataclass
class Index:
    """Items of one block: words of each, and where each seed stands."""

    ids: list
    words: list[np.ndarray]
    seeds: np.ndarray
    items: np.ndarray
    places: np.ndarray
    sieve: np.ndarray

    @classmethod
    def build(cls, ids: list, texts: list[str], n: int) -> Index:
        words, text = word_hashes(pa.array(texts, pa.large_string()))
        seeds, at = seed_hashes(words, text, n)
        order = np.argsort(seeds, kind="stable")
        begins = np.searchsorted(text, np.arange(len(ids) + 1))
        sieve = np.zeros(1 << SIEVE_BITS, bool)
        sieve[(seeds >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)] = True
        items = text[at]
        return cls(
            list(ids), [words[a:b] for a, b in zip(begins[:-1], begins[1:])], seeds[order], items[order],
            (at - begins[items])[order], sieve,
        )


def tiles(text: np.ndarray, item: np.ndarray, pairs: list[tuple[int, int]], least: int) -> list[tuple[int, int, int]]:
    """Greedy tiling of ``text`` and ``item`` (word hashes) from seed places: (start in text, start in item, length).

    Longest first; ties by place in the item, then in the text.  Matches that a tile cuts come back shortened.
    """
    diagonals = defaultdict(list)
    for i, j in pairs:
        diagonals[i - j].append(i)
    queue = []
    for shift, starts in diagonals.items():
        starts.sort()
        begin = last = starts[0]
        for i in [*starts[1:], None]:
            if i is None or i > last + 1:
                queue.append((-(last - begin + least), begin - shift, begin))
                begin = i
            last = i
    heapify(queue)
    used_text, used_item, out = np.zeros(len(text), bool), np.zeros(len(item), bool), []
    while queue:
        length, j, i = heappop(queue)
        length = -length
        busy = used_text[i : i + length] | used_item[j : j + length]
        if not busy.any():
            used_text[i : i + length] = used_item[j : j + length] = True
            out.append((i, j, length))
            continue
        edges = np.flatnonzero(np.diff(np.concatenate([[True], busy, [True]]).astype(np.int8)))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if b - a >= least:
                heappush(queue, (-(b - a), j + a, i + a))
    return out


def find(index: Index, column: pa.Array, least: int, coverage: float) -> Iterator[tuple[int, int, float, int, int, int]]:
    """(row, item, coverage, tiles, longest, words) of the pairs whose tiles cover ``coverage`` of the item or more."""
    words, text = word_hashes(column)
    seeds, at = seed_hashes(words, text, least)
    some = np.flatnonzero(index.sieve[(seeds >> np.uint64(64 - SIEVE_BITS)).astype(np.int64)])
    low, high = np.searchsorted(index.seeds, seeds[some], "left"), np.searchsorted(index.seeds, seeds[some], "right")
    hit = high > low
    some, low, high = some[hit], low[hit], high[hit]
    begins = np.searchsorted(text, np.arange(len(column) + 1))
    pairs = defaultdict(list)
    for k, a, b in zip(at[some].tolist(), low.tolist(), high.tolist()):
        row = int(text[k])
        for x in range(a, b):
            pairs[row, int(index.items[x])].append((k - int(begins[row]), int(index.places[x])))
    for (row, item), places in pairs.items():
        size = len(index.words[item])
        # Tiles lie on seed places, so these bound what they can cover.
        if len({j + d for _, j in places for d in range(least)}) < coverage * size:
            continue
        found = tiles(words[begins[row] : begins[row + 1]], index.words[item], places, least)
        covered = sum(n for _, _, n in found)
        if covered >= coverage * size:
            yield row, item, covered / size, len(found), max(n for _, _, n in found), covered


def item_blocks(benchmark: DataFrame, key: str, text: str, least: int, block_chars: int) -> Iterator[Index]:
    """The benchmark in blocks of about ``block_chars`` characters: what a task holds of it at a time is bounded.

    A block comes through the driver; a block without an item of ``least`` words is left out.
    """
    size = benchmark.agg(F.sum(F.length(text))).first()[0] or 0
    parts = max(1, -(-int(size) // block_chars))
    dealt = benchmark.withColumn("_part", F.pmod(F.xxhash64(text), F.lit(parts)))
    for part in range(parts):
        rows = dealt.where(F.col("_part") == part).select(key, text).collect()
        index = Index.build([r[0] for r in rows], [r[1] or "" for r in rows], least)
        if len(index.seeds):
            yield index


def leaks(
    docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id",
    item_text: str = "text", least: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(key, item, coverage, n_tiles, longest, n_words): pairs of a row and an item whose tiles cover enough of the item.

    Null and empty texts and items pair with nothing, nor do items of fewer than ``least`` words.  Repeated rows and items
    each give their own rows.  Every text is read whole, once per block of the benchmark; nothing is shuffled.
    """
    kinds = docs.schema[key].dataType.simpleString(), benchmark.schema[item].dataType.simpleString()
    schema = f"`{key}` {kinds[0]}, `{item}` {kinds[1]}, coverage double, n_tiles long, longest long, n_words long"
    item_type = to_arrow_type(benchmark.schema[item].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in item_blocks(benchmark, item, item_text, least, block_chars):
        run = _leaks_of(index, key, item, item_type, text, least, coverage)
        out = out.unionByName(docs.select(key, text).mapInArrow(run, schema))
    return out


def _leaks_of(index: Index, key: str, item: str, item_type: pa.DataType, text: str, least: int, coverage: float) -> Callable:
    kinds = (pa.float64(), pa.int64(), pa.int64(), pa.int64())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, text):
            found = list(find(index, batch.column(text), least, coverage))
            rows, items, *values = zip(*found) if found else [()] * 6
            arrays = [batch.column(key).take(pa.array(rows, pa.int64())), pa.array([index.ids[i] for i in items], item_type)]
            arrays += [pa.array(v, k) for v, k in zip(values, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, [key, item, "coverage", "n_tiles", "longest", "n_words"])

    return run


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text",
    least: int = MIN_MATCH, coverage: float = COVERAGE, block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``docs`` without the rows that contain enough of an item; all others stay as they are, null texts too."""

    def clean(index: Index) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in blocks(batches, text):
                bad = {found[0] for found in find(index, batch.column(text), least, coverage)}
                yield batch.filter(pa.array([row not in bad for row in range(batch.num_rows)], pa.bool_()))

        return run

    for index in item_blocks(benchmark, item, item_text, least, block_chars):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs
