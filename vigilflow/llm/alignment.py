"""Which tokens of two tokenizers stand for each other, counted over the corpus by an external merge.

Where a token of either tokenizer ends at the same byte, the two are linked.  Tasks write records (pair of ids, document,
number of links) as sorted runs: partitioned by the low bits of the second id, byte planes under zstd.  The
runs' pairs are counted by k-way heap merges of bounded fan-in.  Their order has the second side first, so all pairs of an id
follow each other and its highest count is known when the next id comes.  The counts then meet the records
of every run again and go back to its documents.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Callable, Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import BLOCK_BYTES, TEXT_ROWS, blocks, giving_back, packed, release, stored, unpacked

RADIX_BITS = 6
RUN_RECORDS = 1 << 21  # links held before a run is written
RUN_DOCS = 1 << 18
FAN_IN = 64
MERGE_STEP = 256  # keys of a stream that the heap takes out at a time
ID_BITS, DOC_BITS = 18, 20  # a record is one number of 64 bits: partition, rest of the second id, first id, document
TEXT_PIECE = 1 << 18
# Between two printable ASCII characters a blank begins a pretoken, and no piece of the second kind goes across it.
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
LONG_RUN = 1000


def byte_letters() -> dict[str, int]:
    """Characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def token_table(tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All tokens' bytes one after the other, and the n + 1 places where they begin."""
    ends = np.append(0, np.cumsum([len(t) for t in tokens]))
    return np.frombuffer(b"".join(tokens), np.uint8), ends


def joined(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of tokens in a row, and where each token ends among them."""
    data, ends = table
    sizes = ends[ids + 1] - ends[ids]
    stops = np.cumsum(sizes)
    return data[np.repeat(ends[ids] - stops + sizes, sizes) + np.arange(stops[-1] if len(stops) else 0)], stops


class ByteTokens:
    """Ids of the byte-level vocabulary of a ``tokenizers`` file.

    Its merges are in the order of the ids, so the faster library of ranks gives the same ids.  Texts with letters beyond
    Latin ones, of which the libraries may have different Unicode tables, and very long runs go to the file's own library.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        letters = byte_letters()
        self.path, self.slow = path, None
        self.tokens = [b""] * (max(vocabulary.values()) + 1)
        ranks = {}
        for token, i in vocabulary.items():
            if all(c in letters for c in token):
                self.tokens[i] = bytes(letters[c] for c in token)
                ranks[self.tokens[i]] = i
        special = {t: i for t, i in vocabulary.items() if t.startswith("<|") and t.endswith("|>") and len(t) > 4}
        for token, i in special.items():  # no text gives them
            ranks.pop(token.encode(), None)
        self.fast = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str, usual: bool) -> list[int]:
        if usual:
            return self.fast.encode_ordinary(text)
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.encode_special_tokens = True
        return self.slow.encode(text, add_special_tokens=False).ids


class PieceTokens:
    """Ids of a ``sentencepiece`` model, which puts a blank before each text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        byte = [re.fullmatch("<0x([0-9A-F]{2})>", p) for p in pieces]
        self.tokens = [bytes([int(b[1], 16)]) if b else p.replace("▁", " ").encode() for p, b in zip(pieces, byte)]
        self.whole = any("▁" in p.lstrip("▁") for p in pieces)  # then texts can't be cut at blanks

    def encode(self, text: str) -> list[int]:
        return self.model.encode(text)


Tokenizers = Callable[[], tuple[ByteTokens, PieceTokens]]


def text_pieces(text: str, size: int) -> Iterator[str]:
    """``text`` cut at blanks (which go) where both tokenizers start anew; a text without such blanks stays whole."""
    at = 0
    while len(text) - at > size:
        found = CUT.search(text, at + size)
        if not found:
            break
        yield text[at : found.start()]
        at = found.end()
    yield text[at:] if at else text


class Aligner:
    """Tokens, groups and links of blocks of texts."""

    def __init__(self, tokenizers: tuple[ByteTokens, PieceTokens], size: int):
        self.a, self.b = tokenizers
        self.size = 1 << 62 if self.b.whole else size
        self.bytes_a, self.bytes_b = token_table(self.a.tokens), token_table(self.b.tokens)
        n, m = len(self.a.tokens), len(self.b.tokens)
        if max(n, m >> RADIX_BITS) > 1 << ID_BITS:
            raise ValueError(f"vocabularies of {n} and {m} tokens need more bits")
        written = [f"{i}{mark}".encode() for mark, k in ((",", n), ("|", n), (",", m), (";", m), ("", m)) for i in range(k)]
        self.starts = np.cumsum([0, n, n, m, m])  # of ids with their marks in the table
        width = max(map(len, written))
        self.written = np.array(written, f"S{width}").view(np.uint8).reshape(len(written), width)
        self.widths = np.array([len(w) for w in written])

    def _usual(self, raw: bytes) -> bool:
        data = np.frombuffer(raw, np.uint8)
        blank = (data == 32) | ((data >= 9) & (data <= 13))
        turns = np.flatnonzero(np.diff(blank))
        longest = np.diff(turns, prepend=-1, append=len(data)).max() if len(data) else 0
        return longest < LONG_RUN and not (data >= 0xCA).any()

    def _ids(self, text: str, raw: bytes) -> tuple[list[int], list[int]]:
        if not text:
            return [], []
        usual, a, b = self._usual(raw), [], []
        for piece in text_pieces(text, self.size):
            a += self.a.encode(" " + piece, usual)
            b += self.b.encode(piece)
        return a, b

    def align(self, texts: list[str]) -> dict[str, np.ndarray]:
        """n_a, n_b, n_groups and groups_sha256 of each text, and its links: _doc (place in ``texts``), _a, _b."""
        found_a, found_b, bodies = [], [], []
        for text in texts:
            raw = text.encode()
            a, b = (np.array(x, np.int64) for x in self._ids(text, raw))
            if not (len(a) and len(b) and self._same(a, self.bytes_a, raw) and self._same(b, self.bytes_b, raw)):
                a, b, raw = a[:0], b[:0], b""
            found_a.append(a)
            found_b.append(b)
            bodies.append(len(raw) + 1 if len(a) else 0)
        n_a, n_b = (np.array([len(x) for x in found]) for found in (found_a, found_b))
        a, b = (np.concatenate([*found, np.zeros(0, np.int64)]) for found in (found_a, found_b))
        end_a, end_b = (np.cumsum(np.diff(t[1])[ids]) for ids, t in ((a, self.bytes_a), (b, self.bytes_b)))
        # Of ends in rising order, those that both sides have.
        near = np.searchsorted(end_a, end_b)
        last_b = np.flatnonzero(end_a[np.minimum(near, len(a) - 1)] == end_b) if len(a) else near
        last_a = near[last_b]
        stops = np.cumsum(bodies)
        doc = np.searchsorted(stops, end_b[last_b])
        links = np.bincount(doc, minlength=len(texts))
        return {
            "n_a": n_a, "n_b": n_b, "n_groups": links, "groups_sha256": self._digests(a, b, last_a, last_b, n_a + n_b, links),
            "_doc": doc, "_a": a[last_a], "_b": b[last_b],
        }

    @staticmethod
    def _same(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray], raw: bytes) -> bool:
        return joined(ids, table)[0].tobytes() == b" " + raw

    def _digests(self, a, b, last_a, last_b, sizes, links) -> list[str]:
        """Hex digests of the texts' groups, written as ``a1,a2|b1;a3|b2,b3``; '' without tokens."""
        ends_a, ends_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        ends_a[last_a], ends_b[last_b] = True, True
        group_a, group_b = np.cumsum(ends_a) - ends_a, np.cumsum(ends_b) - ends_b
        # A token of the first side stands after all groups before its own, one of the second after the first side of its own.
        place_a = np.arange(len(a)) + np.append(0, last_b + 1)[group_a]
        place_b = np.arange(len(b)) + (last_a + 1)[group_b] if len(b) else np.zeros(0, np.int64)
        final = np.zeros(len(b), bool)
        some = links > 0
        final[last_b[np.cumsum(links)[some] - 1]] = True
        codes = np.empty(len(a) + len(b), np.int64)
        codes[place_a] = a + self.starts[ends_a.astype(int)]
        codes[place_b] = b + self.starts[2 + ends_b.astype(int) + final]
        cells = self.written[codes]
        flat = cells[cells != 0]
        stops = np.append(0, np.cumsum(self.widths[codes]))[np.append(0, np.cumsum(sizes))]
        return [sha256(flat[x:y].tobytes()).hexdigest() if y > x else "" for x, y in zip(stops[:-1], stops[1:])]


def pair_keys(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sortable keys of pairs: low bits of b (the partition), its other bits, a."""
    low, high = b & ((1 << RADIX_BITS) - 1), b >> RADIX_BITS
    return ((low << ID_BITS | high) << ID_BITS | a).astype(np.uint64)


def record_runs(docs: DataFrame, key: str, text: str, tokenizers: Tokenizers, records: int, size: int) -> DataFrame:
    """Per run one row with the lists of its documents, and a row per partition with its records.

    _pairs (sorted, packed) and _links (how often each is linked in the run) head the records; of each pair
    _sizes says how many documents have it, _docs which, _counts how often.
    """
    kind = docs.schema[key].dataType.simpleString()
    lists = ["n_a", "n_b", "n_groups"]
    schema = (
        f"_run long, _radix int, _pairs binary, _links binary, _sizes binary, _docs binary, _counts binary, _keys array<{kind}>, "
        + ", ".join(f"{c} array<long>" for c in lists) + ", groups_sha256 array<string>"
    )
    names = [part.split()[0] for part in schema.split(", ")]
    rows = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, first, number = Aligner(tokenizers(), size), TaskContext.get().partitionId() << 32, 0
        held, found, keys, n_links, n_docs = [], [], [], 0, 0

        def written(key_type: pa.DataType) -> pa.RecordBatch:
            """The run's document lists, then its partitions in order."""
            every, counts = np.unique(np.concatenate(held), return_counts=True)
            pairs, doc = every >> np.uint64(DOC_BITS), (every & np.uint64((1 << DOC_BITS) - 1)).astype(np.uint32)
            radix = pairs >> np.uint64(2 * ID_BITS)
            out: list[dict] = []
            for low, high in zip(cuts := np.flatnonzero(np.diff(radix.astype(np.int64), prepend=-1)), [*cuts[1:], len(pairs)]):
                heads = np.flatnonzero(np.diff(pairs[low:high].astype(np.int64), prepend=-1))
                out.append({
                    "_radix": int(radix[low]), "_pairs": packed(pairs[low:high][heads], True),
                    "_links": packed(np.add.reduceat(counts[low:high], heads).astype(np.uint64)),
                    "_sizes": packed(np.diff(heads, append=high - low).astype(np.uint32)),
                    "_docs": packed(doc[low:high]), "_counts": packed(counts[low:high].astype(np.uint32)),
                })
            joined_lists = {c: np.concatenate([f[c] for f in found]).tolist() for c in lists}
            out.append({"_keys": keys, **joined_lists, "groups_sha256": [x for f in found for x in f["groups_sha256"]]})
            types = [pa.int64(), pa.int32(), *[pa.binary()] * 5, pa.list_(key_type), *[pa.list_(pa.int64())] * 3, pa.list_(pa.string())]
            columns = [pa.array([first + number] * len(out) if c == "_run" else [o.get(c) for o in out], t) for c, t in zip(names, types)]
            return pa.RecordBatch.from_arrays(columns, names)

        for batch in blocks(batches, "_text", BLOCK_BYTES):
            got = aligner.align(batch.column("_text").to_pylist())
            place = (got["_doc"] + n_docs).astype(np.uint64)
            held.append(pair_keys(got["_a"], got["_b"]) << np.uint64(DOC_BITS) | place)
            found.append({c: got[c] for c in [*lists, "groups_sha256"]})
            keys += batch.column("_key").to_pylist()
            n_links, n_docs = n_links + len(place), n_docs + batch.num_rows
            if n_links >= records or n_docs >= RUN_DOCS:
                number += 1
                yield written(batch.schema.field("_key").type)
                held, found, keys, n_links, n_docs = [], [], [], 0, 0
        if keys:
            number += 1
            yield written(batch.schema.field("_key").type)

    return rows.mapInArrow(giving_back(run), schema)


def merged(streams: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of equal keys over sorted (keys, counts), by a heap that holds one key of each stream."""
    if len(streams) == 1:
        return streams[0]

    def taken(stream: tuple[np.ndarray, np.ndarray]) -> Iterator[tuple[int, int]]:
        for i in range(0, len(stream[0]), MERGE_STEP):
            yield from zip(*(x[i : i + MERGE_STEP].tolist() for x in stream))

    keys, sums, last = array("Q"), array("Q"), None
    for key, n in heapq.merge(*map(taken, streams)):
        if key == last:
            sums[-1] += n
        else:
            keys.append(key)
            sums.append(n)
            last = key
    return np.array(keys, np.uint64), np.array(sums, np.uint64)


def merge_level(runs: DataFrame, slots: int) -> DataFrame:
    """Runs of a partition merged, those of equal ``_run`` modulo ``slots`` into one."""

    def merge(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs, links = merged([(unpacked(r["_pairs"], np.uint64, True), unpacked(r["_links"], np.uint64)) for r in rows])
        return pa.table(
            [pa.array([rows[0]["_radix"]], pa.int32()), pa.array([rows[0]["_slot"]], pa.int64()), pa.array([packed(pairs, True)]), pa.array([packed(links)])],
            ["_radix", "_run", "_pairs", "_links"],
        )

    dealt = runs.withColumn("_slot", F.pmod(F.xxhash64("_run"), F.lit(slots)) if slots > 1 else F.lit(0).cast("long"))
    return dealt.groupBy("_radix", "_slot").applyInArrow(merge, "_radix int, _run long, _pairs binary, _links binary")


def pair_counts(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """(_radix, _all, _n, _top), stored: of each partition its pairs, their counts, and whether the second id has none higher."""
    if fan_in < 4:
        raise ValueError("a merge of fewer than four runs does not get on")
    heads = runs.where("_radix is not null").select("_radix", "_run", "_pairs", "_links")
    many = heads.groupBy("_radix").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    before = None
    while many > fan_in:
        # Dealt by hash, a slot gets about half a fan-in.
        many = -(-2 * many // fan_in)
        heads = stored(merge_level(heads, many), "merged")
        if before is not None:
            release(before)
        before = heads

    def best(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        pairs, links = merged([(unpacked(r["_pairs"], np.uint64, True), unpacked(r["_links"], np.uint64)) for r in rows])
        side = (pairs >> np.uint64(ID_BITS)).astype(np.int64)
        starts = np.flatnonzero(np.diff(side, prepend=-1))
        highest = np.repeat(np.maximum.reduceat(links, starts), np.diff(starts, append=len(side)))
        top = (links == highest).astype(np.uint8)
        arrays = [pa.array([rows[0]["_radix"]], pa.int32()), *(pa.array([x]) for x in (packed(pairs, True), packed(links), packed(top)))]
        return pa.table(arrays, ["_radix", "_all", "_n", "_top"])

    out = stored(heads.groupBy("_radix").applyInArrow(best, "_radix int, _all binary, _n binary, _top binary"), "pairs")
    if before is not None:
        release(before)
    return out


def contributions(runs: DataFrame, counts: DataFrame) -> DataFrame:
    """(_run, _at, _best, _sum): of each run and partition what its records give to the documents.

    Each row brings the counts of its partition, whose rows follow each other: they are unpacked once, and batches must be few rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        radix, every, counted, highest = None, None, None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["_radix"] != radix:
                    radix, every = row["_radix"], unpacked(row["_all"], np.uint64, True)
                    counted, highest = unpacked(row["_n"], np.uint64).astype(np.int64), unpacked(row["_top"], np.uint8).astype(np.int64)
                pairs = unpacked(row["_pairs"], np.uint64, True)
                at = np.searchsorted(every, pairs)
                sizes, doc = unpacked(row["_sizes"], np.uint32), unpacked(row["_docs"], np.uint32)
                n, top = counted[at], highest[at]
                links = unpacked(row["_counts"], np.uint32).astype(np.int64)
                order = np.argsort(doc, kind="stable")
                starts = np.flatnonzero(np.diff(doc[order].astype(np.int64), prepend=-1))
                best, total = (np.add.reduceat((links * np.repeat(x, sizes))[order], starts) for x in (top, n))
                arrays = [pa.array([row["_run"]], pa.int64()), *(pa.array([packed(x)]) for x in (doc[order][starts], best, total))]
                yield pa.RecordBatch.from_arrays(arrays, ["_run", "_at", "_best", "_sum"])

    records = runs.where("_radix is not null").select("_run", "_radix", "_pairs", "_sizes", "_docs", "_counts")
    both = records.join(counts.hint("merge"), "_radix")
    return both.mapInArrow(giving_back(run), "_run long, _at binary, _best binary, _sum binary")


def align(
    docs: DataFrame, tokenizers: Tokenizers, key: str = "doc_id", text: str = "text",
    records: int = RUN_RECORDS, fan_in: int = FAN_IN, size: int = TEXT_PIECE,
) -> DataFrame:
    """One row per row of ``docs``: key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Token ranges that end at the same byte of blank + text are linked.  n_best counts the links whose pair no other pair of
    its second id exceeds in links corpus-wide, ties included; count_sum adds up the corpus-wide counts of the pairs of the links.
    Null texts count as empty; empty texts, and those that the tokens of either side do not spell exactly, have zeros
    and '' and no links.  Rows equal in key or text count as often as they stand.  Texts of more than
    ``size`` characters are cut where neither tokenizer notices, if they have such places.  Other columns of ``docs`` do not matter.
    """
    runs = stored(record_runs(docs, key, text, tokenizers, records, size), "runs", TEXT_ROWS)
    counts = pair_counts(runs, fan_in)
    given = stored(contributions(runs, counts), "contributions", batch_bytes=BLOCK_BYTES)
    kind = docs.schema[key].dataType.simpleString()
    lists = runs.where("_radix is null").select("_run", "_keys", "n_a", "n_b", "n_groups", "groups_sha256")
    names = [key, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]

    def gather(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        own = next(r for r in rows if r["_at"] is None)
        best, total = np.zeros((2, len(own["_keys"])), np.int64)
        for r in rows:
            if r["_at"] is not None:
                at = unpacked(r["_at"], np.uint32)
                best[at] += unpacked(r["_best"], np.int64)
                total[at] += unpacked(r["_sum"], np.int64)
        arrays = [pa.array(own["_keys"], table.schema.field("_keys").type.value_type), *(pa.array(own[c], pa.int64()) for c in ("n_a", "n_b", "n_groups"))]
        # Tokens have at least one byte, so a common end is the end of one pair: each group has one link.
        arrays += [arrays[-1], pa.array(best), pa.array(total), pa.array(own["groups_sha256"], pa.string())]
        return pa.table(arrays, names)

    schema = f"`{key}` {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return given.unionByName(lists, allowMissingColumns=True).groupBy("_run").applyInArrow(gather, schema)
