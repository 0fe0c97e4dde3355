"""Language-model scores by deleted interpolation.

A token's probability is a mixture of the maximum-likelihood estimates after two words, after one, after none, and of a
uniform share.  The weights depend on how often the context was seen (buckets by powers of two); they are learned by
expectation-maximisation on a tenth of the training texts, whose counts are deleted from the estimates meanwhile.

Texts travel in blocks.  A block asks for each of its n-grams once: hashes are dealt by leading bits, every part
counts what all blocks bring, and tells each block how much more than its own that is.  Nothing
of the corpus passes through the driver but totals, and sums per bucket and round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from vigilflow.llm.common import BLOCK_BYTES, MULTIPLIER, TEXT_ROWS, arrow_batches, blocks, distinct, give_back, mix, packed, release, span_hashes, stored, unpacked, word_spans

TEXT_BYTES = 3 * BLOCK_BYTES  # of the texts of a block
PART_BYTES = 4 * BLOCK_BYTES  # of the texts whose n-grams one part counts, on average
EVENT_TOKENS = 1 << 15  # of a row of estimates
TRAIN, FOLD, TEST = 0, 1, 2
COMPONENTS = 4  # after two words, after one, after none, uniform
BUCKETS = 65  # by contexts of two words: 32 and up; of one word, where those are new: below 32; both new: 64
ROUNDS, ENOUGH = 20, 1e-4
START, END, FIRST = (mix(np.array([x], np.uint64))[0] for x in (101, 102, 103))
LOW = np.uint64(1)
# Hashes keep 56 bits, those of three words, most of all, 52; the lowest bit tells words from longer n-grams.
HASH, TRIPLE = ~np.uint64(0xFF), ~np.uint64(0xFFF)


def with_kind(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(_row, _key, _kind, _text): the rows with a number each; held out, deleted for the weights, or counted."""
    crc = F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(0))
    kind = F.when(crc % 5 == 1, TEST).when(F.floor(crc / 5) % 10 == 0, FOLD).otherwise(TRAIN)
    return docs.select(
        F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), kind.cast("int").alias("_kind"),
        F.coalesce(F.col(text), F.lit("")).alias("_text"),
    )


def cut(raw: bytes, size: int) -> Iterator[tuple[bytes, int, bool]]:
    """(bytes, words only there as context, last) of the pieces of a text: whole words, after the two words before."""
    if len(raw) <= size:
        yield raw, 0, True
        return
    data = np.frombuffer(raw, np.uint8)
    starts, stops, _ = word_spans(data, np.array([0, len(data)]))
    at = 0
    while True:
        stop = max(at + 1, int(np.searchsorted(starts, (starts[at] if at < len(starts) else 0) + size)))
        last = stop >= len(starts)
        skip = min(at, 2)
        low, high = (int(starts[at - skip]), int(stops[min(stop, len(starts)) - 1])) if len(starts) else (0, 0)
        yield raw[low:high], skip, last
        if last:
            return
        at = stop


def text_blocks(rows: DataFrame, size: int = TEXT_BYTES) -> DataFrame:
    """Blocks of texts of one kind: _block, _kind, _size, _texts, and for each piece _rows, _keys, _skips, _lasts, _ends."""
    key = rows.schema["_key"].dataType.simpleString()
    schema = f"_block long, _kind int, _size long, _texts binary, _ends array<long>, _rows array<long>, _keys array<{key}>, _skips array<int>, _lasts array<boolean>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        first, number = TaskContext.get().partitionId() << 32, 0
        waiting: dict[int, list] = {}

        def block(kind: int, pieces: list, key_type: pa.DataType) -> pa.RecordBatch:
            nonlocal number
            number += 1
            data = zstandard.ZstdCompressor(level=3).compress(b"".join(p[0] for p in pieces))
            ends = np.cumsum([len(p[0]) for p in pieces])
            one = lambda values, kind: pa.array([values], pa.list_(kind))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([first + number], pa.int64()), pa.array([kind], pa.int32()), pa.array([int(ends[-1])], pa.int64()),
                    pa.array([data], pa.binary()), one(ends.tolist(), pa.int64()), one([p[1] for p in pieces], pa.int64()),
                    one([p[2] for p in pieces], key_type), one([p[3] for p in pieces], pa.int32()), one([p[4] for p in pieces], pa.bool_()),
                ],
                ["_block", "_kind", "_size", "_texts", "_ends", "_rows", "_keys", "_skips", "_lasts"],
            )

        held: dict[int, int] = {}
        key_type = pa.null()
        for batch in blocks(batches, "_text"):
            key_type = batch.schema.field("_key").type
            for row, name, kind, text in zip(*(batch.column(c).to_pylist() for c in ("_row", "_key", "_kind", "_text"))):
                for piece, skip, last in cut(text.encode(), size):
                    waiting.setdefault(kind, []).append((piece, row, name, skip, last))
                    held[kind] = held.get(kind, 0) + len(piece) + 64
                    if held[kind] >= size:
                        yield block(kind, waiting.pop(kind), key_type)
                        held[kind] = 0
        for kind, pieces in waiting.items():
            yield block(kind, pieces, key_type)
        waiting.clear()
        give_back()

    return rows.mapInArrow(run, schema)


class Tokens:
    """The tokens of a block: words as hashes, an end after the last piece of each text, and the n-grams that end there."""

    def __init__(self, texts: bytes, ends: list[int], skips: list[int], lasts: list[bool]):
        import zstandard

        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(texts), np.uint8)
        raw = np.where((raw >= 65) & (raw <= 90), raw + 32, raw).astype(np.uint8)
        stops = np.append(0, np.array(ends, np.int64))
        lasts = np.array(lasts, bool)
        begin, finish, text = word_spans(raw, stops)
        words = span_hashes(raw, begin, finish)
        counts = np.bincount(text, minlength=len(lasts)) + lasts
        before = np.append(0, np.cumsum(lasts))
        self.tokens = np.full(int(counts.sum()), END, np.uint64)
        self.tokens[np.arange(len(words)) + before[text]] = words
        self.text = np.repeat(np.arange(len(lasts)), counts)
        place = np.arange(len(self.text)) - np.append(0, np.cumsum(counts))[self.text]
        self.asked = place >= np.array(skips, np.int64)[self.text]
        self.first = place == 0
        del raw, begin, finish, text, words
        self.keys, places = distinct(self._keys(place))
        self.places = places.astype(np.int32).reshape(3, len(self.tokens))

    def _keys(self, place: np.ndarray) -> np.ndarray:
        """Hashes of the words, pairs and triples that end at each token, one after the other."""
        one, two = np.full_like(self.tokens, START), np.full_like(self.tokens, START)
        one[1:], two[2:] = self.tokens[:-1], self.tokens[:-2]
        one[place < 1], two[place < 2] = START, START
        single = mix(self.tokens * MULTIPLIER + FIRST) & HASH | LOW
        pair = mix(mix(one * MULTIPLIER + START) + self.tokens) & HASH
        triple = mix(mix(mix(two * MULTIPLIER + END) + one) + self.tokens) & TRIPLE
        return np.concatenate([single, pair, triple])

    def own(self) -> np.ndarray:
        """How often each key of the block ends at a token of its own (not of a piece before)."""
        weights = np.tile(self.asked, 3)
        return np.bincount(self.places.ravel()[weights], minlength=len(self.keys)).astype(np.uint32)


    def parts(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """The parts that count the block's keys, and where in the keys each begins (and the last ends)."""
        part = (self.keys >> np.uint64(64 - bits)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1))
        return part[cuts], np.append(cuts, len(part))


END_KEY = mix(np.array([END], np.uint64) * MULTIPLIER + FIRST) & HASH | LOW
BLOCK_COLUMNS = ["_block", "_kind", "_texts", "_ends", "_skips", "_lasts"]


def asked_counts(texts: DataFrame, bits: int) -> DataFrame:
    """(_block, _part, _kind, _keys, _own): of each block the n-grams and their counts there, dealt by leading bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).select(BLOCK_COLUMNS).to_pylist()[0]
                tokens = Tokens(row["_texts"], row["_ends"], row["_skips"], row["_lasts"])
                own = tokens.own() if row["_kind"] != TEST else np.zeros(len(tokens.keys), np.uint32)
                parts, cuts = tokens.parts(bits)
                out = []
                for part, low, high in zip(parts, cuts[:-1], cuts[1:]):
                    out.append((int(part), packed(tokens.keys[low:high], True), packed(own[low:high])))
                n = len(out)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["_block"]] * n, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([row["_kind"]] * n, pa.int32()),
                        pa.array([x[1] for x in out], pa.binary()), pa.array([x[2] for x in out], pa.binary()),
                    ],
                    ["_block", "_part", "_kind", "_keys", "_own"],
                )
                del row, tokens, own, parts, cuts, out
                give_back()

    return texts.select(BLOCK_COLUMNS).mapInArrow(run, "_block long, _part int, _kind int, _keys binary, _own binary")


TOTALS = ["n", "n_kept", "words", "words_kept", "texts", "texts_kept"]


def counted(asked: DataFrame) -> DataFrame:
    """(_block, _part, _more, _kept): how much more often all training texts, and those not in the fold (only told to blocks of
    the fold), have each n-gram of a block and part than the block itself; and, without _block, the _totals of
    a part: tokens, different words, texts, of all training texts and without the fold."""

    def count(table: pa.Table) -> pa.Table:
        give_back()  # what the part before has left
        rows = table.to_pylist()
        keys = [unpacked(r["_keys"], np.uint64, True) for r in rows]
        own = [unpacked(r["_own"], np.uint32) for r in rows]
        sizes = [len(k) for k in keys]
        every, at = distinct(np.concatenate(keys))
        kinds = np.repeat(np.array([r["_kind"] for r in rows], np.int8), sizes)
        values = np.concatenate(own).astype(np.float64)
        total = np.bincount(at, values, len(every)).astype(np.uint64)
        kept = np.bincount(at, np.where(kinds == TRAIN, values, 0), len(every)).astype(np.uint64)
        single = (every & LOW).astype(bool)
        ends = every == END_KEY
        totals = [int(x.sum()) for x in (total[single], kept[single], total[single] > 0, kept[single] > 0, total[ends], kept[ends])]
        places = np.split(at, np.cumsum(sizes)[:-1])
        more = [packed(total[place] - mine) for place, mine in zip(places, own)]
        rest = [packed(kept[place]) if r["_kind"] == FOLD else None for r, place in zip(rows, places)]
        n = len(rows)
        arrays = [
            pa.array([r["_block"] for r in rows] + [None], pa.int64()), pa.array([r["_part"] for r in rows] + [None], pa.int32()),
            pa.array(more + [None], pa.binary()), pa.array(rest + [None], pa.binary()), pa.array([None] * n + [totals], pa.list_(pa.int64())),
        ]
        return pa.table(arrays, ["_block", "_part", "_more", "_kept", "_totals"])

    return asked.groupBy("_part").applyInArrow(count, "_block long, _part int, _more binary, _kept binary, _totals array<long>")


def told_counts(tokens: Tokens, kind: int, known: dict[int, tuple[bytes, bytes | None]], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts of the block's keys in all training texts, and (for a block of the fold) in those not in the fold."""
    total = tokens.own().astype(np.uint64) if kind != TEST else np.zeros(len(tokens.keys), np.uint64)
    kept = np.zeros(len(tokens.keys), np.uint64)
    parts, cuts = tokens.parts(bits)
    for part, low, high in zip(parts.tolist(), cuts[:-1], cuts[1:]):
        more, rest = known[part]
        total[low:high] += unpacked(more, np.uint64)
        if rest is not None:
            kept[low:high] = unpacked(rest, np.uint64)
    return total, kept


def estimates(tokens: Tokens, counts: np.ndarray, n: int, texts: int, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, COMPONENTS estimates) of the tokens that are asked for; an estimate without context counts is 0."""
    one, two, three = (counts[p].astype(np.float64) for p in tokens.places)
    after = lambda values: np.where(tokens.first, texts, np.append(0.0, values[:-1]))
    context1, context2 = after(one), after(two)
    with np.errstate(divide="ignore", invalid="ignore"):
        parts = [np.where(context2 > 0, three / context2, 0), np.where(context1 > 0, two / context1, 0)]
        level = lambda c: np.minimum(np.log2(np.maximum(c, 1)).astype(np.int64), 31)
    parts += [one / max(n, 1), np.full(len(one), 1 / (words + 1))]
    bucket = np.where(context2 > 0, 32 + level(context2), np.where(context1 > 0, level(context1), 64))
    return bucket[tokens.asked], np.stack(parts)[:, tokens.asked]


def usable(n: int) -> np.ndarray:
    """(BUCKETS, COMPONENTS): whether a bucket has the component at all."""
    out = np.ones((BUCKETS, COMPONENTS), bool)
    out[:32, 0] = out[64, 0] = out[64, 1] = False
    out[:, 2] = n > 0
    return out


def grouped(texts: DataFrame, known: DataFrame):
    """The blocks, each with what it was told, in one group: as much as a block has n-grams."""
    left = texts.withColumns({"_part": F.lit(None).cast("int"), "_more": F.lit(None).cast("binary"), "_kept": F.lit(None).cast("binary")})
    return left.unionByName(known.select("_block", "_part", "_more", "_kept"), allowMissingColumns=True).groupBy("_block")


def read_block(table: pa.Table, bits: int) -> tuple[dict, Tokens, np.ndarray, np.ndarray]:
    """The block of a group, its tokens and counts."""
    give_back()  # what the block before has left
    known, row = {}, {}
    for r in table.to_pylist():
        if r["_texts"] is None:
            known[r["_part"]] = r["_more"], r["_kept"]
        else:
            row = r
    tokens = Tokens(row["_texts"], row["_ends"], row["_skips"], row["_lasts"])
    return row, tokens, *told_counts(tokens, row["_kind"], known, bits)


def held_out_events(texts: DataFrame, known: DataFrame, bits: int, totals: dict[str, int]) -> DataFrame:
    """(_bucket, _parts) packed, by ``EVENT_TOKENS`` tokens of a block of the fold: what the kept texts say of them."""
    n, words, documents = totals["n_kept"], totals["words_kept"], totals["texts_kept"]

    def run(table: pa.Table) -> pa.Table:
        _, tokens, _, kept = read_block(table, bits)
        bucket, parts = estimates(tokens, kept, n, documents, words)
        some = [slice(i, i + EVENT_TOKENS) for i in range(0, len(bucket), EVENT_TOKENS)]
        columns = [bucket[s].astype(np.uint8).tobytes() for s in some], [parts[:, s].astype(np.float32).tobytes() for s in some]
        return pa.table([pa.array(c, pa.binary()) for c in columns], ["_bucket", "_parts"])

    fold = grouped(texts.where(F.col("_kind") == FOLD), known.where("_kept is not null"))
    return fold.applyInArrow(run, "_bucket binary, _parts binary")


def learn_weights(events: DataFrame, n: int, rounds: int = ROUNDS) -> np.ndarray:
    """(BUCKETS, COMPONENTS) weights by expectation-maximisation, each started and held up by one occurrence."""
    prior = usable(n).astype(np.float64)
    weights = prior / prior.sum(axis=1, keepdims=True)
    for _ in range(rounds):
        def expect(batches: Iterator[pa.RecordBatch], weights: np.ndarray = weights) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                sums = np.zeros((BUCKETS, COMPONENTS))
                for buckets, parts in zip(batch.column(0), batch.column(1)):
                    bucket = np.frombuffer(buckets.as_buffer(), np.uint8)
                    shares = np.frombuffer(parts.as_buffer(), np.float32).reshape(COMPONENTS, -1) * weights[bucket].T
                    shares /= shares.sum(axis=0)
                    sums += np.stack([np.bincount(bucket, s, BUCKETS) for s in shares], axis=1)
                some = np.flatnonzero(sums.sum(axis=1))
                columns = [pa.array(some, pa.int32()), *(pa.array(sums[some, j]) for j in range(COMPONENTS))]
                yield pa.RecordBatch.from_arrays(columns, ["_bucket", *(f"_s{j}" for j in range(COMPONENTS))])

        schema = "_bucket int, " + ", ".join(f"_s{j} double" for j in range(COMPONENTS))
        found = events.mapInArrow(expect, schema).groupBy("_bucket").agg(*(F.sum(f"_s{j}") for j in range(COMPONENTS))).collect()  # BUCKETS rows at most
        posterior = prior.copy()
        for row in found:
            posterior[row[0]] += row[1:]
        before, weights = weights, posterior / posterior.sum(axis=1, keepdims=True)
        if np.abs(weights - before).max() < ENOUGH:
            break
    return weights


def score(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = TEXT_BYTES) -> DataFrame:
    """One row per row of ``docs``: key, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words between ASCII white space, A to Z in lower case, then one end; null texts count as empty.  The
    model learns from the rows whose crc32 of the key as text leaves no 1 when divided by 5 (null keys: learned from).  Rows equal in
    key or text count as often as they stand.  A word never seen has its share of one
    unseen word.  Without any text to learn from, scores are finite all the same.  Texts longer
    than ``size`` bytes are scored in pieces.  Other columns of ``docs`` do not matter.
    """
    texts = stored(text_blocks(with_kind(docs, key, text), size), "texts", TEXT_ROWS)
    total = texts.agg(F.sum("_size")).first()[0] or 0
    bits = max(5, int(np.ceil(np.log2(max(1, total / PART_BYTES)))))
    known = stored(counted(asked_counts(texts, bits)), "counts", batch_bytes=BLOCK_BYTES)
    sums = known.where("_block is null").select(*(F.sum(F.get("_totals", F.lit(i))) for i in range(len(TOTALS)))).first()
    totals = {name: int(x or 0) for name, x in zip(TOTALS, sums)}
    events = stored(held_out_events(texts, known, bits, totals), "events", batch_bytes=BLOCK_BYTES)
    n, words, documents = totals["n"], totals["words"], totals["texts"]
    with arrow_batches(docs.sparkSession, size=BLOCK_BYTES):
        weights = learn_weights(events, n)
    release(events)
    key_type = docs.schema[key].dataType.simpleString()

    def run(table: pa.Table) -> pa.Table:
        names = ["_row", "_key", "_test", "_n", "_seen", "_base", "_score"]
        row, tokens, counts, _ = read_block(table, bits)
        bucket, parts = estimates(tokens, counts, n, documents, words)
        owner, pieces = tokens.text[tokens.asked], len(row["_rows"])
        seen = counts[tokens.places[0]][tokens.asked].astype(np.float64)
        logs = np.log10((parts * weights[bucket].T).sum(axis=0))
        base = np.log10((seen + 0.5) / (n + 0.5 * (words + 1)))
        found = [np.bincount(owner, w, pieces) for w in (np.ones(len(owner)), seen > 0, base, logs)]
        key_field = table.schema.field("_keys").type.value_type
        columns = [
            pa.array(row["_rows"], pa.int64()), pa.array(row["_keys"], key_field), pa.array([row["_kind"] == TEST] * pieces, pa.bool_()),
            *(pa.array(x.astype(np.int64)) for x in found[:2]), *(pa.array(x.astype(np.float64)) for x in found[2:]),
        ]
        return pa.table(columns, names)

    told = known.where("_block is not null")
    pieces = grouped(texts, told).applyInArrow(run, f"_row long, _key {key_type}, _test boolean, _n long, _seen long, _base double, _score double")
    whole = pieces.groupBy("_row").agg(F.first("_key").alias(key), F.first("_test").alias("held_out"), *(F.sum(c).alias(c) for c in ("_n", "_seen", "_base", "_score")))
    return whole.select(
        key, "held_out", F.col("_n").alias("n_tokens"), F.col("_seen").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("_base").alias("base_score"), F.col("_score").alias("score"),
    )
