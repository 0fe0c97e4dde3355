"""Hierarchical packing of documents into token windows of several lengths.

The remainder of a document (what full windows leave over) goes to the tier of the
smallest window that holds it.  Tiers are packed from long to short: every window is opened by
a remainder of its own tier, and its gap is filled from shorter tiers, cut where the gap
ends.  Step groups balance over all tasks: the windows of a tier are numbered by the counts of (task, tier) and dealt
evenly, so that two groups of a tier differ by one window at most.
"""

from __future__ import annotations

import json
import zlib
from collections import Counter, deque
from collections.abc import Callable, Iterator
from itertools import compress, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from vigilflow.llm.alignment import byte_letters
from vigilflow.llm.common import TEXT_ROWS, blocks, give_back, stored
from vigilflow.operators.joins import lookup_join

TIERS = (4096, 2048, 1024, 512)
STEP_TOKENS = 1 << 17
CACHE_WORDS = 1_000_000
CACHE_BYTES = 64 << 20  # of words and ids, about a third of what their entries take
END_MARK = "</w>"
# Latin letters of one lower-case letter each, then signs: the tokenizer parts them between the two and nowhere else; a sign that
# begins a contraction is not among them.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿĀ-įĲ-ķĹ-ňŊ-ž"
PLAIN = rf"^[{LETTERS}]+[!-&(-/:-@\[-`{{-~]*$"


class WordPieces:
    """Ids of lower-case pretokens, many at a time, by a faster library: its ranks are the file's merges in their order.

    A line end stands for the end-of-word mark; the ranks before all merges join it to the byte before it.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocabulary = byte_letters(), model["vocab"]
        names = sorted(letters, key=letters.__getitem__)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        ranks: dict[bytes, int] = {}
        self.ids = np.zeros(512 + len(pairs), "<u4")
        for rank, token in enumerate([*names, *(name + END_MARK for name in names), *(a + b for a, b in pairs)]):
            body = bytes(letters[c] for c in token.removesuffix(END_MARK))
            if b"\n" not in body or rank < 512:  # no word has a line end
                ranks.setdefault(body + b"\n" * token.endswith(END_MARK), rank)
            self.ids[rank] = vocabulary.get(token, 0)
        self.ends = np.zeros(len(self.ids), bool)
        self.ends[[rank for token, rank in ranks.items() if token.endswith(b"\n")]] = True
        self.encoding = tiktoken.Encoding("words", pat_str=r"[^\n]+\n", mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pretokens of ``text``, each with a line end after it, and where each ends among the ids."""
        ranks = np.array(self.encoding.encode_ordinary(text), np.int64)
        return self.ids[ranks], np.flatnonzero(self.ends[ranks]) + 1


class WordEncoder:
    """Token ids of whole texts, kept per blank-separated word.

    Exact for tokenizers that drop white space and never look across it: each word has the
    ids it has in its text.  Words of Latin letters with signs after them, most of all words, are
    encoded many at a time by ``WordPieces``; all others one by one, by the tokenizer itself.  The cache
    is emptied beyond ``CACHE_WORDS`` entries or ``CACHE_BYTES``.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.pieces = WordPieces(path)
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _plain(self, words: pa.Array, known: list[str]) -> None:
        """Words that match ``PLAIN``, in both forms."""
        parted = pc.replace_substring_regex(pc.utf8_lower(words), rf"^([{LETTERS}]+)([^{LETTERS}])", "\\1\n\\2")
        ids, stops = self.pieces.encode("\n".join([*parted.to_pylist(), ""]))
        last = np.cumsum(1 + pc.not_equal(pc.binary_length(parted), pc.binary_length(words)).to_numpy(zero_copy_only=False))
        if len(stops) != last[-1] or stops[-1] != len(ids):
            self._one_by_one(known)
            return
        raw, ends = ids.tobytes(), (stops[last - 1] * 4).tolist()
        self.cache.update(zip(known, map(raw.__getitem__, map(slice, [0, *ends], ends))))

    def _one_by_one(self, words: list[str]) -> None:
        for word, found in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False)):
            self.cache[word] = np.array(found.ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        array = pa.array(words, pa.large_string())
        plain = pc.match_substring_regex(array, PLAIN)
        known = list(compress(words, plain.to_pylist()))
        if known:
            self._plain(array.filter(plain), known)
        self._one_by_one(array.filter(pc.invert(plain)).to_pylist())

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.cache) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        split = [text.replace("\n", " ").split(" ") for text in texts]
        self.cache.setdefault("", b"")
        new = set().union(*split).difference(self.cache)
        if new:
            self.learn(list(new))
            self.held += sum(map(len, new)) + sum(map(len, map(self.cache.__getitem__, new)))
        known = self.cache.__getitem__
        for words in split:
            yield b"".join(map(known, words))


class Packer:
    """Cuts documents into pieces (document, start, length, sequence, offset, tier) so that windows are full.

    Documents are numbers here; ``take`` gives pieces of complete windows, ``rest`` those of what is left.
    """

    def __init__(self, tiers: tuple[int, ...] = TIERS):
        self.tiers = tuple(sorted(tiers, reverse=True))
        if any(t & (t - 1) for t in self.tiers):
            raise ValueError("tiers are powers of two")
        self.pools: dict[int, deque] = {t: deque() for t in self.tiers}
        self.held = dict.fromkeys(self.tiers, 0)
        self.sequence = count()
        self.pieces: list[tuple[int, int, int, int, int, int]] = []

    def add(self, doc: int, n: int) -> None:
        largest = self.tiers[0]
        at = 0
        while n - at >= largest:
            self.pieces.append((doc, at, largest, next(self.sequence), 0, largest))
            at += largest
        if at < n:
            self._route(doc, at, n - at)

    def _route(self, doc: int, at: int, n: int) -> None:
        tier = min(t for t in self.tiers if t >= n)
        self.pools[tier].append((doc, at, n))
        self.held[tier] += n

    def _fill(self, sequence: int, tier: int, used: int, gap: int, sources: list[int]) -> None:
        for source in sources:
            pool = self.pools[source]
            while gap and pool:
                doc, at, n = pool.popleft()
                taken = min(n, gap)
                self.pieces.append((doc, at, taken, sequence, used, tier))
                self.held[source] -= taken
                used, gap = used + taken, gap - taken
                if taken < n:
                    pool.appendleft((doc, at + taken, n - taken))

    def pack(self) -> None:
        """All windows that can be filled to the last token; the rest stays in the pools."""
        for i, tier in enumerate(self.tiers):
            # Gaps take the shortest remainders first; where those run out, more of the tier's own.
            sources = [*reversed(self.tiers[i + 1 :]), tier]
            while self.pools[tier] and sum(self.held[t] for t in sources) >= tier:
                doc, at, n = self.pools[tier].popleft()
                self.held[tier] -= n
                sequence = next(self.sequence)
                self.pieces.append((doc, at, n, sequence, 0, tier))
                self._fill(sequence, tier, n, tier - n, sources)

    def finish(self) -> None:
        """The rest, end to end, in windows of falling powers of two: none of them has padding."""
        self.pack()
        total = sum(self.held.values())
        for bit in range(total.bit_length() - 1, -1, -1):
            if total >> bit & 1:
                size = min(1 << bit, self.tiers[0])
                for _ in range((1 << bit) // size):
                    self._fill(next(self.sequence), size, 0, size, list(self.tiers))

    def take(self) -> list[tuple[int, int, int, int, int, int]]:
        done, self.pieces = self.pieces, []
        return done


def balanced(pieces: DataFrame) -> DataFrame:
    """``pieces`` (a stored table) with the window's number by (task, tier) in ``step_group`` replaced by its step group.

    A tier of W windows has as many groups as its tokens fill ``STEP_TOKENS``, rounded up, and one for each window at most; windows
    are dealt in order of their number over all tasks, W divided by the groups or one more to each.  The id of a group is its tier
    times 2^40 plus its number.  One row a (task, tier) travels; pieces stay where they are while these rows fit a broadcast.
    """
    slot = (F.shiftright("sequence_id", 40) * (1 << 20) + F.log2("tier").cast("long")).alias("_slot")
    counts = pieces.where("offset = 0").groupBy(slot, "tier").agg(F.count(F.lit(1)).alias("_n"))
    tier = Window.partitionBy("tier")
    before = F.sum("_n").over(tier.orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1))
    total = counts.withColumns({"_before": F.coalesce(before, F.lit(0)), "_all": F.sum("_n").over(tier)})
    groups = total.withColumn("_groups", F.least("_all", F.ceil(F.col("_all") * F.col("tier") / STEP_TOKENS)).cast("long"))
    least = F.expr("_all div _groups")
    table = stored(groups.select("_slot", "_before", least.alias("_least"), (F.col("_all") % F.col("_groups")).alias("_larger")), "windows")
    joined = lookup_join(pieces.withColumn("_slot", slot), table, "_slot", "sequence_id", "inner")
    at = joined.withColumn("_at", F.col("step_group") + F.col("_before"))
    # The first _larger groups hold one window more than the others.
    number = F.expr("if(_at < _larger * (_least + 1), _at div (_least + 1), _larger + (_at - _larger * (_least + 1)) div _least)")
    group = F.col("tier") * (1 << 40) + number
    return at.select(*(group.alias(c) if c == "step_group" else F.col(f"`{c}`") for c in pieces.columns))


SCHEMA = (
    "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "tier long, step_group long"
)


def pack(
    docs: DataFrame,
    encoder: Callable[[], WordEncoder],
    end_id: int = 2,
    key: str = "doc_id",
    text: str = "text",
    tiers: tuple[int, ...] = TIERS,
    ids: bool = False,
) -> DataFrame:
    """One row per piece: key, place in its document and in its window, tier, step group; ``ids`` adds the token ids.

    Null texts count as empty: one piece with the end id.  Repeated rows are packed each for itself.
    Each task packs its own rows block by block, so no text or piece is shuffled and memory holds one block and
    the remainders that wait for a window.  Windows are full; only the last few of a task
    are shorter, of lengths that are powers of two.  ``sequence_id`` is unique over all tasks
    (task number times 2^40 plus a count).  A step group holds windows of one tier, about ``STEP_TOKENS`` tokens of all tasks
    together (see ``balanced``).  A task that runs again gives the same pieces for the same rows; they are stored once.
    """
    kind = docs.schema[key].dataType.simpleString()
    names = [x.strip().split()[0] for x in SCHEMA.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer, tail = encoder(), Packer(tiers), np.array([end_id], "<u4").tobytes()
        first = TaskContext.get().partitionId() << 40
        open_docs: dict[int, list] = {}
        number = count()
        windows: Counter[int] = Counter()

        def emit() -> pa.RecordBatch:
            columns = [[] for _ in range(10)]
            for doc, start, length, sequence, offset, tier in packer.take():
                entry = open_docs[doc]
                part = memoryview(entry[1])[4 * start : 4 * (start + length)]
                if offset == 0:
                    windows[tier] += 1
                row = (
                    entry[0], start, length, zlib.crc32(part), len(entry[1]) // 4, first + sequence, offset, tier,
                    windows[tier] - 1, bytes(part) if ids else None,
                )
                for column, value in zip(columns, row):
                    column.append(value)
                entry[2] -= length
                if not entry[2]:
                    del open_docs[doc]
            arrays = [pa.array(columns[0], key_type), *(pa.array(c, pa.int64()) for c in columns[1:9])]
            if ids:
                arrays.append(pa.array(columns[9], pa.binary()))
            return pa.RecordBatch.from_arrays(arrays, [key, *names, *(["ids"] if ids else [])])

        key_type = None
        for batch in blocks(batches, text):
            key_type = batch.schema.field(key).type
            keys = batch.column(key).to_pylist()
            texts = pc.fill_null(batch.column(text), "").to_pylist()
            for name, raw in zip(keys, words.encode(texts)):
                raw += tail
                doc = next(number)
                open_docs[doc] = [name, raw, len(raw) // 4]
                packer.add(doc, len(raw) // 4)
            packer.pack()
            yield emit()
        if key_type is not None:
            packer.finish()
            yield emit()
        del words, packer
        open_docs.clear()
        give_back()

    schema = f"`{key}` {kind}, {SCHEMA}" + (", ids binary" if ids else "")
    return balanced(stored(docs.select(key, text).mapInArrow(run, schema), "pieces", TEXT_ROWS))
