"""Token counts by finite-state transducers compiled from a byte-level BPE tokenizer.

Two deterministic transducers run one after the other.  The first cuts a text into
pretokens: eleven states over character classes, compiled in full.  Texts are cut into chunks whose maps
(state before -> state after) are computed at once, composed by a parallel prefix scan, and run
again from the now known states to give the cuts.  The second reads the bytes of a pretoken; each of
its transitions carries the change of the token count.  It has too many states to compile in
full, so transitions are compiled when first met.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from vigilflow.llm.common import blocks, span_hashes

CHUNK = 256
PIECE_CHARS = 1 << 20
MAX_STATES = 200_000
MAX_WORDS = 500_000

# Character classes.  Letters that end a contraction have classes of their own.
LETTER, STMD, RV, E, L_, NUMBER, SPACE, WHITE, QUOTE, OTHER = range(10)
CLASSES = 10
FIRST, END = CLASSES, 2 * CLASSES  # the first character of a text has its class plus FIRST
WHITE_SPACE = (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)

# States: what the last characters were.
NEW, LETTERS, NUMBERS, OTHERS, SPACE1, SPACE2, WHITE1, WHITE2, QUOTED, QUOTED_RV, QUOTED_L = range(11)
STATES = 11
HERE, BEFORE = 1, 2  # a pretoken starts at this character, at the one before


def _opened(kind: int) -> int:
    """The state after a character that starts a pretoken."""
    if kind < NUMBER:
        return LETTERS
    return {NUMBER: NUMBERS, SPACE: SPACE1, WHITE: WHITE1, QUOTE: QUOTED, OTHER: OTHERS}[kind]


def _move(state: int, kind: int) -> tuple[int, int]:
    """Next state and output of the pretoken pattern: contractions, runs with one space before, white space."""
    letter, white = kind < NUMBER, kind in (SPACE, WHITE)
    fresh = (_opened(kind), HERE)
    if state == LETTERS:
        return (LETTERS, 0) if letter else fresh
    if state == NUMBERS:
        return (NUMBERS, 0) if kind == NUMBER else fresh
    if state == OTHERS:
        return (OTHERS, 0) if kind in (OTHER, QUOTE) else fresh
    if state in (SPACE1, SPACE2, WHITE1, WHITE2):
        if white:  # a run of two or more keeps its last character open
            return (SPACE2 if kind == SPACE else WHITE2), 0
        before = BEFORE if state in (SPACE2, WHITE2) else 0
        if state in (SPACE1, SPACE2):  # one space belongs to what follows
            return (OTHERS if kind == QUOTE else _opened(kind)), before
        return fresh[0], fresh[1] | before
    if state == QUOTED:
        if kind in (OTHER, QUOTE):
            return OTHERS, 0
        return {STMD: (NEW, 0), RV: (QUOTED_RV, 0), L_: (QUOTED_L, 0)}.get(kind, fresh)
    if (state, kind) in ((QUOTED_RV, E), (QUOTED_L, L_)):
        return NEW, 0
    if state in (QUOTED_RV, QUOTED_L):  # no contraction: the letter before starts a pretoken
        return (LETTERS, BEFORE) if letter else (fresh[0], HERE | BEFORE)
    return fresh


def _tables() -> tuple[np.ndarray, np.ndarray]:
    moves, outputs = np.zeros((STATES, END + 1), np.uint8), np.zeros((STATES, END + 1), np.uint8)
    for state in range(STATES):
        pending = BEFORE if state in (QUOTED_RV, QUOTED_L) else 0
        for kind in range(CLASSES):
            moves[state, kind], outputs[state, kind] = _move(state, kind)
            moves[state, FIRST + kind], outputs[state, FIRST + kind] = _opened(kind), HERE | pending
        outputs[state, END] = pending
    return moves.ravel(), outputs.ravel()


class Pretokens:
    """The pretoken transducer."""

    def __init__(self):
        self.moves, self.outputs = _tables()
        self.kinds = np.full(0x110000, 255, np.uint8)
        self.kinds[list(WHITE_SPACE)] = WHITE
        for chars, kind in (("stmd", STMD), ("rv", RV), ("e", E), ("l", L_), (" ", SPACE), ("'", QUOTE)):
            self.kinds[[ord(c) for c in chars]] = kind

    def classes(self, points: np.ndarray) -> np.ndarray:
        kinds = self.kinds[points]
        for point in np.unique(points[kinds == 255]).tolist():
            kind = unicodedata.category(chr(point))[0]
            self.kinds[point] = {"L": LETTER, "N": NUMBER}.get(kind, OTHER)
        return self.kinds[points]

    def chunk_maps(self, chunks: np.ndarray) -> np.ndarray:
        """State before -> state after, for each column of ``chunks`` (a chunk's classes)."""
        width = END + 1
        out = np.empty((chunks.shape[1], STATES), np.uint8)
        active = np.arange(chunks.shape[1])
        lanes = np.tile(np.arange(STATES, dtype=np.intp), (len(active), 1))
        columns, states = np.zeros(0, np.intp), np.zeros(0, np.intp)
        for row in range(len(chunks)):
            if len(columns):
                states = self.moves[states * width + chunks[row, columns]].astype(np.intp)
            if len(active):
                lanes = self.moves[lanes * width + chunks[row, active, None]].astype(np.intp)
                if row % 8 == 7:  # maps that have become constant go on with one lane
                    same = (lanes == lanes[:, :1]).all(axis=1)
                    columns, states = np.append(columns, active[same]), np.append(states, lanes[same, 0])
                    active, lanes = active[~same], lanes[~same]
        out[active] = lanes
        out[columns] = states[:, None]
        return out

    @staticmethod
    def scan(maps: np.ndarray) -> np.ndarray:
        """Composition of each map with all before it, in a logarithmic number of vector steps."""
        maps, reach = maps.copy(), 1
        while reach < len(maps):
            maps[reach:] = np.take_along_axis(maps[reach:], maps[:-reach].astype(np.intp), axis=1)
            reach *= 2
        return maps

    def starts(self, points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
        """Positions in ``points`` (code points of texts end to end) where pretokens start; ``firsts``: where texts do."""
        n, width = len(points), END + 1
        kinds = np.full(-(-(n + 1) // CHUNK) * CHUNK, END, np.uint8)
        kinds[:n] = self.classes(points)
        kinds[firsts] += FIRST
        chunks = np.ascontiguousarray(kinds.reshape(-1, CHUNK).T)
        entry = np.zeros(chunks.shape[1], np.intp)
        entry[1:] = self.scan(self.chunk_maps(chunks))[:-1, NEW]
        output = np.empty_like(chunks)
        for row in range(CHUNK):
            at = entry * width + chunks[row]
            output[row] = self.outputs[at]
            entry = self.moves[at].astype(np.intp)
        marks = output.T.ravel()
        found = (marks & HERE).astype(bool)
        found[:-1] |= (marks[1:] & BEFORE).astype(bool)
        return np.flatnonzero(found[:n])


def byte_letters() -> dict[int, str]:
    """Byte -> the letter that stands for it in byte-level vocabularies (printable ones stand for themselves)."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class TokenCounter:
    """The transducer from bytes to changes of the token count, compiled as it is used.

    The last token of the encoding of a prefix is the one suffix that is a token and may follow the last token
    of what is left without it.  So a state holds the longest suffix that begins some token, and for each
    place in it from which a token may still reach on, the last token and the count there, relative to
    now: a finite set.  Two tokens may follow one another if
    the tokenizer's merges leave them apart.  The table is emptied beyond ``MAX_STATES`` states.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        letters = byte_letters()
        back = {letter: byte for byte, letter in letters.items()}
        self.letters = [letters[b] for b in range(256)]
        self.tokens = {bytes(back[c] for c in token) for token in self.tokenizer.get_vocab(with_added_tokens=False)}
        self.begins = {token[:n] for token in self.tokens for n in range(len(token) + 1)}
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.pairs: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        start = (b"", ((b"", 0),))
        self.keys, self.numbers, self.next = [start], {start: 0}, [{}]

    def _split(self, text: bytes) -> list[str]:
        return [t.value for t in self.tokenizer.model.tokenize("".join(self.letters[b] for b in text))]

    def follows(self, left: bytes, right: bytes) -> bool:
        """Whether ``right`` may come after ``left`` (empty: after the start)."""
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) > 4 * MAX_STATES:
                self.pairs.clear()
            apart = [len(left), len(right)] if left else [len(right)]
            known = self.pairs[left, right] = [len(t) for t in self._split(left + right)] == apart
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, history = self.keys[state]
        suffix += bytes((byte,))
        for n in range(len(suffix), 0, -1):
            # An open place has an entry; no token can reach back to another one.
            if history[n - 1] and suffix[-n:] in self.tokens and self.follows(history[n - 1][0], suffix[-n:]):
                break
        change = history[n - 1][1] + 1
        places = [(suffix[-n:], 0)]
        for k in range(1, len(suffix) + 1):
            entry = history[k - 1]
            places.append((entry[0], entry[1] - change) if entry and suffix[-k:] in self.begins else None)
        while places[-1] is None:
            places.pop()
        key = (suffix[len(suffix) - len(places) + 1 :], tuple(places))
        to = self.numbers.get(key)
        if to is None:
            to = self.numbers[key] = len(self.keys)
            self.keys.append(key)
            self.next.append({})
        self.next[state][byte] = to, change
        return to, change

    def count(self, word: bytes) -> int:
        if len(self.keys) > MAX_STATES:
            self.reset()
        state = total = 0
        moves = self.next
        for byte in word:
            step = moves[state].get(byte) or self.compile(state, byte)
            state = step[0]
            total += step[1]
        return total


SAFE = re.compile("(?<=[A-Za-z]) (?=[A-Za-z])")


def pieces(text: str, specials: re.Pattern) -> tuple[list[str], int]:
    """``text`` without special strings, cut where a pretoken starts in any case; the number of special strings."""
    parts = specials.split(text) if specials.pattern else [text]
    out = []
    for part in parts:
        begin = 0
        while len(part) - begin > PIECE_CHARS and (cut := SAFE.search(part, begin + PIECE_CHARS)):
            out.append(part[begin : cut.start()])
            begin = cut.start()
        out.append(part[begin:])
    return out, len(parts) - 1


class TextCounter:
    """Token counts of batches of texts; words counted before are looked up by a 64-bit hash."""

    def __init__(self, path: str):
        self.words, self.pretokens = TokenCounter(path), Pretokens()
        self.specials = re.compile("|".join(map(re.escape, self.words.specials)))
        self.known: dict[int, int] = {}

    def counts(self, texts: list[str]) -> np.ndarray:
        parts, owners, totals = [], [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            cut, special = pieces(text, self.specials)
            totals[i] = special
            parts += cut
            owners += [i] * len(cut)
        joined = "".join(parts)
        if not joined:
            return totals
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        starts = self.pretokens.starts(points, begins[lengths > 0])
        raw = np.frombuffer(joined.encode(), np.uint8)
        places = np.flatnonzero((raw & 0xC0) != 0x80)[starts]
        stops = np.append(places[1:], len(raw))
        values, index, inverse = np.unique(span_hashes(raw, places, stops), return_index=True, return_inverse=True)
        if len(self.known) > MAX_WORDS:
            self.known.clear()
        found = list(map(self.known.get, keys := values.tolist()))
        for i, n in enumerate(found):
            if n is None:
                word = raw[places[index[i]] : stops[index[i]]].tobytes()
                found[i] = self.known[keys[i]] = self.words.count(word)
        owner = np.array(owners)[np.searchsorted(begins, starts, side="right") - 1]
        np.add.at(totals, owner, np.array(found, np.int64)[inverse])
        return totals


def count_tokens(
    docs: DataFrame, path: Callable[[], str], limit: int = 512, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: key, n_bytes, n_tokens, over_limit (more than ``limit`` tokens).

    Counts are those of the tokenizer file at ``path()`` (called in tasks) without added tokens; strings of
    special tokens in a text count one each.  Null texts count as empty: no tokens.  Long texts are cut
    where a pretoken starts, so memory holds one piece.  Nothing is shuffled.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in blocks(batches, text):
            counter = counter or TextCounter(path())
            texts = pc.fill_null(batch.column(text), "")
            found = counter.counts(texts.to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(key), pc.binary_length(texts).cast(pa.int64()), pa.array(found), pa.array(found > limit)],
                [key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, n_bytes long, n_tokens long, over_limit boolean")
