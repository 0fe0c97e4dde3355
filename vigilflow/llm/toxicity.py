"""Toxicity by a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

Each word has two inputs: a vector of its own (hashed) and one of its character runs (mean and strongest of hashed
runs of three to eight bytes).  Two gated recurrent layers read a window of words in both directions,
attention pools their states, and a logistic unit scores the window.  Windows overlap and cover the whole
text; a text's score is a logistic function of its worst windows and of the mean of all.  In training, a text
counts by its worst window.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import ALNUM, blocks, give_back, mix, span_hashes, utf8, word_spans

WINDOW, STRIDE = 64, 48
HIDDEN = 8
DIM, CHAR_DIM = 8, 4
INPUTS = DIM + CHAR_DIM + 1
WORD_BITS, CHAR_BITS = 17, 20
RUNS = (3, 5, 6, 7, 8)
WORST = 4
MAX_WORDS = 200_000
PART = 16_384


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


@dataclass
class Words:
    """Distinct words of a batch: word bucket, and buckets of character runs with the number of their word."""

    word: np.ndarray
    run: np.ndarray
    owner: np.ndarray


def buckets(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> Words:
    """Buckets of the words at the given spans of ``raw``."""
    word = (span_hashes(raw, starts, stops) >> np.uint64(64 - WORD_BITS)).astype(np.int32)
    parts = [_runs(raw, starts[i : i + PART], stops[i : i + PART], i) for i in range(0, len(starts), PART)]
    run, owner = zip(*parts) if parts else ([np.zeros(0, np.int32)],) * 2
    return Words(word, np.concatenate(run), np.concatenate(owner))


def _runs(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    lengths = stops - starts
    # Each word with one mark before and one after it, end to end.
    ends = np.cumsum(lengths + 2)
    owner = np.repeat(np.arange(len(starts)), lengths + 2)
    place = np.arange(ends[-1]) - np.repeat(ends - lengths - 2, lengths + 2)
    inner = (place > 0) & (place <= lengths[owner])
    letters = np.full(len(owner), 256, np.uint64)
    letters[inner] = raw[(starts[owner] + place - 1)[inner]]
    runs, owners = [], []
    value = np.zeros(len(letters), np.uint64)
    for n in range(max(RUNS)):
        shifted = letters[n:]
        value = value[: len(shifted)] * np.uint64(263) + shifted
        if n + 1 in RUNS:
            same = owner[: len(value)] == owner[n:]
            runs.append((mix(value[same] + np.uint64((n + 1) << 56)) >> np.uint64(64 - CHAR_BITS)).astype(np.int32))
            owners.append(owner[: len(value)][same])
    run, of = np.concatenate(runs), np.concatenate(owners)
    order = np.argsort(of, kind="stable")
    return run[order], (of[order] + number).astype(np.int32)


def distinct_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, stops, hash of each word, text of each word) of lower-case texts; words are letters and digits."""
    raw, ends = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, stops, text = word_spans(raw, ends, ALNUM)
    return raw, starts, stops, span_hashes(raw, starts, stops), text


def windows(text: np.ndarray, n: int, size: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, number of words, text) of all overlapping windows; a text without words has one empty window."""
    counts = np.bincount(text, minlength=n)
    begins = np.cumsum(counts) - counts
    parts = np.maximum(1, -(-(counts - size) // stride) + 1)
    owner = np.repeat(np.arange(n), parts)
    number = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    first = begins[owner] + number * stride
    return first, np.minimum(size, counts[owner] - number * stride), owner


@dataclass
class Model:
    """Weights; ``head`` those of a text's window logits; ``shift`` moves the balance of the sample to that of
    all labels; ``rate`` is the share of label 1, the score of a text without words."""

    word: np.ndarray
    char: np.ndarray
    weights: dict[str, np.ndarray] = field(default_factory=dict)
    head: np.ndarray = field(default_factory=lambda: np.zeros(WORST + 2))
    shift: float = 0.0
    rate: float = 0.5

    @classmethod
    def fresh(cls, seed: int = 7) -> Model:
        rng = np.random.default_rng(seed)
        draw = lambda *shape, scale=0.3: (rng.standard_normal(shape) * scale).astype(np.float32)
        inputs, states = INPUTS, 2 * HIDDEN
        weights = {"attend": draw(states, HIDDEN), "query": draw(HIDDEN), "out": draw(states), "bias": np.zeros(1, np.float32)}
        for way in "fb":
            weights |= {
                f"{way}x": draw(inputs, 3 * HIDDEN), f"{way}h": draw(HIDDEN, 3 * HIDDEN), f"{way}0": np.zeros(3 * HIDDEN, np.float32),
            }
        return cls(draw(1 << WORD_BITS, DIM, scale=0.05), draw(1 << CHAR_BITS, CHAR_DIM, scale=0.05), weights)

    def inputs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Input vectors of words, with the number of runs and the strongest run of each."""
        n = len(words.word)
        counts = np.bincount(words.owner, minlength=n)
        begins = np.cumsum(counts) - counts
        x = np.empty((n, INPUTS), np.float32)
        x[:, :DIM] = self.word[words.word]
        for i in range(0, n, PART):
            part, stop = begins[i : i + PART], begins[i + PART] if i + PART < n else len(words.run)
            vectors = self.char[words.run[part[0] : stop]]
            x[i : i + PART, DIM:-1] = np.add.reduceat(vectors, part - part[0]) / counts[i : i + PART, None]
            x[i : i + PART, -1] = np.maximum.reduceat(vectors[:, 0], part - part[0])
        return x, counts, begins

    def gates(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return tuple(x @ self.weights[f"{way}x"] + self.weights[f"{way}0"] for way in "fb")

    def read(self, way: str, gates: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps, windows, HIDDEN) in one direction; masked steps leave the state as it is."""
        steps, n = mask.shape
        state, out, tape = np.zeros((n, HIDDEN), np.float32), np.empty((steps, n, HIDDEN), np.float32), []
        recurrent = self.weights[f"{way}h"]
        for t in range(steps) if way == "f" else range(steps - 1, -1, -1):
            inner = state @ recurrent
            both = _sigmoid(gates[t][:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
            update, reset = both[:, :HIDDEN], both[:, HIDDEN:]
            fresh = np.tanh(gates[t][:, 2 * HIDDEN :] + reset * inner[:, 2 * HIDDEN :])
            before = state
            state = before + mask[t][:, None] * (1 - update) * (fresh - before)
            out[t] = state
            if keep:
                tape.append((t, before, inner, update, reset, fresh))
        return out, tape

    def forward(self, gates: tuple[np.ndarray, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, dict]:
        """Logits of windows from the gate inputs (steps, windows, 3 * HIDDEN) of both directions."""
        tape = {}
        sides = []
        for way, inputs in zip("fb", gates):
            out, tape[way] = self.read(way, inputs, mask, keep)
            sides.append(out)
        states = np.concatenate(sides, axis=2)
        hidden = np.tanh(states @ self.weights["attend"])
        scores = np.where(mask > 0, hidden @ self.weights["query"], -1e9)
        share = np.exp(scores - scores.max(axis=0))
        share = (share / share.sum(axis=0) * mask).astype(np.float32)
        pooled = (share[:, :, None] * states).sum(axis=0)
        logits = pooled @ self.weights["out"] + self.weights["bias"][0]
        tape |= {"states": states, "hidden": hidden, "share": share, "pooled": pooled, "mask": mask}
        return logits, tape

    def backward(self, tape: dict, slope: np.ndarray) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """Gradients of the weights, and of the gate inputs, for the slope of the loss in the logits."""
        w, share, states, hidden, mask = self.weights, tape["share"], tape["states"], tape["hidden"], tape["mask"]
        grads = {"out": tape["pooled"].T @ slope, "bias": np.array([slope.sum()], np.float32)}
        pooled = slope[:, None] * w["out"]
        d_states = share[:, :, None] * pooled
        d_share = (states * pooled).sum(axis=2)
        d_scores = share * (d_share - (share * d_share).sum(axis=0))
        grads["query"] = np.einsum("tn,tnh->h", d_scores, hidden)
        d_hidden = d_scores[:, :, None] * w["query"] * (1 - hidden**2)
        grads["attend"] = np.einsum("tns,tnh->sh", states, d_hidden)
        d_states = d_states + d_hidden @ w["attend"].T
        d_gates = {}
        for side, way in enumerate("fb"):
            into = d_states[:, :, side * HIDDEN : (side + 1) * HIDDEN]
            gates = np.zeros((*mask.shape, 3 * HIDDEN), np.float32)
            d_recurrent, d_after = np.zeros_like(w[f"{way}h"]), np.zeros(mask.shape[1:] + (HIDDEN,), np.float32)
            for t, before, inner, update, reset, fresh in reversed(tape[way]):
                total = d_after + into[t]
                moved = mask[t][:, None] * total
                d_fresh = moved * (1 - update) * (1 - fresh**2)
                gates[t, :, :HIDDEN] = moved * (before - fresh) * update * (1 - update)
                gates[t, :, HIDDEN : 2 * HIDDEN] = d_fresh * inner[:, 2 * HIDDEN :] * reset * (1 - reset)
                gates[t, :, 2 * HIDDEN :] = d_fresh
                d_inner = gates[t].copy()
                d_inner[:, 2 * HIDDEN :] *= reset
                d_recurrent += before.T @ d_inner
                d_after = total - moved * (1 - update) + d_inner @ w[f"{way}h"].T
            grads[f"{way}h"] = d_recurrent
            d_gates[way] = gates
        return grads, d_gates


def layout(first: np.ndarray, size: np.ndarray, inverse: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) numbers of distinct words, and the mask of steps within the window."""
    steps = max(1, int(size.max(initial=0)))
    place = np.arange(steps)[:, None]
    mask = place < size
    return inverse[np.where(mask, first + place, 0)] if len(inverse) else np.zeros(mask.shape, np.int64), mask.astype(np.float32)


class Scorer:
    """Scores of batches of texts; gate inputs of words seen before are kept, up to ``MAX_WORDS`` words."""

    def __init__(self, model: Model):
        self.model, self.numbers, self.tables = model, {}, None

    def _learn(self, raw: np.ndarray, starts: np.ndarray, stops: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        values, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.numbers) > MAX_WORDS:
            self.numbers, self.tables = {}, None
        keys = values.tolist()
        new = [i for i, key in enumerate(keys) if key not in self.numbers]
        if new:
            at = index[new]
            gates = self.model.gates(self.model.inputs(buckets(raw, starts[at], stops[at]))[0])
            base = len(self.numbers)
            for k, i in enumerate(new):
                self.numbers[keys[i]] = base + k
            self.tables = gates if self.tables is None else tuple(np.concatenate(x) for x in zip(self.tables, gates))
        return np.fromiter(map(self.numbers.__getitem__, keys), np.int64, len(keys))[inverse]

    def logits(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(logit, text number) of every window."""
        raw, starts, stops, hashes, text = distinct_words(column)
        numbers = self._learn(raw, starts, stops, hashes) if len(hashes) else np.zeros(0, np.int64)
        first, size, owner = windows(text, len(column))
        self.sizes, out = size, np.empty(len(first), np.float32)
        order = np.argsort(size, kind="stable")
        for begin in range(0, len(order), 2048):
            some = order[begin : begin + 2048]
            words, mask = layout(first[some], size[some], numbers)
            if self.tables is None:
                gates = (np.zeros((*mask.shape, 3 * HIDDEN), np.float32),) * 2
            else:
                gates = tuple(table[words] for table in self.tables)
            out[some] = self.model.forward(gates, mask)[0]
        return out, owner

    def scores(self, column: pa.Array) -> np.ndarray:
        """Probability of the label for each text."""
        logits, owner = self.logits(column)
        value = document_inputs(logits, owner, len(column)) @ self.model.head[:-1] + self.model.head[-1] + self.model.shift
        said = np.bincount(owner, weights=self.sizes, minlength=len(column)) > 0
        value = np.where(said, value, np.log(self.model.rate / (1 - self.model.rate)))
        return 1 / (1 + np.exp(-np.clip(value, -30, 30)))


def log_odds(words: Words, begins: np.ndarray, docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log odds of the label for word and run buckets by the texts they are in; within -3 and 3, rare ones near 0."""
    counts = [np.zeros((2, 1 << bits), np.float32) for bits in (WORD_BITS, CHAR_BITS)]
    stops = np.append(begins[1:], len(words.run))
    for own, label in zip(docs, labels.tolist()):
        counts[0][label, np.unique(words.word[own])] += 1
        lengths = stops[own] - begins[own]
        at = np.repeat(begins[own] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
        counts[1][label, np.unique(words.run[at])] += 1
    total = np.bincount(labels, minlength=2)[:, None]
    odds = []
    for found in counts:
        rates = (found + 0.5) / (total + 1)
        seen = found.sum(axis=0)
        odds.append(np.clip(np.log(rates[1] / rates[0]), -3, 3) * seen / (seen + 5))
    return tuple(odds)


def document_inputs(logits: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, WORST + 1): the largest window logits of each text, falling, then the mean; absent windows count as the least one."""
    order = np.lexsort((-logits, owner))
    counts = np.bincount(owner, minlength=n)
    begins = np.cumsum(counts) - counts
    ranked = logits[order]
    columns = [ranked[begins + np.minimum(k, counts - 1)] for k in range(WORST)]
    return np.stack([*columns, np.bincount(owner, weights=logits, minlength=n) / counts], axis=1)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, turns: int = 30) -> np.ndarray:
    """Weights of a ridge logistic regression (Newton steps); the last one is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), np.diag([*[ridge] * (x.shape[1] - 1), 1e-3])
    for _ in range(turns):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w -= 0.7 * np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (p - y) + penalty @ w)
    return w


def train(texts: list[str], labels: np.ndarray, base_rate: float, steps: int = 150, batch: int = 64, seed: int = 7) -> Model:
    """A model of the given texts; ``base_rate``: share of label 1 among all labelled rows.

    The first numbers of the word and run vectors are log odds; in training, those of the other half of the texts.  The other weights are trained by Adam, ``steps`` steps
    or four epochs, on the worst window of each text (the first time: the one with the strongest words), the vectors by
    Adagrad once per epoch.  With one label only, or none, the score is the smoothed base rate.
    """
    model = Model.fresh(seed)
    model.rate = rate = min(max(base_rate, 1e-3), 1 - 1e-3)
    labels = np.asarray(labels, np.int64)
    if len(set(labels.tolist())) < 2:
        model.shift = float(np.log(rate / (1 - rate)))
        return model
    column = pa.array(texts, pa.large_string())
    raw, starts, stops, hashes, text = distinct_words(column)
    _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
    words = buckets(raw, starts[index], stops[index])
    cuts = np.searchsorted(text, np.arange(1, len(texts)))
    _, counts, begins = model.inputs(words)
    own, fold = [np.unique(p) for p in np.split(inverse, cuts)], np.arange(len(texts)) % 2
    odds = [log_odds(words, begins, [own[d] for d in np.flatnonzero(use)], labels[use]) for use in (fold == 1, fold == 0, fold >= 0)]

    def inputs_of(part: int) -> np.ndarray:
        model.word[:, 0], model.char[:, 0] = odds[part]
        return model.inputs(words)[0]

    first, size, owner = windows(text, len(texts))
    window_begins = np.searchsorted(owner, np.arange(len(texts) + 1))
    moments = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in model.weights.items()}
    squares = [np.full(len(t), 1e-8, np.float32) for t in (model.word, model.char)]
    rng, step = np.random.default_rng(seed), 0

    def gates_of(some: np.ndarray) -> tuple:
        numbers, mask = layout(first[some], size[some], inverse)
        taken = x[fold[owner[some]][None, :], numbers]
        return numbers, mask, taken, tuple(taken @ model.weights[f"{w}x"] + model.weights[f"{w}0"] for w in "fb")

    epochs = max(4, -(-steps * batch // len(texts)))
    for epoch in range(epochs):
        # A text's log odds come from the other half of the texts, as those of unseen texts do.
        x = np.stack([inputs_of(0), inputs_of(1)])
        slopes = np.zeros_like(x[0])
        order = rng.permutation(len(texts))
        for begin in range(0, len(order), batch):
            docs = order[begin : begin + batch]
            if epoch:
                every = np.concatenate([np.arange(window_begins[d], window_begins[d + 1]) for d in docs])
                _, mask, _, gates = gates_of(every)
                value = model.forward(gates, mask)[0]
            else:
                every = np.concatenate([np.arange(window_begins[d], window_begins[d + 1]) for d in docs])
                _, mask, taken, _ = gates_of(every)
                value = ((taken[:, :, 0] + taken[:, :, -1]) * mask).sum(axis=0)
            ranked = every[np.lexsort((-value, owner[every]))]
            worst = ranked[np.append(True, owner[ranked][1:] != owner[ranked][:-1])]
            numbers, mask, taken, gates = gates_of(worst)
            logits, tape = model.forward(gates, mask, keep=True)
            slope = ((_sigmoid(logits) - labels[owner[worst]]) / len(worst)).astype(np.float32)
            grads, d_gates = model.backward(tape, slope)
            d_taken = np.zeros_like(taken)
            for way in "fb":
                grads[f"{way}x"] = np.einsum("tnx,tng->xg", taken, d_gates[way])
                grads[f"{way}0"] = d_gates[way].sum(axis=(0, 1))
                d_taken += d_gates[way] @ model.weights[f"{way}x"].T
            np.add.at(slopes, numbers[mask > 0], d_taken[mask > 0])
            step += 1
            for name, grad in grads.items():
                low, high = moments[name]
                low += 0.1 * (grad - low)
                high += 0.001 * (grad**2 - high)
                rise = 0.01 * (low / (1 - 0.9**step)) / (np.sqrt(high / (1 - 0.999**step)) + 1e-8)
                model.weights[name] -= (rise + 0.002 * model.weights[name]).astype(np.float32)
        if epoch + 1 == epochs:  # the weights belong to the vectors they were trained with
            break
        shared = slopes[:, DIM:-1] / np.maximum(counts, 1)[:, None]
        for table, rows, grad, square in ((model.word, words.word, slopes[:, :DIM], squares[0]), (model.char, words.run, shared, squares[1])):
            total = np.zeros_like(table)
            for column in range(1, table.shape[1]):
                each = grad[:, column] if table is model.word else np.repeat(grad[:, column], counts)
                for i in range(0, len(rows), 1 << 20):
                    total[:, column] += np.bincount(rows[i : i + (1 << 20)], weights=each[i : i + (1 << 20)], minlength=len(table))
            square += (total**2).mean(axis=1)
            table -= 0.1 / epochs * total / np.sqrt(square)[:, None]
    logits = []
    for begin in range(0, len(first), 512):
        _, mask, _, gates = gates_of(np.arange(begin, min(begin + 512, len(first))))
        logits.append(model.forward(gates, mask)[0])
    inputs_of(2)
    model.head = logistic(document_inputs(np.concatenate(logits), owner, len(texts)), labels)
    share = labels.mean()
    model.shift = float(np.log(rate / (1 - rate)) - np.log(share / (1 - share)))
    return model


def held_out(key: str) -> Column:
    """Rows kept from training: the crc32 of the key as text leaves 2 when divided by 4."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string")), F.lit(4)) == 2, F.lit(False))


def fit(
    docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_label: tuple[int, int] = (2000, 1000), max_chars: int = 20_000,
) -> Model:
    """A model from a bounded sample: of each label ``per_label`` labelled rows (those of the smallest key hashes) that are
    not held out, and of their texts those of up to ``max_chars`` characters.

    One task trains on the sample; the totals by label and the weights (20 MB) are all that reaches the driver.  Null
    keys, texts and labels are left out; a key with both labels has label 1.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(key) & F.col(key).isNotNull())
    known = known.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    totals = {r["_label"]: r["count"] for r in known.groupBy("_label").count().collect()}
    parts = [known.where(F.col("_label") == v).orderBy(F.xxhash64(key), key).limit(per_label[v]) for v in (0, 1)]
    some = docs.where(F.length(text) <= max_chars).select(F.col(key), F.col(text).alias("_text"))
    joined = some.join(F.broadcast(parts[0].union(parts[1])), key)
    sample = joined.orderBy(F.xxhash64(key), key, F.xxhash64("_text")).limit(sum(per_label)).select("_text", "_label")
    base_rate = totals.get(1, 0) / max(1, sum(totals.values()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, known = [], []
        for batch in batches:
            texts += batch.column(0).to_pylist()
            known += batch.column(1).to_pylist()
        model = train(texts, np.array(known, np.int64), base_rate)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(vars(model))], pa.binary())], ["_model"])
        del texts, known, model
        give_back()

    # The order with its limit leaves one partition, in that order; without rows there may be none.
    found = sample.mapInArrow(run, "_model binary").collect()
    model = Model(**pickle.loads(found[0]["_model"])) if found else train([], np.zeros(0, np.int64), base_rate)
    del found
    give_back()
    return model


def shipped_by_value(docs: DataFrame, model: Model) -> Broadcast:
    """The model as bytes that hold its class, too: workers need not have this package."""
    return docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(model))


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """One row per row of ``docs``: key, held_out, score (0 to 1), predicted (1 from ``threshold`` on).

    Scores come from the text alone and cover it whole; null texts count as empty, and a text without words has the
    share of label 1 as its score.  Nothing is shuffled; the model (20 MB) is broadcast.
    """
    kind = docs.schema[key].dataType.simpleString()
    shipped = shipped_by_value(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shipped.value))
        for batch in blocks(batches, text):
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(scorer.scores(batch.column(text)))], [key, "score"])
        del scorer
        give_back()

    scored = docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, score double")
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def remove_toxic(docs: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more; all others stay as they are."""
    shipped = shipped_by_value(docs, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shipped.value))
        for batch in blocks(batches, text):
            yield batch.filter(pa.array(scorer.scores(batch.column(text)) < threshold))
        del scorer
        give_back()

    return docs.mapInArrow(run, docs.schema)
