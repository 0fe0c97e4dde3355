import gc
import math
import random
import re
import zlib
from collections import Counter

import pyarrow as pa
import pytest
import zstandard

from vigilflow.llm import interpolation
from vigilflow.llm.interpolation import ENOUGH, ROUNDS, cut, score

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*WORD.findall(lower), None]


def bucket(two, one):
    return ("two", min(int(math.log2(two)), 31)) if two else ("one", min(int(math.log2(one)), 31)) if one else ("new", 0)


def model(texts):
    c = [Counter(), Counter(), Counter()]
    for ts in texts:
        padded = ["<", "<", *ts]
        for i in range(2, len(padded)):
            for k in range(3):
                c[k][tuple(padded[i - k : i + 1])] += 1
    starts = {("<",): len(texts), ("<", "<"): len(texts)}
    n, v = sum(c[0].values()), len(c[0])

    def parts(u, w, x):
        two, one = ({**starts}.get((u, w), 0) or c[1][u, w]), starts.get((w,), 0) or c[0][w,]
        out = [c[2][u, w, x] / two if two else None, c[1][w, x] / one if one else None, c[0][x,] / n if n else None, 1 / (v + 1)]
        return bucket(two, one), out

    return c[0], n, v, parts


def brute(rows):
    crc = lambda k: zlib.crc32(str(k).encode()) if k is not None else 0
    kind = [2 if crc(k) % 5 == 1 else 1 if crc(k) // 5 % 10 == 0 else 0 for k, _ in rows]
    texts = [tokens(t) for _, t in rows]
    _, _, _, kept = model([t for t, k in zip(texts, kind) if k == 0])
    events = Counter()
    for ts, k in zip(texts, kind):
        if k == 1:
            for u, w, x in zip(["<", "<", *ts], ["<", *ts], ts):
                b, p = kept(u, w, x)
                events[b, tuple(p)] += 1
    single, n, v, every = model([t for t, k in zip(texts, kind) if k != 2])
    usable = {b: [y is not None or (j == 2 and n > 0) for j, y in enumerate(p)] for b, p in events}
    weights = {b: [x / sum(u) for x in u] for b, u in usable.items()}
    for _ in range(ROUNDS):
        sums = {b: [float(x) for x in u] for b, u in usable.items()}
        for (b, p), m in events.items():
            share = [(y or 0) * l for y, l in zip(p, weights[b])]
            for j in range(4):
                sums[b][j] += m * share[j] / sum(share)
        before, weights = weights, {b: [x / sum(s) for x in s] for b, s in sums.items()}
        if max((abs(x - y) for b in weights for x, y in zip(weights[b], before[b])), default=0) < ENOUGH:
            break
    out = []
    for (key, _), ts, k in zip(rows, texts, kind):
        base = sum(math.log10((single[x,] + 0.5) / (n + 0.5 * (v + 1))) for x in ts)
        total = 0.0
        for u, w, x in zip(["<", "<", *ts], ["<", *ts], ts):
            b, p = every(u, w, x)
            there = [y is not None for y in p]
            l = weights.get(b, [1.0] * 4)
            l = [x if t else 0 for x, t in zip(l, there)]
            total += math.log10(sum((y or 0) * x for y, x in zip(p, l)) / sum(l))
        out.append((key, k == 2, len(ts), sum(single[x,] > 0 for x in ts), n, base, total))
    return out


def check(spark, rows, frame=None, **options):
    frame = spark.createDataFrame(rows, "doc_id long, text string") if frame is None else frame
    order = lambda r: (str(r[0]), r[1:5], round(r[5], 6))
    got, want = sorted(map(tuple, score(frame, **options).collect()), key=order), sorted(brute(rows), key=order)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-9, abs=1e-9)
        assert g[6] == pytest.approx(w[6], rel=2e-3, abs=2e-3)


def corpus(n, seed=1):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["Über", "THE", "the"]
    rows = [(i, " ".join(draw.choices(words, [1 / (1 + j) for j in range(len(words))], k=draw.randint(0, 60)))) for i in range(n)]
    return rows


def test_equals_brute_force(spark):
    rows = corpus(150) + [(None, "the the THE w1"), (None, None), (300, ""), (301, None), (7, "a\tb\x0bc\nd"), (7, "a\tb\x0bc\nd"), (302, "\n \n")]
    rows += [(400 + i, "one two three four") for i in range(60)]
    check(spark, rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS score", "1 AS _key", "2 AS _texts", "3 AS held_out")
    check(spark, rows, frame)


def test_long_texts_in_pieces(spark):
    rows = corpus(40, 2) + [(1000, " ".join(t or "" for _, t in corpus(60, 3))), (1002, "x" * 5000), (1004, "y " * 900 + "z" * 3000 + " end")]
    check(spark, rows, size=700)


def test_nothing_to_learn_from(spark):
    check(spark, [])
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1][:3]
    check(spark, [(i, "some words") for i in held])
    only = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 > 1 and zlib.crc32(str(i).encode()) // 5 % 10 == 0][:2]
    check(spark, [(i, "some words") for i in only + held])


def test_pieces_of_whole_words():
    text = b"  aa bb  cc dd ee ff "
    for size in (1, 3, 7, 30):
        pieces = list(cut(text, size))
        words = [w for p, skip, _ in pieces for w in p.split()[skip:]]
        assert words == text.split()
        assert [last for *_, last in pieces] == [False] * (len(pieces) - 1) + [True]
    assert list(cut(b" " * 50, 3)) == [(b"", 0, True)]


def test_better_than_the_base_on_texts_held_out(spark):
    rows = score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.9 * sum(r["base_score"] for r in held)


def test_memory_goes_back_after_each_block(monkeypatch):
    class Frame:
        def select(self, columns):
            return self

        def mapInArrow(self, run, schema):
            return run

    def block(text):
        return [0, interpolation.TRAIN, zstandard.ZstdCompressor().compress(text), [len(text)], [0], [True]]

    columns = list(zip(*(block(t) for t in (b"a b c", b"a b d a", b""))))
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], interpolation.BLOCK_COLUMNS)
    alive = []
    held = lambda: sum(isinstance(x, interpolation.Tokens) for x in gc.get_objects())
    monkeypatch.setattr(interpolation, "give_back", lambda: alive.append(held()))
    found = list(interpolation.asked_counts(Frame(), 5)(iter([batch])))
    assert len(found) == 3 and alive == [0, 0, 0]


def test_batches_of_all_steps_are_bounded(spark, monkeypatch):
    """Rows of blocks and estimates hold megabytes: a batch of many lies beside the heap of its executor."""
    seen, learn = [], interpolation.learn_weights

    def watched(events, n):
        seen.append(spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch"))
        sizes = [(len(r["_bucket"]), len(r["_parts"])) for r in events.collect()]
        assert len(sizes) > 1 and all(a <= interpolation.EVENT_TOKENS and b == 16 * a for a, b in sizes)
        return learn(events, n)

    monkeypatch.setattr(interpolation, "learn_weights", watched)
    before = spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = [(i, "a b c d " * 3000) for i in range(100)]
    found = score(spark.createDataFrame(rows, "doc_id long, text string"))
    assert seen == [f"{interpolation.BLOCK_BYTES}b"] and spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before
    assert {(r["n_tokens"], r["n_known"]) for r in found.collect()} == {(12001, 12001)}
