import base64
import hashlib
import random
import tracemalloc
from collections import Counter

import pytest
import public_tokenizers
import pyarrow.parquet as pq

from vigilflow.llm import alignment
from vigilflow.llm.alignment import ByteTokens, PieceTokens, align, merged, text_pieces
from vigilflow.llm.queries import two_tokenizers

import numpy as np


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def spelled(libraries, text):
    """(id, bytes) of both sides, straight from the libraries; nothing where the bytes differ."""
    a, b = libraries
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as file:
        known = {int(i): base64.b64decode(t) for t, i in map(bytes.split, file)} if not hasattr(spelled, "known") else spelled.known
    spelled.known = known
    if not text:
        return [], []
    left = [(i, known[i]) for i in a.encode(" " + text, add_special_tokens=False).ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = piece.startswith("<0x") and piece.endswith(">") and len(piece) == 6
        right.append((i, bytes([int(piece[3:5], 16)]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    ok = b"".join(t for _, t in left) == whole == b"".join(t for _, t in right)
    return (left, right) if ok else ([], [])


def brute(libraries, rows):
    found, counts = [], Counter()
    for key, text in rows:
        left, right = spelled(libraries, text)
        ends, at = {}, 0
        for i, (_, t) in enumerate(left):
            at += len(t)
            ends[at] = i
        links, groups, at, before_a, before_b = [], [], 0, 0, 0
        for j, (_, t) in enumerate(right):
            at += len(t)
            if at in ends:
                i = ends[at]
                links.append((left[i][0], right[j][0]))
                groups.append(",".join(str(x) for x, _ in left[before_a : i + 1]) + "|" + ",".join(str(x) for x, _ in right[before_b : j + 1]))
                before_a, before_b = i + 1, j + 1
        counts.update(links)
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if left else ""
        found.append((key, len(left), len(right), len(groups), links, digest))
    highest = {}
    for (_, b), n in counts.items():
        highest[b] = max(n, highest.get(b, 0))
    return [
        (key, a, b, g, len(links), sum(counts[x] == highest[x[1]] for x in links), sum(counts[x] for x in links), digest)
        for key, a, b, g, links, digest in found
    ]


def texts():
    draw = random.Random(4)
    real = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["text"]).column("text").to_pylist()[:40]
    odd = ["", None, " ", "  two  blanks ", "a\nb\r\n\tc", "<|endoftext|> and <s> </s> <unk> <0x41>", "▁ is a mark", "日本語 and русский текст", "naïve café “quoted” — ok",
           "🙂🙂 é", "x" * 2500, " " * 2500, "1234567890 " * 30, "it's they'll I'M", "\x00\x01 control", " nbsp em", "ﬁ ½ ①"]
    made = ["".join(draw.choices("ab \n'1é.日", k=draw.randint(1, 80))) for _ in range(60)]
    return list(enumerate(real + odd + made)) + [(7, "same row"), (7, "same row"), (None, "no key")]


def check(libraries, frame, rows, **options):
    order = lambda r: (str(r[0]), r[1:])
    got = sorted((tuple(r) for r in align(frame, two_tokenizers, **options).collect()), key=order)
    assert got == sorted(brute(libraries, rows), key=order)


def test_equals_brute_force(spark, libraries):
    rows = texts()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(libraries, frame, rows)
    check(libraries, frame.selectExpr("*", "'x' AS n_a", "1 AS _run", "2 AS _keys"), rows, records=2000, fan_in=4, size=50)


def test_a_pair_owns_most_links(spark, libraries):
    rows = [(i, "the the the of the") for i in range(1500)] + [(5000 + i, f"the {i} of") for i in range(50)]
    check(libraries, spark.createDataFrame(rows, "doc_id long, text string").repartition(7), rows, records=1500, fan_in=5)


def test_empty_table(spark):
    assert align(spark.createDataFrame([], "doc_id long, text string"), two_tokenizers).collect() == []


def test_long_text_in_pieces(libraries):
    text = " ".join(t for _, t in texts()[:40])
    pieces = list(text_pieces(text, 1000))
    assert len(pieces) > 20 and " ".join(pieces) == text
    a, b = libraries
    assert [i for p in pieces for i in a.encode(" " + p, add_special_tokens=False).ids] == a.encode(" " + text, add_special_tokens=False).ids
    assert [i for p in pieces for i in b.encode(p)] == b.encode(text)
    assert list(text_pieces("é" * 5000, 100)) == ["é" * 5000]


def test_fast_ids_are_the_file_s_own(libraries):
    fast, _ = two_tokenizers()
    for _, text in texts():
        if text:
            own = libraries[0].encode(" " + text, add_special_tokens=False).ids
            assert fast.encode(" " + text, False) == own
            if len(text) < 2000:
                assert fast.encode(" " + text, True) == own


def test_heap_merge():
    draw = np.random.default_rng(2)
    streams = []
    for n in (0, 5, 300, 1000):
        keys = np.unique(draw.integers(0, 2000, n)).astype(np.uint64)
        streams.append((keys, draw.integers(1, 9, len(keys)).astype(np.uint64)))
    want = Counter()
    for k, c in streams:
        want.update(dict(zip(k.tolist(), c.tolist())))
    keys, sums = merged(streams)
    assert dict(zip(keys.tolist(), sums.tolist())) == want and (np.diff(keys.astype(np.int64)) > 0).all()


def test_a_merge_does_not_hold_its_streams_as_lists():
    keys, counts = np.arange(4000, dtype=np.uint64) + np.uint64(1 << 40), np.full(4000, 1000, np.uint64)
    tracemalloc.start()
    got = merged([(keys, counts)] * 64)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got[0] == keys).all() and (got[1] == 64_000).all()
    assert peak < 6e6  # 256000 pairs of numbers take three times that


def test_counts_of_a_partition_travel_in_small_batches(spark, libraries, monkeypatch):
    steps, store = {}, alignment.stored
    monkeypatch.setattr(alignment, "stored", lambda df, label, *a, **k: steps.setdefault(label, k) and None or store(df, label, *a, **k))
    rows = texts()[:40]
    check(libraries, spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows, records=300, fan_in=4)
    assert steps["contributions"] == {"batch_bytes": alignment.BLOCK_BYTES}
