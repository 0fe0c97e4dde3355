import random

import pytest

from vigilflow.llm import token_counts
from vigilflow.llm.queries import byte_tokenizer

PARTS = [
    "'", "'s", "'re", "'r", "'ll", "'l", "'ve", "'d", "a", "e", "re", "S", " ", "  ", "\n", "\t", "1", "23", "!", "?.", "é", "ß", "日本",
    " ", "　", "²", "<|endoftext|>", "\x00", "🙂", "́", "x" * 30,
]


@pytest.fixture(scope="module")
def texts():
    r = random.Random(5)
    some = ["".join(r.choice(PARTS) for _ in range(r.randint(0, 60))) for _ in range(1500)]
    return [*some, "", "a" * 5000, " " * 3000, "'" * 700, "ab" * 9000, "the quick " * 60_000]


@pytest.fixture(scope="module")
def counts(texts):
    from tokenizers import Tokenizer

    return [len(e.ids) for e in Tokenizer.from_file(byte_tokenizer()).encode_batch(texts, add_special_tokens=False)]


def test_counts_are_those_of_the_library(texts, counts):
    assert token_counts.TextCounter(byte_tokenizer()).counts(texts).tolist() == counts


def test_short_pieces_and_small_tables_change_nothing(texts, counts, monkeypatch):
    monkeypatch.setattr(token_counts, "PIECE_CHARS", 500)
    monkeypatch.setattr(token_counts, "MAX_STATES", 50)
    monkeypatch.setattr(token_counts, "MAX_WORDS", 20)
    counter = token_counts.TextCounter(byte_tokenizer())
    some = [*range(0, 1500, 7), 1505]
    assert [int(counter.counts([texts[i]])[0]) for i in some] == [counts[i] for i in some]


def test_chunk_maps_compose(texts):
    import numpy as np

    machine = token_counts.Pretokens()
    points = np.frombuffer("".join(texts[:300]).encode("utf-32-le"), np.uint32)
    kinds = machine.classes(points)[: len(points) // 64 * 64]
    maps = machine.chunk_maps(np.ascontiguousarray(kinds.reshape(-1, 64).T))
    scanned, state = machine.scan(maps), np.arange(token_counts.STATES)
    for row, kind in enumerate(kinds):
        state = machine.moves[state * (token_counts.END + 1) + kind].astype(np.intp)
        if row % 64 == 63:
            assert (scanned[row // 64] == state).all()


def test_rows(spark):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, "é" * 2000, "y"), (2, None, None), (3, "", None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted((str(r[0]), *r[1:]) for r in map(tuple, token_counts.count_tokens(frame, byte_tokenizer).collect()))
    assert got[:2] == [("1", 11, 2, False)] * 2 and got[2:4] == [("2", 0, 0, False), ("3", 0, 0, False)]
    assert got[4][:2] == ("None", 4000) and got[4][3] == (got[4][2] > 512)
    assert token_counts.count_tokens(frame.limit(0), byte_tokenizer).collect() == []
