import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from vigilflow.llm.packing import Packer, WordEncoder, pack
from vigilflow.llm.queries import word_encoder

PATH = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(PATH))


def test_ids_are_those_of_the_library(tokenizer):
    r = random.Random(1)
    parts = ["the", "The,", "ÉCOLE", "ét", "ΑΣ", "İx", "don't", "...", ".", "12.5", "日本語", "<|endoftext|>", "　", "\t", "ß", "ﬁ", "🙂", "ǅ", "x" * 300, "\x1c"]
    texts = ["".join(r.choice(parts) + r.choice(["", " ", "  ", "\n"]) for _ in range(r.randint(0, 40))) for _ in range(500)]
    found = list(word_encoder().encode(texts))
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert found == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 9000), max_size=80), st.integers(1, 9))
def test_every_token_lies_in_one_full_window(sizes, step):
    packer, pieces = Packer(), []
    for i, n in enumerate(sizes):
        packer.add(i, n)
        if i % step == 0:
            packer.pack()
            pieces += packer.take()
    packer.finish()
    pieces += packer.take()
    for i, n in enumerate(sizes):
        own = sorted((p[1], p[2]) for p in pieces if p[0] == i)
        assert [a for a, _ in own] == list(np.cumsum([0, *(length for _, length in own)])[:-1]) and sum(x for _, x in own) == n
    windows = {}
    for _, _, length, sequence, offset, tier in pieces:
        assert offset == windows.get(sequence, (0, tier))[0]
        windows[sequence] = (offset + length, tier)
    assert all(used == tier and tier <= 4096 and tier & (tier - 1) == 0 for used, tier in windows.values())


def test_pieces_hold_the_documents(spark, tokenizer):
    rows = [(1, "the quick brown fox " * 3000), (2, None), (3, ""), (2, "again"), (None, "nothing"), (4, "short text."), (4, "short text.")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, tier string").repartition(2)
    got = pack(frame, word_encoder, ids=True).collect()
    for r in got:
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
    want = sorted((str(k), np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4").tobytes()) for k, t in rows)
    ids = {}
    for r in sorted(got, key=lambda r: (r["start"])):
        ids.setdefault((str(r["doc_id"]), r["doc_tokens"], r["sequence_id"] >> 40), []).append(r)
    total = sum(r["length"] for r in got)
    assert total == sum(len(x) // 4 for _, x in want)
    long = b"".join(bytes(r["ids"]) for r in sorted((r for r in got if r["doc_id"] == 1), key=lambda r: r["start"]))
    assert long == dict(want)["1"]
    assert {r["doc_tokens"] for r in got if r["doc_id"] == 2} == {1, 2}


def test_step_groups_balance_over_all_tasks(spark, monkeypatch):
    from vigilflow.llm import packing

    r = random.Random(4)
    rows = [(i, "word " * r.choice([3, 90, 300, 700, 1500, 3000, 9000])) for i in range(150)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for step, limit in ((1 << 13, None), (1 << 17, None), (1 << 10, None), (1 << 13, 0)):
        monkeypatch.setattr(packing, "STEP_TOKENS", step)
        if limit is not None:  # the way of tables beyond the broadcast size
            join = packing.lookup_join
            monkeypatch.setattr(packing, "lookup_join", lambda *a, join=join: join(*a, limit=limit))
        tokens, tiers, windows = {}, {}, {}
        pieces = pack(frame, word_encoder).collect()
        assert sum(p["length"] for p in pieces) == sum(n for n in {p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
        for p in pieces:
            assert tiers.setdefault(p["step_group"], p["tier"]) == p["tier"] == p["step_group"] >> 40
            assert windows.setdefault(p["sequence_id"], p["step_group"]) == p["step_group"]
            tokens[p["step_group"]] = tokens.get(p["step_group"], 0) + p["length"]
        for tier in set(tiers.values()):
            own = {g: n for g, n in tokens.items() if tiers[g] == tier}
            assert max(own.values()) - min(own.values()) in (0, tier)
            assert len(own) == min(-(-sum(own.values()) // step), sum(own.values()) // tier)
            assert sorted(g - (tier << 40) for g in own) == list(range(len(own)))


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), word_encoder).collect() == []


def test_tiers_are_powers_of_two():
    with pytest.raises(ValueError):
        Packer((1000,))


def test_small_cache_changes_nothing(monkeypatch):
    import public_tokenizers

    from vigilflow.llm import packing

    texts = ["one two three, four.", "two three four five.", "one six."]
    want = list(word_encoder().encode(texts))
    monkeypatch.setattr(packing, "CACHE_WORDS", 1)
    encoder = WordEncoder(public_tokenizers.path(PATH))
    assert [x for t in texts for x in encoder.encode([t])] == want


def test_words_of_latin_letters_and_signs_are_encoded_together(tokenizer, monkeypatch):
    r = random.Random(2)
    letters = [c for c in map(chr, range(0xC0, 0x180)) if c.isalpha() and len(c.lower()) == 1 and c not in "ıĸŉſİ"]
    words = {r.choice(letters + ["the", "Er"]) + "".join(r.choice("etaoinNSß") for _ in range(r.randint(0, 12))) + r.choice(["", ".", ",###", '"%%%', "-"]) for _ in range(4000)}
    words |= {"aaaaaaaaa", "<", "a<", "x</w>", "x<|endoftext|>", "don't", "a'", "I'll.", "été's", "ét", "a\x1c", "ab1", "日本."}
    words, rare, found = sorted(words), [], word_encoder()
    one_by_one = found._one_by_one
    monkeypatch.setattr(found, "_one_by_one", lambda some: (rare.extend(some), one_by_one(some)))
    want = [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch(words, add_special_tokens=False)]
    assert list(found.encode(words)) == want
    assert len(rare) < 15 and {"don't", "x<|endoftext|>", "ab1"} <= set(rare)
