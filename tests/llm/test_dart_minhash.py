import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from vigilflow.llm.dart_minhash import drop_near_duplicates, near_duplicates, prefix_pairs, shingles, signatures


def grams(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(rows):
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in rows:
        for j, b in rows:
            common = len(grams(a) & grams(b))
            if i < j and ((a or "") == (b or "") or common and common >= 0.8 * len(grams(a) | grams(b))):
                low, high = sorted((find(i), find(j)))
                root[high] = low
    return {i: find(i) for i, _ in rows}


def corpus():
    r = random.Random(4)
    prose = lambda n: [r.choice("abcdefghijklmnopqrstuvwxyz") * r.randint(1, 3) + str(r.randint(0, 40)) for _ in range(n)]
    out = []
    for _ in range(12):
        base = prose(r.randint(40, 400))
        out.append(" ".join(base))
        for _ in range(r.randint(0, 12)):  # chains of copies: far ends are linked through the middle only
            base = list(base)
            for _ in range(r.randint(1, 4)):
                base[r.randrange(len(base))] = "new" + str(r.randint(0, 9999))
            out.append(" ".join(base))
    out += ["", "", None, " \n", "one two three", "One  two\nthree", "one two", "x " * 3000, "x " * 2000, "y " * 50]
    r.shuffle(out)
    return list(enumerate(out))


def test_classes_equal_brute_force(spark):
    rows = corpus()
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in near_duplicates(frame).collect()}
    want = brute(rows)
    assert {i: r["class_id"] for i, r in got.items()} == want
    sizes = Counter(want.values())
    assert all(r["class_size"] == sizes[want[i]] and r["kept"] == (want[i] == i) for i, r in got.items())


def test_one_row_of_each_class_stays(spark):
    text = "a b c d e f g h i j k l m n o p"
    rows = [(3, text, 1), (3, text, 2), (1, text + " q", 3), (None, "other words that are not like the rest", 4), (7, None, 5), (8, "", 6)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _id int")
    got = drop_near_duplicates(frame)
    assert got.columns == frame.columns
    assert sorted((str(r["doc_id"]), r["_id"]) for r in got.collect()) == [("1", 3), ("7", 5), ("None", 4)]
    assert near_duplicates(frame.limit(0)).collect() == [] and drop_near_duplicates(frame.limit(0)).collect() == []


def test_pairs_far_from_the_center_of_a_large_bucket(spark):
    """Copies of a text with many changes each, and copies of those: similar to one another, not to the center."""
    r = random.Random(9)
    base = [f"w{r.randint(0, 9999)}" for _ in range(400)]

    def changed(words, n):
        words = list(words)
        for _ in range(n):
            words[r.randrange(len(words))] = f"n{r.randint(0, 99999)}"
        return words

    texts = [base] + [changed(base, r.randint(1, 5)) for _ in range(25)]
    for _ in range(25):
        texts.append(changed(base, r.randint(9, 16)))
    for _ in range(8):
        far = changed(base, 14)
        texts += [far, changed(far, 3), changed(changed(far, 5), 4)]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    r.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    for bands in (24, 60):
        got = {x["doc_id"]: x["class_id"] for x in near_duplicates(frame, rows=1 if bands == 24 else 4, bands=bands).collect()}
        assert got == brute(sorted(rows))


def agreement(a, b, wa=None, wb=None, k=512):
    elements = [np.array(sorted(x), np.uint64) for x in (a, b)]
    owner = np.repeat([0, 1], [len(a), len(b)])
    weights = None if wa is None else np.concatenate([wa, wb])
    s = signatures(owner, np.concatenate(elements), 2, k, weights)
    assert (s != 0).all()
    return (s[0] == s[1]).mean()


def test_signatures_agree_as_often_as_sets_overlap():
    r = np.random.default_rng(1)
    for common, own in ((5, 0), (1, 1), (80, 20), (500, 500), (4000, 1000)):
        a, b, c = (r.integers(1, 1 << 62, n) for n in (common, own, own))
        want = common / (common + 2 * own)
        assert abs(agreement([*a, *b], [*a, *c]) - want) < 4 * (want * (1 - want) / 512) ** 0.5 + 1e-9


def test_weights_count():
    ids = sorted(np.random.default_rng(2).integers(1, 1 << 62, 300))
    wa, wb = np.full(300, 1.0), np.linspace(0.1, 1, 300)
    want = np.minimum(wa, wb).sum() / np.maximum(wa, wb).sum()
    assert abs(agreement(ids, ids, wa, wb, 1024) - want) < 0.07


def test_shingles_of_counts():
    column = pa.array(["a b c d e a b c d e a b c d e", "A b c  d e", None, "a b", ""])
    owner, elements = shingles(column)
    assert np.bincount(owner, minlength=5).tolist() == [5, 1, 0, 1, 0]
    assert len(set(elements[owner == 0]) & set(elements[owner == 1])) == 1
    owner, _ = shingles(column, weighted=True)
    assert np.bincount(owner, minlength=5).tolist() == [11, 1, 0, 1, 0]


def test_components_are_whole_or_raise(spark, monkeypatch):
    from vigilflow.llm import dart_minhash

    chain = [(i, i + 1) for i in range(1, 30)] + [(50, 40), (40, 60)]
    links = spark.createDataFrame(chain, "x long, y long")
    got = {r["_id"]: r["_root"] for r in dart_minhash.components(links, "x", "y", "chain").collect()}
    assert got == {**{i: 1 for i in range(1, 31)}, 40: 40, 50: 40, 60: 40}
    monkeypatch.setattr(dart_minhash, "TURNS", 2)
    with pytest.raises(RuntimeError):
        dart_minhash.components(links, "x", "y", "chain")


def test_few_pairs_of_a_large_group_are_left(spark):
    """Copies of a center, most of them below the threshold and similar to none: their number of pairs follows that of the similar ones."""
    r = random.Random(5)
    center, fresh = set(range(150)), iter(range(1000, 1_000_000))
    near = [center - set(r.sample(range(150), 8)) | {next(fresh) for _ in range(8)} for _ in range(80)]
    far = [center - set(r.sample(range(150), n)) | {next(fresh) for _ in range(n)} for n in (r.randint(22, 40) for _ in range(300))]
    far += [s - set(r.sample(sorted(s), 6)) | {next(fresh) for _ in range(6)} for s in far[:20]]
    sets = {i: s for i, s in enumerate([*near, *far], 1)}
    alike = lambda a, b: len(a & b) >= 0.8 * len(a | b)
    name = lambda i: i.to_bytes(4, "big")
    out = {i: not alike(s, center) for i, s in sets.items()}
    rows = [
        (name(0), name(i), name(i if out[i] else 0), name(0), len(s), 150, len(s & center), np.array(sorted(s ^ center), np.uint32).tobytes())
        for i, s in sets.items()
    ]
    groups = spark.createDataFrame(rows, "_center binary, _id binary, _root binary, _main binary, _a long, _b long, _c long, _delta binary")
    got = {frozenset(int.from_bytes(x[k], "big") for k in ("_id", "_id2")) for x in prefix_pairs(groups, 0.8).collect()}
    want = {frozenset((i, j)) for i in sets for j in sets if i < j and (out[i] or out[j]) and alike(sets[i], sets[j])}
    assert want and want <= got and len(got) < 3 * len(want) + len(sets)
