import hashlib
import random
from collections import Counter

from vigilflow.llm.radix_dedup import remove_repeats


def brute(bodies, depth=200):
    count = Counter(b[i : i + depth] for b in bodies for i in range(len(b) - depth + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - depth + 1):
            if count[b[i : i + depth]] > 1:
                gone[i : i + depth] = b"\1" * depth
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def texts():
    r = random.Random(3)
    prose = lambda n: "".join(r.choice("abcdé fghi\n") for _ in range(n))
    passage, base = prose(230), prose(3000)
    out = [base, base, prose(500) + passage + prose(90), passage, prose(40) + passage, passage[:199], passage[5:204]]
    for _ in range(6):  # near copies with a few changed letters
        copy = list(base)
        for _ in range(r.randint(1, 12)):
            copy[r.randrange(len(copy))] = r.choice("XYZ")
        out.append("".join(copy))
    out += ["a" * 150, "a" * 900, "ab" * 300, "x" + "ab" * 120, "", None, prose(150), base[100:310], base[2800:] + passage[:30], "é" * 400]
    half = prose(260)
    return out + [half + prose(80) + half[:205]]


def test_equals_brute_force(spark):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r)[1:] for r in remove_repeats(frame).collect()}
    assert [got[i] for i, _ in rows] == brute([(t or "").encode() for _, t in rows])


def test_repeated_rows_null_keys_extra_columns_and_kept_bytes(spark):
    text = "".join(chr(97 + i * i % 23) + str(i) for i in range(120))
    rows = [(1, text, 1), (1, text, 2), (None, "short", 3), (2, "q" + text[::-1], 4)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, _at long")
    got = sorted((str(r["doc_id"]), r["n_removed"], bytes(r["kept"])) for r in remove_repeats(frame, kept=True).collect())
    whole = (text[::-1]).encode()
    assert got == [("1", len(text), b""), ("1", len(text), b""), ("2", 0, b"q" + whole), ("None", 0, b"short")]


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []
