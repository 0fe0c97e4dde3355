from itertools import permutations

from vigilflow.llm.filter_audit import audit

CHARS = "#$%&*|"


def brute(docs, labels):
    """Filters applied one after the other, in every order."""
    rows = []
    for key, text, part in docs:
        text = text or ""
        words = [w for w in text.replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ") if w]
        failed = {
            "A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text), "D": any(c in CHARS for c in text),
            "E": key is not None and any(k is not None and k < key and (t or "") == text for k, t, _ in docs),
        }
        own = [x for x in labels if x[0] is not None and x[0] == key]
        rows.append((part or "", {f for f, bad in failed.items() if bad}, any(x[1] == 1 for x in own), any(x[2] == 1 for x in own)))
    out, sums = {}, {}
    for part in {r[0] for r in rows}:
        for order in map("".join, permutations("ABCDE")):
            left = [r for r in rows if r[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += here
                alone = sum(r[0] == part and r[1] == {f} for r in rows)
                out[part, order, step] = (len(left), len(here), redundant, alone, sum(r[2] for r in here), sum(r[3] for r in here))
                sums[part, f] = sums.get((part, f), 0) + len(here)
    return {(p, o, s): (*v, sums[p, o[s - 1]]) for (p, o, s), v in out.items()}


def result(spark, docs, labels, extra=False):
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string")
    if extra:
        frame = frame.selectExpr("*", "1 AS _id", "'x' AS mask", "2 AS quality", "3 AS n")
    got = audit(frame, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r["part"], r["filter_order"], r["step"]) for r in got}) == len(got)
    return {(r[0], r[1], r[2]): tuple(r[3:]) for r in got}


LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "a"), (2, LONG, "a"), (3, LONG + " #", "a"), (4, "the " * 70, None), (5, "the " * 70, ""), (None, LONG, "a"),
    (6, None, "b"), (7, "", "b"), (8, "AB cd", "b"), (9, "AB cd", "a"), (10, LONG.upper() + " *", "a"), (11, "é x\ty\x0bz\x1cq " * 200_000, "b"),
    (-1, "AB cd", None), (12, "a\nb " * 30, "c"), (13, "50 " + " ".join(str(i) for i in range(49)), "c"),
]
LABELS = [(1, 1, 0), (2, 1, 1), (2, 0, 1), (5, None, 1), (9, 1, None), (None, 1, 1), (99, 1, 1), (7, 1, 0)]


def test_equals_brute_force(spark):
    expected = brute(DOCS, LABELS)
    assert result(spark, DOCS, LABELS) == expected
    assert result(spark, DOCS, LABELS, extra=True) == expected
    assert len(expected) == 4 * 600


def test_copies_own_most_rows(spark):
    docs = [(i % 700, "same text here", "hot") for i in range(2000)] + [(5000 + i, f"{LONG} {i}", "rest") for i in range(50)]
    got = result(spark, docs, [(0, 1, 1)])
    assert got["hot", "EABCD", 1][:3] == (3, 1997, 0) and got["hot", "EABCD", 1][4:6] == (0, 0)
    assert got["hot", "EABCD", 2][:3] == (0, 3, 1997) and got["hot", "EABCD", 2][4:6] == (3, 3)
    assert got["rest", "ABCDE", 5][:2] == (50, 0)


def test_empty_tables(spark):
    assert result(spark, [], LABELS) == {}
    assert len(result(spark, [(1, "x", "p")], [])) == 600
