import random

import numpy as np

from vigilflow.llm.decontaminate import decontaminate, leaks, tiles


def naive(text, item, least):
    """Greedy tiling by trying all places, longest first, ties by place in the item, then in the text."""
    used_text, used_item, out = [False] * len(text), [False] * len(item), []
    while True:
        best = None
        for j in range(len(item)):
            for i in range(len(text)):
                n = 0
                while i + n < len(text) and j + n < len(item) and text[i + n] == item[j + n] and not used_text[i + n] and not used_item[j + n]:
                    n += 1
                if n >= least and (best is None or n > best[2]):
                    best = (i, j, n)
        if best is None:
            return out
        out.append(best)
        for d in range(best[2]):
            used_text[best[0] + d] = used_item[best[1] + d] = True


def test_tiles_equal_naive_tiling():
    r = random.Random(6)
    for _ in range(200):
        text, item = ([r.randint(0, 3) for _ in range(r.randint(0, 40))] for _ in range(2))
        seeds = [(i, j) for i in range(len(text) - 2) for j in range(len(item) - 2) if text[i : i + 3] == item[j : j + 3]]
        found = tiles(np.array(text, np.uint64), np.array(item, np.uint64), seeds, 3)
        assert sorted(found) == sorted(naive(text, item, 3))


ITEM = [f"word{i}" for i in range(40)]


def test_copied_moved_and_changed_passages(spark):
    filler = " ".join(f"other{i}" for i in range(300))
    moved = ITEM[30:] + ITEM[:15] + ["gap"] + ITEM[15:30]
    rows = [
        (1, f"{filler} {' '.join(ITEM)} {filler}"), (2, " ".join(moved).upper() + "!"), (3, ", ".join(ITEM[:19])), (4, "\n".join(ITEM[:20])),
        (5, " x ".join(" ".join(ITEM[i : i + 4]) for i in range(0, 40, 4))), (6, None), (7, ""), (None, " ".join(ITEM)), (1, filler),
        (8, (" ".join(ITEM[:10]) + " ") * 50),
    ]
    docs = spark.createDataFrame([(*r, "k") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(1, " ".join(ITEM)), (2, "too short"), (3, None), (3, "")], "item_id long, text string")
    for chars in (1 << 20, 50):
        got = {r["doc_id"]: (r["coverage"], r["n_tiles"], r["longest"]) for r in leaks(docs, items, block_chars=chars).collect()}
        assert got == {1: (1.0, 1, 40), 2: (1.0, 3, 15), 4: (0.5, 1, 20), None: (1.0, 1, 40)}
        left = decontaminate(docs, items, block_chars=chars)
        assert left.columns == docs.columns
        assert sorted(str(r["doc_id"]) for r in left.collect()) == ["1", "3", "5", "6", "7", "8"]


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert leaks(docs, items.limit(0)).collect() == [] and leaks(docs.limit(0), items).collect() == []
    assert decontaminate(docs, items.limit(0)).count() == 1 and decontaminate(docs, items).count() == 0
