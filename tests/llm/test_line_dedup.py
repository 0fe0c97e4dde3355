from collections import Counter, defaultdict
from os.path import commonprefix

import duckdb
from pyspark.sql import functions as F

from tools.check import rows_of
from vigilflow.llm import line_dedup
from vigilflow.llm.line_dedup import dedup_lines, suffix_array
from vigilflow.llm.queries import ORACLES


def brute(rows, least):
    """First copies stay by (key, line); the rows have distinct keys."""
    lines = {k: (t or "").split("\n") for k, t in rows}
    places = defaultdict(list)
    for k in sorted(lines):
        for i in range(len(lines[k]) - least + 1):
            places[tuple(lines[k][i : i + least])].append((k, i))
    gone = {(k, i + d) for found in places.values() for k, i in found[1:] for d in range(least)}
    return {k: ("\n".join(x for i, x in enumerate(ls) if (k, i) not in gone), sum((k, i) in gone for i in range(len(ls)))) for k, ls in lines.items()}


ROWS = [
    (1, "a\nb\nc\nd\ne"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "a\nb\nc\nd\ne"), (5, "q\nq\nq\nq\nq\nq"), (6, ""), (7, None),
    (8, "c\nd\ne\nc\nd\ne"), (9, "\n\n\n\n"), (10, "z\n\n\n\nz"), (11, "b\nc\nd"), (12, "\n".join(f"line {i % 700}" for i in range(3000))),
]


def test_equals_brute_force(spark):
    frame = spark.createDataFrame(ROWS, "doc_id long, text string")
    for least in (1, 2, 3, 5):
        got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in dedup_lines(frame, min_lines=least).collect()}
        assert got == brute(ROWS, least), least


def test_repeated_rows_null_keys_and_clashing_columns(spark):
    rows = [(1, "a\nb\nc", 7, "x"), (1, "a\nb\nc", 7, "x"), (None, "a\nb\nc", 8, "y"), (2, "d\na\nb\nc", 9, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, n_removed long, _h string")
    got = sorted((str(r["doc_id"]), r["text"], r["n_removed"], r["_h"]) for r in dedup_lines(frame).collect())
    # The null key comes first, so it keeps the lines; equal rows have one result.
    assert got == [("1", "", 3, "x"), ("1", "", 3, "x"), ("2", "d", 3, None), ("None", "a\nb\nc", 0, "y")]


def test_empty_table(spark):
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_runs_of_many_words(spark):
    passage, half, other = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 51), ("h", 30), ("o", 30)))
    fifty = " ".join(f"f{i}" for i in range(50))
    rows = [
        (1, passage), (2, f"{passage}\nx"), (3, f"y\n{half}\n{other}\nz"), (4, f"{half}\n{other}"), (5, half), (6, other),
        (7, fifty), (8, fifty), (9, f"{passage}\n{passage}"), (10, passage), (10, passage),
    ]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in dedup_lines(frame).collect()}
    assert got == {
        1: (passage, 0, 0), 2: ("x", 1, 1), 3: (f"y\n{half}\n{other}\nz", 0, 0), 4: ("", 2, 1), 5: (half, 0, 0), 6: (other, 0, 0),
        7: (fifty, 0, 0), 8: (fifty, 0, 0), 9: ("", 2, 1), 10: ("", 1, 1),
    }
    deep = {r["doc_id"]: r["n_removed"] for r in dedup_lines(frame.where("doc_id in (3, 4)"), min_lines=5, long_words=59).collect()}
    assert deep == {3: 0, 4: 2}


PASSAGES = ORACLES["op2_line_dedup"]


def test_long_passages_equal_sql(spark):
    path = "/root/testdata/sf0.001/documents.parquet"
    frame = dedup_lines(spark.read.parquet(path).select("doc_id", "text"))
    result = duckdb.sql(PASSAGES.replace("FROM documents", f"FROM '{path}'"))
    rows = [tuple(r) for r in frame.collect()]
    assert rows_of(frame.columns, rows) == rows_of(result.columns, result.fetchall())
    by_lines = dedup_lines(spark.read.parquet(path).select("doc_id", "text"), long_words=None)
    assert {r["doc_id"]: r["n_removed"] for r in by_lines.collect()} != {r[0]: r[3] for r in rows}


def test_suffix_array_and_common_prefixes(spark):
    rows = [*ROWS[:11], (12, "\n".join(f"l{i % 5}" for i in range(20))), (13, "p\nq1\na\nb\nc\nd"), (14, "p\nq2\na\nb\nc"), (14, "p\nq2\na\nb\nc")]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffix_array(frame, "doc_id", "text").orderBy("_part", "_rank", "doc_id", "_h", "_line").collect()
    lines = {k: (t or "").split("\n") for k, t in rows}
    often = Counter(line for k, t in rows for line in (t or "").split("\n"))
    assert sorted((r["doc_id"], r["_line"]) for r in got) == sorted((k, i) for k, ls in lines.items() for i, x in enumerate(ls) if often[x] > 1)
    suffixes = [lines[r["doc_id"]][r["_line"] :] for r in got]
    common = [len(commonprefix([a, b])) for a, b in zip(suffixes, suffixes[1:])]
    assert [r["_lcp"] for r in got] == [0, *common]
    # In a sorted array the longest common prefix of any suffix is one with a neighbour.
    for i, suffix in enumerate(suffixes):
        longest = max(len(commonprefix([suffix, other])) for j, other in enumerate(suffixes) if i != j)
        assert max([0, *common][i], [*common, 0][i]) == longest


def test_one_very_long_line_and_one_very_long_document(spark):
    line, passage = "w " * 500_000, "\n".join(f"line {i}" for i in range(3_000))
    rows = [(1, line), (2, f"x\n{line}"), (3, passage), (4, f"y\n{passage}\nz")]
    got = {r["doc_id"]: (r["text"], r["n_removed"], r["n_runs"]) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (line, 0, 0), 2: ("x", 1, 1), 3: (passage, 0, 0), 4: ("y\nz", 3_000, 1)}


def test_words_and_lines_of_odd_blanks(spark):
    texts = ["", " ", "a", " a", "a ", "a b", "a  b", "a\tb", "a\x0bb", "a\fb", "a\r", "\n", "a\nb c\n", "é\u00a0ü \u2003 x", "日本 語", "a\x00b c", "a b c d"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    text = F.col("t")
    got = frame.select("t", line_dedup._words(text), F.regexp_count(text, F.lit(line_dedup.WORD)), line_dedup._n_lines(text)).collect()
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[2], r[0].count("\n") + 1) for r in got]


def test_each_text_is_split_once_and_travels_once(spark, monkeypatch):
    """The cost of the first and of the last step, which read all texts: what they compute of a text and what they shuffle."""
    plans, stored = {}, line_dedup.stored

    def noted(frame, label):
        plans[label] = frame._jdf.queryExecution().optimizedPlan().toString()
        return stored(frame, label)

    monkeypatch.setattr(line_dedup, "stored", noted)
    out = dedup_lines(spark.createDataFrame([(1, "a\nb\nc"), (2, "a\nb\nc")], "doc_id long, text string"))
    assert "lambdafunction" not in plans["lines"] and plans["lines"].count("split(") == 1
    assert "text, text#" not in out._jdf.queryExecution().optimizedPlan().toString()
