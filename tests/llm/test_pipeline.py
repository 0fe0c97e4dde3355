"""The pipeline on small tables; its stages on cases planted in them."""

import pytest

import corpus_pipeline as pipeline
from vigilflow.llm.common import stored

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def results(spark):
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, FOLDER), name)
        out.append((name, docs))
    return out


def test_stages_keep_the_columns_and_only_drop_rows(spark, results):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    for name, frame in results[:-1]:
        assert frame.columns == docs.columns and frame.schema == docs.schema
        now = {r["doc_id"]: r for r in frame.collect()}
        assert now.keys() <= before.keys() and len(now) > 0.8 * len(before), name
        same = [k for k in now if now[k] == before[k]]
        assert name == "line_dedup" or len(same) == len(now)
        assert all(r["n_chars"] == len(r["text"]) for k, r in now.items() if k not in same)
        before = now


def test_run_packs_what_the_stages_keep(spark, results):
    kept = {r["doc_id"] for r in results[-2][1].select("doc_id").collect()}
    pieces = pipeline.run(spark, FOLDER).collect()
    assert {r["doc_id"] for r in pieces} == kept
    assert sorted(map(tuple, pieces))[:50] == sorted(map(tuple, results[-1][1].collect()))[:50]


def test_leaks_and_copies_go_clean_documents_stay(spark):
    stages = dict(pipeline.STAGES)
    item = spark.read.parquet(f"{FOLDER}/benchmark.parquet").first()["text"]
    clean = " ".join(f"clean{i}" for i in range(200))
    near = clean.replace("clean100", "dirty")
    leak = " ".join(f"own{i}" for i in range(200)) + "\n" + item
    rows = [(1, clean, "en", "s", 1), (2, near, "en", "s", 1), (3, leak, "en", "s", 1), (4, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r["doc_id"] for r in stages["near_dedup"](spark, docs, FOLDER).collect()} == {1, 3, 4}
    assert {r["doc_id"] for r in stages["decontamination"](spark, docs, FOLDER).collect()} == {1, 2, 4}
    block = "first line of it\nsecond line of it\nthird line of it"
    lines = spark.createDataFrame([(1, block, "", "", 1), (2, "own\n" + block, "", "", 2), (3, block, "", "", 3), (4, "", "", "", 0)], docs.schema)
    got = {r["doc_id"]: r["text"] for r in stages["line_dedup"](spark, lines, FOLDER).collect()}
    assert got == {1: block, 2: "own", 4: ""}
    for name in ("line_dedup", "near_dedup", "decontamination", "packing"):
        assert stages[name](spark, docs.limit(0), FOLDER).collect() == []
