import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilflow.llm import toxicity as tox

FOLDER = "/root/testdata/sf0.1"


def test_gradients():
    r = np.random.default_rng(1)
    model = tox.Model.fresh()
    mask = np.array([[1, 1, 1], [1, 1, 0], [1, 0, 0], [0, 0, 0]], np.float32)
    x, slope = r.standard_normal((4, 3, tox.INPUTS)), np.array([1.0, -2, 0.5])

    def loss():
        logits, tape = model.forward(model.gates(x), mask, keep=True)
        return float((logits * slope).sum()), tape

    grads, d_gates = model.backward(loss()[1], slope)
    for way in "fb":
        grads[f"{way}x"], grads[f"{way}0"] = np.einsum("tnx,tng->xg", x, d_gates[way]), d_gates[way].sum(axis=(0, 1))
    for name, weights in model.weights.items():
        direction = r.standard_normal(weights.shape).astype(np.float32)
        start = weights.copy()
        sides = []
        for step in (1e-2, -1e-2):
            model.weights[name] = start + step * direction
            sides.append(loss()[0])
        model.weights[name] = start
        want = float((grads[name] * direction).sum())
        assert abs((sides[0] - sides[1]) / 2e-2 - want) < 2e-2 * max(1, abs(want)), name


def test_windows_cover_all_words():
    for n in (0, 1, 63, 64, 65, 112, 113, 500):
        first, size, owner = tox.windows(np.zeros(n, np.int64), 2)
        covered = set()
        for a, b in zip(first[owner == 0], size[owner == 0]):
            covered |= set(range(a, a + b))
        assert covered == set(range(n)) and size.max(initial=0) <= tox.WINDOW and (owner == 1).sum() == 1


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("documents", "labels"))
    model = tox.fit(docs, labels)
    return model, tox.score(docs, model).join(labels, "doc_id").toPandas()


def test_held_out_accuracy(scored):
    found = scored[1]
    rest = found[found.held_out]
    assert (rest.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    hits = ((rest.predicted == 1) & (rest.toxic == 1)).sum()
    assert hits / (rest.toxic == 1).sum() > 0.85 and hits / (rest.predicted == 1).sum() > 0.8
    assert ((found.predicted == 1) == (found.score >= 0.3)).all() and found.score.between(0, 1).all()


def test_odd_rows(spark, scored):
    model = scored[0]
    rows = [(1, None, 1), (2, "", 2), (3, "... !!", 3), (4, "idiot moron scum clown loser trash", 4), (4, "idiot moron scum clown loser trash", 5), (None, "the thing is on", 6)]
    rows += [(9, "the thing is on " * 20_000 + "idiot moron scum clown loser trash " + "the thing is on " * 20_000, 7)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, score int")
    got = {(r["doc_id"]): r for r in tox.score(frame, model).collect()}
    assert got[1]["score"] == got[2]["score"] == got[3]["score"] == pytest.approx(model.rate)
    assert got[4]["predicted"] == 1 and got[9]["score"] > got[None]["score"] and not got[None]["held_out"]
    left = tox.remove_toxic(frame, model)
    assert left.columns == frame.columns and {1, 2, 3, 6} <= {r["score"] for r in left.collect()} and left.where("score in (4, 5)").count() == 0
    assert tox.score(frame.limit(0), model).collect() == []


def test_without_two_labels(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c d")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0), (2, None), (None, 1)], "doc_id long, toxic int")
    for some in (labels, labels.limit(0)):
        assert {r["predicted"] for r in tox.score(docs, tox.fit(docs, some)).collect()} == {0}
    assert tox.train(["x"], np.array([1]), 1.0).rate == pytest.approx(0.999)
    assert len(tox.Scorer(tox.Model.fresh()).scores(pa.array([], pa.string()))) == 0


def test_the_sample_stays_out_of_the_driver(spark, monkeypatch):
    rows = [(i, f"idiot moron scum {i}" if i % 3 == 0 else f"the thing is on {i}", i % 3 == 0) for i in range(300)]
    frame = spark.createDataFrame([(i, text, int(toxic)) for i, text, toxic in rows], "doc_id long, text string, toxic int").repartition(5)
    seen, collect = [], type(frame).collect
    monkeypatch.setattr(type(frame), "collect", lambda self: (seen.append(self.columns), collect(self))[1])
    model = tox.fit(frame.select("doc_id", "text"), frame.select("doc_id", "toxic"))
    assert seen and not any("_text" in columns for columns in seen)
    monkeypatch.undo()
    order = [r["doc_id"] for r in frame.where(~tox.held_out("doc_id")).orderBy(F.xxhash64("doc_id")).collect()]
    labels = np.array([int(rows[i][2]) for i in order])
    want = tox.train([rows[i][1] for i in order], labels, labels.mean())
    assert all((model.weights[name] == want.weights[name]).all() for name in want.weights)
    assert (model.char == want.char).all() and (model.head == want.head).all() and model.shift == want.shift and model.rate == want.rate
