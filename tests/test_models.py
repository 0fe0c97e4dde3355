"""Training, search, scoring and storage of the learned classifier."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import QUERIES, views as V
from vigilflow.catalog.model_queries import _trained
from vigilflow.plans.training import FlowClassifier, search_space

FOLDER = "/root/testdata/sf0.001"


def test_search_space_is_seeded_and_without_repeats():
    assert search_space(5, 1) == search_space(5, 1)
    assert len({tuple(p.items()) for p in search_space(5, 1)}) == 5


def test_training_after_an_observed_write_and_reload(spark, tmp_path):
    QUERIES["S4_alert_append"](spark, FOLDER).collect()  # the session has observed metrics now
    model, test, log = _trained(spark, FOLDER)
    assert set(model.level2) <= set(L.GROUP_MEMBERS) and len(log) >= 2
    model.save(str(tmp_path))
    rows = V.flows(spark, FOLDER)
    scored, again = (m.transform(rows) for m in (model, FlowClassifier.load(str(tmp_path))))
    assert scored.filter(~F.col("attack_type").isin(L.TARGET_CLASSES)).count() == 0
    pick = [*V.FLOW_KEY, "attack_type"]
    assert scored.select(pick).exceptAll(again.select(pick)).count() == 0
    assert scored.count() == rows.count()
