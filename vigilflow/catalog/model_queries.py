"""Scoring and models."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.feature_queries import ENGINEERED_SELECT, KEYS
from vigilflow.catalog.registry import query
from vigilflow.functions.features import engineer
from vigilflow.operators import scoring as S
from vigilflow.operators.metrics import confusion, per_class
from vigilflow.plans.catalogue import class_table, feature_table
from vigilflow.plans.training import FlowClassifier, macro_f1, train_classifier
from vigilflow.session import cut_lineage, fresh_folder

_ENGINEERED = f"(SELECT {KEYS}, {ENGINEERED_SELECT} FROM flows_v)"
_GROUP = """CASE WHEN syn_flag_ratio > 0.5 THEN 'DDoS-family' WHEN fwd_bwd_pkt_ratio > 1000 THEN 'DoS-family' WHEN ack_syn_ratio > 3e8 THEN 'Brute-force'
       WHEN psh_flag_ratio > 0.25 THEN 'PortScan' WHEN slow_indicator > 3e6 THEN 'Bot' ELSE 'BENIGN' END"""


def _member(group: str) -> str:
    names = ", ".join(V.text(c) for c in sorted(L.GROUP_MEMBERS[group]))
    return f"([{names}])[1 + CAST(floor(CAST(duration_log AS DOUBLE)) AS BIGINT) % {len(L.GROUP_MEMBERS[group])}]"


_CLASS = (
    "CASE grp " + " ".join(f"WHEN {V.text(g)} THEN {_member(g)}" for g, m in L.GROUP_MEMBERS.items() if len(m) > 1) + " ELSE grp END"
)
_CONFIDENCE = """CASE WHEN grp IN ('DDoS-family', 'DoS-family', 'Brute-force') THEN
       round(0.5 + (CAST(duration_log AS DOUBLE) - floor(CAST(duration_log AS DOUBLE))) / 2, 4) ELSE 1.0 END"""


def _scored(spark, sf):
    return S.rule_score(engineer(V.flows(spark, sf)))


@query(
    "M6_F21_hierarchical_rules",
    f"""SELECT {KEYS}, grp AS group_pred, {_CLASS} AS attack_type, {_CONFIDENCE} AS confidence FROM (SELECT *, {_GROUP} AS grp FROM {_ENGINEERED})""",
)
def m6(spark, sf):
    return _scored(spark, sf).select(*V.FLOW_KEY, "group_pred", "attack_type", S.confidence("probabilities").alias("confidence"))


_TIE = ["duration_log", "slow_indicator", "pkts_per_duration", "bytes_per_duration"]


@query(
    "M8_prediction_rows",
    f"""SELECT CASE WHEN copy = 1 THEN id ELSE md5(id || '|' || copy) END AS id, attack_type, confidence, attack_type <> 'BENIGN' AS is_attack,
       {V.sql_severity('attack_type')} AS severity, 'rules' AS model FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY {', '.join(f'"{c}"' for c in _TIE)}) AS copy FROM
       (SELECT *, md5('rules|' || flow_key || '|' || flow_line || '|' || l_partkey || '|' || l_suppkey) AS id, {_CLASS} AS attack_type, {_CONFIDENCE} AS confidence
        FROM (SELECT *, {_GROUP} AS grp FROM {_ENGINEERED})))""",
)
def m8(spark, sf):
    at = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    rows = S.prediction_rows(_scored(spark, sf), V.FLOW_KEY, "rules", at, tie=_TIE)
    return rows.select("id", "attack_type", "confidence", "is_attack", "severity", "model")


@query(
    "O6_sorted_probabilities",
    """SELECT id, CASE WHEN id % 2 = 0 THEN 'DDoS' ELSE 'DDoS Volumetric' END AS first_class, 0.7::DOUBLE AS first_value,
       CASE WHEN id % 2 = 0 THEN 'DDoS Volumetric' ELSE 'DDoS' END AS second_class, 3 AS entries, 'b,c,a' AS features FROM pred""",
)
def o6(spark, sf):
    even = F.col("id") % 2 == 0
    probabilities = F.create_map(
        F.lit("DDoS"), F.when(even, 0.7).otherwise(0.2), F.lit("DDoS Amplification"), F.lit(None).cast("double"),
        F.lit("DDoS Volumetric"), F.when(even, 0.2).otherwise(0.7),
    )
    ranked = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(r).cast("int").alias("rank")) for n, r in (("a", None), ("b", 1), ("c", 4))])
    rows = V.predictions(spark, sf).select("id", S.sorted_probabilities(probabilities).alias("p"), S.best_ranked(ranked).alias("f"))
    first, second = F.get("p", 0), F.get("p", 1)
    return rows.select(
        "id", first["name"].alias("first_class"), first["value"].alias("first_value"), second["name"].alias("second_class"),
        F.size("p").alias("entries"), F.array_join(F.transform("f", lambda e: e["name"]), ",").alias("features"),
    )


@query(
    "F22_finite_maps",
    """SELECT id, CASE WHEN id % 3 = 0 THEN 0.0 ELSE confidence END AS a, 0.0::DOUBLE AS b, confidence AS back FROM pred""",
)
def f22(spark, sf):
    a = F.when(F.col("id") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("confidence"))
    cells = S.clean_map(F.create_map(F.lit("a"), a, F.lit("b"), F.lit(float("inf"))))
    rows = V.predictions(spark, sf).select("id", cells.alias("m"), F.to_json(F.create_map(F.lit("c"), "confidence")).alias("j"))
    back = F.from_json("j", "map<string,double>")
    return rows.select("id", F.col("m")["a"].alias("a"), F.col("m")["b"].alias("b"), back["c"].alias("back"))


@query(
    "A28_scaler",
    " UNION ALL ".join(
        f"""SELECT {V.text(c)} AS feature, round(avg("{c}"), 4) AS mean, round(stddev_pop("{c}"), 4) AS scale FROM flows_v""" for c in V.FLOW_FEATURES
    )
    + " UNION ALL SELECT 'constant', 7.0, 1.0",
)
def a28(spark, sf):
    rows = V.flows(spark, sf).withColumn("constant", F.lit(7.0))
    table = S.scaler_table(rows, [*V.FLOW_FEATURES, "constant"])
    return table.select("feature", F.round("mean", 4).alias("mean"), F.round("scale", 4).alias("scale"))


@query(
    "M5_scaled_features",
    f"""SELECT {KEYS}, round(("Total Fwd Packets" - (SELECT avg("Total Fwd Packets") FROM flows_v)) / (SELECT stddev_pop("Total Fwd Packets") FROM flows_v), 4) AS packets,
       round(("ACK Flag Count" - (SELECT avg("ACK Flag Count") FROM flows_v)) / (SELECT stddev_pop("ACK Flag Count") FROM flows_v), 4) AS acks FROM flows_v""",
)
def m5(spark, sf):
    rows = V.flows(spark, sf)
    names = ["Total Fwd Packets", "ACK Flag Count"]
    scaled = S.scale(rows, S.fit_scaler(rows, names))
    return scaled.select(
        *V.FLOW_KEY, F.round(F.col("`Total Fwd Packets`").cast("double"), 4).alias("packets"),
        F.round(F.col("`ACK Flag Count`").cast("double"), 4).alias("acks"),
    )


_IMPORTANCE_SQL = " UNION ALL ".join(
    f"""SELECT l_returnflag AS source, {V.text(c)} AS feature, round(stddev_pop({V.FLOW[c]}) / (1 + avg({V.FLOW[c]})), 4) AS importance FROM lineitem GROUP BY 1"""
    for c in V.FLOW_FEATURES
)


def _importance(spark, sf):
    """Per source (return flag) a spread measure as feature importance."""
    rows = V.table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("source"), *[F.expr(V.FLOW[c]).alias(c) for c in V.FLOW_FEATURES]
    )
    stats = rows.groupBy("source").agg(
        *[F.round(F.stddev_pop(F.col(f"`{c}`")) / (1 + F.avg(F.col(f"`{c}`"))), 4).alias(c) for c in V.FLOW_FEATURES]
    )
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").alias("importance")) for c in V.FLOW_FEATURES]))
    return stats.select("source", cells.alias("r")).select("source", "r.feature", "r.importance")


@query(
    "A27_S16_W5_feature_ranks",
    f"""SELECT feature, round(importance, 4) AS importance, row_number() OVER (ORDER BY round(importance, 4) DESC, feature) AS rank FROM
       (SELECT feature, sum(importance) AS importance FROM ({_IMPORTANCE_SQL}) GROUP BY 1)""",
)
def a27(spark, sf):
    path = fresh_folder(spark, "importance")
    _importance(spark, sf).write.mode("overwrite").partitionBy("source").option("header", True).csv(path)
    read = spark.read.option("header", True).schema("feature string, importance double").csv([f"{path}/source={s}" for s in "ANR"])
    ranked = S.rank_features(read)
    return ranked.select("feature", F.round("importance", 4).alias("importance"), F.col("rank").cast("long").alias("rank"))


@query(
    "O5_top_features",
    f"""SELECT feature AS name, row_number() OVER (ORDER BY round(importance, 4) DESC, feature) AS rank FROM
       (SELECT feature, sum(importance) AS importance FROM ({_IMPORTANCE_SQL}) GROUP BY 1) ORDER BY rank LIMIT 6""",
)
def o5(spark, sf):
    return feature_table(S.rank_features(_importance(spark, sf)), 6).withColumn("rank", F.col("rank").cast("long"))


_BEST = sorted(V.FLOW_FEATURES)[:8]
_RANKS = {name: len(_BEST) - i for i, name in enumerate(_BEST)}  # names and ranks run against each other
_TOP6 = sorted(_RANKS, key=_RANKS.get)[:6]


def _scaled_sql(name: str) -> str:
    spread = f"""(SELECT CASE WHEN stddev_pop("{name}") = 0 THEN 1 ELSE stddev_pop("{name}") END FROM flows_v)"""
    return f"""round(CAST(CAST(("{name}" - (SELECT avg("{name}") FROM flows_v)) / {spread} AS FLOAT) AS DOUBLE), 4)"""


@query(
    "M9_row_top_features",
    f"""SELECT {KEYS}, {V.text(",".join(f"{n}:{_RANKS[n]}" for n in _TOP6))} AS names, {", ".join(f"{_scaled_sql(n)} AS v{i}" for i, n in enumerate(_TOP6))} FROM flows_v""",
)
def m9(spark, sf):
    rows = V.flows(spark, sf)
    scaled = S.scale(rows, S.fit_scaler(rows, V.FLOW_FEATURES)).withColumn("top", S.top_features(V.FLOW_FEATURES, _RANKS))
    names = F.array_join(F.transform("top", lambda e: F.concat_ws(":", e["name"], e["rank"].cast("string"))), ",")
    values = [F.get("top", i)["value"].alias(f"v{i}") for i in range(len(_TOP6))]
    return scaled.select(*V.FLOW_KEY, names.alias("names"), *values)


@query(
    "M12_class_catalogue",
    f"""SELECT CAST(c.code AS INTEGER) AS code, c.class, {V.sql_group('c.class')} AS "group", {V.sql_severity('c.class')} AS severity, count(p.id) AS n
       FROM (SELECT unnest([{', '.join(V.text(c) for c in L.TARGET_CLASSES)}]) AS class, unnest(range({len(L.TARGET_CLASSES)})) AS code) c
       LEFT JOIN pred p ON p.attack_type = c.class GROUP BY ALL""",
)
def m12(spark, sf):
    seen = V.predictions(spark, sf).groupBy(F.col("attack_type").alias("class")).agg(F.count(F.lit(1)).alias("c"))
    rows = class_table(spark).join(seen, "class", "left")
    return rows.select("code", "class", "group", "severity", F.coalesce("c", F.lit(0)).alias("n"))


# One small forest per session and data folder serves the learned-model queries.
_SMALL = [{"numTrees": 4, "maxDepth": 5}, {"numTrees": 3, "maxDepth": 3}]
_TRAINED: dict[tuple[str, str], tuple] = {}


def _trained(spark, sf):
    slot = (spark.sparkContext.applicationId, sf)
    if slot not in _TRAINED:
        rows = V.learnable_flows(spark, sf)
        _TRAINED[slot] = train_classifier(rows, V.FLOW_FEATURES, V.FLOW_KEY, space=_SMALL, largest=2000, smallest=200)
    return _TRAINED[slot]


def _judged(spark, model, test):
    """Truth and prediction of the test rows, stored: each report reads them several times."""
    return cut_lineage(spark, model.transform(test.drop(*L.ENGINEERED_FEATURES)).select("Label", "attack_type"))


@query("M2_M3_trained_classifier")
def m2(spark, sf):
    model, test, _ = _trained(spark, sf)
    return per_class(confusion(_judged(spark, model, test), "Label", "attack_type"))


@query("M4_search_log")
def m4(spark, sf):
    _, _, log = _trained(spark, sf)
    return spark.createDataFrame(
        [(e["model"], e["trial"], e["numTrees"], e["maxDepth"], e["f1_macro"]) for e in log],
        "model string, trial int, num_trees int, max_depth int, f1_macro double",
    )


@query("M7_M8_learned_scoring")
def m7(spark, sf):
    model, _, _ = _trained(spark, sf)
    rows = S.prediction_rows(model.transform(V.flows(spark, sf)), V.FLOW_KEY, model.name, F.lit(V.AS_OF).cast("timestamp_ntz"))
    return rows.select("id", "attack_type", "group_pred", "confidence", "severity", F.to_json("probabilities").alias("probabilities"),
                       F.to_json("top_features").alias("top_features"))


@query("M11_S15_stored_model_and_report")
def m11(spark, sf):
    from vigilflow.plans.evaluation import evaluate, save_evaluation

    model, test, _ = _trained(spark, sf)
    path = fresh_folder(spark, "model")
    model.save(path)
    save_evaluation(evaluate(_judged(spark, FlowClassifier.load(path), test), "Label", "attack_type"), f"{path}/report")
    return spark.read.json(f"{path}/report/summary")


# The learned model has no SQL form; these give properties that any good model has.


@query("M2_M3_model_quality", "SELECT true AS beats_floor, true AS known_classes, 1::BIGINT AS tests")
def m2_quality(spark, sf):
    model, test, _ = _trained(spark, sf)
    judged = _judged(spark, model, test)
    floor = macro_f1(judged, "Label", "attack_type") > 0.5
    known = F.bool_and(F.col("attack_type").isin(L.TARGET_CLASSES)).alias("known_classes")
    return judged.agg(F.lit(floor).alias("beats_floor"), known, F.sign(F.count(F.lit(1))).cast("long").alias("tests"))


@query(
    "M4_search_covers_space",
    f"SELECT trial, num_trees, max_depth, true AS every_model, true AS valid FROM (VALUES {', '.join(f'({i}, {p['numTrees']}, {p['maxDepth']})' for i, p in enumerate(_SMALL))}) t(trial, num_trees, max_depth)",
)
def m4_space(spark, sf):
    rows = m4(spark, sf)
    models = 1 + len(_trained(spark, sf)[0].level2)
    return rows.groupBy("trial", "num_trees", "max_depth").agg(
        (F.count_distinct("model") == models).alias("every_model"), F.bool_and(F.col("f1_macro").between(0, 1)).alias("valid")
    )


@query(
    "M7_M8_scoring_properties",
    "SELECT count(*) AS scored, 0::BIGINT AS foreign_classes, 0::BIGINT AS wrong_confidence, 0::BIGINT AS unsure_singletons, true AS unique_ids FROM lineitem",
)
def m7_properties(spark, sf):
    rows = m7(spark, sf).withColumn("p", F.from_json("probabilities", "map<string,double>"))
    members = F.create_map(*[x for g, names in L.GROUP_MEMBERS.items() for x in (F.lit(g), F.array(*[F.lit(n) for n in names]))])
    own = members[F.col("group_pred")]
    return rows.agg(
        F.count(F.lit(1)).alias("scored"),
        F.count_if(~F.array_contains(own, F.col("attack_type"))).alias("foreign_classes"),
        F.count_if(F.col("confidence") != F.round(F.array_max(F.map_values("p")), 4)).alias("wrong_confidence"),
        F.count_if((F.size(own) == 1) & (F.col("confidence") != 1.0)).alias("unsure_singletons"),
        (F.count_distinct("id") == F.count(F.lit(1))).alias("unique_ids"),
    )


@query("M11_reloaded_model_agrees", "SELECT count(*) AS compared, 0::BIGINT AS different FROM lineitem")
def m11_reloaded(spark, sf):
    model, _, _ = _trained(spark, sf)
    path = fresh_folder(spark, "model")
    model.save(path)
    flows, at = V.flows(spark, sf), F.lit(V.AS_OF).cast("timestamp_ntz")
    first, again = (S.prediction_rows(m.transform(flows), V.FLOW_KEY, model.name, at).select("id", "attack_type") for m in (model, FlowClassifier.load(path)))
    both = first.join(again.withColumnRenamed("attack_type", "second"), "id")
    return both.agg(F.count(F.lit(1)).alias("compared"), F.count_if(F.col("attack_type") != F.col("second")).alias("different"))
