"""Evaluation metrics."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.operators import metrics as M
from vigilflow.plans.evaluation import evaluate, save_evaluation
from vigilflow.session import fresh_folder

METRICS = [
    "accuracy", "precision_weighted", "recall_weighted", "f1_weighted", "f1_macro", "auc", "false_alarm_rate",
    "level1_accuracy", "level1_f1",
]


def _classes_sql(source: str, truth: str = "truth", pred: str = "pred", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    match = f" AND t.{by} = p.{by}" if by else ""
    return f"""(SELECT {f'coalesce(t.{by}, p.{by}) AS {by}, ' if by else ''}coalesce(t.c, p.c) AS class, coalesce(t.n, 0) AS support, coalesce(p.n, 0) AS predicted, coalesce(t.h, 0) AS hits
       FROM (SELECT {lead}{truth} AS c, count(*) AS n, count(*) FILTER ({truth} = {pred}) AS h FROM {source} GROUP BY ALL) t
       FULL JOIN (SELECT {lead}{pred} AS c, count(*) AS n FROM {source} GROUP BY ALL) p ON t.c = p.c{match})"""


_P = "CASE WHEN predicted > 0 THEN hits / predicted ELSE 0 END"
_R = "CASE WHEN support > 0 THEN hits / support ELSE 0 END"
_F1 = f"CASE WHEN hits > 0 THEN 2 * ({_P}) * ({_R}) / (({_P}) + ({_R})) ELSE 0 END"


def _summary_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    total = f"sum(support) OVER (PARTITION BY {by})" if by else "sum(support) OVER ()"
    return f"""SELECT {lead}CAST(sum(support) AS BIGINT) AS "rows", round(sum(hits) / sum(support), 6) AS accuracy,
       round(sum(p * support) / sum(support), 6) AS precision_weighted, round(sum(r * support) / sum(support), 6) AS recall_weighted,
       round(sum(f * support) / sum(support), 6) AS f1_weighted, round(avg(f), 6) AS f1_macro,
       CASE WHEN min(support) > 0 AND min(total - support) > 0 THEN
       round(sum(support * (r + (total - support - predicted + hits) / (total - support)) / 2) / sum(support), 6) END AS auc,
       round(max(CASE WHEN class = 'BENIGN' THEN 1 - hits / support END), 6) AS false_alarm_rate
       FROM (SELECT *, {total} AS total, {_P} AS p, {_R} AS r, {_F1} AS f FROM {_classes_sql(source, by=by)}) {group}"""


_GROUPED = f"(SELECT *, {V.case('truth', L.CLASS_TO_GROUP)} AS gt, {V.case('pred', L.CLASS_TO_GROUP)} AS gp FROM labelled_v)"


def _level1_sql(by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {lead}round(sum(hits) / sum(support), 6) AS level1_accuracy, round(sum(({_F1}) * support) / sum(support), 6) AS level1_f1
       FROM {_classes_sql(_GROUPED, 'gt', 'gp', by)} {group}"""


def _rounded(df, *names):
    return df.select(*[F.round(c, 6).alias(c) if c in METRICS else F.col(c) for c in (names or df.columns)])


@query(
    "A11_batch_accuracy",
    "SELECT round(count(*) FILTER (truth = pred) / count(*), 4) AS accuracy FROM labelled_v",
)
def a11(spark, sf):
    return M.batch_accuracy(V.labelled(spark, sf), "truth", "pred")


@query("A12_false_alarm_rate", "SELECT round(avg(CASE WHEN pred <> 'BENIGN' THEN 1 ELSE 0 END), 6) AS false_alarm_rate FROM labelled_v WHERE truth = 'BENIGN'")
def a12(spark, sf):
    return _rounded(M.summary(M.confusion(V.labelled(spark, sf))), "false_alarm_rate")


@query(
    "A13_confusion",
    """SELECT truth, pred, count(*) AS n, round(count(*) / (sum(count(*)) OVER (PARTITION BY truth) + 1e-8), 6) AS share FROM labelled_v GROUP BY 1, 2""",
)
def a13(spark, sf):
    return M.normalised(M.confusion(V.labelled(spark, sf))).withColumn("share", F.round("share", 6))


@query(
    "A13_confusion_wide",
    "SELECT truth, " + ", ".join(f"""count(*) FILTER (pred = {V.text(c)}) AS "{c}\"""" for c in L.TARGET_CLASSES) + " FROM labelled_v GROUP BY 1",
)
def a13_wide(spark, sf):
    return M.wide(M.confusion(V.labelled(spark, sf)), L.TARGET_CLASSES)


@query(
    "A14_per_class",
    f'SELECT class, support, predicted, hits, round({_P}, 6) AS "precision", round({_R}, 6) AS recall, round({_F1}, 6) AS f1 FROM {_classes_sql("labelled_v")}',
)
def a14(spark, sf):
    rows = M.per_class(M.confusion(V.labelled(spark, sf)))
    return rows.withColumns({c: F.round(c, 6) for c in ("precision", "recall", "f1")})


@query("A15_A16_summary", _summary_sql("labelled_v"))
def a15(spark, sf):
    return _rounded(M.summary(M.confusion(V.labelled(spark, sf))))


@query("A17_level1_metrics", _level1_sql())
def a17(spark, sf):
    return _rounded(M.report(V.labelled(spark, sf)), "level1_accuracy", "level1_f1")


@query("A18_M10_report_per_phase", f"SELECT s.*, l.level1_accuracy, l.level1_f1 FROM ({_summary_sql('labelled_v', 'phase')}) s JOIN ({_level1_sql('phase')}) l ON s.phase = l.phase")
def a18(spark, sf):
    return _rounded(M.report(V.labelled(spark, sf), by=("phase",)))


@query(
    "S15_stored_reports",
    f"""SELECT s.phase, 'all' AS class, CAST(s."rows" AS BIGINT) AS n, s.f1_weighted AS f1, l.level1_f1 FROM ({_summary_sql('labelled_v', 'phase')}) s
       JOIN ({_level1_sql('phase')}) l ON s.phase = l.phase
       UNION ALL SELECT phase, class, support, round({_F1}, 6), NULL FROM {_classes_sql('labelled_v', by='phase')}""",
)
def s15(spark, sf):
    """The files of an evaluation, read again: a row per phase, a row per phase and class."""
    parts, path = evaluate(V.labelled(spark, sf), by=("phase",)), fresh_folder(spark, "report")
    save_evaluation(parts, path)
    whole, classes = (spark.read.schema(parts[name].schema).json(f"{path}/{name}") for name in ("summary", "classes"))
    rows = whole.select("phase", F.lit("all").alias("class"), F.col("rows").alias("n"), F.col("f1_weighted").alias("f1"), "level1_f1")
    rows = rows.unionByName(classes.select("phase", "class", F.col("support").alias("n"), "f1", F.lit(None).cast("double").alias("level1_f1")))
    return rows.withColumns({c: F.round(c, 6) for c in ("f1", "level1_f1")})


@query("A19_class_distribution", "SELECT truth, count(*) AS n, count(*) / max(count(*)) OVER () AS share_of_max FROM labelled_v GROUP BY 1")
def a19(spark, sf):
    return M.class_distribution(V.labelled(spark, sf), "truth")


@query("F25_correct_flag", "SELECT id, truth = pred AS correct FROM labelled_v")
def f25(spark, sf):
    return V.labelled(spark, sf).select("id", F.col("truth").eqNullSafe(F.col("pred")).alias("correct"))


@query("J7_J8_reattach_by_key", "SELECT p.id, p.attack_type, p.vlan_id, p.flow_direction, 'rspan' AS input_path, l.truth FROM placed p JOIN labelled_v l ON p.id = l.id")
def j7(spark, sf):
    rows = V.placed_predictions(spark, sf)
    results = rows.select("id", "attack_type")
    requests = rows.select("id", "vlan_id", "flow_direction", F.lit("rspan").alias("input_path"))
    return results.join(requests, "id", "left").join(V.labelled(spark, sf).select("id", "truth"), "id", "left")
