"""Prediction history."""

from pyspark.sql import functions as F

from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.operators import history as H
from vigilflow.session import fresh_folder
from vigilflow.sources import sinks

NOON = "2024-01-30 12:00:00"


@query("P8_filter", "SELECT id, created_at, attack_type, severity FROM pred WHERE severity = 'critical' AND is_attack")
def p8(spark, sf):
    return H.matching(V.predictions(spark, sf), "critical", True).select("id", "created_at", "attack_type", "severity")


def _window(name: str, interval: str | None, cut: str | None = None):
    start = cut or f"TIMESTAMP '{NOON}' - INTERVAL {interval}"
    where = f"WHERE created_at >= {start}" if interval else ""

    @query(f"P10_window_{name}", f"SELECT id, created_at, severity FROM pred {where}")
    def run(spark, sf):
        return H.within(V.predictions(spark, sf), NOON, name).select("id", "created_at", "severity")


for _name, _interval in (("1h", "1 HOUR"), ("24h", "24 HOUR"), ("7d", "7 DAY"), ("30d", "30 DAY"), ("all", None)):
    _window(_name, _interval)


@query("P10_window_legacy_text", f"SELECT id, created_at FROM pred WHERE created_at >= date_trunc('day', TIMESTAMP '{NOON}' - INTERVAL 1 HOUR)")
def p10_legacy(spark, sf):
    return H.within(V.predictions(spark, sf), NOON, "1h", legacy_text=True).select("id", "created_at")


@query(
    "P14_live_filter",
    """SELECT id, src_ip, dst_ip, severity FROM pred WHERE is_attack AND (contains(lower(src_ip), '10.1') OR contains(lower(dst_ip), '10.1'))""",
)
def p14(spark, sf):
    return H.live_filter(V.predictions(spark, sf), "attacks", " 10.1 ").select("id", "src_ip", "dst_ip", "severity")


@query("P15_result_filter", "SELECT id, src_ip FROM pred WHERE attack_type = 'PortScan' AND severity = 'medium' AND contains(src_ip, '.113.')")
def p15(spark, sf):
    return H.result_filter(V.predictions(spark, sf), "PortScan", "medium", ".113.").select("id", "src_ip")


@query(
    "P16_retention",
    f"""SELECT id, created_at, (SELECT count(*) FROM pred WHERE created_at < TIMESTAMP '{NOON}' - INTERVAL 10 DAY) AS deleted
       FROM pred WHERE created_at >= TIMESTAMP '{NOON}' - INTERVAL 10 DAY""",
)
def p16(spark, sf):
    path = fresh_folder(spark, "retention")
    rows = V.predictions(spark, sf).select("id", "created_at", "attack_type").withColumn("event_date", F.to_date("created_at"))
    rows.write.mode("overwrite").partitionBy("event_date").parquet(path)
    deleted = sinks.retain(spark, path, NOON, 10)
    return sinks.read_predictions(spark, path).select("id", "created_at", F.lit(deleted).cast("long").alias("deleted"))


@query("P17_clear_all", "SELECT id, created_at, attack_type, CAST(created_at AS DATE) AS event_date FROM pred WHERE false")
def p17(spark, sf):
    path = fresh_folder(spark, "cleared")
    rows = V.predictions(spark, sf).select("id", "created_at", "attack_type").withColumn("event_date", F.to_date("created_at"))
    rows.write.mode("overwrite").partitionBy("event_date").parquet(path)
    sinks.clear(spark, path)
    return sinks.read_predictions(spark, path)


@query(
    "P18_schema_evolution",
    """SELECT id, attack_type, CAST(CASE WHEN id % 2 = 0 THEN vlan_id END AS INTEGER) AS vlan_id,
       CAST(CASE WHEN id % 2 = 0 THEN src_vlan END AS INTEGER) AS src_vlan, CAST(NULL AS INTEGER) AS protocol FROM placed""",
)
def p18(spark, sf):
    rows = V.placed_predictions(spark, sf).select("id", "attack_type", "vlan_id", "src_vlan")
    old = H.with_added_columns(rows.filter("id % 2 = 1").drop("vlan_id", "src_vlan"))
    new = H.with_added_columns(rows.filter("id % 2 = 0"))
    return old.unionByName(new).select("id", "attack_type", "vlan_id", "src_vlan", "protocol")


@query(
    "P19_recent",
    """SELECT id, attack_type, confidence, severity, src_ip, dst_ip, created_at, is_attack, group_pred
       FROM pred ORDER BY created_at DESC, id LIMIT 10""",
)
def p19(spark, sf):
    return H.recent(V.predictions(spark, sf))


@query("O1_newest_first", "SELECT id, created_at, attack_type FROM pred ORDER BY created_at DESC, id")
def o1(spark, sf):
    return H.newest_first(V.predictions(spark, sf).select("id", "created_at", "attack_type"))


@query("O3_page", "SELECT id, created_at, attack_type FROM pred WHERE is_attack ORDER BY created_at DESC, id LIMIT 50 OFFSET 100")
def o3(spark, sf):
    rows = H.matching(V.predictions(spark, sf), attack_only=True)
    return H.page(rows.select("id", "created_at", "attack_type"), 50, 100)


@query("O3_deep_page", "SELECT id, created_at, attack_type FROM pred ORDER BY created_at DESC, id LIMIT 50 OFFSET 4000")
def o3_deep(spark, sf):
    return H.page(V.predictions(spark, sf).select("id", "created_at", "attack_type"), 50, 4000, shallow=1000)


@query(
    "O3_deep_page_null_times",
    """SELECT id, CASE WHEN id % 3 > 0 THEN created_at END AS created_at FROM pred
       ORDER BY CASE WHEN id % 3 > 0 THEN created_at END DESC NULLS LAST, id LIMIT 5000 OFFSET 4000""",
)
def o3_nulls(spark, sf):
    rows = V.predictions(spark, sf).select("id", F.when(F.col("id") % 3 > 0, F.col("created_at")).alias("created_at"))
    return H.page(rows, 5000, 4000, shallow=1000)


@query("O3_page_counts", "SELECT count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS pages FROM pred WHERE is_attack")
def o3_counts(spark, sf):
    return H.page_counts(H.matching(V.predictions(spark, sf), attack_only=True), 50)


def _sorted(by: str, descending: bool, key: str):
    way = "DESC" if descending else "ASC"

    @query(
        f"O4_sort_{by}_{way.lower()}",
        f"SELECT row_number() OVER (ORDER BY {key} {way}, id) AS position, id FROM pred ORDER BY {key} {way}, id LIMIT 50 OFFSET 50",
    )
    def run(spark, sf):
        rows = H.sorted_page(V.predictions(spark, sf).select("id", "confidence", "attack_type", "severity"), by, 2, 50, descending)
        # The page holds 50 rows, so numbering it is no global sort.
        from pyspark.sql import Window

        place = F.row_number().over(Window.orderBy(*H.result_order(by, descending)))
        return rows.select((place + 50).cast("long").alias("position"), "id")


for _by, _key in (
    ("confidence", "confidence"), ("type", "attack_type"),
    ("severity", V.case("severity", {"critical": 0, "high": 1, "medium": 2, "info": 3}, "4")),
):
    for _down in (False, True):
        _sorted(_by, _down, _key)


@query("O7_latest_200", "SELECT id, created_at FROM pred ORDER BY created_at DESC, id LIMIT 200")
def o7(spark, sf):
    return H.newest_first(V.predictions(spark, sf).select("id", "created_at")).limit(200)


@query(
    "A30_page_summary",
    """SELECT count(*) AS shown, count(*) FILTER (is_attack) AS attacks, count(*) FILTER (NOT is_attack) AS benign
       FROM (SELECT * FROM pred ORDER BY created_at DESC, id LIMIT 50 OFFSET 100)""",
)
def a30(spark, sf):
    return H.page_summary(H.page(V.predictions(spark, sf).select("id", "created_at", "is_attack"), 50, 100))


@query(
    "J11_late_truth",
    """SELECT id, attack_type, CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'BENIGN' ELSE attack_type END END AS ground_truth,
       CASE WHEN id % 4 = 0 THEN CASE WHEN id % 8 = 0 THEN 'BENIGN' ELSE attack_type END END = attack_type AS correct FROM pred""",
)
def j11(spark, sf):
    rows = V.predictions(spark, sf).select("id", "attack_type", F.lit(None).cast("string").alias("ground_truth"))
    base = rows.filter("id % 4 = 0").select("id", F.col("attack_type").alias("ground_truth"), F.lit(1).alias("seen_at"))
    late = base.filter("id % 8 = 0").select("id", F.lit("BENIGN").alias("ground_truth"), F.lit(2).alias("seen_at"))
    return H.merge_truth(rows, base.unionByName(late))


@query("U4_exact_dedup", "SELECT id, attack_type FROM pred")
def u4(spark, sf):
    rows = V.predictions(spark, sf).select("id", "attack_type")
    return rows.unionByName(rows.filter("id % 3 = 0")).dropDuplicates(["id"])


@query(
    "S3_prediction_append",
    "SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n, count(DISTINCT id) AS ids FROM pred GROUP BY 1",
)
def s3(spark, sf):
    path = fresh_folder(spark, "predictions")
    rows = V.predictions(spark, sf)
    rows.limit(0).withColumn("event_date", F.to_date("created_at")).write.mode("overwrite").parquet(path)
    sinks.append_predictions(rows.filter("id % 2 = 0"), path)
    sinks.append_predictions(rows.filter("id % 2 = 1"), path)
    stored = sinks.read_predictions(spark, path)
    return stored.groupBy(F.date_format("event_date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("ids")
    )


@query(
    "S6_log_export",
    f"""SELECT strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') AS "time", src_ip, dst_ip, CAST(dst_port AS VARCHAR) AS dst_port,
       attack_type AS prediction, CASE WHEN is_attack THEN '1' ELSE '0' END AS is_attack,
       {V.sql_fixed('confidence * 100', 1)} AS confidence, severity, {V.sql_fixed('inference_ms', 2)} AS inference_ms,
       CASE WHEN id % 5 = 0 THEN attack_type ELSE '' END AS ground_truth FROM pred""",
)
def s6(spark, sf):
    rows = V.predictions(spark, sf)
    return sinks.log_export(rows.withColumn("ground_truth", F.when(F.col("id") % 5 == 0, F.col("attack_type"))))
