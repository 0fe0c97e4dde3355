"""Dashboard analytics."""

from pyspark.sql import functions as F

from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.operators import analytics as A
from vigilflow.operators.history import within

NOON = "2024-01-30 12:00:00"


@query(
    "A1_headline_stats",
    """SELECT count(*) AS total_predictions, count(*) FILTER (is_attack) AS total_attacks,
       count(*) FILTER (NOT is_attack) AS total_benign, round(coalesce(avg(confidence), 0), 4) AS avg_confidence,
       round(coalesce(avg(inference_ms), 0), 3) AS avg_inference_ms FROM pred""",
)
def headline(spark, sf):
    return A.headline(V.predictions(spark, sf))


@query(
    "A1_stats_single_scan",
    """SELECT CASE grouping_id(severity, attack_type) WHEN 3 THEN 'all' WHEN 1 THEN 'severity' ELSE 'attack_type' END AS part,
       coalesce(severity, attack_type) AS name, count(*) AS n, count(*) FILTER (is_attack) AS attacks,
       round(avg(confidence), 4) AS avg_confidence, round(avg(inference_ms), 3) AS avg_inference_ms
       FROM pred GROUP BY GROUPING SETS ((severity), (attack_type), ())""",
)
def single_scan(spark, sf):
    return A.statistics(V.predictions(spark, sf))


@query("A2_by_severity", "SELECT severity, count(*) AS n FROM pred GROUP BY severity")
def by_severity(spark, sf):
    return A.by_severity(V.predictions(spark, sf))


@query("A3_top_attack_types", "SELECT attack_type, count(*) AS n FROM pred GROUP BY attack_type ORDER BY n DESC, attack_type LIMIT 15")
def top_types(spark, sf):
    return A.top_attack_types(V.predictions(spark, sf))


def _timeline_sql(fmt: str, days: int) -> str:
    return f"""SELECT strftime(created_at, '{fmt}') AS period, count(*) AS total, count(*) FILTER (is_attack) AS attacks,
       count(*) FILTER (NOT is_attack) AS benign FROM pred
       WHERE created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL {days} DAY GROUP BY 1"""


@query("A4_timeline_hour", _timeline_sql("%Y-%m-%dT%H", 30))
def timeline_hour(spark, sf):
    return A.timeline(within(V.predictions(spark, sf), V.AS_OF, days=30), "hour")


@query("A4_timeline_day", _timeline_sql("%Y-%m-%d", 14))
def timeline_day(spark, sf):
    return A.timeline(within(V.predictions(spark, sf), V.AS_OF, days=14), "day")


@query(
    "A5_attack_trends",
    f"""SELECT attack_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM pred
       WHERE is_attack AND created_at >= TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY GROUP BY 1, 2""",
)
def trends(spark, sf):
    return A.attack_trends(within(V.predictions(spark, sf), V.AS_OF, days=30))


@query(
    "A6_nested_trends",
    """SELECT attack_type, string_agg(day || '=' || n, ',' ORDER BY day) AS trend FROM
       (SELECT attack_type, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM pred WHERE is_attack GROUP BY 1, 2)
       GROUP BY attack_type""",
)
def nested(spark, sf):
    rows = A.nested_trends(V.predictions(spark, sf))
    cells = F.transform("trend", lambda e: F.concat(e["day"], F.lit("="), e["n"].cast("string")))
    return rows.select("attack_type", F.array_join(cells, ",").alias("trend"))


@query(
    "A7_top_attacks",
    """SELECT attack_type, count(*) AS n, round(avg(confidence), 6) AS avg_confidence, min(severity) AS severity
       FROM pred WHERE is_attack GROUP BY attack_type""",
)
def top_attacks(spark, sf):
    return A.top_attacks(V.predictions(spark, sf)).withColumn("avg_confidence", F.round("avg_confidence", 6))


@query(
    "A8_severity_by_day",
    """SELECT severity, strftime(created_at, '%Y-%m-%d') AS day, count(*) AS n FROM pred GROUP BY 1, 2
       UNION ALL SELECT severity, NULL, count(*) FROM pred GROUP BY 1""",
)
def severity_by_day(spark, sf):
    return A.severity_by_day(V.predictions(spark, sf))


@query("A9_table_health", "SELECT count(*) AS total_rows, min(created_at) AS oldest_record, max(created_at) AS newest_record FROM pred")
def health(spark, sf):
    return A.table_health(V.predictions(spark, sf))


@query("A9_stored_bytes")
def stored(spark, sf):
    return A.stored_bytes(V.table(spark, sf, "events"))


@query("A9_stored_bytes_consistent", "SELECT true AS some_files, true AS some_bytes, true AS megabytes_fit")
def stored_consistent(spark, sf):
    return stored(spark, sf).select(
        (F.col("files") > 0).alias("some_files"), (F.col("bytes") > 0).alias("some_bytes"),
        (F.col("mb") == F.round(F.col("bytes") / 1_048_576, 2)).alias("megabytes_fit"),
    )


@query(
    "A10_batch_summary",
    """SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks, count(*) FILTER (NOT is_attack) AS benign,
       round(sum(inference_ms), 2) AS inference_ms, round(sum(inference_ms) / count(*), 4) AS ms_per_flow FROM pred""",
)
def batch_summary(spark, sf):
    return A.batch_summary(V.predictions(spark, sf))


@query(
    "A20_distinct_values",
    """SELECT DISTINCT 'attack_type' AS kind, attack_type AS value FROM pred
       UNION ALL SELECT DISTINCT 'severity', severity FROM pred""",
)
def distinct_values(spark, sf):
    return A.distinct_values(V.predictions(spark, sf)).orderBy("kind", "value")


@query(
    "A21_confidence_histogram",
    """SELECT CAST(b.bin AS INTEGER) AS bin, count(p.slot) AS n FROM range(10) b(bin)
       LEFT JOIN (SELECT least(CAST(floor(confidence * 10) AS BIGINT), 9) AS slot FROM pred WHERE id % 11 <> 0) p ON p.slot = b.bin GROUP BY 1""",
)
def histogram(spark, sf):
    rows = V.predictions(spark, sf)
    return A.confidence_histogram(rows.withColumn("confidence", F.when(F.col("id") % 11 != 0, F.col("confidence"))))


@query(
    "A22_type_counts",
    """SELECT coalesce(CASE WHEN id % 13 <> 0 THEN attack_type END, 'Unknown') AS name, count(*) AS n FROM pred
       GROUP BY 1 ORDER BY n DESC, name LIMIT 8""",
)
def type_counts(spark, sf):
    rows = V.predictions(spark, sf)
    return A.type_counts(rows.withColumn("attack_type", F.when(F.col("id") % 13 != 0, F.col("attack_type"))))


@query(
    "A23_by_region",
    """SELECT region, count(*) AS n, count(*) FILTER (severity = 'critical') AS critical,
       count(DISTINCT attack_type) AS types, string_agg(DISTINCT attack_type, ', ' ORDER BY attack_type) AS type_list FROM
       (SELECT *, ([ 'China', 'Russia', 'USA', 'UK', 'France', 'Germany', 'Japan', 'Brazil', 'S. Korea', 'India' ])
       [1 + CAST(split_part(src_ip, '.', 1) AS INTEGER) % 10] AS region FROM pred WHERE is_attack) GROUP BY region""",
)
def regions(spark, sf):
    return A.by_region(V.predictions(spark, sf))


@query(
    "A24_rates",
    """SELECT count(*) AS total, count(*) FILTER (is_attack) AS attacks,
       round(count(*) FILTER (is_attack) / count(*) * 100, 4) AS attack_rate,
       count(*) FILTER (is_attack) / count(*) * 100 > 20 AS is_high_rate FROM pred""",
)
def rates(spark, sf):
    return A.rates(V.predictions(spark, sf))


@query(
    "A24_severity_shares",
    """SELECT s.severity, count(p.id) AS n, round(count(p.id) / (SELECT count(*) FROM pred) * 100, 1) AS pct
       FROM (VALUES ('info'), ('medium'), ('high'), ('critical')) s(severity) LEFT JOIN pred p ON p.severity = s.severity GROUP BY 1""",
)
def severity_shares(spark, sf):
    return A.severity_shares(V.predictions(spark, sf))


@query(
    "A24_top_shares",
    """SELECT attack_type, count(*) AS n, round(count(*) / (SELECT count(*) FROM pred WHERE is_attack) * 100, 1) AS share
       FROM pred WHERE is_attack GROUP BY 1 ORDER BY n DESC, attack_type LIMIT 5""",
)
def top_shares(spark, sf):
    return A.top_shares(V.predictions(spark, sf))


@query(
    "A26_situation_summary",
    f"""SELECT concat('- Total predictions analyzed: ', (SELECT count(*) FROM pred), chr(10), '- Total attacks detected: ',
       (SELECT count(*) FROM pred WHERE is_attack), ' (', (SELECT CAST(CAST(round(count(*) FILTER (is_attack) / count(*) * 100, 1) AS DECIMAL(18,1)) AS VARCHAR) FROM pred),
       '% attack rate)', chr(10), '- Open/investigating alerts: ', (SELECT count(*) FROM alerts_v WHERE status IN ('open', 'investigating')), chr(10),
       '- Severity breakdown: ', (SELECT string_agg(severity || ': ' || n, ', ' ORDER BY severity) FROM (SELECT severity, count(*) AS n FROM pred GROUP BY 1)), chr(10),
       '- Recent attacks (last 24h): ', (SELECT string_agg(attack_type || ': ' || n, ', ' ORDER BY n DESC, attack_type) FROM
       (SELECT attack_type, count(*) AS n FROM pred WHERE is_attack AND created_at >= TIMESTAMP '{NOON}' - INTERVAL 1 DAY GROUP BY 1 ORDER BY n DESC, attack_type LIMIT 5))) AS summary""",
)
def situation(spark, sf):
    return A.situation_summary(V.predictions(spark, sf), V.alerts(spark, sf), NOON)


@query("A29_rows_per_file", "SELECT 'lineitem.parquet' AS file, count(*) AS n FROM lineitem")
def rows_per_file(spark, sf):
    rows = A.rows_per_file(V.table(spark, sf, "lineitem"))
    # A table stored as a folder of parts counts as one.
    name = F.regexp_extract("file", r"([^/]+\.parquet)(?:/[^/]*)?$", 1)
    return rows.groupBy(name.alias("file")).agg(F.sum("n").alias("n"))


@query(
    "W8_share_of_group",
    """SELECT group_pred, attack_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY group_pred), 6) AS share
       FROM pred GROUP BY 1, 2""",
)
def shares(spark, sf):
    return A.group_share(V.predictions(spark, sf), "group_pred", "attack_type")
