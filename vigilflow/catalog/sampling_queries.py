"""Splits, caps and balancing."""

from pyspark.sql import functions as F

from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.operators import sampling as S
from vigilflow.session import fresh_folder
from vigilflow.sources import sinks

_KEYS = ", ".join(V.FLOW_KEY)
_TEXT = " || '|' || ".join(V.FLOW_KEY)
FILES, CLASSES = 10, 11


def _rank(group: str, *lead: str) -> str:
    head = " || '|' || ".join(("'42'", *lead))
    return f"row_number() OVER (PARTITION BY {group} ORDER BY md5({head} || '|' || {_TEXT}))"


@query(
    "W1_per_file_split",
    f"""SELECT {_KEYS}, file_id, CASE WHEN rk <= 2500 THEN 'train' WHEN rk <= 3500 THEN 'unseen' ELSE 'unused' END AS split
       FROM (SELECT *, {_rank('file_id', 'file_id')} AS rk FROM labelled_flows)""",
)
def w1(spark, sf):
    rows = V.labelled_flows(spark, sf).select(*V.FLOW_KEY, "file_id")
    return S.split_per_file(rows, "file_id", V.FLOW_KEY, 2500, 1000, file_bound=FILES)


@query(
    "W2_class_balance",
    f"""WITH ranked AS (SELECT {_KEYS}, "Label", {_rank('"Label"', '"Label"')} AS rk, count(*) OVER (PARTITION BY "Label") AS n
       FROM (SELECT * REPLACE (CASE WHEN "Label" = 'Bot' AND l_partkey % 50 <> 0 THEN 'BENIGN' ELSE "Label" END AS "Label") FROM labelled_flows)),
       draws AS (SELECT "Label", i, CAST(('0x' || substr(md5('42|draw|' || "Label" || '|' || i), 1, 8)) AS BIGINT) % n + 1 AS rk
       FROM (SELECT DISTINCT "Label", n FROM ranked WHERE n < 600), range(1, 601) r(i))
       SELECT {_KEYS}, "Label", 0::BIGINT AS copy FROM ranked WHERE n >= 600 AND rk <= 3000
       UNION ALL SELECT {_KEYS}, r."Label", d.i AS copy FROM draws d JOIN ranked r ON r."Label" = d."Label" AND r.rk = d.rk""",
)
def w2(spark, sf):
    # Most rows of one class are relabelled, so that there is a small class.
    label = F.expr("CASE WHEN Label = 'Bot' AND l_partkey % 50 <> 0 THEN 'BENIGN' ELSE Label END")
    rows = V.labelled_flows(spark, sf).withColumn("Label", label).select(*V.FLOW_KEY, "Label")
    return S.balance_classes(rows, "Label", V.FLOW_KEY, 3000, 600, class_bound=CLASSES)


@query(
    "W3_cap_per_file",
    f"SELECT {_KEYS}, file_id FROM (SELECT *, {_rank('file_id', 'file_id')} AS rk FROM labelled_flows) WHERE rk <= 1234",
)
def w3(spark, sf):
    rows = V.labelled_flows(spark, sf).select(*V.FLOW_KEY, "file_id")
    return S.cap_per_group(rows, ["file_id"], V.FLOW_KEY, 1234, group_bound=FILES)


@query(
    "W6_stratified_split",
    f"""SELECT {_KEYS}, "Label", CASE WHEN rk <= floor(round(n * 0.7, 6)) THEN 'train' WHEN rk <= floor(round(n * 0.85, 6)) THEN 'validation' ELSE 'test' END AS split
       FROM (SELECT *, {_rank('"Label"', '"Label"')} AS rk, count(*) OVER (PARTITION BY "Label") AS n FROM labelled_flows)""",
)
def w6(spark, sf):
    rows = V.labelled_flows(spark, sf).select(*V.FLOW_KEY, "Label")
    return S.stratified_split(rows, "Label", V.FLOW_KEY, class_bound=CLASSES)


@query(
    "W7_equal_shares",
    f"""WITH g AS (SELECT *, CASE WHEN file_id % 3 = 0 THEN 'amplification' ELSE 'flood' END AS grp FROM labelled_flows),
       r AS (SELECT {_KEYS}, grp, file_id, {_rank('grp, file_id', 'file_id')} AS rk FROM g)
       SELECT {_KEYS}, grp, file_id, grp AS "Label" FROM r JOIN (SELECT grp, count(DISTINCT file_id) AS files FROM g GROUP BY 1) USING (grp) WHERE rk <= 4000 // files""",
)
def w7(spark, sf):
    rows = V.labelled_flows(spark, sf).select(
        *V.FLOW_KEY, F.when(F.col("file_id") % 3 == 0, F.lit("amplification")).otherwise(F.lit("flood")).alias("grp"), "file_id"
    )
    return S.sample_group_files(rows, "grp", "file_id", V.FLOW_KEY, 4000, file_bound=FILES)


@query(
    "S14_random_row",
    f"""WITH f AS (SELECT file_id FROM (SELECT DISTINCT file_id FROM labelled_flows) ORDER BY md5('7|' || file_id) LIMIT 1)
       SELECT {_KEYS}, file_id, "Label" FROM labelled_flows WHERE file_id = (SELECT file_id FROM f) ORDER BY md5('7|' || file_id || '|' || {_TEXT}) LIMIT 1""",
)
def s14(spark, sf):
    rows = V.labelled_flows(spark, sf).select(*V.FLOW_KEY, "file_id", "Label")
    return S.random_row(rows, "file_id", V.FLOW_KEY, 7)


# Rows without a file or a label form a group of their own.
_NULLS = """(SELECT * REPLACE (CASE WHEN file_id % 3 <> 0 THEN file_id END AS file_id,
       CASE WHEN "Label" = 'Bot' AND l_partkey % 50 <> 0 THEN 'BENIGN' WHEN "Label" <> 'PortScan' THEN "Label" END AS "Label") FROM labelled_flows)"""


def _with_nulls(spark, sf):
    return V.labelled_flows(spark, sf).withColumns(
        {
            "file_id": F.when(F.col("file_id") % 3 != 0, F.col("file_id")),
            "Label": F.expr("CASE WHEN Label = 'Bot' AND l_partkey % 50 <> 0 THEN 'BENIGN' WHEN Label <> 'PortScan' THEN Label END"),
        }
    )


def _null_rank(group: str) -> str:
    return f"row_number() OVER (PARTITION BY {group} ORDER BY md5('42|' || coalesce(CAST({group} AS VARCHAR), '\\N') || '|' || {_TEXT}))"


@query(
    "W1_null_files",
    f"""SELECT {_KEYS}, file_id, CASE WHEN rk <= 2500 THEN 'train' WHEN rk <= 3500 THEN 'unseen' ELSE 'unused' END AS split
       FROM (SELECT *, {_null_rank('file_id')} AS rk FROM {_NULLS})""",
)
def w1_nulls(spark, sf):
    rows = _with_nulls(spark, sf).select(*V.FLOW_KEY, "file_id")
    return S.split_per_file(rows, "file_id", V.FLOW_KEY, 2500, 1000, file_bound=FILES)


@query(
    "W2_null_labels",
    f"""WITH ranked AS (SELECT {_KEYS}, "Label", {_null_rank('"Label"')} AS rk, count(*) OVER (PARTITION BY "Label") AS n FROM {_NULLS}),
       draws AS (SELECT "Label", i, CAST(('0x' || substr(md5('42|draw|' || coalesce("Label", '\\N') || '|' || i), 1, 8)) AS BIGINT) % n + 1 AS rk
       FROM (SELECT DISTINCT "Label", n FROM ranked WHERE n < 9000), range(1, 9001) r(i))
       SELECT {_KEYS}, "Label", 0::BIGINT AS copy FROM ranked WHERE n >= 9000 AND rk <= 9500
       UNION ALL SELECT {_KEYS}, r."Label", d.i AS copy FROM draws d JOIN ranked r ON r."Label" IS NOT DISTINCT FROM d."Label" AND r.rk = d.rk""",
)
def w2_nulls(spark, sf):
    return S.balance_classes(_with_nulls(spark, sf).select(*V.FLOW_KEY, "Label"), "Label", V.FLOW_KEY, 9500, 9000, class_bound=CLASSES)


@query(
    "W6_null_labels",
    f"""SELECT {_KEYS}, "Label", CASE WHEN rk <= floor(round(n * 0.7, 6)) THEN 'train' WHEN rk <= floor(round(n * 0.85, 6)) THEN 'validation' ELSE 'test' END AS split
       FROM (SELECT *, {_null_rank('"Label"')} AS rk, count(*) OVER (PARTITION BY "Label") AS n FROM {_NULLS})""",
)
def w6_nulls(spark, sf):
    return S.stratified_split(_with_nulls(spark, sf).select(*V.FLOW_KEY, "Label"), "Label", V.FLOW_KEY, class_bound=CLASSES)


@query(
    "S5_samples_by_label",
    f"""SELECT "Label", count(*) AS n, sum(flow_key) AS keys, round(sum("Total Fwd Packets"), 2) AS packets FROM labelled_flows GROUP BY 1""",
)
def s5(spark, sf):
    path = fresh_folder(spark, "samples")
    rows = V.labelled_flows(spark, sf).select(*V.FLOW_KEY, "Total Fwd Packets", "Label")
    sinks.write_samples(rows, path)
    # The label of a row is the folder it lies in.
    schema = "flow_key long, flow_line long, l_partkey long, l_suppkey long, `Total Fwd Packets` double, Label string"
    back = spark.read.option("header", True).schema(schema).csv(path)
    return back.groupBy("Label").agg(
        F.count(F.lit(1)).alias("n"), F.sum("flow_key").alias("keys"), F.round(F.sum("Total Fwd Packets"), 2).alias("packets")
    )
