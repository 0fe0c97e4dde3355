"""Harmonising and cleaning."""

from pyspark.sql import functions as F

from vigilflow import lookups as L
from vigilflow.catalog import views as V
from vigilflow.catalog.registry import query
from vigilflow.functions.numbers import text_to_number
from vigilflow.operators import harmonise as H
from vigilflow.operators.metrics import classes_present
from vigilflow.session import fresh_folder
from vigilflow.sources.csv_flows import read_flow_csv, read_upload

# Dirty cells by line item: numbers as text, junk, blanks, infinities, nulls.
_DIRTY = {
    "Flow Duration": """CASE l_partkey % 7 WHEN 0 THEN 'inf' WHEN 1 THEN 'abc' WHEN 2 THEN '' WHEN 3 THEN NULL ELSE CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR(40)) END""",
    "Tot Fwd Pkts": "CASE l_suppkey % 5 WHEN 0 THEN '1d' WHEN 1 THEN NULL ELSE CAST(CAST(l_quantity AS INTEGER) AS VARCHAR(40)) END",
    "Idle Max": "CASE WHEN l_linenumber % 2 = 0 THEN 'NaN' ELSE '7' END",
    "SYN Flag Cnt": "CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(l_linenumber AS VARCHAR(40)) END",
    "ACK Flag Cnt": "CASE WHEN l_partkey % 3 = 0 THEN NULL ELSE CAST(l_linenumber * 2 AS VARCHAR(40)) END",
}
_LABELS = ["Benign", "DoS attacks-Hulk", "Infilteration", "Syn", "UDPLag", "Bot", "Heartbleed"]
_KEY = "l_orderkey AS flow_key, l_linenumber AS flow_line, l_partkey, l_suppkey"
_DIRTY_SQL = f"""SELECT {_KEY}, {', '.join(f'{sql} AS "{n}"' for n, sql in _DIRTY.items())},
       ([{', '.join(V.text(' ' + s) for s in _LABELS)}])[1 + l_suppkey % {len(_LABELS)}] AS " label " FROM lineitem"""


def dirty(spark, sf):
    raw = F.array(*[F.lit(" " + s) for s in _LABELS])[(F.col("l_suppkey") % len(_LABELS)).cast("int")]
    return V.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("flow_key"), F.col("l_linenumber").alias("flow_line"), "l_partkey", "l_suppkey",
        *[F.expr(sql).alias(n) for n, sql in _DIRTY.items()], raw.alias(" label "),
    )


def _number(column: str) -> str:
    c = f'"{column}"'
    return rf"CASE WHEN regexp_full_match(trim({c}), '[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?') THEN TRY_CAST(trim({c}) AS DOUBLE) END"


_CELLS = {name: _number(name) for name in _DIRTY}
_CANON = {L.COLUMN_RENAMES.get(n, n): sql for n, sql in _CELLS.items()}
_MERGED = V.case('trim(" label ")', L.LABEL_MERGE, 'trim(" label ")')
_LABEL = f"(CASE {_MERGED} WHEN 'DDoS SYN Flood' THEN 'DDoS Volumetric' WHEN 'DDoS UDP Flood' THEN 'DDoS Volumetric' ELSE {_MERGED} END)"
_KEYS = ", ".join(V.FLOW_KEY)
_TARGETS = "(" + ", ".join(V.text(c) for c in L.TARGET_CLASSES) + ")"
# 5 features and the label: a row needs int(6 * 0.7) = 4 filled cells.
_FILLED = " + ".join(f"CAST(({sql}) IS NOT NULL AS INTEGER)" for sql in _CANON.values()) + " + 1"
_KEPT = f"FROM ({_DIRTY_SQL}) WHERE {_LABEL} IN {_TARGETS} AND {_FILLED} >= 4"


@query("F3_number_coercion", f"SELECT {_KEYS}, " + ", ".join(f'{sql} AS "{n}"' for n, sql in _CELLS.items()) + f" FROM ({_DIRTY_SQL})")
def f3(spark, sf):
    rows = dirty(spark, sf)
    return rows.select(*V.FLOW_KEY, *[text_to_number(F.col(f"`{n}`")).alias(n) for n in _DIRTY])


@query(
    "P1_P3_rename_and_drop",
    f"""SELECT {_KEYS}, "Tot Fwd Pkts" AS "Total Fwd Packets", "SYN Flag Cnt" AS "SYN Flag Count", "Flow Duration" FROM ({_DIRTY_SQL})""",
)
def p1(spark, sf):
    raw = dirty(spark, sf).select(
        *V.FLOW_KEY, F.col("`Tot Fwd Pkts`").alias(" Tot Fwd Pkts "), F.lit("second").alias("Total Fwd Packets"), "`SYN Flag Cnt`", "`Flow Duration`",
        F.lit("1.2.3.4").alias("Src IP"), F.lit("80").alias("Dst Port"), F.lit("x").alias("Flow ID"), F.lit("y").alias("Fwd Header Length.1"),
    )
    return H.drop_leakage(H.rename_columns(raw))


@query("P4_target_classes", f"""SELECT {_KEYS}, {_LABEL} AS "Label" FROM ({_DIRTY_SQL}) WHERE {_LABEL} IN {_TARGETS}""")
def p4(spark, sf):
    return H.keep_classes(H.with_label(dirty(spark, sf)), L.TARGET_CLASSES).select(*V.FLOW_KEY, "Label")


@query("F1_F2_label_column", f"""SELECT {_KEYS}, {_LABEL} AS "Label", {_MERGED} AS twelve FROM ({_DIRTY_SQL})""")
def f1(spark, sf):
    rows = dirty(spark, sf)
    from vigilflow.functions.lookup import normalise_label

    both = rows.withColumn("twelve", normalise_label("` label `", eleven_classes=False))
    return H.with_label(both).select(*V.FLOW_KEY, "Label", "twelve")


@query("P5_sparse_rows", f"SELECT {_KEYS} {_KEPT}")
def p5(spark, sf):
    rows = H.keep_classes(H.with_label(dirty(spark, sf)), L.TARGET_CLASSES)
    cells = H.coerce_numbers(rows, ("Label", *V.FLOW_KEY))
    return H.drop_sparse_rows(cells, [c for c in cells.columns if c not in V.FLOW_KEY]).select(*V.FLOW_KEY)


@query("P20_zero_fill", f"""SELECT {_KEYS}, coalesce({_CELLS['Flow Duration']}, 0) AS "Flow Duration", coalesce({_CELLS['Idle Max']}, 0) AS "Idle Max" FROM ({_DIRTY_SQL})""")
def p20(spark, sf):
    rows = dirty(spark, sf).select(*V.FLOW_KEY, "`Flow Duration`", "`Idle Max`")
    return H.fill_zero(H.coerce_numbers(rows, tuple(V.FLOW_KEY)), tuple(V.FLOW_KEY))


@query(
    "P7_feature_spread",
    "SELECT * FROM (" + " UNION ALL ".join(
        f"""SELECT {V.text(n)} AS feature, round(stddev_samp(coalesce({sql}, 0)), 4) AS spread, stddev_samp(coalesce({sql}, 0)) > 1e-6 AS kept {_KEPT}"""
        for n, sql in {**_CANON, 'constant': '7.0::DOUBLE'}.items()
    ) + ")",
)
def p7(spark, sf):
    rows = H.clean(H.rename_columns(dirty(spark, sf)), L.TARGET_CLASSES, tuple(V.FLOW_KEY)).withColumn("constant", F.lit(7.0))
    names = [c for c in rows.columns if c not in (*V.FLOW_KEY, "Label")]
    spread = H.feature_spread(rows, names)
    cells = F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"`{n}`").alias("s")) for n in names]))
    return spread.select(cells.alias("r")).select(
        "r.feature", F.round("r.s", 4).alias("spread"), (F.coalesce("r.s", F.lit(0.0)) > H.VARIANCE_FLOOR).alias("kept")
    )


@query(
    "M1_cleaning",
    f"SELECT {_KEYS}, " + ", ".join(f'coalesce({sql}, 0) AS "{n}"' for n, sql in _CANON.items()) + f', {_LABEL} AS "Label" {_KEPT}',
)
def m1(spark, sf):
    cleaned, _ = H.preprocess(H.rename_columns(dirty(spark, sf)), L.TARGET_CLASSES, tuple(V.FLOW_KEY))
    return cleaned


@query(
    "U1_aligned_union",
    """SELECT flow_key, "Total Fwd Packets" AS fwd, CASE WHEN flow_line % 2 = 0 THEN "Flow Duration" END AS duration,
       CASE WHEN flow_line % 2 = 1 THEN "SYN Flag Count" END AS syn FROM flows_v""",
)
def u1(spark, sf):
    rows = V.flows(spark, sf)
    fwd = F.col("`Total Fwd Packets`").alias("fwd")
    even = rows.filter("flow_line % 2 = 0").select("flow_key", fwd, F.col("`Flow Duration`").alias("duration"))
    odd = rows.filter("flow_line % 2 = 1").select(F.col("`SYN Flag Count`").alias("syn"), "flow_key", fwd)
    return H.union_all([even, odd])


@query(
    "U3_classes_present",
    f"""SELECT class, class IN {_TARGETS} AS is_target FROM (SELECT truth AS class FROM labelled_v UNION SELECT CASE WHEN id % 97 = 0 THEN 'Heartbleed' ELSE pred END FROM labelled_v)""",
)
def u3(spark, sf):
    rows = V.labelled(spark, sf)
    return classes_present(rows.withColumn("pred", F.when(F.col("id") % 97 == 0, F.lit("Heartbleed")).otherwise(F.col("pred"))))


@query(
    "F28_class_codes",
    f"SELECT id, attack_type, CAST(list_position([{', '.join(V.text(c) for c in L.TARGET_CLASSES)}], attack_type) - 1 AS INTEGER) AS code FROM pred",
)
def f28(spark, sf):
    from vigilflow.functions.lookup import lookup

    codes = H.class_codes(L.TARGET_CLASSES)
    return V.predictions(spark, sf).select("id", "attack_type", lookup("attack_type", codes).alias("code"))


@query(
    "S1_csv_scan",
    """SELECT flow_key, CAST("Flow Duration" AS DOUBLE) AS "Flow Duration", "Total Fwd Packets", CASE WHEN flow_line % 2 = 0 THEN "SYN Flag Count" END AS "SYN Flag Count",
       "Label" FROM labelled_flows""",
)
def s1(spark, sf):
    folder = fresh_folder(spark, "flows")
    rows = V.labelled_flows(spark, sf)
    ip = F.lit("10.0.0.1").alias(" Src IP")
    long_names = rows.filter("flow_line % 2 = 0").select("flow_key", ip, "`Flow Duration`", F.col("`Total Fwd Packets`").alias(" Total Fwd Packets"), "`SYN Flag Count`", F.col("Label").alias(" Label"))
    short_names = rows.filter("flow_line % 2 = 1").select(F.col("Label"), F.col("`Total Fwd Packets`").alias("Tot Fwd Pkts"), "flow_key", "`Flow Duration`")
    for name, part in (("long", long_names), ("short", short_names)):
        part.write.mode("overwrite").option("header", True).option("encoding", "ISO-8859-1").csv(f"{folder}/{name}")
    read = read_flow_csv(spark, folder)
    number = {c: text_to_number(F.col(f"`{c}`")).alias(c) for c in ("Flow Duration", "Total Fwd Packets", "SYN Flag Count")}
    return read.select(F.col("flow_key").cast("long").alias("flow_key"), *number.values(), "Label")


@query(
    "S2_upload_scoring_input",
    f"""SELECT {_CELLS['Flow Duration']} AS "Flow Duration", {_CELLS['Tot Fwd Pkts']} AS "Tot Fwd Pkts", {_LABEL} AS ground_truth FROM ({_DIRTY_SQL})""",
)
def s2(spark, sf):
    path = fresh_folder(spark, "upload")
    rows = dirty(spark, sf).select("`Flow Duration`", F.col("`Tot Fwd Pkts`").alias(" Tot Fwd Pkts"), F.col("` label `").alias(" LABEL"))
    rows.write.mode("overwrite").option("header", True).csv(path)
    return read_upload(spark, path)
