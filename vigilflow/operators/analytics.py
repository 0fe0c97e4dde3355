"""Dashboard analytics over the prediction history.

Every result is one map-side-combined aggregate of the history; anything that
follows (shares, nesting, top-k) works on the few aggregated rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow import lookups as L
from vigilflow.functions.network import map_position
from vigilflow.functions.numbers import fixed_text

PERIODS = {"hour": "yyyy-MM-dd'T'HH", "day": "yyyy-MM-dd"}


def _count() -> Column:
    return F.count(F.lit(1))


def _day() -> Column:
    return F.date_format("created_at", PERIODS["day"])


def headline(df: DataFrame) -> DataFrame:
    """Totals and averages in one pass; averages of nothing are 0."""
    attacks = F.count_if("is_attack")
    return df.agg(
        _count().alias("total_predictions"),
        attacks.alias("total_attacks"),
        (_count() - attacks).alias("total_benign"),
        F.round(F.coalesce(F.avg("confidence"), F.lit(0.0)), 4).alias("avg_confidence"),
        F.round(F.coalesce(F.avg("inference_ms"), F.lit(0.0)), 3).alias("avg_inference_ms"),
    )


def by_severity(df: DataFrame) -> DataFrame:
    return df.groupBy("severity").agg(_count().alias("n"))


def top_attack_types(df: DataFrame, rows: int = 15) -> DataFrame:
    """Most frequent classes, benign included."""
    counts = df.groupBy("attack_type").agg(_count().alias("n"))
    return counts.orderBy(F.desc("n"), "attack_type").limit(rows)


def statistics(df: DataFrame) -> DataFrame:
    """Headline, severity and class counts from a single scan.

    Grouping sets give one aggregate whose rows carry ``part``: all, severity or
    attack_type.
    """
    sets = df.groupingSets(
        [["severity"], ["attack_type"], []], "severity", "attack_type"
    ).agg(
        _count().alias("n"),
        F.count_if("is_attack").alias("attacks"),
        F.round(F.avg("confidence"), 4).alias("avg_confidence"),
        F.round(F.avg("inference_ms"), 3).alias("avg_inference_ms"),
        F.grouping_id().alias("_g"),
    )
    part = F.when(F.col("_g") == 3, "all").when(F.col("_g") == 1, "severity").otherwise("attack_type")
    return sets.select(
        part.alias("part"), F.coalesce("severity", "attack_type").alias("name"),
        "n", "attacks", "avg_confidence", "avg_inference_ms",
    )


def timeline(df: DataFrame, period: str = "hour") -> DataFrame:
    """Total, attacks and benign per hour or day, in order of time."""
    counts = df.groupBy(F.date_format("created_at", PERIODS[period]).alias("period")).agg(
        _count().alias("total"),
        F.count_if("is_attack").alias("attacks"),
        F.count_if(~F.col("is_attack")).alias("benign"),
    )
    return counts.orderBy("period")


def _trend_counts(df: DataFrame) -> DataFrame:
    return df.filter("is_attack").groupBy("attack_type", _day().alias("day")).agg(_count().alias("n"))


def attack_trends(df: DataFrame) -> DataFrame:
    """Attacks per class and day: day by day, the most frequent class first, equal ones by name."""
    return _trend_counts(df).orderBy("day", F.desc("n"), "attack_type")


def nested_trends(df: DataFrame) -> DataFrame:
    """One row per class with its ordered list of {day, n} (built from counts)."""
    series = F.sort_array(F.collect_list(F.struct("day", "n")))
    return _trend_counts(df).groupBy("attack_type").agg(series.alias("trend"))


def top_attacks(df: DataFrame) -> DataFrame:
    """Count, mean confidence and severity of every attack class, the most frequent first, equal ones by name."""
    classes = df.filter("is_attack").groupBy("attack_type").agg(
        _count().alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("severity").alias("severity")
    )
    return classes.orderBy(F.desc("n"), "attack_type")


def severity_by_day(df: DataFrame) -> DataFrame:
    """Counts per severity and day plus per severity (day is null) in one pass: day by day, the totals last."""
    return (
        df.withColumn("day", _day())
        .groupingSets([["severity", "day"], ["severity"]], "severity", "day")
        .agg(_count().alias("n"))
        .orderBy(F.asc_nulls_last("day"), "severity")
    )


def table_health(df: DataFrame) -> DataFrame:
    return df.agg(
        _count().alias("total_rows"),
        F.min("created_at").alias("oldest_record"),
        F.max("created_at").alias("newest_record"),
    )


def stored_bytes(df: DataFrame) -> DataFrame:
    """Bytes of the files behind a file-backed frame."""
    files = df.select("_metadata.file_path", "_metadata.file_size").groupBy("file_path").agg(F.max("file_size").alias("b"))
    return files.agg(
        F.count(F.lit(1)).alias("files"), F.sum("b").alias("bytes"), F.round(F.sum("b") / 1_048_576, 2).alias("mb")
    )


def rows_per_file(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("_metadata.file_path").alias("file")).agg(_count().alias("n"))


def batch_summary(df: DataFrame) -> DataFrame:
    """Totals of a scored batch and latency per flow."""
    attacks = F.count_if("is_attack")
    spent = F.sum("inference_ms")
    return df.agg(
        _count().alias("total"), attacks.alias("attacks"), (_count() - attacks).alias("benign"),
        F.round(F.coalesce(spent, F.lit(0.0)), 2).alias("inference_ms"),
        F.when(_count() > 0, F.round(spent / F.count(F.lit(1)), 4)).alias("ms_per_flow"),
    )


def distinct_values(df: DataFrame) -> DataFrame:
    """Classes and (non-blank) severities that occur, as (kind, value)."""
    pair = F.explode(
        F.array(
            F.struct(F.lit("attack_type").alias("kind"), F.col("attack_type").alias("value")),
            F.struct(F.lit("severity").alias("kind"), F.col("severity").alias("value")),
        )
    )
    found = df.select(pair.alias("p")).select("p.kind", "p.value").distinct()
    return found.filter((F.col("kind") == "attack_type") | (F.coalesce("value", F.lit("")) != ""))


def confidence_histogram(df: DataFrame, bins: int = 10) -> DataFrame:
    """Equal bins over [0, 1], the top one closed; empty bins are kept."""
    slot = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    counts = df.filter(F.col("confidence").isNotNull()).groupBy(slot.alias("bin")).agg(_count().alias("c"))
    frame = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return frame.join(counts, "bin", "left").select("bin", F.coalesce("c", F.lit(0)).alias("n"))


def type_counts(df: DataFrame, rows: int = 8) -> DataFrame:
    """Most frequent classes, nameless ones as 'Unknown'."""
    name = F.when(F.col("attack_type") != "", F.col("attack_type"))
    counts = df.groupBy(F.coalesce(name, F.lit("Unknown")).alias("name")).agg(_count().alias("n"))
    return counts.orderBy(F.desc("n"), "name").limit(rows)


def by_region(df: DataFrame) -> DataFrame:
    """Attacks per pseudo-region: count, critical ones, classes seen.

    Counted per (region, class) first, so the class list is made of few rows.
    """
    region, _, _ = map_position("src_ip")
    base = (
        df.filter(F.col("is_attack") & (F.coalesce("src_ip", F.lit("")) != ""))
        .groupBy(region.alias("region"), "attack_type")
        .agg(_count().alias("c"), F.count_if(F.col("severity") == "critical").alias("k"))
    )
    return base.groupBy("region").agg(
        F.sum("c").alias("n"), F.sum("k").alias("critical"), F.count(F.lit(1)).alias("types"),
        F.array_join(F.sort_array(F.collect_list("attack_type")), ", ").alias("type_list"),
    )


def rates(df: DataFrame, high: float = 20.0) -> DataFrame:
    """Attack rate in percent and whether it is high."""
    total, attacks = _count(), F.count_if("is_attack")
    rate = F.when(total > 0, attacks / total * 100).otherwise(F.lit(0.0))
    return df.agg(
        total.alias("total"), attacks.alias("attacks"), F.round(rate, 4).alias("attack_rate"),
        (rate > high).alias("is_high_rate"),
    )


def severity_shares(df: DataFrame) -> DataFrame:
    """Percent of all rows for each of the four severities (0 when absent)."""
    total = _count()
    counts = df.agg(total.alias("_all"), *[F.count_if(F.col("severity") == s).alias(s) for s in L.SEVERITY_ORDER])
    rows = F.explode(F.array(*[F.struct(F.lit(s).alias("severity"), F.col(s).alias("n")) for s in L.SEVERITY_ORDER]))
    return counts.select("_all", rows.alias("r")).select(
        "r.severity", "r.n",
        F.round(F.when(F.col("_all") > 0, F.col("r.n") / F.col("_all") * 100).otherwise(0.0), 1).alias("pct"),
    )


def top_shares(df: DataFrame, rows: int = 5) -> DataFrame:
    """Most frequent attack classes with their share of all attacks."""
    counts = df.filter("is_attack").groupBy("attack_type").agg(_count().alias("n"))
    share = F.round(F.col("n") / F.sum("n").over(Window.partitionBy(F.lit(0))) * 100, 1)
    return counts.withColumn("share", share).orderBy(F.desc("n"), "attack_type").limit(rows)


def group_share(df: DataFrame, group: str, member: str) -> DataFrame:
    """Count of each member and its share of the group total."""
    counts = df.groupBy(group, member).agg(_count().alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(group)), 6))


def situation_summary(predictions: DataFrame, alerts: DataFrame, as_of: str, top: int = 5) -> DataFrame:
    """One text line per fact on the current situation."""
    from vigilflow.operators.history import cutoff

    kinds = predictions.groupBy("severity", "attack_type", "is_attack").agg(
        _count().alias("n"), F.count_if(F.col("created_at") >= cutoff(as_of, days=1)).alias("day")
    )

    def listing(rows: DataFrame, name: str, order: list[Column]) -> DataFrame:
        entry = F.struct(*order, F.concat_ws(": ", name, F.col("n").cast("string")).alias("text"))
        return rows.agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["text"]), ", ").alias("text")
        )

    totals = kinds.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(F.col("is_attack"), F.col("n"))), F.lit(0)).alias("attacks"),
    )
    severities = listing(
        kinds.groupBy("severity").agg(F.sum("n").alias("n")), "severity", [F.col("severity")]
    ).withColumnRenamed("text", "severities")
    lately = (
        kinds.filter("is_attack and day > 0").groupBy("attack_type").agg(F.sum("day").alias("n"))
        .orderBy(F.desc("n"), "attack_type").limit(top)
    )
    attacks = listing(lately, "attack_type", [(-F.col("n")).alias("k"), F.col("attack_type")]).withColumnRenamed("text", "lately")
    active = alerts.agg(F.count_if(F.col("status").isin("open", "investigating")).alias("active"))
    rate = F.when(
        F.col("total") > 0, F.concat(fixed_text(F.col("attacks") / F.col("total") * 100, 1), F.lit("%"))
    ).otherwise("N/A")
    one = totals.crossJoin(severities).crossJoin(attacks).crossJoin(active)  # four single rows
    return one.select(
        F.concat_ws(
            "\n",
            F.concat(F.lit("- Total predictions analyzed: "), F.col("total").cast("string")),
            F.concat(F.lit("- Total attacks detected: "), F.col("attacks").cast("string"), F.lit(" ("), rate, F.lit(" attack rate)")),
            F.concat(F.lit("- Open/investigating alerts: "), F.col("active").cast("string")),
            F.concat(F.lit("- Severity breakdown: "), F.col("severities")),
            F.concat(F.lit("- Recent attacks (last 24h): "), F.coalesce(F.nullif("lately", F.lit("")), F.lit("None"))),
        ).alias("summary")
    )
