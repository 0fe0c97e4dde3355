"""Quality rules with a verdict on the host, by DataFrame functions only.

Every text gets counts and rule failures; failures are summed per host, the host's
failure rate is shrunk towards the rate of all hosts by a beta prior fitted to the
spread between hosts, and the verdict goes back to the host's documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import SPACES, stored
from vigilflow.operators.joins import lookup_join

TRIM = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5


def text_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words.

    Words have no ASCII white space inside; null texts count as empty and have zeros.
    A word counts as repeated if it lies in a five-word window that stands at two
    places or more of its text; windows are compared by 64-bit hashes of hashes.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    out = docs.withColumn("_text", body).withColumn("_trim", F.btrim("_text", F.lit(TRIM)))
    out = out.withColumn("_words", F.when(F.col("_trim") == "", F.array().cast("array<string>")).otherwise(F.split("_trim", SPACES)))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("_lines", lines).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    positions = F.when(F.size("_words") >= WINDOW, F.sequence(F.lit(0), F.size("_words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("_windows", F.transform(positions, lambda i: F.xxhash64(*(F.get("_hashes", i + k) for k in range(WINDOW)))))
    out = out.withColumn("_distinct", F.size(F.array_distinct("_windows")))
    # Only texts that repeat a window pay for the sort.
    marked = F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = out.withColumn("_marked", F.when(F.col("_distinct") < F.size("_windows"), marked))
    equal = lambda x, k: F.coalesce(F.get("_marked", k)["h"] == x["h"], F.lit(False))
    found = F.filter("_marked", lambda x, k: equal(x, k - 1) | equal(x, k + 1))
    out = out.withColumn("_at", F.sort_array(F.transform(found, lambda x: x["i"])))
    gaps = F.transform("_at", lambda x, k: F.when(k == 0, F.lit(WINDOW)).otherwise(F.least(F.lit(WINDOW), x - F.get("_at", k - 1))))
    return out.select(
        *docs.columns,
        F.size("_words").cast("long").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.coalesce(F.aggregate(gaps, F.lit(0), lambda total, x: total + x), F.lit(0)).cast("long").alias("n_repeat_words"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def rule_failed() -> Column:
    """The base rules, many symbols, many repeated lines, or words of an odd mean length."""
    mean_chars = F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))
    return base_failed() | (F.col("n_symbols") > F.col("n_words")) | (4 * F.col("n_dup_lines") > F.col("n_words")) | (mean_chars > 20)


def host_verdicts(counted: DataFrame, host: str, max_rate: float = 0.5, max_strength: float = 1e4) -> DataFrame:
    """One row per host: documents, failures, shrunk failure rate and ``host_ok``.

    The beta prior has the mean of all documents; its strength comes from the variance of
    host rates beyond what chance explains (moments), at most ``max_strength`` documents.
    """
    hosts = counted.groupBy(host).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("bad"))
    rate = F.col("bad") / F.col("n")
    prior = hosts.agg(
        (F.sum("bad") / F.sum("n")).alias("mean"),
        F.var_pop(rate).alias("spread"),
        F.avg(F.lit(1.0) / F.col("n")).alias("chance"),
    )
    noise = F.col("mean") * (1 - F.col("mean"))
    beyond = F.col("spread") - noise * F.col("chance")
    strength = F.when(beyond > 0, F.greatest(F.lit(1.0), F.least(F.lit(max_strength), noise / beyond - 1))).otherwise(F.lit(max_strength))
    mean, weight = prior.select("mean").scalar(), prior.select(strength).scalar()
    shrunk = (F.col("bad") + mean * weight) / (F.col("n") + weight)
    return hosts.withColumn("host_rate", shrunk).select(host, "host_rate", (F.col("host_rate") <= max_rate).alias("host_ok"))


def quality_rules(docs: DataFrame, key: str = "doc_id", text: str = "text", host: str = "source", max_rate: float = 0.5) -> DataFrame:
    """One row per row of ``docs``: key, counts, base_failed, host_rate and kept.

    ``kept`` is false for rows that fail a base rule, else the verdict on their host.  Null
    hosts form one host.  The texts are read once: the narrow counts are stored, summed per
    host with map-side partial sums and joined with the few host rows (broadcast if
    small, else salted, as one host may own most rows).  An empty table gives no rows.
    """
    named = docs.select(
        F.col(key), F.col(text).alias("_body"), F.coalesce(F.concat(F.lit("="), F.col(host).cast("string")), F.lit("")).alias("_host")
    )
    counted = text_counts(named, "_body").drop("_body").withColumn("base_failed", base_failed()).withColumn("failed", rule_failed())
    counted = stored(counted, "counts")
    judged = lookup_join(counted, host_verdicts(counted, "_host", max_rate), "_host", key)
    return judged.select(
        key, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & F.col("host_ok")).alias("kept"), F.round("host_rate", 6).alias("host_rate"),
    )
