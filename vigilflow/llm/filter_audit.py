"""How five filters interact: what each removes, repeats or loses, in all 120 orders of application.

Copies are found by an existential self-join: a row whose hash and exact text stand under a smaller id fails E.  The rows that
fail E are united with those that fail the others; combined they give one bit set per row.  Whatever
the order of the filters, its counts follow from the number of rows of each bit set, at most 32 per part.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, functions as F

from vigilflow.llm.common import release, stored

FILTERS = "ABCDE"
ORDERS = ["".join(p) for p in permutations(FILTERS)]
MIN_WORDS = 50
BIT = {letter: 1 << i for i, letter in enumerate(FILTERS)}


def words(text: Column) -> Column:
    """Words end at ASCII white space; a split at one blank needs no regular expression."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\x0c\r", " " * 5), " "), "")


def failures(text: Column) -> Column:
    """Bits of the filters A to D that ``text`` with the words ``_words`` fails: short, repetitive, shouting, marked up."""
    capitals = F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    n, different = F.size("_words"), F.size(F.array_distinct("_words"))
    failed = {
        "A": n < MIN_WORDS, "B": 100 * different < 65 * n, "C": 100 * capitals > 5 * F.length(text),
        "D": text.rlike("[#$%&*|]"),
    }
    return sum((F.when(c, BIT[letter]).otherwise(0) for letter, c in failed.items()), F.lit(0))


def copies(rows: DataFrame) -> DataFrame:
    """(_id, _part, _hash) of the rows of ``rows`` (_id, _part, _hash, _text) whose text also stands under a smaller id.

    Only texts of a hash that stands twice are kept and moved again.  Of each text the smallest id is enough to tell; it is found
    with combining on the map side.  All sides are stored, so that AQE can split a text that owns many rows in both joins.
    """
    often = stored(rows.groupBy("_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_hash"), "hashes")
    twice = stored(rows.join(often.hint("merge"), "_hash", "left_semi"), "twice")
    least = twice.groupBy("_hash", "_text").agg(F.min("_id").alias("_least"))
    least = stored(least.select(F.col("_hash").alias("_h"), F.col("_text").alias("_t"), "_least"), "least")
    same = (F.col("_hash") == F.col("_h")) & (F.col("_text") == F.col("_t")) & (F.col("_least") < F.col("_id"))
    return twice.join(least.hint("merge"), same, "left_semi").select("_id", "_part", "_hash")


def combinations(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """(part, mask, n, good, toxic), stored: rows of each part by the set of filters that they fail."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("_part"), F.xxhash64(body).alias("_hash"), body.alias("_text"))
    bits = failures(F.col("_text")).alias("_bits")
    plain = rows.withColumn("_words", words(F.col("_text"))).select("_id", "_part", "_hash", bits, F.lit(1).alias("_n"))
    again = copies(rows).select("_id", "_part", "_hash", F.lit(BIT["E"]).alias("_bits"), F.lit(0).alias("_n"))
    # Rows equal in id, part and text fail alike, so one bit set stands for all of them.
    masks = plain.unionByName(again).groupBy("_id", "_part", "_hash").agg(F.bit_or("_bits").alias("mask"), F.sum("_n").alias("_n"))
    masks = stored(masks, "masks")
    judged = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_lid")).agg(
        F.max((F.coalesce(F.col("quality"), F.lit(0)) == 1).cast("int")).alias("_good"),
        F.max((F.coalesce(F.col("toxic"), F.lit(0)) == 1).cast("int")).alias("_toxic"),
    )
    judged = stored(judged, "judged")
    known = masks.join(judged.hint("merge"), F.col("_id") == F.col("_lid"), "left")
    share = lambda c: F.sum(F.col("_n") * F.coalesce(F.col(c), F.lit(0)))
    counts = known.groupBy(F.col("_part").alias("part"), "mask").agg(F.sum("_n").alias("n"), share("_good").alias("good"), share("_toxic").alias("toxic"))
    out = stored(counts, "masks-by-part")
    release(masks, judged)
    return out


def by_order(counts: DataFrame) -> DataFrame:
    """All orders and steps of each part of ``counts`` (part, mask, n, good, toxic; one row per part and mask)."""
    sets = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("_sets"))
    rows = sets.withColumn("filter_order", F.explode(F.array(*map(F.lit, ORDERS)))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    place = lambda letter: F.instr("filter_order", letter)
    bits = lambda use: sum((F.when(use(place(x)), b).otherwise(0) for x, b in BIT.items()), F.lit(0))
    rows = rows.withColumns({"_bit": bits(lambda at: at == F.col("step")), "_before": bits(lambda at: at < F.col("step"))})

    def total(field: str, use) -> Column:
        chosen = lambda s: F.when(use(s["mask"]), s[field]).otherwise(F.lit(0))
        return F.aggregate("_sets", F.lit(0).cast("long"), lambda n, s: n + chosen(s))

    def failing(mask: Column) -> Column:
        return mask.bitwiseAND(F.col("_bit")) != 0

    def here(mask: Column) -> Column:
        return failing(mask) & (mask.bitwiseAND(F.col("_before")) == 0)

    orders = len(ORDERS)
    # In a set of k filters each comes first in one k-th of all orders.
    shares = lambda s: F.when(failing(s["mask"]), s["n"] * F.lit(orders) / F.bit_count(s["mask"])).otherwise(F.lit(0.0))
    return rows.select(
        "part", "filter_order", "step",
        total("n", lambda m: m.bitwiseAND(F.col("_bit").bitwiseOR(F.col("_before"))) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m: failing(m) & (m.bitwiseAND(F.col("_before")) != 0)).alias("redundant"),
        total("n", lambda m: m == F.col("_bit")).alias("unique_fails"),
        total("good", here).alias("good_lost"), total("toxic", here).alias("toxic_lost"),
        F.round(F.aggregate("_sets", F.lit(0.0), lambda n, s: n + shares(s))).cast("long").alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", part: str = "source") -> DataFrame:
    """One row per part, order of the five filters and step, zeros included.

    Filters: A under 50 words; B 100 * distinct words < 65 * words; C 100 * capitals > 5 * characters; D a character of
    ``#$%&*|``; E a text that also stands under a smaller id.  Null texts count as empty, null parts are part ''.  Every row of
    ``docs`` counts, repeated ones too; a row without id never fails E and has no label.  A document is good (toxic) if any of its
    ``labels`` rows (key, quality, toxic) says 1.  No rows of ``docs``: no rows.  Other columns of ``docs`` do not matter.
    """
    return by_order(combinations(docs, labels, key, text, part))
