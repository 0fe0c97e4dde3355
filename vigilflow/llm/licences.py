"""Licence scan: canonical digests of texts joined to digests of known licences, by DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from vigilflow.llm.licence_texts import DIGESTS, KNOWN, NOTICES

# Spellings that licence matching treats as equal.
SPELLINGS = (
    ("licence", "license"), ("organisation", "organization"), ("favour", "favor"), ("acknowledgement", "acknowledgment"),
    ("authorised", "authorized"), ("non commercial", "noncommercial"), ("sub license", "sublicense"), ("per cent", "percent"),
    ("whilst", "while"), ("wilful", "willful"), ("fulfilment", "fulfillment"), ("judgement", "judgment"),
    ("copyright holder", "copyright owner"), ("merchantibility", "merchantability"), ("https", "http"),
)
COPYRIGHT_LINE = r"(^|\n)[^\p{L}\p{N}\n(©]*(copyright|©|\(c\)|all rights reserved)[^\n]*"


def canonical(text: Column) -> Column:
    """Lower case, no copyright lines, single spaces for punctuation, one spelling; line ends stay."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "$1")
    out = F.regexp_replace(out, r"[^\p{L}\p{N}\n]+", " ")
    for old, new in SPELLINGS:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def lines_of(canonical_text: Column) -> Column:
    return F.filter(F.transform(F.split(canonical_text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def body_of(text: Column) -> Column:
    """The canonical text in one line, so that line ends do not count."""
    return F.array_join(lines_of(canonical(text)), " ")


def digest_of(text: Column) -> Column:
    return F.sha2(body_of(text), 256)


def known_digests(
    spark: SparkSession, known: tuple[tuple[str, str], ...] = KNOWN, digests: tuple[tuple[str, str], ...] = ()
) -> DataFrame:
    """(digest, licence): one row per known text, made by the same expressions as those of documents, or ready digest."""
    frame = spark.createDataFrame(list(known), "licence string, body string")
    frame = frame.select("licence", digest_of(F.col("body")).alias("digest"))
    if digests:
        frame = frame.unionByName(spark.createDataFrame(list(digests), "licence string, digest string"))
    return frame.groupBy("digest").agg(F.min("licence").alias("licence"))


def scan(
    docs: DataFrame, key: str = "doc_id", text: str = "text", known: tuple[tuple[str, str], ...] = KNOWN,
    digests: tuple[tuple[str, str], ...] = DIGESTS, notices: tuple[tuple[str, str], ...] = NOTICES,
) -> DataFrame:
    """(key, scope, licence, n): known licences found in ``docs``.

    Scope ``text``: the entire text is a known licence or notice.  Scope ``line``: n of its lines
    are, e.g. a notice within a document; a one-line text counts under both.  Scope ``notice``: one of ``notices``
    stands n times within the text, whatever its line ends; a text that is one counts under both.  Null and empty texts match
    nothing.  Rows with the same key count together.  The known digests are broadcast:
    their number is fixed by ``known`` and ``digests`` (a few dozen rows), whatever the corpus.
    """
    if len(known) + len(digests) > 10_000:
        raise ValueError("too many known texts to broadcast")
    spark = docs.sparkSession
    lines = docs.select(F.col(key), lines_of(canonical(F.col(text))).alias("_lines")).withColumn("_whole", F.array_join("_lines", " "))
    whole = F.struct(F.lit("text").alias("scope"), F.col("_whole").alias("body"))
    parts = F.transform("_lines", lambda x: F.struct(F.lit("line").alias("scope"), x.alias("body")))
    shown = spark.createDataFrame(list(notices), "licence string, body string").select(body_of(F.col("body")).alias("body")).collect()
    notice = lambda body: F.struct(F.lit("notice").alias("scope"), F.lit(body).alias("body"))
    found = [F.array_repeat(notice(r["body"]), _times(F.col("_whole"), r["body"])) for r in shown]
    rows = lines.select(key, F.explode(F.concat(F.array(whole), parts, *found)).alias("_part"))
    digested = rows.select(key, "_part.scope", F.sha2("_part.body", 256).alias("digest"))
    # Notices are known by their own digests, also where ``known`` lacks them.
    hits = digested.join(F.broadcast(known_digests(spark, known + notices, digests)), "digest")
    return hits.groupBy(key, "scope", "licence").agg(F.count(F.lit(1)).alias("n"))


def _times(body: Column, part: str) -> Column:
    """How often the words of ``part`` stand in ``body``; blanks are doubled so that neighbours need not share one."""
    words, wide = F.replace(body, F.lit(" "), F.lit("  ")), f" {part.replace(' ', '  ')} "
    text = F.concat(F.lit(" "), words, F.lit(" "))
    count = (F.length(text) - F.length(F.replace(text, F.lit(wide), F.lit("")))) / len(wide)
    return F.when(F.contains(body, F.lit(part)), count.cast("int")).otherwise(0)
