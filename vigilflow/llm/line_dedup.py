"""Line dedup by a suffix array over line-id sequences, by DataFrame functions only.

The corpus is one sequence of line ids per document.  The array holds the suffixes whose first line stands at two
places or more.  Prefix doubling ranks them: pass k orders the suffixes that share 2^k lines by the ranks of the suffixes 2^k
lines on; ranks come from range partitions and their running counts, so no task orders all.  A suffix leaves when nobody
shares its prefix or when it ends, so the longest repeat sets the number of passes.  Each suffix keeps its rank of
every pass.  Neighbours of the array part in one pass, which gives the leading bit of their longest common prefix; the ranks of
the suffixes so many lines on give the next bits.  The intervals of the array with common prefixes of
``min_lines`` lines are the repeated runs: the first suffix by place keeps its lines and those of the later ones go;
overlapping intervals of a document join to its maximal runs.  Intervals of fewer lines count where these have over ``long_words`` words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.llm.common import release, stored

NAME = ["_a", "_b"]
WORD = r"[^\x20\x09-\x0D]+"
LONG_WORDS = 50
WHOLE, LONELY = -2, -1  # order of suffixes that end here and of those whose next line is the only one of its kind


def _name(*parts: Column) -> list[Column]:
    return [F.xxhash64(F.lit(seed), *parts).alias(name) for seed, name in zip((1, 2), NAME)]


def _words(text: Column) -> Column:
    """The number of words.  The pattern makes a string of each word, so it is left to texts with other blanks than single inner spaces."""
    odd = F.contains(text, F.lit("  ")) | F.startswith(text, F.lit(" ")) | F.endswith(text, F.lit(" "))
    for blank in "\t\n\x0b\f\r":
        odd = odd | F.contains(text, F.lit(blank))
    by_spaces = F.octet_length(text) - F.octet_length(F.replace(text, F.lit(" "), F.lit(""))) + 1
    return F.when(text == "", 0).when(odd, F.regexp_count(text, F.lit(WORD))).otherwise(by_spaces)


def _n_lines(text: Column) -> Column:
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def _dealt(frame: DataFrame, order: list[str], label: str) -> DataFrame:
    """``frame`` stored in range partitions of ``order``, whose numbers are in ``_part``."""
    return stored(frame.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), label)


def _running(dealt: DataFrame, order: list[str], sums: dict[str, Column]) -> DataFrame:
    """Adds to rows of ``_dealt`` the sums of columns up to each row, this one included; one row a partition gives the offsets."""
    values = dealt.select("*", *(value.alias(f"_of{name}") for name, value in sums.items()))
    totals = values.groupBy("_part").agg(*(F.sum(f"_of{name}").alias(f"_to{name}") for name in sums))
    past = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_part", *(F.coalesce(F.sum(f"_to{name}").over(past), F.lit(0)).alias(f"_to{name}") for name in sums))
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    within = values.select(*dealt.columns, *(F.sum(f"_of{name}").over(here).alias(name) for name in sums))
    out = within.join(F.broadcast(offsets), "_part")
    return out.select(*dealt.columns, *((F.col(name) + F.col(f"_to{name}")).alias(name) for name in sums))


def _first_ranks(docs: DataFrame, key: str, text: str, place: list[str], asked) -> DataFrame:
    """(place, _n_lines, _words, _rank, _path, _alone, _done) of the lines that stand at two places or more."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(key, body.alias("_body")).where(asked(F.col("_body")))
    rows = rows.select(key, F.xxhash64("_body").alias("_h"), _n_lines(F.col("_body")).alias("_n_lines"), F.split("_body", "\n").alias("_lines"))
    # Lines are rows before anything is computed of them: generated code, which functions over arrays are not.  Every text
    # has a line; the outer form spares a filter that would split the texts once more to find that out.
    rows = rows.select(key, "_h", "_n_lines", F.posexplode_outer("_lines").alias("_line", "_text"))
    before = stored(rows.select(*place, "_n_lines", *_name(F.col("_text")), _words(F.col("_text")).alias("_words")), "lines")
    # Counts are combined on the map side; names are stored, so that AQE can split the rows of a hot one in the join.
    shared = before.groupBy(*NAME).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    dealt = _dealt(shared, NAME, "names")
    names = _running(dealt, NAME, {"_upto": F.col("_n")}).select(*NAME, (F.col("_upto") - F.col("_n")).alias("_rank"))
    names = stored(names, "ranked")
    ranks = before.join(names.hint("merge"), NAME).dropDuplicates(place).select(
        *place, "_n_lines", "_words", "_rank", F.array("_rank").alias("_path"), F.lit(False).alias("_alone"), F.lit(False).alias("_done")
    )
    out = stored(ranks, "rank0")
    release(before, dealt, names)
    return out


def _at(frame: DataFrame, place: list[str], shift: Column, **columns: str) -> tuple[DataFrame, list[Column]]:
    """Columns of suffixes under new names, and the condition that joins each to the one ``shift`` lines before it."""
    tail = frame.select(*(F.col(c).alias(f"_t{c}") for c in place), *(F.col(c).alias(name) for name, c in columns.items()))
    same = [F.col(c).eqNullSafe(F.col(f"_t{c}")) for c in place[:-1]]
    return tail, [*same, F.col(place[-1]) + shift == F.col(f"_t{place[-1]}")]


def _doubled(ranks: DataFrame, place: list[str], shift: int) -> DataFrame:
    """Ranks by twice as many lines: those of equal rank by ``shift`` lines are ordered by the suffixes ``shift`` lines on."""
    tail, same = _at(ranks.where(F.col("_line") >= shift), place, F.lit(shift), _next="_rank", _lonely="_alone")
    whole = F.col("_line") + shift >= F.col("_n_lines")
    active = ranks.where("not _done").join(tail.hint("merge"), same, "left").select(
        *ranks.columns, whole.alias("_whole"),
        F.when(whole, F.lit(WHOLE)).otherwise(F.coalesce("_next", F.lit(LONELY))).cast("long").alias("_code"),
        (~whole & F.coalesce("_lonely", F.lit(True))).alias("_unlike"),
    )
    active = stored(active, "active")  # counted first, then given its ranks
    order = ["_rank", "_code", "_unlike"]
    dealt = _dealt(active.groupBy(*order).agg(F.count(F.lit(1)).alias("_n")), order, "codes")
    upto = _running(dealt, order, {"_upto": F.col("_n")}).select(
        *order, (F.col("_upto") - F.col("_n")).alias("_before"), (F.col("_unlike") | (F.col("_n") == 1)).alias("_single")
    )
    upto = stored(upto, "running")
    starts = stored(upto.groupBy("_rank").agg(F.min("_before").alias("_start")), "starts")
    finer = upto.join(starts.hint("merge"), "_rank").select(*order, "_single", (F.col("_rank") + F.col("_before") - F.col("_start")).alias("_new"))
    moved = active.join(finer.hint("merge"), order).select(
        *place, "_n_lines", "_words", F.col("_new").alias("_rank"),
        F.when(F.col("_single"), F.col("_path")).otherwise(F.concat("_path", F.array("_new"))).alias("_path"),
        F.col("_single").alias("_alone"), (F.col("_single") | F.col("_whole")).alias("_done"),
    )
    out = stored(ranks.where("_done").unionByName(moved), f"rank{2 * shift}")
    release(active, dealt, upto, starts)
    return out


def suffix_array(docs: DataFrame, key: str, text: str, asked=lambda body: F.lit(True)) -> DataFrame:
    """(key, _h, _line, _n_lines, _words, _rank, _part, _lcp), stored: the array in the order (_part, _rank, key, _h, _line) with the number of
    lines each suffix has in common with the one before it.

    Only suffixes whose first line stands twice or more are in it.  Lines that stand once come before all others, in no order among them.
    """
    place = [key, "_h", "_line"]
    ranks, shift = _first_ranks(docs, key, text, place, asked), 1
    while not ranks.where("not _done").isEmpty():
        before, ranks = ranks, _doubled(ranks, place, shift)
        release(before)
        shift *= 2
    order = ["_rank", *place]
    held = [*order, "_path", "_alone"]
    dealt = _dealt(ranks, order, "order")
    # The last row of each range partition stands before the first of the next one: one row a partition.
    lasts = dealt.groupBy("_part").agg(F.max(F.struct(*held)).alias("_end"))
    lasts = lasts.select("_part", F.lag("_end").over(Window.orderBy("_part")).alias("_end"))
    previous = F.lag(F.struct(*held)).over(Window.partitionBy("_part").orderBy(*order))
    pairs = dealt.select("*", previous.alias("_prev")).join(F.broadcast(lasts), "_part").withColumn("_prev", F.coalesce("_prev", "_end")).drop("_end")
    # Ranks of a pass refine those of the one before, so the passes in which two suffixes agree come first.
    agree = F.size(F.filter(F.transform("_path", lambda x, i: x == F.get("_prev._path", i)), lambda x: x))
    equal = ~F.col("_alone") & ~F.col("_prev._alone") & (F.col("_path") == F.col("_prev._path"))
    pairs = pairs.withColumns({"_agree": F.coalesce(F.when(F.col("_prev").isNotNull(), agree), F.lit(0)), "_equal": F.coalesce(equal, F.lit(False))})
    lcp = F.when(F.col("_equal"), F.col("_n_lines") - F.col("_line")).when(F.col("_agree") > 0, F.pow(F.lit(2), F.col("_agree") - 1).cast("int")).otherwise(0)
    pairs = pairs.select(*place, "_n_lines", "_words", "_rank", "_part", *(F.col(f"_prev.{c}").alias(f"_p{c}") for c in place), "_agree", "_equal", lcp.alias("_lcp"))
    pairs = stored(pairs, "neighbours")
    release(dealt)
    top = pairs.where("not _equal").agg(F.max("_agree")).first()[0] or 0
    asking = (F.col("_agree") >= 2) & ~F.col("_equal")  # the others part within two lines, or never
    known, asked_again = pairs.where(~asking), pairs.where(asking)
    kept = None
    for level in range(top - 2, -1, -1):
        before, now = kept, (F.col("_agree") >= level + 2) & ~F.col("_equal")
        far = ranks.where(F.col("_line") >= 2 << level)  # those who ask have so many lines in common at least
        here, same = _at(far, place, F.col("_lcp"), _path="_path", _alone="_alone")
        there, also = _at(far.withColumnsRenamed({c: f"_p{c}" for c in place}), [f"_p{c}" for c in place], F.col("_lcp"), _path2="_path", _alone2="_alone")
        both = asked_again.where(now).join(here.hint("merge"), same, "left").join(there.hint("merge"), also, "left")
        ended = F.coalesce((F.col("_path") == F.col("_path2")) & ~F.col("_alone") & ~F.col("_alone2"), F.lit(False))
        step = F.when(ended, F.col("_n_lines") - F.col("_line") - F.col("_lcp")).when(F.get("_path", F.lit(level)) == F.get("_path2", F.lit(level)), 1 << level)
        both = both.select(*(c for c in pairs.columns if c not in ("_lcp", "_equal")), ended.alias("_equal"), (F.col("_lcp") + F.coalesce(step, F.lit(0))).alias("_lcp"))
        kept = asked_again = stored(asked_again.where(~now).unionByName(both), f"lcp{level}")
        if before is not None:
            release(before)
    out = stored(known.unionByName(asked_again).select(*place, "_n_lines", "_words", "_rank", "_part", "_lcp"), "array")
    release(pairs, ranks, *([kept] if kept is not None else []))
    return out


def repeated_windows(docs: DataFrame, key: str, text: str, min_lines: int, long_words: int | None = LONG_WORDS) -> DataFrame:
    """(key, _h, _line, _len) of each later copy of ``min_lines`` lines in a row, or of fewer with over ``long_words`` words.

    Order: key, hash of the text, line.
    """
    place = [key, "_h", "_line"]

    def asked(body: Column) -> Column:
        # Without the last line break asked for, all of the text comes before it.
        enough = F.substring_index(body, "\n", min_lines - 1) != body if min_lines > 1 else F.lit(True)
        return enough if long_words is None else enough | (_words(F.replace(body, F.lit("\n"), F.lit(" "))) > long_words)

    array = suffix_array(docs, key, text, asked)
    depths = [min_lines] if long_words is None else list(range(1, min_lines + 1))
    numbered = _running(array, ["_rank", *place], {f"_i{d}": (F.col("_lcp") < d).cast("long") for d in depths})
    # The lines of a common prefix all are in the array, so a gap in a range means nothing here.
    ahead = Window.partitionBy(*place[:-1]).orderBy("_line")
    words = {f"_w{d}": F.sum("_words").over(ahead.rangeBetween(0, d - 1)) for d in depths if d < min_lines}
    numbered = stored(numbered.withColumns(words) if words else numbered, "intervals")
    release(array)
    out = None
    for d in depths:
        rows = numbered.select(*place, F.col(f"_i{d}").alias("_i"), *([f"_w{d}"] if d < min_lines else []))
        rows = rows.where(F.col(f"_w{d}") > long_words) if d < min_lines else rows
        first = rows.groupBy("_i").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct(*place)).alias("_first")).where("_n > 1")
        later = rows.join(stored(first, f"firsts{d}").hint("merge"), "_i").where(F.struct(*place) > F.col("_first"))
        later = later.select(*place, F.lit(d).alias("_len"))
        out = later if out is None else out.unionByName(later)
    return out


def repeated_runs(windows: DataFrame, key: str) -> DataFrame:
    """(key, _h, runs): per document the maximal runs [start, stop) of lines to delete."""
    grouped = windows.groupBy(key, "_h").agg(F.collect_set(F.struct("_line", "_len")).alias("_w"))
    covered = F.flatten(F.transform("_w", lambda w: F.sequence(w["_line"], w["_line"] + w["_len"] - 1)))
    lines = grouped.select(key, "_h", F.sort_array(F.array_distinct(covered)).alias("_p"))
    apart = lambda i: F.coalesce(F.get("_p", i) - F.get("_p", i - 1) > 1, F.lit(True))
    starts = F.filter("_p", lambda x, i: apart(i))
    stops = F.transform(F.filter("_p", lambda x, i: apart(i + 1)), lambda x: x + 1)
    return lines.select(key, "_h", F.arrays_zip(starts.alias("start"), stops.alias("stop")).alias("runs"))


def dedup_lines(
    docs: DataFrame, key: str = "doc_id", text: str = "text", min_lines: int = 3, long_words: int | None = LONG_WORDS
) -> DataFrame:
    """``docs`` with later copies of repeated runs deleted from ``text``; adds n_lines, n_removed and n_runs (long; columns of
    these names are replaced).

    A run is ``min_lines`` or more successive lines that stand again elsewhere, in the same document
    or another, or fewer lines with over ``long_words`` words (None: only the number of lines counts); empty lines count.  Of all copies the first by (key, hash of the text, line)
    stays.  Rows equal in key and text are one document and get the same result, so no
    row goes.  Null texts count as empty and become empty.  Lines of documents never join up.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != text)).alias("_row")  # the text travels once
    marked = docs.select(row, F.col(key).alias("_key"), F.xxhash64(body).alias("_hash"), body.alias("_text"))
    named = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    runs = repeated_runs(repeated_windows(named, "_key", "_text", min_lines, long_words), "_key")
    runs = runs.select(F.col("_key").alias("_rkey"), "_h", F.col("runs").alias("_runs"))
    joined = marked.join(runs.hint("merge"), F.col("_key").eqNullSafe(F.col("_rkey")) & (F.col("_hash") == F.col("_h")), "left")
    out = joined.withColumn("_lines", F.when(F.col("_runs").isNotNull(), F.split("_text", "\n")))
    # What stays lies before the first run, between two runs, or after the last one.
    froms = F.concat(F.array(F.lit(0)), F.transform("_runs", lambda r: r["stop"]))
    tos = F.concat(F.transform("_runs", lambda r: r["start"]), F.array(F.size("_lines")))
    gaps = F.arrays_zip(froms.alias("a"), tos.alias("b"))
    kept = F.flatten(F.transform(gaps, lambda g: F.slice("_lines", g["a"] + 1, g["b"] - g["a"])))
    rest = F.when(F.col("_runs").isNull(), F.col("_text")).otherwise(F.array_join(kept, "\n"))
    removed = F.aggregate("_runs", F.lit(0), lambda n, r: n + r["stop"] - r["start"])
    counts = {"n_lines": _n_lines(F.col("_text")), "n_removed": removed, "n_runs": F.size("_runs")}
    return out.select(
        *(rest.alias(c) if c == text else F.col(f"_row.`{c}`") for c in docs.columns if c not in counts),
        *(F.coalesce(value, F.lit(0)).cast("long").alias(name) for name, value in counts.items()),
    )
