"""Near duplicates by DartMinHash signatures, banded joins and exact checks.

Darts with hashed places are thrown at the regions of a text's weighted shingles (shingle x weight x rank), as many per
unit of area for every text.  A dart hits if it lies below the shingle's weight; of the hits at ranks below a
bound only some k ln k + 2 k are ever made, however long the text.  The earliest hit of each of k coordinates
is the signature.  Two texts agree in a coordinate with the probability of their weighted Jaccard similarity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from vigilflow.llm.common import TEXT_ROWS, blocks, giving_back, mix, release, span_hashes, stored, utf8, word_spans

WORDS = 5
ROWS, BANDS = 4, 24
SIMILARITY = 0.8
DELTA_BYTES = 1 << 19
WORTH = 50
TURNS = 100  # of star steps; their number grows with the logarithm of the nodes
ODD = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(column: pa.Array, words: int = WORDS, weighted: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(text number, element) of the word shingles of all texts, sorted, each once.

    Words are lower case and split at ASCII white space; a text with fewer than ``words`` words has one shingle
    of all of them, one without words none.  ``weighted``: the n-th occurrence of a shingle is an element of its own, so
    that sets of elements have the similarity of the texts' counts.
    """
    raw, ends = utf8(pc.utf8_lower(column.cast(pa.large_string())))
    starts, stops, text = word_spans(raw, ends)
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    values = span_hashes(raw, starts, stops)
    counts = np.bincount(text, minlength=len(column))
    left = np.repeat(np.cumsum(counts), counts)[np.arange(len(text))] - np.arange(len(text))  # words from here to the text's end
    first = np.append(True, text[1:] != text[:-1])
    total = np.zeros(len(values), np.uint64)
    for k in range(words):
        inside = left > k
        total[inside] += values[np.flatnonzero(inside) + k] * ODD[k]
    use = (left >= words) | (first & (left < words))
    text, total = text[use], mix(total[use] ^ np.minimum(left[use], words).astype(np.uint64))
    order = np.lexsort((total, text))
    text, total = text[order], total[order]
    new = np.append(True, (text[1:] != text[:-1]) | (total[1:] != total[:-1]))
    if weighted:
        begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        copy = (np.arange(len(new)) - begin).astype(np.uint64)
        return text, mix(total + copy * ODD[40])
    return text[new], total[new]


def signatures(text: np.ndarray, elements: np.ndarray, n: int, k: int, weights: np.ndarray | None = None) -> np.ndarray:
    """(n, k) DartMinHash signatures; rows of texts without elements are zero.

    Each element has a region one unit of weight wide (``weights``: up to that part of it; elements of more than one unit
    come as several).  Ranks of the darts in a region are a Poisson process read in rising order, up to one over
    the text's weight; where a coordinate got no dart, the text's bound is doubled.
    """
    out = np.zeros((n, k), np.uint64)
    density = k * np.log(k) + 2 * k
    total = np.bincount(text, weights=weights, minlength=n)
    with np.errstate(divide="ignore"):
        bound = np.where(total > 0, 1 / np.maximum(total, 1e-300), 0.0)
    todo = np.flatnonzero(total > 0)
    unit = 1 / (1 << 53)
    while len(todo):
        pending = np.zeros(n, bool)
        pending[todo] = True
        use = np.flatnonzero(pending[text])
        rank = np.zeros(len(use))
        slots, ranks, marks = [], [], []
        throw = 0
        while len(use):
            seed = mix(elements[use] + ODD[41:42] * np.uint64(throw))
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 1) * unit) / density
            near = rank < bound[text[use]]
            use, rank, seed = use[near], rank[near], seed[near]
            hit = slice(None)
            if weights is not None:
                hit = (mix(seed ^ ODD[42]) >> np.uint64(11)).astype(np.float64) * unit < weights[use]
            slots.append(text[use][hit] * k + (mix(seed ^ ODD[43]) % np.uint64(k)).astype(np.int64)[hit])
            ranks.append(rank[hit])
            marks.append(mix(seed ^ ODD[44])[hit])
            throw += 1
        slots, ranks, marks = np.concatenate(slots), np.concatenate(ranks), np.concatenate(marks)
        order = np.lexsort((ranks, slots))
        slots, marks = slots[order], marks[order]
        earliest = np.append(True, slots[1:] != slots[:-1]) if len(slots) else np.zeros(0, bool)
        out.ravel()[slots[earliest]] = marks[earliest]
        filled = np.bincount(slots[earliest] // k, minlength=n) == k
        todo = todo[~filled[todo]]
        bound[todo] *= 2
    return out


def band_keys(signature: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """(n, bands) keys: equal only in the same band and for equal coordinates."""
    n, k = signature.shape
    parts = signature.reshape(n, k // rows, rows)
    key = np.broadcast_to(mix(np.arange(1, k // rows + 1, dtype=np.uint64)), (n, k // rows)).copy()
    for row in range(rows):
        key = mix(key * ODD[45] + parts[:, :, row])
    return key


def with_bands(texts: DataFrame, text: str, words: int, weighted: bool, rows: int, bands: int) -> DataFrame:
    """``_id`` and ``_bands``: the band keys of each text, none for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A text gets some 6 k darts however short it is.
        for batch in blocks(batches, text, rows=512):
            owner, elements = shingles(batch.column(text), words, weighted)
            n = batch.num_rows
            keys = band_keys(signatures(owner, elements, n, rows * bands), rows)
            some = np.bincount(owner, minlength=n) > 0
            offsets = np.append(0, np.cumsum(some * bands)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys[some].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("_id"), lists], ["_id", "_bands"])

    return texts.mapInArrow(giving_back(run), "_id binary, _bands array<long>")


def compared(edges: DataFrame, texts: DataFrame, words: int, weighted: bool) -> DataFrame:
    """(_center, _id, _a, _b, _c, _delta), stored: for each pair the sizes of the node's and the center's set of
    shingles, of what they share, and the elements (32 bits each, sorted) that only one of them has.

    A text travels once, with the list of its centers (at most one per band); then its elements meet those of each
    center.  A popular center is no hot spot: AQE splits the join.
    """
    both = edges.select("_center", "_id").union(edges.select("_center", F.col("_center")).distinct())
    need = both.groupBy("_id").agg(F.collect_set("_center").alias("_centers"))
    one = texts.dropDuplicates(["_id"])

    def elements(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_text"):
            owner, found = shingles(batch.column("_text"), words, weighted)
            cuts = np.searchsorted(owner, np.arange(1, batch.num_rows))
            sets = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in np.split(found, cuts)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_id"), batch.column("_centers"), pa.array(sets, pa.binary())], ["_id", "_centers", "_set"]
            )

    sets = one.join(need.hint("merge"), "_id").select("_id", "_centers", "_text")
    sets = stored(sets.mapInArrow(giving_back(elements), "_id binary, _centers array<binary>, _set binary"), "sets", TEXT_ROWS)
    pairs = sets.select("_id", "_set", F.explode("_centers").alias("_center")).where(F.col("_id") != F.col("_center"))
    own = F.array_contains("_centers", F.col("_id"))  # every center has itself in its list
    centers = sets.where(own).select(F.col("_id").alias("_center"), F.col("_set").alias("_other"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_set", 8 * DELTA_BYTES):
            rows = []
            for left, right in zip(batch.column("_set"), batch.column("_other")):
                x, y = np.frombuffer(left.as_buffer(), np.uint32), np.frombuffer(right.as_buffer(), np.uint32)
                delta = np.setxor1d(x, y, assume_unique=True)
                rows.append((len(x), len(y), (len(x) + len(y) - len(delta)) // 2, delta.tobytes()))
            columns = list(zip(*rows)) if rows else [()] * 4
            arrays = [pa.array(v, k) for v, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays([batch.column("_center"), batch.column("_id"), *arrays], ["_center", "_id", "_a", "_b", "_c", "_delta"])

    joined = pairs.join(centers.hint("merge"), "_center").select("_center", "_id", "_set", "_other")
    schema = "_center binary, _id binary, _a long, _b long, _c long, _delta binary"
    out = stored(joined.mapInArrow(giving_back(compare), schema), "compared", TEXT_ROWS)
    release(sets)
    return out


def linked(similarity: float) -> Column:
    return F.col("_c") >= similarity * (F.col("_a") + F.col("_b") - F.col("_c"))


def similar_by_delta(pairs: DataFrame, similarity: float) -> DataFrame:
    """(_center, _id) of the similar pairs among rows with both nodes' sizes and differences from the same center.

    What two sets share follows from what each shares with the center and from their common differences.
    """

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_delta", 8 * DELTA_BYTES):
            keep = []
            numbers = zip(*(batch.column(c).to_pylist() for c in ("_a", "_c", "_b", "_a2", "_c2")))
            for left, right, (a, c, b, a2, c2) in zip(batch.column("_delta"), batch.column("_delta2"), numbers):
                x, y = np.frombuffer(left.as_buffer(), np.uint32), np.frombuffer(right.as_buffer(), np.uint32)
                common = c + c2 - b + len(np.intersect1d(x, y, assume_unique=True))
                keep.append(common >= similarity * (a + a2 - common))
            yield batch.select(["_id", "_id2"]).rename_columns(["_center", "_id"]).filter(pa.array(keep, pa.bool_()))

    return pairs.select("_id", "_id2", "_a", "_b", "_c", "_delta", "_a2", "_c2", "_delta2").mapInArrow(giving_back(similar), "_center binary, _id binary")


def with_roots(found: DataFrame, roots: DataFrame | None) -> DataFrame:
    """Adds the components of node and center; of the groups by center those whose nodes lie in several components."""
    if roots is None:
        out = found.withColumns({"_root": F.col("_id"), "_main": F.col("_center")})
    else:
        mains = roots.select(F.col("_id").alias("_center"), F.col("_root").alias("_main"))
        out = found.join(roots.hint("merge"), "_id", "left").join(mains.hint("merge"), "_center", "left")
        out = out.withColumns({"_root": F.coalesce("_root", "_id"), "_main": F.coalesce("_main", "_center")})
    split = out.groupBy("_center").agg(F.min("_root").alias("_low"), F.max("_root").alias("_high")).where("_low <> _high")
    keys = stored(split.select("_center"), "split")
    return stored(out.join(keys.hint("merge"), "_center", "left_semi"), "groups")


def second(frame: DataFrame, *columns: str) -> DataFrame:
    """``frame`` with the given columns renamed for the other side of a pair."""
    return frame.select("_center", *(F.col(c).alias(f"{c}2") for c in columns))


def prefix_pairs(groups: DataFrame, similarity: float) -> DataFrame:
    """(_center, _id, _id2): pairs of nodes of a group, in different components, that may be similar.

    Let U be a node that is not similar to its center C, V any other node of the group, t = s / (1 + s).  U and V are
    similar only if their differences from C have x >= t(|U| + |V|) + |C| - |U & C| - |V & C| elements in common.  As U is not
    similar to C, x > t|V| + (1 - t)|C| - |V & C| whatever U is; and x >= t(|U| + |C|) - |U & C| whatever V is.  If
    two sets share x elements, any order has a shared one among the first |set| - x + 1 of both.  In the
    order rising by frequency these prefixes hold rare elements, which few nodes share.  And at the first element two nodes
    share, no more can follow than either has from there on.  Elements of one node alone come before all others, so a pair
    goes unless both hold x elements that others have, too.
    """
    t = similarity / (1 + similarity)
    size = F.octet_length("_delta") / 4
    strict = F.floor(F.greatest(F.lit(0.0), t * F.col("_a") + (1 - t) * F.col("_b") - F.col("_c") - 1e-6))
    loose = F.ceil(F.greatest(F.lit(1.0), t * (F.col("_a") + F.col("_b")) - F.col("_c") - 1e-6))
    nodes = groups.select(
        "_center", "_id", "_root", (F.col("_root") != F.col("_main")).alias("_out"), "_delta",
        (size - strict).cast("long").alias("_short"), (size - loose + 1).cast("long").alias("_long"), size.cast("long").alias("_size"),
        (t * F.col("_a") + F.col("_b") / 2 - F.col("_c")).alias("_part"),  # x >= the parts of U and V
    )

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks(batches, "_delta", DELTA_BYTES):
            deltas = [np.frombuffer(d.as_buffer(), np.uint32) for d in batch.column("_delta")]
            at = pa.array(np.repeat(np.arange(len(deltas)), [len(d) for d in deltas]))
            values = pa.array(np.concatenate([*deltas, np.zeros(0, np.uint32)]).astype(np.int64))
            columns = ["_center", "_id", "_root", "_out", "_short", "_long", "_size", "_part"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in columns), values], [*columns, "_e"])

    schema = "_center binary, _id binary, _root binary, _out boolean, _short long, _long long, _size long, _part double, _e long"
    rows = stored(nodes.mapInArrow(giving_back(spread), schema), "differences")
    often = rows.groupBy("_center", "_e").agg(F.count(F.lit(1)).alias("_n"), F.max("_out").alias("_any")).where("_n > 1")
    often = stored(often, "frequencies")
    common = rows.join(often.hint("merge"), ["_center", "_e"])
    # Elements of one node come first in the order but meet nobody.
    node = Window.partitionBy("_center", "_id")
    ranked = common.withColumns({"_place": F.row_number().over(node.orderBy("_n", "_e")), "_shared": F.count(F.lit(1)).over(node)})
    ranked = ranked.withColumns({"_rank": F.expr("_place + _size - _shared"), "_left": F.expr("_shared - _place + 1")})
    reach = F.when(F.col("_out"), F.greatest("_short", "_long")).otherwise(F.col("_short"))
    prefixes = ranked.where(F.col("_any") & (F.col("_rank") <= reach))
    near = (F.col("_rank") <= F.col("_short")).alias("_near")
    prefixes = stored(prefixes.select("_center", "_e", "_id", "_root", "_out", near, "_part", "_left"), "prefixes")
    release(rows, often)
    left = prefixes.where("_out")
    right = prefixes.where("_near").select("_center", "_e", *(F.col(c).alias(f"{c}2") for c in ("_id", "_root", "_out", "_part", "_left")))
    pairs = left.join(right.hint("merge"), ["_center", "_e"])
    pairs = pairs.where("_root <> _root2 and (not _out2 or (_near and _id < _id2)) and _part + _part2 - 1e-6 <= least(_left, _left2)")
    return pairs.select("_center", "_id", "_id2").distinct()


def components(links: DataFrame, a: str, b: str, label: str) -> DataFrame:
    """(_id, _root) of all nodes of ``links``: the smallest id of their component.

    Large-star and small-star steps by turns, as joins; each turn is stored, until a turn changes nothing.
    Raises if ``TURNS`` turns are not enough, as links would be lost.
    """
    edges = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), f"{label}-0")
    before = None
    for turn in range(1, TURNS + 1):
        every = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = every.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = every.join(least.hint("merge"), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large, old = stored(large.where("u <> v").distinct(), f"{label}-{turn}l"), edges
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least.hint("merge"), "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct(), f"{label}-{turn}s")
        release(old, large)
        state = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise RuntimeError(f"components still change after {TURNS} turns")
    roots = edges.groupBy(F.col("u").alias("_id")).agg(F.min("v").alias("_root"))
    return roots.union(edges.select(F.col("v").alias("_id"), F.col("v").alias("_root")).distinct())


def same_class(places: DataFrame, texts: DataFrame, words: int, weighted: bool, similarity: float) -> DataFrame | None:
    """(_id, _root) of linked nodes from (_band, _id, _p): bucket, node, popularity; None if nothing is linked.

    All nodes of a bucket are compared with its most popular one, the center.  What two nodes have in common follows from
    their differences from the same center.  So the nodes of a center that are not in its component are then compared with
    the most popular of them, and at last with all other nodes of the center that a prefix filter on the differences
    leaves.  No bucket is expanded into all pairs, and no similar pair that shares a bucket is lost.
    """
    top = places.groupBy("_band").agg(F.max(F.struct("_p", "_id")).alias("_top")).select("_band", F.col("_top._id").alias("_center"))
    top = stored(top, "centers")
    edges = places.join(top.hint("merge"), "_band").where("_id <> _center")
    edges = stored(edges.groupBy("_center", "_id").agg(F.max("_p").alias("_p")), "edges")
    release(top)
    found = compared(edges, texts, words, weighted)
    links = found.where(linked(similarity)).select("_center", "_id")

    def joined(links: DataFrame, label: str) -> DataFrame | None:
        return None if links.isEmpty() else stored(components(links, "_center", "_id", label), label)

    roots = joined(links, "first")
    groups = with_roots(found, roots)
    outside = groups.where("_root <> _main").join(edges.hint("merge"), ["_center", "_id"])
    lead = outside.groupBy("_center").agg(F.max(F.struct("_p", "_id", "_a", "_c", "_delta")).alias("_top")).select("_center", "_top.*")
    lead = stored(second(lead, "_id", "_a", "_c", "_delta"), "leads")
    pairs = outside.join(lead.hint("merge"), "_center").where("_id <> _id2 and _root <> _id2")
    more = stored(similar_by_delta(pairs, similarity), "more")
    release(lead)
    links = links.union(more)
    if WORTH * more.count() > links.count():  # else the last step bears a few needless pairs
        roots = joined(links, "second")
        groups = with_roots(found, roots)
    pairs = prefix_pairs(groups, similarity)
    nodes = groups.select("_center", "_id", "_a", "_b", "_c", "_delta")
    pairs = pairs.join(nodes.hint("merge"), ["_center", "_id"])
    pairs = pairs.join(second(nodes, "_id", "_a", "_c", "_delta").hint("merge"), ["_center", "_id2"])
    last = stored(similar_by_delta(pairs, similarity), "last")
    if not (more.isEmpty() and last.isEmpty()):
        roots = joined(links.union(last), "third")
    release(found, edges)
    return roots


def _members(
    docs: DataFrame, key: str, text: str, words: int, similarity: float, weighted: bool, rows: int, bands: int
) -> DataFrame:
    """(_key, _id, class_size, _first) of each row, stored: key, digest of the text, size and first (key, digest) of its class."""
    body = docs.select(F.col(key).alias("_key"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    body = body.select("_key", F.unhex(F.md5("_text")).alias("_id"), "_text")
    texts = body.select("_id", "_text")
    signed = stored(with_bands(texts, "_text", words, weighted, rows, bands), "bands", TEXT_ROWS)
    places = signed.dropDuplicates(["_id"]).select("_id", F.explode("_bands").alias("_band"))
    places = stored(places, "places")
    release(signed)
    # Keys are stored before large joins: where one owns many rows, AQE can then split it.
    counts = stored(places.groupBy("_band").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1"), "counts")
    counted = stored(places.join(counts.hint("merge"), "_band"), "shared")
    release(places, counts)
    popular = counted.groupBy("_id").agg(F.sum("_n").alias("_p"))
    shared = stored(counted.join(popular.hint("merge"), "_id").drop("_n"), "popular")
    release(counted)
    roots = same_class(shared, texts, words, weighted, similarity)
    release(shared)

    members = body.select("_key", "_id")
    if roots is None:
        members = members.withColumn("_root", F.col("_id"))
    else:
        members = members.join(roots.hint("merge"), "_id", "left").select("_key", "_id", F.coalesce("_root", "_id").alias("_root"))
    members = stored(members, "members")
    classes = members.groupBy("_root").agg(F.count(F.lit(1)).alias("class_size"), F.min(F.struct("_key", "_id")).alias("_first"))
    classes = stored(classes, "firsts")
    out = stored(members.join(classes.hint("merge"), "_root").drop("_root"), "classes")
    release(members, classes)
    return out


def _is_first() -> Column:
    return F.col("_key").eqNullSafe(F.col("_first._key")) & (F.col("_id") == F.col("_first._id"))


def near_duplicates(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    words: int = WORDS,
    similarity: float = SIMILARITY,
    weighted: bool = False,
    rows: int = ROWS,
    bands: int = BANDS,
) -> DataFrame:
    """One row per row of ``docs``: key, class_id, class_size, kept.

    Classes are the components of the links between texts of ``similarity`` or more; class_id is the smallest
    key in the class.  ``kept`` marks the row with that key (of several the one with the least text digest; rows equal in
    key and text are all marked).  Null texts count as empty; texts without words link to none, but equal texts, empty ones
    included, are one class.  A pair of the threshold similarity shares a band with probability 1 - 3e-6; every pair that
    shares one is compared unless its class is known from other pairs.  Equal texts are one node.
    """
    members = _members(docs, key, text, words, similarity, weighted, rows, bands)
    return members.select(F.col("_key").alias(key), F.col("_first._key").alias("class_id"), "class_size", _is_first().alias("kept"))


def drop_near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each class of ``near_duplicates``; of rows equal in key and text one, too."""
    defaults = {"words": WORDS, "similarity": SIMILARITY, "weighted": False, "rows": ROWS, "bands": BANDS}
    members = _members(docs, key, text, **(defaults | options))
    first = members.where(_is_first()).select("_key", "_id").distinct()
    body = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(key).alias("_k"),
        F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))).alias("_d"),
    )
    kept = body.join(first.hint("merge"), F.col("_k").eqNullSafe(F.col("_key")) & (F.col("_d") == F.col("_id")), "left_semi")
    return kept.dropDuplicates(["_k", "_d"]).select("_row.*")
