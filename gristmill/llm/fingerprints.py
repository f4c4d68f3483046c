"""Document fingerprints by a threshold-scaled sketch (operator 7), in DataFrame functions only.

A text's sketch holds every distinct hash of its word 5-grams that lies below a
fixed fraction of the hash space.  Sketches of parts merge into the sketch of
the whole, and intersection over size estimates containment however unequal two
texts are.  The smallest hash is always kept, so a text with words has a sketch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

WORDS = 5
#: One of so many hashes is kept.
SCALE = 4
#: Rows that one window of neighbours holds, about.
GROUP_ROWS = 4096
SEGMENTS = 64
#: Ids of groups' first rows that are broadcast, at most.
HEADS_BROADCAST = 1_000_000


def with_sketch(df: DataFrame, text: str, out: str, scale: int = SCALE) -> DataFrame:
    """df with out, array<long>: the sorted sketch of column text.

    Lower-cased words between white space; fewer than five are one shingle
    together.  A null, empty or blank text has an empty sketch.
    """
    limit = -(1 << 63) + (1 << 64) // scale
    df = df.withColumn("_w", F.transform(F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"\s+"), lambda w: w != ""), lambda w: F.xxhash64(w)))
    n = F.size("_w")
    grams = F.transform(F.sequence(F.lit(1), n - WORDS + 1), lambda i: F.xxhash64(*(F.element_at("_w", i + j) for j in range(WORDS))))
    df = df.withColumn("_g", F.when(n >= WORDS, grams).when(n > 0, F.array(F.xxhash64("_w"))).otherwise(F.array().cast("array<bigint>")))
    kept = F.concat(F.filter("_g", lambda g: g < F.lit(limit)), F.when(n > 0, F.array(F.array_min("_g"))).otherwise(F.array().cast("array<bigint>")))
    return df.withColumn(out, F.array_sort(F.array_distinct(kept))).drop("_w", "_g")


def merged(one: Column | str, two: Column | str, scale: int = SCALE) -> Column:
    """The sketch of two texts' shingles together."""
    limit = -(1 << 63) + (1 << 64) // scale
    both = F.array_sort(F.array_union(one, two))
    return F.filter(both, lambda x, i: (x < F.lit(limit)) | (i == 0))


def likeness(one: Column | str, two: Column | str) -> Column:
    """Estimated Jaccard similarity of two sketches, 0 to 1; two empty ones are alike (1)."""
    same = F.size(F.array_intersect(one, two))
    total = F.size(one) + F.size(two) - same
    return F.when(total == 0, 1.0).otherwise(same / total)


def containment(one: Column | str, two: Column | str) -> Column:
    """Estimated share of the first text's shingles that the second has; an empty first one is contained."""
    return F.when(F.size(one) == 0, 1.0).otherwise(F.size(F.array_intersect(one, two)) / F.size(one))


def as_string(sketch: Column | str) -> Column:
    """Sixteen lower-case hex digits for each hash, in order."""
    return F.lower(F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), ""))


def grouped_by_range(docs: DataFrame, rows: int = GROUP_ROWS) -> DataFrame:
    """docs with seg and grp: ascending groups of doc_id, of about rows rows where ids are spread evenly in a segment.

    Segments lie between quantiles of doc_id, groups cut a segment evenly.  A
    null doc_id is in segment -1, first in order.
    """
    n, least, most = docs.agg(F.count("doc_id"), F.min("doc_id"), F.max("doc_id")).first()
    if not n:
        return docs.withColumn("seg", F.lit(-1)).withColumn("grp", F.lit(0).cast("long"))
    k = max(1, min(SEGMENTS, n // rows))
    inner = docs.select(F.percentile_approx("doc_id", [i / k for i in range(1, k)] or [0.5], 10_000)).first()[0] if k > 1 else []
    bounds = sorted({int(least), *map(int, inner)})
    ends = [*bounds[1:], int(most) + 1]
    each = max(1, -(-n // (len(bounds) * rows)))
    widths = [max(1, -(-(b - a) // each)) for a, b in zip(bounds, ends, strict=True)]
    # ids may lie further apart than a long reaches, so distances and widths are decimals
    wide = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    at, starts, width = F.array(*map(F.lit, bounds)), F.array(*map(wide, bounds)), F.array(*map(wide, widths))
    docs = docs.withColumn("seg", F.coalesce(F.aggregate(at, F.lit(0), lambda acc, b: acc + (b <= F.col("doc_id")).cast("int")) - 1, F.lit(-1)))
    i = F.col("seg") + 1
    distance = F.col("doc_id").cast("decimal(20,0)") - F.element_at(starts, i)
    inside = (distance - distance % F.element_at(width, i)) / F.element_at(width, i)
    return docs.withColumn("grp", F.when(F.col("seg") < 0, F.lit(0).cast("long")).otherwise(inside.cast("long")))


def with_next(docs: DataFrame, columns: list[str], more: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """docs with next_<column>: that column of the next row in ascending (doc_id, text) order; after the last row, of the first.

    more adds the columns that docs has not itself: it is applied to all rows
    once, and to the first rows of groups after they are picked.  One shuffle
    moves the rows into groups of neighbouring ids; the first row of each
    group, one in some thousand, is joined to the group before it.
    """
    docs = grouped_by_range(docs)
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    ranks = docs.groupBy("seg", "grp").agg(F.min("doc_id").alias("head"))
    within = ranks.withColumn("to", F.lead(F.struct("seg", "grp")).over(Window.partitionBy("seg").orderBy("grp")))
    first = ranks.groupBy("seg").agg(F.min("grp").alias("grp"))  # at most SEGMENTS + 1 rows
    turn = first.agg(F.array_sort(F.collect_list(F.struct("seg", "grp"))).alias("all"))
    following = F.coalesce(F.array_min(F.filter("all", lambda s: s["seg"] > F.col("seg"))), F.element_at("all", 1))
    jumps = first.join(F.broadcast(turn)).select("seg", following.alias("jump"))
    to = within.join(F.broadcast(jumps), "seg").select("seg", "grp", F.coalesce("to", "jump").alias("to"))
    first_ids = ranks.where("head is not null").select(F.col("head").alias("doc_id"))
    if first_ids.count() <= HEADS_BROADCAST:  # counted, so the broadcast has a known size; else both sides are shuffled
        first_ids = F.broadcast(first_ids)
    plain = docs.select("seg", "grp", "doc_id", "text")
    heads = plain.join(first_ids, "doc_id", "left_semi").union(plain.where("doc_id is null").select("doc_id", "seg", "grp", "text"))
    heads = heads.groupBy("seg", "grp").agg(F.min_by("text", F.struct(F.col("text").isNotNull(), "text")).alias("text"))
    heads = more(heads).select("seg", "grp", F.struct(*columns).alias("first"))
    heads = to.join(heads.select(F.struct("seg", "grp").alias("to"), "first"), "to").select("seg", "grp", "first")
    docs = more(docs)
    window = Window.partitionBy("seg", "grp").orderBy(*order)
    docs = docs.withColumn("_next", F.lead(F.struct(*columns)).over(window)).join(heads, ["seg", "grp"], "left")
    for c in columns:
        docs = docs.withColumn(f"next_{c}", F.when(F.col("_next").isNotNull(), F.col("_next")[c]).otherwise(F.col("first")[c]))
    return docs.drop("seg", "grp", "_next", "first")


def fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """(doc_id, sketch array<long>, fingerprint string) of docs(doc_id, text).

    A null or empty text has an empty sketch and the fingerprint ''; equal texts
    have equal fingerprints; rows stay apart, those of one doc_id or none too;
    other columns are ignored.
    """
    out = with_sketch(docs.select("doc_id", "text"), "text", "sketch", scale)
    return out.select("doc_id", "sketch", as_string("sketch").alias("fingerprint"))


def edited_fingerprints(docs: DataFrame, scale: int = SCALE) -> DataFrame:
    """Fingerprints of docs(doc_id, text) and of their edited texts, with likenesses.

    Edited: the last quarter of the code points, rounded down, replaced by the
    first as many (or all) of the next document.  A null text counts as empty;
    rows with equal doc_id follow each other by text; other columns are ignored.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    docs = with_next(docs, ["text", "sketch"], lambda df: with_sketch(df, "text", "sketch", scale))
    docs = docs.withColumn("n_chars", F.char_length("text").cast("long"))
    part = F.floor(F.col("n_chars") / 4).cast("int")
    docs = docs.withColumn("edited", F.concat(F.substr("text", F.lit(1), F.col("n_chars").cast("int") - part), F.substr("next_text", F.lit(1), part)))
    docs = with_sketch(docs, "edited", "edited_sketch", scale)
    return docs.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        as_string("sketch").alias("fingerprint"),
        as_string("edited_sketch").alias("edited_fingerprint"),
        likeness("sketch", "edited_sketch").alias("near_edited"),
        likeness("sketch", "next_sketch").alias("near_next"),
        containment("sketch", "edited_sketch").alias("contained_in_edited"),
    )
