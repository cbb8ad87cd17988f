"""Document fingerprints: bottom-k sketches of shingle hashes; DataFrame expressions only.

The sketch of a set of shingles is its ``k`` smallest 64-bit hashes in rising order.  Sketches of
parts merge to the sketch of the whole, and estimate resemblance, containment and the number of
distinct shingles.

Edge cases: a null text is an empty one, whose sketch is empty; two empty sketches resemble each
other fully, an empty and another not at all; a text of fewer words than a shingle is one shingle;
equal texts have equal sketches.  In ``edited``: rows of equal doc_id follow each other by a hash of
the text; a null doc_id comes after all others; a single document is its own next one; doc_ids may
be as far apart as 64 bits allow; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skeinwork.llm.words import words

#: Sketch size and words of a shingle.
K, SHINGLE = 128, 5

#: Ranges of doc_id at most (their first rows are broadcast), rows of each at least, and parts of the rows of one frequent doc_id.
RANGES, ROWS, PARTS = 1 << 16, 64, 64


def shingles(w: str, size: int = SHINGLE) -> Column:
    """Hashes of the shingles of the array column named ``w``."""
    run = F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *(F.get(w, i + j) for j in range(1, size))))
    return F.when(F.size(w) == 0, F.array().cast("array<long>")).when(F.size(w) < size, F.array(F.xxhash64(F.array_join(w, " ")))).otherwise(run)


def sketch(hashes: Column, k: int = K) -> Column:
    """Bottom-k sketch of an array of hashes."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """Sketch of the union of two sketched sets."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard likeness of two sketched sets."""
    both = merge(a, b, k)
    shared = F.size(F.array_intersect(F.array_intersect(both, a), b))
    return F.when(F.size(both) == 0, F.lit(1.0)).otherwise(shared / F.greatest(F.size(both), F.lit(1)))


def distinct(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below ``k``."""
    part = (F.get(a, F.lit(k - 1)).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise(F.lit(float(k - 1)) / part)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of ``a``'s shingles that ``b`` has."""
    j = resemblance(a, b, k)
    shared = j / (1 + j) * (distinct(a, k) + distinct(b, k))
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / F.greatest(distinct(a, k), F.lit(1.0))))


def fingerprint(a: Column) -> Column:
    """A sketch as text: base64 of its hashes, eight bytes each."""
    return F.regexp_replace(F.base64(F.unhex(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 16, "0")), ""))), r"\s", "")


def with_sketch(df: DataFrame, text: str, name: str, k: int = K) -> DataFrame:
    """Add the sketch of column ``text``."""
    return df.withColumn("_w", words(F.coalesce(F.col(text), F.lit("")))).withColumn(name, sketch(shingles("_w"), k)).drop("_w")


def followed(docs: DataFrame, carried: list[str]) -> DataFrame:
    """Rows of ``docs`` (doc_id, text, ``carried``) with ``next_`` columns of the document that follows
    by falling doc_id; after the last comes the first.

    Rows go to ranges of doc_id between quantiles, so ranges are alike however ids are spread; the first
    row of each range is also sent, as a stand-in, to the end of the range before, so no row needs another
    range, and nothing is ordered in one task.  A doc_id so frequent that it is two quantiles, and the null
    one, go to parts of their own by the hash of the text, by which their rows are ordered anyway.
    """
    n = docs.filter(F.col("doc_id").isNotNull()).count()
    ranges = max(1, min(RANGES, n // ROWS))
    shares = [k / ranges for k in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", shares, max(10_000, 8 * ranges))).first()[0] or [] if shares else []
    bounds = sorted(set(found))
    frequent = sorted({a for a, b in zip(found, found[1:]) if a == b})
    side = max(1, math.isqrt(len(bounds)))
    number = lambda x: F.split(F.lit(",".join(map(str, x))), ",").cast("array<long>") if x else F.array().cast("array<long>")
    up_to = lambda values: F.size(F.filter(values, lambda b: b <= F.col("doc_id")))
    coarse = up_to(number(bounds[::side]))
    fine = up_to(F.slice(number(bounds), (F.greatest(coarse, F.lit(1)) - 1) * side + 1, side))
    reached = F.when(coarse == 0, F.lit(0)).otherwise((coarse - 1) * side + fine).cast("long")
    part = F.shiftright("hash", 58) + F.lit(33)  # 1 to PARTS, rising with the hash
    of_frequent = F.col("doc_id").isin(frequent) if frequent else F.lit(False)
    # a frequent doc_id is the least of its range, so it comes last there
    at = F.when(F.col("doc_id").isNull(), F.lit(1).cast("long") * 2 * PARTS + part).otherwise(-reached * 2 * PARTS + F.when(of_frequent, part).otherwise(0))
    placed = docs.withColumn("hash", F.xxhash64("text")).withColumn("at", at)
    heads = docs.select("doc_id", F.xxhash64("text").alias("hash")).withColumn("at", at).groupBy("at").agg(F.max(F.struct("doc_id", F.bitwise_not("hash").alias("turned"))).alias("head"))
    by_place = Window.orderBy("at")  # RANGES rows and PARTS of each frequent doc_id, at most
    whole = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = F.coalesce(F.lag("at").over(by_place), F.last("at").over(whole))
    heads = F.broadcast(heads.select("at", "head", before.alias("before")))
    is_head = F.col("doc_id").eqNullSafe(F.col("head.doc_id")) & (F.bitwise_not("hash") == F.col("head.turned"))
    own = F.struct(F.col("at"), F.lit(0).alias("late"))
    stand_in = F.struct(F.col("before").alias("at"), F.lit(1).alias("late"))
    placed = placed.join(heads, "at").withColumn("place", F.explode(F.when(is_head, F.array(own, stand_in)).otherwise(F.array(own))))
    placed = placed.select(*docs.columns, "hash", "place.*")
    order = Window.partitionBy("at").orderBy("late", F.desc_nulls_last("doc_id"), "hash")
    return placed.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in carried)).filter("late = 0").drop("at", "late", "hash")


def edited(docs: DataFrame, k: int = K) -> DataFrame:
    """Sketches of every text, of its edited text and of the next document, with their likenesses.

    Edited: the last half of the code points (rounded down) gives way to as many of the next document.
    """
    whole = with_sketch(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "sketch", k)
    pairs = followed(whole, ["text", "sketch"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    cut = F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("next_text", F.lit(1), half))
    made = with_sketch(pairs.withColumn("edited", cut).drop("text", "next_text"), "edited", "edited_sketch", k)
    return made.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "sketch",
        "edited_sketch",
        resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"),
        distinct(F.col("sketch"), k).alias("n_shingles"),
        containment(F.col("sketch"), F.col("edited_sketch"), k).alias("kept_in_edited"),
    )
