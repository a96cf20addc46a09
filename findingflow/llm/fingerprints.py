"""Threshold-scaled document fingerprints, in DataFrame functions only.

A fingerprint keeps every five-word shingle hash below a fixed fraction of the hash range, so fingerprints of very
unequal documents compare by containment, and the fingerprint of a union is the union of fingerprints. A text whose
hashes all lie above the threshold keeps its least one, which merging preserves too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FRACTION = 0.25
LEAST = -(1 << 63)
PER_RANGE, MOST_RANGES, MOST_PARTS, MOST_SAMPLED = 2000, 4096, 65_536, 200_000


def sketch(df: DataFrame, text_col: str, out: str, fraction: float = FRACTION) -> DataFrame:
    """``df`` with ``out``: the sorted distinct shingle hashes kept for ``text_col``; empty for texts without words.

    Words are runs of letters, digits and underscores, in lower case; fewer than five words make one shingle.
    """
    kept = df.columns
    threshold = LEAST + int(fraction * (1 << 64))
    apart = df.withColumn("_w", F.split(F.lower(text_col), r"[^\p{L}\p{N}_]+"))
    first, last = F.when(F.get("_w", F.lit(0)) == "", 2).otherwise(1), F.size("_w") - F.when(F.element_at("_w", -1) == "", 1).otherwise(0)
    words = apart.withColumn("_w", F.slice("_w", first, F.greatest(last - first + 1, F.lit(0))))
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.size("_w") - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(5)]))
    hashed = words.select(*kept, F.when(F.size("_w") > 0, each).otherwise(F.array().cast("array<bigint>")).alias("_h"))
    below = hashed.withColumn("_s", F.filter("_h", lambda h: h < threshold))
    least = F.when(F.size("_h") > 0, F.array(F.array_min("_h"))).otherwise(F.col("_h"))
    return below.select(*kept, F.when(F.size("_s") > 0, F.array_sort(F.array_distinct("_s"))).otherwise(least).alias(out))


def spell(hashes: str) -> Column:
    """A sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(hashes, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def resemblance(a: str, b: str) -> Column:
    """Estimated Jaccard similarity of two texts from their sketches; 1 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - both
    return F.when(total == 0, 1.0).otherwise(both / total)


def containment(a: str, b: str) -> Column:
    """Estimated share of a's shingles that b has; 1 if a is empty."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def cuts_of(rows: DataFrame, key: str) -> tuple[list[int], dict[int, int]]:
    """Bounds that cut the keys into ranges of about equal count, and keys with many rows with the parts each is split into.

    At most MOST_RANGES bounds, by quantiles of at most about MOST_SAMPLED rows (bounds only decide where rows are
    worked on), and two around each hot key: one with more rows than four ranges should have, counted over all rows, so
    there are fewer of them than ranges.
    """
    n = rows.count()
    ranges = max(1, min(MOST_RANGES, n // PER_RANGE))
    if ranges == 1:
        return [], {}
    usual = max(PER_RANGE, n // ranges)
    hot = {r[key]: min(MOST_PARTS, -(-r["count"] // usual)) for r in rows.groupBy(key).count().where(F.col("count") > 4 * usual).collect()}
    seen = rows.select(key) if n <= MOST_SAMPLED else rows.select(key).sample(MOST_SAMPLED / n, 7)
    bounds = seen.agg(F.percentile_approx(key, [k / ranges for k in range(1, ranges)], 4 * ranges)).first()[0] or []
    return sorted({*bounds, *hot, *(k + 1 for k in hot if k < -LEAST - 1)}), hot


def place_in(bounds: list[int], key: str) -> Column:
    """How many bounds are at or below the key, by binary search."""
    if not bounds:
        return F.lit(0)
    held = F.array(*map(F.lit, bounds)) if len(bounds) < 16 else F.from_json(F.lit(str(bounds)), "array<bigint>")
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    beyond = lambda at: F.coalesce(F.get(held, at - 1) <= F.col(key), F.lit(False))
    return F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda low, width: F.when(beyond(low + width), low + width).otherwise(low))


def dealt_in_order(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` (doc_id, text, a bigint ``key``) in ranges (``_bucket``) by key, each with the first row of the next range as a guest (``_guest`` 1).

    Ranges have about equal counts however the keys are spread, and the rows of a hot key are split by a
    hash of their text, so that a window over each range, by key and text, finds every row's successor; the first
    range follows the last. No window spans all rows. Only repetitions of one row always stay together.
    """
    bounds, hot = cuts_of(rows, key)
    part = F.lit(0).cast("bigint")
    if hot:
        parts = F.element_at(F.create_map(*[F.lit(x) for pair in hot.items() for x in pair]), F.col(key))
        part = F.coalesce(F.pmod(F.xxhash64("text"), parts), F.lit(0).cast("bigint"))
    dealt = rows.select("*", (place_in(bounds, key).cast("bigint") * (2 * MOST_PARTS) + part).alias("_bucket"))
    firsts = dealt.groupBy("_bucket").agg(F.min(key).alias("_first"))
    order = Window.orderBy("_bucket")  # ranges and parts, not rows
    after = lambda c: F.coalesce(F.lead(c).over(order), F.first(c).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    turns = firsts.select(F.col("_bucket").alias("_for"), after("_bucket").alias("_next"), after("_first").alias("_next_key"))
    met = dealt.join(F.broadcast(turns), (F.col("_bucket") == F.col("_next")) & (F.col(key) == F.col("_next_key")))
    guests = met.groupBy(F.col("_for").alias("_bucket"), key).agg(F.min("text").alias("text"), F.first("doc_id").alias("doc_id"))
    return dealt.withColumn("_guest", F.lit(0)).unionByName(guests.withColumn("_guest", F.lit(1)))


def fingerprint_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fraction: float = FRACTION) -> DataFrame:
    """Fingerprints of every text and of its edited text, and how alike they are.

    The edited text is the text with its last floor(n_chars / 2) code points replaced by the first as many (or all)
    of the next document's, by ascending id, the first after the last. Null texts count as empty; null ids come
    first; rows of one id follow each other by text (those of an id with very many rows, part by part); a single row
    is its own next. Texts without words have an empty fingerprint. An empty table gives an empty one; other columns
    are ignored.
    """
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(id_col).cast("bigint"), F.lit(LEAST)).alias("_key"), F.coalesce(text_col, F.lit("")).alias("text"))
    signed = sketch(dealt_in_order(rows, "_key"), "text", "own", fraction)
    order = Window.partitionBy("_bucket").orderBy("_guest", "_key", "text")
    following = signed.select("doc_id", "_guest", "text", "own", F.lead("text").over(order).alias("next"), F.lead("own").over(order).alias("next_own")).where("_guest = 0")
    half = F.floor(F.length("text") / 2).cast("int")
    edit = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    edited = sketch(following.select("doc_id", F.length("text").cast("bigint").alias("n_chars"), "own", "next_own", edit.alias("edited")), "edited", "edited_own", fraction)
    return edited.select(
        "doc_id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        spell("own").alias("fingerprint"),
        spell("edited_own").alias("edited_fingerprint"),
        resemblance("own", "edited_own").alias("near_edited"),
        resemblance("own", "next_own").alias("near_next"),
        containment("own", "edited_own").alias("contained_in_edited"),
        containment("own", "next_own").alias("contained_in_next"),
    )
