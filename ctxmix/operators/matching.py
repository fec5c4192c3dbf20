"""Substring (containment) joins without a nested loop over both full sides.

``contained_pairs`` finds every (needle, haystack) with needle a substring of the
haystack, for short strings such as titles, as equi-joins:

* needles of length >= 3 are keyed by their rarest trigram (frequency measured on
  the haystack side) and joined with the exploded trigrams of each haystack, then
  verified with ``contains``. Lossless: a contained needle shares every trigram.
* a needle whose rarest trigram is in more than ``RARE`` haystacks, and which is long enough, is
  keyed by its rarest gram of six characters instead, then of twelve and of twenty-four, with the
  haystacks' grams of that length: keys grow until they are rare. What stays common has matches
  in about as many haystacks as it has candidates; its join is dealt by the haystack's hash.
* needles of length 1 or 2 join the exploded 1- and 2-grams of the haystacks.
* the empty needle is contained in every haystack: when present (a one-row check),
  every haystack is emitted once with it, without any join.

``cover_join`` handles long needles in long texts (passages in documents) by whole words:
each needle is keyed by its rarest interior word pair.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .skew import salted_join


def grams(s: Column, n: int) -> Column:
    """Distinct character n-grams of ``s`` (empty array when shorter than n)."""
    idx = F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1)))
    arr = F.transform(idx, lambda i: F.substring(s, i, n))
    return F.when(F.length(s) >= n, F.array_distinct(arr)).otherwise(
        F.array().cast("array<string>"))


#: Haystacks that may share a needle's key before it grows, and the lengths of keys.
RARE, LENGTHS = 1000, (3, 6, 12, 24)


def rarest_keys(n: DataFrame, h: DataFrame, rare: int = RARE) -> list[tuple[int, DataFrame]]:
    """(length, needles ``n`` with their key ``g`` and the number ``cnt`` of haystacks that have it): each needle
    once, with the shortest key that is rare enough, else with the longest it has."""
    out, left = [], n.where(F.length("n") >= LENGTHS[0])
    for size, longer in zip(LENGTHS, [*LENGTHS[1:], None]):
        freq = h.select(F.explode(grams(F.col("h"), size)).alias("g")).groupBy("g").agg(F.count(F.lit(1)).alias("cnt"))
        each = left.select("n", F.explode(grams(F.col("n"), size)).alias("g")).join(freq, "g", "left").withColumn("cnt", F.coalesce("cnt", F.lit(0)))
        # a needle with a gram found in no haystack has minimum count 0 and cannot match anything
        keyed = materialize(each.groupBy("n").agg(F.min(F.struct("cnt", "g")).alias("k")).where("k.cnt > 0").select("n", "k.g", "k.cnt"), "keys")
        grows = (F.col("cnt") > rare) & (F.length("n") >= (longer or 0)) if longer else F.lit(False)
        out.append((size, keyed.where(~grows)))
        left = keyed.where(grows).select("n")
        if longer is None or left.isEmpty():
            return out
    return out


def contained_pairs(needles: DataFrame, haystacks: DataFrame, needle: str = "needle",
                    haystack: str = "haystack", rare: int = RARE) -> DataFrame:
    """All distinct ``(needle, haystack)`` with ``contains(haystack, needle)``."""
    n = needles.select(F.col(needle).alias("n")).where(F.col("n").isNotNull()).distinct()
    h = haystacks.select(F.col(haystack).alias("h")).where(F.col("h").isNotNull()).distinct()

    hits = []
    for size, keyed in rarest_keys(n, h, rare):
        found = salted_join(h.select("h", F.explode(grams(F.col("h"), size)).alias("g")), keyed.select("n", "g"), "g", "h", 4)
        hits.append(found.where(F.col("h").contains(F.col("n"))).select("n", "h"))
    long_hits = reduce(DataFrame.unionByName, hits)

    h12 = h.select("h", F.explode(F.concat(grams(F.col("h"), 1), grams(F.col("h"), 2))).alias("g"))
    short = n.where(F.length("n").between(1, 2))
    short_hits = short.join(h12, short["n"] == h12["g"]).select("n", "h")

    out = long_hits.unionByName(short_hits)
    if n.where(F.length("n") == 0).limit(1).count() > 0:
        out = out.unionByName(h.select(F.lit("").alias("n"), "h"))
    return out.select(F.col("n").alias(needle), F.col("h").alias(haystack))


def either_contains_pairs(left: DataFrame, right: DataFrame, left_col: str,
                          right_col: str) -> DataFrame:
    """Distinct ``(left, right)`` where one string contains the other (both directions)."""
    # Both directions read the same two distinct sets; identical exchanges in one plan
    # are reused by Spark, so each distinct is shuffled once.
    left = left.select(left_col).where(F.col(left_col).isNotNull()).distinct()
    right = right.select(right_col).where(F.col(right_col).isNotNull()).distinct()
    a = contained_pairs(left.select(F.col(left_col).alias("needle")),
                        right.select(F.col(right_col).alias("haystack")))
    a = a.select(F.col("needle").alias(left_col), F.col("haystack").alias(right_col))
    b = contained_pairs(right.select(F.col(right_col).alias("needle")),
                        left.select(F.col(left_col).alias("haystack")))
    b = b.select(F.col("haystack").alias(left_col), F.col("needle").alias(right_col))
    return a.unionByName(b).distinct()


def _words(c: Column) -> Column:
    return F.split(c, " ")


def _needle_keys(n: Column) -> tuple[Column, Column]:
    """(kind, keys) of a needle: what every text that contains it must have.

    Four words or more: hashes of its interior word pairs, which stand whole in the text.
    Three words: its middle word. Fewer: its trigrams, or itself if it has two characters or less.
    """
    w = _words(n)
    inner = F.slice(w, 2, F.greatest(F.size(w) - 2, F.lit(0)))
    kind = F.when(F.size(w) >= 4, "pair").when(F.size(w) == 3, "word").when(F.length(n) >= 3, "gram").otherwise("char")
    keys = (F.when(kind == "pair", _pair_hashes(inner)).when(kind == "word", F.transform(inner, lambda x: F.xxhash64(x)))
            .when(kind == "gram", F.transform(grams(n, 3), lambda x: F.xxhash64(x))).otherwise(F.array(F.xxhash64(n))))
    return kind, keys


def _pair_hashes(w: Column) -> Column:
    """Hashes of neighbouring words. Arrays are zipped, not looked up by place: an array expression inside a
    lambda would be evaluated for each element."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.xxhash64(a, b))


def _text_grams(t: Column, n: int) -> Column:
    """Distinct character n-grams of a long text, in one pass over its characters."""
    chars = F.filter(F.split(t, ""), lambda c: c != "")
    size = F.greatest(F.size(chars) - (n - 1), F.lit(0))
    out = F.slice(chars, 1, size)
    for k in range(1, n):
        out = F.zip_with(out, F.slice(chars, k + 1, size), lambda a, b: F.concat(a, b))
    return F.array_distinct(out)


def _text_keys(t: Column, kind: str) -> Column:
    if kind == "pair":
        return F.array_distinct(_pair_hashes(_words(t)))
    if kind == "word":
        return F.array_distinct(F.transform(_words(t), lambda x: F.xxhash64(x)))
    if kind == "gram":
        return F.transform(_text_grams(t, 3), lambda x: F.xxhash64(x))
    return F.transform(F.concat(_text_grams(t, 1), _text_grams(t, 2)), lambda x: F.xxhash64(x))


def cover_join(texts: DataFrame, needles: DataFrame, text: str, needle: str,
               text_id: str, needle_id: str) -> DataFrame:
    """Rows of ``texts x needles`` with ``contains(texts.text, needles.needle)``, as equi-joins.

    Each needle is keyed by the rarest of its keys (see :func:`_needle_keys`), counted over all texts. Only the keys
    that some needle has leave the texts, as hashes with the text's id; candidate
    pairs are then verified on the strings. Ids are unique on their side. The empty needle is in
    every text and needs no join to be found.
    """
    n = needles.where(F.col(needle).isNotNull())
    kind, keys = _needle_keys(F.col(needle))
    keyed = n.where(F.length(needle) > 0).select(F.col(needle_id), kind.alias("kind"), F.explode(F.array_distinct(keys)).alias("key"))
    kinds = sorted(r["kind"] for r in keyed.select("kind").distinct().collect())  # four at most
    t = texts.where(F.col(text).isNotNull())
    pairs = None
    wanted = materialize(keyed, "needle-keys")
    for k in kinds:
        own = wanted.where(F.col("kind") == k)
        seen = materialize(t.select(F.col(text_id), F.explode(_text_keys(F.col(text), k)).alias("key"))
                           .join(own.select("key").distinct(), "key", "left_semi"), "text-keys")
        counts = seen.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        # a needle with a key that no text has is in none
        rarest = (own.join(counts, "key", "left").groupBy(needle_id)
                  .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k"))
                  .where("k.n > 0").select(needle_id, F.col("k.key").alias("key")))
        found = seen.join(rarest, "key").select(text_id, needle_id)
        pairs = found if pairs is None else pairs.unionByName(found)
    if n.where(F.length(needle) == 0).limit(1).count():
        blank = n.where(F.length(needle) == 0).select(needle_id)
        ids = salted_join(t.select(text_id, F.lit(1).alias("one")), blank.withColumn("one", F.lit(1)), "one", text_id, 64).drop("one")
        pairs = ids if pairs is None else pairs.unionByName(ids)
    if pairs is None:
        return t.join(n, F.lit(False))
    return (pairs.join(t, text_id).join(n, needle_id).where(F.col(text).contains(F.col(needle)))
            .select(*texts.columns, *needles.columns))
