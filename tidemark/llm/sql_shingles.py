"""Shingles, signatures and similarities with DataFrame functions only, for searches that are to run no Python on the executors.

The shingles of a text are a multiset; its elements are the shingles told apart by occurrence, so that the Jaccard similarity of two sets
of elements is the weighted one of the shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

COORDINATES = 95  # 19 bands of 5: a pair at 0.8 is missed with probability 0.0005
BAND_ROWS = 5
BLANKS = r"[\x20\x09-\x0D]+"
STEPS = [1 << k for k in range(30, -1, -1)]


def _before(hashes: Column, x: Column, i: Column) -> Column:
    """How many of the first ``i`` numbers of a sorted array, of which the last is ``x``, are less than x: a search by halves."""
    less = lambda p, step: (p + step <= i) & (F.get(hashes, p + step - F.lit(1)) < x)
    return F.aggregate(F.array(*[F.lit(s) for s in STEPS]), F.lit(0), lambda p, step: F.when(less(p, step), p + step).otherwise(p))


def _told_apart(hashes: Column) -> Column:
    """Elements of a sorted array of shingle hashes: the first of equal ones stays, others get a hash of their own."""
    return F.transform(hashes, lambda x, i: F.when((i == 0) | (F.get(hashes, i - F.lit(1)) < x), x).otherwise(F.xxhash64(x, i - _before(hashes, x, i))))


def elements(text: Column, size: int) -> Column:
    """The elements of a text's shingles of ``size`` words, sorted; a text shorter than a shingle is one shingle, one without words has none."""
    words = lambda t: F.transform(F.array_remove(F.split(t, BLANKS), ""), lambda w: F.xxhash64(w))
    shingle = lambda w, i: F.xxhash64(*[F.get(w, i + F.lit(k)) for k in range(size)])
    shingles = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - F.lit(size)), lambda i: shingle(w, i))
    none = F.array().cast("array<bigint>")
    hashes = lambda w: F.when(F.size(w) >= size, F.sort_array(shingles(w))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(none)
    own = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), h).otherwise(_told_apart(h))
    # a lambda's variable is evaluated once; an expression may be evaluated wherever its column is read, filters pushed below it too
    return F.element_at(F.transform(F.transform(F.transform(F.array(text), words), hashes), own), 1)


def band_rows(texts: DataFrame, size: int, coordinates: int = COORDINATES, rows: int = BAND_ROWS) -> DataFrame:
    """(band, node) of texts (node, text): a coordinate of a band is the least of the band's hash of the elements, its bits turned by the coordinate's
    constant, so two texts agree in it with the probability of their similarity. Up to
    a hundred columns Spark compiles the aggregation into one loop. Texts without elements have no rows."""
    # the outer form, as the plain one first asks for the size of the array, by making it
    each = texts.select("node", F.explode_outer(elements(F.col("text"), size)).alias("element")).where("element is not null")
    bands = coordinates // rows
    hashed = each.select("node", *[F.xxhash64("element", F.lit(b)).alias(f"h{b}") for b in range(bands)])
    turned = lambda b, r: F.min(F.col(f"h{b}").bitwiseXOR(F.xxhash64(F.lit(r)))).alias(f"c{b}_{r}")
    least = hashed.groupBy("node").agg(*[turned(b, r) for b in range(bands) for r in range(rows)])
    keys = [F.xxhash64(F.lit(b), *[F.col(f"c{b}_{r}") for r in range(rows)]) for b in range(bands)]
    return least.select(F.explode(F.array(*keys)).alias("band"), "node")


def similarity(left: Column, right: Column, size: int) -> Column:
    """The weighted Jaccard similarity of two texts, 0 where neither has words."""
    sides = F.array(F.struct(elements(left, size).alias("a"), elements(right, size).alias("b")))
    counts = F.transform(sides, lambda s: F.struct(F.size(F.array_intersect(s["a"], s["b"])).alias("shared"), (F.size(s["a"]) + F.size(s["b"])).alias("total")))
    return F.element_at(F.transform(counts, lambda c: c["shared"] / F.greatest(c["total"] - c["shared"], F.lit(1))), 1)


def element_rows(nodes: DataFrame, size: int) -> DataFrame:
    """(node, label, size, element) of nodes (node, label, text), a row for each element."""
    made = nodes.select("node", "label", elements(F.col("text"), size).alias("elements"))
    made = made.select("node", "label", F.size("elements").cast("long").alias("size"), "elements")
    return made.select("node", "label", "size", F.explode_outer("elements").alias("element")).where("element is not null")
