"""Global ranks, order statistics and cumulative counts without a single-task window.

A window without ``partitionBy`` sends every row to one task. For ranks the rows are dealt out by
range, sorted inside their partition, and a row's global position is its position there plus the
rows of earlier partitions; there is one number per partition and no limit to their count. For a few
order statistics the keys are cut into bins by literal bounds and the bins counted; a bin that holds a
wanted rank and is still large is cut again. Bounds come from a sample and decide only how even
the parts are; results are exact for any bounds. All order keys are compared together, so a
heavily repeated first key is split by the next.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tidemark.session import broadcast_if_small, materialize

ROWS_PER_BIN = 1_000_000
MAX_BINS = 4096  # beyond this the bins grow instead; selection then narrows the bin it needs in another round
SAMPLE_PER_BIN = 20
HOT_ROWS = 100_000  # a value with more rows is joined apart from the others
HELD_ROWS = 10_000  # values of a group that are sorted in one state
PIVOTS = 256  # evenly spaced ranks that a sketch of a large group knows
ROW_BITS = 33  # of the row number that Spark's increasing ids hold beside the partition number


@dataclass(frozen=True)
class Bins:
    """Bin number of a row as a Column, and the row count before each bin."""

    number: Column
    sizes: list[int]

    @property
    def before(self) -> Column:
        total, offsets = 0, []
        for size in self.sizes:
            offsets.append(total)
            total += size
        return F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), self.number + 1)


def _literal_key(df: DataFrame, keys: list[str], values) -> Column:
    types = {f.name: f.dataType for f in df.schema.fields}
    return F.struct(*[F.lit(v).cast(types[k]).alias(k) for k, v in zip(keys, values)])


def _bounds_below(bounds: list[Column], key: Column) -> Column:
    """How many of the sorted bounds are smaller than ``key``: a search over groups of bounds, then inside one group."""
    if not bounds:
        return F.lit(0)
    width = math.ceil(math.sqrt(len(bounds)))
    groups = [bounds[i : i + width] for i in range(0, len(bounds), width)]
    below = lambda array: F.size(F.filter(array, lambda b: b < key))
    group = below(F.array(*[g[-1] for g in groups[:-1]])) if len(groups) > 1 else F.lit(0)
    inside = F.element_at(F.array(*[F.array(*g) for g in groups]), group + 1)
    return group * width + below(inside)


def order_bins(
    df: DataFrame, keys: list[str], rows_per_bin: int = ROWS_PER_BIN, weight: str | None = None, n: int | None = None
) -> Bins:
    """Cut ``df`` into bins ordered by ``keys``; every bin holds about ``rows_per_bin`` rows.

    The driver sees a bounded sample of keys and one count per bin, never rows.
    ``weight`` sums a column per bin instead of counting rows; ``n`` is the row count where it is known.
    """
    measure = F.sum(weight) if weight else F.count(F.lit(1))
    n = df.count() if n is None else n
    wanted = math.ceil(n / rows_per_bin)
    if wanted <= 1:
        total = (df.agg(measure).first()[0] or 0) if weight else n
        return Bins(F.lit(0), [total])
    wanted = min(wanted, MAX_BINS)
    fraction = min(1.0, SAMPLE_PER_BIN * wanted / n)
    sample = sorted(tuple(r) for r in df.select(*keys).sample(fraction, seed=17).collect())
    cuts = sorted({sample[i * len(sample) // wanted] for i in range(1, wanted)}) if sample else []
    bounds = [_literal_key(df, keys, c) for c in cuts]
    number = _bounds_below(bounds, F.struct(*[F.col(k) for k in keys]))
    counted = df.groupBy(number.alias("bin")).agg(measure.alias("n")).collect()
    sizes = [0] * (len(bounds) + 1)
    for row in counted:
        sizes[row["bin"]] = row["n"]
    return Bins(number, sizes)


def ranged(df: DataFrame, keys: list[str], rows_per_bin: int) -> DataFrame:
    """``df`` dealt out by ranges of the keys, with the partition and the 1-based position in it, written so that both stay."""
    parts = max(1, math.ceil(df.count() / rows_per_bin))
    ids = df.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_id", F.monotonically_increasing_id())
    place = {"_part": F.shiftright("_id", ROW_BITS), "_at": F.col("_id").bitwiseAND(F.lit((1 << ROW_BITS) - 1)) + 1}
    return materialize(ids.withColumns(place).drop("_id"))


def _offsets(dealt: DataFrame, measure: Column) -> DataFrame:
    """(_part, _before): what the partitions before each one hold. The driver sees one number per partition."""
    sizes = sorted(tuple(r) for r in dealt.groupBy("_part").agg(measure.alias("n")).collect())
    rows, total = [], 0
    for part, n in sizes:
        rows.append((part, total))
        total += n
    return F.broadcast(dealt.sparkSession.createDataFrame(rows, "_part long, _before long"))


def global_row_number(df: DataFrame, keys: list[str], out: str = "rn", rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Exact ``row_number() over (order by keys)``; ``keys`` ascending, not null and unique together."""
    dealt = ranged(df, keys, rows_per_bin)
    numbered = dealt.join(_offsets(dealt, F.count(F.lit(1))), "_part")
    return numbered.withColumn(out, F.col("_at") + F.col("_before")).select(*df.columns, out)


def order_statistics(
    df: DataFrame, keys: list[str], ranks: list[int], rows_per_bin: int = ROWS_PER_BIN, n: int | None = None
) -> dict[int, tuple]:
    """Key tuples at the given 1-based global ranks.

    Only the bins that hold a wanted rank are sorted; other rows are counted and left alone. A bin that is
    still too large is cut into bins again.
    """
    bins = order_bins(df, keys, rows_per_bin, n=n)
    located = df.select(*keys, bins.number.alias("_bin"))
    wanted = sorted({r for r in ranks if 1 <= r <= sum(bins.sizes)})
    window = Window.partitionBy("_bin").orderBy(*keys)
    found, conditions, starts, total = {}, F.lit(False), {}, 0
    for i, size in enumerate(bins.sizes):
        inside = [r - total for r in wanted if total < r <= total + size]
        if inside and size > 2 * rows_per_bin and size < sum(bins.sizes):
            narrowed = order_statistics(located.where(F.col("_bin") == i).select(*keys), keys, inside, rows_per_bin, size)
            found.update({total + r: key for r, key in narrowed.items()})
        elif inside:
            starts[i] = total
            conditions = conditions | ((F.col("_bin") == i) & F.col("_rank").isin(inside))
        total += size
    if starts:
        rows = (
            located.where(F.col("_bin").isin(list(starts)))
            .withColumn("_rank", F.row_number().over(window))
            .where(conditions)
        )
        found.update({starts[r["_bin"]] + r["_rank"]: tuple(r[k] for k in keys) for r in rows.collect()})
    return found


def ntile_ends(n: int, buckets: int) -> list[int]:
    """Rank of the last row of each bucket but the last, as ``ntile`` deals rows out."""
    return [i * (n // buckets) + min(i, n % buckets) for i in range(1, buckets)]


def ntile_column(
    df: DataFrame, keys: list[str], buckets: int = 4, rows_per_bin: int = ROWS_PER_BIN, n: int | None = None
) -> Column:
    """``ntile(buckets) over (order by keys)`` as a comparison with ``buckets - 1`` literal keys.

    Finding the literals reads the key columns only; the wide rows are never shuffled.
    """
    n = df.count() if n is None else n
    ends = ntile_ends(n, buckets)
    cuts = order_statistics(df, keys, ends, rows_per_bin, n)
    here = F.struct(*[F.col(k) for k in keys])
    tile = F.lit(1)
    for end in ends:
        above = here > _literal_key(df, keys, cuts[end]) if end in cuts else F.lit(True)
        tile = tile + above.cast("int")
    return tile


def exact_quantiles(df: DataFrame, key: str, tiebreak: str, fractions: list[float], rows_per_bin: int = ROWS_PER_BIN) -> list[float]:
    """Linearly interpolated quantiles of a whole column, however many rows it has."""
    n = df.count()
    if n == 0:
        return [None] * len(fractions)
    spots = [(n - 1) * f for f in fractions]
    ranks = {math.floor(s) + 1 for s in spots} | {math.ceil(s) + 1 for s in spots}
    found = order_statistics(df, [key, tiebreak], sorted(ranks), rows_per_bin, n)
    result = []
    for s in spots:
        low, high = found[math.floor(s) + 1][0], found[math.ceil(s) + 1][0]
        result.append(low + (high - low) * (s - math.floor(s)))
    return result


def cumulative_counts(df: DataFrame, key: str, rows_per_bin: int = ROWS_PER_BIN, **measures: Column) -> DataFrame:
    """One row per distinct ``key``: ``n`` rows, ``n_before`` rows with a smaller key, plus ``measures``.

    Repeated values are aggregated first, so a value that fills a third of the table is one row here.
    """
    values = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), *[m.alias(a) for a, m in measures.items()])
    dealt = ranged(materialize(values), [key], rows_per_bin)
    running = Window.partitionBy("_part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    before = dealt.withColumn("_own", F.coalesce(F.sum("n").over(running), F.lit(0))).join(_offsets(dealt, F.sum("n")), "_part")
    return before.withColumn("n_before", F.col("_own") + F.col("_before")).drop("_part", "_at", "_own", "_before")


def average_rank(df: DataFrame, key: str, out: str, rows_per_bin: int = ROWS_PER_BIN, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Add the tie-averaged rank of ``key`` to every row; rows with a null key go.

    The rows of a value that has more than ``hot_rows`` are not brought together: there are few such values, and they go to the rows.
    """
    ranks = cumulative_counts(df.select(key), key, rows_per_bin)
    ranks = materialize(ranks.select(key, "n", (F.col("n_before") + (F.col("n") + 1) / 2).alias(out)))
    hot = ranks.where(F.col("n") > hot_rows).select(key, out)
    if hot.isEmpty():
        return df.join(ranks.drop("n"), key)
    hot = broadcast_if_small(hot)
    rest = df.join(hot.select(key), key, "left_anti").join(ranks.where(F.col("n") <= hot_rows).select(key, out), key)
    return df.join(hot, key).unionByName(rest)


def _inside(rows: DataFrame, state: DataFrame, group: str, value: str) -> DataFrame:
    above = F.col("lo").isNull() | (F.col(value) > F.col("lo"))
    below = F.col("hi").isNull() | (F.col(value) < F.col("hi"))
    return rows.join(broadcast_if_small(state), group).where(above & below)


def _narrowed(rows: DataFrame, state: DataFrame, group: str, value: str) -> DataFrame:
    """The next state: in two passes for all groups, two values beside the wanted ranks and how many rows lie below them.

    The values come from a mergeable sketch, so they part the rows by number however the values are spread.
    """
    grid = [i / PIVOTS for i in range(PIVOTS + 1)]
    sketch = _inside(rows, state, group, value).groupBy(group).agg(F.percentile_approx(value, grid, 10 * PIVOTS).alias("p"))
    first, second = F.col("first") - F.col("upto_lo"), F.col("second") - F.col("upto_lo")  # ranks among the rows inside
    spot = lambda rank, shift: F.greatest(F.lit(1), F.least(F.lit(PIVOTS + 1), F.floor(rank / F.col("n") * PIVOTS) + shift)).cast("int")
    ends = {"a": F.element_at("p", spot(first, 0)), "b": F.element_at("p", spot(second, 3))}
    tried = materialize(state.join(sketch, group).withColumns(ends).drop("p"))
    v, number = F.col(value), lambda met: F.count_if(met)
    counts = _inside(rows, tried, group, value).groupBy(group).agg(
        number(v < F.col("a")).alias("under_a"), number(v <= F.col("a")).alias("upto_a"), number(v < F.col("b")).alias("under_b"), number(v <= F.col("b")).alias("upto_b"))
    low = lambda b, a, old: F.when(F.col("under_b") <= first, b).when(F.col("under_a") <= first, a).otherwise(old)
    high = lambda a, b, old: F.when(F.col("upto_a") > second, a).when(F.col("upto_b") > second, b).otherwise(old)
    gone = low(F.col("upto_b"), F.col("upto_a"), F.lit(0))
    return tried.join(counts, group).select(
        group, low(F.col("b"), F.col("a"), F.col("lo")).alias("lo"), high(F.col("a"), F.col("b"), F.col("hi")).alias("hi"), (F.col("upto_lo") + gone).alias("upto_lo"),
        F.greatest(F.lit(0), high(F.col("under_a"), F.col("under_b"), F.col("n")) - gone).alias("n"), "first", "second", "spot",
    )


def grouped_quantile(df: DataFrame, group: str, value: str, fraction: float, out: str = "quantile", held_rows: int = HELD_ROWS) -> DataFrame:
    """(group, out): the linearly interpolated quantile of every group, of any size; null values are left out.

    A group with more than ``held_rows`` values is narrowed to the values strictly between two of its own, near the wanted ranks, and
    that again, until so few are left that they can be sorted in one state. All large groups go through a level together.
    Values are finite doubles.
    """
    rows = df.select(group, F.col(value).cast("double").alias(value)).where(F.col(value).isNotNull())
    spot = (F.col("n") - 1) * F.lit(float(fraction))
    nothing = F.lit(None).cast("double")
    state = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n")).select(
        group, nothing.alias("lo"), nothing.alias("hi"), F.lit(0).cast("long").alias("upto_lo"), "n", F.floor(spot).alias("first"), F.ceil(spot).alias("second"), spot.alias("spot"))
    state, done = materialize(state), None
    while True:
        large = F.col("n") > held_rows
        ready, state = state.where(~large), state.where(large)
        done = ready if done is None else done.unionByName(ready)
        if state.isEmpty():
            break
        state = materialize(_narrowed(rows, state, group, value))
    held = _inside(rows, done.select(group, "lo", "hi"), group, value).groupBy(group).agg(F.sort_array(F.collect_list(value)).alias("_values"))
    both = done.join(held, group, "left")

    def at(rank):
        inside = F.get("_values", (F.col(rank) - F.col("upto_lo")).cast("int"))
        return F.when(F.col(rank) < F.col("upto_lo"), F.col("lo")).when(F.col(rank) >= F.col("upto_lo") + F.col("n"), F.col("hi")).otherwise(inside)

    low, high = at("first"), at("second")
    between = (F.col("second") - F.col("spot")) * low + (F.col("spot") - F.col("first")) * high
    return both.select(group, F.when(F.col("first") == F.col("second"), low).otherwise(between).alias(out))
