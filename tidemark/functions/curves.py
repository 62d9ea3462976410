"""Zero curves: nodes as a sorted array per curve, interpolation, discounting and bootstrapping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

NODE = "array<struct<t:double,z:double>>"


def curve_nodes(points: DataFrame, key: str, t: str = "t", z: str = "z", out: str = "nodes") -> DataFrame:
    """One row per curve with its sorted nodes. A curve has as many nodes as quoted tenors, so the array is short."""
    node = F.struct(F.col(t).cast("double").alias("t"), F.col(z).cast("double").alias("z"))
    return points.groupBy(key).agg(F.sort_array(F.collect_list(node)).alias(out))


def zero_rate(nodes: Column, t: Column) -> Column:
    """Linear between nodes, flat beyond both ends; NULL on an empty curve."""
    around = F.struct(
        F.try_element_at(F.filter(nodes, lambda p: p["t"] <= t), F.lit(-1)).alias("lo"),
        F.try_element_at(F.filter(nodes, lambda p: p["t"] >= t), F.lit(1)).alias("hi"),
    )

    def between(p):
        lo, hi = p["lo"], p["hi"]
        slope = (hi["z"] - lo["z"]) / F.nullif(hi["t"] - lo["t"], F.lit(0.0))
        return F.coalesce(lo["z"] + slope * (t - lo["t"]), lo["z"], hi["z"])

    return F.get(F.transform(F.array(around), between), F.lit(0))


def discount_factor(nodes: Column, t: Column) -> Column:
    return F.exp(-zero_rate(nodes, t) * t)


def discount_flows(flows: DataFrame, curves: DataFrame, key: str, t: str = "t") -> DataFrame:
    """Zero rate and discount factor for each flow on its curve.

    The curve's nodes travel as one row, so the join is one-to-one per flow with no range condition and no
    candidate rows to filter.
    """
    return (
        flows.join(curves, key)
        .withColumn("zero_rate", zero_rate(F.col("nodes"), F.col(t)))
        .withColumn("discount_factor", F.exp(-F.col("zero_rate") * F.col(t)))
        .drop("nodes")
    )


def bootstrap_zero_curves(quotes: DataFrame, key: str) -> DataFrame:
    """Zero curve of every group of par quotes ``(t, par_yield, freq)``.

    Quotes are folded in maturity order. A quote with one payment a year and at most a year to run is a single
    discount; any other discounts its earlier coupons on the nodes found so far and solves for its own. A
    non-positive discount factor fails the job.
    """
    quote = F.struct(F.col("t").cast("double").alias("t"), F.col("par_yield").alias("y"), F.col("freq").cast("int").alias("f"))
    grouped = quotes.groupBy(key).agg(F.sort_array(F.collect_list(quote)).alias("quotes"))

    def solve(nodes, q):
        n = F.round(q["t"] * q["f"]).cast("int")
        coupon = q["y"] * 100.0 / q["f"]
        earlier = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
        known = F.aggregate(
            F.transform(earlier, lambda k: coupon * discount_factor(nodes, k / q["f"])), F.lit(0.0), lambda acc, x: acc + x
        )
        last = n / q["f"]
        factor = (100.0 - known) / (coupon + 100.0)
        failed = F.raise_error(F.lit("implied discount factor is not positive")).cast("double")
        par = F.struct(last.cast("double").alias("t"), (-F.ln(F.when(factor > 0, factor).otherwise(failed)) / last).alias("z"))
        short = F.struct(q["t"].alias("t"), (F.ln(q["y"] * q["t"] + 1.0) / q["t"]).alias("z"))
        return F.when((q["f"] == 1) & (q["t"] <= 1.0), short).otherwise(par)

    fold = F.aggregate(
        "quotes", F.array().cast(NODE), lambda nodes, q: F.concat(nodes, F.array(solve(nodes, q))).cast(NODE)
    )
    return grouped.select(key, fold.alias("nodes"))
