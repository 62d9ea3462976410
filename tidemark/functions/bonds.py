"""Fixed-coupon bonds, shock grids and the closed-form short-rate model, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def cash_flow_sums(ytm: Column) -> Column:
    """Struct of price and the two time-weighted sums behind duration and convexity.

    The cash flows are folded inside the row: no exploded rows and no shuffle. The running discount
    factor is multiplied, not raised to a power. Expects columns face, coupon_rate, years and freq.
    """
    periods = F.round(F.col("years") * F.col("freq")).cast("int")
    coupon = F.col("face") * F.col("coupon_rate") / F.col("freq")
    step = 1.0 / (1.0 + ytm / F.col("freq"))
    start = F.struct(
        F.lit(1.0).alias("v"), F.lit(0.0).alias("price"), F.lit(0.0).alias("timed"), F.lit(0.0).alias("squared")
    )

    def add(acc, k):
        v = acc["v"] * step
        pv = v * F.when(k == periods, coupon + F.col("face")).otherwise(coupon)
        years = k / F.col("freq")
        return F.struct(
            v.alias("v"),
            (acc["price"] + pv).alias("price"),
            (acc["timed"] + years * pv).alias("timed"),
            (acc["squared"] + years * (years + 1.0 / F.col("freq")) * pv).alias("squared"),
        )

    return F.aggregate(F.sequence(F.lit(1), periods), start, add)


# Below this product of period yield and periods the closed forms lose digits; the cash flows are folded instead.
SMALL_YIELD = 0.01


def bond_price(ytm: Column) -> Column:
    """Annuity form of the price: constant work per bond, inside code generation.

    ``expm1`` and ``log1p`` keep it exact for yields near zero; a zero yield sums the cash flows.
    """
    periods = F.round(F.col("years") * F.col("freq"))
    coupon = F.col("face") * F.col("coupon_rate") / F.col("freq")
    rate = F.nullif(ytm / F.col("freq"), F.lit(0.0))
    log_factor = -periods * F.log1p(rate)
    discounted = F.exp(log_factor) * F.col("face") - F.expm1(log_factor) / rate * coupon
    return F.coalesce(discounted, periods * coupon + F.col("face"))


def bond_risk_metrics(bonds: DataFrame) -> DataFrame:
    """Price, Macaulay and modified duration, and convexity.

    With v the period discount factor, the sums of v^k, k v^k and k^2 v^k have closed forms, so a bond costs the
    same however long it runs. Tiny yields take the exact fold over the cash flows.
    """
    n, y, v = F.col("_n"), F.col("_y"), F.col("_v")
    coupon = F.col("face") * F.col("coupon_rate") / F.col("freq")
    sum_1 = F.col("_sum_1")
    tiny = F.abs(F.col("ytm") / F.col("freq")) * n < SMALL_YIELD
    fold = F.when(tiny, cash_flow_sums(F.col("ytm")))
    timed = (coupon * sum_1 + F.col("face") * n * v) / F.col("freq")
    squared = (coupon * (F.col("_sum_2") + sum_1) + F.col("face") * n * (n + 1) * v) / (F.col("freq") * F.col("freq"))
    growth = 1.0 + F.col("ytm") / F.col("freq")
    return (
        bonds.withColumn("_n", F.round(F.col("years") * F.col("freq")))
        .withColumn("_y", F.nullif(F.col("ytm") / F.col("freq"), F.lit(0.0)))
        .withColumn("_v", F.exp(-n * F.log1p(y)))
        .withColumn("_sum_0", -F.expm1(-n * F.log1p(y)) / y)
        .withColumn("_sum_1", ((1.0 + y) * F.col("_sum_0") - n * v) / y)
        .withColumn("_sum_2", ((1.0 + y) * (2.0 * sum_1 - F.col("_sum_0")) - n * n * v) / y)
        .withColumn("_fold", fold)
        .withColumn("price", bond_price(F.col("ytm")))
        .withColumn("macaulay_duration", F.coalesce(F.col("_fold.timed"), timed) / F.col("price"))
        .withColumn("modified_duration", F.col("macaulay_duration") / growth)
        .withColumn("convexity", F.coalesce(F.col("_fold.squared"), squared) / (F.col("price") * growth * growth))
        .drop("_n", "_y", "_v", "_sum_0", "_sum_1", "_sum_2", "_fold")
    )


def estimated_price_change(shock: Column) -> Column:
    """Duration plus convexity estimate of the price change for a yield shift."""
    return F.col("price") * (F.col("convexity") * shock * shock * 0.5 - F.col("modified_duration") * shock)


def shock_grid(bonds: DataFrame, shocks: list[float]) -> DataFrame:
    """Estimated and exact price change of every bond under every yield shift; the grid fans out inside the row."""
    grid = F.array(*[F.lit(float(x)) for x in shocks])
    return (
        bond_risk_metrics(bonds)
        .withColumn("shock", F.explode(grid))
        .withColumn("estimated_change", estimated_price_change(F.col("shock")))
        .withColumn("exact_change", bond_price(F.col("ytm") + F.col("shock")) - F.col("price"))
    )


def zero_bond_price(r0: Column, t: Column, kappa: Column, theta: Column, sigma: Column) -> Column:
    """Closed-form zero-coupon price under a mean-reverting Gaussian short rate, with its limit at zero reversion speed."""
    speed = F.nullif(kappa, F.lit(0.0))
    b = F.coalesce((1.0 - F.exp(-speed * t)) / speed, t)
    mean_reverting = (theta - sigma * sigma / (speed * speed * 2.0)) * (b - t) - sigma * sigma * b * b / (speed * 4.0)
    limit = sigma * sigma * t * t * t / 6.0 - theta * t * t / 2.0
    return F.exp(F.coalesce(mean_reverting, limit) - b * r0)


def zero_bond_yield(price: Column, t: Column) -> Column:
    return -F.ln(price) / t
