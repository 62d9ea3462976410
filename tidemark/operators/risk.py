"""Value-at-risk, tail loss, backtests, stress tests, signal scores and estimator statistics, by group."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from statistics import NormalDist

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tidemark.functions.normal import chi2_1_upper_tail, norm_cdf
from tidemark.operators.ranking import HELD_ROWS, ROWS_PER_BIN, average_rank, grouped_quantile
from tidemark.operators.series import TRADING_DAYS
from tidemark.session import broadcast_if_small, materialize

NORMAL = NormalDist()
HOLDING_DAYS = 5
BLOCK_ROWS = 4096  # of a series that one task works out
BUCKET_DAYS = 4096  # in which the rows of a series are numbered


def normal_loss(col: str, confidence: float) -> Column:
    z = NORMAL.inv_cdf(1 - confidence)
    return -(F.avg(col) + F.stddev_samp(col) * z)


def historical_var(returns: DataFrame, confidence: float = 0.95, key: str = "ticker", held_rows: int = HELD_ROWS) -> DataFrame:
    """Negated, linearly interpolated quantile of each group, which may have any number of rows."""
    quantiles = grouped_quantile(returns, key, "ret", 1 - confidence, "_quantile", held_rows)
    return quantiles.select(key, (-F.col("_quantile")).alias("var"))


def parametric_var(returns: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    return returns.groupBy(key).agg(normal_loss("ret", confidence).alias("var"))


def book_returns(returns: DataFrame, positions: DataFrame) -> DataFrame:
    """Return of each book on each date: positions joined on the ticker and summed, map-side first."""
    return (
        returns.join(positions, "ticker")
        .groupBy("book", "date")
        .agg(F.sum(F.col("weight") * F.col("ret")).alias("ret"))
    )


def scenario_var(returns: DataFrame, positions: DataFrame, confidence: float = 0.95, held_rows: int = HELD_ROWS) -> DataFrame:
    """VaR of each book over a scenario table; here one scenario per historical date."""
    return historical_var(materialize(book_returns(returns, positions)), confidence, "book", held_rows)


def historical_cvar(returns: DataFrame, confidence: float = 0.95, key: str = "ticker", held_rows: int = HELD_ROWS) -> DataFrame:
    """Mean loss at or beyond the VaR; the VaR itself when nothing lies beyond."""
    var = broadcast_if_small(historical_var(returns, confidence, key, held_rows))
    tail = F.when(F.col("ret") <= -F.col("var"), F.col("ret"))
    return returns.join(var, key).groupBy(key).agg(F.coalesce(-F.avg(tail), F.first("var")).alias("cvar"))


def parametric_cvar(returns: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    scale = NORMAL.pdf(NORMAL.inv_cdf(confidence)) / (1 - confidence)
    return returns.groupBy(key).agg((F.stddev_samp("ret") * scale - F.avg("ret")).alias("cvar"))


def _windowed_quantile(window: int, fraction: float, names: list[str]):
    """Quantile of the ``window`` rows before each row of a block: a sorted list that loses one value and gains one per row."""
    spot = (window - 1) * fraction
    low, high = math.floor(spot), math.ceil(spot)

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_pos")
        values = table.column("ret").to_pylist()
        first = table.column("_pos")[0].as_py()
        own = table.column("_carried").to_numpy(zero_copy_only=False) == 0
        held, missing, out = [], 0, []
        for i, value in enumerate(values):
            if i > window:
                gone = values[i - 1 - window]
                if gone is None:
                    missing -= 1
                else:
                    del held[bisect_left(held, gone)]
            if i:
                if values[i - 1] is None:
                    missing += 1
                else:
                    insort(held, values[i - 1])
            whole = own[i] and first + i >= window and not missing
            out.append(None if not whole else held[low] if low == high else (high - spot) * held[low] + (spot - low) * held[high])
        return table.select(names).append_column("_quantile", pa.array(out, pa.float64())).filter(pa.array(own))

    return run


def rolling_quantile(series: DataFrame, window: int, fraction: float, key: str, block_rows: int = BLOCK_ROWS, bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """``series`` (key, date, ret) with ``_quantile``, the interpolated quantile of the ``window`` rows before each; null with fewer or a null.

    Rows are numbered inside buckets of days whose counts are summed up, so no task sorts a whole series. Blocks of ``block_rows``
    rows also get the ``window`` rows before them and are worked out one by one.
    """
    if block_rows < window:
        raise ValueError(f"a block of {block_rows} rows is shorter than the window of {window}")
    bucket = F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / bucket_days)
    rows = materialize(series.select(key, "date", F.col("ret").cast("double").alias("ret"), bucket.alias("_bucket")))
    earlier = Window.partitionBy(key).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # buckets of a series
    counts = rows.groupBy(key, "_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    inside = F.row_number().over(Window.partitionBy(key, "_bucket").orderBy("date")) - 1
    placed = rows.withColumn("_at", inside).join(counts, [key, "_bucket"]).withColumn("_pos", F.col("_at") + F.col("_before"))
    own = F.floor(F.col("_pos") / block_rows)
    late = F.col("_pos") % block_rows >= block_rows - window  # also the last rows before the next block
    copies = F.when(late, F.array(F.struct(F.lit(0).alias("c"), own.alias("b")), F.struct(F.lit(1).alias("c"), (own + 1).alias("b")))).otherwise(F.array(F.struct(F.lit(0).alias("c"), own.alias("b"))))
    dealt = placed.select(key, "date", "ret", "_pos", F.explode(copies).alias("_copy")).select(key, "date", "ret", "_pos", F.col("_copy.c").alias("_carried"), F.col("_copy.b").alias("_block"))
    kind = dealt.schema[key].dataType.simpleString()
    return dealt.groupBy(key, "_block").applyInArrow(_windowed_quantile(window, fraction, [key, "date", "ret"]), f"`{key}` {kind}, date date, ret double, _quantile double")


def rolling_var_backtest(
    returns: DataFrame, method: str, window: int = 250, confidence: float = 0.95, key: str = "ticker", block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """VaR from the ``window`` rows before each day, and whether that day's loss exceeded it."""
    if method == "historical":
        valued = rolling_quantile(returns, window, 1 - confidence, key, max(block_rows, window)).withColumn("var_estimate", -F.col("_quantile"))
    elif method == "parametric":
        frame = Window.partitionBy(key).orderBy("date").rowsBetween(-window, -1)
        value = -(F.avg("ret").over(frame) + F.stddev_samp("ret").over(frame) * NORMAL.inv_cdf(1 - confidence))
        valued = returns.withColumn("var_estimate", F.when(F.count("ret").over(frame) == window, value))
    else:
        raise ValueError(f"unknown method {method!r}")
    return valued.where(F.col("var_estimate").isNotNull()).select(
        key, "date", "var_estimate", F.col("ret").alias("actual_return"), (-F.col("ret") > F.col("var_estimate")).alias("breached")
    )


def _count_log(count: Column, probability: Column) -> Column:
    """count * ln(probability), with 0 * ln(0) = 0."""
    return F.when(count == 0, F.lit(0.0)).otherwise(count * F.ln(probability))


def kupiec_test(breaches: DataFrame, confidence: float = 0.95, key: str = "ticker") -> DataFrame:
    """Proportion-of-failures likelihood ratio test of the breach rate, one row per group."""
    p = 1 - confidence
    n, x = F.col("n_obs"), F.col("n_breaches")
    rate = F.col("breach_rate")
    null_model = _count_log(x, F.lit(p)) + _count_log(n - x, F.lit(1 - p))
    free_model = _count_log(x, rate) + _count_log(n - x, 1 - rate)
    return (
        breaches.groupBy(key)
        .agg(F.count("breached").alias("n_obs"), F.count_if("breached").alias("n_breaches"))
        .withColumn("breach_rate", F.coalesce(x / F.nullif(n, F.lit(0)), F.lit(0.0)))
        .withColumn("expected_rate", F.lit(p))
        .withColumn("lr_statistic", (null_model - free_model) * -2.0)
        .withColumn("p_value", chi2_1_upper_tail(F.col("lr_statistic")))
        .withColumn("reject_at_5pct", F.col("p_value") < 0.05)
    )


def window_breach_rate(breaches: DataFrame, start: str, end: str, key: str = "ticker") -> DataFrame:
    """Breach rate in an inclusive date window next to the full sample."""
    hit = F.col("breached").cast("double")
    inside = F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return breaches.groupBy(key).agg(F.avg(F.when(inside, hit)).alias("window_rate"), F.avg(hit).alias("full_rate"))


def stress_test(positions: DataFrame, shocks: DataFrame) -> DataFrame:
    """Sum of weight times shock over the shared assets; a book that shares none gets an error text."""
    joined = positions.join(shocks.select("ticker", F.col("total_return").alias("shock")), "ticker", "left")
    shared = F.count("shock")
    return joined.groupBy("book").agg(
        F.sum(F.col("weight") * F.col("shock")).alias("portfolio_shock"),
        shared.alias("n_assets"),
        F.when(shared == 0, F.lit("weights and shocks share no assets")).alias("error"),
    )


def annualized_stats(returns: DataFrame, key: str = "ticker") -> DataFrame:
    return returns.groupBy(key).agg(
        (F.avg("ret") * TRADING_DAYS).alias("annual_return"),
        (F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("annual_volatility"),
    )


def information_coefficient(panel: DataFrame, signal: str, target: str, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Pooled Spearman correlation with tie-averaged ranks; two-sided p-value from the normal limit of t."""
    pairs = panel.select(signal, target)
    ranked = average_rank(average_rank(pairs, signal, "_rs", rows_per_bin), target, "_rt", rows_per_bin)
    n, rho = F.col("n"), F.col("ic")
    return (
        ranked.agg(F.corr("_rs", "_rt").alias("ic"), F.count(F.lit(1)).alias("n"))
        .withColumn("t_statistic", rho * F.sqrt((n - 2) / F.nullif(1 - rho * rho, F.lit(0.0))))
        .withColumn("_z", -F.abs("t_statistic"))
        .withColumn("p_value", 2.0 * norm_cdf(F.col("_z")))
        .drop("_z")
    )


def daily_spread(panel: DataFrame, signal: str, target: str = "forward_return_5d") -> DataFrame:
    """Return of the highest-signal ticker minus that of the lowest, on days with two or more; ties go to the first ticker."""
    return (
        panel.groupBy("date")
        .agg(
            F.min_by(target, F.struct(-F.col(signal), F.col("ticker"))).alias("top"),
            F.min_by(target, F.struct(F.col(signal), F.col("ticker"))).alias("bottom"),
            F.count(F.lit(1)).alias("n"),
        )
        .where(F.col("n") >= 2)
        .select("date", (F.col("top") - F.col("bottom")).alias("spread"))
    )


def long_short_sharpe(panel: DataFrame, signal: str, target: str = "forward_return_5d") -> DataFrame:
    sd = F.stddev_samp("spread")
    ratio = F.avg("spread") / F.nullif(sd, F.lit(0.0)) * math.sqrt(TRADING_DAYS / HOLDING_DAYS)
    n = F.count("spread")
    return daily_spread(panel, signal, target).agg(
        n.alias("n_days"), F.when((n == 0) | (sd == 0), F.lit(0.0)).otherwise(ratio).alias("long_short_sharpe")
    )


def path_payoffs(prices: DataFrame, keys: list[str], strike: float = 1.0, barrier: float = 0.9) -> DataFrame:
    """Barrier and average payoffs of an ordered series; strike and barrier are fractions of its first price.

    One aggregate per series: the average leaves out the first point by subtracting it.
    """
    if barrier >= 1:
        raise ValueError("the barrier must be below the first price")
    first, last, low, k = F.col("first_price"), F.col("last_price"), F.col("low"), F.col("first_price") * strike
    after_first = (F.col("total") - first) / F.nullif(F.col("n_points") - 1, F.lit(0))
    return (
        prices.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n_points"),
            F.min_by("price", "date").alias("first_price"),
            F.max_by("price", "date").alias("last_price"),
            F.min("price").alias("low"),
            F.sum("price").alias("total"),
        )
        .withColumn("knocked_out", low <= first * barrier)
        .withColumn("average_price", after_first)
        .select(
            *keys, "n_points", "knocked_out", "last_price", "average_price",
            F.when(F.col("knocked_out"), 0.0).otherwise(F.greatest(last - k, F.lit(0.0))).alias("barrier_payoff"),
            F.greatest(F.col("average_price") - k, F.lit(0.0)).alias("average_payoff"),
        )
    )


def mean_and_error(df: DataFrame, key: str, col: str) -> DataFrame:
    """Mean and standard error (sample deviation over root n) of a measure, by group."""
    n = F.count(col)
    return df.groupBy(key).agg(
        n.alias("n"), F.avg(col).alias("mean"), (F.stddev_samp(col) / F.sqrt(n)).alias("std_error")
    )


def paired_mean_and_error(df: DataFrame, key: str, pair: str, col: str) -> DataFrame:
    """Mean and standard error of per-pair means: related observations count once."""
    return mean_and_error(df.groupBy(key, pair).agg(F.avg(col).alias(col)), key, col)


def control_variate(df: DataFrame, key: str, col: str, control: str, control_mean: float) -> DataFrame:
    """Group means adjusted by a control with a known mean.

    With b = cov / var, the adjusted column y - b (x - E[x]) has variance var(y) - cov^2 / var(x),
    so one aggregate over the rows is enough.
    """
    both = F.col(col).isNotNull() & F.col(control).isNotNull()
    cov, var_x, var_y = F.covar_samp(col, control), F.var_samp(control), F.var_samp(col)
    b = cov / F.nullif(var_x, F.lit(0.0))
    n = F.count(F.lit(1))
    return df.where(both).groupBy(key).agg(
        n.alias("n"),
        b.alias("beta"),
        (F.avg(col) - b * (F.avg(control) - control_mean)).alias("mean"),
        F.sqrt(F.greatest(var_y - b * cov, F.lit(0.0)) / n).alias("std_error"),
    )


def partial_moments(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """Mergeable count, sum and sum of squares."""
    return df.groupBy(*keys).agg(
        F.count(col).alias("n"), F.sum(col).alias("total"), F.sum(F.col(col) * F.col(col)).alias("total_sq")
    )


def merge_moments(parts: DataFrame, key: str) -> DataFrame:
    """Mean and population standard error from partial moments of any sharding."""
    n = F.sum("n")
    mean = F.sum("total") / n
    variance = F.greatest(F.sum("total_sq") / n - mean * mean, F.lit(0.0))
    return parts.groupBy(key).agg(n.alias("n"), mean.alias("mean"), F.sqrt(variance / n).alias("std_error"))


def estimate_spread(df: DataFrame, estimator: str, run: str, col: str) -> DataFrame:
    """Standard deviation of an estimator's mean across repeated runs."""
    runs = df.groupBy(estimator, run).agg(F.avg(col).alias("estimate"))
    return runs.groupBy(estimator).agg(F.count("estimate").alias("n_runs"), F.stddev_samp("estimate").alias("spread"))
