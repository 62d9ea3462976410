"""Price and return series in long form: ``(date, ticker, price)`` with one row per ticker and day.

A window over one ticker (or one book) holds at most one row per calendar day, about 37,000 rows per
century, so partitioning by ticker is bounded however large the source tables are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import Window

from tidemark.operators.ranking import order_statistics

TRADING_DAYS = 252
FACTOR_COLUMNS = ["mom_21", "mom_63", "vol_21", "reversal_5", "rel_strength_21"]
VOLATILITY_COLUMNS = ["trailing_vol_21", "trailing_vol_63", "trailing_skew_21", "trailing_mean_return_21", "market_vol_21"]


def align_dates(prices: DataFrame) -> DataFrame:
    """Keep the dates on which every ticker has a price."""
    tickers = prices.agg(F.count_distinct("ticker").alias("n")).scalar()
    full = prices.groupBy("date").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == tickers).select("date")
    return prices.join(full, "date", "left_semi")


def by_date(key: str):
    return Window.partitionBy(key).orderBy("date")


def pct_change(col: str, n: int, key: str = "ticker") -> Column:
    return F.col(col) / F.lag(col, n).over(by_date(key)) - 1


def forward_return(col: str, n: int, key: str = "ticker") -> Column:
    return F.lead(col, n).over(by_date(key)) / F.col(col) - 1


def rolling(agg, col: str, first: int, last: int, key: str = "ticker") -> Column:
    """``agg`` over rows ``first..last`` relative to the current one; NULL until all of them have a value."""
    frame = by_date(key).rowsBetween(first, last)
    return F.when(F.count(col).over(frame) == last - first + 1, agg(col).over(frame))


def rolling_volatility(col: str, n: int, key: str = "ticker") -> Column:
    return rolling(F.stddev_samp, col, 1 - n, 0, key) * math.sqrt(TRADING_DAYS)


def rolling_skew(col: str, n: int, key: str = "ticker") -> Column:
    """Bias-corrected sample skewness; Spark's own is the population moment."""
    return rolling(F.skewness, col, 1 - n, 0, key) * (math.sqrt(n * (n - 1)) / (n - 2))


def daily_returns(prices: DataFrame) -> DataFrame:
    return (
        prices.withColumn("ret", pct_change("price", 1))
        .where(F.col("ret").isNotNull())
        .select("date", "ticker", "ret")
    )


def equal_weight_returns(returns: DataFrame) -> DataFrame:
    return returns.groupBy("date").agg(F.avg("ret").alias("ret"))


def with_market(assets: DataFrame, market: DataFrame, *cols: str) -> DataFrame:
    """Attach the market's columns of the same date, prefixed ``market_``."""
    return assets.join(market.select("date", *[F.col(c).alias(f"market_{c}") for c in cols]), "date")


def factor_panel(prices: DataFrame, market: str) -> DataFrame:
    """Momentum, volatility, reversal, relative strength and the 5-day forward return, complete rows only."""
    panel = (
        prices.withColumn("ret", pct_change("price", 1))
        .withColumns(
            {
                "mom_21": pct_change("price", 21),
                "mom_63": pct_change("price", 63),
                "vol_21": rolling_volatility("ret", 21),
                "reversal_5": -pct_change("price", 5),
                "forward_return_5d": forward_return("price", 5),
            }
        )
    )
    benchmark = panel.where(F.col("ticker") == market)
    return (
        with_market(panel.where(F.col("ticker") != market), benchmark, "mom_21")
        .withColumn("rel_strength_21", F.col("mom_21") - F.col("market_mom_21"))
        .dropna(subset=FACTOR_COLUMNS + ["forward_return_5d"])
        .select("date", "ticker", *FACTOR_COLUMNS, "forward_return_5d")
    )


def volatility_panel(prices: DataFrame, market: str) -> DataFrame:
    """Trailing risk of the equal-weight portfolio and its volatility over the next 21 days, complete rows only."""
    returns = prices.withColumn("ret", pct_change("price", 1))
    asset = F.when(F.col("ticker") != market, F.col("ret"))
    index = F.when(F.col("ticker") == market, F.col("ret"))
    annual = math.sqrt(TRADING_DAYS)
    return (
        returns.groupBy("date")
        .agg(F.avg(asset).alias("ret"), F.max(index).alias("market_ret"))
        .withColumn("book", F.lit("equal_weight"))
        .withColumns(
            {
                "trailing_vol_21": rolling_volatility("ret", 21, "book"),
                "trailing_vol_63": rolling_volatility("ret", 63, "book"),
                "trailing_skew_21": rolling_skew("ret", 21, "book"),
                "trailing_mean_return_21": rolling(F.avg, "ret", -20, 0, "book") * TRADING_DAYS,
                "market_vol_21": rolling_volatility("market_ret", 21, "book"),
                "forward_vol_21": rolling(F.stddev_samp, "ret", 1, 21, "book") * annual,
            }
        )
        .dropna(subset=VOLATILITY_COLUMNS + ["forward_vol_21"])
        .select("date", *VOLATILITY_COLUMNS, "forward_vol_21")
    )


def chronological_split(panel: DataFrame, train_frac: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Split by distinct date, so all tickers of a day fall on the same side."""
    dates = panel.select("date").distinct()
    n = dates.count()
    if n == 0:
        return panel, panel
    rank = int(n * train_frac) + 1
    (cutoff,) = order_statistics(dates, ["date"], [rank], n=n)[rank]
    return panel.where(F.col("date") < F.lit(cutoff)), panel.where(F.col("date") >= F.lit(cutoff))


def position_split(panel: DataFrame, key: str, train_frac: float = 0.7, out: str = "side") -> DataFrame:
    """Mark the first ``floor(n * train_frac)`` rows of each series as train, the rest as test."""
    size = F.count(F.lit(1)).over(Window.partitionBy(key))
    return panel.withColumn(
        out, F.when(F.row_number().over(by_date(key)) <= F.floor(size * train_frac), "train").otherwise("test")
    )


def period_total_return(prices: DataFrame, start: str, end: str) -> DataFrame:
    """Last over first price minus one inside an inclusive window; fewer than two days give an error text."""
    window = prices.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))
    n = F.count(F.lit(1))
    change = F.max_by("price", "date") / F.min_by("price", "date") - 1
    return window.groupBy("ticker").agg(
        n.alias("n_days"),
        F.when(n >= 2, change).alias("total_return"),
        F.when(n < 2, F.lit(f"Not enough data in [{start}, {end}]")).alias("error"),
    )


def momentum_signal() -> Column:
    """Unfitted baseline: one- plus three-month momentum."""
    return F.col("mom_21") + F.col("mom_63")
