"""Moments of asset returns, portfolio statistics and the best portfolios on a weight grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.risk import book_returns
from tidemark.operators.series import TRADING_DAYS

TICKERS_PER_BLOCK = 512
DAYS_PER_BUCKET = 1024
FRONTIER_POINTS = 40
MOST_ASSETS = 64  # of a weight grid
MOST_CANDIDATES = 1 << 40
CANDIDATES_PER_TASK = 500_000
CLOSE = 2e-9  # portfolios whose measure differs by less may be equal after rounding


def annual_means(returns: DataFrame) -> DataFrame:
    return returns.groupBy("ticker").agg((F.avg("ret") * TRADING_DAYS).alias("mean"))


def _block_moments(keys: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """Centred cross products of one date bucket and one pair of ticker blocks."""
    _, left, right = keys
    wide = pdf.pivot(index="date", columns="ticker", values="ret")
    block = pdf.drop_duplicates("ticker").set_index("ticker")["block"]
    a = [t for t in wide.columns if block[t] == left]
    b = [t for t in wide.columns if block[t] == right]
    x, y = wide[a].to_numpy(), wide[b].to_numpy()
    mx, my = x.mean(axis=0), y.mean(axis=0)
    cross = (x - mx).T @ (y - my)
    first, second = np.meshgrid(np.arange(len(a)), np.arange(len(b)), indexing="ij")
    out = pd.DataFrame(
        {
            "a": np.asarray(a, dtype=object)[first.ravel()],
            "b": np.asarray(b, dtype=object)[second.ravel()],
            "n": len(wide),
            "cross": cross.ravel(),
            "mean_a": mx[first.ravel()],
            "mean_b": my[second.ravel()],
        }
    )
    return out if left != right else out[out["a"] <= out["b"]]


def covariance(returns: DataFrame, tickers_per_block: int = TICKERS_PER_BLOCK, days_per_bucket: int = DAYS_PER_BUCKET) -> DataFrame:
    """Annualised sample covariance of every pair of tickers, both orders. Dates must be aligned.

    No date emits its ticker pairs. Tickers fall into blocks and dates into buckets; one task multiplies one
    bucket of a pair of blocks, and the partial sums are merged by pair. A row is copied once per block, and a
    task holds at most ``days_per_bucket`` dates of two blocks.
    """
    n_blocks = math.ceil(returns.agg(F.count_distinct("ticker")).first()[0] / tickers_per_block)
    block = F.pmod(F.xxhash64("ticker"), F.lit(n_blocks)).cast("int")
    partners = F.sequence(F.lit(0), F.lit(n_blocks - 1))
    copies = (
        returns.select("date", "ticker", "ret", block.alias("block"), F.explode(partners).alias("other"))
        .withColumns(
            {
                "bucket": F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / days_per_bucket),
                "left": F.least("block", "other"),
                "right": F.greatest("block", "other"),
            }
        )
    )
    parts = copies.groupBy("bucket", "left", "right").applyInPandas(
        _block_moments, "a string, b string, n long, cross double, mean_a double, mean_b double"
    )
    # Tickers of two different blocks come out in block order; put every pair in name order.
    n, ma, mb = F.col("n"), F.col("mean_a"), F.col("mean_b")
    merged = (
        parts.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .agg(
            F.sum("n").alias("n"),
            F.sum(F.col("cross") + n * ma * mb).alias("cross"),
            F.sum(n * F.when(F.col("a") <= F.col("b"), ma).otherwise(mb)).alias("sum_a"),
            F.sum(n * F.when(F.col("a") <= F.col("b"), mb).otherwise(ma)).alias("sum_b"),
        )
        .select("a", "b", ((F.col("cross") - F.col("sum_a") * F.col("sum_b") / n) / (n - 1) * TRADING_DAYS).alias("cov"))
    )
    mirrored = merged.where(F.col("a") != F.col("b")).select(F.col("b").alias("a"), F.col("a").alias("b"), "cov")
    return merged.unionByName(mirrored)


def _sharpe(ret: Column, vol: Column, rf: float) -> Column:
    return F.when(vol > 0, (ret - rf) / F.nullif(vol, F.lit(0.0))).otherwise(0.0)


def portfolio_stats(returns: DataFrame, positions: DataFrame, rf: float = 0.0) -> DataFrame:
    """Return, volatility and Sharpe ratio of each book.

    The variance of the book's own return series equals the quadratic form of its weights in the
    covariance matrix, so the matrix is never formed.
    """
    stats = book_returns(returns, positions).groupBy("book").agg(
        (F.avg("ret") * TRADING_DAYS).alias("expected_return"),
        (F.stddev_samp("ret") * math.sqrt(TRADING_DAYS)).alias("volatility"),
    )
    return stats.withColumn("sharpe_ratio", _sharpe(F.col("expected_return"), F.col("volatility"), rf))


def _unranked(numbers: np.ndarray, steps: int, n: int) -> np.ndarray:
    """The weights, in steps, of the candidates with the given numbers: all ways to deal ``steps`` to ``n`` assets, in order."""
    units = np.zeros((len(numbers), n), np.int64)
    rest, left = numbers.copy(), np.full(len(numbers), steps)
    for asset in range(n - 1):
        others = n - asset - 1
        ways = np.array([[math.comb(r - x + others - 1, others - 1) if x <= r else 0 for x in range(steps + 1)] for r in range(steps + 1)])
        before = np.cumsum(ways, axis=1) - ways  # candidates with a smaller weight of this asset, by what is left
        units[:, asset] = np.minimum((before[left] <= rest[:, None]).sum(axis=1) - 1, left)
        rest -= before[left, units[:, asset]]
        left -= units[:, asset]
    if n:
        units[:, n - 1] = left
    return units


def _candidates(means: np.ndarray, cov: np.ndarray, steps: int, rf: float, best: str | None, n_points: int):
    low, high = means.min(), means.max()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = _unranked(batch.column("id").to_numpy(), steps, len(means))
            w = units / steps
            ret = w @ means
            vol = np.sqrt(np.maximum(((w @ cov) * w).sum(axis=1), 0.0))
            ratio = np.divide(ret - rf, vol, out=np.zeros(len(vol)), where=vol > 0)
            keep = np.arange(len(w))
            if best == "volatility":
                keep = keep[vol <= vol.min(initial=np.inf) + CLOSE]
            elif best == "sharpe_ratio":
                keep = keep[ratio >= ratio.max(initial=-np.inf) - CLOSE]
            elif best == "frontier":
                bucket = np.zeros(len(ret), int) if high == low else np.clip(np.floor((ret - low) / (high - low) * n_points), 0, n_points - 1).astype(int)
                least = np.full(n_points, np.inf)
                np.minimum.at(least, bucket, vol)
                keep = keep[vol <= least[bucket] + CLOSE]
            names = ["/".join(map(str, u)) for u in units[keep].tolist()]
            yield pa.RecordBatch.from_pydict({
                "universe": ["all"] * len(keep), "weights": names, "expected_return": ret[keep], "volatility": vol[keep], "sharpe_ratio": ratio[keep],
                "low_return": np.full(len(keep), low), "high_return": np.full(len(keep), high),
            })

    return run


def grid_portfolios(returns: DataFrame, steps: int = 10, rf: float = 0.0, best: str | None = None, n_points: int = FRONTIER_POINTS) -> DataFrame:
    """The long-only, fully invested portfolios whose weights are multiples of ``1 / steps``, with their statistics.

    There are C(steps + n - 1, n - 1) of them, numbered in order of their weights. The numbers are dealt out as ranges and a task makes
    the weights of its own, so no row holds a list of portfolios: 20 assets in tenths are 20 million numbers. With ``best`` (``volatility``,
    ``sharpe_ratio``, or ``frontier`` for each of ``n_points`` buckets of return) a batch returns only what is best in it, ties
    included. The moments of the universe, MOST_ASSETS assets at most, go to the tasks.
    """
    spark = returns.sparkSession
    if best not in (None, "volatility", "sharpe_ratio", "frontier"):
        raise ValueError(f"best must be volatility, sharpe_ratio or frontier, got {best!r}")
    held = annual_means(returns).orderBy("ticker").limit(MOST_ASSETS + 1).collect()
    if len(held) > MOST_ASSETS:
        raise ValueError(f"a weight grid takes at most {MOST_ASSETS} assets")
    schema = "universe string, weights string, expected_return double, volatility double, sharpe_ratio double, low_return double, high_return double"
    if not held:
        return spark.createDataFrame([], schema)
    at = {r["ticker"]: i for i, r in enumerate(held)}
    cov = np.zeros((len(at), len(at)))
    for r in covariance(returns).collect():
        cov[at[r["a"]], at[r["b"]]] = r["cov"]
    count = math.comb(steps + len(at) - 1, len(at) - 1)
    if count > MOST_CANDIDATES:
        raise ValueError(f"{count} portfolios; take fewer assets or steps")
    numbers = spark.range(0, count, 1, max(spark.sparkContext.defaultParallelism, math.ceil(count / CANDIDATES_PER_TASK)))
    return numbers.mapInArrow(_candidates(np.array([r["mean"] for r in held]), cov, steps, rf, best, n_points), schema)


def _pick(candidates: DataFrame, keys: list[str], order: Column) -> DataFrame:
    row = F.struct("weights", "expected_return", "volatility", "sharpe_ratio")
    best = candidates.groupBy(*keys).agg(F.min_by(row, F.struct(order, F.col("weights"))).alias("p"))
    return best.select(*keys, "p.*")


def min_variance(candidates: DataFrame) -> DataFrame:
    return _pick(candidates, ["universe"], F.round("volatility", 9))


def max_sharpe(candidates: DataFrame) -> DataFrame:
    return _pick(candidates, ["universe"], -F.round("sharpe_ratio", 9))


def efficient_frontier(candidates: DataFrame, n_points: int = FRONTIER_POINTS) -> DataFrame:
    """Lowest-volatility candidate in each of ``n_points`` equal return buckets between the asset means."""
    low, high = F.col("low_return"), F.col("high_return")
    bucket = F.floor((F.col("expected_return") - low) / F.nullif(high - low, F.lit(0.0)) * n_points) + 1
    bucket = F.greatest(F.least(F.coalesce(bucket, F.lit(1)), F.lit(n_points)), F.lit(1)).cast("int")
    return _pick(candidates.withColumn("bucket", bucket), ["universe", "bucket"], F.round("volatility", 9))
