"""European option values over a contracts table: price, Greeks, implied volatility, jump-diffusion price.

A contract row has spot ``s``, strike ``k``, years ``t``, rate ``r``, volatility ``sigma``, dividend yield ``q``
and ``option_type``. Closed forms are Column expressions staged so that each intermediate is computed once.
The two iterative ones (a root search and a 40-term sum) run as numpy over Arrow batches.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tidemark.functions.normal import norm_cdf, norm_cdf_array, norm_pdf

# Search range, price tolerance and number of jump terms.
LOW_VOL, HIGH_VOL = 1e-4, 5.0
FLOOR_TOLERANCE = 1e-10
JUMP_TERMS = 40
BISECTIONS = 60


def _is_call() -> Column:
    kind = F.col("option_type")
    bad = F.raise_error(F.concat(F.lit("option_type must be 'call' or 'put', got "), F.coalesce(kind, F.lit("NULL"))))
    return F.when(kind == "call", True).when(kind == "put", False).otherwise(bad.cast("boolean"))


def _staged(contracts: DataFrame) -> DataFrame:
    """Add d1, d2 and their distribution values; NULL where the contract has expired."""
    live = F.when(F.col("t") > 0, F.col("t"))
    return (
        contracts.withColumn("_call", _is_call())
        .withColumn("_width", F.col("sigma") * F.sqrt(live))
        .withColumn("_d1", (F.ln(F.col("s") / F.col("k")) + (F.col("r") - F.col("q") + F.col("sigma") * F.col("sigma") * 0.5) * live) / F.col("_width"))
        .withColumn("_d2", F.col("_d1") - F.col("_width"))
        .withColumns(
            {
                "_n1": norm_cdf(F.col("_d1")),
                "_n2": norm_cdf(F.col("_d2")),
                "_m1": norm_cdf(-F.col("_d1")),
                "_m2": norm_cdf(-F.col("_d2")),
                "_spot": F.col("s") * F.exp(-F.col("q") * F.col("t")),
                "_cash": F.col("k") * F.exp(-F.col("r") * F.col("t")),
            }
        )
    )


STAGED = ["_call", "_width", "_d1", "_d2", "_n1", "_n2", "_m1", "_m2", "_spot", "_cash"]


def _price() -> Column:
    s, k = F.col("s"), F.col("k")
    intrinsic = F.greatest(F.when(F.col("_call"), s - k).otherwise(k - s), F.lit(0.0))
    live = F.when(
        F.col("_call"), F.col("_spot") * F.col("_n1") - F.col("_cash") * F.col("_n2")
    ).otherwise(F.col("_cash") * F.col("_m2") - F.col("_spot") * F.col("_m1"))
    return F.when(F.col("t") <= 0, intrinsic).otherwise(live)


def black_scholes_price(contracts: DataFrame, out: str = "price") -> DataFrame:
    """Closed-form price; intrinsic value at or after expiry; an unknown option type fails the job."""
    return _staged(contracts).withColumn(out, _price()).drop(*STAGED)


def black_scholes_greeks(contracts: DataFrame) -> DataFrame:
    """Price, delta, gamma, vega, theta and rho; theta and rho are per year."""
    call, root = F.col("_call"), F.sqrt("t")
    sign = F.when(call, 1.0).otherwise(-1.0)
    carry = F.exp(-F.col("q") * F.col("t"))
    near, far = F.when(call, F.col("_n1")).otherwise(F.col("_m1")), F.when(call, F.col("_n2")).otherwise(F.col("_m2"))
    density = norm_pdf(F.col("_d1"))
    decay = -F.col("_spot") * density * F.col("sigma") / (root * 2.0)
    return (
        _staged(contracts)
        .withColumns(
            {
                "price": _price(),
                "delta": sign * carry * near,
                "gamma": carry * density / (F.col("s") * F.col("_width")),
                "vega": F.col("_spot") * density * root,
                "theta": decay + sign * (F.col("q") * F.col("_spot") * near - F.col("r") * F.col("_cash") * far),
                "rho": sign * F.col("t") * F.col("_cash") * far,
            }
        )
        .drop(*STAGED)
    )


def _price_array(s, k, t, r, sigma, call):
    """The same closed form over numpy arrays, without dividends."""
    width = sigma * np.sqrt(t)
    d1 = (np.log(s / k) + (r + 0.5 * sigma * sigma) * t) / width
    sign = np.where(call, 1.0, -1.0)
    return sign * (s * norm_cdf_array(sign * d1) - k * np.exp(-r * t) * norm_cdf_array(sign * (d1 - width)))


def _implied(price, s, k, t, r, call):
    """Bisection of a whole batch at once; NaN below the price floor or when the range holds no root."""
    low, high = np.full(len(s), LOW_VOL), np.full(len(s), HIGH_VOL)
    floor = np.maximum(np.where(call, s - k, k - s), 0.0) * np.exp(-r * t) + FLOOR_TOLERANCE
    with np.errstate(all="ignore"):
        solvable = (price > floor) & (_price_array(s, k, t, r, low, call) <= price) & (price <= _price_array(s, k, t, r, high, call))
        for _ in range(BISECTIONS):
            middle = (low + high) / 2
            under = _price_array(s, k, t, r, middle, call) < price
            low, high = np.where(under, middle, low), np.where(under, high, middle)
    return np.where(solvable, (low + high) / 2, np.nan)


@F.pandas_udf(DoubleType())
def _implied_udf(price: pd.Series, s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, call: pd.Series) -> pd.Series:
    return pd.Series(_implied(*(x.to_numpy(float) for x in (price, s, k, t, r)), call.to_numpy(bool)))


def implied_volatility(quotes: DataFrame, price: str = "price", out: str = "implied_vol") -> DataFrame:
    """Volatility at which the dividend-free closed form gives ``price``; NULL when there is none."""
    value = _implied_udf(price, "s", "k", "t", "r", _is_call())
    return quotes.withColumn(out, F.nanvl(value, F.lit(None).cast("double")))


def _jump_price(s, k, t, r, sigma, call, intensity, jump_mean, jump_vol):
    drift = jump_mean + 0.5 * jump_vol * jump_vol
    growth = math.exp(drift) - 1
    rate = intensity * (1 + growth) * t
    weight, total = np.exp(-rate), np.zeros(len(s))
    for n in range(JUMP_TERMS):
        if n:
            weight = weight * rate / n
        total += weight * _price_array(s, k, t, r - intensity * growth + n * drift / t, np.sqrt(sigma * sigma + n * jump_vol * jump_vol / t), call)
    return total


def jump_diffusion_price(contracts: DataFrame, intensity: float, jump_mean: float, jump_vol: float, out: str = "price") -> DataFrame:
    """Poisson-weighted sum of closed-form prices with lognormal jumps; the intrinsic value where the contract has expired."""

    @F.pandas_udf(DoubleType())
    def value(s: pd.Series, k: pd.Series, t: pd.Series, r: pd.Series, sigma: pd.Series, call: pd.Series) -> pd.Series:
        s_, k_, t_, r_, sigma_ = (x.to_numpy(float) for x in (s, k, t, r, sigma))
        side, live = call.to_numpy(bool), t_ > 0
        expired = np.maximum(np.where(side, s_ - k_, k_ - s_), 0.0)
        running = _jump_price(s_, k_, np.where(live, t_, 1.0), r_, sigma_, side, intensity, jump_mean, jump_vol)
        return pd.Series(np.where(live, running, np.where(np.isnan(t_), np.nan, expired)))

    return contracts.withColumn(out, value("s", "k", "t", "r", "sigma", _is_call()))


def jump_smile(contracts: DataFrame, moneyness: list[float], intensity: float, jump_mean: float, jump_vol: float) -> DataFrame:
    """Price and implied volatility of every contract at each strike ``s * m``. The grid fans out inside the row."""
    grid = contracts.withColumn("k", F.explode(F.transform(F.array(*[F.lit(float(m)) for m in moneyness]), lambda m: m * F.col("s"))))
    return implied_volatility(jump_diffusion_price(grid, intensity, jump_mean, jump_vol))
