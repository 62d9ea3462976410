import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.functions.normal import chi2_1_upper_tail, norm_cdf, norm_cdf_array
from tidemark.operators import portfolio, risk, series


def frame(spark, values, ticker="X"):
    days = pd.bdate_range("2020-01-01", periods=len(values)).date
    return spark.createDataFrame(pd.DataFrame({"date": days, "ticker": ticker, "ret": values}))


@pytest.fixture(scope="module")
def normal_returns(spark):
    values = np.random.default_rng(3).normal(0.0003, 0.018, 5000)
    return values, frame(spark, values)


def test_normal_cdf(spark):
    z = np.linspace(-9, 9, 2001)
    exact = np.array([0.5 * math.erfc(-x / math.sqrt(2)) for x in z])
    assert np.max(np.abs(norm_cdf_array(z) - exact)) < 1e-15
    got = spark.createDataFrame(pd.DataFrame({"z": z})).select(norm_cdf(F.col("z"))).toPandas().iloc[:, 0]
    assert np.max(np.abs(got - exact)) < 1e-15
    assert norm_cdf_array(np.array([-40.0, 40.0])).tolist() == [0.0, 1.0]


def test_chi_squared_tail(spark):
    df = spark.createDataFrame([(3.841458820694124,), (0.0,), (-1e-16,)], "x double")
    got = [r[0] for r in df.select(chi2_1_upper_tail(F.col("x"))).collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-12) and got[1:] == [1.0, 1.0]


def test_var_matches_numpy_and_tail_loss_is_larger(normal_returns):
    values, df = normal_returns
    hist = risk.historical_var(df).first()["var"]
    param = risk.parametric_var(df).first()["var"]
    assert hist == pytest.approx(-np.percentile(values, 5), abs=1e-12)
    assert param == pytest.approx(-(values.mean() + NormalDist().inv_cdf(0.05) * values.std(ddof=1)), abs=1e-12)
    assert abs(hist - param) < 0.002
    assert risk.historical_cvar(df).first()["cvar"] == pytest.approx(-values[values <= -hist].mean(), abs=1e-12)
    assert risk.historical_cvar(df).first()["cvar"] >= hist and risk.parametric_cvar(df).first()["cvar"] >= param


@pytest.mark.parametrize(("n", "x"), [(2000, 100), (500, 100), (500, 0), (40, 40)])
def test_kupiec(spark, n, x):
    df = spark.createDataFrame([("X", i < x) for i in range(n)], "ticker string, breached boolean")
    row = risk.kupiec_test(df).first()
    rate = x / n
    log = lambda count, p: 0.0 if count == 0 else count * math.log(p)
    lr = -2 * (log(x, 0.05) + log(n - x, 0.95) - log(x, rate) - log(n - x, 1 - rate))
    assert row.n_obs == n and row.n_breaches == x and row.lr_statistic == pytest.approx(lr, abs=1e-9)
    assert row.p_value == pytest.approx(math.erfc(math.sqrt(max(lr, 0) / 2)), abs=1e-6)  # the root magnifies noise near zero
    assert row.reject_at_5pct == (row.p_value < 0.05)


def test_rolling_backtest_excludes_today(spark):
    values = np.random.default_rng(5).normal(0, 0.01, 300)
    df = frame(spark, values)
    got = risk.rolling_var_backtest(df, "historical", window=250).orderBy("date").toPandas()
    want = [-np.percentile(values[i - 250 : i], 5) for i in range(250, 300)]
    assert np.allclose(got["var_estimate"], want, atol=1e-12)
    assert got["breached"].tolist() == [bool(-values[250 + i] > w) for i, w in enumerate(want)]
    with pytest.raises(ValueError):
        risk.rolling_var_backtest(df, "other")


def test_stress_and_missing_overlap(spark):
    positions = spark.createDataFrame([("a", "A", 0.6), ("a", "B", 0.4), ("a", "Z", 0.1), ("b", "Z", 1.0)], "book string, ticker string, weight double")
    shocks = spark.createDataFrame([("A", -0.2), ("B", 0.05)], "ticker string, total_return double")
    rows = {r.book: r for r in risk.stress_test(positions, shocks).collect()}
    assert rows["a"].portfolio_shock == pytest.approx(-0.10) and rows["a"].error is None
    assert rows["b"].portfolio_shock is None and "share no assets" in rows["b"].error


def test_short_period_is_an_error(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.0), (dt.date(2020, 1, 1), "B", 1.0), (dt.date(2020, 1, 2), "B", 3.0)], "date date, ticker string, price double")
    rows = {r.ticker: r for r in series.period_total_return(df, "2020-01-01", "2020-01-05").collect()}
    assert rows["A"].error and rows["A"].total_return is None and rows["B"].total_return == 2.0


@pytest.fixture(scope="module")
def universe(spark):
    rng = np.random.default_rng(42)
    cov = np.array([[4, 1, 0.5], [1, 9, -1], [0.5, -1, 1]]) * 1e-4
    values = rng.multivariate_normal([0.001, 0.0005, 0.0002], cov, 400)
    wide = pd.DataFrame(values, columns=["A", "B", "C"])
    wide["date"] = pd.bdate_range("2019-01-01", periods=400).date
    return values, spark.createDataFrame(wide.melt("date", var_name="ticker", value_name="ret"))


@pytest.mark.parametrize(("per_block", "per_bucket"), [(1, 100), (2, 37), (512, 1024)])
def test_covariance_for_any_blocking(universe, per_block, per_bucket):
    values, returns = universe
    got = portfolio.covariance(returns, per_block, per_bucket).toPandas()
    assert len(got) == 9
    matrix = got.pivot(index="a", columns="b", values="cov").to_numpy()
    assert np.allclose(matrix, np.cov(values.T) * 252, atol=1e-12)


def test_portfolios(universe, spark):
    values, returns = universe
    cov, mu = np.cov(values.T) * 252, values.mean(axis=0) * 252
    weights = spark.createDataFrame([("p", t, w) for t, w in zip("ABC", (0.2, 0.3, 0.5))], "book string, ticker string, weight double")
    row = portfolio.portfolio_stats(returns, weights, rf=0.01).first()
    w = np.array([0.2, 0.3, 0.5])
    assert row.expected_return == pytest.approx(w @ mu) and row.volatility == pytest.approx(math.sqrt(w @ cov @ w))
    assert row.sharpe_ratio == pytest.approx((w @ mu - 0.01) / math.sqrt(w @ cov @ w))
    candidates = portfolio.grid_portfolios(returns, steps=20)
    pdf = candidates.toPandas()
    grid = pdf["weights"].str.split("/", expand=True).astype(int)
    assert len(pdf) == math.comb(22, 2) and (grid.sum(axis=1) == 20).all() and (grid >= 0).all(axis=None)
    assert pdf["weights"].is_unique
    g = grid.to_numpy() / 20
    assert np.allclose(pdf["volatility"], np.sqrt(np.einsum("ij,jk,ik->i", g, cov, g)))
    least = portfolio.min_variance(candidates).first()
    assert least.volatility == pytest.approx(pdf["volatility"].min()) and least.volatility <= np.sqrt(np.diag(cov)).min() + 1e-12
    assert portfolio.max_sharpe(candidates).first().sharpe_ratio == pytest.approx(pdf["sharpe_ratio"].max())
    for best, pick in (("volatility", portfolio.min_variance), ("sharpe_ratio", portfolio.max_sharpe), ("frontier", lambda c: portfolio.efficient_frontier(c, 10))):
        few = portfolio.grid_portfolios(returns, steps=20, best=best, n_points=10)
        assert few.count() < len(pdf) and sorted(map(tuple, pick(few).collect())) == sorted(map(tuple, pick(candidates).collect()))
    frontier = portfolio.efficient_frontier(candidates, 10).toPandas()
    assert frontier["bucket"].between(1, 10).all() and frontier["bucket"].is_unique


@pytest.mark.parametrize(("steps", "n"), [(4, 1), (0, 3), (7, 2), (5, 4), (10, 5)])
def test_every_portfolio_has_a_number(steps, n):
    count = math.comb(steps + n - 1, n - 1)
    units = portfolio._unranked(np.arange(count), steps, n)
    assert (units >= 0).all() and (units.sum(axis=1) == steps).all()
    rows = [tuple(u) for u in units.tolist()]
    assert rows == sorted(set(rows)) and len(rows) == count


def test_wide_grid_is_never_listed(spark):
    """Twenty assets in fifths: 42,504 portfolios, and the numbers of a grid of twenty in tenths."""
    rng = np.random.default_rng(1)
    values = rng.normal(0.0005, 0.01, (60, 20)) * np.linspace(0.5, 2, 20)
    wide = pd.DataFrame(values, columns=[f"T{i:02d}" for i in range(20)])
    wide["date"] = pd.bdate_range("2020-01-01", periods=60).date
    returns = spark.createDataFrame(wide.melt("date", var_name="ticker", value_name="ret"))
    best = portfolio.min_variance(portfolio.grid_portfolios(returns, steps=5, best="volatility")).first()
    cov = np.cov(values.T) * 252
    g = portfolio._unranked(np.arange(math.comb(24, 19)), 5, 20) / 5
    assert best.volatility == pytest.approx(math.sqrt((((g @ cov) * g).sum(axis=1)).min()))
    last = math.comb(29, 19) - 1
    assert portfolio._unranked(np.array([0, last]), 10, 20)[:, [0, -1]].tolist() == [[0, 10], [10, 0]]
    with pytest.raises(ValueError):
        portfolio.grid_portfolios(returns, steps=100)


def prices_frame(spark, n=160):
    rng = np.random.default_rng(11)
    steps = rng.normal(0.0003, 0.01, (n, 4))
    wide = pd.DataFrame(100 * np.exp(np.cumsum(steps, axis=0)), columns=["A", "B", "C", "SPY"])
    wide.index = pd.bdate_range("2021-01-01", periods=n)
    wide.index.name = "date"
    long = wide.reset_index().melt("date", var_name="ticker", value_name="price")
    long["date"] = long["date"].dt.date
    return wide, spark.createDataFrame(long)


def test_factor_panel_against_pandas(spark):
    wide, prices = prices_frame(spark)
    got = series.factor_panel(prices, "SPY").toPandas().sort_values(["ticker", "date"]).reset_index(drop=True)
    parts = []
    for t in "ABC":
        p, r = wide[t], wide[t].pct_change()
        parts.append(pd.DataFrame({
            "date": wide.index.date, "ticker": t, "mom_21": p.pct_change(21), "mom_63": p.pct_change(63), "vol_21": r.rolling(21).std() * np.sqrt(252),
            "reversal_5": -p.pct_change(5), "rel_strength_21": p.pct_change(21) - wide["SPY"].pct_change(21), "forward_return_5d": p.pct_change(5).shift(-5)}))
    want = pd.concat(parts).dropna().reset_index(drop=True)
    assert len(got) == len(want) and not got.isna().any(axis=None)
    assert np.allclose(got[want.columns[2:]].to_numpy(float), want[want.columns[2:]].to_numpy(float), atol=1e-10)
    train, test = series.chronological_split(series.factor_panel(prices, "SPY"))
    assert train.agg(F.max("date")).first()[0] < test.agg(F.min("date")).first()[0]


def test_volatility_panel_against_pandas(spark):
    wide, prices = prices_frame(spark)
    got = series.volatility_panel(prices, "SPY").toPandas().sort_values("date").reset_index(drop=True)
    r = wide.pct_change()
    b, m = r[["A", "B", "C"]].mean(axis=1), r["SPY"]
    a = np.sqrt(252)
    b.iloc[0] = np.nan
    want = pd.DataFrame({
        "trailing_vol_21": b.rolling(21).std() * a, "trailing_vol_63": b.rolling(63).std() * a, "trailing_skew_21": b.rolling(21).skew(),
        "trailing_mean_return_21": b.rolling(21).mean() * 252, "market_vol_21": m.rolling(21).std() * a, "forward_vol_21": b.shift(-21).rolling(21).std() * a}).dropna()
    assert len(got) == len(want)
    assert np.allclose(got[want.columns].to_numpy(float), want.to_numpy(float), atol=1e-8)


def test_dates_missing_a_ticker_are_dropped(spark):
    df = spark.createDataFrame([(dt.date(2020, 1, 1), "A", 1.0), (dt.date(2020, 1, 1), "B", 1.0), (dt.date(2020, 1, 2), "A", 1.0)], "date date, ticker string, price double")
    assert series.align_dates(df).count() == 2


def test_information_coefficient_with_ties(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"s": rng.integers(0, 5, 200).astype(float), "t": rng.integers(0, 9, 200).astype(float)})
    row = risk.information_coefficient(spark.createDataFrame(pdf), "s", "t").first()
    assert row.ic == pytest.approx(pdf["s"].rank().corr(pdf["t"].rank()), abs=1e-12) and row.n == 200


def test_long_short_rules(spark):
    rows = [("d1", "A", 1.0, 0.3), ("d1", "B", 1.0, 0.1), ("d2", "A", 5.0, 0.5), ("d3", "A", 1.0, 0.2), ("d3", "B", 2.0, 0.9)]
    df = spark.createDataFrame(rows, "date string, ticker string, signal double, forward_return_5d double")
    spread = {r.date: r.spread for r in risk.daily_spread(df, "signal").collect()}
    assert spread == {"d1": pytest.approx(0.0), "d3": pytest.approx(0.7)}  # tie: first ticker on both sides; one-name day skipped
    flat = spark.createDataFrame([(d, t, s, 0.1) for d in ("d1", "d2") for t, s in (("A", 1.0), ("B", 2.0))], df.schema)
    assert risk.long_short_sharpe(flat, "signal").first().long_short_sharpe == 0.0


def test_path_payoffs(spark):
    days = [dt.date(2020, 1, i) for i in (1, 2, 3)]
    rows = [(d, s, p) for s, path in {"up": (100.0, 120.0, 130.0), "hit": (100.0, 90.0, 150.0)}.items() for d, p in zip(days, path)]
    got = {r.s: r for r in risk.path_payoffs(spark.createDataFrame(rows, "date date, s string, price double"), ["s"]).collect()}
    assert not got["up"].knocked_out and got["up"].barrier_payoff == 30.0 and got["up"].average_payoff == 25.0
    assert got["hit"].knocked_out and got["hit"].barrier_payoff == 0.0 and got["hit"].average_payoff == 20.0
    with pytest.raises(ValueError):
        risk.path_payoffs(spark.createDataFrame(rows, "date date, s string, price double"), ["s"], barrier=1.0)


def test_estimators(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(10, 2, 500)
    y = 3 * x + rng.normal(0, 1, 500)
    pdf = pd.DataFrame({"g": "a", "shard": rng.integers(0, 7, 500), "pair": np.arange(500) // 2, "x": x, "y": y})
    df = spark.createDataFrame(pdf)
    cov = np.cov(y, x)
    b = cov[0, 1] / cov[1, 1]
    adjusted = y - b * (x - 10)
    row = risk.control_variate(df, "g", "y", "x", 10.0).first()
    assert row["mean"] == pytest.approx(adjusted.mean()) and row.std_error == pytest.approx(adjusted.std(ddof=1) / np.sqrt(500))
    plain = risk.mean_and_error(df, "g", "y").first()
    assert row.std_error < plain.std_error
    pairs = pdf.groupby("pair")["y"].mean()
    assert risk.paired_mean_and_error(df, "g", "pair", "y").first().std_error == pytest.approx(pairs.std(ddof=1) / np.sqrt(250))
    merged = risk.merge_moments(risk.partial_moments(df, ["g", "shard"], "y"), "g").first()
    assert merged["mean"] == pytest.approx(y.mean()) and merged.std_error == pytest.approx(y.std() / np.sqrt(500))
    constant = spark.createDataFrame([("a", 1, 0.1)] * 10, "g string, shard int, y double")
    assert risk.merge_moments(risk.partial_moments(constant, ["g", "shard"], "y"), "g").first().std_error == pytest.approx(0.0, abs=1e-8)


@pytest.mark.parametrize("block, bucket", [(20, 7), (64, 4096), (4096, 4096)])
def test_rolling_quantile_in_blocks(spark, block, bucket):
    rng = np.random.default_rng(5)
    parts, want = [], {}
    for name, n in (("a", 700), ("b", 21), ("c", 20), ("d", 3)):
        values = [None if name == "a" and i in (100, 101, 400) else round(float(v), 2) for i, v in enumerate(rng.normal(0, 1, n))]
        days = pd.bdate_range("1969-10-01", periods=n).date
        parts += [(d, name, v) for d, v in zip(days, values)]
        for i in range(20, n):
            before = values[i - 20 : i]
            if None not in before:
                want[name, days[i]] = float(np.quantile(before, 0.05))
    df = spark.createDataFrame(parts, "date date, ticker string, ret double").repartition(4)
    rows = risk.rolling_quantile(df, 20, 0.05, "ticker", block, bucket).collect()
    assert len(rows) == len(parts)
    got = {(r["ticker"], r["date"]): r["_quantile"] for r in rows if r["_quantile"] is not None}
    assert got == pytest.approx(want, abs=1e-12)
    with pytest.raises(ValueError):
        risk.rolling_quantile(df, 20, 0.05, "ticker", 19)
