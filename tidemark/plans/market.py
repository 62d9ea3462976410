"""Return panels, risk figures, signals and portfolios over the derived price table."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import functions as F

from tidemark.functions.normal import DENOMINATOR, NUMERATOR
from tidemark.operators import portfolio, risk, series
from tidemark.plans import views
from tidemark.plans.registry import Registry, round_all, rounded
from tidemark.plans.views import MARKET, with_views
from tidemark.session import materialize

R = Registry()
Z = NormalDist().inv_cdf(1 - 0.95)
TAIL_SCALE = NormalDist().pdf(NormalDist().inv_cdf(0.95)) / (1 - 0.95)
STRESS_START, STRESS_END = "1998-03-15", "1998-05-15"
W = "OVER (PARTITION BY ticker ORDER BY date)"
# A price is a quotient of two exact sums, so it can end in an exact half; both sides settle it at 9 digits first.
PRICE = "CAST(ROUND(CAST(price AS DECIMAL(28,9)), 4) AS DOUBLE) AS price"


def returns(spark, d):
    return series.daily_returns(views.prices(spark, d))


def settled(prices):
    return prices.withColumn("price", F.round(F.round("price", 9), 4))


@R.query("j2_aligned_prices", with_views("prices_v", f"SELECT date, ticker, {PRICE} FROM prices_v"))
def aligned_prices(spark, d):
    return settled(views.prices(spark, d))


@R.query("f8_date_slice_return", with_views("prices_v", f"""
SELECT ticker, COUNT(*) AS n_days, ROUND(arg_max(price, date) / arg_min(price, date) - 1, 6) AS total_return, CAST(NULL AS VARCHAR) AS error
FROM prices_v WHERE date BETWEEN DATE '{STRESS_START}' AND DATE '{STRESS_END}' GROUP BY ticker"""))
def date_slice(spark, d):
    return round_all(series.period_total_return(views.prices(spark, d), STRESS_START, STRESS_END), "total_return")


@R.query("f11_drop_market", with_views("prices_v", f"SELECT date, ticker, {PRICE} FROM prices_v WHERE ticker <> '{MARKET}'"))
def drop_market(spark, d):
    return settled(views.prices(spark, d).where(F.col("ticker") != MARKET))


@R.query("j3_market_join", with_views("returns_v", f"""
SELECT a.date, a.ticker, ROUND(a.ret, 6) AS ret, ROUND(m.ret, 6) AS market_ret
FROM returns_v a JOIN returns_v m ON a.date = m.date AND m.ticker = '{MARKET}' WHERE a.ticker <> '{MARKET}'"""))
def market_join(spark, d):
    r = returns(spark, d)
    joined = series.with_market(r.where(F.col("ticker") != MARKET), r.where(F.col("ticker") == MARKET), "ret")
    return round_all(joined, "ret", "market_ret")


@R.query("u1_union_series", with_views("prices_v", f"SELECT date, ticker, {PRICE} FROM prices_v"))
def union_series(spark, d):
    p = settled(views.prices(spark, d))
    return p.where(F.col("ticker") < "B").unionByName(p.where(F.col("ticker") >= "B").select("ticker", "price", "date"))


@R.query("w3_pct_change", with_views("prices_v", f"""
SELECT date, ticker, ROUND(price / LAG(price, 1) {W} - 1, 6) AS chg_1, ROUND(price / LAG(price, 5) {W} - 1, 6) AS chg_5,
       ROUND(price / LAG(price, 21) {W} - 1, 6) AS chg_21, ROUND(price / LAG(price, 63) {W} - 1, 6) AS chg_63 FROM prices_v"""))
def pct_change(spark, d):
    changes = {f"chg_{n}": rounded(series.pct_change("price", n)) for n in (1, 5, 21, 63)}
    return views.prices(spark, d).withColumns(changes).drop("price")


def _roll(agg, col, first, last, key="PARTITION BY ticker "):
    lo = f"{-first} PRECEDING" if first <= 0 else f"{first} FOLLOWING"
    hi = "CURRENT ROW" if last == 0 else f"{last} FOLLOWING"
    frame = f"({key}ORDER BY date ROWS BETWEEN {lo} AND {hi})"
    return f"CASE WHEN COUNT({col}) OVER {frame} = {last - first + 1} THEN {agg}({col}) OVER {frame} END"


@R.query("w4_rolling_volatility", with_views("returns_v", f"""
SELECT date, ticker, ROUND({_roll('stddev_samp', 'ret', -20, 0)} * sqrt(252), 6) AS vol_21, ROUND({_roll('stddev_samp', 'ret', -62, 0)} * sqrt(252), 6) AS vol_63,
       ROUND({_roll('avg', 'ret', -20, 0)} * 252, 6) AS mean_21 FROM returns_v"""))
def rolling_volatility(spark, d):
    return returns(spark, d).withColumns(
        {
            "vol_21": rounded(series.rolling_volatility("ret", 21)),
            "vol_63": rounded(series.rolling_volatility("ret", 63)),
            "mean_21": rounded(series.rolling(F.avg, "ret", -20, 0) * series.TRADING_DAYS),
        }
    ).drop("ret")


@R.query("w5_rolling_skew", with_views("returns_v", f"SELECT date, ticker, ROUND({_roll('skewness', 'ret', -20, 0)}, 6) AS skew_21 FROM returns_v"))
def rolling_skew(spark, d):
    return returns(spark, d).withColumn("skew_21", rounded(series.rolling_skew("ret", 21))).drop("ret")


@R.query("w6_forward_labels", with_views("prices_v", f"""
SELECT date, ticker, ROUND(LEAD(price, 5) {W} / price - 1, 6) AS forward_return_5d, ROUND({_roll('stddev_samp', 'ret', 1, 21)} * sqrt(252), 6) AS forward_vol_21
FROM (SELECT *, price / LAG(price) {W} - 1 AS ret FROM prices_v)"""))
def forward_labels(spark, d):
    p = views.prices(spark, d).withColumn("ret", series.pct_change("price", 1))
    return p.select(
        "date", "ticker",
        rounded(series.forward_return("price", 5)).alias("forward_return_5d"),
        rounded(series.rolling(F.stddev_samp, "ret", 1, 21) * math.sqrt(252)).alias("forward_vol_21"),
    )


FACTORS_SQL = f"""
SELECT a.date, a.ticker, a.mom_21, a.mom_63, a.vol_21, a.reversal_5, a.mom_21 - m.mom_21 AS rel_strength_21, a.forward_return_5d
FROM factor_base a JOIN factor_base m ON a.date = m.date AND m.ticker = '{MARKET}'
WHERE a.ticker <> '{MARKET}' AND a.mom_63 IS NOT NULL AND a.vol_21 IS NOT NULL AND a.forward_return_5d IS NOT NULL"""
FACTOR_BASE_SQL = f"""
SELECT date, ticker, price / LAG(price, 21) {W} - 1 AS mom_21, price / LAG(price, 63) {W} - 1 AS mom_63, 1 - price / LAG(price, 5) {W} AS reversal_5,
       {_roll('stddev_samp', 'ret', -20, 0)} * sqrt(252) AS vol_21, LEAD(price, 5) {W} / price - 1 AS forward_return_5d
FROM (SELECT *, price / LAG(price) {W} - 1 AS ret FROM prices_v)"""


def with_factors(body, **extra):
    return with_views("prices_v", body, factor_base=FACTOR_BASE_SQL, panel=FACTORS_SQL, **extra)


def factor_panel(spark, d):
    return series.factor_panel(views.prices(spark, d), MARKET)


def _select_rounded(cols):
    return ", ".join(f"ROUND({c}, 6) AS {c}" for c in cols)


@R.query("w7_reversal_relative_strength", with_factors("SELECT date, ticker, ROUND(reversal_5, 6) AS reversal_5, ROUND(rel_strength_21, 6) AS rel_strength_21 FROM panel"))
def reversal_relative_strength(spark, d):
    return round_all(factor_panel(spark, d).select("date", "ticker", "reversal_5", "rel_strength_21"), "reversal_5", "rel_strength_21")


PANEL_COLUMNS = series.FACTOR_COLUMNS + ["forward_return_5d"]


@R.query("w8_factor_panel", with_factors(f"SELECT date, ticker, {_select_rounded(PANEL_COLUMNS)} FROM panel"))
def factor_panel_query(spark, d):
    return round_all(factor_panel(spark, d), *PANEL_COLUMNS)


VOL_COLUMNS = series.VOLATILITY_COLUMNS + ["forward_vol_21"]
VOL_SQL = f"""
SELECT * FROM (SELECT date, {_roll('stddev_samp', 'r', -20, 0, '')} * sqrt(252) AS trailing_vol_21, {_roll('stddev_samp', 'r', -62, 0, '')} * sqrt(252) AS trailing_vol_63,
       {_roll('skewness', 'r', -20, 0, '')} AS trailing_skew_21, {_roll('avg', 'r', -20, 0, '')} * 252 AS trailing_mean_return_21,
       {_roll('stddev_samp', 'm', -20, 0, '')} * sqrt(252) AS market_vol_21, {_roll('stddev_samp', 'r', 1, 21, '')} * sqrt(252) AS forward_vol_21
  FROM (SELECT date, AVG(CASE WHEN ticker <> '{MARKET}' THEN ret END) AS r, MAX(CASE WHEN ticker = '{MARKET}' THEN ret END) AS m FROM returns_v GROUP BY date))
WHERE trailing_vol_63 IS NOT NULL AND market_vol_21 IS NOT NULL AND forward_vol_21 IS NOT NULL"""


@R.query("w9_volatility_panel", with_views("returns_v", f"SELECT date, {_select_rounded(VOL_COLUMNS)} FROM vol_panel", vol_panel=VOL_SQL))
def volatility_panel(spark, d):
    return round_all(series.volatility_panel(views.prices(spark, d), MARKET), *VOL_COLUMNS)


HIST_BACKTEST = """
SELECT ticker, date, var_estimate, ret AS actual_return, -ret > var_estimate AS breached FROM (
  SELECT *, -quantile_cont(ret, 1 - 0.95) OVER f AS var_estimate, COUNT(*) OVER f AS n FROM returns_v
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) WHERE n = 250"""
PARAM_BACKTEST = f"""
SELECT ticker, date, var_estimate, ret AS actual_return, -ret > var_estimate AS breached FROM (
  SELECT *, -(AVG(ret) OVER f + ({Z!r}) * stddev_samp(ret) OVER f) AS var_estimate, COUNT(*) OVER f AS n FROM returns_v
  WINDOW f AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 250 PRECEDING AND 1 PRECEDING)) WHERE n = 250"""
BACKTEST_OUT = "SELECT ticker, date, ROUND(var_estimate, 6) AS var_estimate, ROUND(actual_return, 6) AS actual_return, breached FROM backtest"


@R.query("w10_rolling_var_historical", with_views("returns_v", BACKTEST_OUT, backtest=HIST_BACKTEST))
def rolling_var_historical(spark, d):
    return round_all(risk.rolling_var_backtest(returns(spark, d), "historical"), "var_estimate", "actual_return")


@R.query("w10_rolling_var_blocks", with_views("returns_v", BACKTEST_OUT, backtest=HIST_BACKTEST))
def rolling_var_blocks(spark, d):
    """The same backtest with every series cut into blocks of 300 rows."""
    return round_all(risk.rolling_var_backtest(returns(spark, d), "historical", block_rows=300), "var_estimate", "actual_return")


@R.query("w10_rolling_var_parametric", with_views("returns_v", BACKTEST_OUT, backtest=PARAM_BACKTEST))
def rolling_var_parametric(spark, d):
    return round_all(risk.rolling_var_backtest(returns(spark, d), "parametric"), "var_estimate", "actual_return")


@R.query("a16_equal_weight_returns", with_views("portfolio_v", "SELECT date, ROUND(ret, 6) AS ret FROM portfolio_v"))
def equal_weight(spark, d):
    return round_all(series.equal_weight_returns(returns(spark, d)), "ret")


@R.query("a17_mean_vector", with_views("returns_v", "SELECT ticker, ROUND(AVG(ret) * 252, 6) AS mean FROM returns_v GROUP BY ticker"))
def mean_vector(spark, d):
    return round_all(portfolio.annual_means(returns(spark, d)), "mean")


COV_SQL = """
SELECT a.ticker AS a, b.ticker AS b, covar_samp(a.ret, b.ret) * 252 AS cov FROM returns_v a JOIN returns_v b ON a.date = b.date GROUP BY a.ticker, b.ticker"""


@R.query("a17_covariance", with_views("returns_v", "SELECT a, b, ROUND(cov, 6) AS cov FROM cov_v", cov_v=COV_SQL))
def covariance(spark, d):
    return round_all(portfolio.covariance(returns(spark, d)), "cov")


@R.query("a18_portfolio_stats", with_views("returns_v positions_v", """
SELECT book, ROUND(r, 6) AS expected_return, ROUND(v, 6) AS volatility, ROUND(CASE WHEN v > 0 THEN (r - 0.04) / v ELSE 0 END, 6) AS sharpe_ratio FROM (
  SELECT p.book, m.r, sqrt(q.v) AS v FROM (SELECT DISTINCT book FROM positions_v) p
  JOIN (SELECT book, SUM(weight * mean) AS r FROM positions_v JOIN (SELECT ticker, AVG(ret) * 252 AS mean FROM returns_v GROUP BY ticker) USING (ticker) GROUP BY book) m USING (book)
  JOIN (SELECT x.book, SUM(x.weight * y.weight * cov) AS v FROM positions_v x JOIN positions_v y ON x.book = y.book
        JOIN cov_v ON cov_v.a = x.ticker AND cov_v.b = y.ticker GROUP BY x.book) q USING (book))""", cov_v=COV_SQL))
def portfolio_stats(spark, d):
    stats = portfolio.portfolio_stats(returns(spark, d), views.positions(spark, d), rf=0.04)
    return round_all(stats, "expected_return", "volatility", "sharpe_ratio")


GRID_SQL = """
SELECT w1 || '/' || w2 || '/' || w3 || '/' || w4 || '/' || (10 - w1 - w2 - w3 - w4) AS weights, [w1, w2, w3, w4, 10 - w1 - w2 - w3 - w4] AS u
FROM range(0, 11) a(w1), range(0, 11) b(w2), range(0, 11) c(w3), range(0, 11) d(w4) WHERE w1 + w2 + w3 + w4 <= 10"""
ORDERED_SQL = "SELECT ticker, mean, ROW_NUMBER() OVER (ORDER BY ticker) AS i FROM (SELECT ticker, AVG(ret) * 252 AS mean FROM returns_v GROUP BY ticker)"
CANDIDATES_SQL = """
SELECT weights, r, v, CASE WHEN v > 0 THEN (r - 0.04) / v ELSE 0 END AS s FROM (
  SELECT weights, SUM(u[m.i] / 10e0 * m.mean) AS r FROM grid, ordered m GROUP BY weights) JOIN (
  SELECT weights, sqrt(greatest(SUM(u[x.i] / 10e0 * u[y.i] / 10e0 * cov), 0)) AS v
  FROM grid, cov_v JOIN ordered x ON x.ticker = cov_v.a JOIN ordered y ON y.ticker = cov_v.b GROUP BY weights) USING (weights)"""
PICK = "weights, ROUND(r, 6) AS expected_return, ROUND(v, 6) AS volatility, ROUND(s, 6) AS sharpe_ratio"


def with_grid(body):
    return with_views("returns_v", body, cov_v=COV_SQL, ordered=ORDERED_SQL, grid=GRID_SQL, cand=CANDIDATES_SQL)


def candidates(spark, d, best):
    return portfolio.grid_portfolios(returns(spark, d), steps=10, rf=0.04, best=best)


STATS = ("expected_return", "volatility", "sharpe_ratio")


@R.query("a19_min_variance", with_grid(f"SELECT 'all' AS universe, {PICK} FROM cand ORDER BY ROUND(v, 9), weights LIMIT 1"))
def min_variance(spark, d):
    return round_all(portfolio.min_variance(candidates(spark, d, "volatility")), *STATS)


@R.query("a20_max_sharpe", with_grid(f"SELECT 'all' AS universe, {PICK} FROM cand ORDER BY ROUND(s, 9) DESC, weights LIMIT 1"))
def max_sharpe(spark, d):
    return round_all(portfolio.max_sharpe(candidates(spark, d, "sharpe_ratio")), *STATS)


@R.query("a21_efficient_frontier", with_grid(f"""
SELECT 'all' AS universe, CAST(bucket AS INTEGER) AS bucket, {PICK} FROM (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY bucket ORDER BY ROUND(v, 9), weights) AS rn FROM (
    SELECT *, greatest(least(floor((r - (SELECT MIN(mean) FROM ordered)) / (SELECT MAX(mean) - MIN(mean) FROM ordered) * 40) + 1, 40), 1) AS bucket FROM cand))
WHERE rn = 1"""))
def efficient_frontier(spark, d):
    return round_all(portfolio.efficient_frontier(candidates(spark, d, "frontier")), *STATS)


@R.query("a22_annualized_stats", with_views("returns_v", """
SELECT ticker, ROUND(AVG(ret) * 252, 6) AS annual_return, ROUND(stddev_samp(ret) * sqrt(252), 6) AS annual_volatility FROM returns_v GROUP BY ticker"""))
def annualized_stats(spark, d):
    return round_all(risk.annualized_stats(returns(spark, d)), "annual_return", "annual_volatility")


@R.query("a23_historical_var", with_views("returns_v", "SELECT ticker, ROUND(-quantile_cont(ret, 1 - 0.95), 6) AS var FROM returns_v GROUP BY ticker"))
def historical_var(spark, d):
    return round_all(risk.historical_var(returns(spark, d)), "var")


@R.query("a24_parametric_var", with_views("returns_v", f"SELECT ticker, ROUND(-(AVG(ret) + ({Z!r}) * stddev_samp(ret)), 6) AS var FROM returns_v GROUP BY ticker"))
def parametric_var(spark, d):
    return round_all(risk.parametric_var(returns(spark, d)), "var")


BOOK_SQL = "SELECT book, date, SUM(weight * ret) AS ret FROM returns_v JOIN positions_v USING (ticker) GROUP BY book, date"


@R.query("a25_scenario_var", with_views("returns_v positions_v", "SELECT book, ROUND(-quantile_cont(ret, 1 - 0.95), 6) AS var FROM book_v GROUP BY book", book_v=BOOK_SQL))
def scenario_var(spark, d):
    return round_all(risk.scenario_var(returns(spark, d), views.positions(spark, d)), "var")


@R.query("a25_scenario_var_narrowed", with_views("returns_v positions_v", "SELECT book, ROUND(-quantile_cont(ret, 1 - 0.95), 6) AS var FROM book_v GROUP BY book", book_v=BOOK_SQL))
def scenario_var_narrowed(spark, d):
    """The same when a task may hold two values of a book: all books are narrowed level by level."""
    return round_all(risk.scenario_var(returns(spark, d), views.positions(spark, d), held_rows=2), "var")


@R.query("a26_historical_cvar", with_views("returns_v", """
SELECT ticker, ROUND(COALESCE(-AVG(CASE WHEN ret <= q THEN ret END), -MIN(q)), 6) AS cvar
FROM returns_v JOIN (SELECT ticker, quantile_cont(ret, 1 - 0.95) AS q FROM returns_v GROUP BY ticker) USING (ticker) GROUP BY ticker"""))
def historical_cvar(spark, d):
    return round_all(risk.historical_cvar(returns(spark, d)), "cvar")


@R.query("a27_parametric_cvar", with_views("returns_v", f"SELECT ticker, ROUND(-AVG(ret) + stddev_samp(ret) * ({TAIL_SCALE!r}), 6) AS cvar FROM returns_v GROUP BY ticker"))
def parametric_cvar(spark, d):
    return round_all(risk.parametric_cvar(returns(spark, d)), "cvar")


def phi_sql(z: str) -> str:
    """Lower-tail normal probability of a non-positive column, for the SQL side."""
    x = f"abs({z})"
    num = den = None
    for c in NUMERATOR:
        num = f"{c!r}" if num is None else f"(({num}) * {x} + {c!r})"
    for c in DENOMINATOR:
        den = f"{c!r}" if den is None else f"(({den}) * {x} + {c!r})"
    tail = f"exp(-{x} * {x} / 2e0) / ({x} + 1e0/({x} + 2e0/({x} + 3e0/({x} + 4e0/({x} + 0.65e0))))) / 2.506628274631e0"
    lower = f"(CASE WHEN {x} > 37 THEN 0e0 WHEN {x} < 7.07106781186547e0 THEN exp(-{x} * {x} / 2e0) * {num} / {den} ELSE {tail} END)"
    return f"(CASE WHEN {z} > 0 THEN 1 - {lower} ELSE {lower} END)"


@R.query("a28_kupiec_test", with_views("returns_v", f"""
SELECT ticker, n AS n_obs, x AS n_breaches, ROUND(x / n, 6) AS breach_rate, ROUND(1 - 0.95e0, 6) AS expected_rate, ROUND(lr, 6) AS lr_statistic,
       ROUND(2 * {phi_sql('root')}, 6) AS p_value, 2 * {phi_sql('root')} < 0.05 AS reject_at_5pct
FROM (SELECT *, -sqrt(greatest(lr, 0)) AS root FROM (SELECT *, -2 * (x * ln(0.05e0) + (n - x) * ln(0.95e0)
   - CASE WHEN x = 0 THEN 0 ELSE x * ln(x / n) END - CASE WHEN x = n THEN 0 ELSE (n - x) * ln(1 - x / n) END) AS lr
  FROM (SELECT ticker, COUNT(*) AS n, CAST(SUM(CASE WHEN breached THEN 1 ELSE 0 END) AS BIGINT) AS x FROM backtest GROUP BY ticker)))""", backtest=HIST_BACKTEST))
def kupiec_test(spark, d):
    tested = risk.kupiec_test(risk.rolling_var_backtest(returns(spark, d), "historical"))
    return round_all(tested, "breach_rate", "expected_rate", "lr_statistic", "p_value")


@R.query("a29_window_breach_rate", with_views("returns_v", f"""
SELECT ticker, ROUND(AVG(CASE WHEN date BETWEEN DATE '{STRESS_START}' AND DATE '{STRESS_END}' THEN CAST(breached AS INTEGER) END), 6) AS window_rate,
       ROUND(AVG(CAST(breached AS INTEGER)), 6) AS full_rate FROM backtest GROUP BY ticker""", backtest=PARAM_BACKTEST))
def window_breach_rate(spark, d):
    backtest = risk.rolling_var_backtest(returns(spark, d), "parametric")
    return round_all(risk.window_breach_rate(backtest, STRESS_START, STRESS_END), "window_rate", "full_rate")


SHOCKS_SQL = f"""SELECT ticker, arg_max(price, date) / arg_min(price, date) - 1 AS shock FROM prices_v
WHERE date BETWEEN DATE '{STRESS_START}' AND DATE '{STRESS_END}' GROUP BY ticker"""


@R.query("a30_period_total_return", with_views("prices_v", "SELECT ticker, ROUND(shock, 6) AS total_return FROM shocks", shocks=SHOCKS_SQL))
def period_total_return(spark, d):
    return round_all(series.period_total_return(views.prices(spark, d), STRESS_START, STRESS_END), "total_return").select("ticker", "total_return")


@R.query("j4_shared_assets", with_views("prices_v positions_v", """
SELECT book, ticker, ROUND(weight, 6) AS weight, ROUND(shock, 6) AS total_return FROM positions_v JOIN shocks USING (ticker)""", shocks=SHOCKS_SQL))
def shared_assets(spark, d):
    shocks = series.period_total_return(views.prices(spark, d), STRESS_START, STRESS_END)
    joined = views.positions(spark, d).join(shocks.select("ticker", "total_return"), "ticker")
    return round_all(joined, "weight", "total_return")


@R.query("a31_stress_test", with_views("prices_v positions_v", """
SELECT book, ROUND(SUM(weight * shock), 6) AS portfolio_shock, COUNT(shock) AS n_assets,
  CASE WHEN COUNT(shock) = 0 THEN 'weights and shocks share no assets' END AS error
FROM positions_v LEFT JOIN shocks USING (ticker) GROUP BY book""", shocks=SHOCKS_SQL))
def stress_test(spark, d):
    shocks = series.period_total_return(views.prices(spark, d), STRESS_START, STRESS_END)
    return round_all(risk.stress_test(views.positions(spark, d), shocks), "portfolio_shock")


SPLIT_SQL = "SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) WHERE i = CAST(floor(n * 0.7e0) AS BIGINT)"


@R.query("m7_chronological_split", with_factors("""
SELECT date, ticker, CASE WHEN date < (SELECT date FROM cutoff) THEN 'train' ELSE 'test' END AS side FROM panel""", cutoff=SPLIT_SQL))
def chronological_split(spark, d):
    panel = materialize(factor_panel(spark, d)).select("date", "ticker")
    train, test = series.chronological_split(panel)
    return train.withColumn("side", F.lit("train")).unionByName(test.withColumn("side", F.lit("test")))


@R.query("m8_position_split", with_views("portfolio_v", """
SELECT date, CASE WHEN ROW_NUMBER() OVER (ORDER BY date) <= floor(COUNT(*) OVER () * 0.7e0) THEN 'train' ELSE 'test' END AS side FROM portfolio_v"""))
def position_split(spark, d):
    book = series.equal_weight_returns(returns(spark, d)).withColumn("book", F.lit("equal_weight"))
    return series.position_split(book, "book").select("date", "side")


def momentum_panel(spark, d):
    return materialize(factor_panel(spark, d).withColumn("signal", series.momentum_signal()))


@R.query("m9_momentum_signal", with_factors("SELECT date, ticker, ROUND(mom_21 + mom_63, 6) AS signal FROM panel"))
def momentum_signal(spark, d):
    panel = factor_panel(spark, d)
    return panel.select("date", "ticker", rounded(series.momentum_signal()).alias("signal"))


def _rank_sql(col):
    return f"RANK() OVER (ORDER BY {col}) + (COUNT(*) OVER (PARTITION BY {col}) - 1) / 2e0"


@R.query("a32_information_coefficient", with_factors(f"""
SELECT n, ROUND(ic, 6) AS ic, ROUND(t, 4) AS t_statistic, ROUND(2 * {phi_sql('z')}, 6) AS p_value FROM (
  SELECT n, ic, ic * sqrt((n - 2) / (1 - ic * ic)) AS t, -abs(ic * sqrt((n - 2) / (1 - ic * ic))) AS z
  FROM (SELECT COUNT(*) AS n, corr(rs, rt) AS ic FROM (
    SELECT {_rank_sql('signal')} AS rs, {_rank_sql('forward_return_5d')} AS rt FROM (SELECT mom_21 + mom_63 AS signal, forward_return_5d FROM panel))))"""))
def information_coefficient(spark, d):
    scored = risk.information_coefficient(momentum_panel(spark, d), "signal", "forward_return_5d")
    return scored.select("n", rounded("ic").alias("ic"), rounded("t_statistic", 4).alias("t_statistic"), rounded("p_value").alias("p_value"))


SPREAD_SQL = """
SELECT date, arg_max(f, s) - arg_min(f, s) AS spread FROM (SELECT date, mom_21 + mom_63 AS s, forward_return_5d AS f FROM panel) GROUP BY date HAVING COUNT(*) >= 2"""


@R.query("t4_daily_spread", with_factors("SELECT date, ROUND(spread, 6) AS spread FROM spreads", spreads=SPREAD_SQL))
def daily_spread(spark, d):
    return round_all(risk.daily_spread(factor_panel(spark, d).withColumn("signal", series.momentum_signal()), "signal"), "spread")


@R.query("a33_long_short_sharpe", with_factors("""
SELECT COUNT(*) AS n_days, CASE WHEN COUNT(*) = 0 THEN 0 ELSE ROUND(AVG(spread) / stddev_samp(spread) * sqrt(252 / 5e0), 6) END AS long_short_sharpe FROM spreads""", spreads=SPREAD_SQL))
def long_short_sharpe(spark, d):
    panel = factor_panel(spark, d).withColumn("signal", series.momentum_signal())
    return round_all(risk.long_short_sharpe(panel, "signal"), "long_short_sharpe")


@R.query("a34_path_payoffs", with_views("prices_v", """
SELECT ticker, month, n AS n_points, low <= first * 0.9 AS knocked_out, ROUND(last, 6) AS last_price, ROUND(avg_price, 6) AS average_price,
  ROUND(CASE WHEN low <= first * 0.9 THEN 0 ELSE greatest(last - first, 0) END, 6) AS barrier_payoff, ROUND(greatest(avg_price - first, 0), 6) AS average_payoff
FROM (SELECT ticker, month, COUNT(*) AS n, MIN(price) AS low, MAX(CASE WHEN step = 1 THEN price END) AS first, arg_max(price, date) AS last,
        AVG(CASE WHEN step > 1 THEN price END) AS avg_price
  FROM (SELECT *, strftime(date, '%Y-%m') AS month, ROW_NUMBER() OVER (PARTITION BY ticker, strftime(date, '%Y-%m') ORDER BY date) AS step FROM prices_v)
  GROUP BY ticker, month)"""))
def path_payoffs(spark, d):
    monthly = views.prices(spark, d).withColumn("month", F.date_format("date", "yyyy-MM"))
    return round_all(risk.path_payoffs(monthly, ["ticker", "month"]), "last_price", "average_price", "barrier_payoff", "average_payoff")


@R.query("a12_mean_and_error", """
SELECT o_orderpriority, COUNT(o_totalprice) AS n, ROUND(AVG(o_totalprice), 4) AS mean, ROUND(stddev_samp(o_totalprice) / sqrt(COUNT(*)), 4) AS std_error
FROM orders GROUP BY o_orderpriority""")
def mean_and_error(spark, d):
    return round_all(risk.mean_and_error(views.table(spark, d, "orders"), "o_orderpriority", "o_totalprice"), "mean", "std_error", digits=4)


@R.query("a13_paired_mean_and_error", """
SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(p), 4) AS mean, ROUND(stddev_samp(p) / sqrt(COUNT(*)), 4) AS std_error
FROM (SELECT l_returnflag, l_orderkey, AVG(l_extendedprice) AS p FROM lineitem GROUP BY ALL) GROUP BY l_returnflag""")
def paired_mean_and_error(spark, d):
    paired = risk.paired_mean_and_error(views.table(spark, d, "lineitem"), "l_returnflag", "l_orderkey", "l_extendedprice")
    return round_all(paired, "mean", "std_error", digits=4)


@R.query("a14_control_variate", """
SELECT l_returnflag, COUNT(*) AS n, ROUND(MIN(b), 4) AS beta, ROUND(AVG(y - b * (x - 25.5e0)), 4) AS mean,
       ROUND(stddev_samp(y - b * (x - 25.5e0)) / sqrt(COUNT(*)), 4) AS std_error
FROM (SELECT l_returnflag, l_extendedprice AS y, l_quantity AS x FROM lineitem)
JOIN (SELECT l_returnflag, covar_samp(l_extendedprice, l_quantity) / var_samp(l_quantity) AS b FROM lineitem GROUP BY 1) USING (l_returnflag)
GROUP BY l_returnflag""")
def control_variate(spark, d):
    adjusted = risk.control_variate(views.table(spark, d, "lineitem"), "l_returnflag", "l_extendedprice", "l_quantity", 25.5)
    return round_all(adjusted, "beta", "mean", "std_error", digits=4)


@R.query("a15_mergeable_moments", """
SELECT l_returnflag, COUNT(*) AS n, ROUND(AVG(l_quantity), 6) AS mean, ROUND(sqrt(var_pop(l_quantity) / COUNT(*)), 6) AS std_error
FROM lineitem GROUP BY l_returnflag""")
def mergeable_moments(spark, d):
    parts = risk.partial_moments(views.table(spark, d, "lineitem"), ["l_returnflag", "l_suppkey"], "l_quantity")
    return round_all(risk.merge_moments(parts, "l_returnflag"), "mean", "std_error")


@R.query("a36_estimate_spread", """
SELECT o_orderpriority, COUNT(*) AS n_runs, ROUND(stddev_samp(m), 4) AS spread FROM (
  SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS run, AVG(o_totalprice) AS m FROM orders GROUP BY ALL) GROUP BY o_orderpriority""")
def estimate_spread(spark, d):
    runs = views.table(spark, d, "orders").withColumn("run", F.date_format("o_orderdate", "yyyy-MM"))
    return round_all(risk.estimate_spread(runs, "o_orderpriority", "run", "o_totalprice"), "spread", digits=4)
