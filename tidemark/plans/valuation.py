"""Revaluation of contract, bond and curve tables."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidemark.functions import bonds, curves, options
from tidemark.functions.normal import chi2_1_upper_tail, norm_cdf, norm_pdf
from tidemark.operators import interpolation
from tidemark.plans import views
from tidemark.plans.market import phi_sql
from tidemark.plans.registry import Registry, round_all, rounded
from tidemark.plans.views import with_views

R = Registry()

N1_SQL = """SELECT o_orderkey, (o_totalprice - 250000e0) / 60000e0 AS z FROM orders"""


@R.query("n1_normal_functions", with_views([], f"""
SELECT o_orderkey, ROUND(exp(-z * z / 2) / sqrt(2 * pi()), 9) AS pdf, ROUND({phi_sql('z')}, 9) AS cdf,
       ROUND(2 * {phi_sql('nz')}, 9) AS chi2_tail FROM (SELECT *, -abs(z) AS nz FROM scores)""", scores=N1_SQL))
def normal_functions(spark, d):
    z = F.col("z")
    scores = views.table(spark, d, "orders").select("o_orderkey", ((F.col("o_totalprice") - 250000.0) / 60000.0).alias("z"))
    return scores.withColumn("z2", z * z).select(
        "o_orderkey",
        rounded(norm_pdf(z), 9).alias("pdf"),
        rounded(norm_cdf(z), 9).alias("cdf"),
        rounded(chi2_1_upper_tail(F.col("z2")), 9).alias("chi2_tail"),
    )


def d_sql(source: str) -> str:
    return f"SELECT *, d1 - sigma * sqrt(t) AS d2 FROM (SELECT *, (ln(s / k) + (r - q + sigma * sigma / 2) * t) / (sigma * sqrt(t)) AS d1 FROM {source})"


def phi_columns(source: str) -> str:
    return f"SELECT *, {phi_sql('d1')} AS n1, {phi_sql('d2')} AS n2 FROM (SELECT * FROM {source})"


PRICE_SQL = """CASE option_type WHEN 'call' THEN s * exp(-q * t) * n1 - k * exp(-r * t) * n2
  ELSE s * exp(-q * t) * (n1 - 1) - k * exp(-r * t) * (n2 - 1) END"""


def with_phi(body: str, source: str = "SELECT * FROM contracts_v", views_used: str = "contracts_v") -> str:
    return with_views(views_used, body, base=source, dd=d_sql("base"), priced=phi_columns("dd"))


@R.query("n2_option_price", with_phi(f"SELECT contract_id, ROUND({PRICE_SQL}, 6) + 0e0 AS price FROM priced"))
def option_price(spark, d):
    return round_all(options.black_scholes_price(views.contracts(spark, d)), "price").select("contract_id", "price")


GREEKS = ["price", "delta", "gamma", "vega", "theta", "rho"]


@R.query("n3_option_greeks", with_phi(f"""
SELECT contract_id, ROUND({PRICE_SQL}, 6) + 0e0 AS price, ROUND(exp(-q * t) * (n1 - c), 6) + 0e0 AS delta, ROUND(exp(-q * t) * p / (s * sigma * sqrt(t)), 6) + 0e0 AS gamma,
  ROUND(s * exp(-q * t) * p * sqrt(t), 6) + 0e0 AS vega,
  ROUND(-s * exp(-q * t) * p * sigma / (2 * sqrt(t)) - r * k * exp(-r * t) * (n2 - c) + q * s * exp(-q * t) * (n1 - c), 6) + 0e0 AS theta,
  ROUND(k * t * exp(-r * t) * (n2 - c), 6) + 0e0 AS rho
FROM (SELECT *, CASE option_type WHEN 'call' THEN 0 ELSE 1 END AS c, exp(-d1 * d1 / 2) / sqrt(2 * pi()) AS p FROM priced)"""))
def option_greeks(spark, d):
    return round_all(options.black_scholes_greeks(views.contracts(spark, d)), *GREEKS).select("contract_id", *GREEKS)


@R.query("n4_implied_volatility", with_phi(f"""
SELECT contract_id, price > greatest(CASE option_type WHEN 'call' THEN s - k ELSE k - s END, 0) * exp(-r * t) + 1e-10 AS solved,
  ROUND(CASE WHEN price > greatest(CASE option_type WHEN 'call' THEN s - k ELSE k - s END, 0) * exp(-r * t) + 1e-10 THEN price END, 5) AS repriced
FROM (SELECT *, {PRICE_SQL} AS price FROM priced)""", "SELECT * REPLACE (0e0 AS q) FROM contracts_v"))
def implied_volatility(spark, d):
    """Invert the price of every contract, then price it again at the volatility found."""
    quotes = options.black_scholes_price(views.contracts(spark, d).withColumn("q", F.lit(0.0)))
    solved = options.implied_volatility(quotes).withColumn("sigma", F.col("implied_vol"))
    repriced = options.black_scholes_price(solved, "repriced")
    return repriced.select("contract_id", F.col("implied_vol").isNotNull().alias("solved"), rounded("repriced", 5).alias("repriced"))


JUMPS = {"intensity": 0.75, "jump_mean": -0.05, "jump_vol": 0.2}
JUMP_DRIFT = JUMPS["jump_mean"] + 0.5 * JUMPS["jump_vol"] ** 2
JUMP_GROWTH = math.exp(JUMP_DRIFT) - 1


def jump_source(source: str) -> str:
    lam, g, m, v = JUMPS["intensity"], JUMP_GROWTH, JUMP_DRIFT, JUMPS["jump_vol"]
    return f"""SELECT c.* REPLACE (r - {lam} * {g!r} + n * ({m!r}) / t AS r, sqrt(sigma * sigma + n * {v} * {v} / t) AS sigma, 0e0 AS q),
      exp(-{lam} * {1 + g!r} * t + n * ln({lam} * {1 + g!r} * t) - lgamma(n + 1)) AS weight FROM ({source}) c, range(0, 40) x(n)"""


@R.query("n5_jump_diffusion_price", with_phi(
    f"SELECT contract_id, ROUND(SUM(weight * ({PRICE_SQL})), 6) AS price FROM priced GROUP BY contract_id",
    jump_source("SELECT * FROM contracts_v")))
def jump_diffusion_price(spark, d):
    priced = options.jump_diffusion_price(views.contracts(spark, d), **JUMPS)
    return priced.select("contract_id", rounded("price").alias("price"))


SMILE = [0.8, 0.9, 1.0, 1.1, 1.2]


@R.query("n6_jump_smile")
def jump_smile(spark, d):
    smile = options.jump_smile(views.contracts(spark, d), SMILE, **JUMPS)
    return round_all(smile.select("contract_id", "k", "price", "implied_vol"), "k", "price", "implied_vol")


@R.query("n6_smile_prices", with_phi(
    f"SELECT contract_id, ROUND(k / s, 6) AS moneyness, ROUND(SUM(weight * ({PRICE_SQL})), 6) AS price FROM priced GROUP BY contract_id, ROUND(k / s, 6)",
    jump_source("SELECT b.* REPLACE (s * m AS k) FROM contracts_v b, (VALUES (0.8e0), (0.9e0), (1e0), (1.1e0), (1.2e0)) g(m)")))
def smile_prices(spark, d):
    smile = options.jump_smile(views.contracts(spark, d), SMILE, **JUMPS)
    return smile.select("contract_id", rounded(F.col("k") / F.col("s")).alias("moneyness"), rounded("price").alias("price"))


def short_rate_inputs(spark, d):
    """Start rate, reversion speed and maturity read off the line items; some speeds are zero."""
    key = F.col("l_linenumber")
    return views.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        F.col("l_tax").alias("r0"),
        ((key - 1) / F.lit(4.0)).alias("kappa"),
        (F.col("l_discount") + 0.01).alias("theta"),
        (F.col("l_quantity") / 5.0).alias("t"),
    )


@R.query("n7_zero_bond_price", """
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(p, 6) AS price, ROUND(-ln(p) / t, 6) + 0e0 AS yield FROM (
  SELECT *, CASE WHEN kappa = 0 THEN exp(-theta * t * t / 2 + 4e-4 * t * t * t / 6 - t * r0)
    ELSE exp((theta - 4e-4 / (2 * kappa * kappa)) * (b - t) - 4e-4 / (4 * kappa) * b * b - b * r0) END AS p
  FROM (SELECT *, CASE WHEN kappa = 0 THEN t ELSE (1 - exp(-kappa * t)) / kappa END AS b FROM (
    SELECT l_orderkey, l_linenumber, l_partkey, l_tax AS r0, (l_linenumber - 1) / 4e0 AS kappa, l_discount + 0.01e0 AS theta, l_quantity / 5e0 AS t FROM lineitem)))""")
def zero_bond_price(spark, d):
    t = F.col("t")
    priced = short_rate_inputs(spark, d).withColumn(
        "p", bonds.zero_bond_price(F.col("r0"), t, F.col("kappa"), F.col("theta"), F.lit(0.02))
    )
    return priced.select(
        "l_orderkey", "l_linenumber", "l_partkey",
        rounded("p").alias("price"), rounded(bonds.zero_bond_yield(F.col("p"), t)).alias("yield"),
    )


FLOWS_SQL = """SELECT b.*, i / CAST(freq AS DOUBLE) AS u, (face * coupon_rate / freq + CASE WHEN i = years * freq THEN face ELSE 0 END) / pow(1 + ytm / freq, i) AS pv
FROM (SELECT *, unnest(range(1, years * freq + 1)) AS i FROM bonds_v) b"""


@R.query("n8_bond_price", with_views("bonds_v", "SELECT bond_id, ROUND(SUM(pv), 6) AS price FROM flows GROUP BY bond_id", flows=FLOWS_SQL))
def bond_price(spark, d):
    return views.bonds(spark, d).select("bond_id", rounded(bonds.bond_price(F.col("ytm"))).alias("price"))


METRICS = ["price", "macaulay_duration", "modified_duration", "convexity"]
METRICS_SQL = """SELECT bond_id, SUM(pv) AS price, SUM(u * pv) / SUM(pv) AS macaulay_duration, SUM(u * pv) / SUM(pv) / (1 + ANY_VALUE(ytm / freq)) AS modified_duration,
  SUM(pv * u * (u + 1 / CAST(freq AS DOUBLE))) / (SUM(pv) * pow(1 + ANY_VALUE(ytm / freq), 2)) AS convexity FROM flows GROUP BY bond_id"""


@R.query("n9_bond_risk_metrics", with_views("bonds_v", f"SELECT bond_id, {', '.join(f'ROUND({m}, 6) AS {m}' for m in METRICS)} FROM metrics", flows=FLOWS_SQL, metrics=METRICS_SQL))
def bond_risk_metrics(spark, d):
    return round_all(bonds.bond_risk_metrics(views.bonds(spark, d)), *METRICS).select("bond_id", *METRICS)


SHOCKS = [-0.02, -0.01, -0.005, 0.005, 0.01, 0.02]


@R.query("n10_shock_grid", with_views("bonds_v", """
SELECT bond_id, shock, ROUND(price * (-modified_duration * shock + 0.5 * convexity * shock * shock), 6) AS estimated_change, ROUND(exact, 6) AS exact_change
FROM metrics JOIN (SELECT bond_id, shock, SUM((face * coupon_rate / freq + CASE WHEN i = years * freq THEN face ELSE 0 END) / pow(1 + (ytm + shock) / freq, i)) - ANY_VALUE(p) AS exact
  FROM (SELECT bond_id AS id, price AS p FROM metrics) m JOIN (SELECT *, unnest(range(1, years * freq + 1)) AS i FROM bonds_v) b ON b.bond_id = m.id,
       (VALUES (-0.02e0), (-0.01e0), (-0.005e0), (0.005e0), (0.01e0), (0.02e0)) g(shock) GROUP BY bond_id, shock) USING (bond_id)""", flows=FLOWS_SQL, metrics=METRICS_SQL))
def shock_grid(spark, d):
    return round_all(bonds.shock_grid(views.bonds(spark, d), SHOCKS), "estimated_change", "exact_change").select(
        "bond_id", "shock", "estimated_change", "exact_change"
    )


@R.query("j8_scenario_grid", with_phi(f"""
SELECT contract_id, spot_shift, ROUND({PRICE_SQL}, 6) + 0e0 AS price FROM priced""",
    "SELECT c.* REPLACE (s * (1 + g.x) AS s), g.x AS spot_shift FROM contracts_v c, (VALUES (-0.2e0), (-0.1e0), (0e0), (0.1e0), (0.2e0)) g(x)"))
def scenario_grid(spark, d):
    shifts = F.array(*[F.lit(x) for x in (-0.2, -0.1, 0.0, 0.1, 0.2)])
    grid = views.contracts(spark, d).withColumn("spot_shift", F.explode(shifts)).withColumn("s", F.col("s") * (1 + F.col("spot_shift")))
    return options.black_scholes_price(grid).select("contract_id", "spot_shift", rounded("price").alias("price"))


@R.query("n11_bootstrap_zero_curves")
def bootstrap(spark, d):
    nodes = curves.bootstrap_zero_curves(views.curve_quotes(spark, d), "curve_id").select("curve_id", F.explode("nodes").alias("p"))
    return nodes.select("curve_id", "p.t", rounded("p.z").alias("z"))


@R.query("n11_par_reprice", with_views("curve_quotes_v", "SELECT curve_id, t, 100e0 AS repriced FROM curve_quotes_v"))
def par_reprice(spark, d):
    """Every quote, repriced on the zero nodes known when it was solved plus its own, is worth 100: coupons, or the one payment of a short quote."""
    quotes = views.curve_quotes(spark, d)
    zero = curves.bootstrap_zero_curves(quotes, "curve_id")
    joined = quotes.join(zero, "curve_id")
    short = (F.col("freq") == 1) & (F.col("t") <= 1)
    known = F.filter("nodes", lambda p: p["t"] < F.col("t"))
    own = F.filter("nodes", lambda p: p["t"] == F.col("t"))
    coupon = F.col("par_yield") * 100.0 / F.col("freq")
    periods = F.round(F.col("t") * F.col("freq")).cast("int")
    earlier = F.when(periods > 1, F.sequence(F.lit(1), periods - 1)).otherwise(F.array().cast("array<int>"))
    coupons = F.aggregate(
        F.transform(earlier, lambda k: coupon * curves.discount_factor(known, k / F.col("freq"))),
        F.lit(0.0), lambda a, x: a + x,
    ) + (coupon + 100.0) * curves.discount_factor(own, F.col("t"))
    once = (F.col("par_yield") * F.col("t") + 1.0) * 100.0 * curves.discount_factor(own, F.col("t"))
    return joined.select("curve_id", "t", rounded(F.when(short, once).otherwise(coupons)).alias("repriced"))


def line_flows(spark, d):
    """Every line item as a cash flow due at its ship date, on its supplier's curve."""
    due = F.datediff(F.to_date("l_shipdate"), F.lit("1995-01-01").cast("date")) / 365.25
    items = views.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return views.spread(items, "l_orderkey").select(
        "l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("curve_id"), F.col("l_extendedprice").alias("amount"), due.alias("t")
    )


RATED_SQL = """
SELECT f.*, COALESCE(CASE WHEN hi.t > lo.t THEN lo.par_yield + (hi.par_yield - lo.par_yield) * (f.t - lo.t) / (hi.t - lo.t) END, lo.par_yield, hi.par_yield) AS z
FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey AS curve_id, l_extendedprice AS amount, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 365.25e0 AS t,
        row_number() OVER () AS id FROM lineitem) f
ASOF LEFT JOIN curve_quotes_v lo ON lo.curve_id = f.curve_id AND f.t >= lo.t
ASOF LEFT JOIN curve_quotes_v hi ON hi.curve_id = f.curve_id AND f.t <= hi.t"""


@R.query("j6_interpolated_rate", with_views("curve_quotes_v", "SELECT l_orderkey, l_linenumber, l_partkey, curve_id, ROUND(z, 6) AS zero_rate FROM rated", rated=RATED_SQL))
def interpolated_rate(spark, d):
    nodes = curves.curve_nodes(views.curve_quotes(spark, d), "curve_id", z="par_yield")
    flows = curves.discount_flows(line_flows(spark, d), nodes, "curve_id")
    return flows.select("l_orderkey", "l_linenumber", "l_partkey", "curve_id", rounded("zero_rate").alias("zero_rate"))


@R.query("j6_interpolated_rate_ranged", with_views("curve_quotes_v", "SELECT l_orderkey, l_linenumber, l_partkey, curve_id, ROUND(z, 6) AS zero_rate FROM rated", rated=RATED_SQL))
def interpolated_rate_ranged(spark, d):
    """The same rates when no curve is held whole: nodes and times dealt out in parts of 2000 rows."""
    rated = interpolation.interpolated_rates(line_flows(spark, d), views.curve_quotes(spark, d), "curve_id", z="par_yield", out="zero_rate", rows_per_bin=2000)
    return rated.select("l_orderkey", "l_linenumber", "l_partkey", "curve_id", rounded("zero_rate").alias("zero_rate"))


@R.query("n12_discount_factor", with_views("curve_quotes_v", """
SELECT l_orderkey, l_linenumber, l_partkey, ROUND(exp(-z * t), 6) AS discount_factor, ROUND(amount * exp(-z * t), 4) AS present_value FROM rated""", rated=RATED_SQL))
def discount_factor(spark, d):
    nodes = curves.curve_nodes(views.curve_quotes(spark, d), "curve_id", z="par_yield")
    flows = curves.discount_flows(line_flows(spark, d), nodes, "curve_id")
    return flows.select(
        "l_orderkey", "l_linenumber", "l_partkey", rounded("discount_factor").alias("discount_factor"),
        rounded(F.col("amount") * F.col("discount_factor"), 4).alias("present_value"),
    )
