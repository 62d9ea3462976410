import math

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tidemark.functions import bonds, curves, options
from tidemark.operators import interpolation

BASE = {"s": 100.0, "k": 100.0, "t": 1.0, "r": 0.05, "sigma": 0.2, "q": 0.0, "option_type": "call"}


def contracts(spark, *changes):
    rows = [{**BASE, **c, "contract_id": i} for i, c in enumerate(changes)]
    return spark.createDataFrame(pd.DataFrame(rows))


def phi(x):
    return 0.5 * math.erfc(-x / math.sqrt(2))


def closed_form(s, k, t, r, sigma, q, option_type, **_):
    d1 = (math.log(s / k) + (r - q + sigma**2 / 2) * t) / (sigma * math.sqrt(t))
    d2 = d1 - sigma * math.sqrt(t)
    if option_type == "call":
        return s * math.exp(-q * t) * phi(d1) - k * math.exp(-r * t) * phi(d2)
    return k * math.exp(-r * t) * phi(-d2) - s * math.exp(-q * t) * phi(-d1)


def prices(df):
    return [r.price for r in options.black_scholes_price(df).orderBy("contract_id").collect()]


def test_known_prices_and_parity(spark):
    cases = [
        {"s": 42.0, "k": 40.0, "t": 0.5, "r": 0.1}, {"s": 42.0, "k": 40.0, "t": 0.5, "r": 0.1, "option_type": "put"},
        {"q": 0.03}, {"q": 0.03, "option_type": "put"}, {"k": 150.0, "option_type": "put", "t": 3.0},
    ]
    got = prices(contracts(spark, *cases))
    assert got[0] == pytest.approx(4.76, abs=0.01) and got[1] == pytest.approx(0.81, abs=0.01)
    assert got == pytest.approx([closed_form(**{**BASE, **c}) for c in cases], abs=1e-12)
    assert got[2] - got[3] == pytest.approx(100 * math.exp(-0.03) - 100 * math.exp(-0.05))


def test_expired_contracts_are_worth_intrinsic(spark):
    got = prices(contracts(spark, {"t": 0.0, "s": 110.0}, {"t": 0.0, "s": 110.0, "option_type": "put"}, {"t": -1.0, "s": 90.0, "option_type": "put"}))
    assert got == [10.0, 0.0, 10.0]


def test_unknown_option_type_fails(spark):
    with pytest.raises(PySparkException, match="option_type"):
        prices(contracts(spark, {"option_type": "straddle"}))


@pytest.mark.parametrize("kind", ["call", "put"])
def test_greeks_match_finite_differences(spark, kind):
    base = {**BASE, "k": 105.0, "q": 0.02, "option_type": kind}
    g = options.black_scholes_greeks(contracts(spark, base)).first()
    bump = lambda name, h: closed_form(**{**base, name: base[name] + h})
    first = lambda name, h: (bump(name, h) - bump(name, -h)) / (2 * h)
    assert g.price == pytest.approx(closed_form(**base))
    assert g.delta == pytest.approx(first("s", 1e-4), abs=1e-6)
    assert g.gamma == pytest.approx((bump("s", 1e-2) - 2 * closed_form(**base) + bump("s", -1e-2)) / 1e-4, abs=1e-5)
    assert g.vega == pytest.approx(first("sigma", 1e-5), abs=1e-5)
    assert g.theta == pytest.approx(-first("t", 1e-5), abs=1e-5)
    assert g.rho == pytest.approx(first("r", 1e-5), abs=1e-5)


def test_implied_volatility_round_trip(spark):
    sigmas = [0.05, 0.2, 0.8, 2.5]
    df = contracts(spark, *[{"sigma": v, "option_type": k} for v in sigmas for k in ("call", "put")])
    solved = options.implied_volatility(options.black_scholes_price(df)).toPandas()
    assert np.allclose(solved["implied_vol"], solved["sigma"], atol=1e-6)


def test_implied_volatility_outside_bounds_is_null(spark):
    quotes = contracts(spark, {"s": 150.0}, {}, {}).withColumn("price", F.when(F.col("contract_id") == 0, 1.0).when(F.col("contract_id") == 1, 99.9999).otherwise(10.0))
    got = [r.implied_vol for r in options.implied_volatility(quotes).orderBy("contract_id").collect()]
    assert got[0] is None and got[1] is None and got[2] is not None


def test_no_jumps_is_the_plain_price(spark):
    df = contracts(spark, {}, {"k": 80.0, "option_type": "put"}, {"t": 0.1})
    jump = options.jump_diffusion_price(df, 0.0, -0.1, 0.3).orderBy("contract_id").toPandas()["price"]
    assert np.allclose(jump, prices(df), atol=1e-10)


def test_jumps_raise_the_price_and_keep_parity(spark):
    df = contracts(spark, {}, {"option_type": "put"})
    call, put = options.jump_diffusion_price(df, 1.5, -0.1, 0.3).orderBy("contract_id").toPandas()["price"]
    assert call > prices(df)[0] and call - put == pytest.approx(100 - 100 * math.exp(-0.05), abs=1e-6)


def test_smile_shape(spark):
    smile = options.jump_smile(contracts(spark, {"t": 0.25}), [0.8, 0.9, 1.0, 1.1, 1.2], 1.0, -0.1, 0.2).orderBy("k").toPandas()
    assert smile["k"].tolist() == pytest.approx([80, 90, 100, 110, 120])
    assert smile["implied_vol"].notna().all() and smile["implied_vol"][0] > smile["implied_vol"][2] > 0.2


def bond_rows(spark, rows):
    return spark.createDataFrame(rows, "face double, coupon_rate double, ytm double, years double, freq int")


def by_cash_flow(face, coupon_rate, ytm, years, freq):
    n = round(years * freq)
    k = np.arange(1, n + 1)
    pv = (face * coupon_rate / freq + np.where(k == n, face, 0)) / (1 + ytm / freq) ** k
    t = k / freq
    mac = (t * pv).sum() / pv.sum()
    return pv.sum(), mac, mac / (1 + ytm / freq), (pv * t * (t + 1 / freq)).sum() / (pv.sum() * (1 + ytm / freq) ** 2)


def test_bond_metrics_against_cash_flows(spark):
    cases = [(100.0, c, y, t, f) for c in (0.0, 0.04, 0.06) for y in (0.0, 1e-9, 1e-5, 0.004, 0.03, 0.07, -0.01) for t in (0.5, 2.0, 20.0) for f in (1, 2) if t * f >= 1]
    got = bonds.bond_risk_metrics(bond_rows(spark, cases)).collect()
    for r in got:
        want = by_cash_flow(r.face, r.coupon_rate, r.ytm, r.years, r.freq)
        assert (r.price, r.macaulay_duration, r.modified_duration, r.convexity) == pytest.approx(want, rel=1e-9)


def test_par_bond_and_shocks(spark):
    par = bond_rows(spark, [(100.0, 0.05, 0.05, 10.0, 2)])
    rows = bonds.shock_grid(par, [-0.03, 0.0001, 0.03]).orderBy("shock").collect()
    assert rows[0].price == pytest.approx(100.0)
    assert rows[1].estimated_change == pytest.approx(rows[1].exact_change, abs=1e-7)
    exact = by_cash_flow(100, 0.05, 0.08, 10, 2)[0] - 100
    assert rows[2].exact_change == pytest.approx(exact) and abs(rows[2].estimated_change - exact) < 0.6


def test_zero_bond(spark):
    df = spark.createDataFrame([(0.03, 5.0, 0.5), (0.03, 5.0, 0.0), (0.03, 5.0, 1e-4), (0.03, 1e-6, 0.5)], "r0 double, t double, kappa double")
    p = bonds.zero_bond_price(F.col("r0"), F.col("t"), F.col("kappa"), F.lit(0.04), F.lit(0.02))
    got = [r[0] for r in df.select(p).collect()]
    kappa, t = 0.5, 5.0
    b = (1 - math.exp(-kappa * t)) / kappa
    a = (0.04 - 0.0004 / (2 * kappa**2)) * (b - t) - 0.0004 / (4 * kappa) * b**2
    assert got[0] == pytest.approx(math.exp(a - b * 0.03), abs=1e-14)
    assert got[1] == pytest.approx(math.exp(-0.04 * 12.5 + 0.0004 * 125 / 6 - 5 * 0.03), abs=1e-14)
    y = df.select(bonds.zero_bond_yield(p, F.col("t"))).collect()[3][0]
    assert y == pytest.approx(0.03, abs=1e-5)


QUOTES = [(0.5, 0.045, 1), (1.0, 0.047, 1), (2.0, 0.049, 2), (3.0, 0.050, 2), (5.0, 0.052, 2), (10.0, 0.053, 2)]


def interpolate(nodes, t):
    return float(np.interp(t, [n[0] for n in nodes], [n[1] for n in nodes]))


def bootstrap(quotes):
    nodes = []
    for t, y, f in sorted(quotes):
        if f == 1 and t <= 1:
            nodes.append((t, math.log(1 + y * t) / t))
            continue
        n, c = round(t * f), 100 * y / f
        known = sum(c * math.exp(-interpolate(nodes, k / f) * k / f) for k in range(1, n))
        nodes.append((n / f, -math.log((100 - known) / (c + 100)) / (n / f)))
    return nodes


def test_bootstrap(spark):
    rows = [(1, *q) for q in reversed(QUOTES)] + [(2, t, y + 0.01, f) for t, y, f in QUOTES] + [(3, 1.0, 0.04, 1)]
    df = spark.createDataFrame(rows, "curve_id int, t double, par_yield double, freq int")
    got = {r.curve_id: [(n.t, n.z) for n in r.nodes] for r in curves.bootstrap_zero_curves(df, "curve_id").collect()}
    for cid, quotes in {1: QUOTES, 2: [(t, y + 0.01, f) for t, y, f in QUOTES], 3: [(1.0, 0.04, 1)]}.items():
        assert np.allclose(got[cid], bootstrap(quotes), atol=1e-12)
    for t, y, f in QUOTES[2:]:  # every quote reprices near par on the finished curve
        c = 100 * y / f
        total = sum(c * math.exp(-interpolate(got[1], k / f) * k / f) for k in range(1, round(t * f) + 1))
        assert total + 100 * math.exp(-interpolate(got[1], t) * t) == pytest.approx(100, abs=0.1)


def test_impossible_quote_fails(spark):
    df = spark.createDataFrame([(1, 1.0, 0.05, 1), (1, 30.0, 2.5, 1)], "curve_id int, t double, par_yield double, freq int")
    with pytest.raises(PySparkException, match="discount factor"):
        curves.bootstrap_zero_curves(df, "curve_id").collect()


def test_flat_ends_and_linear_inside(spark):
    points = spark.createDataFrame([(1, 1.0, 0.02), (1, 3.0, 0.04), (1, 10.0, 0.05)], "c int, t double, z double")
    flows = spark.createDataFrame([(1, x) for x in (0.0, 0.5, 1.0, 2.0, 3.0, 6.5, 10.0, 99.0)], "c int, t double")
    got = curves.discount_flows(flows, curves.curve_nodes(points, "c"), "c").orderBy("t").toPandas()
    want = [0.02, 0.02, 0.02, 0.03, 0.04, 0.045, 0.05, 0.05]
    assert np.allclose(got["zero_rate"], want) and np.allclose(got["discount_factor"], np.exp(-np.array(want) * got["t"]))


@pytest.mark.parametrize("price", [lambda d: options.jump_diffusion_price(d, 1.0, -0.1, 0.2), lambda d: options.implied_volatility(d.withColumn("price", F.lit(5.0)))])
def test_unknown_option_type_is_rejected(spark, price):
    bad = spark.createDataFrame([(100.0, 100.0, 1.0, 0.05, 0.2, "foo")], "s double, k double, t double, r double, sigma double, option_type string")
    with pytest.raises(Exception, match="option_type"):
        price(bad).collect()


def test_expired_jump_contract_is_worth_its_intrinsic_value(spark):
    rows = [(100.0, 90.0, 0.0, 0.05, 0.2, "call"), (100.0, 90.0, 0.0, 0.05, 0.2, "put")]
    df = spark.createDataFrame(rows, "s double, k double, t double, r double, sigma double, option_type string")
    assert sorted(r["price"] for r in options.jump_diffusion_price(df, 1.0, -0.1, 0.2).collect()) == [0.0, 10.0]


@pytest.mark.parametrize("rows_per_bin", [10, 1_000_000])
def test_interpolation_on_curves_of_any_size(spark, rows_per_bin):
    rng = np.random.default_rng(9)
    curves_ = {"long": np.sort(rng.uniform(0, 50, 300)), "short": np.array([1.0, 2.0]), "one": np.array([3.0])}
    rates = {k: rng.normal(0.03, 0.01, len(t)) for k, t in curves_.items()}
    points = spark.createDataFrame([(k, float(t), float(z)) for k in curves_ for t, z in zip(curves_[k], rates[k])], "c string, t double, z double").repartition(4)
    flows = [(i, k, float(t)) for k in curves_ for i, t in enumerate(np.concatenate([rng.uniform(-5, 60, 80), np.full(60, 7.5), curves_[k][:3]]))]
    flows += [(900, "unknown", 1.0), (901, None, 1.0), (902, "long", None)]
    out = interpolation.interpolated_rates(spark.createDataFrame(flows, "i long, c string, t double").repartition(3), points, "c", rows_per_bin=rows_per_bin).collect()
    assert len(out) == len(flows)
    for r in out:
        if r["c"] in curves_ and r["t"] is not None:
            assert r["rate"] == pytest.approx(np.interp(r["t"], curves_[r["c"]], rates[r["c"]]), abs=1e-12)
        else:
            assert r["rate"] is None


def test_small_parts_are_cut_inside_a_task(spark, monkeypatch):
    """Parts of few rows make no tasks of their own, and a curve goes on over parts and tasks."""
    asked = []
    monkeypatch.setattr(interpolation, "TASK_ROWS", 100)
    monkeypatch.setattr(interpolation, "ranged", lambda df, keys, rows, f=interpolation.ranged: asked.append(rows) or f(df, keys, rows))
    t = [0.0, 40.0, 90.0, 300.0]
    z = [0.01, 0.05, 0.02, 0.04]
    points = spark.createDataFrame([(1, *x) for x in zip(t, z)], "c int, t double, z double")
    flows = spark.createDataFrame([(1, float(i) - 20) for i in range(400)], "c int, t double").repartition(3)
    got = interpolation.interpolated_rates(flows, points, "c", rows_per_bin=7).collect()
    assert len(got) == 400 and all(r["rate"] == pytest.approx(np.interp(r["t"], t, z), abs=1e-12) for r in got)
    assert asked == [100]
