import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators import ranking, retail
from tidemark.session import materialize


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one value."""
    rng = np.random.default_rng(1)
    value = np.where(rng.random(1500) < 0.34, 7.0, np.round(rng.normal(0, 20, 1500), 1))
    pdf = pd.DataFrame({"id": np.arange(1500), "value": value})
    return pdf, materialize(spark.createDataFrame(pdf).repartition(7))


@pytest.mark.parametrize("rows_per_bin", [40, 333, 10_000])
def test_global_row_number(skewed, rows_per_bin):
    pdf, df = skewed
    got = ranking.global_row_number(df, ["value", "id"], "rn", rows_per_bin).toPandas().sort_values("rn")
    want = pdf.sort_values(["value", "id"])
    assert list(got["rn"]) == list(range(1, 1501))
    assert list(got["id"]) == list(want["id"])


def test_hot_value_is_split_over_bins(skewed):
    _, df = skewed
    bins = ranking.order_bins(df, ["value", "id"], 40)
    assert sum(bins.sizes) == 1500
    assert max(bins.sizes) < 200  # the hot value alone has about 500 rows


@pytest.mark.parametrize("rows_per_bin", [50, 10_000])
def test_order_statistics(skewed, rows_per_bin):
    pdf, df = skewed
    want = pdf.sort_values(["value", "id"]).reset_index(drop=True)
    ranks = [1, 2, 700, 701, 1499, 1500, 1501]
    got = ranking.order_statistics(df, ["value", "id"], ranks, rows_per_bin)
    assert got == {r: (want.value[r - 1], want.id[r - 1]) for r in ranks if r <= 1500}


@pytest.mark.parametrize("rows_per_bin", [60, 10_000])
def test_exact_quantiles(skewed, rows_per_bin):
    pdf, df = skewed
    fractions = [0.0, 0.01, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = ranking.exact_quantiles(df, "value", "id", fractions, rows_per_bin)
    assert np.allclose(got, np.quantile(pdf.value, fractions), rtol=0, atol=1e-12)


@pytest.mark.parametrize("rows_per_bin", [60, 10_000])
def test_average_rank(skewed, rows_per_bin):
    pdf, df = skewed
    got = ranking.average_rank(df, "value", "r", rows_per_bin).toPandas().sort_values("id")
    assert np.allclose(got["r"], pdf["value"].rank())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 10, 11])
def test_ntile_of_few_rows(spark, n):
    df = spark.range(n).withColumn("k", F.lit(1.0))
    got = df.withColumn("t", ranking.ntile_column(df, ["k", "id"], 4)).orderBy("id").toPandas()["t"].tolist()
    df.createOrReplaceTempView("few")
    want = [r[0] for r in spark.sql("select ntile(4) over (order by k, id) t from few order by id").collect()]
    assert got == want


@pytest.mark.parametrize("rows_per_bin", [90, 10_000])
def test_quartile_scores_with_many_bins(spark, skewed, rows_per_bin):
    _, df = skewed
    features = df.select(
        F.col("id").alias("customer_id"), F.col("value").alias("recency_days"), (F.col("id") % 5).alias("frequency"), F.abs("value").alias("monetary_sgd")
    )
    got = retail.quartile_scores(features, rows_per_bin=rows_per_bin)
    features.createOrReplaceTempView("feat")
    want = spark.sql("""select customer_id, ntile(4) over (order by recency_days, customer_id) a,
        ntile(4) over (order by frequency desc, customer_id) b, ntile(4) over (order by monetary_sgd desc, customer_id) c from feat""")
    columns = ["recency_days_quartile", "frequency_quartile", "monetary_sgd_quartile"]
    g, w = got.toPandas().sort_values("customer_id"), want.toPandas().sort_values("customer_id")
    assert (g[columns].to_numpy() == w[["a", "b", "c"]].to_numpy()).all()


def test_value_quartiles_merge_equal_edges(spark):
    df = spark.createDataFrame([(i, 5.0 if i < 8 else float(i)) for i in range(12)], "id long, x double")
    got = retail.value_quartiles(df, "x", "id", "q").orderBy("id").toPandas()["q"].tolist()
    edges = sorted(set(np.quantile([5.0] * 8 + [8.0, 9.0, 10.0, 11.0], [0, 0.25, 0.5, 0.75, 1])))
    want = [1 + sum(x > e for e in edges[1:-1]) for x in [5.0] * 8 + [8.0, 9.0, 10.0, 11.0]]
    assert got == want


@pytest.mark.parametrize("hot", [10, 100_000])
def test_hot_values_are_joined_apart(skewed, hot):
    pdf, df = skewed
    got = ranking.average_rank(df, "value", "r", 60, hot).toPandas().sort_values("id")
    assert np.allclose(got["r"], pdf["value"].rank())


@pytest.mark.parametrize("held", [10_000, 1])
@pytest.mark.parametrize("fraction", [0.0, 0.37, 1.0])
def test_grouped_quantile(spark, held, fraction):
    rng = np.random.default_rng(2)
    groups = {
        "hot": np.concatenate([rng.normal(0, 1, 700), np.full(400, 0.25)]), "wide": np.array([1e308, -1e308, 0.0, 5e-324, 1e-300, 3.0]), "same": np.full(50, 2.0),
        "one": np.array([1.5]), "two": np.array([1.0, 2.0]), "skewed": 2.0 ** -np.arange(60.0),
    }
    rows = [(g, float(v)) for g, x in groups.items() for v in x] + [("hot", None), ("none", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r["g"]: r["quantile"] for r in ranking.grouped_quantile(df, "g", "v", fraction, held_rows=held).collect()}
    assert set(got) == set(groups)
    for g, x in groups.items():
        x = np.sort(x)
        spot = (len(x) - 1) * fraction
        low, high = x[math.floor(spot)], x[math.ceil(spot)]
        want = low if math.floor(spot) == math.ceil(spot) else (math.ceil(spot) - spot) * low + (spot - math.floor(spot)) * high
        assert got[g] == pytest.approx(want, rel=1e-12, abs=0)
