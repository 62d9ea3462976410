import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models, series
from tidemark.sources import readers, schemas, sinks


@pytest.fixture(scope="module")
def customers(spark):
    rng = np.random.default_rng(0)
    n = 600
    frequency = rng.integers(0, 12, n)
    churned = np.where(frequency == 0, np.nan, (rng.random(n) < 1 / (1 + np.exp(frequency - 4))).astype(float))
    pdf = pd.DataFrame({
        "customer_id": [f"CUST{i:06d}" for i in range(n)], "country": rng.choice(["SG", "MY", "TH"], n), "segment": rng.choice(["a", "b"], n),
        "age_group": rng.choice(["x", "y", "z"], n), "tenure_days": rng.integers(1, 900, n), "frequency": frequency, "monetary_sgd": frequency * 10.0,
        "avg_basket_sgd": 10.0, "categories_purchased": np.minimum(frequency, 4), "recency_days": rng.integers(0, 300, n)})
    df = spark.createDataFrame(pdf)
    labels = spark.createDataFrame([(i, None if math.isnan(c) else int(c)) for i, c in zip(pdf.customer_id, churned)], "customer_id string, churned int")
    return df.join(labels, "customer_id").cache()


@pytest.fixture(scope="module")
def fitted(customers):
    known = customers.where("churned is not null")
    train, test = models.stratified_split(known, "churned", "customer_id")
    return train, test, models.fit_churn(train, numTrees=30)


def test_split_is_exact_and_independent_of_partitioning(customers, fitted):
    train, test, _ = fitted
    known = customers.where("churned is not null")
    sizes = {r.churned: r["count"] for r in known.groupBy("churned").count().collect()}
    got = {r.churned: r["count"] for r in test.groupBy("churned").count().collect()}
    assert got == {c: int(n * 0.2 + 0.5) for c, n in sizes.items()}
    assert train.count() + test.count() == known.count()
    again = models.stratified_split(known.repartition(13), "churned", "customer_id", rows_per_bin=20)[1]
    assert {r.customer_id for r in again.collect()} == {r.customer_id for r in test.collect()}


def test_balanced_weights(customers):
    rows = models.balanced_weights(customers.where("churned is not null")).groupBy("churned").agg(F.sum("class_weight").alias("w")).collect()
    assert rows[0].w == pytest.approx(rows[1].w)


def test_scores_cover_every_row_and_rank_well(customers, fitted):
    _, test, model = fitted
    scored = models.score_customers(model, customers)
    assert scored.count() == customers.count() and scored.where("churn_probability is null or churn_risk_band is null").count() == 0
    assert scored.where("churn_probability != round(churn_probability, 4)").count() == 0
    assert evaluation.roc_auc(models.score_customers(model, test), "churned", "churn_probability").first()[0] > 0.6


def test_unseen_category_is_scored(spark, customers, fitted):
    odd = customers.limit(5).withColumn("country", F.lit("XX"))
    assert models.score_customers(fitted[2], odd).where("churn_probability is null").count() == 0


def test_importance(fitted):
    rows = models.feature_importance(fitted[2]).collect()
    assert sum(r.importance for r in rows) == pytest.approx(1.0)
    assert {r.feature for r in rows} >= {"frequency", "country_SG", "age_group_z"} and len(rows) == 5 + 3 + 2 + 3
    assert [r.importance for r in rows] == sorted((r.importance for r in rows), reverse=True)


def test_label_defining_column_is_refused():
    with pytest.raises(ValueError, match="recency_days"):
        models.churn_pipeline(numeric=models.NUMERIC + ["recency_days"])
    assert not models.LABEL_DEFINING & set(models.NUMERIC + models.CATEGORICAL)


def test_auc_and_report(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 400), np.round(rng.random(400), 1)
    df = spark.createDataFrame(pd.DataFrame({"y": y, "s": s}))
    pairs = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    for rows_per_bin in (3, 10_000):
        assert evaluation.roc_auc(df, "y", "s", rows_per_bin).first()[0] == pytest.approx(np.mean(pairs))
    report = {r["class"]: r for r in evaluation.class_report(df, "y", "s").collect()}
    p = s > 0.5
    for c in (0, 1):
        tp = ((p == c) & (y == c)).sum()
        assert report[c].precision == pytest.approx(tp / (p == c).sum()) and report[c].recall == pytest.approx(tp / (y == c).sum())
        assert report[c].f1 == pytest.approx(2 * tp / ((p == c).sum() + (y == c).sum()))
    fit = spark.createDataFrame(pd.DataFrame({"t": s, "p": s * 0.5}))
    assert evaluation.r_squared(fit, "t", "p").first().r_squared == pytest.approx(1 - ((s * 0.5) ** 2).sum() / ((s - s.mean()) ** 2).sum())


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    days = [dt.date(2021, 1, 1) + dt.timedelta(days=i) for i in range(90)]
    pdf = pd.DataFrame([(d, t) for d in days for t in "ABC"], columns=["date", "ticker"])
    for c in series.FACTOR_COLUMNS:
        pdf[c] = rng.normal(size=len(pdf))
    pdf["forward_return_5d"] = 0.5 * pdf["mom_21"] + 0.1 * rng.normal(size=len(pdf))
    return spark.createDataFrame(pdf)


def test_signal_comparison(panel):
    rows = models.compare_signals(panel, maxIter=15, stepSize=0.3).collect()
    assert len(rows) == 2 and all(-1 <= r.ic <= 1 and 0 <= r.ic_p_value <= 1 for r in rows)
    assert rows[1].ic > 0.8 and rows[1].long_short_sharpe > 0


def test_contributions(panel, spark):
    pdf = panel.toPandas()
    betas = {"mom_21": 2.0, "vol_21": -1.0}
    got = {r.feature: r for r in models.linear_contributions(panel, betas, panel.where("ticker = 'A'")).collect()}
    mu = pdf[pdf.ticker == "A"]["vol_21"].mean()
    part = -(pdf["vol_21"] - mu)
    assert got["vol_21"].mean_abs == pytest.approx(part.abs().mean())
    assert got["vol_21"].direction == ("increases" if part.mean() > 0 else "decreases")
    model = models.fit_return_model(panel, maxIter=10, stepSize=0.3)
    rows = models.permutation_contributions(model, panel.withColumn("row_id", F.concat_ws(":", "date", "ticker")), series.FACTOR_COLUMNS, "row_id").collect()
    assert rows[0].feature == "mom_21" and rows[0].mean_abs > 5 * rows[1].mean_abs


def test_volatility_model_runs(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame(rng.random((120, 6)), columns=series.VOLATILITY_COLUMNS + ["forward_vol_21"])
    model = models.fit_volatility_model(spark.createDataFrame(pdf), maxIter=5)
    assert model.transform(spark.createDataFrame(pdf)).where("prediction is null").count() == 0


def test_model_save_and_load(customers, fitted, tmp_path):
    sinks.save_model(fitted[2], str(tmp_path / "m"))
    a = models.score_customers(fitted[2], customers).select("customer_id", "churn_probability").collect()
    b = models.score_customers(sinks.load_model(str(tmp_path / "m")), customers).select("customer_id", "churn_probability").collect()
    assert sorted(a) == sorted(b)


def test_csv_and_json_sources(spark, tmp_path):
    (tmp_path / "customers.csv").write_text("customer_id,customer_name,signup_date,country,segment,age_group\nC1,Ann,2024-01-02,SG,a,18-25\n")
    (tmp_path / "transactions.csv").write_text("transaction_id,customer_id,transaction_date,category,channel,amount_sgd\nT1,C1,2024-02-03,x,web,9.5\nT2,C1,,x,web,\n")
    customers, transactions = readers.read_raw_tables(spark, str(tmp_path))
    assert customers.first().signup_date == dt.date(2024, 1, 2)
    assert [(r.transaction_date, r.amount_sgd) for r in transactions.collect()] == [(dt.date(2024, 2, 3), 9.5), (None, None)]
    (tmp_path / "q.json").write_text('[{"id": 1, "question": "a", "expected_source": null, "expected_keywords": ["x"], "in_scope": false, "note": "n"},\n {"id": 2, "question": "b", "in_scope": true}]')
    rows = readers.read_json_array(spark, str(tmp_path / "q.json"), schemas.RETRIEVAL_QUESTIONS).orderBy("id").collect()
    assert rows[0].expected_keywords == ["x"] and rows[0].note == "n" and rows[1].expected_keywords is None and rows[1].in_scope
    (tmp_path / "m.json").write_text('{\n "accuracy": 0.7446, "roc_auc": 0.7769, "n_train": 4776\n}')
    assert readers.read_json_array(spark, str(tmp_path / "m.json"), schemas.METRICS).first().n_train == 4776


def test_wrong_header_is_refused(spark, tmp_path):
    (tmp_path / "x.csv").write_text("id,amount\n1,2\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, str(tmp_path / "x.csv"), "customer_id string, amount double").collect()


def test_markdown_and_charts(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        (tmp_path / "none").mkdir()
        readers.read_markdown_folder(spark, str(tmp_path / "none"))
    (tmp_path / "leave.md").write_text("# Leave\n\ntext\n")
    (tmp_path / "other.txt").write_text("x")
    assert [tuple(r) for r in readers.read_markdown_folder(spark, str(tmp_path)).collect()] == [("leave.md", "# Leave\n\ntext\n")]
    (tmp_path / "c.json").write_text('{"chart": {"result": [{"meta": {"symbol": "SPY"}, "timestamp": [1609770600, 1609857000], "indicators": {"adjclose": [{"adjclose": [1.5, null]}]}}]}}')
    assert [tuple(r) for r in readers.read_charts(spark, str(tmp_path / "c.json")).collect()] == [(dt.date(2021, 1, 4), "SPY", 1.5)]


def test_partitioned_sink_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "p")
    sinks.write_partitioned(spark.createDataFrame([(1, "a"), (2, "b")], "x int, country string"), path, "country")
    sinks.write_partitioned(spark.createDataFrame([(3, "b")], "x int, country string"), path, "country")
    assert sorted((r.x, r.country) for r in spark.read.parquet(path).collect()) == [(1, "a"), (3, "b")]
    plan = spark.read.parquet(path).where("country = 'a'")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(country" in plan


def test_reports(spark, tmp_path):
    sinks.write_evaluation(spark.createDataFrame([(1, None)], "n int, rate double"), spark.createDataFrame([(1,), (2,)], "id int"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r/questions")).count() == 2
    assert spark.read.text(str(tmp_path / "r/summary")).first()[0] == '{"n":1,"rate":null}'


def test_node_tables_give_the_models_predictions(spark, tmp_path):
    rng = np.random.default_rng(4)
    n = 400
    pdf = pd.DataFrame({
        "id": np.arange(n), "tenure_days": rng.integers(1, 900, n).astype(float), "frequency": rng.integers(0, 9, n).astype(float), "monetary_sgd": rng.normal(50, 20, n),
        "avg_basket_sgd": rng.normal(5, 2, n), "categories_purchased": rng.integers(0, 5, n).astype(float), "country": rng.choice(list("abcd"), n), "segment": rng.choice(list("xy"), n)})
    pdf["churned"] = ((pdf["frequency"] < 3) ^ (pdf["country"] == "a")).astype(int)
    df = spark.createDataFrame(pdf).withColumn("tenure_days", F.when(F.col("id") % 51 != 0, F.col("tenure_days")))
    model = models.fit_churn(df.where("id % 3 > 0"), categorical=["country", "segment"], numTrees=7, maxDepth=5, minInstancesPerNode=3)
    rows = model.transform(df).select("id", vector_to_array("features").alias("v"), vector_to_array("probability")[1].alias("p"))
    nodes = models.node_table(model.stages[-1], str(tmp_path / "forest"))
    assert nodes.where("categories is not null").count() > 0 and nodes.where("threshold is not null").count() > 0
    both = rows.join(models.forest_probability(rows, nodes, "id", "v", 5), "id").toPandas()
    assert len(both) == n and np.allclose(both["p"], both["probability"], atol=1e-12)
    assembled = VectorAssembler(inputCols=["frequency", "monetary_sgd"], outputCol="features").transform(df)
    boosted = GBTRegressor(featuresCol="features", labelCol="avg_basket_sgd", maxIter=6, maxDepth=3, seed=1).fit(assembled)
    rows = boosted.transform(assembled).select("id", vector_to_array("features").alias("v"), F.col("prediction").alias("p"))
    walked = models.boosted_prediction(rows, models.node_table(boosted, str(tmp_path / "boosted")), "id", "v", 3)
    both = rows.join(walked, "id").toPandas()
    assert len(both) == n and np.allclose(both["p"], both["prediction"], atol=1e-12)
