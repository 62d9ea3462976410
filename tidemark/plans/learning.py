"""Model training, scoring, metrics and explanations."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidemark.operators import evaluation, models, series
from tidemark.plans import views
from tidemark.plans.files import new_folder
from tidemark.plans.market import factor_panel, with_factors
from tidemark.plans.registry import Registry, round_all, rounded
from tidemark.plans.views import MARKET, with_views
from tidemark.session import materialize

R = Registry()
CUTOFF_SQL = "SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) WHERE i = CAST(floor(n * 0.7e0) AS BIGINT)"
CATEGORICAL = ["country", "segment"]


@R.query("f9_feature_subset", with_views("features_v", """
SELECT churned, tenure_days, frequency, monetary_sgd, avg_basket_sgd, categories_purchased, country, segment FROM features_v"""))
def feature_subset(spark, d):
    return views.features(spark, d).select("churned", *models.NUMERIC, *CATEGORICAL)


@R.query("f10_complete_rows", with_factors("SELECT COUNT(*) AS complete_rows, COUNT(DISTINCT date) AS dates FROM panel"))
def complete_rows(spark, d):
    return factor_panel(spark, d).agg(F.count(F.lit(1)).alias("complete_rows"), F.count_distinct("date").alias("dates"))


@R.query("a35_score_metrics", with_views("scored_v metrics_v", """
SELECT (SELECT COUNT(*) FROM scored_v WHERE churned IS NOT NULL) AS n, accuracy, (SELECT ROUND(AVG(churned), 6) FROM scored_v) AS base_rate, roc_auc FROM metrics_v"""))
def score_metrics(spark, d):
    rows = materialize(views.scored(spark, d).select("churned", "churn_probability"))
    auc = evaluation.roc_auc(rows, "churned", "churn_probability").select("roc_auc").scalar()
    return evaluation.accuracy_metrics(rows, "churned", "churn_probability").select(
        "n", rounded("accuracy", 4).alias("accuracy"), rounded("base_rate").alias("base_rate"), rounded(auc, 4).alias("roc_auc")
    )


@R.query("a35_class_report", with_views("scored_v", """
SELECT c AS class, ROUND(tp / pred, 6) AS precision, ROUND(tp / support, 6) AS recall, ROUND(2 * tp / (pred + support), 6) AS f1, support FROM (
  SELECT c, COUNT(*) FILTER (churned = c) AS support, COUNT(*) FILTER (guess = c) AS pred, COUNT(*) FILTER (guess = c AND churned = c) AS tp
  FROM (SELECT churned, CAST(churn_probability > 0.5 AS INTEGER) AS guess FROM scored_v WHERE churned IS NOT NULL), (VALUES (0), (1)) v(c) GROUP BY c)"""))
def class_report(spark, d):
    return round_all(evaluation.class_report(views.scored(spark, d), "churned", "churn_probability"), "precision", "recall", "f1")


@R.query("a35_r_squared", with_views("portfolio_v", """
SELECT COUNT(*) AS n, ROUND(1 - SUM(pow(ret - p, 2)) / (var_pop(ret) * COUNT(*)), 6) AS r_squared
FROM (SELECT ret, -0.5 * LAG(ret) OVER (ORDER BY date) AS p FROM portfolio_v) WHERE p IS NOT NULL"""))
def r_squared(spark, d):
    """Yesterday's return, halved and turned, as a forecast of today's."""
    book = series.equal_weight_returns(series.daily_returns(views.prices(spark, d))).withColumn("book", F.lit("equal_weight"))
    forecast = book.withColumn("p", -0.5 * F.lag("ret").over(series.by_date("book"))).where(F.col("p").isNotNull())
    return round_all(evaluation.r_squared(forecast, "ret", "p"), "r_squared")


@R.query("m1_encoded_features", with_views("features_v", """
SELECT customer_id, c.i AS country_slot, s.i AS segment_slot, CAST(5 + (SELECT COUNT(DISTINCT country) + COUNT(DISTINCT segment) FROM features_v) AS INTEGER) AS width,
       ROUND(COALESCE(f.tenure_days, 0) + f.frequency + f.monetary_sgd + f.avg_basket_sgd + f.categories_purchased + 2e0, 2) AS total
FROM features_v f JOIN (SELECT country, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, country) - 1 AS INTEGER) AS i FROM features_v GROUP BY country) c USING (country)
JOIN (SELECT segment, CAST(ROW_NUMBER() OVER (ORDER BY COUNT(*) DESC, segment) - 1 AS INTEGER) AS i FROM features_v GROUP BY segment) s USING (segment)"""))
def encoded_features(spark, d):
    """Where each category sits in its one-hot block, the vector width, and the sum over the vector's known values."""
    features = materialize(views.features(spark, d).select("customer_id", *models.NUMERIC, *CATEGORICAL))
    encoder = Pipeline(stages=models.churn_pipeline(categorical=CATEGORICAL).getStages()[:-1])
    encoded = encoder.fit(features).transform(features)
    vector = vector_to_array("features")
    slot = lambda c: F.unwrap_udt(f"{c}_onehot")["indices"][0]
    return encoded.select(
        "customer_id", slot("country").alias("country_slot"), slot("segment").alias("segment_slot"), F.size(vector).alias("width"),
        rounded(F.aggregate(vector, F.lit(0.0), lambda a, x: a + F.nanvl(x, F.lit(0.0))), 2).alias("total"),
    )


@R.query("m6_label_leakage", with_views("features_v", """
SELECT ROUND(AVG(CASE WHEN (recency_days > 90) = (churned = 1) THEN 1e0 ELSE 0e0 END), 6) AS label_from_recency FROM features_v WHERE churned IS NOT NULL"""))
def label_leakage(spark, d):
    """How often the refused column alone gives the label away: always, which is why the feature list may not hold it."""
    models.check_no_leakage(models.NUMERIC + CATEGORICAL)
    known = views.features(spark, d).where(F.col("churned").isNotNull())
    same = ((F.col("recency_days") > 90) == (F.col("churned") == 1)).cast("double")
    return known.agg(rounded(F.avg(same)).alias("label_from_recency"))


@R.query("m2_stratified_split", with_views("features_v", """
SELECT customer_id, churned, ROW_NUMBER() OVER (PARTITION BY churned ORDER BY md5(CAST(customer_id AS VARCHAR) || ':42'))
  <= floor(COUNT(*) OVER (PARTITION BY churned) * 0.2e0 + 0.5e0) AS is_test FROM features_v WHERE churned IS NOT NULL"""))
def stratified_split(spark, d):
    known = materialize(views.features(spark, d).select("customer_id", "churned").where(F.col("churned").isNotNull()))
    train, test = models.stratified_split(known, "churned", "customer_id")
    return train.withColumn("is_test", F.lit(False)).unionByName(test.withColumn("is_test", F.lit(True)))


def churn_run(spark, d):
    """Split, fit a forest on the training part."""
    features = materialize(views.features(spark, d))
    known = features.where(F.col("churned").isNotNull())
    train, test = models.stratified_split(known, "churned", "customer_id")
    return features, test, models.fit_churn(train, categorical=CATEGORICAL)


@R.query("m3_churn_forest_metrics")
def churn_forest_metrics(spark, d):
    _, test, model = churn_run(spark, d)
    scores = materialize(models.score_customers(model, test).select("churned", "churn_probability"))
    auc = evaluation.roc_auc(scores, "churned", "churn_probability").select("roc_auc").scalar()
    return evaluation.accuracy_metrics(scores, "churned", "churn_probability").withColumn("roc_auc", auc)


@R.query("m4_feature_importance")
def feature_importance(spark, d):
    return models.feature_importance(churn_run(spark, d)[2], categorical=CATEGORICAL)


@R.query("m5_churn_scores")
def churn_scores(spark, d):
    features, _, model = churn_run(spark, d)
    return models.score_customers(model, features).select("customer_id", "churned", "churn_probability", "churn_risk_band")


@R.query("m5_node_table_scores", with_views("features_v", "SELECT customer_id, TRUE AS same, TRUE AS banded FROM features_v"))
def node_table_scores(spark, d):
    """Every customer scored by walking the forest's node table: the same probability as the model's, and the band that goes with it."""
    features, _, model = churn_run(spark, d)
    depth = model.stages[-1].getOrDefault("maxDepth")
    nodes = models.node_table(model.stages[-1], new_folder(spark))
    vectors = materialize(model.transform(features).select(
        "customer_id", vector_to_array("features").alias("features"), vector_to_array("probability")[1].alias("expected")))
    walked = models.forest_probability(vectors, nodes, "customer_id", "features", depth)
    scored = models.score_customers(model, features).select("customer_id", "churn_probability", "churn_risk_band")
    p = F.col("churn_probability")
    band = F.when(p <= 0.33, "Low").when(p <= 0.66, "Medium").otherwise("High")
    return vectors.join(walked, "customer_id").join(scored, "customer_id").select(
        "customer_id", (F.abs(F.col("probability") - F.col("expected")) < 1e-9).alias("same"), (F.col("churn_risk_band") == band).alias("banded"))


@R.query("m4_importance_names", with_views("features_v", """
SELECT feature, TRUE AS share FROM (SELECT unnest(['tenure_days', 'frequency', 'monetary_sgd', 'avg_basket_sgd', 'categories_purchased']) AS feature
UNION SELECT 'country_' || country FROM features_v UNION SELECT 'segment_' || segment FROM features_v)"""))
def importance_names(spark, d):
    """The expanded features of the fitted forest, each with a share of an importance that sums to one."""
    ranked = materialize(models.feature_importance(churn_run(spark, d)[2], categorical=CATEGORICAL))
    total = ranked.agg(F.sum("importance")).scalar()
    return ranked.select("feature", (F.col("importance").between(0, 1) & (F.abs(total - 1) < 1e-9)).alias("share"))


@R.query("m10_node_table_predictions", with_factors("SELECT date, ticker, TRUE AS same FROM panel WHERE date >= (SELECT date FROM cutoff)", cutoff=CUTOFF_SQL))
def node_table_predictions(spark, d):
    """The boosted return model's later dates predicted by walking its node table."""
    train, test = series.chronological_split(materialize(factor_panel(spark, d)))
    model = models.fit_return_model(materialize(train))
    key = F.concat_ws(":", F.col("date").cast("string"), F.col("ticker"))
    rows = materialize(model.transform(test).select(key.alias("key"), "date", "ticker", vector_to_array("features").alias("features"), F.col("prediction").alias("expected")))
    nodes = models.node_table(model.stages[-1], new_folder(spark))
    walked = models.boosted_prediction(rows, nodes, "key", "features", model.stages[-1].getOrDefault("maxDepth"))
    return rows.join(walked, "key").select("date", "ticker", (F.abs(F.col("prediction") - F.col("expected")) < 1e-9).alias("same"))


@R.query("m10_return_model")
def return_model(spark, d):
    train, test = series.chronological_split(materialize(factor_panel(spark, d)))
    model = models.fit_return_model(materialize(train))
    return model.transform(test).select("date", "ticker", "forward_return_5d", "prediction")


@R.query("m11_volatility_model")
def volatility_model(spark, d):
    panel = materialize(series.volatility_panel(views.prices(spark, d), MARKET).withColumn("book", F.lit("equal_weight")))
    sides = materialize(series.position_split(panel, "book"))
    model = models.fit_volatility_model(sides.where(F.col("side") == "train"))
    return evaluation.r_squared(model.transform(sides.where(F.col("side") == "test")), "forward_vol_21", "prediction")


@R.query("m12_compare_signals")
def compare_signals(spark, d):
    return models.compare_signals(factor_panel(spark, d))


BETAS = {"mom_21": 0.5, "mom_63": -0.25, "vol_21": 0.1, "reversal_5": 0.75, "rel_strength_21": 0.3}


@R.query("m13_linear_contributions", with_factors(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(AVG(abs({b} * ({f} - mu_{f}))), 6) AS mean_abs FROM panel, means" for f, b in BETAS.items()),
    means="SELECT " + ", ".join(f"AVG({f}) AS mu_{f}" for f in BETAS) + " FROM panel"))
def linear_contributions(spark, d):
    panel = materialize(factor_panel(spark, d))
    summary = models.linear_contributions(panel, BETAS, panel)
    return summary.select("feature", rounded("mean_abs").alias("mean_abs"))


@R.query("m13_linear_direction", with_factors(" UNION ALL ".join(
    f"SELECT '{f}' AS feature, ROUND(AVG({b} * ({f} - mu_{f})), 6) + 0e0 AS mean_signed, CASE WHEN AVG({b} * ({f} - mu_{f})) > 0 THEN 'increases' ELSE 'decreases' END AS direction FROM test, means"
    for f, b in BETAS.items()),
    cutoff="SELECT date FROM (SELECT date, ROW_NUMBER() OVER (ORDER BY date) - 1 AS i, COUNT(*) OVER () AS n FROM (SELECT DISTINCT date FROM panel)) WHERE i = CAST(floor(n * 0.7e0) AS BIGINT)",
    train="SELECT * FROM panel WHERE date < (SELECT date FROM cutoff)", test="SELECT * FROM panel WHERE date >= (SELECT date FROM cutoff)",
    means="SELECT " + ", ".join(f"AVG({f}) AS mu_{f}" for f in BETAS) + " FROM train"))
def linear_direction(spark, d):
    """Later dates explained against the mean of the earlier ones."""
    train, test = series.chronological_split(materialize(factor_panel(spark, d)))
    summary = models.linear_contributions(test, BETAS, train)
    return summary.select("feature", rounded("mean_signed").alias("mean_signed"), "direction")


@R.query("m13_permutation_contributions")
def permutation_contributions(spark, d):
    panel = materialize(factor_panel(spark, d).withColumn("row_id", F.concat_ws(":", F.col("date").cast("string"), F.col("ticker"))))
    train, test = series.chronological_split(panel)
    model = models.fit_return_model(train)
    return models.permutation_contributions(model, test, series.FACTOR_COLUMNS, "row_id")
