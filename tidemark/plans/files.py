"""Round trips through every reader and writer, on tables derived from the given ones.

Files go to a new folder below the shared folder of the session.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tidemark.functions.dates import epoch_date, epoch_seconds
from tidemark.operators import models
from tidemark.plans import views
from tidemark.plans.registry import Registry
from tidemark.plans.views import with_views
from tidemark.session import materialize, shared_folder
from tidemark.sources import readers, schemas, sinks

R = Registry()
SCORED_SCHEMA = "customer_id long, country string, monetary_sgd double, churn_probability double, churn_risk_band string"


def new_folder(spark) -> str:
    return f"{shared_folder(spark)}/tidemark-files-{uuid.uuid4().hex}"


@R.query("s1_csv_scan", with_views("customers_v transactions_v", """
SELECT CAST(transaction_id AS VARCHAR) AS transaction_id, CAST(customer_id AS VARCHAR) AS customer_id, transaction_date, category, channel, amount_sgd FROM transactions_v"""))
def csv_scan(spark, d):
    folder = new_folder(spark)
    rows = views.transactions(spark, d).withColumns({c: F.col(c).cast("string") for c in ("transaction_id", "customer_id")})
    sinks.write_csv(rows, f"{folder}/transactions.csv")
    return readers.read_csv(spark, f"{folder}/transactions.csv", schemas.TRANSACTIONS)


@R.query("s2_json_array_scan", """
SELECT CAST(item_id AS INTEGER) AS id, text AS question, CAST(NULL AS VARCHAR) AS expected_source, 'item' || item_id || '|' || length(text) AS keywords,
       item_id % 2 = 0 AS in_scope, CAST(NULL AS VARCHAR) AS note FROM benchmark""")
def json_array_scan(spark, d):
    """Benchmark items as question files of at most 50 questions, without the optional keys."""
    folder = new_folder(spark)
    item = F.struct(
        F.col("item_id").alias("id"), F.col("text").alias("question"),
        F.array(F.concat(F.lit("item"), F.col("item_id").cast("string")), F.length("text").cast("string")).alias("expected_keywords"),
        (F.col("item_id") % 2 == 0).alias("in_scope"),
    )
    files = views.table(spark, d, "benchmark").groupBy(F.floor(F.col("item_id") / 50)).agg(F.to_json(F.collect_list(item)).alias("value"))
    files.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    read = readers.read_json_array(spark, folder, schemas.RETRIEVAL_QUESTIONS)
    return read.withColumn("keywords", F.array_join("expected_keywords", "|")).drop("expected_keywords")


@R.query("s3_markdown_folder", """
SELECT '# Item ' || item_id || chr(10) || text || chr(10) AS body, TRUE AS named, COUNT(*) OVER () AS files FROM benchmark""")
def markdown_folder(spark, d):
    folder = new_folder(spark)
    body = F.concat(F.lit("# Item "), F.col("item_id").cast("string"), F.lit("\n"), F.col("text"))
    files = views.table(spark, d, "benchmark").select(body.alias("value"))
    files.write.option("maxRecordsPerFile", 1).text(folder)
    read = readers.read_markdown_folder(spark, folder, "*.txt")
    names = read.agg(F.count_distinct("source_file")).scalar()
    return read.select("body", F.col("source_file").endswith(".txt").alias("named"), names.alias("files"))


@R.query("s4_chart_files", with_views("prices_v", "SELECT date, ticker, CAST(ROUND(CAST(price AS DECIMAL(28,9)), 4) AS DOUBLE) AS price FROM prices_v"))
def chart_files(spark, d):
    """Prices written as one nested chart document per ticker and read back."""
    folder = new_folder(spark)
    point = F.struct(epoch_seconds(F.col("date")).alias("t"), F.round(F.round("price", 9), 4).alias("p"))
    grouped = views.prices(spark, d).groupBy("ticker").agg(F.sort_array(F.collect_list(point)).alias("x"))
    closes = F.array(F.struct(F.col("x.p").alias("adjclose")))
    result = F.struct(
        F.struct(F.col("ticker").alias("symbol")).alias("meta"), F.col("x.t").alias("timestamp"), F.struct(closes.alias("adjclose")).alias("indicators")
    )
    document = grouped.select(F.to_json(F.struct(F.struct(F.array(result).alias("result")).alias("chart"))).alias("value"))
    document.write.option("maxRecordsPerFile", 1).text(folder)
    return readers.read_charts(spark, folder)


@R.query("s5_partitioned_parquet", with_views("features_v", "SELECT customer_id, segment, monetary_sgd, churned, country FROM features_v"))
def partitioned_parquet(spark, d):
    folder = new_folder(spark)
    sinks.write_partitioned(views.features(spark, d).select("customer_id", "segment", "monetary_sgd", "churned", "country"), folder, "country")
    return spark.read.parquet(folder)


@R.query("s5_partition_pruning", with_views("features_v", "SELECT customer_id, monetary_sgd, country FROM features_v WHERE country = 'NATION_7'"))
def partition_pruning(spark, d):
    return partitioned_parquet(spark, d).where(F.col("country") == "NATION_7").select("customer_id", "monetary_sgd", "country")


@R.query("s6_csv_sink", with_views("scored_v", "SELECT customer_id, country, monetary_sgd, churn_probability, churn_risk_band FROM scored_v"))
def csv_sink(spark, d):
    folder = new_folder(spark)
    sinks.write_csv(views.scored(spark, d).select("customer_id", "country", "monetary_sgd", "churn_probability", "churn_risk_band"), folder)
    return readers.read_csv(spark, folder, SCORED_SCHEMA)


@R.query("s7_evaluation_report", with_views("scored_v", """
SELECT COUNT(*) AS questions, CAST(SUM(CASE WHEN churned = 1 THEN 1 ELSE 0 END) AS BIGINT) AS hits, (SELECT COUNT(*) FROM scored_v) AS summary_total FROM scored_v"""))
def evaluation_report(spark, d):
    folder = new_folder(spark)
    rows = materialize(views.scored(spark, d).select("customer_id", "churned"))
    sinks.write_evaluation(rows.agg(F.count(F.lit(1)).alias("total")), rows, folder)
    total = readers.read_json_array(spark, f"{folder}/summary", "total long").scalar()
    per_question = spark.read.schema("customer_id long, churned int").json(f"{folder}/questions")
    return per_question.agg(F.count(F.lit(1)).alias("questions"), F.count_if(F.col("churned") == 1).alias("hits"), total.alias("summary_total"))


@R.query("s8_model_reload", with_views("features_v", "SELECT COUNT(*) AS rows, CAST(0 AS BIGINT) AS changed FROM features_v"))
def model_reload(spark, d):
    """Rows, and rows whose score changes after saving and loading the fitted pipeline (none should)."""
    folder = new_folder(spark)
    features = materialize(views.features(spark, d))
    model = models.fit_churn(features, categorical=["country", "segment"])
    sinks.save_model(model, folder)
    before = models.score_customers(model, features).select("customer_id", F.col("churn_probability").alias("p"))
    after = models.score_customers(sinks.load_model(folder), features).select("customer_id", "churn_probability")
    return before.join(after, "customer_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(~F.col("p").eqNullSafe(F.col("churn_probability"))).alias("changed")
    )


@R.query("n16_epoch_dates", """
SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS seconds, CAST(ts AS DATE) AS day FROM events""")
def epoch_dates(spark, d):
    stamped = views.table(spark, d, "events").select("event_id", epoch_seconds(F.col("ts")).alias("seconds"))
    return stamped.withColumn("day", epoch_date(F.col("seconds")))
