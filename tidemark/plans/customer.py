"""Customer features, labels, quartiles, KPIs and lookups."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import ranking, retail
from tidemark.plans import views
from tidemark.plans.registry import Registry
from tidemark.plans.views import with_views
from tidemark.session import materialize

R = Registry()
CENTS = "CAST(ROUND(CAST({} AS DECIMAL(28,8)), 2) AS DOUBLE)"


@R.query(
    "f1_clean_transactions",
    with_views("transactions_v", """
SELECT * FROM transactions_v
WHERE customer_id IS NOT NULL AND transaction_date IS NOT NULL AND amount_sgd IS NOT NULL AND amount_sgd > 0"""),
)
def clean_transactions(spark, d):
    return retail.clean_transactions(views.transactions(spark, d))


@R.query(
    "f2_recency_tenure_days",
    with_views("customers_v", """
SELECT c.customer_id, CAST(date_diff('day', c.signup_date, DATE '2001-08-02') AS INTEGER) AS tenure_days,
       CAST(date_diff('day', MAX(CAST(o.o_orderdate AS DATE)), DATE '2001-08-02') AS INTEGER) AS recency_days
FROM customers_v c JOIN orders o ON o.o_custkey = c.customer_id GROUP BY c.customer_id, c.signup_date"""),
)
def recency_tenure(spark, d):
    last = views.transactions(spark, d).groupBy("customer_id").agg(F.max("transaction_date").alias("last_purchase_date"))
    return (
        views.customers(spark, d)
        .join(last, "customer_id")
        .select(
            "customer_id",
            retail.days_before(views.AS_OF, "signup_date").alias("tenure_days"),
            retail.days_before(views.AS_OF, "last_purchase_date").alias("recency_days"),
        )
    )


@R.query("f3_null_defaults", with_views("features_v", """
SELECT customer_id, frequency, monetary_sgd, avg_basket_sgd, categories_purchased, recency_days FROM features_v"""))
def null_defaults(spark, d):
    return views.features(spark, d).select("customer_id", *retail.FEATURE_DEFAULTS)


@R.query("f4_churn_label", with_views("transactions_v", """
SELECT c.c_custkey AS customer_id, CASE WHEN t.last_day IS NULL THEN NULL WHEN t.last_day < DATE '2001-05-04' THEN 1 ELSE 0 END AS churned
FROM customer c LEFT JOIN (SELECT customer_id, MAX(transaction_date) AS last_day FROM transactions_v WHERE amount_sgd > 0 GROUP BY 1) t
ON t.customer_id = c.c_custkey"""))
def churn_label(spark, d):
    return views.features(spark, d).select("customer_id", "churned")


@R.query("f5_risk_band", with_views("scored_v", """
SELECT customer_id, churn_probability, CASE WHEN churn_probability > -0.01 AND churn_probability <= 0.33 THEN 'Low'
  WHEN churn_probability > 0.33 AND churn_probability <= 0.66 THEN 'Medium'
  WHEN churn_probability > 0.66 AND churn_probability <= 1 THEN 'High' END AS churn_risk_band FROM scored_v"""))
def risk_band(spark, d):
    return views.scored(spark, d).select("customer_id", "churn_probability", "churn_risk_band")


@R.query("f6_facet_filter", with_views("features_v", """
SELECT customer_id, country, segment, monetary_sgd FROM features_v
WHERE country IN ('NATION_1', 'NATION_7', 'NATION_19') AND segment IN ('HOUSEHOLD', 'MACHINERY')"""))
def facet_filter(spark, d):
    kept = retail.facet_filter(
        views.features(spark, d), country=["NATION_1", "NATION_7", "NATION_19"], segment=["HOUSEHOLD", "MACHINERY"]
    )
    return kept.select("customer_id", "country", "segment", "monetary_sgd")


def customer_requests(spark, d):
    """One id request per part: padded and lower case, and beyond the last customer for some."""
    return views.table(spark, d, "part").select(F.format_string("  customer#%09d ", "p_partkey").alias("requested_id"))


REQUESTS_SQL = "SELECT '  customer#' || lpad(CAST(p_partkey AS VARCHAR), 9, '0') || ' ' AS requested_id FROM part"


@R.query("f7_customer_lookup", with_views("scored_v", """
SELECT r.requested_id, s.customer_name AS found_id, s.country, s.segment, s.churn_probability, s.churn_risk_band, s.recency_days,
       s.frequency, s.monetary_sgd, s.tenure_days,
       CASE WHEN s.customer_id IS NULL THEN 'No customer found with ID ''' || r.requested_id || '''.' END AS error
FROM requests r LEFT JOIN scored_v s ON upper(trim(r.requested_id)) = upper(s.customer_name)""", requests=REQUESTS_SQL))
def customer_lookup(spark, d):
    return retail.lookup_customers(customer_requests(spark, d), views.scored(spark, d), id_col="customer_name")


@R.query("j1_customer_left_join", with_views("features_v", """
SELECT customer_id, customer_name, signup_date, country, segment, c_acctbal, tenure_days, last_purchase_date, frequency, monetary_sgd,
       avg_basket_sgd, categories_purchased, recency_days, churned FROM features_v"""))
def customer_left_join(spark, d):
    return views.features(spark, d)


@R.query("a1_purchase_summary", with_views("transactions_v", f"""
SELECT customer_id, MAX(transaction_date) AS last_purchase_date, COUNT(transaction_id) AS frequency, {CENTS.format('SUM(amount_sgd)')} AS monetary_sgd,
       {CENTS.format('AVG(amount_sgd)')} AS avg_basket_sgd, COUNT(DISTINCT category) AS categories_purchased,
       CAST(DATE '2001-08-02' - MAX(transaction_date) AS INTEGER) AS recency_days
FROM transactions_v WHERE amount_sgd > 0 GROUP BY customer_id"""))
def purchase_summary(spark, d):
    return retail.purchase_summary(retail.clean_transactions(views.transactions(spark, d)), views.AS_OF)


@R.query("a2_country_summary", with_views("features_v", f"""
SELECT country, COUNT(*) AS customers, {CENTS.format('AVG(monetary_sgd)')} AS avg_ltv_sgd, ROUND(AVG(churned), 3) AS churn_rate
FROM features_v GROUP BY country ORDER BY country"""))
def country_summary(spark, d):
    return retail.country_summary(views.features(spark, d))


@R.query("a3_kpi_row", with_views("features_v", f"""
SELECT COUNT(*) AS customers, {CENTS.format('SUM(monetary_sgd)')} AS total_revenue, {CENTS.format('AVG(monetary_sgd)')} AS avg_ltv,
       ROUND(AVG(churned), 6) AS churn_rate FROM features_v"""))
def kpi_row(spark, d):
    return retail.kpi_row(views.features(spark, d))


@R.query("a4_revenue_by_country", with_views("features_v", f"""
SELECT country, {CENTS.format('SUM(monetary_sgd)')} AS monetary_sgd FROM features_v GROUP BY country ORDER BY monetary_sgd DESC"""))
def revenue_by_country(spark, d):
    return retail.revenue_by(views.features(spark, d))


@R.query("a5_segment_counts", with_views("customers_v", """
SELECT segment, COUNT(*) AS customers FROM customers_v GROUP BY segment"""))
def segment_counts(spark, d):
    return retail.value_counts(views.customers(spark, d), "segment")


@R.query("a6_country_band_counts", with_views("scored_v", """
SELECT country, churn_risk_band, COUNT(*) AS customers FROM scored_v GROUP BY country, churn_risk_band"""))
def country_band_counts(spark, d):
    return retail.value_counts(views.scored(spark, d), "country", "churn_risk_band")


def country_requests(spark, d):
    """Requests for every nation and every region; regions are not countries, so those miss."""
    nation = views.table(spark, d, "nation").select(F.concat(F.lit(" "), F.lower("n_name")).alias("requested_country"))
    region = views.table(spark, d, "region").select(F.col("r_name").alias("requested_country"))
    return nation.unionByName(region)


@R.query("a7_country_kpis", with_views("scored_v", f"""
SELECT q.requested_country, k.country, k.customer_count, k.avg_churn_probability, k.high_risk_count, k.total_monetary_sgd,
  CASE WHEN k.country IS NULL THEN 'No data for country ''' || q.requested_country || '''. Valid markets: '
    || (SELECT string_agg(country, ', ' ORDER BY country) FROM (SELECT DISTINCT country FROM scored_v)) || '.' END AS error
FROM (SELECT ' ' || lower(n_name) AS requested_country FROM nation UNION ALL SELECT r_name FROM region) q
LEFT JOIN (SELECT country, COUNT(*) AS customer_count, ROUND(AVG(churn_probability), 4) AS avg_churn_probability,
  CAST(SUM(CASE WHEN churn_risk_band = 'High' THEN 1 ELSE 0 END) AS BIGINT) AS high_risk_count, {CENTS.format('SUM(monetary_sgd)')} AS total_monetary_sgd
  FROM scored_v GROUP BY country) k ON lower(k.country) = lower(trim(q.requested_country))"""))
def country_kpis(spark, d):
    return retail.lookup_country_kpis(country_requests(spark, d), views.scored(spark, d))


@R.query("a8_sorted_countries", with_views("customers_v", "SELECT DISTINCT country FROM customers_v ORDER BY country"))
def sorted_countries(spark, d):
    return retail.sorted_distinct(views.customers(spark, d), "country")


@R.query("w1_quartile_scores", with_views("features_v", """
SELECT customer_id, CAST(NTILE(4) OVER (ORDER BY recency_days, customer_id) AS INTEGER) AS recency_days_quartile,
       CAST(NTILE(4) OVER (ORDER BY frequency DESC, customer_id) AS INTEGER) AS frequency_quartile,
       CAST(NTILE(4) OVER (ORDER BY monetary_sgd DESC, customer_id) AS INTEGER) AS monetary_sgd_quartile FROM features_v"""))
def quartile_scores(spark, d):
    scores = retail.quartile_scores(views.features(spark, d))
    return scores.select("customer_id", *[f"{c}_quartile" for c in retail.QUARTILE_COLUMNS])


@R.query("w2_value_quartiles", with_views("features_v", """
SELECT f.customer_id,
  CAST(1 + (SELECT COUNT(*) FROM inner_edges i WHERE f.recency_days > i.e) AS INTEGER) AS recency_quartile,
  CAST(4 - CASE WHEN r.rk > 1 + (r.n - 1) * 0.25e0 THEN 1 ELSE 0 END - CASE WHEN r.rk > 1 + (r.n - 1) * 0.5e0 THEN 1 ELSE 0 END
    - CASE WHEN r.rk > 1 + (r.n - 1) * 0.75e0 THEN 1 ELSE 0 END AS INTEGER) AS monetary_quartile
FROM features_v f JOIN (SELECT customer_id, ROW_NUMBER() OVER (ORDER BY monetary_sgd, customer_id) AS rk, COUNT(*) OVER () AS n FROM features_v) r
USING (customer_id)""",
    edges="SELECT DISTINCT unnest(quantile_cont(recency_days, [0, 0.25, 0.5, 0.75, 1])) AS e FROM features_v",
    inner_edges="SELECT e FROM edges WHERE e > (SELECT MIN(e) FROM edges) AND e < (SELECT MAX(e) FROM edges)"))
def value_quartiles(spark, d):
    features = materialize(views.features(spark, d).select("customer_id", "recency_days", "monetary_sgd"))
    scored = retail.value_quartiles(features, "recency_days", "customer_id", "recency_quartile")
    scored = retail.first_rank_quartiles(scored, "monetary_sgd", "customer_id", "monetary_quartile")
    return scored.select("customer_id", "recency_quartile", "monetary_quartile")


AVERAGE_AND_FIRST_RANK_SQL = with_views("scored_v", """
SELECT customer_id, churn_probability, CAST(RANK() OVER (ORDER BY churn_probability) + (COUNT(*) OVER (PARTITION BY churn_probability) - 1) / 2e0 AS DOUBLE) AS avg_rank,
       ROW_NUMBER() OVER (ORDER BY churn_probability, customer_id) AS first_rank FROM scored_v""")


@R.query("w11_average_and_first_rank", AVERAGE_AND_FIRST_RANK_SQL)
def average_and_first_rank(spark, d):
    scores = materialize(views.scored(spark, d).select("customer_id", "churn_probability"))
    ranked = ranking.global_row_number(scores, ["churn_probability", "customer_id"], "first_rank")
    return ranking.average_rank(ranked, "churn_probability", "avg_rank")


@R.query("w11_ranks_in_many_parts", AVERAGE_AND_FIRST_RANK_SQL)
def ranks_in_many_parts(spark, d):
    """The same ranks from parts of 100 rows, with the values of more than 20 rows joined apart."""
    scores = materialize(views.scored(spark, d).select("customer_id", "churn_probability"))
    ranked = ranking.global_row_number(scores, ["churn_probability", "customer_id"], "first_rank", 100)
    return ranking.average_rank(ranked, "churn_probability", "avg_rank", 100, 20)


@R.query("t1_total_sort", with_views("features_v", """
SELECT customer_id, country, monetary_sgd FROM features_v ORDER BY country, monetary_sgd DESC, customer_id"""))
def total_sort(spark, d):
    return views.features(spark, d).select("customer_id", "country", "monetary_sgd").orderBy("country", F.desc("monetary_sgd"), "customer_id")


@R.query("t2_top_customers", with_views("features_v", """
SELECT customer_id, monetary_sgd FROM features_v ORDER BY monetary_sgd DESC, customer_id LIMIT 10"""))
def top_customers(spark, d):
    return retail.top_rows(views.features(spark, d).select("customer_id", "monetary_sgd"), 10, F.desc("monetary_sgd"), "customer_id")


@R.query("u5_distinct_segments", "SELECT DISTINCT c_mktsegment AS segment, c_nationkey FROM customer")
def distinct_segments(spark, d):
    return views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("segment"), "c_nationkey").distinct()
