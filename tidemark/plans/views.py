"""Input views over the given tables, once as DataFrames and once as SQL for the independent check.

The two forms are written separately on purpose: the SQL is never used to build the DataFrames.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.operators import evaluation, retail
from tidemark.operators.series import align_dates
from tidemark.session import materialize

AS_OF = "2001-08-02"
MARKET = "ASIA"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal a table that arrives in fewer splits than there are cores (one small file) out over the cores.

    For work that is heavy per row. A large table has more splits than cores already and is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def customers(spark, d) -> DataFrame:
    first_order = (
        table(spark, d, "orders")
        .groupBy(F.col("o_custkey").alias("customer_id"))
        .agg(F.to_date(F.min("o_orderdate")).alias("signup_date"))
    )
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("country"))
    return (
        table(spark, d, "customer")
        .join(nation, "c_nationkey")
        .select(
            F.col("c_custkey").alias("customer_id"),
            F.col("c_name").alias("customer_name"),
            "country",
            F.col("c_mktsegment").alias("segment"),
            "c_acctbal",
        )
        .join(first_order, "customer_id", "left")
    )


def transactions(spark, d) -> DataFrame:
    """All orders. Finished orders are purchases, open ones have no amount yet, pending ones count as returns."""
    status = F.col("o_orderstatus")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("transaction_id"),
        F.col("o_custkey").alias("customer_id"),
        F.to_date("o_orderdate").alias("transaction_date"),
        F.col("o_orderpriority").alias("category"),
        status.alias("channel"),
        F.when(status == "F", F.col("o_totalprice")).when(status == "P", -F.col("o_totalprice")).alias("amount_sgd"),
    )


def features(spark, d) -> DataFrame:
    return retail.customer_features(customers(spark, d), retail.clean_transactions(transactions(spark, d)), AS_OF)


def scored(spark, d) -> DataFrame:
    """Features with a fixed score that rises with recency, so no model is needed to check the consumers."""
    score = F.round(F.col("recency_days") / (F.col("recency_days") + 90.0), 4)
    return features(spark, d).withColumn("churn_probability", score).withColumn("churn_risk_band", retail.risk_band())


def raw_prices(spark, d) -> DataFrame:
    """Mean unit price per ship date and supplier region: one series per region.

    Sums combine map-side to one row per (day, region). Spark broadcasts the supplier side while it is small;
    beyond that the join shuffles and adaptive execution splits a supplier with a large share of the rows.
    """
    region = (
        table(spark, d, "nation")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("s_nationkey"), F.col("r_name").alias("ticker"))
    )
    supplier = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey").join(region, "s_nationkey")
    return (
        table(spark, d, "lineitem")
        .select("l_suppkey", F.to_date("l_shipdate").alias("date"), "l_extendedprice", "l_quantity")
        .join(supplier, "l_suppkey")
        .groupBy("date", "ticker")
        .agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"))
    )


def prices(spark, d) -> DataFrame:
    """The price table on the common calendar, written once: it is tiny next to the line items behind it."""
    return align_dates(materialize(raw_prices(spark, d)))


def positions(spark, d) -> DataFrame:
    """One book per market segment; weights are its shares of order value by customer region."""
    region = (
        table(spark, d, "nation")
        .join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
        .select(F.col("n_nationkey").alias("c_nationkey"), F.col("r_name").alias("ticker"))
    )
    spent = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.sum("o_totalprice").alias("spent"))
    by_cell = (
        table(spark, d, "customer")
        .join(spent, "c_custkey")
        .groupBy(F.col("c_mktsegment").alias("book"), "c_nationkey")
        .agg(F.sum("spent").alias("spent"))
        .join(region, "c_nationkey")
        .groupBy("book", "ticker")
        .agg(F.sum("spent").alias("spent"))
    )
    total = by_cell.groupBy("book").agg(F.sum("spent").alias("total"))
    return by_cell.join(total, "book").select("book", "ticker", (F.col("spent") / F.col("total")).alias("weight"))


def contracts(spark, d) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, d, "part").select(
        key.alias("contract_id"),
        F.col("p_retailprice").alias("s"),
        (F.col("p_retailprice") * (F.lit(0.8) + F.lit(0.1) * (key % 5))).alias("k"),
        (F.col("p_size") / F.lit(50.0)).alias("t"),
        F.lit(0.05).alias("r"),
        (F.lit(0.1) + F.lit(0.05) * (key % 7)).alias("sigma"),
        (F.lit(0.01) * (key % 3)).alias("q"),
        F.when(key % 2 == 0, "call").otherwise("put").alias("option_type"),
    )


def bonds(spark, d) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        key.alias("bond_id"),
        F.lit(100.0).alias("face"),
        ((F.lit(1) + key % 8) / F.lit(100.0)).alias("coupon_rate"),
        ((F.lit(1) + F.col("o_custkey") % 9) / F.lit(100.0)).alias("ytm"),
        (F.lit(1) + key % 30).alias("years"),
        (F.lit(1) + key % 2).alias("freq"),
    )


# Tenor in years for each line number.
TENORS = {1: 0.5, 2: 1.0, 3: 2.0, 4: 3.0, 5: 5.0, 6: 10.0, 7: 20.0}


def curve_quotes(spark, d) -> DataFrame:
    """One par curve per supplier: the mean tax rate by line number, read as a yield for that tenor."""
    tenor = F.element_at(F.create_map(*[F.lit(x) for kv in TENORS.items() for x in kv]), F.col("l_linenumber"))
    return (
        table(spark, d, "lineitem")
        .groupBy(F.col("l_suppkey").alias("curve_id"), "l_linenumber")
        .agg((F.lit(0.01) + F.avg("l_tax")).alias("par_yield"))
        .select("curve_id", tenor.alias("t"), "par_yield", F.when(tenor <= 1.0, 1).otherwise(2).alias("freq"))
    )


def markdown(spark, d) -> DataFrame:
    body = F.concat(F.lit("# Doc "), F.col("doc_id").cast("string"), F.lit("\n"), F.replace("text", F.lit("\n"), F.lit("\n## Part\n")))
    documents = table(spark, d, "documents").select("doc_id", "text")
    return spread(documents, "doc_id").select("doc_id", body.alias("body"))


def questions(spark, d) -> DataFrame:
    return (
        table(spark, d, "conversations")
        .where(F.col("role") == "user")
        .select((F.col("conv_id") * 1000 + F.col("turn")).alias("question_id"), F.col("text").alias("question"))
    )


def centroids(spark, d) -> DataFrame:
    """One query vector per label: the mean of the label's vectors, position by position."""
    long = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("pos", "x"))
    return (
        long.groupBy("label", "pos").agg(F.avg(F.col("x").cast("double")).alias("x"))
        .groupBy(F.col("label").alias("query_id"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", "x"))).alias("v"))
        .select("query_id", F.transform("v", lambda e: F.round(e["x"], 9)).alias("query_vec"))
    )


def typed_questions(spark, d) -> DataFrame:
    """Questions with the tool each one is meant for: parts stand for customer ids (some unknown), nations for countries,
    segments for drivers, suppliers for policy, and user turns of conversations are out of scope. Nations and regions give compound
    questions, for two or three tools each."""

    def ask(df, key, category, text, tools, must):
        return df.select(
            F.concat(F.lit(f"{category}-"), key).alias("question_id"),
            F.lit(category).alias("category"),
            text.alias("question"),
            F.array(*[F.lit(t) for t in tools]).cast("array<string>").alias("expected_tools"),
            (must if must is not None else F.array().cast("array<string>")).alias("must_contain"),
        )

    part = table(spark, d, "part").select("p_partkey")
    code = F.format_string("cust%06d", "p_partkey")
    nation, region, supplier = table(spark, d, "nation"), table(spark, d, "region"), table(spark, d, "supplier")
    own = F.format_string("cust%06d", "n_nationkey")
    segment = table(spark, d, "customer").select("c_mktsegment").distinct()
    turns = table(spark, d, "conversations").where(F.col("role") == "user")
    turn_key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return (
        ask(part, F.col("p_partkey").cast("string"), "customer", F.concat(F.lit("What is the churn risk for customer "), code, F.lit("?")),
            ["get_customer_churn_risk"], F.array(F.format_string("CUST%06d", "p_partkey")))
        .unionByName(ask(nation, F.col("n_name"), "country", F.concat(F.lit("How is revenue doing in "), F.col("n_name"), F.lit("?")),
                         ["get_country_kpis"], F.array(F.concat("n_name", F.lit(":")))))
        .unionByName(ask(segment, F.col("c_mktsegment"), "driver", F.concat(F.lit("Which driver matters most for churn in "), F.col("c_mktsegment"), F.lit("?")),
                         ["get_churn_risk_drivers"], F.array(F.lit("drivers"))))
        .unionByName(ask(supplier, F.col("s_suppkey").cast("string"), "policy", F.concat(F.lit("Can I claim the expense of a visit to "), F.col("s_name"), F.lit("?")),
                         ["ask_hr_it_policy"], None))
        .unionByName(ask(turns, turn_key, "out_of_scope", F.col("text"), [], None))
        .unionByName(ask(nation, F.concat(F.lit("pair-"), F.col("n_name")), "compound",
                         F.concat(F.lit("What is the churn risk for customer "), own, F.lit(" and how is revenue doing in "), F.col("n_name"), F.lit("?")),
                         ["get_customer_churn_risk", "get_country_kpis"], F.array(F.upper(own), F.concat("n_name", F.lit(":")))))
        .unionByName(ask(nation, F.concat(F.lit("triple-"), F.col("n_name")), "compound",
                         F.concat(F.lit("How is revenue doing in "), F.col("n_name"), F.lit(", which driver matters, and how much leave do people get there?")),
                         ["get_country_kpis", "get_churn_risk_drivers", "ask_hr_it_policy"], F.array(F.concat("n_name", F.lit(":")), F.lit("drivers"))))
        .unionByName(ask(region, F.concat(F.lit("policy-"), F.col("r_name")), "compound",
                         F.concat(F.lit("Which driver matters most, and can I claim the expense of a visit to "), F.col("r_name"), F.lit("?")),
                         ["get_churn_risk_drivers", "ask_hr_it_policy"], F.array(F.lit("drivers"))))
    )


def coded_scores(spark, d) -> DataFrame:
    """Scored customers under the short id used in questions."""
    return scored(spark, d).withColumn("customer_id", F.format_string("CUST%06d", "customer_id"))


NUMERIC_FEATURES = ["tenure_days", "frequency", "monetary_sgd", "avg_basket_sgd", "categories_purchased"]


def importance(scores: DataFrame) -> DataFrame:
    """A simple importance per feature: absolute correlation with the churn label."""
    known = scores.where(F.col("churned").isNotNull())
    parts = [F.struct(F.lit(f).alias("feature"), F.round(F.abs(F.corr(f, "churned")), 6).alias("importance")) for f in NUMERIC_FEATURES]
    return known.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")


def model_metrics(scores: DataFrame) -> DataFrame:
    """Accuracy and ROC-AUC of the fixed score, one row."""
    auc = evaluation.roc_auc(scores, "churned", "churn_probability").select("roc_auc").scalar()
    return evaluation.accuracy_metrics(scores, "churned", "churn_probability").select(
        F.round("accuracy", 4).alias("accuracy"), F.round(auc, 4).alias("roc_auc")
    )


def passages(spark, d) -> DataFrame:
    """Every embedded document: its text, a title from its label and its source as section."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("chunk_text"), F.col("source").alias("section"))
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")
    title = F.concat(F.lit("Label "), F.col("label").cast("string"))
    return vectors.join(docs, "chunk_id").withColumn("doc_title", title)


def vector_questions(spark, d) -> DataFrame:
    """Every benchmark passage as a question with a vector: the items take turns over the labels; even items point the way of their label's
    mean (in scope), odd ones the opposite way, and every further turn a tenth farther."""
    means = centroids(spark, d).agg(F.sort_array(F.collect_list(F.struct("query_id", "query_vec"))).alias("means"))  # one per label
    items = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))
    pair = F.floor(F.col("query_id") / 2)
    mean = F.element_at("means", (F.pmod(pair, F.size("means")) + 1).cast("int"))
    inside = F.col("query_id") % 2 == 0
    way = F.when(inside, 1).otherwise(-1) * (1 + F.floor(pair / F.size("means")) / 10)
    return items.withColumn("means", means.scalar()).select(
        "query_id", F.transform(mean["query_vec"], lambda x: F.round(x * way, 9)).alias("query_vec"),
        F.when(inside, F.concat(F.lit("Label "), mean["query_id"].cast("string"))).alias("expected_source"), inside.alias("in_scope"), "question",
    )


SQL = {
    "customers_v": """
SELECT c.c_custkey AS customer_id, c.c_name AS customer_name, m.signup_date, n.n_name AS country, c.c_mktsegment AS segment, c.c_acctbal
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT o_custkey, CAST(MIN(o_orderdate) AS DATE) AS signup_date FROM orders GROUP BY o_custkey) m ON m.o_custkey = c.c_custkey""",
    "transactions_v": """
SELECT o_orderkey AS transaction_id, o_custkey AS customer_id, CAST(o_orderdate AS DATE) AS transaction_date, o_orderpriority AS category,
       o_orderstatus AS channel, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'P' THEN -o_totalprice END AS amount_sgd FROM orders""",
    "features_v": """
SELECT c.*, CAST(DATE '2001-08-02' - c.signup_date AS INTEGER) AS tenure_days, a.last_purchase_date,
       COALESCE(a.frequency, 0) AS frequency, COALESCE(a.monetary_sgd, 0) AS monetary_sgd, COALESCE(a.avg_basket_sgd, 0) AS avg_basket_sgd,
       COALESCE(a.categories_purchased, 0) AS categories_purchased,
       CAST(COALESCE(DATE '2001-08-02' - a.last_purchase_date, 9999) AS INTEGER) AS recency_days,
       CASE WHEN COALESCE(a.frequency, 0) = 0 THEN NULL WHEN DATE '2001-08-02' - a.last_purchase_date > 90 THEN 1 ELSE 0 END AS churned
FROM customers_v c LEFT JOIN (
  SELECT customer_id, MAX(transaction_date) AS last_purchase_date, COUNT(transaction_id) AS frequency,
         CAST(ROUND(CAST(SUM(amount_sgd) AS DECIMAL(28,8)), 2) AS DOUBLE) AS monetary_sgd,
         CAST(ROUND(CAST(AVG(amount_sgd) AS DECIMAL(28,8)), 2) AS DOUBLE) AS avg_basket_sgd,
         COUNT(DISTINCT category) AS categories_purchased
  FROM transactions_v WHERE amount_sgd > 0 AND customer_id IS NOT NULL AND transaction_date IS NOT NULL GROUP BY customer_id) a USING (customer_id)""",
    "scored_v": """
SELECT *, CASE WHEN churn_probability <= 0.33 THEN 'Low' WHEN churn_probability <= 0.66 THEN 'Medium' ELSE 'High' END AS churn_risk_band
FROM (SELECT *, ROUND(recency_days / (recency_days + 90e0), 4) AS churn_probability FROM features_v)""",
    "raw_prices_v": """
SELECT CAST(l_shipdate AS DATE) AS date, r_name AS ticker, SUM(l_extendedprice) / SUM(l_quantity) AS price
FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey GROUP BY CAST(l_shipdate AS DATE), r_name""",
    "prices_v": """
SELECT * FROM raw_prices_v WHERE date IN
  (SELECT date FROM raw_prices_v GROUP BY date HAVING COUNT(*) = (SELECT COUNT(DISTINCT ticker) FROM raw_prices_v))""",
    "returns_v": """
SELECT * FROM (SELECT date, ticker, price / LAG(price) OVER (PARTITION BY ticker ORDER BY date) - 1 AS ret FROM prices_v) WHERE ret IS NOT NULL""",
    "portfolio_v": """
SELECT date, AVG(ret) AS ret FROM returns_v GROUP BY date""",
    "positions_v": """
SELECT c_mktsegment AS book, r_name AS ticker,
       SUM(o_totalprice) / SUM(SUM(o_totalprice)) OVER (PARTITION BY c_mktsegment) AS weight
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
GROUP BY c_mktsegment, r_name""",
    "contracts_v": """
SELECT p_partkey AS contract_id, p_retailprice AS s, p_retailprice * (0.8e0 + 0.1e0 * (p_partkey % 5)) AS k, p_size / 5e1 AS t, 5e-2 AS r,
       0.1e0 + 0.05e0 * (p_partkey % 7) AS sigma, 1e-2 * (p_partkey % 3) AS q,
       CASE WHEN p_partkey % 2 = 0 THEN 'call' ELSE 'put' END AS option_type FROM part""",
    "bonds_v": """
SELECT o_orderkey AS bond_id, 1e2 AS face, (1 + o_orderkey % 8) / 1e2 AS coupon_rate, (1 + o_custkey % 9) / 1e2 AS ytm,
       1 + o_orderkey % 30 AS years, 1 + o_orderkey % 2 AS freq FROM orders""",
    "curve_quotes_v": """
SELECT curve_id, t, par_yield, CASE WHEN t <= 1 THEN 1 ELSE 2 END AS freq FROM (
  SELECT l_suppkey AS curve_id, 1e-2 + AVG(l_tax) AS par_yield,
         CASE l_linenumber WHEN 1 THEN 0.5e0 WHEN 2 THEN 1e0 WHEN 3 THEN 2e0 WHEN 4 THEN 3e0 WHEN 5 THEN 5e0 WHEN 6 THEN 1e1 ELSE 2e1 END AS t
  FROM lineitem GROUP BY l_suppkey, l_linenumber)""",
    "markdown_v": """
SELECT doc_id, '# Doc ' || CAST(doc_id AS VARCHAR) || chr(10) || replace(text, chr(10), chr(10) || '## Part' || chr(10)) AS body FROM documents""",
    "questions_v": """
SELECT conv_id * 1000 + turn AS question_id, text AS question FROM conversations WHERE role = 'user'""",
    "typed_questions_v": """
SELECT 'customer-' || p_partkey AS question_id, 'customer' AS category, 'What is the churn risk for customer cust' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '?' AS question,
       ['get_customer_churn_risk'] AS expected_tools, ['CUST' || lpad(CAST(p_partkey AS VARCHAR), 6, '0')] AS must_contain FROM part
UNION ALL SELECT 'country-' || n_name, 'country', 'How is revenue doing in ' || n_name || '?', ['get_country_kpis'], [n_name || ':'] FROM nation
UNION ALL SELECT DISTINCT 'driver-' || c_mktsegment, 'driver', 'Which driver matters most for churn in ' || c_mktsegment || '?', ['get_churn_risk_drivers'], ['drivers'] FROM customer
UNION ALL SELECT 'policy-' || s_suppkey, 'policy', 'Can I claim the expense of a visit to ' || s_name || '?', ['ask_hr_it_policy'], CAST([] AS VARCHAR[]) FROM supplier
UNION ALL SELECT 'out_of_scope-' || conv_id || '-' || turn, 'out_of_scope', text, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM conversations WHERE role = 'user'
UNION ALL SELECT 'compound-pair-' || n_name, 'compound', 'What is the churn risk for customer cust' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0') || ' and how is revenue doing in ' || n_name || '?',
  ['get_customer_churn_risk', 'get_country_kpis'], ['CUST' || lpad(CAST(n_nationkey AS VARCHAR), 6, '0'), n_name || ':'] FROM nation
UNION ALL SELECT 'compound-triple-' || n_name, 'compound', 'How is revenue doing in ' || n_name || ', which driver matters, and how much leave do people get there?',
  ['get_country_kpis', 'get_churn_risk_drivers', 'ask_hr_it_policy'], [n_name || ':', 'drivers'] FROM nation
UNION ALL SELECT 'compound-policy-' || r_name, 'compound', 'Which driver matters most, and can I claim the expense of a visit to ' || r_name || '?',
  ['get_churn_risk_drivers', 'ask_hr_it_policy'], ['drivers'] FROM region""",
    "importance_v": """
SELECT * FROM (
  SELECT 'tenure_days' AS feature, ROUND(abs(corr(tenure_days, churned)), 6) AS importance FROM features_v WHERE churned IS NOT NULL
  UNION ALL SELECT 'frequency', ROUND(abs(corr(frequency, churned)), 6) FROM features_v WHERE churned IS NOT NULL
  UNION ALL SELECT 'monetary_sgd', ROUND(abs(corr(monetary_sgd, churned)), 6) FROM features_v WHERE churned IS NOT NULL
  UNION ALL SELECT 'avg_basket_sgd', ROUND(abs(corr(avg_basket_sgd, churned)), 6) FROM features_v WHERE churned IS NOT NULL
  UNION ALL SELECT 'categories_purchased', ROUND(abs(corr(categories_purchased, churned)), 6) FROM features_v WHERE churned IS NOT NULL)""",
    "metrics_v": """
SELECT ROUND(AVG(CASE WHEN (churn_probability > 0.5) = (churned = 1) THEN 1 ELSE 0 END), 4) AS accuracy,
       ROUND((SUM(CASE WHEN churned = 1 THEN rk END) - SUM(churned) * (SUM(churned) + 1) / 2e0) / (SUM(churned) * SUM(1 - churned)), 4) AS roc_auc
FROM (SELECT *, RANK() OVER (ORDER BY churn_probability) + (COUNT(*) OVER (PARTITION BY churn_probability) - 1) / 2e0 AS rk FROM scored_v WHERE churned IS NOT NULL)""",
    "passages_v": """
SELECT vec_id AS chunk_id, embedding, label, text AS chunk_text, source AS section, 'Label ' || label AS doc_title FROM embeddings JOIN documents ON doc_id = vec_id""",
    "vector_questions_v": """
SELECT item_id AS query_id, list_transform(m.query_vec, lambda x : ROUND(x * (CASE WHEN item_id % 2 = 0 THEN 1 ELSE -1 END) * (1 + (item_id // 2 // n) / 1e1), 9)) AS query_vec,
       CASE WHEN item_id % 2 = 0 THEN 'Label ' || m.query_id END AS expected_source, item_id % 2 = 0 AS in_scope, text AS question
FROM benchmark JOIN (SELECT *, ROW_NUMBER() OVER (ORDER BY query_id) - 1 AS place, COUNT(*) OVER () AS n FROM centroids_v) m ON (item_id // 2) % n = place""",
    "centroids_v": """
SELECT label AS query_id, list(ROUND(x, 9) ORDER BY pos) AS query_vec FROM (
  SELECT label, pos, AVG(CAST(embedding[pos] AS DOUBLE)) AS x FROM (SELECT label, embedding, unnest(range(1, len(embedding) + 1)) AS pos FROM embeddings)
  GROUP BY label, pos) GROUP BY label""",
}

# View -> views it reads.
NEEDS = {
    "features_v": ["customers_v", "transactions_v"],
    "scored_v": ["features_v"],
    "prices_v": ["raw_prices_v"],
    "returns_v": ["prices_v"],
    "portfolio_v": ["returns_v"],
    "importance_v": ["features_v"],
    "metrics_v": ["scored_v"],
    "vector_questions_v": ["centroids_v"],
}


def with_views(names: str | list[str], body: str, **extra: str) -> str:
    """Prefix ``body`` with the named views, and the views they need, as CTEs."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in NEEDS.get(name, []):
            add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names.split() if isinstance(names, str) else names:
        add(name)
    ctes = [f"{n} AS ({SQL[n].strip()})" for n in ordered] + [f"{n} AS ({s.strip()})" for n, s in extra.items()]
    return f"WITH {', '.join(ctes)}\n{body.strip()}" if ctes else body.strip()
