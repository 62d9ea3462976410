"""Churn classifier, boosted return and volatility models, and their explanations, on MLlib."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tidemark.operators import risk
from tidemark.operators.ranking import ROWS_PER_BIN, global_row_number, order_statistics
from tidemark.operators.retail import risk_band
from tidemark.operators.series import FACTOR_COLUMNS, VOLATILITY_COLUMNS, chronological_split, momentum_signal
from tidemark.session import broadcast_if_small, materialize

# Fixed values.
NUMERIC = ["tenure_days", "frequency", "monetary_sgd", "avg_basket_sgd", "categories_purchased"]
CATEGORICAL = ["country", "segment", "age_group"]
LABEL = "churned"
LABEL_DEFINING = {"recency_days", "last_purchase_date"}
SEED = 42
FOREST = {"numTrees": 300, "maxDepth": 8, "minInstancesPerNode": 10, "seed": SEED}
RETURN_MODEL = {"maxIter": 200, "maxDepth": 3, "stepSize": 0.03, "subsamplingRate": 0.8, "featureSubsetStrategy": "0.8", "seed": SEED}
VOLATILITY_MODEL = {"maxIter": 150, "maxDepth": 3, "stepSize": 0.05, "seed": SEED}


def check_no_leakage(columns: list[str]) -> None:
    leaking = LABEL_DEFINING & set(columns)
    if leaking:
        raise ValueError(f"{sorted(leaking)} define the churn label and cannot be features")


def churn_pipeline(numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, **forest) -> Pipeline:
    """Numbers as they are, categories one-hot with unseen values all zero, then a random forest."""
    check_no_leakage(numeric + categorical)
    indexed, encoded = [f"{c}_index" for c in categorical], [f"{c}_onehot" for c in categorical]
    return Pipeline(
        stages=[
            # "keep" puts an unseen value in one extra last slot, which dropLast then leaves all zero.
            StringIndexer(inputCols=categorical, outputCols=indexed, handleInvalid="keep"),
            OneHotEncoder(inputCols=indexed, outputCols=encoded, dropLast=True),
            # A missing number becomes NaN and takes the right branch of a split, so every row gets a score.
            VectorAssembler(inputCols=numeric + encoded, outputCol="features", handleInvalid="keep"),
            RandomForestClassifier(featuresCol="features", labelCol=LABEL, weightCol="class_weight", **{**FOREST, **forest}),
        ]
    )


def stratified_split(df: DataFrame, label: str, id_col: str, test_frac: float = 0.2, seed: int = SEED, rows_per_bin: int = ROWS_PER_BIN):
    """Exact share of each class by order of a hash of the id, so the split does not depend on partitioning."""
    keyed = df.withColumn("_hash", F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit(str(seed)))))
    is_test = F.lit(False)
    for row in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect():
        rank = int(row["n"] * test_frac + 0.5)
        same = F.col(label).eqNullSafe(F.lit(row[label]))
        cut = order_statistics(keyed.where(same).select("_hash"), ["_hash"], [rank], rows_per_bin).get(rank)
        if cut is not None:
            is_test = is_test | (same & (F.col("_hash") <= F.lit(cut[0])))
    marked = keyed.withColumn("_test", is_test)
    return marked.where(~F.col("_test")).drop("_hash", "_test"), marked.where("_test").drop("_hash", "_test")


def balanced_weights(df: DataFrame, label: str = LABEL) -> DataFrame:
    """Weight n / (classes * class size): every class weighs the same in total."""
    sizes = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(sizes.values())
    weight = F.lit(None).cast("double")
    for value, n in sizes.items():
        weight = F.when(F.col(label) == value, total / (len(sizes) * n)).otherwise(weight)
    return df.withColumn("class_weight", weight)


def fit_churn(train: DataFrame, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL, **forest) -> PipelineModel:
    known = train.select(LABEL, *numeric, *categorical).where(F.col(LABEL).isNotNull())
    return churn_pipeline(numeric, categorical, **forest).fit(balanced_weights(known))


def score_customers(model: PipelineModel, features: DataFrame) -> DataFrame:
    """Probability (4 digits) and band for every row, labelled or not."""
    probability = F.round(vector_to_array("probability")[1], 4)
    return (
        model.transform(features)
        .withColumn("churn_probability", probability)
        .withColumn("churn_risk_band", risk_band())
        .select(*features.columns, "churn_probability", "churn_risk_band")
    )


def feature_importance(model: PipelineModel, numeric: list[str] = NUMERIC, categorical: list[str] = CATEGORICAL) -> DataFrame:
    """One row per expanded feature, most important first. The driver holds one number per feature."""
    labels = model.stages[0].labelsArray
    names = numeric + [f"{c}_{v}" for c, values in zip(categorical, labels) for v in values]
    weights = model.stages[-1].featureImportances.toArray()
    schema = StructType([StructField("feature", StringType()), StructField("importance", DoubleType())])
    rows = [(n, float(w)) for n, w in zip(names, weights, strict=True)]
    spark = SparkSession.active()
    return spark.createDataFrame(rows, schema).orderBy(F.desc("importance"), "feature")


def _fit_boosted(train: DataFrame, features: list[str], label: str, **params) -> PipelineModel:
    assembler = VectorAssembler(inputCols=features, outputCol="features")
    return Pipeline(stages=[assembler, GBTRegressor(featuresCol="features", labelCol=label, **params)]).fit(train)


def fit_return_model(train: DataFrame, **params) -> PipelineModel:
    return _fit_boosted(train, FACTOR_COLUMNS, "forward_return_5d", **{**RETURN_MODEL, **params})


def fit_volatility_model(train: DataFrame, **params) -> PipelineModel:
    return _fit_boosted(train, VOLATILITY_COLUMNS, "forward_vol_21", **{**VOLATILITY_MODEL, **params})


def evaluate_signal(name: str, panel: DataFrame, signal: str) -> DataFrame:
    """One row: information coefficient with p-value and long-short Sharpe ratio."""
    ic = risk.information_coefficient(panel, signal, "forward_return_5d")
    sharpe = risk.long_short_sharpe(panel, signal).select("long_short_sharpe").scalar()
    return ic.select(F.lit(name).alias("name"), "ic", F.col("p_value").alias("ic_p_value"), sharpe.alias("long_short_sharpe"))


def compare_signals(panel: DataFrame, **params) -> DataFrame:
    """Unfitted momentum against the boosted model, both on the later dates only."""
    panel = materialize(panel)
    train, test = chronological_split(panel)
    model = fit_return_model(train, **params)
    test = materialize(model.transform(test).withColumn("signal", momentum_signal()).drop("features"))
    baseline = evaluate_signal("Hand-crafted momentum (unfit)", test, "signal")
    return baseline.unionByName(evaluate_signal("Boosted trees (trained on train split)", test, "prediction"))


def _summary(df: DataFrame, contributions: dict[str, Column]) -> DataFrame:
    """Mean absolute and mean signed value of each contribution: one aggregate, then one row per feature."""
    parts = [
        F.struct(F.lit(name).alias("feature"), F.avg(F.abs(c)).alias("mean_abs"), F.avg(c).alias("mean_signed"))
        for name, c in contributions.items()
    ]
    rows = df.agg(F.array(*parts).alias("p")).select(F.explode("p").alias("p")).select("p.*")
    direction = F.when(F.col("mean_signed") > 0, "increases").otherwise("decreases")
    return rows.select("feature", "mean_abs", "mean_signed", direction.alias("direction")).orderBy(F.desc("mean_abs"), "feature")


def linear_contributions(df: DataFrame, weights: dict[str, float], background: DataFrame) -> DataFrame:
    """Exact attribution of a linear model, weight * (x - background mean), summarised per feature."""
    means = background.agg(*[F.avg(f).alias(f) for f in weights])
    centred = {f: F.lit(w) * (F.col(f) - means.select(f).scalar()) for f, w in weights.items()}
    return _summary(df, centred)


def permutation_contributions(model: PipelineModel, df: DataFrame, features: list[str], id_col: str) -> DataFrame:
    """Attribution for a tree model: change in the prediction when one feature takes another row's value.

    Rows are paired through two global ranks, by id and by a hash of the id, so the shuffle of values is
    a join and does not depend on partitioning.
    """
    base = materialize(model.transform(df).select(id_col, *features, F.col("prediction").alias("_base")))
    hashed = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.lit("permute")))
    left = global_row_number(base, [id_col], "_rn")
    right = global_row_number(base.withColumn("_hash", hashed), ["_hash"], "_rn").select("_rn", *[F.col(f).alias(f"_other_{f}") for f in features])
    paired = materialize(left.join(right, "_rn"))
    changed = paired
    for f in features:
        swapped = changed.withColumn("_own", F.col(f)).withColumn(f, F.col(f"_other_{f}"))
        scored = model.transform(swapped).withColumn(f"_d_{f}", F.col("_base") - F.col("prediction"))
        changed = scored.withColumn(f, F.col("_own")).drop("_own", "prediction", "features")
    return _summary(changed, {f: F.col(f"_d_{f}") for f in features})


def node_table(model, folder: str) -> DataFrame:
    """The nodes of a fitted forest or boosted model, as it saves them: tree, weight, node, feature, threshold, categories, left, right,
    prediction, stats. Inner nodes have either a threshold (up to it goes left) or the categories that go left; leaves have no feature."""
    spark = SparkSession.active()
    model.write().save(folder)
    weights = spark.read.parquet(f"{folder}/treesMetadata").select(F.col("_1").alias("tree"), F.col("_3").alias("weight"))
    n, split = F.col("nodeData"), F.col("nodeData.split")
    inner, listed = split["featureIndex"] >= 0, split["numCategories"] >= 0
    values = split["leftCategoriesOrThreshold"]
    nodes = spark.read.parquet(f"{folder}/data").select(
        F.col("treeID").alias("tree"), n["id"].alias("node"), F.when(inner, split["featureIndex"]).alias("feature"),
        F.when(inner & ~listed, F.get(values, F.lit(0))).alias("threshold"), F.when(inner & listed, values).alias("categories"),
        n["leftChild"].alias("left"), n["rightChild"].alias("right"), n["prediction"].alias("prediction"), n["impurityStats"].alias("stats"),
    )
    return nodes.join(weights, "tree")


def leaves_reached(rows: DataFrame, nodes: DataFrame, id_col: str, features: str, depth: int) -> DataFrame:
    """(id, tree, node): the leaf of every tree that a row with an array of features ends in.

    A row walks all trees at once, one level a join with the nodes. The nodes of a model are bounded by its size, 2 ** depth
    a tree, and go to the rows while they are few; a missing number goes right.
    """
    trees = nodes.agg(F.max("tree")).first()[0] + 1
    inner = broadcast_if_small(materialize(nodes.where("feature is not null").select("tree", "node", "feature", "threshold", "categories", "left", "right")))
    at = rows.select(id_col, features, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"), F.lit(0).alias("node"))
    value = F.get(features, F.col("feature"))
    left = F.coalesce(F.array_contains("categories", value), (value <= F.col("threshold")) & ~F.isnan(value), F.lit(False))
    following = F.when(F.col("feature").isNull(), F.col("node")).when(left, F.col("left")).otherwise(F.col("right"))
    for _ in range(depth):
        at = at.join(inner, ["tree", "node"], "left").select(id_col, features, "tree", following.alias("node"))
    return at.select(id_col, "tree", "node")


def forest_probability(rows: DataFrame, nodes: DataFrame, id_col: str, features: str, depth: int) -> DataFrame:
    """(id, probability) of class 1: the mean over the trees of its share in the leaf."""
    share = F.get("stats", F.lit(1)) / F.aggregate("stats", F.lit(0.0), lambda a, x: a + x)
    leaves = broadcast_if_small(nodes.where("feature is null").select("tree", "node", share.alias("share")))
    reached = leaves_reached(rows, nodes, id_col, features, depth).join(leaves, ["tree", "node"])
    return reached.groupBy(id_col).agg(F.avg("share").alias("probability"))


def boosted_prediction(rows: DataFrame, nodes: DataFrame, id_col: str, features: str, depth: int) -> DataFrame:
    """(id, prediction): the weighted sum of the leaves' predictions."""
    leaves = broadcast_if_small(nodes.where("feature is null").select("tree", "node", (F.col("weight") * F.col("prediction")).alias("part")))
    reached = leaves_reached(rows, nodes, id_col, features, depth).join(leaves, ["tree", "node"])
    return reached.groupBy(id_col).agg(F.sum("part").alias("prediction"))
