"""Scoring of retrieval and routing runs, and of model predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidemark.operators.ranking import ROWS_PER_BIN, cumulative_counts


def rate(condition: Column, among: Column) -> Column:
    """Share of the rows in ``among`` that meet ``condition`` (NULL counts as not met); 0 when there are none."""
    met = F.coalesce(condition, F.lit(False)).cast("double")
    return F.coalesce(F.avg(F.when(among, met)), F.lit(0.0))


def contains_keyword(answer: Column):
    text = F.lower(answer)
    return lambda kw: F.contains(text, F.lower(kw))


def judge_retrieval(expected: DataFrame, actual: DataFrame, question_id: str = "query_id") -> DataFrame:
    """Join expectations to results and mark each question.

    ``expected``: expected_source, expected_keywords, in_scope. ``actual``: sources (array), answer, grounded, best_distance.
    """
    scope = F.col("in_scope")
    hit = F.when(scope & F.col("expected_source").isNotNull(), F.array_contains("sources", F.col("expected_source")))
    words = F.when(
        scope & (F.size("expected_keywords") > 0), F.exists("expected_keywords", contains_keyword(F.col("answer")))
    )
    return (
        expected.join(actual, question_id)
        .withColumn("retrieval_hit", hit)
        .withColumn("keyword_hit", words)
        .withColumn("best_distance", F.round("best_distance", 3))
        .withColumn(
            "hallucination_flag",
            F.when(scope, F.col("grounded") & F.coalesce(~F.col("keyword_hit"), F.lit(False))).otherwise(F.col("grounded")),
        )
    )


def retrieval_summary(judged: DataFrame) -> DataFrame:
    inside = F.col("in_scope")
    return judged.agg(
        F.count(F.lit(1)).alias("total_questions"),
        F.count_if(inside).alias("in_scope_questions"),
        F.count_if(~inside).alias("out_of_scope_questions"),
        rate(F.col("retrieval_hit"), inside).alias("retrieval_accuracy"),
        rate(F.col("keyword_hit"), inside).alias("keyword_grounding_accuracy"),
        rate(~F.col("grounded"), ~inside).alias("correct_refusal_rate"),
        F.count_if("hallucination_flag").alias("hallucination_flags"),
    )


def judge_routing(expected: DataFrame, actual: DataFrame, question_id: str = "question_id") -> DataFrame:
    """``expected``: category, expected_tools, must_contain, must_not_contain. ``actual``: tools_called, answer, handled."""
    as_set = lambda c: F.array_sort(F.array_distinct(c))
    found = contains_keyword(F.col("answer"))
    return (
        expected.join(actual, question_id)
        .withColumn("routing_correct", as_set(F.col("tools_called")) == as_set(F.col("expected_tools")))
        .withColumn("keyword_hit", F.when(F.size("must_contain") > 0, F.forall("must_contain", found)))
        .withColumn("hallucination_flag", F.coalesce(F.exists("must_not_contain", found), F.lit(False)))
    )


def routing_summary(judged: DataFrame) -> DataFrame:
    correct = F.col("routing_correct")
    return judged.agg(
        F.count(F.lit(1)).alias("total_questions"),
        rate(correct, F.lit(True)).alias("routing_accuracy"),
        rate(F.col("keyword_hit"), F.col("keyword_hit").isNotNull()).alias("keyword_grounding_accuracy"),
        F.count_if("hallucination_flag").alias("hallucination_flags"),
        rate(F.size("tools_called") == 0, F.col("category") == "out_of_scope").alias("correct_refusal_rate"),
        rate(correct, F.col("category") == "compound").alias("compound_full_success_rate"),
    )


def routing_by_category(judged: DataFrame) -> DataFrame:
    return judged.groupBy("category").agg(
        F.count(F.lit(1)).alias("questions"), rate(F.col("routing_correct"), F.lit(True)).alias("routing_accuracy")
    )


def roc_auc(scored: DataFrame, label: str, score: str, rows_per_bin: int = ROWS_PER_BIN) -> DataFrame:
    """Area under the ROC curve from tie-averaged ranks; works on one row per distinct score."""
    counts = cumulative_counts(
        scored.where(F.col(label).isNotNull()), score, rows_per_bin, positives=F.sum(F.col(label).cast("long"))
    )
    rank = F.col("n_before") + (F.col("n") + 1) / 2
    pos = F.sum("positives")
    neg = F.sum("n") - pos
    return counts.agg(
        ((F.sum(F.col("positives") * rank) - pos * (pos + 1) / 2) / F.nullif(pos * neg, F.lit(0))).alias("roc_auc")
    )


def accuracy_metrics(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Row count, accuracy and base rate over rows with a known label."""
    known = scored.where(F.col(label).isNotNull())
    predicted = (F.col(score) > threshold).cast("int")
    return known.agg(
        F.count(F.lit(1)).alias("n"),
        F.avg((predicted == F.col(label)).cast("double")).alias("accuracy"),
        F.avg(F.col(label).cast("double")).alias("base_rate"),
    )


def class_report(scored: DataFrame, label: str, score: str, threshold: float = 0.5) -> DataFrame:
    """Precision, recall, F1 and support of each class."""
    predicted = (F.col(score) > threshold).cast("int")
    cells = (
        scored.where(F.col(label).isNotNull())
        .groupBy(F.col(label).cast("int").alias("actual"), predicted.alias("predicted"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    # Four rows at most: each contributes to the class it belongs to and the class it was given.
    sides = F.explode(F.array_distinct(F.array("actual", "predicted"))).alias("class")
    per_class = cells.select("actual", "predicted", "n", sides).groupBy("class").agg(
        F.sum(F.when((F.col("actual") == F.col("class")) & (F.col("predicted") == F.col("class")), F.col("n")).otherwise(0)).alias("hits"),
        F.sum(F.when(F.col("predicted") == F.col("class"), F.col("n")).otherwise(0)).alias("given"),
        F.sum(F.when(F.col("actual") == F.col("class"), F.col("n")).otherwise(0)).alias("support"),
    )
    zero = F.lit(0.0)
    return per_class.select(
        "class",
        F.coalesce(F.col("hits") / F.nullif(F.col("given"), F.lit(0)), zero).alias("precision"),
        F.coalesce(F.col("hits") / F.nullif(F.col("support"), F.lit(0)), zero).alias("recall"),
        F.coalesce(2 * F.col("hits") / F.nullif(F.col("given") + F.col("support"), F.lit(0)), zero).alias("f1"),
        "support",
    )


def r_squared(predictions: DataFrame, target: str, predicted: str) -> DataFrame:
    """1 - residual over total sum of squares, in one aggregate."""
    gap = F.col(target) - F.col(predicted)
    n = F.count(target)
    return predictions.agg(
        n.alias("n"), (1 - F.sum(gap * gap) / F.nullif(F.var_pop(target) * n, F.lit(0.0))).alias("r_squared")
    )
