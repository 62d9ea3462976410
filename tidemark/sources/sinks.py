"""File writers."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_partitioned(df: DataFrame, path: str, *by: str, dynamic: bool = True) -> None:
    """Parquet partitioned by columns; with ``dynamic`` only the partitions present in ``df`` are replaced.

    Rows of a partition value are gathered first, so each value gets few files; adaptive execution splits a
    value that holds a large share of the rows.
    """
    mode = "dynamic" if dynamic else "static"
    gathered = df.hint("rebalance", *by)
    gathered.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_evaluation(summary: DataFrame, per_question: DataFrame, folder: str) -> None:
    """One summary row and one row per question, side by side."""
    write_json(summary, f"{folder}/summary")
    write_json(per_question, f"{folder}/questions")


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
