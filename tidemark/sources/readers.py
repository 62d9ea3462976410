"""File readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.functions.dates import epoch_date
from tidemark.sources import schemas


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Typed CSV with a header; column names are checked against the schema."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)


def read_raw_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return (
        read_csv(spark, f"{folder}/customers.csv", schemas.CUSTOMERS),
        read_csv(spark, f"{folder}/transactions.csv", schemas.TRANSACTIONS),
    )


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Files that hold one JSON array, or one object, each. Missing optional keys become NULL."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_markdown_folder(spark: SparkSession, folder: str, glob: str = "*.md") -> DataFrame:
    """One row per file with its name and whole text; a folder without such files is an error."""
    files = spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True)
    if files.isEmpty():
        raise FileNotFoundError(f"no policy documents in {folder}")
    return files.select(F.col("_metadata.file_name").alias("source_file"), F.col("value").alias("body"))


def read_charts(spark: SparkSession, path: str) -> DataFrame:
    """Landed chart files to long prices: times and closes are zipped inside the row, epoch seconds become dates."""
    result = F.explode("chart.result").alias("r")
    point = F.explode(F.arrays_zip(F.col("r.timestamp").alias("t"), F.col("r.indicators.adjclose")[0]["adjclose"].alias("p"))).alias("x")
    return (
        spark.read.schema(schemas.CHART).option("multiLine", True).json(path)
        .select(result)
        .select(F.col("r.meta.symbol").alias("ticker"), point)
        .select(epoch_date(F.col("x.t")).alias("date"), "ticker", F.col("x.p").alias("price"))
        .where(F.col("price").isNotNull())
    )
