"""Benchmark results and dataset catalogues as CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = "section STRING, variant STRING, dataset STRING, revision STRING, machine_id STRING, iteration INT, variable STRING, value DOUBLE, unit STRING"


def write_results(df: DataFrame, path: str) -> None:
    """Long results; warm-up rows (negative or NULL iterations) are not written."""
    df.where("iteration >= 0").write.mode("overwrite").option("header", True).csv(path)


def collect_results(spark: SparkSession, paths: list[str]) -> DataFrame:
    """All results of several runs; folders that are missing or empty add nothing."""
    fs = spark._jvm.org.apache.hadoop.fs.Path
    there = [p for p in paths if (h := fs(p)).getFileSystem(spark._jsc.hadoopConfiguration()).exists(h)]
    return spark.read.schema(RESULTS).option("header", True).csv(there) if there else spark.createDataFrame([], RESULTS)


def catalogue(spark: SparkSession, path: str, collections: list[str] | None = None) -> DataFrame:
    df = spark.read.option("header", True).csv(path)
    return df.where(F.col("collection").isin(collections)) if collections else df


def from_filename(df: DataFrame, column: str = "filename") -> DataFrame:
    """`collection` and `chromosome` from names like <collection>_chr<k>.<extension>."""
    return df.withColumn("collection", F.regexp_extract(column, r"^([^_]+)_chr", 1)).withColumn("chromosome", F.regexp_extract(column, r"_chr(\d+)", 1).cast("int"))
