"""Archives: a folder of Parquet tables and a one-row meta table with format name and version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {"tables": 1, "dag": 4, "bp": 2, "sequence": 1}


def save(path: str, kind: str, tables: dict[str, DataFrame], **scalars: float) -> None:
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    meta = spark.range(1).select(F.lit(kind).alias("format"), F.lit(FORMATS[kind]).alias("version"), F.lit(",".join(tables)).alias("tables"), *(F.lit(float(v)).alias(k) for k, v in scalars.items()))
    meta.write.mode("overwrite").json(f"{path}/_meta.json.d".replace("/_meta", "/meta"))


def load(spark: SparkSession, path: str, kind: str) -> tuple[dict[str, DataFrame], dict]:
    """The tables and the meta row. Another format or version is an error."""
    meta = spark.read.json(f"{path}/meta.json.d").first().asDict()
    if meta["format"] != kind:
        raise ValueError(f"{path} holds {meta['format']}, not {kind}")
    if meta["version"] != FORMATS[kind]:
        raise ValueError(f"{path} has version {meta['version']}, this reads {FORMATS[kind]}")
    return {t: spark.read.parquet(f"{path}/{t}") for t in meta["tables"].split(",")}, meta
