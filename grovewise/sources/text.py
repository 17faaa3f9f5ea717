"""Whitespace-separated text tables, one record a line, as used for small fixtures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from grovewise.model import TreeTables


def _rows(spark: SparkSession, text: str, fields: int) -> DataFrame:
    """(line, f): non-blank lines split at white space; missing trailing fields are NULL."""
    lines = [(i, x.strip()) for i, x in enumerate(x for x in text.split("\n") if x.strip())]
    df = spark.createDataFrame(lines, "line INT, raw STRING").withColumn("f", F.split("raw", r"\s+"))
    return df.select("line", *(F.try_element_at("f", F.lit(i + 1)).alias(f"f{i}") for i in range(fields)))


def tables_from_text(spark: SparkSession, sequence_length: float, nodes: str, edges: str, sites: str = "", mutations: str = "", individuals: str = "", migrations: str = "") -> TreeTables:
    """nodes: is_sample time [population [individual]]; edges: left right parent child[,child...]; sites: position state;
    mutations: site node state [parent [time]]; individuals: flags [location,... [parents,...]]; migrations: left right node
    source dest time. Ids are line numbers; -1 and - are NULL."""
    null = lambda c, kind: F.when(~F.col(c).isin("-1", "-"), F.col(c)).cast(kind)
    n = _rows(spark, nodes, 4).select(F.col("line").cast("long").alias("node_id"), (F.col("f0") == "1").alias("is_sample"), F.col("f1").cast("double").alias("time"), null("f2", "int").alias("population"), null("f3", "int").alias("individual"))
    e = _rows(spark, edges, 4).select(F.col("f0").cast("double").alias("left"), F.col("f1").cast("double").alias("right"), F.col("f2").cast("long").alias("parent"), F.explode(F.split("f3", ",").cast("array<bigint>")).alias("child"))
    s = _rows(spark, sites, 2).select(F.col("line").cast("long").alias("line"), F.col("f0").cast("double").alias("position"), F.col("f1").alias("ancestral_state"))
    s = s.withColumn("site_id", (F.row_number().over(W.orderBy("position", "line")) - 1).cast("long"))
    renamed = s.select(F.col("line").alias("_site"), "site_id")  # mutations name their site by its line
    s = s.select("site_id", "position", "ancestral_state")
    m = _rows(spark, mutations, 5).select(F.col("line").cast("long").alias("mutation_id"), F.col("f0").cast("long").alias("_site"), F.col("f1").cast("long").alias("node"), F.col("f2").alias("derived_state"), null("f3", "long").alias("parent"), F.col("f4").try_cast("double").alias("time"))
    m = m.join(renamed, "_site", "left").select("mutation_id", "site_id", "node", "derived_state", "parent", "time")
    numbers = lambda c, kind: F.transform(F.filter(F.split(c, ","), lambda x: ~x.isin("", "-")), lambda x: x.cast(kind))
    i = _rows(spark, individuals, 3).select(F.col("line").alias("individual_id"), F.col("f0").cast("int").alias("flags"), numbers("f1", "double").alias("location"), numbers("f2", "int").alias("parents"))
    g = _rows(spark, migrations, 6).select(*(F.col(f"f{k}").cast(t).alias(c) for k, (c, t) in enumerate((("left", "double"), ("right", "double"), ("node", "int"), ("source", "int"), ("dest", "int"), ("time", "double")))))
    return TreeTables(n, e, s, m, float(sequence_length), i, g)
