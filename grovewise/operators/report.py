"""Reporting queries over long benchmark results and dataset statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Model constants, bytes: an edge with its interval, an edge of the DAG, a mutation, a site.
EDGE_BYTES, DAG_EDGE_BYTES, MUTATION_BYTES, SITE_BYTES = 16.0, 8.0, 8.5, 0.25


def summary(results: DataFrame, by: list[str], value: str = "value") -> DataFrame:
    """Robust summary per group: median, min, max, q10, q90, sd, range."""
    v = F.col(value)
    q = lambda p: F.percentile(v, F.lit(p))
    return results.groupBy(*by).agg(q(0.5).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"), q(0.1).alias("q10"), q(0.9).alias("q90"), F.stddev(v).alias("sd"), (F.max(v) - F.min(v)).alias("range"))


def walltime_summary(results: DataFrame) -> DataFrame:
    return summary(results.where("variable = 'walltime'"), ["section", "variant", "collection", "chromosome", "variable"])


def speedup(summarised: DataFrame, reference: str) -> DataFrame:
    """The reference variant's median over each other variant's median, min, max, q10, q90; NULL where that is 0."""
    on = ["section", "collection", "chromosome", "variable"]
    ref = summarised.where(F.col("variant") == reference).select(*on, F.col("median").alias("_ref"))
    s = summarised.where(F.col("variant") != reference).join(ref, on)
    return s.select(*on, "variant", *((F.col("_ref") / F.nullif(F.col(c), F.lit(0.0))).alias(f"speedup_{c}") for c in ("median", "min", "max", "q10", "q90")))


def speedup_summary(speedups: DataFrame) -> DataFrame:
    """Per section, collection and variant: min, max and median speed-up, and the largest of a section's medians."""
    v = F.col("speedup_median")
    per = speedups.groupBy("section", "collection", "variant").agg(F.min(v).alias("min_speedup"), F.max(v).alias("max_speedup"), F.percentile(v, F.lit(0.5)).alias("median_speedup"))
    best = per.groupBy("section").agg(F.max("median_speedup").alias("best_median"))
    return per.join(best, "section")


def fraction_of_samples(sections: DataFrame, column: str = "section") -> DataFrame:
    """`fraction`: 1/n from section names that end in _<n>th; other rows are dropped."""
    n = F.regexp_extract(column, r"_(\d+)th$", 1)
    return sections.where(n != "").withColumn("fraction", 1.0 / n.cast("int"))


def dataset_wide(stats: DataFrame) -> DataFrame:
    """Long (collection, chromosome, variable, value) to wide, with the share of subtrees that are unique."""
    wide = stats.groupBy("collection", "chromosome").pivot("variable", ["num_edges", "num_trees", "num_unique_subtrees", "num_subtrees"]).agg(F.first("value"))
    return wide.withColumn("unique_share", F.col("num_unique_subtrees") / F.col("num_subtrees"))


def dataset_summary(wide: DataFrame, column: str, by: str = "collection") -> DataFrame:
    """min, median, max, mean, sd and geometric mean of one column per collection."""
    v = F.col(column)
    return wide.groupBy(by).agg(F.min(v).alias("min"), F.percentile(v, F.lit(0.5)).alias("median"), F.max(v).alias("max"), F.avg(v).alias("mean"), F.stddev(v).alias("sd"), F.exp(F.avg(F.log(v))).alias("geometric_mean"))


def storage_model(stats: DataFrame) -> DataFrame:
    """MiB by collection: interval-stamped edges against DAG edges, and the sequence."""
    mib = lambda x: x / (1024.0 * 1024.0)
    return stats.groupBy("collection").agg(
        mib(F.sum("num_edges") * EDGE_BYTES).alias("edges_mib"), mib(F.sum("num_dag_edges") * DAG_EDGE_BYTES).alias("dag_edges_mib"), mib(F.sum("num_mutations") * MUTATION_BYTES + F.sum("num_sites") * SITE_BYTES).alias("sequence_mib")
    )


def distribution(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Box-plot figures: quartiles and whisker ends."""
    q = F.percentile(column, F.array(*(F.lit(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0))))
    return df.groupBy(*by).agg(q.alias("q")).select(*by, *(F.col("q")[i].alias(n) for i, n in enumerate(("lowest", "q25", "q50", "q75", "highest"))))


def is_unique(df: DataFrame, column: str) -> DataFrame:
    return df.agg((F.count(column) == F.count_distinct(column)).alias("ok"))


def close(a: Column, b: Column, tolerance: float = 1e-4) -> Column:
    """Relative comparison of two statistics."""
    return F.abs(a - b) <= tolerance * F.greatest(F.abs(a), F.abs(b))
