"""Compress, measure and describe forests from the command line, with long results as CSV.

    python -m grovewise.plans.commands compress  --source x.trees --folder out --results r [--dataset name --revision r --machine m]
    python -m grovewise.plans.commands benchmark --source x.trees --folder out --results r [--iterations 10 --warmup 1]
    python -m grovewise.plans.commands stats     --source x.trees --folder out --results r

A source is a binary tree file or a saved folder of tables; `compress` fills the folder that the others read. Spark evaluates late,
so what a section times is written to the no-op sink or to its folder in that section.
"""

from __future__ import annotations

import argparse
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.forest import Forest
from grovewise.operators.report import close
from grovewise.operators.samples import random_pairs
from grovewise.sources import results

PARTS = ("tables", "dag", "bp", "sequence")


def sets(k: int) -> list[str]:
    """Every sample in one of k sets, in turn."""
    return [f"sample_id % {k} = {i}" for i in range(k)]


#: What `benchmark` runs, and compares, on both layouts.
SECTIONS: dict[str, Callable[[Forest], DataFrame]] = {
    "afs": lambda f: f.afs(),
    "diversity": lambda f: f.diversity(),
    "num_segregating_sites": lambda f: f.segregating_sites(),
    "tajimas_d": lambda f: f.tajimas_d(),
    "divergence": lambda f: f.divergence(*sets(2)),
    "fst": lambda f: f.fst(*sets(2)),
    "f2": lambda f: f.f2(*sets(2)),
    "f3": lambda f: f.f3(*sets(3)),
    "f4": lambda f: f.f4(*sets(4)),
    **{f"lca_{n}th": (lambda f, n=n: f.lca(f"sample_id % {n} = 0")) for n in range(2, 11)},
}


class Recorder:
    """Long result rows of one dataset; times are in ns."""

    def __init__(self, dataset: str, revision: str = "undefined", machine: str = "undefined"):
        self.of, self.rows = (dataset, revision, machine), []

    def value(self, section: str, variant: str, variable: str, value: float, unit: str, iteration: int = 0) -> None:
        self.rows.append((section, variant, *self.of, iteration, variable, float(value), unit))

    @contextmanager
    def time(self, section: str, variant: str, iteration: int = 0) -> Iterator[None]:
        began = time.perf_counter_ns()
        yield
        self.value(section, variant, "walltime", time.perf_counter_ns() - began, "ns", iteration)

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, results.RESULTS)


def _run(*tables: DataFrame) -> None:
    for t in tables:
        t.write.format("noop").mode("overwrite").save()


def _alike(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row, `ok`: a statistic's first column is close in both, or tables by tree or by bin have the same rows."""
    first = a.columns[0]
    if first in ("tree_id", "num_derived"):
        return a.exceptAll(b).unionByName(b.exceptAll(a)).agg((F.count("*") == 0).alias("ok"))
    x, y = (df.select(F.col(first).cast("double").alias(c)) for df, c in ((a, "_a"), (b, "_b")))  # one row each
    same = F.col("_a").eqNullSafe(F.col("_b")) | F.coalesce(close(F.col("_a"), F.col("_b")), F.lit(False))
    return x.join(y, F.lit(True)).select(same.alias("ok"))


def opened(spark: SparkSession, source: str, layout: str = "dag") -> Forest:
    return Forest.from_file(spark, source, layout) if source.endswith(".trees") else Forest.load(spark, source, layout)


def compress(spark: SparkSession, record: Recorder, source: str, folder: str) -> Forest:
    """Reads a source and writes its tables, DAG, parentheses and sequence below the folder."""
    with record.time("load_trees_file", "tables"):
        f = opened(spark, source)
        t = f.tables
        _run(t.nodes, t.edges, t.sites, t.mutations)
    with record.time("compress_forest_and_sequence", "dag"):
        _run(f.dag_edges, f.seq_mutations)
    with record.time("compress_forest_and_sequence", "bp"):
        _run(f.bp_tokens)
    with record.time("save_forest_file", "dag"):
        f.save(f"{folder}/tables"), f.save_dag(f"{folder}/dag"), f.save_sequence(f"{folder}/sequence")
    with record.time("save_forest_file", "bp"):
        f.save_bp(f"{folder}/bp")
    return f


def _from_folder(spark: SparkSession, folder: str, layout: str = "dag") -> Forest:
    return Forest.load_compressed(spark, *(f"{folder}/{p}" for p in ("tables", layout, "sequence")), layout)


def benchmark(spark: SparkSession, record: Recorder, source: str, folder: str, iterations: int = 10, warmup: int = 1, seed: int = 0, sections: dict[str, Callable[[Forest], DataFrame]] = SECTIONS) -> DataFrame:
    """Times every section on a new forest of each layout in each iteration, and gives (section, ok): whether the layouts gave the same, a row for each layout but the first.

    Warm-up runs have negative iterations, which the writer of results leaves out."""
    checks = None
    for i in range(-warmup, iterations):
        forests = {}
        with record.time("load_trees_file", "tree", i):
            forests["tree"] = opened(spark, source, "tree")
            _run(forests["tree"].tables.edges, forests["tree"].tables.mutations)
        with record.time("load_forest_file", "dag", i):
            forests["dag"] = _from_folder(spark, folder)
            _run(forests["dag"].dag_edges, forests["dag"].seq_mutations)
        with record.time("load_forest_file", "bp", i):
            forests["bp"] = _from_folder(spark, folder, "bp")
            _run(forests["bp"].bp_tokens, forests["bp"].seq_mutations)
        pair = random_pairs(forests["tree"].samples, 1, seed + i + warmup).first()
        here = sections if pair is None else {**sections, "lca_pairwise": lambda f, p=pair: f.lca_pair(p.u, p.v)}
        for name, query in here.items():
            for variant, f in forests.items():
                with record.time(name, variant, i):
                    _run(query(f))
        if checks is None:
            for name, query in sections.items():
                first, *others = (query(f) for f in forests.values())
                for other in others:
                    ok = _alike(first, other).select(F.lit(name).alias("section"), "ok")
                    checks = ok if checks is None else checks.unionByName(ok)
    return checks if checks is not None else spark.createDataFrame([], "section STRING, ok BOOLEAN")


def stats(spark: SparkSession, record: Recorder, source: str, folder: str) -> None:
    """Cardinalities of the source and of both encodings; the numbers of trees and samples of each encoding come from its own tables."""
    f, dag, bp = opened(spark, source), _from_folder(spark, folder), Forest.load_bp(spark, f"{folder}/bp")["bp_tokens"]
    for r in f.stats().collect():
        record.value("stats", "all", r.metric, r.value, "1")
    n = bp.agg(F.count("*").alias("bits"), F.count_distinct("tree_id").alias("trees"), F.sum((F.col("is_leaf") & F.col("bp")).cast("long")).alias("leaves"), F.sum((F.col("is_ref") & F.col("bp")).cast("long")).alias("refs")).first()
    for variant, trees, samples in (("dag", dag.dag_roots.count(), dag.num_samples), ("bp", n.trees, n.leaves or 0)):
        record.value("stats", variant, "num_trees", trees, "1")
        record.value("stats", variant, "num_samples", samples, "1")
    record.value("stats", "dag", "num_edges", dag.dag_edges.count(), "1")
    for vector in ("bp", "is_ref", "is_leaf"):
        record.value("stats", "bp", f"{vector}_size", n.bits, "Bit")
    for table, rows in (("references", n.refs or 0), ("leaves", n.leaves or 0)):
        record.value("stats", "bp", f"{table}_size", 64 * rows, "Bit")


def mismatches(rows: DataFrame, variables: tuple[str, ...] = ("num_trees", "num_samples")) -> DataFrame:
    """(dataset, variable, least, most): counts that should be alike in all variants and are not."""
    per = rows.where(F.col("variable").isin(*variables)).groupBy("dataset", "variable").agg(F.min("value").alias("least"), F.max("value").alias("most"))
    return per.where("least <> most")


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser()
    p.add_argument("command", choices=["compress", "benchmark", "stats"])
    for name in ("source", "folder", "results"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--dataset")
    p.add_argument("--revision", default="undefined")
    p.add_argument("--machine", default="undefined")
    p.add_argument("--iterations", type=int, default=10)
    p.add_argument("--warmup", type=int, default=1)
    a = p.parse_args(args)
    spark = SparkSession.builder.getOrCreate()
    record = Recorder(a.dataset or a.source, a.revision, a.machine)
    if a.command == "compress":
        compress(spark, record, a.source, a.folder)
    elif a.command == "benchmark":
        benchmark(spark, record, a.source, a.folder, a.iterations, a.warmup).where("NOT ok").show(truncate=False)
    else:
        stats(spark, record, a.source, a.folder)
        mismatches(record.frame(spark)).show(truncate=False)
    results.write_results(record.frame(spark), a.results)


if __name__ == "__main__":
    main()
