"""One query per reference operator, over the adapter's tree sequence."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.forest import Forest
from grovewise.functions.scalar import dna_index
from grovewise.operators import bp, frequencies, graph, report, samples, sequence, stats, trees
from grovewise.plans.lineage import checkpoint_dir
from grovewise.sources import adapter, results
from grovewise.streaming import ingest

S2 = [f"sample_id % 2 = {i}" for i in range(2)]
S3 = [f"sample_id % 3 = {i}" for i in range(3)]
S4 = [f"sample_id % 4 = {i}" for i in range(4)]

_forests: dict[tuple, Forest] = {}


def forest(spark: SparkSession, sf_dir: str, layout: str = "dag") -> Forest:
    """A forest is loaded once per session and input, and answers many queries."""
    key = (spark.sparkContext.applicationId, sf_dir, layout)
    if key not in _forests:
        _forests[key] = Forest(adapter.adapter(spark, sf_dir), layout)
    return _forests[key]


def _rounded(df: DataFrame, *cols: str, digits: int = 9) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) for c in cols))


def _round_all(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _by_set(f: Forest) -> DataFrame:
    c, n = f.allele_counts(S2), f.set_sizes(S2)
    each = [stats.diversity(c, n[i], f"n_{i}").select(F.lit(f"S2_{i}").alias("set_id"), F.round("diversity", 9).alias("diversity")) for i in range(2)]
    return each[0].unionByName(each[1])


def _frequencies(f: Forest) -> DataFrame:
    text = F.array_join(F.transform(F.map_entries("counts"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return f.allele_frequencies().select("site_id", "kind", "num_ancestral", text.alias("counts"))


def _dag_counts(f: Forest) -> DataFrame:
    n = lambda df, c: df.agg(F.count("*").alias(c))
    return n(f.dag_edges, "num_edges").join(n(f.graph_nodes(), "num_nodes"), F.lit(True)).join(n(f.dag_roots, "num_roots"), F.lit(True)).join(n(f.samples, "num_leaves"), F.lit(True))


def _postorder_check(f: Forest) -> DataFrame:
    leaves = f.samples.select(F.col("sample_id").alias("node"))
    bad = graph.postorder_violations(f.dag_edges, f.graph_nodes(), leaves).agg(F.count("*").alias("violations"))
    return bad.join(graph.edges_are_sorted(f.dag_edges, "parent").select(F.col("ok").alias("sorted")), F.lit(True))


def _round_trip(spark: SparkSession, f: Forest, sf_dir: str) -> DataFrame:
    path = f"{checkpoint_dir(spark)}/archive-{spark.sparkContext.applicationId}-{abs(hash(sf_dir))}"
    f.save(path)
    return Forest.load(spark, path).tables.edges.select("left", "right", "parent", "child")


def _stats(spark: SparkSession, d: str) -> DataFrame:
    """File statistics with collection and chromosome read from the file name."""
    return results.from_filename(adapter.file_stats(spark, d))


def _wide(spark: SparkSession, d: str) -> DataFrame:
    s = _stats(spark, d)
    pairs = (("num_edges", "num_edges"), ("num_trees", "num_sites"), ("num_unique_subtrees", "num_dag_edges"))
    values = F.array(*(F.struct(F.lit(k).alias("variable"), F.col(c).cast("double").alias("value")) for k, c in pairs), F.struct(F.lit("num_subtrees").alias("variable"), (F.col("num_edges") + F.col("num_dag_edges")).cast("double").alias("value")))
    return _round_all(report.dataset_wide(s.select("collection", "chromosome", F.explode(values).alias("v")).select("collection", "chromosome", "v.*")), 9)


def _bench(spark: SparkSession, d: str) -> DataFrame:
    return report.walltime_summary(adapter.bench_results(spark, d))


def _fractions(spark: SparkSession, d: str) -> DataFrame:
    s = report.speedup(report.walltime_summary(adapter.lca_results(spark, d)), "0")
    return _round_all(report.fraction_of_samples(s))


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    """The mutations as a stream of files, a file a batch, and the counts that are kept up with it."""
    f = forest(spark, d)
    here = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    f.seq_mutations.repartition(3).write.parquet(f"{here}/mutations")
    stream = spark.readStream.schema(ingest.MUTATIONS).option("maxFilesPerTrigger", 1).parquet(f"{here}/mutations")
    ingest.ingest(f, S2, stream, f"{here}/moves", f"{here}/progress").trigger(availableNow=True).start().awaitTermination()
    return ingest.allele_counts(f, S2, f"{here}/moves")


_F: dict[str, Callable[[Forest], DataFrame]] = {
    "trees": lambda f: f.trees,
    "edges": lambda f: f.tables.edges,
    "tree_edges": lambda f: f.tree_edges,
    "site_to_tree": lambda f: f.site_tree,
    "tree_roots": lambda f: f.roots,
    "node_summary": lambda f: trees.node_summary(f.tree_edges),
    "children": lambda f: trees.children(f.tree_edges),
    "mutation_parent_state": lambda f: f.seq_mutations,
    "mutation_ranges": lambda f: sequence.mutation_ranges(f.tables.mutations),
    "ancestral_states": lambda f: f.tables.sites.select("site_id", "ancestral_state", dna_index(F.col("ancestral_state")).alias("state_index")),
    "samples_below_multi": lambda f: f.samples_below(S4),
    "samples_below_bp": lambda f: f.samples_below_bp(["true"]).groupBy("n_0").agg(F.count("*").alias("num_nodes")),
    "allele_counts": lambda f: f.allele_counts(S2),
    "invalid_sites": lambda f: frequencies.invalid_sites(f.allele_counts(S2), f.lanes(S2)),
    "site_kind": lambda f: f.site_kind(),
    "allele_frequencies": _frequencies,
    "diversity": lambda f: _rounded(f.diversity(), "diversity"),
    "diversity_by_set": _by_set,
    "divergence": lambda f: _rounded(f.divergence(*S2), "divergence"),
    "segregating_sites": lambda f: f.segregating_sites(),
    "afs": lambda f: f.afs(),
    "tajimas_d": lambda f: _rounded(f.tajimas_d(), "tajimas_d"),
    "tajimas_d_as_fold": lambda f: _rounded(f.fold(["true"], stats.tajimas_fold(f.num_samples)), "tajimas_d"),
    "fst": lambda f: _rounded(f.fst(*S2), "fst"),
    "f2": lambda f: _rounded(f.f2(*S2), "f2"),
    "f3": lambda f: _rounded(f.f3(*S3), "f3"),
    "f4": lambda f: _rounded(f.f4(*S4), "f4"),
    "lca_pairwise": lambda f: f.lca_pair(0, 1),
    "lca_every_nth": lambda f: f.lca("sample_id % 10 = 0"),
    "subtrees_with_mutations": lambda f: f.subtrees_with_mutations().agg(F.count("*").alias("num_subtrees")),
    "unique_subtrees": lambda f: f.unique_subtrees(),
    "dag_counts": _dag_counts,
    "node_map": lambda f: f.node_map.select("tree_id", "ts_node", "forest_node", "is_root", "height", "created"),
    "dag_edges": lambda f: f.dag_edges,
    "dag_neighbours": lambda f: graph.adjacency(f.dag_edges).select("node", F.size("neighbours").cast("long").alias("num_children"), (F.size("neighbours") - F.size(F.array_distinct("neighbours"))).cast("long").alias("repeated")),
    "allele_frequencies_of_sets": lambda f: f.allele_frequencies(*S2).select("site_id", "num_ancestral_0", "num_ancestral_1"),
    "adjacency": lambda f: graph.adjacency(f.tree_edges, "tree_id").select("tree_id", "node", F.array_join(F.col("neighbours").cast("array<string>"), ",").alias("neighbours")),
    "duplicate_edges": lambda f: graph.duplicate_edges(f.tree_edges),
    "postorder_violations": _postorder_check,
    "sample_set_inverse": lambda f: samples.inverse(samples.sample_sets(f.samples, samples.round_robin(3)), f.samples),
    "sample_set_sizes": lambda f: samples.popcount(samples.sample_sets(f.samples, samples.round_robin(4))),
    "invalidated_nodes": lambda f: f.invalidated_nodes(),
    "eulertour": lambda f: f.eulertour(),
    "postorder": lambda f: f.postorder(),
    "bp_tokens": lambda f: f.bp_tokens,
    "bp_references": lambda f: bp.references(f.bp_tokens),
    "dataset_stats": lambda f: f.stats(),
    "violations": lambda f: f.violations(),
}

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    **{k: (lambda s, d, q=q: q(forest(s, d))) for k, q in _F.items()},
    "samples_below": lambda s, d: forest(s, d, "tree").samples_below(S2).select("tree_id", "node", "n_0", "n_1"),
    "samples_below_dag": lambda s, d: forest(s, d).samples_below(S2).select("tree_id", "node", "n_0", "n_1"),
    "archive_round_trip": lambda s, d: _round_trip(s, forest(s, d), d),
    "bench_summary": lambda s, d: _round_all(_bench(s, d)),
    "speedup": lambda s, d: _round_all(report.speedup(_bench(s, d), "0")),
    "speedup_summary": lambda s, d: _round_all(report.speedup_summary(report.speedup(_bench(s, d), "0"))),
    "lca_fractions": _fractions,
    "streamed_allele_counts": _streamed,
    "diversity_on_bp": lambda s, d: _rounded(forest(s, d, "bp").diversity(), "diversity"),
    "lca_on_bp": lambda s, d: forest(s, d, "bp").lca("sample_id % 10 = 0"),
    "storage_model": lambda s, d: _round_all(report.storage_model(_stats(s, d)), 9),
    "dataset_summary": lambda s, d: _round_all(report.dataset_summary(_stats(s, d).withColumn("num_edges", F.col("num_edges").cast("double")), "num_edges")),
    "dataset_wide": _wide,
    "distribution": lambda s, d: report.distribution(_stats(s, d).withColumn("num_edges", F.col("num_edges").cast("double")), "num_edges", ["collection"]),
    "filenames_unique": lambda s, d: report.is_unique(_stats(s, d), "filename"),
}
