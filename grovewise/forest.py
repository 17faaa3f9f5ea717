"""The facade: a forest of trees, its sequence, and the queries on them.

Tables are lazy but for what needs rounds or dense ids (breakpoints, edges by ranges of trees, subtrees, DAG and parentheses, counts), which
runs when first asked for, is cut from its lineage and kept for the life of the object.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.model import TreeTables, violations
from grovewise.operators import bp, compress, folds, frequencies, graph, samples, sequence, spans, stats, trees
from grovewise.plans.lineage import cut
from grovewise.sources import archive, treefile

#: A sample set is a boolean over sample_id, as SQL text or as a column.
Rule = Column | str
ALL = "true"
LAYOUTS = ("dag", "bp", "tree")


class Forest:
    """layout 'dag' counts every distinct subtree once; 'bp' counts on the edges that the parentheses spell; 'tree' counts on the edges of each tree."""

    def __init__(self, tables: TreeTables, layout: str = "dag"):
        if layout not in LAYOUTS:
            raise ValueError(f"unknown layout {layout}")
        self.tables, self.layout, self._below = tables, layout, {}

    from_tables = classmethod(lambda cls, *a, **b: cls(TreeTables(*a, **b)))

    @classmethod
    def from_file(cls, spark: SparkSession, path: str, layout: str = "dag") -> Forest:
        """A forest from a binary tree file."""
        return cls(treefile.tables_from_file(spark, path), layout)

    def save(self, path: str) -> None:
        t = self.tables
        archive.save(path, "tables", {"nodes": t.nodes, "edges": t.edges, "sites": t.sites, "mutations": t.mutations}, sequence_length=t.sequence_length)

    @classmethod
    def load(cls, spark: SparkSession, path: str, layout: str = "dag") -> Forest:
        t, meta = archive.load(spark, path, "tables")
        return cls(TreeTables(t["nodes"], t["edges"], t["sites"], t["mutations"], meta["sequence_length"]), layout)

    @staticmethod
    def load_dag(spark: SparkSession, path: str) -> dict[str, DataFrame]:
        """dag_edges, dag_roots and node_spans as saved, and chunk_size, the trees of a chunk of the latter."""
        tables, meta = archive.load(spark, path, "dag")
        return {**tables, "chunk_size": int(meta["chunk_size"])}

    @staticmethod
    def load_bp(spark: SparkSession, path: str) -> dict[str, DataFrame]:
        """bp_tokens and bp_spans as saved, and chunk_size."""
        tables, meta = archive.load(spark, path, "bp")
        return {**tables, "chunk_size": int(meta["chunk_size"])}

    @staticmethod
    def load_sequence(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
        """Sites and the mutations with their states."""
        t = archive.load(spark, path, "sequence")[0]
        return t["sites"], t["seq_mutations"]

    @classmethod
    def load_compressed(cls, spark: SparkSession, path: str, forest: str, seq: str | None = None, layout: str = "dag") -> Forest:
        """A forest with the layout 'dag' or 'bp' whose compression, and sequence, are read instead of made: path holds its tables."""
        f = cls.load(spark, path, layout)
        f.__dict__.update({"dag": cls.load_dag, "bp": cls.load_bp}[layout](spark, forest))
        if seq:
            f.__dict__["seq_mutations"] = cls.load_sequence(spark, seq)[1]
        return f

    def fold_sites(self, rule: Rule, merge: Callable[[Column], Column], name: str) -> DataFrame:
        """(site_id, name): a user's fold over each site's allele counts, an array of (state, is_ancestral, n) in order of states."""
        c = self.allele_counts([rule]).withColumnRenamed("n_0", "n")
        listed = c.groupBy("site_id").agg(F.array_sort(F.collect_list(F.struct("state", "is_ancestral", "n"))).alias("counts"))
        return listed.select("site_id", merge(F.col("counts")).alias(name))

    def fold(self, rules: list[Rule], by: folds.Fold) -> DataFrame:
        """One row: a user's fold over the allele counts (site_id, state, is_ancestral, n_0, ...) of all sites, combined before it is shuffled."""
        return folds.fold(self.allele_counts(rules), by)

    def save_dag(self, path: str) -> None:
        archive.save(path, "dag", {"dag_edges": self.dag_edges, "dag_roots": self.dag_roots, "node_spans": self.node_spans}, chunk_size=self.chunk_size)

    def save_bp(self, path: str) -> None:
        archive.save(path, "bp", {"bp_tokens": self.bp_tokens, "bp_spans": self.bp_spans}, chunk_size=self.chunk_size)

    def save_sequence(self, path: str) -> None:
        archive.save(path, "sequence", {"sites": self.tables.sites, "seq_mutations": self.seq_mutations})

    @cached_property
    def samples(self) -> DataFrame:
        return self.tables.nodes.where("is_sample").select(F.col("node_id").alias("sample_id"))

    @cached_property
    def num_samples(self) -> int:
        return self.samples.count()

    @cached_property
    def breakpoints(self) -> DataFrame:
        return cut(trees.breakpoints(self.tables.edges))

    @cached_property
    def trees(self) -> DataFrame:
        return trees.trees(self.breakpoints)

    @cached_property
    def pieces(self) -> spans.Pieces:
        """Edges by ranges of trees."""
        return spans.pieces(self.tables.edges, self.breakpoints)

    @cached_property
    def chunk_size(self) -> int:
        return self.pieces.size

    @cached_property
    def tree_edges(self) -> DataFrame:
        """Edges tree by tree; only the layout 'tree' and what asks for trees themselves needs them."""
        return trees.tree_edges(self.pieces.edges)

    @cached_property
    def site_tree(self) -> DataFrame:
        return trees.site_to_tree(self.tables.sites, self.trees, self.tables.sequence_length)

    @cached_property
    def coverage(self) -> DataFrame:
        return cut(spans.coverage(self.pieces))

    @cached_property
    def roots(self) -> DataFrame:
        return trees.roots(self.coverage)

    @cached_property
    def seq_mutations(self) -> DataFrame:
        return cut(sequence.seq_mutations(self.tables.sites, self.tables.mutations, self.site_tree))

    @cached_property
    def subtrees(self) -> DataFrame:
        """The versions of every node's subtree."""
        return spans.subtrees(self.pieces, self.samples)

    @cached_property
    def hashes(self) -> DataFrame:
        return compress.subtree_hashes(self.subtrees)

    @cached_property
    def node_spans(self) -> DataFrame:
        return cut(compress.node_spans(self.subtrees, self.samples, self.chunk_size))

    @cached_property
    def node_map(self) -> DataFrame:
        return compress.node_map(self.node_spans)

    @cached_property
    def dag_edges(self) -> DataFrame:
        return compress.dag_edges(self.node_spans, self.chunk_size)

    @cached_property
    def dag_roots(self) -> DataFrame:
        return compress.dag_roots(self.node_spans)

    @cached_property
    def bp_pairs(self) -> DataFrame:
        return bp.pairs(self.subtrees, self.samples, self.chunk_size)

    @cached_property
    def bp_tokens(self) -> DataFrame:
        return bp.tokens(self.bp_pairs)

    @cached_property
    def bp_spans(self) -> DataFrame:
        """Which pair stands for a node, by ranges of trees."""
        return cut(bp.spans(self.bp_pairs, self.subtrees))

    @cached_property
    def forest_spans(self) -> DataFrame:
        """(chunk, node, first, last, forest_node, height, ...) of the layout's own nodes."""
        return self.bp_spans if self.layout == "bp" else self.node_spans

    @cached_property
    def forest_edges(self) -> DataFrame:
        """(parent, child) of the layout's own nodes."""
        return cut(bp.decode(self.bp_tokens)) if self.layout == "bp" else self.dag_edges.select("parent", "child")

    @cached_property
    def forest_mutations(self) -> DataFrame:
        """Mutations with the forest node that they are on; NULL on a node without edges."""
        return cut(sequence.to_forest_nodes(self.seq_mutations, self.forest_spans, self.chunk_size, optional=True))

    def lanes(self, rules: list[Rule]) -> DataFrame:
        return samples.lanes(self.samples, [F.expr(r) if isinstance(r, str) else r for r in rules])

    def set_sizes(self, rules: list[Rule]) -> list[int]:
        n = self.lanes(rules).agg(*(F.coalesce(F.sum(f"n_{i}"), F.lit(0)) for i in range(len(rules)))).first()
        return [int(x) for x in n]

    def counts(self, rules: list[Rule]) -> DataFrame:
        """(forest_node, n_0, ..., height): each node of the layout's graph with its samples of each set; of the layout 'tree', (tree_id, node, ...)."""
        key = str(rules)
        if key not in self._below:
            lanes = self.lanes(rules)
            if self.layout == "tree":
                self._below[key] = cut(samples.samples_below(self.tree_edges, lanes))
            else:
                self._below[key] = cut(samples.samples_below(self.forest_edges, lanes, by=()).withColumnRenamed("node", "forest_node"))
        return self._below[key]

    def samples_below(self, rules: list[Rule]) -> DataFrame:
        """(tree_id, node, n_0, ..., height), tree by tree; rules are booleans over sample_id, one per set. Nodes without samples of any kind are left out."""
        if self.layout == "tree":
            return self.counts(rules)
        x = self.forest_spans.select("chunk", "node", "first", "last", "forest_node").join(self.counts(rules), "forest_node").drop("forest_node")
        return spans.per_tree(x)

    def samples_below_bp(self, rules: list[Rule]) -> DataFrame:
        """(bp_node, n_0, ..., height) from the edges that the parentheses spell."""
        return samples.samples_below(bp.decode(self.bp_tokens), self.lanes(rules), by=()).withColumnRenamed("node", "bp_node")

    def _mutations(self) -> tuple[DataFrame, tuple[str, ...]]:
        return (self.seq_mutations, ("tree_id", "node")) if self.layout == "tree" else (self.forest_mutations, ("forest_node",))

    def allele_counts(self, rules: list[Rule]) -> DataFrame:
        """(site_id, state, is_ancestral, n_0, ...): each state's samples of one, two or more sets."""
        m, by = self._mutations()
        return frequencies.allele_counts(self.tables.sites, m, self.counts(rules), self.lanes(rules), by)

    def site_kind(self, rule: Rule = ALL) -> DataFrame:
        m, by = self._mutations()
        return frequencies.site_kind(self.tables.sites, m, self.counts([rule]), by=by)

    def allele_frequencies(self, *rules: Rule) -> DataFrame:
        """(site_id, kind, num_ancestral, counts) of one set (all samples by default); of several, each set's columns end in its number."""
        rules = rules or (ALL,)
        if len(rules) == 1:
            return frequencies.allele_frequencies(self.allele_counts(list(rules)), self.site_kind(rules[0]))
        m, by = self._mutations()
        c, below = self.allele_counts(list(rules)), self.counts(list(rules))
        out = None
        for i in range(len(rules)):
            one = frequencies.allele_frequencies(c, frequencies.site_kind(self.tables.sites, m, below, f"n_{i}", by), f"n_{i}")
            one = one.select("site_id", *(F.col(x).alias(f"{x}_{i}") for x in ("kind", "num_ancestral", "counts")))
            out = one if out is None else out.join(one, "site_id")
        return out

    def _counted(self, rules: list[Rule], least: int = 1) -> tuple[DataFrame, list[int]]:
        n = self.set_sizes(rules)
        if min(n) < least:
            raise ValueError(f"each sample set needs at least {least} sample(s)")
        return self.allele_counts(rules), n

    def diversity(self, rule: Rule = ALL) -> DataFrame:
        c, (n,) = self._counted([rule])
        return stats.diversity(c, n)

    def divergence(self, a: Rule, b: Rule) -> DataFrame:
        c, n = self._counted([a, b])
        return stats.divergence(c, *n)

    def segregating_sites(self, rule: Rule = ALL) -> DataFrame:
        return stats.segregating_sites(self._counted([rule])[0])

    def afs(self, rule: Rule = ALL) -> DataFrame:
        c, (n,) = self._counted([rule])
        return stats.afs(c, n)

    def tajimas_d(self) -> DataFrame:
        c, (n,) = self._counted([ALL])
        return stats.tajimas_d(c, n)

    def fst(self, a: Rule, b: Rule) -> DataFrame:
        c, n = self._counted([a, b])
        return stats.fst(c, *n)

    def f2(self, a: Rule, b: Rule) -> DataFrame:
        c, n = self._counted([a, b], 2)
        return stats.f2(c, tuple(n))

    def f3(self, a: Rule, b: Rule, c: Rule) -> DataFrame:
        x, n = self._counted([a, b, c])
        if n[0] < 2:
            raise ValueError("the first sample set needs at least 2 samples")
        return stats.f3(x, tuple(n))

    def f4(self, a: Rule, b: Rule, c: Rule, d: Rule) -> DataFrame:
        x, n = self._counted([a, b, c, d])
        return stats.f4(x, tuple(n))

    def lca(self, rule: Rule) -> DataFrame:
        """(tree_id, node): only forest nodes above all of the set's samples are taken to their trees."""
        (n,) = self.set_sizes([rule])
        if self.layout == "tree" or n < 2:
            return trees.lca(self.counts([rule]), n) if self.layout == "tree" else self.trees.select("tree_id", F.lit(None).cast("long").alias("node"))
        above = self.counts([rule]).where(F.col("n_0") == n).select("forest_node", "n_0", "height")
        x = self.forest_spans.select("chunk", "node", "first", "last", "forest_node").join(above, "forest_node")
        return trees.lca(spans.per_tree(x), n)

    def lca_pair(self, u: int, v: int) -> DataFrame:
        return self.lca(F.col("sample_id").isin(u, v))

    def invalidated_nodes(self) -> DataFrame:
        return trees.invalidated_nodes(self.tables.edges, self.trees, self.pieces.edges, self.chunk_size)

    def eulertour(self) -> DataFrame:
        return trees.eulertour(self.tree_edges, self.tables.nodes.where("is_sample"))

    def postorder(self) -> DataFrame:
        return trees.postorder(self.tree_edges)

    def subtrees_with_mutations(self) -> DataFrame:
        """(forest_node): the distinct DAG nodes with a mutation."""
        return sequence.hit_forest_nodes(self.tables.mutated, self.site_tree, self.node_spans, self.chunk_size)

    def unique_subtrees(self) -> DataFrame:
        return compress.unique_subtrees(self.node_spans, self.samples)

    def graph_nodes(self) -> DataFrame:
        leaves = self.samples.select(F.col("sample_id").alias("node"))
        return graph.nodes(self.dag_edges, self.dag_roots, leaves)

    def violations(self) -> DataFrame:
        return violations(self.tables, self.coverage, self.roots)

    def stats(self) -> DataFrame:
        """(metric, value): cardinalities of the input and of both encodings. They are counted before anything is numbered, sorted or placed."""
        t = self.tables
        made = self.node_spans.where("created").select(F.col("forest_node").alias("node")).unionByName(self.samples.select(F.col("sample_id").alias("node")))
        count = lambda name, df: df.agg(F.lit(name).alias("metric"), F.count("*").cast("double").alias("value"))
        found = [
            count("num_nodes", t.nodes), count("num_edges", t.edges), count("num_sites", t.sites), count("num_mutations", t.mutated), count("num_trees", self.trees), count("num_samples", self.samples),
            self.coverage.agg(F.lit("num_subtrees").alias("metric"), F.coalesce(F.sum(F.col("last") - F.col("first")), F.lit(0)).cast("double").alias("value")), count("num_dag_edges", compress.dag_links(self.node_spans, self.chunk_size)), count("num_dag_nodes", made),
            count("num_unique_subtrees", self.subtrees.select("hi", "lo").distinct()), count("num_subtrees_with_mutations", self.subtrees_with_mutations()), count("num_bp_references", bp.written(self.subtrees, self.chunk_size).where("NOT new")),
        ]
        out = found[0]
        for x in found[1:]:
            out = out.unionByName(x)
        return out.unionByName(t.nodes.sparkSession.range(1).select(F.lit("sequence_length").alias("metric"), F.lit(t.sequence_length).alias("value")))
