"""New mutations against a static forest: every statistic is a sum over sites, and a site's counts are sums over its mutations.

A batch's mutations become signed counts by site and state, which are written to a folder of the batch's own number. A batch that is
run again, after a restart or a lost driver, writes the same folder anew, so each counts once; batches may come in any order and
cut the stream anywhere, as the counts are sums. Reading adds up what there is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from grovewise.forest import Forest, Rule
from grovewise.operators import frequencies, sequence

#: Of a stream of mutations with their states, as `Forest.seq_mutations` has them.
MUTATIONS = "mutation_id BIGINT, site_id BIGINT, tree_id BIGINT, node BIGINT, parent_state STRING, derived_state STRING"


def batch_moves(forest: Forest, rules: list[Rule], mutations: DataFrame) -> DataFrame:
    """(site_id, state, n_0, ...) of some mutations; those on nodes without edges count as the sample that they are on."""
    m, by = mutations, ("tree_id", "node")
    if forest.layout != "tree":
        m, by = sequence.to_forest_nodes(mutations, forest.forest_spans, forest.chunk_size, optional=True), ("forest_node",)
    return frequencies.moves(m, forest.counts(rules), forest.lanes(rules), by)


def ingest(forest: Forest, rules: list[Rule], mutations: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """A writer that keeps the sets' counts under `folder` up with a stream of mutations, each of which the source gives once; set a trigger and start it.

    Mutations may arrive late, in any order: each carries the state that it changes. Both folders are shared ones; a stream that is started again with them goes on."""

    def keep(batch: DataFrame, number: int) -> None:
        batch_moves(forest, rules, batch).coalesce(batch.sparkSession.sparkContext.defaultParallelism).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    forest.counts(rules)  # once, before the first batch
    return mutations.writeStream.foreachBatch(keep).option("checkpointLocation", checkpoint)


def allele_counts(forest: Forest, rules: list[Rule], folder: str) -> DataFrame:
    """The counts that `Forest.allele_counts` gives for all mutations that have been ingested; statistics take them alike."""
    lanes = forest.lanes(rules)
    schema = "site_id BIGINT, state STRING, batch BIGINT, " + ", ".join(f"n_{i} BIGINT" for i in range(len(rules)))
    return frequencies.counted(forest.tables.sites, lanes.sparkSession.read.schema(schema).parquet(folder), lanes)
