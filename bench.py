"""Times the headline queries: python bench.py prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times (1 by default); its figure is the median. Loading (edges by ranges of trees, mutations) and
compression (subtrees, DAG, mutations on its nodes) are timed by themselves, once and cold, and kept, as statistics are asked of a forest that has been compressed. All else
is made anew in each run: counts below nodes and what follows; for queries in MAKES, the compression, too.
"""

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS, RUNS = os.environ.get("BENCH_CPUS", "8"), int(os.environ.get("BENCH_RUNS", "1"))
#: What a forest may keep from one run to the next.
LOADED = {"tables", "layout", "_below", "samples", "num_samples", "breakpoints", "pieces", "chunk_size", "trees", "site_tree", "seq_mutations"}
#: What a compressed forest keeps besides, and the queries that time it.
COMPRESSED = {"subtrees", "node_spans", "dag_edges", "forest_spans", "forest_edges", "forest_mutations"}
MAKES = {"unique_subtrees", "bp_tokens", "diversity_on_bp"}
HEADLINE = ["diversity", "diversity_by_set", "divergence", "segregating_sites", "afs", "tajimas_d", "fst", "f2", "f3", "f4", "lca_pairwise", "lca_every_nth", "samples_below", "samples_below_dag", "allele_counts", "unique_subtrees", "bp_tokens", "diversity_on_bp", "bench_summary", "speedup"]


def main() -> None:
    spark = SparkSession.builder.master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from grovewise.plans.queries import QUERIES, forest

    out = {}
    began = time.perf_counter()
    f = forest(spark, SF)
    f.seq_mutations.count(), f.pieces.edges.count()
    out["load_forest"] = time.perf_counter() - began
    began = time.perf_counter()
    f.dag_edges.count(), f.forest_mutations.count()
    out["compress_forest"] = time.perf_counter() - began
    for name in HEADLINE:
        times = []
        for _ in range(1 + RUNS):
            for layout in ("tree", "dag", "bp"):
                f = forest(spark, SF, layout)
                f._below.clear()
                for k in set(f.__dict__) - LOADED - (COMPRESSED if name not in MAKES else set()):
                    del f.__dict__[k]
            began = time.perf_counter()
            QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        out[name] = median(times[1:])
    print(json.dumps({"metric": "headline queries, total wall time", "value": round(sum(out.values()), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in out.items()}, "sf": SF}))
    spark.stop()


if __name__ == "__main__":
    main()
