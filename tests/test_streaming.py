"""Mutations as a stream: any cut into batches, a restart and a batch that runs twice give the counts of all at once."""

import pytest

from grovewise import Forest
from grovewise.operators import stats
from grovewise.streaming import ingest
from simulate import Simulated

RULES = ["sample_id < 2", "sample_id >= 2"]


@pytest.mark.parametrize("layout", ["dag", "tree"])
def test_batches_and_restarts(spark, tmp_path, layout):
    sim = Simulated(5, 6, 3)
    f = Forest(sim.mutated(spark, 25, 3), layout)
    m = f.seq_mutations.collect()
    path = lambda x: str(tmp_path / x)
    put = lambda rows: spark.createDataFrame(rows, f.seq_mutations.schema).coalesce(1).write.mode("append").parquet(path("in"))
    start = lambda: ingest.ingest(f, RULES, spark.readStream.schema(ingest.MUTATIONS).option("maxFilesPerTrigger", 1).parquet(path("in")), path("moves"), path("progress")).trigger(availableNow=True).start().awaitTermination()
    put(m[::3]), put(m[1::3])
    start()
    put(m[2::3])
    start()  # goes on where it ended
    want = sorted(map(tuple, f.allele_counts(RULES).collect()))
    assert sorted(map(tuple, ingest.allele_counts(f, RULES, path("moves")).collect())) == want
    spark.read.parquet(path("moves")).where("batch = 1").drop("batch").write.mode("overwrite").parquet(path("again"))
    spark.read.parquet(path("again")).write.mode("overwrite").parquet(path("moves/batch=1"))  # a batch that runs again
    got = ingest.allele_counts(f, RULES, path("moves"))
    assert sorted(map(tuple, got.collect())) == want and len({r.batch for r in spark.read.parquet(path("moves")).select("batch").distinct().collect()}) == 3
    assert stats.divergence(got, 2, 3).first()[0] == pytest.approx(f.divergence(*RULES).first()[0])


def test_bare_samples_count(spark):
    """A mutation on a sample without edges is its own sample's, in a batch as in the whole."""
    from grovewise.sources.text import tables_from_text

    t = tables_from_text(spark, 10, "1 0\n1 0\n1 0\n0 1", "0 10 3 0,1", "5 A", "0 2 T")
    f = Forest(t)
    got = {(r.site_id, r.state): (r.n_0, r.n_1) for r in ingest.batch_moves(f, RULES, f.seq_mutations).collect()}
    assert got == {(0, "T"): (0, 1), (0, "A"): (0, -1)}
    assert {(r.state, r.n_0) for r in f.allele_counts(["true"]).collect()} == {("A", 2), ("T", 1)}
