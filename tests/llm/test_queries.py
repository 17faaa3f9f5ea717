import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grovewise.llm.registry import ORACLES, QUERIES
from oracle import compare

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ORACLES)
def test_oracle(spark, name):
    compare(spark, QUERIES[name], ORACLES[name], DATA)


def test_shards_of_documents(spark):
    out = QUERIES["op8_sharding"](spark, DATA)
    n = [r["count"] for r in out.groupBy("shard").count().collect()]
    assert len(n) == 40 and max(n) - min(n) <= 1
    d = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", (F.octet_length("text") + 16).alias("size"), F.crc32("text").alias("text_crc32"))
    assert out.select("doc_id", "size", "text_crc32").exceptAll(d.select(*(F.col(c).cast("long") for c in d.columns))).isEmpty()


def test_pipeline_stages(spark):
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    out = d
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, out = out, stage(spark, out, DATA)
        assert out.columns == d.columns and out.dtypes == d.dtypes
        assert out.join(before, "doc_id", "left_anti").isEmpty() and out.count() <= before.count(), name
    last = corpus_pipeline.STAGES[-1][1](spark, out, DATA)
    assert last.count() == out.count() and last.where("NOT lossless").isEmpty()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = d.join(labels.where("quality = 1"), "doc_id", "left_semi")
    first = corpus_pipeline.quality_rules(spark, d, DATA)
    assert first.join(good, "doc_id", "left_semi").count() > 0.9 * good.count()


def test_line_stage_drops_planted_boilerplate_and_passages(spark):
    """600 documents of a source: a license on 1 % of them and a passage on 8 documents go; lines on 4 documents, and the same license in a small source, stay."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = []
    for i in range(600):
        t = [f"own line {i}"] + ["All rights reserved."] * (i % 100 == 0) + [passage] * (10 <= i < 18) + ["on four"] * (i < 4)
        rows.append((i, "\n".join(t), "en", "s", sum(map(len, t)) + len(t) - 1))
    rows += [(700 + i, f"other {i}\nAll rights reserved.", "en", "small", 28) for i in range(3)] + [(800, None, "en", "s", 0)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r.doc_id: r for r in corpus_pipeline.line_dedup(spark, d, DATA).collect()}
    for i, t, _, source, _ in rows:
        want = t if t is None or source == "small" else "\n".join(x for x in t.split("\n") if x not in ("All rights reserved.", passage))
        assert out[i].text == want and out[i].n_chars == len(want or "")
