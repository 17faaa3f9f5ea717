"""A training corpus from raw documents: quality rules, line dedup, near-dedup, decontamination, encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.llm import decontaminate, lines, neardup, pieces, quality
from grovewise.llm.common import name_of, stored
from grovewise.llm.queries import tokenizer_path


#: The line stage: more than this share of a source's distinct texts, and this many of them at least. On sf0.1, with 493 to 499 texts
#: a source, license lines are on 0.6 to 0.8 % of all texts and the most frequent line on 9 to 13 % of each source; some lines of one or two words are on 1 %.
LINE_RATIO, LINE_DOCS = 0.002, 5


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or are outliers of their language and source, go."""
    return quality.kept(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that too many of a source's documents have go; documents stay, with n_chars of what is left."""
    out = lines.drop_boilerplate(docs, "source", "text", LINE_RATIO, LINE_DOCS, distinct=True)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(out.columns[-1]) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*map(name_of, docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return neardup.deduplicated(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All columns, each document's ids, their number, and whether they decode to the text."""
    x = pieces.encode(docs, pieces.Model.load(tokenizer_path("piece_bpe_32k.model")), check=True)
    return x.select(*map(name_of, docs.columns), "ids", F.size("ids").cast("long").alias("n_pieces"), "lossless")


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", encoding)]

#: The robust estimates of the first stage are not expressible in SQL; tests compare stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, f"stage-{i + 1}")
    return docs
