"""One query per operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grovewise.llm import binarycodes, centroids, chat, decontaminate, langid, lines, lm, neardup, pieces, quality, search, sharding, tokencount
from grovewise.llm.common import stored

SHARDS, TOKEN_LIMIT = 40, 512


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _fold(n: int) -> Column:
    """The remainder that splits rows into folds; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % n


def op1(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return quality.judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op2(spark: SparkSession, d: str) -> DataFrame:
    return lm.scored(_table(spark, d, "documents"), _fold(7) != 2)


def op3(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of a document and a benchmark item that it holds."""
    return decontaminate.contained(_table(spark, d, "documents"), _table(spark, d, "benchmark")).select("doc_id", "item_id", "n_common", "n_item")


def op4(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    """Digests of the ids: their number, how many of them are bytes, a hash of all in order, and whether they decode to the text."""
    m = pieces.Model.load(path or tokenizer_path("piece_bpe_32k.model"))
    x = pieces.encode(_table(spark, d, "documents"), m, "doc_id", check=True)
    n_bytes = F.size(F.filter("ids", lambda i: (i >= m.first_byte) & (i < m.first_byte + 256))).cast("long")
    return x.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), n_bytes.alias("n_bytes"), F.xxhash64("ids").alias("ids_digest"), "lossless")


def op5(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").withColumn("held_out", _fold(4) == 2)
    return langid.predict(docs, langid.fit(docs.where("NOT held_out")), "doc_id", "held_out")


def op6(spark: SparkSession, d: str, path: str | None = None) -> DataFrame:
    return tokencount.token_counts(_table(spark, d, "documents"), path or tokenizer_path("byte_bpe_50k.json"), TOKEN_LIMIT, "doc_id")


def op7(spark: SparkSession, d: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, d, "documents"), size=2, percent=80)


def op8(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    rows = _table(spark, d, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    placed = sharding.assign(rows, SHARDS, [F.col("doc_id"), F.col("size"), F.col("text_crc32")])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9(spark: SparkSession, d: str) -> DataFrame:
    turns = chat.numbered(_table(spark, d, "conversations"), strict=True)
    x = chat.preference_pairs(turns, chat.neighbours(turns))
    return x.withColumn("chosen_mask", chat.spans_text(F.col("chosen_mask"))).withColumn("rejected_mask", chat.spans_text(F.col("rejected_mask")))


def op10(spark: SparkSession, d: str) -> DataFrame:
    pages = stored(_table(spark, d, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.html_text(F.col("html")).alias("text")), "page-text")
    return lines.drop_boilerplate(pages, "host", "text").select("page_id", "host", "n_lines", "n_dropped", F.md5("text").alias("text_md5"))


def op11(spark: SparkSession, d: str) -> DataFrame:
    """Each benchmark item's 50 best documents."""
    return search.ranked(_table(spark, d, "documents"), _table(spark, d, "benchmark"), 50)


def op12(spark: SparkSession, d: str) -> DataFrame:
    return binarycodes.near_vectors(_table(spark, d, "embeddings"), 0.95)


def op13(spark: SparkSession, d: str) -> DataFrame:
    return centroids.clusters(_table(spark, d, "embeddings"), k=40, rounds=5, dim=64)


QUERIES = {
    "op1_quality_mcd": op1, "op2_log_bilinear": op2, "op3_decontaminate": op3, "op4_sentencepiece": op4, "op5_language_id": op5, "op6_token_counts": op6,
    "op7_near_duplicates": op7, "op8_sharding": op8, "op9_preference_pairs": op9, "op10_site_lines": op10,
    "op11_lexical_search": op11, "op12_binary_codes": op12, "op13_hamerly_clusters": op13,
}
