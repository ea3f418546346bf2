"""The registered queries of the training-data operators.

Each applies one operator with its production parameters to the whole of its
table and returns the full result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from berth.llm import (bagminhash, cover_tree, decontam, html_main, langid, mixing, packing, pii, prefix_trie, secrets,
                       spelling, token_counts, warc_fixity)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact cosine >= 0.95 links of all embeddings."""
    return cover_tree.link_vectors(_read(spark, sf_dir, "embeddings"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.decontaminate(docs, _read(spark, sf_dir, "benchmark"), want_text=False).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op3_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    return html_main.extract_main_text(_read(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by digest and place."""
    return secrets.scan(_read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "start", "end", F.sha2("value", 256).alias("secret_sha256"), "score")


def op5_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate group of every document."""
    got = bagminhash.near_duplicates(_read(spark, sf_dir, "documents"))
    return got.withColumn("kept", F.col("doc_id") == F.col("group_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from four folds of five."""
    docs = _read(spark, sf_dir, "documents")
    model = langid.train(docs)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(True))
    return langid.identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held.alias("held_out"), "lang_pred", "score")


def op7_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records in which a damaged replica differs from the archive of all
    pages."""
    records = warc_fixity.layout(_read(spark, sf_dir, "pages"))
    return warc_fixity.audit(records, warc_fixity.damaged_replica(records), ("page_id", "url"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram token counts of every document."""
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, token_counts.load_vocabulary())


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temperature mixture of all sources."""
    return mixing.mix_sources(_read(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document."""
    return pii.find_pii(_read(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the prefix trie of all conversations."""
    return prefix_trie.prefix_trie(_read(spark, sf_dir, "conversations"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 4096 tokens."""
    import public_tokenizers

    return packing.pack(spark, _read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spelling variants of all words of the documents."""
    return spelling.variants(_read(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages of corpus_pipeline.py over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_cover_tree, op2_decontaminate, op3_main_text, op4_secret_scan, op5_bagminhash, op6_language_id,
    op7_warc_fixity, op8_token_counts, op9_mixture, op10_pii, op11_prefix_trie,
    op12_packing, op13_spelling, pipeline)}
