"""One query for each corpus operator, with production parameters, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import centroids, dialogues, embeddings, html, jaccard, langid, lines, media, packing, pieces, quality, secrets, suffixes


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_groups(_table(spark, sf_dir, "documents"), jaccard.Similarity(words=4, num=85, den=100)).select("doc_id", "n_shingles", "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_table(spark, sf_dir, "pages"))


def op3_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_features(_table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.held_out_identification(_table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"), cosine=0.95)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def byte_bpe_files() -> tuple:
    """The 50k byte-level BPE, its ranks and its pattern."""
    import public_tokenizers

    return _vocabulary("byte_bpe_50k.json"), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), byte_bpe_files())


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_digest(_table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.piece_digest(_table(spark, sf_dir, "documents"), _vocabulary("piece_bpe_32k.model"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster_digest(_table(spark, sf_dir, "embeddings"))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dialogues.conversation_trie(_table(spark, sf_dir, "conversations"))


def op13_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.passage_digest(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_html_extraction": op2_html_extraction,
    "op3_media_columns": op3_media_columns,
    "op4_secret_scan": op4_secret_scan,
    "op5_language_id": op5_language_id,
    "op6_embedding_near_dedup": op6_embedding_near_dedup,
    "op7_quality": op7_quality,
    "op8_packing": op8_packing,
    "op9_line_dedup": op9_line_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_centroid_clustering": op11_centroid_clustering,
    "op12_conversation_trie": op12_conversation_trie,
    "op13_suffix_dedup": op13_suffix_dedup,
}

ORACLE: dict[str, str] = {
    "op1_ngram_jaccard": jaccard.ORACLE_SQL,
    "op6_embedding_near_dedup": embeddings.ORACLE_SQL,
    "op9_line_dedup": lines.ORACLE_SQL,
    "op11_centroid_clustering": centroids.ORACLE_SQL,
    "op12_conversation_trie": dialogues.ORACLE_SQL,
    "op13_suffix_dedup": suffixes.ORACLE_SQL,
}
