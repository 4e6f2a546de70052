"""The queries of this subpackage: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagelathe.llm import exact_dedup, minhash, mixing, ngram_lm, passage_dedup, sentencepiece_bpe, sharding, token_counts, toxicity, vector_dedup
from pagelathe.runtime import read_table

SHARDS = 16


def model_path() -> str:
    """The public SentencePiece model of this machine; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_bpe.digests(sentencepiece_bpe.encode(read_table(spark, sf_dir, "documents"), model_path()))


def op2_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.assign(read_table(spark, sf_dir, "documents"), size=3, percent=85)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.assign(read_table(spark, sf_dir, "documents"))


def op4_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.score(read_table(spark, sf_dir, "documents"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, read_table(spark, sf_dir, "labels")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), model_path())


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(read_table(spark, sf_dir, "documents"), SHARDS)


def op8_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passage_dedup.passages(read_table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.plan(read_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.assign(read_table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_sentencepiece, op2_minhash, op3_exact_dedup, op4_ngram_lm, op5_toxicity, op6_token_counts, op7_sharding, op8_passage_dedup, op9_mixing, op10_vector_dedup)}

ORACLES = {
    "op2_minhash": minhash.ORACLE,
    "op3_exact_dedup": exact_dedup.ORACLE,
    "op4_ngram_lm": ngram_lm.ORACLE,
    "op7_sharding": sharding.ORACLE,
    "op9_mixing": mixing.ORACLE,
    "op10_vector_dedup": vector_dedup.ORACLE,
}
