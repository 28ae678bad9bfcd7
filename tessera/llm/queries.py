"""One query for each operator, over the whole of its table, and the pipeline."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, byte_repeats, decontaminate, direct_codes, line_dedup, main_text, prefix_trie, search, simhash, token_counts, toxicity, whitening, word_repeats
from tessera.llm.shared import shared_folder, table


def op1_byte_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_repeats.digests(table(spark, sf_dir, "documents"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op3_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document whose id is divisible by 50 is a query against all documents."""
    docs = table(spark, sf_dir, "documents")
    return search.top_k(docs, docs.where("doc_id % 50 = 0"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_word_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_repeats.digests(table(spark, sf_dir, "documents"))


def op10_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/token-codes-{uuid.uuid4().hex}"
    direct_codes.write_codes(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), path)
    return direct_codes.read_codes(spark, path).drop("ids")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_nodes(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.main_text(table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_byte_repeats": op1_byte_repeats,
    "op2_line_dedup": op2_line_dedup,
    "op3_search": op3_search,
    "op4_decontaminate": op4_decontaminate,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_token_counts": op6_token_counts,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_word_repeats": op9_word_repeats,
    "op10_token_codes": op10_token_codes,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_whitening": op12_whitening,
    "op13_main_text": op13_main_text,
}
SQL = {"op2_line_dedup": line_dedup.SQL, "op3_search": search.SQL}
