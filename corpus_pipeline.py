"""Five stages over the documents, each fed with all that the stage before it kept.

toxicity        documents that score as toxic go
line dedup      later repeats of a line go, n_chars follows the text
near dedup      one document of each group of near copies stays
decontamination words of benchmark passages are cut out of the texts
byte-level BPE  the ids of each text and a digest of what they decode to
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from tessera.llm.shared import settle, table

#: SQL cannot express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _length(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, table(spark, sf_dir, "labels"))


def lines_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _length(line_dedup.without_repeats(docs, least=1, counts=False))


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_of_each(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _length(decontaminate.cleaned(docs, table(spark, sf_dir, "benchmark")))


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = byte_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return found.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", not_toxic),
    ("line dedup", lines_once),
    ("near dedup", one_of_near_copies),
    ("decontamination", without_benchmark),
    ("byte-level BPE", token_ids),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
