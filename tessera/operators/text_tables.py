"""Documents to relations: lines, sentences, headings, tokens, years, hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions import text as T, vocabulary as V
from tessera.functions.scalar import find_all


# Tags that are reserved for prompts
UNSAFE_TAGS = ("<user_document", "</user_document>")


def with_sentences(docs: DataFrame) -> DataFrame:
    """Add `sentences`, computed once per row and shared by all detectors."""
    keep = list(docs.columns)
    cut = docs.select(*keep, T.sections(F.col("text")).alias("_sections"))
    cut = cut.select(*keep, T.blocks(F.col("_sections")).alias("_blocks"))
    return cut.select(*keep, T.sentences(F.col("_blocks")).alias("sentences"))


def with_plain_sentences(docs: DataFrame) -> DataFrame:
    return docs.select("*", T.plain_sentences(F.col("text")).alias("plain"))


def lines_with_heading(docs: DataFrame) -> DataFrame:
    cut = docs.select("doc_id", T.sections(F.col("text")).alias("_sections"))
    cut = cut.select("doc_id", F.posexplode_outer(T.lines(F.col("_sections"))).alias("line_no", "l"))
    return cut.select(
        "doc_id",
        F.col("line_no").cast("long"),
        F.col("l.line").alias("line"),
        F.col("l.kind").alias("kind"),
        F.col("l.heading").alias("heading"),
    )


def sentences(docs: DataFrame) -> DataFrame:
    return (
        with_sentences(docs.select("doc_id", "text"))
        .select("doc_id", F.posexplode_outer("sentences").alias("sent_no", "s"))
        .where(F.col("s").isNotNull())
        .select(
            "doc_id",
            F.col("sent_no").cast("long"),
            F.col("s.heading").alias("heading"),
            F.col("s.para_no").cast("long").alias("para_no"),
            F.col("s.sentence").alias("sentence"),
        )
    )


def sentences_simple(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.posexplode_outer(T.plain_sentences(F.col("text"))).alias("sent_no", "sentence"))
        .where(F.col("sentence").isNotNull())
        .select("doc_id", F.col("sent_no").cast("long"), "sentence")
    )


def headings(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.posexplode_outer(T.minor_headings(F.col("text"))).alias("heading_no", "heading"))
        .where(F.col("heading").isNotNull())
        .select("doc_id", F.col("heading_no").cast("long"), "heading")
    )


def section_bodies(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.posexplode_outer(T.section_bodies(F.col("text"))).alias("section_no", "body"))
        .where(F.col("body").isNotNull())
        .select("doc_id", F.col("section_no").cast("long"), "body")
    )


def tokens(docs: DataFrame) -> DataFrame:
    """tokens(doc_id, rule, token, n): the three word rules, counted per document."""
    text = F.col("text")
    rules = F.array(
        F.struct(F.lit("word").alias("rule"), find_all(text, T.WORD).alias("tokens")),
        F.struct(F.lit("content").alias("rule"), T.content_words(text).alias("tokens")),
        F.struct(F.lit("style").alias("rule"), T.style_tokens(text).alias("tokens")),
    )
    each = docs.select("doc_id", F.explode(rules).alias("r"))
    return (
        each.select("doc_id", F.col("r.rule").alias("rule"), F.explode_outer("r.tokens").alias("token"))
        .where(F.col("token").isNotNull())
        .groupBy("doc_id", "rule", "token")
        .agg(F.count("*").alias("n"))
    )


def year_mentions(docs: DataFrame) -> DataFrame:
    text = F.col("text")
    kinds = F.array(
        F.struct(F.lit("year").alias("kind"), find_all(text, V.YEAR, 1).alias("found")),
        F.struct(F.lit("fiscal").alias("kind"), find_all(text, V.FISCAL_YEAR, 1).alias("found")),
        F.struct(F.lit("decade").alias("kind"), find_all(text, V.DECADE).alias("found")),
    )
    return (
        docs.select("doc_id", F.explode(kinds).alias("k"))
        .select("doc_id", F.col("k.kind").alias("kind"), F.posexplode_outer("k.found").alias("pos", "mention"))
        .where(F.col("mention").isNotNull())
        .select("doc_id", "kind", F.col("pos").cast("long"), "mention")
    )


def content_hashes(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.sha2("text", 256).alias("content_hash"))


def state_hash(docs: DataFrame) -> DataFrame:
    """One short hash of the whole corpus that does not depend on row order.

    Each row is hashed with its key; slices of the hashes are added up map-side,
    and the sums are hashed once.  No list of the corpus is ever built."""
    row = F.sha2(F.concat_ws(":", F.col("doc_id").cast("string"), F.sha2("text", 256)), 256)
    slices = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"s{i}")
        for i in range(4)
    ]
    sums = docs.agg(F.count("*").alias("n_docs"), *slices)
    joined = F.concat_ws("/", *[F.col(c).cast("string") for c in ("n_docs", "s0", "s1", "s2", "s3")])
    return sums.select("n_docs", F.substring(F.sha2(joined, 256), 1, 12).alias("state_hash"))


def split_unsafe(docs: DataFrame) -> DataFrame:
    """documents(+unsafe): texts that carry tags reserved for prompts."""
    low = F.lower("text")
    hit = F.lit(False)
    for tag in UNSAFE_TAGS:
        hit = hit | F.contains(low, F.lit(tag))
    return docs.select("*", hit.alias("unsafe"))


def quarantine(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """documents → those that are fit to go on, and those that carry tags reserved for prompts; null texts are fit.

    The flag is computed once, in the scan of whichever output is read."""
    flagged = split_unsafe(docs).withColumn("unsafe", F.coalesce("unsafe", F.lit(False)))
    return flagged.where(~F.col("unsafe")).drop("unsafe"), flagged.where("unsafe").drop("unsafe")
