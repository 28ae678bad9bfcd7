"""Input tables: documents with their passages, sources, versions, peers, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.seeding import seed, source_text, version_texts


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


#: Session setting: into how many partitions texts are dealt out after the scan. Unset, they stay
#: in the splits of the scan, which spark.sql.files.maxPartitionBytes sizes, and are not shuffled.
PARTITIONS = "tessera.text.partitions"


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """The table in as many partitions as PARTITIONS says; the scan's own if it says nothing."""
    wanted = df.sparkSession.conf.get(PARTITIONS, None)
    return df.repartition(int(wanted), *keys) if wanted else df


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """documents(doc_id, text): each text followed by its English passages."""
    raw = read_table(spark, folder, "documents").select("doc_id", "text")
    return seed(spread(raw, "doc_id"))


def documents_with_sources(spark: SparkSession, folder: str) -> DataFrame:
    """documents(doc_id, text, source_text): each document beside its source.

    All passages of `benchmark` serve in turn: the key has as many values as the table has rows."""
    passages = read_table(spark, folder, "benchmark").select(
        F.col("item_id").alias("_item"), F.col("text").alias("_passage")
    )
    docs = documents(spark, folder).withColumn("_turn", F.col("doc_id") % passages.agg(F.count("*")).scalar())
    paired = docs.join(passages, docs._turn == passages._item, "left")
    return paired.select("doc_id", "text", source_text(F.col("doc_id"), F.col("_passage")).alias("source_text"))


# Parameters of the derived panels: who wrote the documents of one panel
PRODUCERS = ("alder", "birch", "cedar", "dogwood")
PANEL = 4


def producer_label(slug: Column, known: tuple[str, ...] = PRODUCERS) -> Column:
    """The last known producer named in a slug, `other` if there is none."""
    named = F.filter(F.split(slug, "-"), lambda part: part.isin(list(known)))
    return F.coalesce(F.try_element_at(named, F.lit(-1)), F.lit("other"))


def panel_slug(doc_id: Column) -> Column:
    """panel-<n>-<producer>; every 14th slug names a producer nobody knows."""
    name = F.element_at(F.array(*[F.lit(p) for p in PRODUCERS]), (doc_id % PANEL + 1).cast("int"))
    return F.concat_ws(
        "-",
        F.lit("panel"),
        F.floor(doc_id / PANEL).cast("string"),
        F.when(doc_id % 14 == 13, F.lit("unnamed")).otherwise(name),
    )


def peers(docs: DataFrame) -> DataFrame:
    """peers(doc_id, slug, peer_group, producer): panels of four documents each."""
    return docs.select(
        "doc_id",
        panel_slug(F.col("doc_id")).alias("slug"),
        F.floor(F.col("doc_id") / PANEL).cast("long").alias("peer_group"),
    ).withColumn("producer", producer_label(F.col("slug")))


def corpus_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have their metadata row; the others are left out."""
    docs = read_table(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    meta = read_table(spark, folder, "labels")
    entries = docs.join(meta, "doc_id")
    return entries.select(
        "*",
        panel_slug(F.col("doc_id")).alias("slug"),
        F.floor(F.col("doc_id") / PANEL).cast("long").alias("peer_group"),
    ).withColumn("producer", producer_label(F.col("slug")))


def versions(spark: SparkSession, folder: str, whole: bool = True) -> DataFrame:
    """versions(group_id, version_id, text): every document written three times, its whole text or its passages alone."""
    ids = spread(read_table(spark, folder, "documents").select("doc_id", "text"), "doc_id")
    each = F.array(
        *[
            F.struct(F.lit(v).cast("long").alias("version_id"), text.alias("text"))
            for v, text in enumerate(version_texts(F.col("doc_id"), F.col("text") if whole else None))
        ]
    )
    rows = ids.select(F.col("doc_id").alias("group_id"), F.explode(each).alias("v"))
    return rows.select("group_id", "v.version_id", "v.text")


DIMENSION_ORDER = ("coverage", "calibration", "evidence", "robustness", "counterfactual")
RATERS = 3


def rating_sheets(spark: SparkSession, folder: str) -> DataFrame:
    """One sheet per (document, rater) with a score of 1 to 5, or a gap, per dimension."""
    labels = read_table(spark, folder, "labels")
    rows = labels.select("*", F.explode(F.sequence(F.lit(0), F.lit(RATERS - 1))).alias("rater_id"))
    scores = []
    for k, dim in enumerate(DIMENSION_ORDER):
        base = (F.col("doc_id") * 3 + F.col("rater_id") * 5 + k * 2) % 3
        gap = (F.col("doc_id") + F.col("rater_id") * 2 + k) % 7 == 0
        score = F.lit(1) + base + F.col("quality") + (F.lit(1) - F.col("toxic"))
        scores.append(F.when(~gap, score).cast("long").alias(dim))
    return rows.select("doc_id", F.col("rater_id").cast("long").alias("rater_id"), *scores)


def llm_usage(spark: SparkSession, folder: str) -> DataFrame:
    """Calls made to write the documents, with token counts from their lengths."""
    docs = read_table(spark, folder, "documents").select("doc_id", "n_chars")
    which = F.col("doc_id") % 5
    return docs.select(
        "doc_id",
        F.when(which < 2, "alder").when(which < 4, "birch").otherwise("cedar").alias("provider"),
        F.when(which == 0, "alder-small").when(which == 1, "alder-large").when(which == 2, "birch-one")
        .when(which == 3, "birch-beta").otherwise("cedar-free").alias("model"),
        (F.col("doc_id") % 10 == 9).alias("grounded"),
        (F.floor(F.col("n_chars") / 8)).cast("long").alias("input_tokens"),
        (F.floor(F.col("n_chars") / 4)).cast("long").alias("output_tokens"),
    )


PRICES = [
    ("alder", "alder-small", 0.00015, 0.0006),
    ("alder", "alder-large", 0.0001, 0.0004),
    ("birch", "birch-one", 0.0002, 0.0008),
]


def llm_pricing(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        PRICES, "provider string, model string, input_per_1k double, output_per_1k double"
    )
