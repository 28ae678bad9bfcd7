"""Near copies over the whole corpus: texts that are the same but for a few characters.

Equal texts are one class from the start, so copies are never paired.  Each class draws a
sketch from its shingles (one hash a shingle, the least of each of BINS bins), bins are taken
together to bands, and classes that share a band at a like length are candidates.  The length
is part of the key, which splits a band that many texts share by a condition that any true pair
meets.  Candidates are compared by edit distance over their whole texts."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.functions.scalar import edit_distance, let, rounded
from tessera.session import written

THRESHOLD = 0.95
SHINGLE, BINS, ROWS = 3, 64, 4


def classes(documents: DataFrame) -> DataFrame:
    """class_id (least doc_id), copies, text: one row for each distinct text; null texts belong to none."""
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.sha2("text", 256).alias("_h"))
    groups = rows.groupBy("_h").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("copies"))
    first = rows.join(groups, [rows["_h"] == groups["_h"], rows["doc_id"] == groups["class_id"]], "left_semi").dropDuplicates(["_h"])
    return first.join(groups, "_h").select("class_id", "copies", "text", F.col("_h").alias("content_hash"))


def _shingles(text: Column) -> Column:
    """Hashes of all runs of SHINGLE words; of the whole text if it has fewer."""

    def runs(words: Column) -> Column:
        last = F.size(words) - SHINGLE
        places = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        each = F.transform(places, lambda k: F.xxhash64(*[words[k + i] for i in range(SHINGLE)]))
        return F.when(F.size(each) > 0, F.array_distinct(each)).otherwise(F.array(F.xxhash64(F.array_join(words, " "))))

    return let(F.split(T.strip(F.lower(text)), r"\s+"), runs)


def _length_step(length: Column, threshold: float) -> Column:
    return F.floor(F.log(F.greatest(length, F.lit(1)).cast("double")) / F.lit(-math.log(threshold))).cast("long")


def near_copy_pairs(reps: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """classes() → (a_id, b_id, similarity): pairs of different texts whose edit distance is small."""
    reps = reps.select("class_id", "text", F.length("text").alias("n"))
    hashes = reps.select("class_id", F.explode(_shingles(F.col("text"))).alias("h"))
    bins = hashes.groupBy("class_id", F.pmod("h", F.lit(BINS)).alias("bin")).agg(F.min("h").alias("least"))
    bands = bins.groupBy("class_id", F.floor(F.col("bin") / ROWS).alias("band")).agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("bin", "least")))).alias("key"))
    sized = written(bands.join(reps.select("class_id", _length_step(F.col("n"), threshold).alias("step")), "class_id"))
    left = sized.select(F.col("class_id").alias("a_id"), "band", "key", F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"))
    right = sized.select(F.col("class_id").alias("b_id"), "band", "key", "step")
    pairs = left.join(right, ["band", "key", "step"]).where("a_id < b_id").select("a_id", "b_id").distinct()
    a, b = reps.select(F.col("class_id").alias("a_id"), F.col("text").alias("a"), F.col("n").alias("a_n")), reps.select(F.col("class_id").alias("b_id"), F.col("text").alias("b"), F.col("n").alias("b_n"))
    # Lengths bound the similarity from above; they are joined and tested before any text is.
    near = pairs.join(a.select("a_id", "a_n"), "a_id").join(b.select("b_id", "b_n"), "b_id").where(F.least("a_n", "b_n") >= F.greatest("a_n", "b_n") * threshold)
    both = near.join(a.select("a_id", "a"), "a_id").join(b.select("b_id", "b"), "b_id")
    longest = F.greatest("a_n", "b_n", F.lit(1))
    away = edit_distance(F.col("a"), F.col("b"), F.ceil(longest * (1 - threshold)).cast("int"))
    similar = F.when(away >= 0, 1 - away / longest)
    return both.select("a_id", "b_id", similar.alias("s")).where(F.col("s") >= threshold).select("a_id", "b_id", rounded(F.col("s"), 4).alias("similarity"))


def near_copies(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, copies, n_similar: each document with its class and how many other texts are near it.

    Documents without an id or a text have no row."""
    reps = written(classes(documents))
    pairs = near_copy_pairs(reps, threshold)
    ends = pairs.select(F.explode(F.array("a_id", "b_id")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_similar"))
    known = reps.select("class_id", "copies", "content_hash").join(ends, "class_id", "left")
    rows = documents.where(F.col("text").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", F.sha2("text", 256).alias("content_hash"))
    return rows.join(known, "content_hash").select("doc_id", "class_id", "copies", F.coalesce("n_similar", F.lit(0)).alias("n_similar"))
