"""Marker rows as data: the built-in perspectives with what a user adds, counted in one pass.

lexicon(class, pattern) rows are few and change without a release. They are read from a table
whose size is checked, and patterns of one class become one alternation at plan time, which
each task compiles once. A class that the built-in sets do not know is counted like them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, functions as F

from tessera.functions import text as T, vocabulary as V
from tessera.functions.scalar import count_matches, kilowords, rounded

LEXICON = "class string, pattern string, exclude string"
#: Rows that a lexicon may have, and signs of one pattern: the check of what becomes part of a plan.
MOST_ROWS, LONGEST = 5000, 5000
COVERED = 2


def load_lexicon(spark: SparkSession) -> DataFrame:
    """The built-in sets as rows of a lexicon."""
    return spark.createDataFrame([(c, p, None) for c, p in V.PERSPECTIVES.items()], LEXICON)


def patterns(lexicon: DataFrame) -> dict[str, str]:
    """One pattern for each class; rows that cannot be read as a pattern, and lexicons beyond the bound, are refused."""
    rows = lexicon.where("class IS NOT NULL AND pattern IS NOT NULL AND pattern <> ''").distinct().limit(MOST_ROWS + 1).collect()
    if len(rows) > MOST_ROWS:
        raise ValueError(f"a lexicon has at most {MOST_ROWS} rows")
    found: dict[str, list[str]] = {}
    for row in sorted(rows, key=lambda r: (r["class"], r["pattern"], r["exclude"] or "")):
        if len(row["pattern"]) > LONGEST:
            raise ValueError(f"a pattern has at most {LONGEST} signs")
        if re.search(r"\(\?[<P]|\\[1-9]", row["pattern"]):
            raise ValueError("a pattern of a lexicon has no named groups and no references")
        after = f"(?!{row['exclude']})" if row["exclude"] else ""
        found.setdefault(row["class"], []).append(f"(?:{row['pattern']}){after}")
    return {c: "|".join(p) for c, p in found.items()}


def lexicon_coverage(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, class, hits, density, covered) of every class of the lexicon, in one pass over each text."""
    sets = [F.struct(F.lit(c).alias("class"), count_matches(F.col("text"), p).alias("hits")) for c, p in patterns(lexicon).items()]
    if not sets:
        return docs.sparkSession.createDataFrame([], "doc_id long, class string, hits long, density double, covered boolean")
    rows = docs.select("doc_id", T.word_count(F.col("text")).alias("words"), F.array(*sets).alias("sets"))
    rows = rows.select("doc_id", "words", F.explode("sets").alias("s"))
    return rows.select(
        "doc_id", F.col("s.class").alias("class"), F.col("s.hits").alias("hits"), rounded(F.col("s.hits") / kilowords(F.col("words")), 1).alias("density"), (F.col("s.hits") >= COVERED).alias("covered")
    )


def lexicon_rates(coverage: DataFrame) -> DataFrame:
    """class, documents, covered, rate: how often each class of a lexicon is covered over the corpus."""
    rows = coverage.groupBy("class").agg(F.count("*").alias("documents"), F.count_if("covered").alias("covered"))
    return rows.select("class", "documents", "covered", rounded(F.col("covered") / F.col("documents"), 4).alias("rate"))
