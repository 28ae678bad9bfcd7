"""Queries over lexicons and the frame catalogue as tables, and near copies of the corpus."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tessera.operators import lexicon as L, near
from tessera.plans import profile as P
from tessera.session import checkpoint_dir
from tessera.sources import corpus as C

#: Rows that a user adds: more words for a class that is there, and a class of their own.
USER_ROWS = [
    ("risks", r"(?i)\b(?:worries|tensions)\b", None),
    ("harbor", r"(?i)\bports?\b", None),
    ("harbor", r"(?i)\bquays?\b", None),
    ("public", r"(?i)\bthe\s+public\b", r"\s+record"),
]


def _user(s):
    return L.load_lexicon(s).unionByName(s.createDataFrame(USER_ROWS, L.LEXICON))


def _pairs(s, d):
    return near.near_copy_pairs(near.written(near.classes(C.read_table(s, d, "documents").select("doc_id", "text"))))


def _written_profiles(s, d):
    """Profiles written for two runs, the second one twice; what stands there afterwards."""
    out = f"{checkpoint_dir(s)}/profiles-{uuid.uuid4().hex}"
    docs = C.documents(s, d).select("doc_id", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("content_hash"))
    for run in ("2026-06-30", "2026-07-31", "2026-07-31"):
        P.write_profiles(docs, out, run)
    return s.read.schema("doc_id long, n_chars int, content_hash string, run_date string").parquet(out).groupBy("run_date").agg(
        F.count("*").alias("profiles"), F.sum("n_chars").alias("n_chars")
    )


QUERIES = {
    "lexicon_coverage": lambda s, d: L.lexicon_coverage(C.documents(s, d), _user(s)),
    "lexicon_rates": lambda s, d: L.lexicon_rates(L.lexicon_coverage(C.documents(s, d), _user(s))),
    "near_copies": lambda s, d: near.near_copies(C.read_table(s, d, "documents").select("doc_id", "text")),
    "near_copy_pairs": _pairs,
    "write_profiles": _written_profiles,
}
