"""Queries of short labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import framing as A, labels as L, text_tables as X
from tessera.plans.fact_queries import _decomposed
from tessera.sources import corpus as C

#: Markers that previews are centred on.
MARKED = r"(?i)\b(?:risks?|growth|because|costs?)\b"


def _ranges(s, d):
    docs = A.add_assertion(A.add_mechanism(C.documents(s, d)))
    return docs.select(
        "doc_id",
        L.range_label(F.col("mechanism_ratio"), "mechanism_ratio").alias("mechanism_label"),
        L.range_label(F.col("assertion_ratio"), "assertion_ratio").alias("assertion_label"),
    )


def _previews(s, d):
    rows = X.sentences(C.documents(s, d)).select("doc_id", "sent_no", "sentence", F.lower(F.regexp_extract("sentence", MARKED, 0)).alias("marker"))
    return rows.select("doc_id", "sent_no", "marker", L.preview(F.col("sentence"), F.col("marker")).alias("preview"))


def _links(s, d):
    """Links of the pages; those of one page in twelve each lead to a known provider."""
    domains = F.array(*[F.lit(x) for x in [*L.PROVIDERS, "evil.com", "example.com"]])
    domain = F.element_at(domains, (F.col("page_id") % 12 + 1).cast("int"))
    url = F.regexp_replace("url", F.lit(r"example\.(?:com|net|org)"), domain)
    return C.read_table(s, d, "pages").select("page_id", url.alias("link"), L.provider_of_url(url).alias("provider"))


def _indicators(s, d):
    rows = _decomposed(s, d).select("claim_id", L.indicator_of(F.col("sentence"), F.col("metric")).alias("indicator"), L.series_of(F.col("sentence"), F.col("metric")).alias("s"))
    return rows.select("claim_id", "indicator", F.col("s.code").alias("series"), F.col("s.scale").alias("scale"))


QUERIES = {"range_label": _ranges, "preview": _previews, "provider_of_url": _links, "indicator_of": _indicators}
