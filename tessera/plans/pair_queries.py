"""Queries over pairs of documents and versions of texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import claims as N, frames as R, pairs as P
from tessera.plans.signals import doc_signals, framed, verified_signals
from tessera.sources import corpus as C


def _pairs(s, d):
    return P.pair_signals(R.add_frames(doc_signals(C.documents(s, d))))


def _readiness(s, d):
    return R.readiness_rows(framed(verified_signals(C.documents_with_sources(s, d))))


def _peers(s, d):
    return C.peers(C.read_table(s, d, "documents").select("doc_id"))


def _gained(s, d):
    diffs = P.profile_diffs(_readiness(s, d))
    return diffs.where((F.col("gained") != "") | (F.col("lost") != "")).select(
        "a_doc_id", "b_doc_id", "dimension", "gained", "lost"
    )


def _summary(s, d):
    pairs = _pairs(s, d)
    return P.pair_summary(pairs, P.near_matches(P.number_sets(pairs)))


def _value_rows(s, d):
    """Every number shown in a claim, in each of its normal forms."""
    docs = P.version_claims(C.versions(s, d))
    rows = docs.select("group_id", "version_id", F.posexplode_outer("claims").alias("claim_no", "c")).where(
        F.col("c").isNotNull()
    )
    rows = rows.select(
        "group_id",
        "version_id",
        F.col("claim_no").cast("long"),
        F.col("c.sentence").alias("sentence"),
        F.posexplode(N.shown_numbers(F.col("c"))).alias("number_no", "raw"),
    )
    return rows.withColumn("number_no", F.col("number_no").cast("long"))


def _forms(column):
    def run(s, d):
        rows = _value_rows(s, d)
        made = {
            "normalize_value": N.normal_value(F.col("raw"), F.col("sentence")).alias("base_value"),
            "stability_key": N.stability_key(F.col("raw")).alias("key"),
            "number_type": N.number_type(F.col("raw")).alias("type"),
        }[column]
        return rows.select("group_id", "version_id", "claim_no", "number_no", "raw", made)

    return run


def _commas(s, d):
    from tessera.operators.grounding import grouped_digits

    rows = P.version_union(C.versions(s, d))
    return rows.select("group_id", "type", "value", grouped_digits(F.col("value")).alias("comma_value"))


QUERIES = {
    "peer_pairs": lambda s, d: P.peer_pairs(_peers(s, d)),
    "producer_label": lambda s, d: _peers(s, d),
    "number_sets": lambda s, d: P.number_sets(_pairs(s, d)).drop("peer_group"),
    "near_matches": lambda s, d: P.near_matches(P.number_sets(_pairs(s, d))),
    "blind_spots": lambda s, d: P.blind_spots(_pairs(s, d)),
    "pair_findings": lambda s, d: P.pair_findings(_pairs(s, d)),
    "pair_summary": _summary,
    "frame_profile_diff": lambda s, d: P.profile_diffs(_readiness(s, d)),
    "frames_gained_lost": _gained,
    "number_stability": lambda s, d: P.number_stability(C.versions(s, d)),
    "regeneration_stability": lambda s, d: P.regeneration_stability(C.versions(s, d)),
    "version_union": lambda s, d: P.version_union(C.versions(s, d)),
    "verbatim_pairs": lambda s, d: P.verbatim_pairs(C.versions(s, d, whole=False)),
    "verbatim_copies": lambda s, d: P.verbatim_copies(C.read_table(s, d, "documents")),
    "heading_overlap": lambda s, d: P.heading_overlap(C.documents(s, d)),
    "normalize_value": _forms("normalize_value"),
    "stability_key": _forms("stability_key"),
    "number_type": _forms("number_type"),
    "add_commas": _commas,
}
