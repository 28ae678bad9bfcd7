"""Queries over frames, absences, patterns, readiness and findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import framing as A, frames as R
from tessera.plans.signals import doc_signals, framed, verified_signals
from tessera.plans.subject_queries import Checked, verdicts_by_document
from tessera.sources import corpus as C


def _framed(s, d):
    return framed(doc_signals(C.documents(s, d)))


def _verified(s, d):
    return framed(verified_signals(C.documents_with_sources(s, d)))


def _judged(s, d):
    """Signals with what the claims of each document come to when they are put to facts and texts."""
    return framed(verified_signals(C.documents_with_sources(s, d), verdicts=verdicts_by_document(s, d)))


def _takeaways(s, d):
    rows = R.takeaway_rows(_framed(s, d))
    return rows.unionByName(R.contradicted_rows(Checked(s, d).final()))


def _doc_signals(s, d):
    return doc_signals(C.documents(s, d)).select(
        "doc_id", "words", "spaced_words", "n_sentences", "coverage_count", "dominant", "voice", "sourced_pct",
        "total_claims", "hedged_count", "risk_level", "mechanism_ratio", "numeric_per_kw", "projection_phrases",
        "role_count", "falsification_count", "genre", "genre_confidence",
    )


def _gates(s, d):
    docs = _framed(s, d)
    return docs.select(
        "doc_id",
        (F.col("n_sentences") >= R.ENOUGH_SENTENCES).alias("frames_open"),
        (F.col("spaced_words") >= A.LONG_ENOUGH).alias("deeper_open"),
        (
            (F.col("spaced_words") >= R.CLUSTER_WORDS) & (F.size("frames") > 0) & (F.col("total_claims") > 0)
        ).alias("clusters_open"),
    )


def _absences(goal=None, budget="full"):
    def run(s, d):
        return R.absence_rows(R.add_absences(framed(doc_signals(C.documents(s, d)), absences=False), goal), budget)

    return run


def _budget(s, d):
    docs = R.add_patterns(R.add_clusters(_framed(s, d)))
    rows = []
    for level, (a, c, p) in R.BUDGETS.items():
        def cut(col, k):
            n = F.size(col)
            return (n if k is None else F.least(n, F.lit(k))).cast("long")

        rows.append(
            F.struct(
                F.lit(level).alias("level"),
                cut("absences", a).alias("absences_returned"),
                F.size("absences").cast("long").alias("absences_total"),
                cut("clusters", c).alias("clusters_returned"),
                F.size("clusters").cast("long").alias("clusters_total"),
                cut("patterns", p).alias("patterns_returned"),
                F.size("patterns").cast("long").alias("patterns_total"),
            )
        )
    return docs.select("doc_id", F.explode(F.array(*rows)).alias("b")).select("doc_id", "b.*")


def _strength(s, d):
    cov = A.coverage_rows(C.documents(s, d))
    density = F.col("density")
    label = (
        F.when(density < 0.01, "none").when(density < 3, "nominal").when(density < 10, "moderate").otherwise("substantive")
    )
    return cov.select("doc_id", "perspective", "density", label.alias("strength"))


def _joined(docs, column):
    return docs.select("doc_id", F.array_join(column, ",").alias(column))


# user rows of the extension job: (id, signal, operator, threshold)
USER_RULES = [("USR-001", "mechanism_ratio", ">=", 0.9), ("USR-002", "numeric_per_kw", ">", 10.0)]


def _custom(s, d):
    docs = R.add_frames(doc_signals(C.documents(s, d)), USER_RULES)
    fired = docs.select(F.explode_outer(R.fired_ids()).alias("fvs_id"))
    return fired.where(F.col("fvs_id").isNotNull()).groupBy("fvs_id").agg(F.count("*").alias("n_fired"))


QUERIES = {
    "doc_signals": _doc_signals,
    "evidence_gates": _gates,
    "frame_suggestions": lambda s, d: R.frame_rows(_framed(s, d)).drop("rank"),
    "rank_suggestions": lambda s, d: R.frame_rows(_framed(s, d)).select("doc_id", "rule_no", "fvs_id", "rank"),
    "top_frames": lambda s, d: R.frame_rows(_framed(s, d)).where(F.col("rank") <= 3).select("doc_id", "fvs_id", "rank"),
    "absent_frames": _absences(),
    "absence_relevance": lambda s, d: R.absence_dimension_rows(_framed(s, d)),
    "rank_absences": _absences(goal="decide"),
    "absence_tier": lambda s, d: R.absence_rows(_framed(s, d)).select("doc_id", "fvs_id", "tier"),
    "signal_strength": _strength,
    "absence_clusters": lambda s, d: R.cluster_rows(R.add_clusters(_framed(s, d))),
    "budget_slice": _budget,
    "list_caps": _absences(goal="learn", budget="minimal"),
    "rule_match": lambda s, d: R.pattern_rows(R.add_patterns(_framed(s, d))).select("doc_id", "pattern_no", "pattern"),
    "frame_patterns": lambda s, d: R.pattern_rows(R.add_patterns(_framed(s, d))),
    "readiness": lambda s, d: R.readiness_rows(_judged(s, d)),
    "citation_gap": lambda s, d: _verified(s, d).select("doc_id", "checked", "verified", "sourced_pct", "citation_gap"),
    "headline_code": lambda s, d: R.add_headline(_judged(s, d)).select("doc_id", "headline"),
    "finding_codes": lambda s, d: _joined(R.add_findings(_judged(s, d)), "findings"),
    "next_actions": lambda s, d: _joined(R.add_next_actions(_framed(s, d)), "actions"),
    "takeaways": _takeaways,
    "custom_rules": _custom,
}
