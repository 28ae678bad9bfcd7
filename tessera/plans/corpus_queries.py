"""Queries over the corpus: prevalence, peers, raters, costs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as U, frames as R, pairs as P
from tessera.plans.signals import doc_signals, framed, verified_signals
from tessera.session import written
from tessera.sources import corpus as C


def _framed(s, d):
    return framed(doc_signals(C.documents(s, d)))


def _readiness(s, d):
    return R.readiness_rows(framed(verified_signals(C.documents_with_sources(s, d))))


def _ratings(s, d):
    return U.long_ratings(C.rating_sheets(s, d))


def _rated(s, d):
    return U.rated_signals(_readiness(s, d), U.expert_means(_ratings(s, d)))


def _prevalence(by_genre):
    def run(s, d):
        stats = U.frame_prevalence(_framed(s, d))
        if by_genre:
            return stats.where(F.col("genre").isNotNull())
        return stats.where(F.col("genre").isNull()).drop("genre", "low_n")

    return run


def _empirics(s, d):
    return U.detector_empirics(R.add_clusters(R.add_patterns(_framed(s, d))))


def _spearman(s, d):
    return U.spearman(U.average_ranks(_rated(s, d), ["dimension"]), ["dimension"])


def _spearman_by_producer(s, d):
    rated = _rated(s, d).withColumn("producer", C.producer_label(C.panel_slug(F.col("doc_id"))))
    return U.spearman(U.average_ranks(rated, ["dimension", "producer"]), ["dimension", "producer"])


def _spearman_by_genre(s, d):
    genres = doc_signals(C.documents(s, d)).select("doc_id", F.coalesce("genre", F.lit(U.UNCLASSIFIED)).alias("genre"))
    rated = written(_rated(s, d)).join(genres, "doc_id")
    return U.spearman(U.average_ranks(rated, ["dimension", "genre"]), ["dimension", "genre"])


def _ranks(s, d):
    return U.average_ranks(_rated(s, d), ["dimension"])


def _tiers(s, d):
    docs = C.read_table(s, d, "documents").select("doc_id", "source")
    labels = C.read_table(s, d, "labels")
    scores = docs.join(labels, "doc_id").groupBy("source").agg(
        F.avg((F.col("quality") + F.col("toxic") == 1).cast("double")).alias("score")
    )
    return scores.select("source", "score", U.agreement_tier(F.col("score")).alias("tier"))


QUERIES = {
    "frame_prevalence": _prevalence(False),
    "frame_prevalence_by_genre": _prevalence(True),
    "co_fires": lambda s, d: U.co_frames(_framed(s, d)),
    "co_absences": lambda s, d: U.co_frames(_framed(s, d), absent=True),
    "pattern_prevalence": lambda s, d: U.pattern_prevalence(_framed(s, d)),
    "detector_empirics": _empirics,
    "peer_outliers": lambda s, d: U.peer_outliers(_readiness(s, d)).drop("fired"),
    "outlier_counts": lambda s, d: U.outlier_counts(U.peer_outliers(_readiness(s, d))),
    "cross_group_findings": lambda s, d: U.cross_group_findings(U.peer_outliers(_readiness(s, d))),
    "cross_group_leanings": lambda s, d: U.cross_group_findings(U.peer_outliers(_readiness(s, d)), 0.3),
    "peer_divergence": lambda s, d: U.peer_divergence(P.profile_diffs(_readiness(s, d))),
    "diff_findings": lambda s, d: U.diff_findings(P.profile_diffs(_readiness(s, d))),
    "read_ratings": _ratings,
    "expert_mean": lambda s, d: U.expert_means(_ratings(s, d)),
    "average_ranks": _ranks,
    "spearman_by_dimension": _spearman,
    "spearman_by_genre": _spearman_by_genre,
    "spearman_by_producer": _spearman_by_producer,
    "icc_by_dimension": lambda s, d: U.icc(_ratings(s, d)),
    "expert_agreement": lambda s, d: U.expert_agreement(
        U.peer_outliers(_readiness(s, d)), U.expert_means(_ratings(s, d))
    ),
    "divergence_cases": lambda s, d: U.divergence_cases(_rated(s, d)),
    "llm_cost": lambda s, d: U.llm_costs(C.llm_usage(s, d), C.llm_pricing(s)),
    "reader_agreement_tier": _tiers,
}
