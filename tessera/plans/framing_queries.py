"""Queries over framing signals and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import vocabulary as V
from tessera.operators import claims as N, framing as A, text_tables as X
from tessera.operators import located as L
from tessera.plans.signals import REFERENCE_YEAR, with_claim_signals
from tessera.sources import corpus as C


def _sents(s, d):
    return X.with_sentences(C.documents(s, d))


def _added(before, after, *more):
    return [c for c in after.columns if c not in before.columns] + list(more)


def _signal(prepare, add):
    def run(s, d):
        base = prepare(s, d)
        out = add(base)
        return out.select("doc_id", *[c for c in out.columns if c not in base.columns])

    return run


def _coverage_summary(s, d):
    out = A.add_coverage(A.add_words(C.documents(s, d)))
    return out.select(
        "doc_id",
        F.array_join("covered", ",").alias("covered"),
        F.array_join("missing", ",").alias("missing"),
        "coverage_count",
        "coverage_balance",
    )


def _claims_base(s, d):
    docs = A.add_words(_sents(s, d))
    return N.with_claims(N.with_sentence_claims(N.with_numbers(docs)))


def _genre(s, d):
    docs = A.add_spaced_words(A.add_voice(A.add_words(_sents(s, d))))
    docs = with_claim_signals(docs)
    out = A.add_genre(docs)
    return out.select("doc_id", *[c for c in out.columns if c.startswith("genre")])


def _roles(s, d):
    out = A.add_roles(A.add_spaced_words(C.documents(s, d)))
    return out.select(
        "doc_id",
        "role_count",
        "role_mentions",
        F.array_join("roles_named", ",").alias("roles_named"),
        F.array_join("roles_absent", ",").alias("roles_absent"),
    )


def _claim_rows(s, d):
    rows = N.claim_rows(_claims_base(s, d))
    return rows.select(
        "doc_id",
        "claim_no",
        "sentence",
        "heading",
        "bullet",
        "framing",
        "is_prediction",
        "high_precision",
        F.array_join(F.transform("numbers", lambda n: n["raw"]), "|").alias("numbers"),
    )


def _missed(s, d):
    """Review lists: hints of open perspectives, likely citations, likely hedges."""
    docs = C.documents(s, d)
    rows = L.missed_perspectives(docs).unionByName(L.missed_citations(docs))
    return rows.unionByName(L.missed_hedges(N.claim_rows(_claims_base(s, d))))


QUERIES = {
    "coverage": lambda s, d: A.coverage_rows(C.documents(s, d)),
    "coverage_summary": _coverage_summary,
    "marker_hits": lambda s, d: A.hit_rows(C.documents(s, d)),
    "hit_to_sentence": lambda s, d: L.hits_in_sentences(C.documents(s, d)),
    "candidate_miss": _missed,
    "substantive_hits": lambda s, d: A.hit_rows(C.documents(s, d), substantive=True),
    "sourced_sentences": lambda s, d: A.flagged_sentences(X.sentences(C.documents(s, d))).drop("is_numeric"),
    "numeric_sentences": lambda s, d: A.flagged_sentences(X.sentences(C.documents(s, d))).drop("is_sourced"),
    "markers_matched": lambda s, d: A.markers_matched(C.documents(s, d)),
    "temporal_orientation": _signal(_sents, A.add_time),
    "voice": _signal(_sents, A.add_voice),
    "epistemic_basis": _signal(_sents, A.add_attribution),
    "mechanism_ratio": _signal(C.documents, A.add_mechanism),
    "assertion_ratio": _signal(C.documents, A.add_assertion),
    "claim_density": _signal(lambda s, d: A.add_words(_sents(s, d)), A.add_density),
    "presentation_features": _signal(
        lambda s, d: X.with_plain_sentences(C.documents(s, d)), A.add_presentation
    ),
    "information_novelty": _signal(
        lambda s, d: X.with_plain_sentences(C.documents(s, d)), A.add_novelty
    ),
    "temporal_scope": _signal(
        lambda s, d: A.add_spaced_words(C.documents(s, d)),
        lambda x: A.add_time_scope(x, REFERENCE_YEAR),
    ),
    "stakeholder_map": lambda s, d: A.role_rows(C.documents(s, d)),
    "stakeholder_roles": _roles,
    "falsification": _signal(lambda s, d: A.add_spaced_words(C.documents(s, d)), A.add_falsification),
    "genre": _genre,
    "number_mentions": lambda s, d: N.number_mentions(C.documents(s, d)),
    "drop_years_and_wordcounts": lambda s, d: N.number_mentions(C.documents(s, d), "numbers"),
    "numeric_claim_sentences": lambda s, d: N.numeric_claim_sentences(C.documents(s, d)),
    "causal_sentences": lambda s, d: N.causal_sentences(C.documents(s, d)),
    "claim_rows": _claim_rows,
    "short_claim_noise": lambda s, d: N.claim_noise(N.with_sentence_claims(N.with_numbers(_sents(s, d)))),
    "claim_stats": _signal(_claims_base, N.add_claim_stats),
    "claim_risk": _signal(lambda s, d: N.add_claim_stats(_claims_base(s, d)), N.add_claim_risk),
}
