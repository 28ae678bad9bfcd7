"""doc_signals: the wide per-document row that rules, pairs and roll-ups read."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.operators import claims as N, framing as A, frames as R, grounding as G, text_tables as X

REFERENCE_YEAR = 2026


def with_claim_signals(docs: DataFrame) -> DataFrame:
    docs = N.with_sentence_claims(N.with_numbers(docs))
    docs = N.with_claims(docs)
    return N.add_claim_risk(N.add_claim_stats(docs))


def doc_signals(docs: DataFrame, this_year: int = REFERENCE_YEAR) -> DataFrame:
    """documents(doc_id, text) → one wide row per document, without a shuffle."""
    docs = X.with_sentences(docs)
    docs = A.add_spaced_words(A.add_words(docs))
    docs = A.add_voice(A.add_time(A.add_coverage(docs)))
    docs = A.add_attribution(docs)
    docs = with_claim_signals(docs)
    docs = A.add_density(A.add_mechanism(docs))
    docs = A.add_falsification(A.add_roles(A.add_time_scope(docs, this_year)))
    return A.add_genre(docs)


def verified_signals(docs: DataFrame, this_year: int = REFERENCE_YEAR, verdicts: DataFrame | None = None) -> DataFrame:
    """documents(+source_text) → signals with checked / verified numbers.

    Numbers are checked against the paired source.  What is contradicted or disputed comes
    from verdicts(doc_id, contradicted, disputed); without such a table it is 0."""
    docs = G.with_source_facts(docs)
    wide = doc_signals(docs, this_year)
    wide = G.add_source_fidelity(wide.withColumn("backed", G.backed_numbers()))
    none = F.lit(0).cast("long")
    if verdicts is None:
        return wide.select("*", none.alias("contradicted"), none.alias("disputed"))
    wide = wide.join(verdicts.select("doc_id", "contradicted", "disputed"), "doc_id", "left")
    return wide.select(*[F.coalesce(c, none).alias(c) if c in ("contradicted", "disputed") else F.col(c) for c in wide.columns])


def framed(signals: DataFrame, absences: bool = True) -> DataFrame:
    """Signals → frames that fired and frames that did not."""
    out = R.add_frames(signals)
    if "checked" in signals.columns:
        out = R.add_citation_gap(out)
    return R.add_absences(out) if absences else out
