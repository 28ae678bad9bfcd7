"""Queries over claims and reference facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import corpus as U, evidence as E, facts as K
from tessera.plans.signals import REFERENCE_YEAR
from tessera.session import cut_lineage
from tessera.sources import corpus as C, facts as S, reports as R

AS_OF = "2026-06-30"


def _decomposed(s, d):
    # claims are few bytes and long work: left to the sums they come from, most would meet in one task
    return K.decompose(C.spread(S.fact_claims(s, d), "claim_id"), REFERENCE_YEAR)


def _companies(s, d):
    customers = C.read_table(s, d, "customer")
    suffix = F.element_at(F.array(F.lit(""), F.lit(" Inc"), F.lit(" Corp")), (F.col("c_custkey") % 3 + 1).cast("int"))
    return customers.select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("ticker"),
        F.concat(F.col("c_name"), suffix).alias("title"),
    )


def _aliases(s, d):
    nations = C.read_table(s, d, "nation").select(
        F.lower("n_name").alias("alias"), F.lit("country").alias("entity_type"), F.col("n_name").alias("canonical")
    )
    coins = s.createDataFrame(
        [("bitcoin", "crypto_asset", "bitcoin"), ("btc", "crypto_asset", "bitcoin")],
        "alias string, entity_type string, canonical string",
    )
    return nations.unionByName(coins)


def _resolve(s, d):
    customers = C.read_table(s, d, "customer")
    k = F.col("c_custkey")
    subject = (
        F.when(k % 6 == 0, F.concat(F.lit("t"), k.cast("string")))
        .when(k % 6 == 1, F.concat(F.col("c_name"), F.when(k % 3 == 1, " Inc").otherwise("")))
        .when(k % 6 == 2, F.concat(F.col("c_name"), F.lit(",")))
        .when(k % 6 == 3, F.concat(F.lit("Nation_"), F.col("c_nationkey").cast("string")))
        .when(k % 6 == 4, F.lit("Bitcoin,"))
        # parts of titles, and titles inside of longer names
        .when(k % 36 == 11, F.expr("substr(c_name, 10)"))
        .when(k % 36 == 23, F.concat(F.lit("The old "), F.col("c_name"), F.lit(" Corp of yore.")))
        .when(k % 36 == 35, F.expr("right(c_name, 3)"))
        .otherwise(F.lit("nobody known"))
    )
    subjects = customers.select(k.alias("subject_id"), subject.alias("subject"))
    return K.resolve_entities(subjects, _aliases(s, d), _companies(s, d))


def _typed(s, d, decomposed=None):
    """Decomposed claims with the entity that their heading is resolved to."""
    # a table of its own: routes, evidence and verdicts all read it
    claims = cut_lineage(_decomposed(s, d) if decomposed is None else decomposed)
    asked = claims.select(F.col("heading").alias("subject")).distinct()
    found = K.resolve_entities(asked, _aliases(s, d), _companies(s, d))
    # facts name companies in full, without the form of the company behind the name
    full = C.read_table(s, d, "customer").select(
        F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("canonical"), F.col("c_name").alias("_full")
    )
    known = found.join(full.hint("merge"), "canonical", "left").select(
        F.col("subject").alias("heading"), "entity_type", F.coalesce("_full", "canonical").alias("canonical")
    )
    return claims.join(known.hint("merge"), "heading", "left")


def _routes(s, d):
    return K.route_claims(_typed(s, d))


def _evidence(s, d, claims=None):
    routes = K.route_claims(_typed(s, d) if claims is None else claims)
    return K.match_facts(routes, S.load_facts(s, d))


def _text_evidence(s, d):
    """Claims about facts and parts, held against articles and notes."""
    claims = S.fact_claims(s, d).select("claim_id", "heading", "sentence", "raw").unionByName(R.part_claims(s, d))
    routes = K.route_claims(_typed(s, d, K.decompose(C.spread(claims, "claim_id"), REFERENCE_YEAR)))
    asked = routes.where(F.col("provider").isin(*E.TEXT_PROVIDERS)).withColumnsRenamed({"canonical": "entity"}).withColumn("subject", F.col("heading"))
    return E.match_texts(asked, E.text_numbers(R.evidence_texts(s, d)))


def _judged(s, d):
    typed = _typed(s, d)
    claims = typed.select("claim_id", "doc_id", "primary_source", "heading", "sentence", "claim_type", "value", "expected")
    return K.verdicts(claims, _evidence(s, d, typed))


def _labelled(judged):
    key = F.length("sentence")
    return judged.select(
        F.col("primary_source").alias("provider"),
        "expected",
        "verdict",
        F.date_sub(F.to_date(F.lit(AS_OF)), (key % 200).cast("int")).alias("as_of_date"),
        (F.col("expected") == "projection").alias("edge"),
    )


def _scores(s, d, judged=None):
    judged = _judged(s, d) if judged is None else judged
    return U.calibration_scores(_labelled(judged), F.to_date(F.lit(AS_OF)))


def _provenance(s, d):
    judged = cut_lineage(_judged(s, d))
    return U.provider_provenance(judged, U.reliability_tiers(_scores(s, d, judged)))


QUERIES = {
    "load_facts": S.load_facts,
    "read_labelled_claims": S.fact_claims,
    "classify_time": lambda s, d: _decomposed(s, d).select(
        "claim_id", "time_period", "period_type", F.col("year").cast("long").alias("year"),
        F.col("quarter").cast("long").alias("quarter"), "reason", "target_year", "target_quarter",
    ),
    "claim_parts": lambda s, d: _decomposed(s, d).select(
        "claim_id", "metric", "value", "unit", "claim_type", "is_segment"
    ),
    "resolve_entity": _resolve,
    "route_claims": lambda s, d: _routes(s, d).select("claim_id", "route_no", "provider"),
    "claim_fact_match": _evidence,
    "claim_text_match": _text_evidence,
    "claim_consensus": lambda s, d: _judged(s, d).select("claim_id", "verdict", "confidence", "best_provider"),
    "confidence_dimensions": lambda s, d: _judged(s, d).select(
        "claim_id", "authority", "precision", "context", "corroboration"
    ),
    "derivation_check": lambda s, d: K.check_derivations(cut_lineage(_judged(s, d))).select(
        "claim_id", "verdict", "confidence"
    ),
    "verification_rollup": lambda s, d: K.verification_rollup(_judged(s, d)),
    "provider_provenance": _provenance,
    "calibration_scores": _scores,
    "reliability_tiers": lambda s, d: U.reliability_tiers(_scores(s, d)),
}
