"""Queries over the claims that documents make: headings, entities, subjects."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import evidence as E, facts as K, subjects as J
from tessera.plans.fact_queries import _aliases, _companies
from tessera.plans.signals import REFERENCE_YEAR
from tessera.session import written
from tessera.sources import corpus as C, facts as S, reports as R


class Held:
    """What the jobs on the claims of documents share; each part is written once."""

    def __init__(self, s, d):
        self.aliases = _aliases(s, d)
        self.countries = J.country_pattern(self.aliases)
        # The texts are read by two passes; they are joined with their section once.
        self.docs = written(R.reports(s, d))
        self.held = J.document_claims(self.docs, self.countries)

    def common(self):
        return written(J.common_words(self.docs))

    def claims(self):
        return written(J.with_found_headings(J.claim_table(self.held), self.held))


class Checked(Held):
    """Claims of documents that have been put to facts and texts."""

    def __init__(self, s, d):
        super().__init__(s, d)
        words, claims = self.common(), self.claims()
        entities = J.primary_entity(self.held, words)
        subjects = written(J.claim_subjects(claims, entities, words, self.countries))
        rows = claims.join(subjects, ["doc_id", "claim_no"]).select(
            F.concat_ws("-", "doc_id", "claim_no").alias("claim_id"), "doc_id", "claim_no", "heading", "sentence", "raw", "subject"
        )
        # customers are also known by their signs; facts name them in full
        signs = R.customers(s, d).select(F.lower("sign").alias("alias"), F.lit("company").alias("entity_type"), F.col("entity").alias("canonical"))
        asked = subjects.select("subject").distinct()
        found = K.resolve_entities(asked, self.aliases.unionByName(signs), _companies(s, d))
        full = C.read_table(s, d, "customer").select(F.concat(F.lit("T"), F.col("c_custkey").cast("string")).alias("canonical"), F.col("c_name").alias("_full"))
        known = found.join(full.hint("merge"), "canonical", "left").select("subject", "entity_type", F.coalesce("_full", "canonical").alias("canonical"))
        like = J.entity_like(asked, words)
        self.typed = written(K.decompose_copies(rows, REFERENCE_YEAR).join(known, "subject").join(like, "subject"))
        routes = written(K.route_claims(self.typed))
        facts = K.match_facts(routes, S.load_facts(s, d))
        asked = routes.where(F.col("provider").isin(*E.TEXT_PROVIDERS)).withColumnRenamed("canonical", "entity")
        texts = E.match_texts(asked, E.text_numbers(R.evidence_texts(s, d)))
        self.evidence = written(facts.unionByName(texts.drop("text_id")))
        self.judged = written(K.verdicts(self.typed, self.evidence))

    def searched(self, limit=E.OPEN_CLAIMS):
        """Evidence that the texts of the corpus hold for claims that are open: the first of a document, or all."""
        asked = written(E.open_claims(self.judged, limit))
        numbers, held = written(E.corpus_numbers(self.docs, asked)), E.corpus_words(self.docs, asked)
        return E.search_texts(E.word_claims(asked), numbers, held)

    def final(self, limit=E.OPEN_CLAIMS):
        """Verdicts with the second round of evidence, and with growth recomputed."""
        both = self.evidence.unionByName(self.searched(limit).drop("text_id"))
        return K.check_derivations(written(K.verdicts(self.typed, both)))


def _verdict_rows(judged):
    return judged.select("doc_id", "claim_no", "subject", "verdict", "confidence", "best_provider")


def verdicts_by_document(s, d, limit=E.OPEN_CLAIMS):
    """doc_id → checked, verified, contradicted, disputed, verified_providers, from the claims of the documents themselves."""
    return K.verification_rollup(Checked(s, d).final(limit))


def _headings(s, d):
    held = J.document_claims(R.reports(s, d), J.country_pattern(_aliases(s, d)))
    rows = J.with_found_headings(J.claim_table(held), held)
    return rows.select("doc_id", "claim_no", "heading")


def _primary(s, d):
    h = Held(s, d)
    return J.primary_entity(h.held, h.common())


def _subjects(s, d):
    h = Held(s, d)
    common = h.common()
    return J.claim_subjects(h.claims(), J.primary_entity(h.held, common), common, h.countries)


def _entity_like(s, d):
    """The names that claims may be about: words of their sentences and headings, as they are written."""
    h = Held(s, d)
    claims = J.claim_table(h.held)
    names = F.concat(F.array("heading"), J.find_all(J.names_only(F.col("sentence")), J.PROPER), J.find_all(J.names_only(F.col("sentence")), J.ACRONYM))
    return J.entity_like(claims.select(F.explode(names).alias("subject")), h.common())


QUERIES = {
    "heading_for_number": _headings,
    "primary_entity": _primary,
    "entity_like": _entity_like,
    "claim_subject": _subjects,
    "document_verdicts": lambda s, d: _verdict_rows(Checked(s, d).judged),
    "search_fallback": lambda s, d: Checked(s, d).searched(),
    "document_verification": lambda s, d: verdicts_by_document(s, d, limit=None),
}
