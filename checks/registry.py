"""All checking SQL by query name."""

from __future__ import annotations

from checks import claims_sql, corpus_sql, evidence_sql, facts_sql, frames_sql, framing_sql, grounding_sql, labels_sql, lexicon_sql, located_sql, pairs_sql, stream_sql, subjects_sql, text_sql, verdicts_sql

SQL = {**text_sql.SQL, **framing_sql.SQL, **claims_sql.SQL, **grounding_sql.SQL, **frames_sql.SQL, **pairs_sql.SQL, **corpus_sql.SQL, **facts_sql.SQL, **evidence_sql.SQL, **labels_sql.SQL, **lexicon_sql.SQL, **located_sql.SQL, **subjects_sql.SQL, **verdicts_sql.SQL, **stream_sql.SQL}
