"""All queries by name."""

from __future__ import annotations

from tessera.plans import corpus_queries, fact_queries, frame_queries, framing_queries, grounding_queries, label_queries, lexicon_queries, pair_queries, stream_queries, subject_queries, text_queries

QUERIES = {**text_queries.QUERIES, **framing_queries.QUERIES, **grounding_queries.QUERIES, **frame_queries.QUERIES, **pair_queries.QUERIES, **corpus_queries.QUERIES, **fact_queries.QUERIES, **label_queries.QUERIES, **lexicon_queries.QUERIES, **subject_queries.QUERIES, **stream_queries.QUERIES}
