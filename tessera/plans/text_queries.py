"""Queries over the text stage."""

from __future__ import annotations

from tessera.operators import text_tables as X
from tessera.sources import corpus as C

QUERIES = {
    "read_corpus": lambda s, d: C.corpus_entries(s, d),
    "content_hash": lambda s, d: X.content_hashes(C.documents(s, d)),
    "state_hash": lambda s, d: X.state_hash(C.documents(s, d)),
    "lines_with_heading": lambda s, d: X.lines_with_heading(C.documents(s, d)),
    "sentences": lambda s, d: X.sentences(C.documents(s, d)),
    "sentences_simple": lambda s, d: X.sentences_simple(C.documents(s, d)),
    "headings": lambda s, d: X.headings(C.documents(s, d)),
    "section_bodies": lambda s, d: X.section_bodies(C.documents(s, d)),
    "tokens": lambda s, d: X.tokens(C.documents(s, d)),
    "year_mentions": lambda s, d: X.year_mentions(C.documents(s, d)),
    "clean_documents": lambda s, d: X.content_hashes(X.quarantine(C.documents(s, d))[0]),
    "quarantined_documents": lambda s, d: X.content_hashes(X.quarantine(C.documents(s, d))[1]),
    "unsafe_text_flag": lambda s, d: X.split_unsafe(C.documents(s, d)).select("doc_id", "unsafe"),
}
