"""SQL for lexicons as tables."""

from __future__ import annotations

from checks import framing_sql as F
from checks.sql import CTES, lit, query, r

_n = lambda t, p: f"len(regexp_extract_all({t}, {lit(p)}))"
# RE2 looks at nothing ahead: what an excluded word follows is taken off
_hits = {c: _n("q", p) for c, p in F.PERSPECTIVES.items()}
_hits["risks"] += " + " + _n("q", r"(?i)\b(?:worries|tensions)\b")
_hits["harbor"] = _n("q", r"(?i)\bports?\b") + " + " + _n("q", r"(?i)\bquays?\b")
_hits["public"] = _n("q", r"(?i)\bthe\s+public\b") + " - " + _n("q", r"(?i)\bthe\s+public\b\s+record")
CTES["lexcov"] = (
    ("qmasked", "doc_words"),
    " UNION ALL ".join(
        f"SELECT d.doc_id, '{c}' AS class, CAST({h} AS BIGINT) AS hits, {r(f'({h}) / greatest(words / 1000.0::DOUBLE, 0.1::DOUBLE)', 1)} AS density, {h} >= 2 AS covered FROM (SELECT doc_id, t AS q FROM qmasked) d JOIN doc_words w ON w.doc_id = d.doc_id"
        for c, h in _hits.items()
    ),
)
SQL = {
    "lexicon_coverage": query("SELECT * FROM lexcov", "lexcov"),
    "lexicon_rates": query(f"SELECT class, count(*) AS documents, count(*) FILTER (covered) AS covered, {r('count(*) FILTER (covered) / count(*)', 4)} AS rate FROM lexcov GROUP BY class", "lexcov"),
    "write_profiles": query("SELECT unnest(['2026-06-30', '2026-07-31']) AS run_date, count(*) AS profiles, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM docs", "docs"),
}
