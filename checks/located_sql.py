"""SQL for the sentences of places, and for the review lists."""

from __future__ import annotations

from checks import claims_sql as _cs, framing_sql as F  # noqa: F401  (register CTEs)
from checks.sql import CTES, has, lit, query, strip
from tessera.functions import vocabulary as V

_WS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"
_lead = lambda x: f"(length({x}) - length(ltrim({x}, {_WS})))"
# lines with their place in the text; the blocks are numbered as those of `blocks`
CTES["lplaces"] = (
    ("docs", "lines"),
    f"""SELECT *, sum(size + 1) OVER (PARTITION BY doc_id, block_no ORDER BY line_no) - size - 1 AS off FROM (
      SELECT l.doc_id, l.line_no, x.at + x.lead AS at, length(l.line) AS size, dense_rank() OVER (PARTITION BY l.doc_id ORDER BY b) - 1 AS block_no FROM (
        SELECT *, sum(CASE WHEN kind <> 'text' OR prev IS DISTINCT FROM 'text' THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS b FROM (
          SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM lines)) l
      JOIN (SELECT doc_id, k AS line_no, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) - 1 AS at, {_lead("raw")} AS lead FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS k FROM docs)) x ON x.doc_id = l.doc_id AND x.line_no = l.line_no
      WHERE kind IN ('text', 'list'))""",
)
CTES["splaces"] = (
    ("blocks",),
    rf"""SELECT doc_id, block_no, row_number() OVER (PARTITION BY doc_id ORDER BY block_no, k) - 1 AS sent_no, marker + s + {_lead("piece")} AS a, marker + s + {_lead("piece")} + length({strip("piece")}) AS e FROM (
      SELECT *, sum(length(piece)) OVER (PARTITION BY doc_id, block_no ORDER BY k) - length(piece) AS s FROM (
        SELECT doc_id, block_no, marker, unnest(ps) AS piece, unnest(range(len(ps))) AS k FROM (
          SELECT doc_id, block_no, length(block) - length(body) AS marker, string_split(regexp_replace(body, '([.!?])(\s+)([A-Z])', '\1' || chr(57344) || '\2\3', 'g'), chr(57344)) AS ps FROM (
            SELECT *, regexp_replace(regexp_replace(block, '^[-*•]\s+', ''), '^\d+\.\s+', '') AS body FROM (
              SELECT doc_id, block, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS block_no FROM blocks))))) WHERE length({strip("piece")}) > 30""",
)


def _in_sentences(name: str, places: str) -> None:
    """CTE of places (doc_id, a, …) with the sentence that holds them."""
    CTES[name] = (
        (places, "lplaces", "splaces"),
        f"""SELECT p.*, s.sent_no FROM {places} p LEFT JOIN lplaces l ON l.doc_id = p.doc_id AND p.a >= l.at AND p.a < l.at + l.size
        LEFT JOIN splaces s ON s.doc_id = p.doc_id AND s.block_no = l.block_no AND l.off + p.a - l.at >= s.a AND l.off + p.a - l.at < s.e""",
    )


_in_sentences("hitsents", "placed")
# RE2 looks at nothing ahead: what may not follow is blotted out first, sign for sign
_PUBLIC = r"(?i)\bt(he\s+public\s+(?:web|domain|sphere|record|opinion|sector|health|good|interest|eye|face|library|school|transport|transit|safety))"
_PERHAPS = r"(?i)\bp(erhaps\s+(?:the|a|an)\s+(?:most|least|best|worst|first|last|defining|leading|dominant|primary|central|key|main|chief|top|greatest))"
CTES["hmasked"] = (("masked",), rf"SELECT doc_id, regexp_replace(regexp_replace(t, {lit(_PUBLIC)}, 'x\1', 'g'), {lit(_PERHAPS)}, 'x\1', 'g') AS t FROM masked")
_hint = {
    "causes": V.PERSPECTIVE_HINTS["causes"], "risks": V.PERSPECTIVE_HINTS["risks"], "trends": V.PERSPECTIVE_HINTS["trends"],
    "stakeholders": r"(?i)\b(?:people\s+who|groups\s+(?:who|affected)|those\s+(?:who|affected|involved|impacted)|anyone\s+who|the\s+public\b|members\s+of|individuals?\s+who)\b",
    "uncertainty": r"(?i)\b(?:might\s+(?:be|have)|perhaps|possibly|conceivably|some\s+doubt|open\s+to\s+(?:debate|question|interpretation)|it\s+is\s+(?:possible|plausible)\s+that)\b",
}
CTES["hints"] = (
    ("hmasked",),
    "SELECT doc_id, class, lower(marker) AS marker, CAST(e - length(marker) AS BIGINT) AS a FROM (SELECT *, sum(length(piece) + length(marker)) OVER (PARTITION BY doc_id, class ORDER BY k) AS e FROM ("
    + " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS class, unnest(h) AS marker, unnest(range(len(h))) AS k, unnest(p[:len(h)]) AS piece FROM (SELECT doc_id, regexp_extract_all(t, {lit(p)}) AS h, string_split_regex(t, {lit(p)}) AS p FROM hmasked)"
        for c, p in _hint.items()
    )
    + "))",
)
_in_sentences("hintsents", "hints")
_note = rf"regexp_extract(ltrim(sentence, {_WS}), '^\[\d{{1,3}}\]')"
_rest = rf"regexp_replace(ltrim(sentence, {_WS}), '^\[\d{{1,3}}\]', '')"
_cite = lit(V.CITATION_HINT)
CTES["missedrows"] = (
    ("hintsents", "cov", "sents", "sflags", "claimrows"),
    rf"""SELECT h.doc_id, h.class, h.sent_no AS place, arg_min(marker, h.a) AS marker, 10 AS most FROM hintsents h JOIN cov c ON c.doc_id = h.doc_id AND c.perspective = h.class AND NOT c.covered WHERE sent_no IS NOT NULL GROUP BY ALL
    UNION ALL SELECT doc_id, 'attribution', sent_no, regexp_replace({strip(f"regexp_extract(CASE WHEN only_note THEN {_rest} ELSE sentence END, {_cite})")}, '\s+', ' ', 'g'), 20 FROM (
      SELECT s.*, {_note} <> '' AND NOT regexp_matches({_rest}, '\[\d{{1,3}}\]') AS only_note FROM sents s JOIN sflags f ON f.doc_id = s.doc_id AND f.sent_no = s.sent_no WHERE NOT f.sourced AND {has("sentence", V.CITATION_HINT)})
      WHERE NOT only_note OR regexp_matches({_rest}, {_cite})
    UNION ALL SELECT doc_id, 'hedge', claim_no, regexp_replace(lower({strip(f"regexp_extract(sentence, {lit(V.CLAIM_HEDGE_HINT)})")}), '\s+', ' ', 'g'), 10 FROM claimrows WHERE NOT bullet AND framing <> 'hedged' AND {has("sentence", V.CLAIM_HEDGE_HINT)}""",
)
SQL = {
    "hit_to_sentence": query(r"SELECT doc_id, perspective, lower(regexp_replace(marker, '\s+', ' ', 'g')) AS marker, a AS start, sent_no FROM hitsents", "hitsents"),
    "candidate_miss": query("SELECT doc_id, class, place, marker FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, class ORDER BY place) AS n FROM missedrows) WHERE n <= most", "missedrows"),
}
