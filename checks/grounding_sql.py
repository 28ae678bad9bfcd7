"""SQL for documents beside their sources."""

from __future__ import annotations

from checks.claims_sql import number_chain
from checks.framing_sql import STOP
from checks.sql import CTES, ascii_letters, has, lit, query, r, strip
from tessera.functions import vocabulary as V
from tessera.operators import grounding as G
from tessera.sources.seeding import SOURCES

_whens = " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(SOURCES))
CTES["srcs"] = (
    (),
    f"""SELECT doc_id, CASE doc_id % {len(SOURCES)} {_whens} END || chr(10) || b.text AS text
    FROM documents d LEFT JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)""",
)
number_chain("s_", "srcs")
CTES["sfloat"] = (
    ("s_datanums",),
    "SELECT DISTINCT doc_id, TRY_CAST(value AS DOUBLE) AS x FROM s_datanums WHERE TRY_CAST(value AS DOUBLE) IS NOT NULL",
)
CTES["ptexts"] = (("plain",), "SELECT doc_id * 100000 + sent_no AS doc_id, sentence AS text FROM plain")
number_chain("p_", "ptexts")

_COMMA = "CASE WHEN NOT contains(value, '.') AND length(value) > 3 THEN format('{:,}', TRY_CAST(value AS BIGINT)) END"


def in_source(src: str) -> str:
    return rf"""CASE type
      WHEN 'percentage' THEN regexp_matches({src}, '(?i)' || regexp_escape(value) || '\s*(?:%|percent)')
        OR (contains(value, '.') AND regexp_matches({src}, '(?i)' || string_split(value, '.')[1] || '\s*(?:%|percent)'))
      WHEN 'dollar' THEN contains({src}, '$' || value) OR coalesce(contains({src}, '$' || {_COMMA}), false)
      WHEN 'multiplier' THEN contains({src}, value || 'x') OR contains({src}, value || 'X')
      ELSE regexp_matches({src}, '(?:^|[^0-9])' || regexp_escape(value) || '(?:$|[^0-9])')
        OR coalesce(regexp_matches({src}, '(?:^|[^0-9])' || ({_COMMA}) || '(?:$|[^0-9])'), false) END"""


def close(made: str, v: str, tol: float) -> str:
    return (
        f"CASE WHEN abs({v}) < 0.001::DOUBLE THEN abs({made}) < 0.001::DOUBLE "
        f"ELSE abs({made} - {v}) / abs({v}) < {tol}::DOUBLE END"
    )


def derived(numbers: str) -> str:
    """(doc_id, value) of numbers that are arithmetic of one or two source numbers."""
    v = "n.v"
    return f"""SELECT DISTINCT n.key, n.v FROM (SELECT DISTINCT doc_id AS key, src AS doc_id, TRY_CAST(value AS DOUBLE) AS v FROM {numbers}) n
      JOIN sfloat a ON a.doc_id = n.doc_id JOIN sfloat b ON b.doc_id = n.doc_id WHERE n.v IS NOT NULL AND (
        {close("a.x / 100", v, .02)} OR {close("a.x * 100", v, .02)}
        OR (a.x <> 0 AND b.x <> 0 AND ({close("a.x / b.x * 100", v, .01)} OR {close("a.x / b.x", v, .02)} OR {close("a.x * b.x", v, .01)}))
        OR {close("(a.x + b.x)", v, .02)}
        OR (abs(a.x - b.x) > 0.001::DOUBLE AND {close("(a.x - b.x)", v, .02)})
        OR (a.x <> b.x AND {close("(a.x - b.x)", v, .01)})
        OR (a.x > 0 AND a.x <= 100 AND {close("a.x / 100 * b.x", v, .01)}))"""


CTES["dnum"] = (("datanums",), "SELECT *, doc_id AS src FROM datanums")
CTES["pnum"] = (("p_datanums",), "SELECT *, doc_id // 100000 AS src FROM p_datanums")
CTES["dder"] = (("dnum", "sfloat"), derived("dnum"))
CTES["pder"] = (("pnum", "sfloat"), derived("pnum"))
CTES["backed"] = (
    ("dnum", "srcs"),
    f"""SELECT n.doc_id, row_number() OVER (PARTITION BY n.doc_id ORDER BY rank, a) - 1 AS number_no, type, value, {in_source("s.text")} AS in_source
    FROM dnum n JOIN srcs s ON s.doc_id = n.doc_id""",
)
CTES["body"] = (
    ("docs",),
    r"SELECT doc_id, regexp_replace(regexp_replace(text, '(?m)^#{1,6}\s+.*$', '', 'g'), '\|[^\n]+\|', '', 'g') AS b FROM docs",
)
_ents = []
for _i, (_rule, _kind, _pat, _ahead) in enumerate(G.ENTITY_RULES):
    if _rule == "ORG_CAMEL":
        _pat = r"\b([A-Z][a-z]+[A-Z][a-zA-Z]+)\b"
    _value = (
        f"concat_ws(' ', regexp_extract(raw, {lit(_pat)}, 1), regexp_extract(raw, {lit(_pat)}, 2))"
        if _rule == "CITATION"
        else strip(f"regexp_extract(raw, {lit(_pat)}, 1)")
    )
    _t = ascii_letters("b", "0") if _rule == "ORG_CAMEL" else "b"
    _ents.append(
        f"""SELECT doc_id, {_i} AS ord, '{_rule}' AS rule, '{_kind}' AS type, {_value} AS value, k, {_ahead} AS ahead, b,
          e - length(raw) AS a, e FROM (
          SELECT *, sum(length(piece) + length(raw)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
            SELECT doc_id, b, unnest(h) AS raw, unnest(range(len(h))) AS k, unnest(p[:len(h)]) AS piece FROM (
              SELECT doc_id, b, regexp_extract_all({_t}, {lit(_pat)}) AS h, string_split_regex({_t}, {lit(_pat)}) AS p FROM body)))"""
    )
CTES["ents"] = (
    ("body",),
    f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY ord, k) - 1 AS mention_no, rule, type, value,
      {strip("substr(b, CAST(greatest(a - ahead, 0) AS BIGINT) + 1, CAST(e + 30 - greatest(a - ahead, 0) AS BIGINT))")} AS context FROM (
      SELECT *, row_number() OVER (PARTITION BY doc_id, rule, value ORDER BY k) AS nth FROM ({" UNION ALL ".join(_ents)})
      WHERE CASE rule WHEN 'PERSON' THEN NOT regexp_matches(lower(value), 'source|extends|mechanism|falsifier|section')
                      WHEN 'ATTRIBUTED' THEN lower(value) NOT IN ('source', 'the', 'this', 'one')
                      WHEN 'CITATION' THEN NOT contains(lower(value), 'source') ELSE true END) WHERE nth = 1""",
)
CTES["entback"] = (
    ("ents", "srcs"),
    f"""SELECT e.doc_id, mention_no, rule, value, contains(lower(s.text), lower(value))
      OR (len(ws) > 0 AND len(list_filter(ws, lambda w: NOT contains(lower(s.text), lower(w)))) = 0) AS in_source
    FROM (SELECT *, list_filter(string_split_regex(value, '\\s+'), lambda w: length(w) > 3 AND lower(w) NOT IN ({STOP})) AS ws FROM ents) e
    JOIN srcs s ON s.doc_id = e.doc_id""",
)
CTES["pwords"] = (
    ("plain", "srcs"),
    f"""SELECT w.doc_id, w.sent_no, count(*) AS n_words, count(*) FILTER (s.w IS NOT NULL) AS n_known,
      count(DISTINCT w.w) AS n_types, count(DISTINCT s.w) AS n_known_types FROM (
      SELECT * FROM (SELECT doc_id, sent_no, unnest(regexp_extract_all(lower(sentence), '[a-z]{{3,}}')) AS w FROM plain) WHERE w NOT IN ({STOP})) w
    LEFT JOIN (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS w FROM srcs) s ON s.doc_id = w.doc_id AND s.w = w.w
    GROUP BY w.doc_id, w.sent_no""",
)
CTES["pback"] = (
    ("pnum", "srcs", "pder"),
    f"""SELECT x.doc_id AS key, raw, value, in_src, d.v IS NOT NULL AS der FROM (
        SELECT n.doc_id, n.raw, n.value, {in_source("s.text")} AS in_src FROM pnum n JOIN srcs s ON s.doc_id = n.src) x
      LEFT JOIN pder d ON d.key = x.doc_id AND d.v = TRY_CAST(x.value AS DOUBLE)""",
)
CTES["asserted"] = (
    ("plain", "pwords", "pback", "srcs"),
    f"""SELECT p.doc_id, p.sent_no, coalesce(k.any_num, false) AS sourced_number,
      len(list_filter(regexp_extract_all(p.sentence, '[A-Z][a-z]+(?:\\s+[A-Z][a-z]+)+'), lambda x: contains(lower(s.text), lower(x)))) > 0 AS sourced_name,
      coalesce(n_known / n_words > 0.5::DOUBLE, false) AS close_words
    FROM plain p JOIN srcs s ON s.doc_id = p.doc_id LEFT JOIN pwords w ON w.doc_id = p.doc_id AND w.sent_no = p.sent_no
    LEFT JOIN (SELECT key, bool_or(in_src) AS any_num FROM pback GROUP BY key) k ON k.key = p.doc_id * 100000 + p.sent_no
    WHERE {has(ascii_letters("p.sentence"), V.FIRM_ASSERTION)}""",
)


def _years(x: str) -> str:
    return (
        f"list_transform(list_concat(regexp_extract_all({x}, {lit(V.YEAR)}, 1), "
        f"regexp_extract_all({x}, {lit(V.FISCAL_YEAR)}, 1)), lambda y: CAST(y AS BIGINT))"
    )


CTES["labelled"] = (
    ("plain", "pwords", "pback", "srcs"),
    rf"""SELECT doc_id, sent_no, CASE WHEN len < 20 THEN 'SKIP' WHEN uns OR ext OR yr THEN 'P'
        WHEN CASE WHEN backed THEN 0.5::DOUBLE ELSE 0 END + ov * 0.3::DOUBLE + CASE WHEN backed AND NOT uns THEN 0.2::DOUBLE ELSE 0 END >= 0.4::DOUBLE THEN 'G' ELSE 'F' END AS label,
      CASE WHEN len >= 20 AND (uns OR ext OR yr) THEN
        array_to_string(list_filter([CASE WHEN uns THEN 'unsourced_numbers' END, CASE WHEN ext THEN 'external_entities' END, CASE WHEN yr THEN 'unsourced_years' END], lambda x: x IS NOT NULL), '+') END AS reason
    FROM (SELECT p.doc_id, p.sent_no, length({strip("regexp_replace(p.sentence, '[#*|_-]', '', 'g')")}) AS len,
        coalesce(n_uns > 0, false) AS uns, coalesce(n_backed > 0, false) AS backed,
        {has(ascii_letters("p.sentence"), V.EXTERNAL_NAME)} AS ext, coalesce(n_known_types / n_types, 0.0::DOUBLE) AS ov,
        len(list_filter({_years(ascii_letters("p.sentence"))}, lambda y: NOT list_contains({_years(ascii_letters("s.text"))}, y))) > 0
          AND (coalesce(n_uns > 0, false) OR length({strip("regexp_replace(p.sentence, '[#*|_-]', '', 'g')")}) > 50) AS yr
      FROM plain p JOIN srcs s ON s.doc_id = p.doc_id LEFT JOIN pwords w ON w.doc_id = p.doc_id AND w.sent_no = p.sent_no
      LEFT JOIN (SELECT key, count(*) FILTER (in_src OR der) AS n_backed,
          count(*) FILTER (NOT in_src AND NOT der AND NOT coalesce(TRY_CAST(value AS DOUBLE) = round(TRY_CAST(value AS DOUBLE)) AND TRY_CAST(value AS DOUBLE) BETWEEN 1 AND 10, false)
            AND NOT regexp_matches(sentence, '\b' || regexp_escape(raw) || '\s*[-]\s*\d+\b')) AS n_uns
        FROM pback JOIN (SELECT doc_id * 100000 + sent_no AS k2, sentence FROM plain) ON k2 = key GROUP BY key) k
        ON k.key = p.doc_id * 100000 + p.sent_no)""",
)


def _prec(n: str, a: int, b: int) -> str:
    return f"CASE WHEN {n} < {a} THEN 'low' WHEN {n} < {b} THEN 'adequate' ELSE 'good' END"


CTES["fidelity"] = (
    ("docs", "backed"),
    f"""SELECT doc_id, checked, verified, CASE WHEN checked > 0 THEN {r("(checked - verified) / checked", 3)} ELSE 0.0 END AS unsourced_rate,
      {_prec("checked", 10, 30)} AS fidelity_precision FROM (
      SELECT d.doc_id, count(b.doc_id) AS checked, count(*) FILTER (in_source) AS verified FROM docs d LEFT JOIN backed b ON b.doc_id = d.doc_id GROUP BY d.doc_id)""",
)
CTES["entprov"] = (
    ("docs", "entback"),
    f"""SELECT doc_id, total_entities, entities_in_source, CASE WHEN total_entities > 0 THEN {r("(total_entities - entities_in_source) / total_entities", 3)} ELSE 0.0 END AS unsourced_entity_rate,
      {_prec("total_entities", 5, 15)} AS entity_precision FROM (
      SELECT d.doc_id, count(b.doc_id) AS total_entities, count(*) FILTER (in_source) AS entities_in_source FROM docs d LEFT JOIN entback b ON b.doc_id = d.doc_id GROUP BY d.doc_id)""",
)
CTES["calib"] = (
    ("docs", "asserted"),
    f"""SELECT doc_id, n AS total_assertions, g AS grounded_assertions, CASE WHEN n > 0 THEN {r("g / n", 3)} END AS calibration_score,
      CASE WHEN n > 0 THEN {r("(n - g) / n", 3)} END AS overclaiming_rate, {_prec("n", 5, 15)} AS calibration_precision FROM (
      SELECT d.doc_id, count(a.doc_id) AS n, count(*) FILTER (sourced_number OR sourced_name OR close_words) AS g
      FROM docs d LEFT JOIN asserted a ON a.doc_id = d.doc_id GROUP BY d.doc_id)""",
)

SQL = {
    "entity_mentions": query("SELECT * FROM ents", "ents"),
    "number_in_source": query("SELECT * FROM backed", "backed"),
    "derivable_numbers": query(
        """SELECT b.doc_id, number_no, type, value, d.v IS NOT NULL AS derivable FROM backed b
        LEFT JOIN dder d ON d.key = b.doc_id AND d.v = TRY_CAST(b.value AS DOUBLE)""",
        "backed",
        "dder",
    ),
    "entity_in_source": query("SELECT * FROM entback", "entback"),
    "vocab_overlap": query(f"SELECT doc_id, sent_no, n_words, n_known, {r('n_known / n_words', 3)} AS overlap FROM pwords", "pwords"),
    "assertion_grounding": query(
        "SELECT *, sourced_number OR sourced_name OR close_words AS grounded FROM asserted", "asserted"
    ),
    "unsourced_years": query(
        f"""SELECT DISTINCT d.doc_id, unnest(list_filter({_years(ascii_letters("d.text"))}, lambda y: NOT list_contains({_years(ascii_letters("s.text"))}, y))) AS year
        FROM docs d JOIN srcs s ON s.doc_id = d.doc_id""",
        "docs",
        "srcs",
    ),
    "grounding_labels": query("SELECT * FROM labelled", "labelled"),
    "source_fidelity": query("SELECT * FROM fidelity", "fidelity"),
    "entity_provenance": query("SELECT * FROM entprov", "entprov"),
    "vocabulary_proximity": query(
        f"""SELECT d.doc_id, CASE WHEN k > 0 THEN n ELSE 0 END AS proximity_sentences, coalesce({r("m", 3)}, 0.0) AS mean_proximity,
          CASE WHEN k > 0 THEN {r("md", 3)} END AS median_proximity, coalesce(low, 0) AS low_proximity_count,
          CASE WHEN k > 0 THEN {r("low / n", 3)} END AS low_proximity_rate
        FROM docs d LEFT JOIN (SELECT doc_id, count(*) AS n FROM plain GROUP BY doc_id) p ON p.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS k, avg(n_known / n_words) AS m, median(n_known / n_words) AS md,
                   count(*) FILTER (n_known / n_words < 0.5) AS low FROM pwords GROUP BY doc_id) w ON w.doc_id = d.doc_id""",
        "docs",
        "plain",
        "pwords",
    ),
    "epistemic_calibration": query("SELECT * FROM calib", "calib"),
    "grounding_mix": query(
        f"""SELECT *, CASE WHEN n > 0 THEN {r("n_grounded / n", 3)} ELSE 0.0 END AS grounded_share, CASE WHEN n > 0 THEN {r("n_framed / n", 3)} ELSE 0.0 END AS framed_share,
          CASE WHEN n > 0 THEN {r("n_projected / n", 3)} ELSE 0.0 END AS projected_share,
          CASE WHEN source_numbers < 10 THEN 'diagnostic' WHEN source_numbers < 15 THEN 'transition' ELSE 'saturated' END AS derivation_regime FROM (
          SELECT d.doc_id, count(*) FILTER (label = 'G') AS n_grounded, count(*) FILTER (label = 'F') AS n_framed, count(*) FILTER (label = 'P') AS n_projected,
            count(*) FILTER (label = 'SKIP') AS n_skipped, count(*) FILTER (label IN ('G', 'F', 'P')) AS n, any_value(coalesce(sn, 0)) AS source_numbers
          FROM docs d LEFT JOIN labelled l ON l.doc_id = d.doc_id
          LEFT JOIN (SELECT doc_id, count(*) AS sn FROM sfloat GROUP BY doc_id) s ON s.doc_id = d.doc_id GROUP BY d.doc_id)""",
        "docs",
        "labelled",
        "sfloat",
    ).replace("SELECT *, CASE WHEN n > 0", "SELECT * EXCLUDE (n), CASE WHEN n > 0", 1),
    "quality_profile": query(
        f"""SELECT doc_id, {r("s", 3)} AS substance_index, {r("p", 3)} AS presentation_index, {r("p - s", 3)} AS quality_gap,
          CASE WHEN p - s > 0.1::DOUBLE THEN 'overclaiming' WHEN p - s < -0.1::DOUBLE THEN 'understated' WHEN p - s IS NOT NULL THEN 'balanced' ELSE 'insufficient_data' END AS gap_direction,
          n_substance, CAST(3 AS BIGINT) AS n_presentation FROM (
          SELECT doc_id, list_sum(sub) / len(sub) AS s, (assertiveness_ratio + least(formatting_density / 3, 1) + type_token_ratio) / 3 AS p, CAST(len(sub) AS BIGINT) AS n_substance FROM (
            SELECT st.*, list_filter([CASE WHEN fidelity_precision <> 'low' THEN 1 - unsourced_rate END, CASE WHEN entity_precision <> 'low' THEN 1 - unsourced_entity_rate END,
                CASE WHEN calibration_precision <> 'low' THEN calibration_score END], lambda x: x IS NOT NULL) AS sub
            FROM styled st JOIN fidelity USING (doc_id) JOIN entprov USING (doc_id) JOIN calib USING (doc_id)))""",
        "styled",
        "fidelity",
        "entprov",
        "calib",
    ),
}
