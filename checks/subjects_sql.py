"""SQL for the claims that documents make: headings, entities, subjects."""

from __future__ import annotations

from checks import claims_sql as _cs, facts_sql as _fs  # noqa: F401  (register CTEs)
from checks.claims_sql import claim_chain, number_chain
from checks.sql import CTES, lit, query, sentence_chain, strip
from tessera.operators import subjects as J

_NL = "chr(10) || chr(10)"
_sign = "translate(lpad(CAST(c_custkey AS VARCHAR), 8, '0'), '0123456789', 'ABCDEFGHIJ')"
CTES["custs"] = (
    (),
    f"""SELECT c_custkey AS custkey, c_name AS entity, n_name AS nation, {_sign} AS sign, upper(left({_sign}, 1)) || lower(substr({_sign}, 2)) AS name,
      row_number() OVER (ORDER BY c_custkey) - 1 AS number FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""",
)
CTES["annual"] = (
    (),
    "SELECT o_custkey AS custkey, CAST(year(o_orderdate) + 20 AS BIGINT) AS year, CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL",
)
CTES["replines"] = (
    ("docs", "custs", "annual"),
    """SELECT doc_id, year, CASE doc_id % 6 WHEN 1 THEN 'In ' || said || ' firms of ' || nation || ' reported revenue of ' || money || ' to it.' WHEN 2 THEN 'In ' || said || ' the total revenue of ' || sign || ' came to ' || money || '.'
        WHEN 3 THEN 'In ' || said || ' the revenue of ' || name || ' was ' || money || '.' WHEN 4 THEN 'In ' || said || ' the annual revenue came to ' || money || '.' ELSE 'In ' || said || ' it reported revenue of ' || money || '.' END AS line
    FROM (SELECT *, CAST(year + CASE WHEN pick = 4 THEN 1 ELSE 0 END AS VARCHAR) AS said, '$' || CAST(CAST(round_even(cents / 100.0::DOUBLE * [1.0, 1.02, 1.1, 3.0, 1.0, 1.0][CAST(pick AS INT) + 1]::DOUBLE, 0) AS BIGINT) AS VARCHAR) AS money
      FROM (SELECT d.doc_id, c.*, a.year, a.cents, (d.doc_id % 6 + a.year) % 6 AS pick FROM docs d JOIN custs c ON c.number = d.doc_id % (SELECT count(*) FROM custs) JOIN annual a ON a.custkey = c.custkey))""",
)
CTES["reports"] = (
    ("docs", "custs", "replines"),
    f"""SELECT d.doc_id, ['', '', 'Northwind program', '', 'the tides'][CAST(d.doc_id % 5 AS INT) + 1] AS topic, text || {_NL} || '## ' || CASE d.doc_id % 6 WHEN 0 THEN entity WHEN 1 THEN 'Overview' WHEN 2 THEN 'Financial results' WHEN 3 THEN 'Summary' ELSE 'Outlook' END || {_NL}
      || CASE d.doc_id % 6 WHEN 5 THEN 'All figures are those of ' || name || '.' || {_NL} WHEN 4 THEN name || ' is meant by the house, and ' || name || ' alone.' || {_NL} ELSE '' END
      || coalesce(lines, '') || CASE WHEN d.doc_id % 4 = 0 THEN {_NL} || 'The revenue grew 25% in 2018 on the year.' ELSE '' END AS text
    FROM docs d JOIN custs c ON c.number = d.doc_id % (SELECT count(*) FROM custs) LEFT JOIN (SELECT doc_id, string_agg(line, {_NL} ORDER BY year) AS lines FROM replines GROUP BY doc_id) l ON l.doc_id = d.doc_id""",
)
sentence_chain("rp_", "reports")
number_chain("rp_", "reports")
claim_chain("rp_")


def names_only(text: str) -> str:
    return rf"regexp_replace(regexp_replace({text}, '[\x{{0080}}-\x{{00A9}}\x{{2000}}-\x{{206F}}]', ' ', 'g'), '[^\x00-\x7F]', '0', 'g')"


ACRONYM = r"\b[A-Z]{2,}(?:\s+[A-Z][a-z]+)*\b"
PROPER = r"\b[A-Z][a-z]+(?:\s+(?:of|the|and|for|in|de|von|van)\s+)?(?:\s+[A-Z][a-z]+)*\b"
SHORT = r"\b(?:U\.?S\.?A?\.?|U\.?K\.?|EU)\b"
COUNTRY = r"(?i)\bNATION_[0-9]+\b"
_in = lambda words: "(" + ", ".join(map(lit, words)) + ")"


def every(text: str, pattern: str) -> str:
    return f"regexp_extract_all({text}, {lit(pattern)})"


def short(found: str) -> str:
    return f"CASE replace({found}, '.', '') WHEN 'US' THEN 'United States' WHEN 'USA' THEN 'United States' WHEN 'UK' THEN 'United Kingdom' WHEN 'EU' THEN 'European Union' END"


def country_in(text: str) -> str:
    return f"coalesce(upper(nullif(regexp_extract({text}, {lit(COUNTRY)}), '')), {short(f'nullif(regexp_extract({text}, {lit(SHORT)}), {lit("")})')})"


def name_words(phrase: str) -> str:
    return (
        rf"list_filter(string_split_regex({strip(phrase)}, '\s+'), lambda w: lower(w) NOT IN {_in(J.NO_ENTITY)} AND length(w) >= 3 AND ((w = upper(w) AND regexp_matches(w, '[A-Z]')) OR (regexp_matches(w, '^[A-Z]') AND regexp_matches(w, '[a-z]'))))"
    )


CTES["common"] = (
    ("reports",),
    rf"""SELECT lower(w) AS word FROM (SELECT unnest({every(names_only("text"), r"\b[A-Za-z]{2,}\b")}) AS w FROM reports) WHERE regexp_matches(w, '^[A-Za-z][a-z]+$')
    GROUP BY 1 HAVING sum(CASE WHEN w = lower(w) THEN 1 ELSE -1 END) >= 0""",
)
CTES["heads"] = (
    ("reports",),
    rf"""SELECT doc_id, topic, unnest(list_transform({every("t", COUNTRY)}, lambda m: upper(m)) || list_filter(list_transform({every("t", SHORT)}, lambda m: {short("m")}), lambda x: x IS NOT NULL) || {every("t", r"\b[A-Z]{3,}\b")}
      || list_transform({every("t", PROPER)}, lambda m: string_split_regex(regexp_replace({strip("m")}, '^(?:The|A|An)\s+', ''), '\s+')[1])) AS entity
    FROM (SELECT doc_id, topic, regexp_replace(regexp_replace({names_only("text")}, '[#*\[\]()]', ' ', 'g'), '\b_+|_+\b', ' ', 'g') AS t FROM reports)""",
)
CTES["mains"] = (
    ("heads", "common"),
    rf"""SELECT doc_id, CASE WHEN own IS NOT NULL THEN topic_head ELSE top END AS entity, CASE WHEN own IS NOT NULL THEN own ELSE n END AS mentions FROM (
      SELECT doc_id, any_value(topic_head) AS topic_head, arg_min(entity, (-n, entity)) AS top, max(n) AS n, max(CASE WHEN entity = topic_head THEN n END) AS own FROM (
        SELECT doc_id, entity, regexp_replace(string_split_regex({strip("any_value(topic)")}, '\s+')[1], '^(?:The|A|An)\s+', '') AS topic_head, count(*) AS n FROM heads GROUP BY doc_id, entity)
      WHERE len(list_filter({name_words("entity")}, lambda w: lower(w) NOT IN (SELECT word FROM common))) > 0 GROUP BY doc_id) WHERE n >= 2""".replace(
        f"len(list_filter({name_words('entity')}, lambda w: lower(w) NOT IN (SELECT word FROM common))) > 0",
        f"entity IN (SELECT phrase FROM (SELECT phrase, unnest({name_words('phrase')}) AS w FROM (SELECT DISTINCT entity AS phrase FROM heads)) WHERE lower(w) NOT IN (SELECT word FROM common))",
    ),
)
CTES["headlines_at"] = (
    ("reports",),
    rf"""SELECT doc_id, CAST(s AS BIGINT) AS s, CAST(s + length(raw) AS BIGINT) AS e, {strip(rf"regexp_replace({strip('raw')}, '^#+\s*', '')")} AS title FROM (
      SELECT *, sum(length(raw) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(raw) - 1 AS s FROM (
        SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS k FROM reports)) WHERE {strip("raw")} LIKE '#%'""",
)
CTES["found_under"] = (
    ("rp_nums", "headlines_at"),
    "SELECT n.doc_id, n.raw, arg_min(title, a) AS heading FROM rp_nums n ASOF JOIN headlines_at h ON n.doc_id = h.doc_id AND n.a >= h.s WHERE n.a >= h.e AND title <> '' GROUP BY ALL",
)
CTES["dclaims"] = (
    ("rp_claimrows", "rp_claimnums", "found_under"),
    """SELECT c.doc_id, c.claim_no, c.sentence, coalesce(CASE WHEN c.heading = '' THEN u.found END, c.heading) AS heading, c.bullet, x.raws FROM rp_claimrows c
    JOIN (SELECT doc_id, bullet, o1, o2, list(raw ORDER BY nord, nk) AS raws FROM rp_claimnums GROUP BY ALL) x ON x.doc_id = c.doc_id AND x.bullet = c.bullet AND x.o1 = c.o1 AND x.o2 = c.o2
    LEFT JOIN (SELECT n.doc_id, n.bullet, n.o1, n.o2, arg_min(f.heading, (nord, nk)) AS found FROM rp_claimnums n JOIN found_under f ON f.doc_id = n.doc_id AND f.raw = n.raw GROUP BY ALL) u
      ON u.doc_id = c.doc_id AND u.bullet = c.bullet AND u.o1 = c.o1 AND u.o2 = c.o2""",
)
CTES["dheld"] = (
    ("dclaims", "reports"),
    rf"""SELECT *, CASE WHEN instr(text, raw) > 1 THEN {names_only("substr(text, greatest(instr(text, raw) - 201, 0) + 1, least(instr(text, raw) - 1, 200))")} ELSE '' END AS back, {names_only("sentence")} AS sent,
      {names_only(strip(rf"regexp_replace({strip(rf"regexp_replace(heading, '^#+\s*', '')")}, '^\d+\.\s*', '')"))} AS h
    FROM (SELECT c.*, r.topic, r.text, coalesce(list_filter(raws, lambda x: regexp_matches(x, '^[$€£¥₹]|^\d.*[BMT]$'))[1], raws[1], '') AS raw FROM dclaims c JOIN reports r ON r.doc_id = c.doc_id)""",
)
_long = r"len(string_split_regex(h, '\s+')) > 4"
_telling = f"len(list_filter({every('h', '[A-Z][a-z]+')}, lambda w: lower(w) NOT IN {_in(J.DESCRIPTIVE)}))"
_usable = (
    f"length(h) >= 3 AND lower(h) NOT IN {_in(J.GENERIC_HEADINGS)} AND (regexp_matches(h, {lit(COUNTRY)}) OR {_telling} >= 2 OR ({_telling} = 1 AND len({every('h', '[A-Z][a-z]+')}) <= 2) OR regexp_matches(h, '\\b[A-Z]{{2,}}\\b') OR contains(h, '('))"
)
_first = rf"list_filter(string_split_regex(h, '\s+'), lambda w: regexp_matches(w, '^[A-Z]') AND lower(w) NOT IN {_in(J.HEADING_STOP)})[1]"
_trimmed = lambda ps: f"list_filter(list_transform({ps}, lambda p: {strip('p')}), lambda p: length(p) > 2)"
_cands = [
    (1, 0, f"CASE WHEN {_usable} AND {_long} THEN [nullif(regexp_extract(h, '\\b[A-Z]{{2,}}\\b'), '')] ELSE [] END", False),
    (1, 1, f"CASE WHEN {_usable} AND {_long} THEN [{_first}] ELSE [] END", True),
    (1, 2, f"CASE WHEN {_usable} THEN [h] ELSE [] END", True),
    (2, 0, f"[{country_in('sent')}]", True),
    (3, 0, every("sent", ACRONYM), False),
    (4, 0, _trimmed(every("sent", PROPER)), False),
    (5, 0, "[entity]", True),
    (6, 0, f"[{country_in('back')}]", True),
    (
        6, 1,
        f"list_reverse({every('back', J.BARE_ACRONYM)}) || list_filter(list_transform(list_reverse({every('back', PROPER)}), lambda p: regexp_replace({strip('p')}, '^(?:The|A|An)\\s+', '')), lambda p: length(p) > 2)",
        False,
    ),
    (7, 0, f"[nullif({strip('substr(topic, 1, 100)')}, '')]", False),
]
CTES["dcands"] = (
    ("dheld", "mains"),
    " UNION ALL ".join(
        f"SELECT doc_id, claim_no, {tier} AS tier, {place} + unnest(range(len(ps))) AS place, unnest(ps) AS phrase, {str(sure).lower()} AS sure FROM (SELECT c.doc_id, claim_no, {ps} AS ps FROM dheld c LEFT JOIN mains m ON m.doc_id = c.doc_id)"
        for tier, place, ps, sure in _cands
    ),
)
CTES["dsubj"] = (
    ("dheld", "dcands", "common"),
    f"""SELECT c.doc_id, c.claim_no, coalesce(b.subject, '') AS subject, coalesce(b.tier, 0) AS tier FROM dheld c LEFT JOIN (
      SELECT doc_id, claim_no, arg_min(phrase, (tier, place)) AS subject, min(tier) AS tier FROM dcands WHERE phrase IS NOT NULL AND phrase <> ''
        AND (sure OR phrase IN (SELECT phrase FROM (SELECT phrase, unnest({name_words("phrase")}) AS w FROM (SELECT DISTINCT phrase FROM dcands WHERE phrase IS NOT NULL)) WHERE lower(w) NOT IN (SELECT word FROM common)))
      GROUP BY ALL) b ON b.doc_id = c.doc_id AND b.claim_no = c.claim_no""",
)
CTES["dnames"] = (
    ("rp_claimrows",),
    f"""SELECT DISTINCT unnest([heading] || {every("s", PROPER)} || {every("s", ACRONYM)}) AS subject FROM (SELECT heading, {names_only("sentence")} AS s FROM rp_claimrows)""",
)
SQL = {
    "heading_for_number": query("SELECT doc_id, claim_no, heading FROM dclaims", "dclaims"),
    "primary_entity": query("SELECT * FROM mains", "mains"),
    "entity_like": query(
        f"SELECT subject, subject IN (SELECT subject FROM (SELECT subject, unnest({name_words('subject')}) AS w FROM dnames) WHERE lower(w) NOT IN (SELECT word FROM common)) AS entity_like FROM dnames", "dnames", "common"
    ),
    "claim_subject": query("SELECT * FROM dsubj", "dsubj"),
}
