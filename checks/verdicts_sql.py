"""SQL for claims of documents that are put to facts and texts."""

from __future__ import annotations

from checks import evidence_sql as V, facts_sql as _fs, pairs_sql as P, subjects_sql as _ss  # noqa: F401  (register CTEs)
from checks.evidence_sql import clone, plain, text_matches, text_numbers
from checks.facts_sql import _metric
from checks.frames_sql import HEADLINE, _dis, _gaps, _pos, _sourcing, _voice
from checks.sql import CTES, has, lit, query, strip
from tessera.functions import timeframe as T
from tessera.operators import facts as K
from tessera.operators.claims import SENTENCE_SCALE, UNIT_SCALES

CTES["draw"] = (("dheld", "dsubj"), "SELECT h.doc_id, h.claim_no, h.doc_id || '-' || h.claim_no AS claim_id, h.heading, h.sentence, h.raw, s.subject FROM dheld h JOIN dsubj s ON s.doc_id = h.doc_id AND s.claim_no = h.claim_no")
clone("d", ("vbase",), "v_shown", "draw")
_f = lambda x: P._case(x, UNIT_SCALES, "NULL")
_near = (
    f"list_filter(list_transform(regexp_extract_all(sentence, {lit(SENTENCE_SCALE)}), lambda m: {{'x': TRY_CAST(replace(regexp_extract(m, {lit(SENTENCE_SCALE)}, 1), ',', '') AS DOUBLE), 'f': {_f(f'lower(regexp_extract(m, {lit(SENTENCE_SCALE)}, 2))')}}}), "
    "lambda z: abs(z.x - base) < 0.01::DOUBLE * greatest(abs(z.x), 1))[1].f"
)
_value = f"CASE WHEN base IS NULL THEN 0.0 ELSE base * coalesce(CASE WHEN suf <> '' THEN {_f('suf')} WHEN word <> '' THEN {_f('word')} END, {_near}, 1) END"


def _int(t: str, pattern: str, group: int) -> str:
    return f"TRY_CAST(regexp_extract({t}, {lit(pattern)}, {group}) AS BIGINT)"


def _fine(y: str) -> str:
    return f"({y} BETWEEN 1900 AND 2100)"


def _period() -> str:
    """The kind of period that a claim speaks of: the first rule that fits, the hint before the sentence."""
    aged = lambda y, kind: f"CASE WHEN coalesce(2026 - {y} > 5, false) THEN 'historical' ELSE '{kind}' END"
    out = []
    for pattern, kind in ((T.QUARTER_YEAR, "quarterly"), (None, ""), (T.BETWEEN, "range"), (T.DASHED, "range"), (T.FISCAL, "annual"), (T.BARE_YEAR, "annual"), (T.MONTH_YEAR, "annual"), (T.NOW, "current")):
        for t in ("time_period", "sentence"):
            if pattern is None:
                own, near = _int(t, T.QUARTER_SPELLED, 2), _int("sentence", r"\b(\d{4})\b", 1)
                year = f"CASE WHEN {_fine(own)} THEN {own} WHEN {_fine(near)} THEN {near} END"
                out.append(f"WHEN regexp_extract({t}, {lit(T.QUARTER_SPELLED)}, 1) <> '' THEN {aged(year, 'quarterly')}")
            elif kind == "range":
                out.append(f"WHEN {_fine(_int(t, pattern, 1))} AND {_fine(_int(t, pattern, 2))} THEN 'range'")
            elif kind == "current":
                out.append(f"WHEN {has(t, pattern)} THEN 'current'")
            else:
                y = _int(t, pattern, 2 if kind == "quarterly" else 1)
                out.append(f"WHEN {_fine(y)} THEN {aged(y, kind)}")
    return "CASE " + " ".join(out) + " ELSE 'unknown' END"


_bare = r"string_split(trim(regexp_replace(raw, '^[$€£¥₹]+', '')), ' ')[1]"
_found = f"CASE WHEN regexp_extract(sentence, {lit(T.TIME_MENTION)}, 1) <> '' THEN regexp_extract(sentence, {lit(T.TIME_MENTION)}, 1) ELSE regexp_extract(heading, {lit(T.TIME_MENTION)}, 1) END"
_year = r"regexp_extract(found, '20[1-3]\d')"
CTES["dparts"] = (
    ("dvbase",),
    rf"""SELECT *, {_period()} AS period_type, TRY_CAST(coalesce(nullif(regexp_extract(time_period, '20[1-3]\d'), ''), nullif(regexp_extract(sentence, '(?i)(?:fiscal\s+(?:year\s+)?|FY\s*)?(20[1-3]\d)', 1), '')) AS BIGINT) AS target_year,
        coalesce({_int("time_period", "(?i)Q([1-4])", 1)}, {_int("sentence", "(?i)Q([1-4])", 1)}) AS target_quarter,
        CASE WHEN regexp_matches(raw, '^[$€£¥₹]') OR {has("sentence", "[€£¥₹]")} OR {has("sentence", T.CURRENCY_WORD)} THEN 'currency' WHEN raw LIKE '%\%' ESCAPE '\' OR {has("sentence", "(?i)percent")} THEN 'percent'
          WHEN {has("sentence", T.DISTANCE)} THEN 'distance' WHEN {has("sentence", T.MASS)} THEN 'mass' WHEN {has("sentence", T.DURATION)} AND metric = 'lifespan' THEN 'time' ELSE 'count' END AS unit,
        CASE WHEN {has("sentence", T.PROJECTED)} THEN 'projection' WHEN {has("sentence", T.DERIVED)} AND contains(raw, '%') THEN 'derived' ELSE 'direct' END AS claim_type,
        {has("sentence || ' ' || heading", T.SEGMENT)} OR {has("sentence || ' ' || heading", T.SEGMENT_LINE)} AS is_segment
      FROM (SELECT *, CASE WHEN {_year} <> '' AND bare <> '' AND len(list_filter(windows, lambda w: contains(w, bare))) > 0 THEN replace(found, {_year}, CAST(CAST({_year} AS BIGINT) - 1 AS VARCHAR)) ELSE found END AS time_period
        FROM (SELECT *, {_value} AS value, {_metric} AS metric, {_found} AS found, {_bare} AS bare, list_transform(string_split_regex(sentence, {lit(T.PRIOR_YEAR)})[2:], lambda x: left(x, 50)) AS windows FROM dvbase))""",
)
_up = r"upper(regexp_replace(trim(subject), '[.,;:!?\x22'')]+$', ''))"
CTES["dtitles"] = ((), "SELECT 'T' || c_custkey AS ticker, upper(c_name || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Inc' ELSE ' Corp' END) AS title, c_name FROM customer")
CTES["dnamed"] = (
    ("dsubj", "dtitles", "custs"),
    f"""SELECT s.subject, coalesce(a.kind, CASE WHEN t.c_name IS NOT NULL THEN 'company' END, CASE WHEN p.c_name IS NOT NULL THEN 'company' END, 'unknown') AS entity_type, coalesce(a.canonical, t.c_name, p.c_name, trim(s.subject)) AS canonical
    FROM (SELECT DISTINCT subject, {_up} AS up FROM dsubj) s
    LEFT JOIN (SELECT upper(n_name) AS up, 'country' AS kind, n_name AS canonical FROM nation UNION ALL SELECT sign, 'company', entity FROM custs UNION ALL SELECT 'BITCOIN', 'crypto_asset', 'bitcoin' UNION ALL SELECT 'BTC', 'crypto_asset', 'bitcoin') a ON a.up = s.up
    LEFT JOIN (SELECT n AS up, arg_min(c_name, (tier, length(title), ticker)) AS c_name FROM (SELECT ticker AS n, 1 AS tier, * FROM dtitles UNION ALL SELECT title, 2, * FROM dtitles UNION ALL
        SELECT CASE WHEN title LIKE '% INC' THEN left(title, length(title) - 4) ELSE left(title, length(title) - 5) END, CASE WHEN title LIKE '% INC' THEN 3 ELSE 4 END, * FROM dtitles WHERE title LIKE '% INC' OR title LIKE '% CORP') GROUP BY n) t ON t.up = s.up AND s.subject <> ''
    LEFT JOIN (SELECT up, arg_min(c_name, (length(title), ticker)) AS c_name FROM (SELECT DISTINCT {_up} AS up FROM dsubj) x JOIN dtitles ON contains(title, up) OR contains(up, title)
        WHERE length(up) >= 3 AND (contains(up, ' ') OR lower(up) NOT IN ({", ".join(map(lit, K.COMMON_NOUNS))})) GROUP BY up) p ON p.up = s.up""",
)
_company = "NOT is_segment AND entity_type NOT IN ('country', 'crypto_asset')"
_low = "lower(sentence)"
_capital = r"regexp_matches(heading, '\b[A-Z][A-Za-z]+\b')"
CTES["droutes"] = (
    ("dparts", "dnamed"),
    f"""SELECT * EXCLUDE (ps), unnest(ps) AS provider FROM (SELECT d.*, entity_type, canonical, canonical AS entity, list_filter(['encyclopedia',
        CASE WHEN entity_type = 'country' AND (metric IN ('gdp', 'population', 'lifespan') OR {has(_low, K.COUNTRY_WORDS)}) THEN 'indicators' END,
        CASE WHEN entity_type = 'country' AND (metric IN ('population', 'area') OR {has(_low, K.PLACE_WORDS)}) THEN 'countries' END,
        CASE WHEN entity_type = 'crypto_asset' THEN 'crypto' END,
        CASE WHEN metric = 'gdp' OR {has(_low, K.MACRO_WORDS)} THEN 'macro' END,
        CASE WHEN {_company} AND ({has(_low, K.FINANCE_WORDS)} OR (unit = 'currency' AND {_capital} AND value > 1e8)) THEN 'filings' END,
        CASE WHEN {_company} AND ({has(_low, K.FINANCE_WORDS)} OR (unit = 'currency' AND {_capital})) THEN 'market' END,
        CASE WHEN metric IN ('height', 'weight', 'length', 'area') OR unit IN ('distance', 'mass') OR {has(_low, K.PHYSICAL_WORDS)} THEN 'physical' END], lambda x: x IS NOT NULL)[:3] AS ps
      FROM dparts d JOIN dnamed n ON n.subject = d.subject)""",
)
# facts are matched as they are for the claims about them; here the entity is what the subject stands for
import re as _re  # noqa: E402

_deps, _body = CTES["evid"]
_body = _re.sub(r"\bFROM routes c\b", "FROM droutes c", _body).replace("f.entity = c.heading", "f.entity = c.entity")
CTES["dfacts"] = (("droutes", "facttab"), _body)
CTES["dtexted"] = (("droutes",), "SELECT * FROM droutes WHERE provider IN ('encyclopedia', 'physical')")
text_matches("dtexts", "dtexted", "evnums")
CTES["devid"] = (("dfacts", "dtexts"), "SELECT claim_id, provider, match_type, difference, fact_value, confidence FROM dfacts UNION ALL SELECT claim_id, provider, match_type, difference, fact_value, confidence FROM dtexts")


def _verdicts(name: str, evidence: str) -> None:
    _, body = CTES["judgedv"]
    body = _re.sub(r"\bFROM parts p\b", "FROM dparts p", body)
    body = _re.sub(r"\bFROM evid\b", f"FROM {evidence}", body)
    body = body.replace("p.claim_id, doc_id, primary_source, heading, sentence, claim_type, value, expected,", "p.claim_id, doc_id, claim_no, heading, sentence, claim_type, value, subject, raw, metric, unit, time_period,")
    CTES[name] = (("dparts", evidence), body)


_verdicts("djudged", "devid")
CTES["dopen"] = (
    ("djudged", "common"),
    f"""SELECT * EXCLUDE (nth) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY claim_no) AS nth FROM djudged WHERE verdict = 'unverifiable' AND value <> 0
      AND subject IN (SELECT subject FROM (SELECT subject, unnest({_ss.name_words("subject")}) AS w FROM (SELECT DISTINCT subject FROM djudged)) WHERE lower(w) NOT IN (SELECT word FROM common))) WHERE nth <= 5""",
)
_subject_words = rf"list_distinct(list_transform(list_filter(regexp_extract_all({plain('subject')}, '\b[a-zA-Z]{{3,}}\b'), lambda w: lower(w) NOT IN ('the','and','for','inc','corp','ltd','llc','company','group','total','global','average')), lambda w: lower(w)))"
CTES["dwebclaims"] = (("dopen",), f"SELECT *, 'web' AS provider, unnest({_subject_words}) AS entity FROM dopen")
CTES["dwebtexts"] = (("reports",), "SELECT CAST(doc_id AS VARCHAR) AS text_id, 'web' AS provider, '' AS entity, text FROM reports")
text_numbers("dwebnums0", "dwebtexts")
CTES["dwebnums"] = (
    ("dwebnums0", "reports", "dwebclaims"),
    rf"""SELECT n.text_id, n.provider, h.entity, n.number_no, n.found, n.digits, n.context FROM dwebnums0 n JOIN (SELECT * FROM (SELECT CAST(doc_id AS VARCHAR) AS text_id, unnest(list_distinct(regexp_extract_all(lower({plain("text")}), '\b[a-z]{{3,}}\b'))) AS entity FROM reports)
      WHERE entity IN (SELECT entity FROM dwebclaims)) h ON h.text_id = n.text_id WHERE EXISTS (SELECT 1 FROM (SELECT DISTINCT value FROM dwebclaims) v WHERE abs(n.found / v.value - 1.0) <= 0.05001)""",
)
text_matches("dweb", "dwebclaims", "dwebnums")
_deps, _body = CTES["dwebmet"]
CTES["dwebmet"] = (_deps, _body.replace("n.entity = c.entity", "n.entity = c.entity AND n.text_id <> split_part(c.claim_id, '-', 1)"))
CTES["devid2"] = (("devid", "dweb"), "SELECT * FROM devid UNION ALL SELECT claim_id, provider, match_type, difference, fact_value, confidence FROM dweb")
_verdicts("djudged2", "devid2")
_deps, _body = CTES["brk"]
CTES["dbrk"] = (("djudged2",), _re.sub(r"\bFROM judgedv\b", "FROM djudged2", _body).replace("AND value > 0 GROUP BY", "AND value > 0 AND heading <> '' GROUP BY"))
CTES["dfinal"] = (("djudged2", "dbrk"), "SELECT j.* EXCLUDE (verdict), CASE WHEN b.claim_id IS NOT NULL THEN 'contradicted' ELSE verdict END AS verdict FROM djudged2 j LEFT JOIN dbrk b ON b.claim_id = j.claim_id")
CTES["droll"] = (
    ("dfinal",),
    """SELECT doc_id, count(*) FILTER (verdict NOT IN ('projection', 'unverifiable')) AS checked, count(*) FILTER (verdict IN ('verified', 'close')) AS verified, count(*) FILTER (verdict = 'contradicted') AS contradicted,
      count(*) FILTER (verdict = 'disputed') AS disputed, count(DISTINCT CASE WHEN verdict IN ('verified', 'close') THEN best_provider END) AS verified_providers FROM dfinal GROUP BY doc_id""",
)
# the same with all open claims of a document, not the first five
_deps, _body = CTES["dopen"]
CTES["dopenall"] = (_deps, _body.replace(" WHERE nth <= 5", ""))
clone("all", ("dwebclaims", "dwebnums", "dwebasked", "dwebmet", "dweb", "devid2", "djudged2", "dbrk", "dfinal", "droll"), "dopen", "dopenall")
# signals with the verdicts on the claims of the documents themselves
CTES["sigv"] = (("sig", "droll"), "SELECT s.*, coalesce(d.contradicted, 0) AS contradicted, coalesce(d.disputed, 0) AS disputed FROM sig s LEFT JOIN droll d ON d.doc_id = s.doc_id")
CTES["readyv"] = (
    ("ready", "droll"),
    "SELECT r.* REPLACE (CASE WHEN dimension = 'robustness' THEN CAST(coalesce(contradicted, 0) + coalesce(disputed, 0) AS DOUBLE) ELSE value END AS value) FROM ready r LEFT JOIN droll d ON d.doc_id = r.doc_id",
)

SQL = {
    "document_verdicts": query("SELECT doc_id, claim_no, subject, verdict, confidence, best_provider FROM djudged", "djudged"),
    "search_fallback": query("SELECT * FROM dweb", "dweb"),
    "document_verification": query("SELECT * FROM alldroll", "alldroll"),
    "readiness": query("SELECT * FROM readyv", "readyv"),
    "headline_code": query(f"SELECT doc_id, {HEADLINE} AS headline FROM sigv", "sigv"),
    "finding_codes": query(
        f"""SELECT doc_id, CASE WHEN n_sentences = 0 THEN 'insufficient' ELSE
          array_to_string(list_filter([{_voice}, CASE WHEN contradicted > 0 THEN 'contradicted' END, {_sourcing}, {_gaps}, {_dis}, {_pos}], lambda x: x IS NOT NULL), ',') END AS findings FROM sigv""",
        "sigv",
    ),
    "takeaways": query(
        f"""SELECT doc_id, 'frame' AS section, n - 1 AS position, fvs_id AS item, NULL AS question FROM (
          SELECT doc_id, fvs_id, row_number() OVER (PARTITION BY doc_id ORDER BY rule_no) AS n FROM fr) WHERE n <= 3
        UNION ALL SELECT doc_id, 'missing', row_number() OVER (PARTITION BY doc_id ORDER BY perspective) - 1, perspective,
          'ask_about_' || perspective FROM cov WHERE NOT covered
        UNION ALL SELECT doc_id, 'contradicted', n, CAST(claim_no AS VARCHAR), NULL FROM (SELECT doc_id, claim_no, row_number() OVER (PARTITION BY doc_id ORDER BY claim_no) - 1 AS n FROM dfinal WHERE verdict = 'contradicted') WHERE n < 5""",
        "fr", "cov", "dfinal",
    ),
}
