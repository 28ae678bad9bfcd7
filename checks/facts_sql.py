"""SQL for claims and reference facts."""

from __future__ import annotations

from checks.sql import CTES, has, lit, query, r
from tessera.functions import timeframe as T
from tessera.operators import facts as K

CTES["rev"] = (
    (),
    """SELECT o_custkey AS custkey, CAST(year(o_orderdate) + 20 AS BIGINT) AS year, CAST(quarter(o_orderdate) AS BIGINT) AS quarter,
      CAST(sum(CAST(round_even(o_totalprice * 100, 0) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY ALL""",
)
CTES["ann"] = (
    ("rev",),
    "SELECT custkey, c_name AS entity, c_nationkey AS nationkey, year, CAST(sum(cents) AS BIGINT) AS cents FROM rev JOIN customer ON c_custkey = custkey GROUP BY ALL",
)
CTES["facttab"] = (
    ("rev", "ann"),
    """SELECT 'filings' AS provider, entity, 'revenue' AS metric, 'annual' AS period_type, year, NULL::BIGINT AS quarter, cents / 100.0::DOUBLE AS value FROM ann
    UNION ALL SELECT 'filings', c_name, 'revenue', 'quarterly', year, quarter, cents / 100.0::DOUBLE FROM rev JOIN customer ON c_custkey = custkey
    UNION ALL SELECT 'market', entity, 'revenue', 'annual', year, NULL, cents / 100.0::DOUBLE * 1.03::DOUBLE FROM ann WHERE custkey % 3 = 0
    UNION ALL SELECT 'indicators', n_name, 'gdp', 'annual', year, NULL, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE FROM ann JOIN nation ON n_nationkey = nationkey GROUP BY n_name, year
    UNION ALL SELECT 'macro', n_name, 'gdp', 'annual', year, NULL, CAST(sum(cents) AS BIGINT) / 100.0::DOUBLE * 1.004::DOUBLE FROM ann JOIN nation ON n_nationkey = nationkey GROUP BY n_name, year
    UNION ALL SELECT 'countries', n_name, 'population', 'annual', NULL, NULL, CAST(count(*) AS DOUBLE) FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY n_name""",
)
CTES["fkey"] = (
    ("facttab",),
    "SELECT *, k % 6 AS pick, CAST('0x' || substr(sha256(entity), 1, 6) AS BIGINT) * 2 + coalesce(year, 0) % 2 AS doc_id FROM (SELECT *, CAST('0x' || substr(sha256(concat_ws('/', provider, entity, period_type, year, quarter)), 1, 6) AS BIGINT) AS k FROM facttab WHERE provider NOT IN ('market', 'macro'))",
)
_money = "'$' || amount"
CTES["fclaims"] = (
    ("fkey",),
    f"""SELECT concat_ws('-', provider, entity, period_type, year, quarter) AS claim_id, doc_id, entity AS heading,
      CASE WHEN provider = 'countries' THEN entity || ' has a population of ' || amount || ' people.'
        WHEN provider = 'indicators' THEN entity || ' had a GDP of ' || {_money} || ' in ' || said || '.'
        WHEN pick = 5 THEN 'Revenue of ' || entity || ' is projected to reach ' || {_money} || ' in ' || said || '.'
        WHEN period_type = 'quarterly' THEN 'In Q' || quarter || ' ' || said || ' ' || entity || ' sales were ' || {_money} || '.'
        ELSE 'In ' || said || ' ' || entity || ' reported revenue of ' || {_money} || '.' END AS sentence,
      CASE WHEN provider = 'countries' THEN amount ELSE {_money} END AS raw,
      CASE WHEN pick = 5 AND provider = 'filings' THEN 'projection' WHEN pick IN (0, 5) THEN 'verified' WHEN pick = 1 THEN 'close' ELSE 'contradicted' END AS expected, provider AS primary_source
    FROM (SELECT *, CAST(CAST(round_even(value * [1.0, 1.02, 1.1, 3.0, 1.0, 1.0][CAST(pick AS INT) + 1]::DOUBLE, 0) AS BIGINT) AS VARCHAR) AS amount,
      CAST(year + CASE WHEN pick = 4 THEN 1 ELSE 0 END AS VARCHAR) AS said FROM fkey)
    UNION ALL SELECT 'growth-' || entity || '-' || year, doc_id, entity, 'Sales of ' || entity || ' grew 25% in ' || year || '.', '25%', 'unverifiable', 'filings'
    FROM fkey WHERE provider = 'filings' AND period_type = 'annual' AND k % 5 = 0""",
)
_metric = "CASE " + " ".join(f"WHEN {has('sentence', p)} THEN '{n}'" for n, p in T.METRICS) + " ELSE '' END"
# the claims carry no scale words, fiscal years or ranges: the other rules never get a turn
CTES["parts"] = (
    ("fclaims",),
    rf"""SELECT *, CASE WHEN regexp_matches(raw, '^[$]') OR {has("sentence", "[€£¥₹]")} OR {has("sentence", T.CURRENCY_WORD)} THEN 'currency' WHEN raw LIKE '%\%' ESCAPE '\' OR {has("sentence", "(?i)percent")} THEN 'percent'
        WHEN {has("sentence", T.DISTANCE)} THEN 'distance' WHEN {has("sentence", T.MASS)} THEN 'mass' WHEN {has("sentence", T.DURATION)} AND metric = 'lifespan' THEN 'time' ELSE 'count' END AS unit,
      CASE WHEN {has("sentence", T.PROJECTED)} THEN 'projection' WHEN {has("sentence", T.DERIVED)} AND contains(raw, '%') THEN 'derived' ELSE 'direct' END AS claim_type,
      {has("sentence || ' ' || heading", T.SEGMENT)} OR {has("sentence || ' ' || heading", T.SEGMENT_LINE)} AS is_segment,
      coalesce(TRY_CAST(replace(replace(replace(raw, '$', ''), '%', ''), ',', '') AS DOUBLE), 0.0) AS value
    FROM (SELECT *, {_metric} AS metric, regexp_extract(sentence, {lit(T.TIME_MENTION)}, 1) AS time_period FROM fclaims)""",
)
_q = lit(T.QUARTER_YEAR)
_b = lit(T.BARE_YEAR)


def _hint(p: str, g: int) -> str:
    return f"coalesce(TRY_CAST(regexp_extract(time_period, {lit(p)}, {g}) AS BIGINT), TRY_CAST(regexp_extract(sentence, {lit(p)}, {g}) AS BIGINT))"


CTES["timed"] = (
    ("parts",),
    rf"""SELECT *, CASE WHEN qy IS NOT NULL THEN qy ELSE byr END AS year, CASE WHEN qy IS NOT NULL THEN qq END AS quarter,
      CASE WHEN qy IS NOT NULL THEN CASE WHEN 2026 - qy > 5 THEN 'historical' ELSE 'quarterly' END WHEN byr IS NOT NULL THEN CASE WHEN 2026 - byr > 5 THEN 'historical' ELSE 'annual' END ELSE 'unknown' END AS period_type,
      CASE WHEN qy IS NOT NULL THEN CASE WHEN 2026 - qy > 5 THEN 'historical_old_year_quarterly' ELSE 'quarterly_q_notation' END
           WHEN byr IS NOT NULL THEN CASE WHEN 2026 - byr > 5 THEN 'historical_old_year' ELSE 'annual_bare_year' END ELSE 'no_time_anchor' END AS reason,
      TRY_CAST(coalesce(nullif(regexp_extract(time_period, '20[1-3]\d'), ''), nullif(regexp_extract(sentence, '20[1-3]\d'), '')) AS BIGINT) AS target_year,
      coalesce(TRY_CAST(regexp_extract(time_period, '(?i)Q([1-4])', 1) AS BIGINT), TRY_CAST(regexp_extract(sentence, '(?i)Q([1-4])', 1) AS BIGINT)) AS target_quarter
    FROM (SELECT *, {_hint(T.QUARTER_YEAR, 2)} AS qy, {_hint(T.QUARTER_YEAR, 1)} AS qq, {_hint(T.BARE_YEAR, 1)} AS byr FROM parts)""",
)
CTES["routed"] = (
    ("timed",),
    f"""SELECT *, heading LIKE 'NATION%' AS country, list_filter([ 'encyclopedia',
        CASE WHEN heading LIKE 'NATION%' AND (metric IN ('gdp', 'population', 'lifespan') OR {has("lower(sentence)", K.COUNTRY_WORDS)}) THEN 'indicators' END,
        CASE WHEN heading LIKE 'NATION%' AND (metric IN ('population', 'area') OR {has("lower(sentence)", K.PLACE_WORDS)}) THEN 'countries' END,
        CASE WHEN metric = 'gdp' OR {has("lower(sentence)", K.MACRO_WORDS)} THEN 'macro' END,
        CASE WHEN NOT is_segment AND heading NOT LIKE 'NATION%' AND ({has("lower(sentence)", K.FINANCE_WORDS)} OR (unit = 'currency' AND value > 1e8)) THEN 'filings' END,
        CASE WHEN NOT is_segment AND heading NOT LIKE 'NATION%' AND ({has("lower(sentence)", K.FINANCE_WORDS)} OR unit = 'currency') THEN 'market' END,
        CASE WHEN metric IN ('height', 'weight', 'length', 'area') OR unit IN ('distance', 'mass') OR {has("lower(sentence)", K.PHYSICAL_WORDS)} THEN 'physical' END], lambda x: x IS NOT NULL)[:3] AS ps FROM timed""",
)
CTES["routes"] = (
    ("routed",),
    "SELECT * EXCLUDE (ps), unnest(ps) AS provider, CAST(unnest(range(len(ps))) AS BIGINT) AS route_no FROM routed",
)
_bands = "CASE provider " + " ".join(
    f"WHEN '{p}' THEN CASE WHEN diff < {e}::DOUBLE THEN 'exact' WHEN diff < {c}::DOUBLE THEN 'close' "
    + ("ELSE 'no_data'" if x is None else "ELSE 'contradicted'" if x == float("inf") else f"WHEN diff < {x}::DOUBLE THEN 'contradicted' ELSE 'no_data'")
    + " END" for p, (e, c, x) in K.BANDS.items()
) + " END"
CTES["evid"] = (
    ("routes", "facttab"),
    f"""SELECT *, CASE WHEN match_type = 'exact' THEN 0.95::DOUBLE ELSE 0.85 END AS confidence FROM (SELECT claim_id, provider, {_bands} AS match_type, {r("diff", 4)} AS difference, fact_value FROM (
      SELECT *, row_number() OVER (PARTITION BY claim_id, provider ORDER BY first_key, diff, newest, fact_value) AS rn FROM (
        SELECT c.claim_id, c.provider, f.value AS fact_value, abs(f.value - c.value) / greatest(abs(c.value), 1e-10::DOUBLE) AS diff, abs(f.year - c.target_year) AS gap,
          CASE WHEN c.provider = 'filings' THEN coalesce(abs(f.year - c.target_year), 0) ELSE -coalesce(f.year, 0) END AS first_key, -coalesce(f.year, 0) AS newest,
          CASE WHEN c.provider = 'filings' THEN
            CASE WHEN c.period_type = 'quarterly' OR target_quarter IS NOT NULL THEN f.period_type = 'quarterly' AND f.quarter = target_quarter ELSE f.period_type = 'annual' END
            AND CASE WHEN target_year IS NULL THEN abs(f.value - c.value) / greatest(abs(c.value), 1e-10) < CASE WHEN f.year >= 2023 THEN 0.31::DOUBLE ELSE 0.30 END
                 WHEN f.year = target_year THEN true ELSE abs(f.year - target_year) <= 1 AND abs(f.value - c.value) / greatest(abs(c.value), 1e-10) < 0.05::DOUBLE END
          ELSE CASE WHEN f.year IS NULL THEN c.period_type <> 'historical' WHEN target_year IS NOT NULL THEN f.year = target_year ELSE f.year BETWEEN 2020 AND 2025 END END AS ok
        FROM routes c JOIN facttab f ON f.provider = c.provider AND f.entity = c.heading AND f.metric = c.metric WHERE c.value <> 0 AND f.value <> 0) WHERE ok) WHERE rn = 1) WHERE match_type <> 'no_data'""",
)
_auth = "CASE provider " + " ".join(f"WHEN '{p}' THEN {w}::DOUBLE" for p, w in K.AUTHORITY.items()) + f" ELSE {K.OTHER_AUTHORITY}::DOUBLE END"
CTES["judgedv"] = (
    ("parts", "evid"),
    f"""SELECT *, CASE WHEN claim_type = 'projection' THEN 'projection' WHEN NOT voted THEN 'unverifiable' WHEN x > 0 AND e + c > 0 THEN 'disputed' WHEN e > 0 THEN 'verified' WHEN c > 0 THEN 'close' WHEN x > 0 THEN 'contradicted' ELSE 'unverifiable' END AS verdict,
      CAST({r("CASE WHEN NOT voted THEN 0.0::DOUBLE WHEN x > 0 AND e > 0 THEN 0.6 WHEN x > 0 AND c > 0 THEN 0.5 WHEN e >= 2 THEN least(ce + 0.05::DOUBLE, 0.98) WHEN e > 0 THEN ce WHEN c > 0 THEN cc WHEN x > 0 THEN cx ELSE 0.0 END", 4)} AS DOUBLE) AS confidence,
      CASE WHEN voted THEN bp END AS best_provider,
      CAST(CASE WHEN e > 0 THEN 1.0 WHEN c > 0 THEN 0.7 ELSE 0.0 END AS DOUBLE) AS precision, CAST(CASE WHEN e + c + x = 0 THEN 0.0 WHEN e + c >= 3 THEN 1.0 WHEN e + c = 2 THEN 0.8 WHEN e + c = 1 THEN 0.5 ELSE 0.2 END AS DOUBLE) AS corroboration
    FROM (SELECT p.claim_id, doc_id, primary_source, heading, sentence, claim_type, value, expected, claim_type <> 'projection' AND value <> 0 AS voted, coalesce(e, 0) AS e, coalesce(c, 0) AS c, coalesce(x, 0) AS x, ce, cc, cx, bp,
        coalesce(ctx, 0.0::DOUBLE) AS context, coalesce(auth, 0.0::DOUBLE) AS authority FROM parts p LEFT JOIN (
        SELECT claim_id, count(*) FILTER (match_type = 'exact') AS e, count(*) FILTER (match_type = 'close') AS c, count(*) FILTER (match_type = 'contradicted') AS x, max(confidence) FILTER (match_type = 'exact') AS ce,
          max(confidence) FILTER (match_type = 'close') AS cc, max(confidence) FILTER (match_type = 'contradicted') AS cx, max(confidence) AS ctx, max({_auth}) AS auth,
          arg_min(provider, (CASE match_type WHEN 'exact' THEN 0 WHEN 'close' THEN 1 ELSE 2 END, provider)) AS bp FROM evid GROUP BY claim_id) v ON v.claim_id = p.claim_id)""",
)
CTES["brk"] = (
    ("judgedv",),
    f"""SELECT DISTINCT g.claim_id FROM (SELECT claim_id, doc_id, heading, TRY_CAST(regexp_extract(sentence, {lit(K.GROWTH)}, 1) AS DOUBLE) AS rate FROM judgedv WHERE claim_type = 'derived') g
    JOIN (SELECT doc_id, heading, list_distinct(list(value)) AS vs FROM judgedv WHERE verdict IN ('verified', 'close') AND value > 0 GROUP BY doc_id, heading) h ON h.heading = g.heading AND h.doc_id = g.doc_id
    WHERE rate IS NOT NULL AND len(vs) >= 2 AND len(list_filter(flatten(list_transform(vs, lambda b: list_transform(vs, lambda c: CASE WHEN c <> b AND abs((c - b) / b * 100 - rate) <= 2 THEN 1 END))), lambda x: x IS NOT NULL)) = 0""",
)
CTES["lab"] = (
    ("judgedv",),
    "SELECT primary_source AS provider, expected IN ('verified', 'close') AS e, verdict IN ('verified', 'close') AS v, length(sentence) % 200 <= 90 AS fresh FROM judgedv WHERE expected <> 'projection'",
)
CTES["scores"] = (
    ("lab",),
    f"""SELECT *, {r("CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END", 4)} AS precision, {r("CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END", 4)} AS recall, {r("CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) END", 4)} AS f1 FROM (
      SELECT provider, scope, count(*) FILTER (e AND v) AS tp, count(*) FILTER (NOT e AND v) AS fp, count(*) FILTER (e AND NOT v) AS fn, count(*) FILTER (NOT e AND NOT v) AS tn
      FROM (SELECT *, 'all' AS scope FROM lab UNION ALL SELECT *, 'fresh' FROM lab WHERE fresh) GROUP BY ALL)""",
)
CTES["tiers"] = (
    ("scores",),
    "SELECT provider, f1, tp + fp + fn + tn AS claims_tested, CASE WHEN f1 IS NULL THEN 'uncalibrated' WHEN f1 >= 0.8::DOUBLE THEN 'strong' WHEN f1 >= 0.6::DOUBLE THEN 'moderate' ELSE 'weak' END AS tier FROM scores WHERE scope = 'all'",
)
_subject = """CASE c_custkey % 6 WHEN 0 THEN 't' || c_custkey WHEN 1 THEN c_name || CASE WHEN c_custkey % 3 = 1 THEN ' Inc' ELSE '' END WHEN 2 THEN c_name || ','
  WHEN 3 THEN 'Nation_' || c_nationkey WHEN 4 THEN 'Bitcoin,' ELSE CASE c_custkey % 36 WHEN 11 THEN substr(c_name, 10) WHEN 23 THEN 'The old ' || c_name || ' Corp of yore.' WHEN 35 THEN right(c_name, 3) ELSE 'nobody known' END END"""
# every title is held against every name that is left
CTES["tparts"] = (
    (),
    f"""SELECT subject, arg_min(ticker, (length(title), ticker)) AS ticker FROM (SELECT DISTINCT subject, upper(rtrim(trim(subject), '.,;:!?)')) AS up FROM (SELECT *, {_subject} AS subject FROM customer WHERE c_custkey % 6 = 5))
    JOIN (SELECT 'T' || c_custkey AS ticker, upper(c_name || CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN ' Inc' ELSE ' Corp' END) AS title FROM customer) ON contains(title, up) OR contains(up, title) GROUP BY subject""",
)

SQL = {
    "load_facts": query("SELECT * FROM facttab", "facttab"),
    "read_labelled_claims": query("SELECT * FROM fclaims", "fclaims"),
    "classify_time": query("SELECT claim_id, time_period, period_type, year, quarter, reason, target_year, target_quarter FROM timed", "timed"),
    "claim_parts": query("SELECT claim_id, metric, value, unit, claim_type, is_segment FROM parts", "parts"),
    "resolve_entity": query(
        f"""SELECT c_custkey AS subject_id, s.subject, CASE c_custkey % 6 WHEN 3 THEN 'country' WHEN 4 THEN 'crypto_asset' WHEN 5 THEN CASE WHEN ticker IS NULL THEN 'unknown' ELSE 'company' END ELSE 'company' END AS entity_type,
        CASE c_custkey % 6 WHEN 3 THEN 'NATION_' || c_nationkey WHEN 4 THEN 'bitcoin' WHEN 5 THEN coalesce(ticker, s.subject) ELSE 'T' || c_custkey END AS canonical,
        CASE c_custkey % 6 WHEN 3 THEN 'country_alias' WHEN 4 THEN 'crypto_asset_alias' WHEN 5 THEN CASE WHEN ticker IS NULL THEN 'no_rule_matched' ELSE 'company_resolved' END ELSE 'company_resolved' END AS reason
        FROM (SELECT *, {_subject} AS subject FROM customer) s LEFT JOIN tparts p ON p.subject = s.subject AND c_custkey % 6 = 5""",
        "tparts",
    ),
    "route_claims": query("SELECT claim_id, route_no, provider FROM routes", "routes"),
    "claim_fact_match": query("SELECT * FROM evid", "evid"),
    "claim_consensus": query("SELECT claim_id, verdict, confidence, best_provider FROM judgedv", "judgedv"),
    "confidence_dimensions": query("SELECT claim_id, authority, precision, context, corroboration FROM judgedv", "judgedv"),
    "derivation_check": query(
        "SELECT j.claim_id, CASE WHEN b.claim_id IS NOT NULL THEN 'contradicted' ELSE verdict END AS verdict, CASE WHEN b.claim_id IS NOT NULL THEN 0.8::DOUBLE ELSE confidence END AS confidence FROM judgedv j LEFT JOIN brk b ON b.claim_id = j.claim_id",
        "judgedv", "brk",
    ),
    "verification_rollup": query(
        """SELECT doc_id, count(*) FILTER (verdict NOT IN ('projection', 'unverifiable')) AS checked, count(*) FILTER (verdict IN ('verified', 'close')) AS verified, count(*) FILTER (verdict = 'contradicted') AS contradicted,
          count(*) FILTER (verdict = 'disputed') AS disputed, count(DISTINCT CASE WHEN verdict IN ('verified', 'close') THEN best_provider END) AS verified_providers FROM judgedv GROUP BY doc_id""",
        "judgedv",
    ),
    "provider_provenance": query(
        """SELECT h.provider, verified_count, coalesce(tier, 'uncalibrated') AS tier, f1, claims_tested FROM (SELECT best_provider AS provider, count(*) AS verified_count FROM judgedv WHERE verdict IN ('verified', 'close') GROUP BY 1) h LEFT JOIN tiers t ON t.provider = h.provider""",
        "judgedv", "tiers",
    ),
    "calibration_scores": query("SELECT * FROM scores", "scores"),
    "reliability_tiers": query("SELECT * FROM tiers", "tiers"),
}
