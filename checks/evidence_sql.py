"""SQL for claims against texts: every claim is held against every number of its entity's texts."""

from __future__ import annotations

from checks import facts_sql as _fs  # noqa: F401  (registers CTEs)
from checks.sql import CTES, has, lit, query, r, strip

#: The rules of the job written once more, by value: words that do not count, scales, weights, bands.
IDLE = (
    "'the','and','for','are','was','were','has','have','had','been','will','with','that','this','from','its','than','more','also','into','over','such',"
    "'per','not','but','year','total','about','which'"
)
NUM = r"\$?\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:trillion|billion|million|thousand|bn|mn|[TBMKtbmk]))?\b"
NUM_PARTS = r"(\d[\d,]*(?:\.\d+)?)(?:\s*(trillion|billion|million|thousand|bn|mn|[TBMKtbmk]))?$"


def plain(text: str) -> str:
    return rf"regexp_replace({text}, '[^\x00-\x7F]', '_', 'g')"


def words(text: str) -> str:
    return rf"list_distinct(list_filter(regexp_extract_all(lower({text}), '\b[a-z]{{3,}}\b'), lambda w: w NOT IN ({IDLE})))"


def clone(prefix: str, names: tuple[str, ...], source: str, by: str) -> None:
    """The CTEs of these names once more, over another table than their source."""
    import re

    for name in names:
        deps, body = CTES[name]
        for old in names:
            body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {prefix}{old}", body)
        body = re.sub(rf"\b(FROM|JOIN) {source}\b", rf"\1 {by}", body)
        CTES[prefix + name] = (tuple(prefix + x if x in names else by if x == source else x for x in deps), body)


def text_numbers(name: str, texts: str) -> None:
    """CTE of numbers with their context over a table (text_id, provider, entity, text)."""
    a, e = "CAST(e - length(m) AS BIGINT)", "CAST(e AS BIGINT)"
    left = "CASE WHEN a > 80 AND contains(substr(t, a - 79, 80), ' ') THEN regexp_replace(substr(t, a - 79, 80), '^[^ ]* ', '') ELSE substr(t, greatest(a - 80, 0) + 1, least(a, 80)) END"
    right = "CASE WHEN e + 80 < length(t) AND contains(substr(t, e + 1, 80), ' ') THEN regexp_replace(substr(t, e + 1, 80), ' [^ ]*$', '') ELSE substr(t, e + 1, 80) END"
    CTES[name] = (
        (texts,),
        rf"""SELECT text_id, provider, entity, k AS number_no, digits, TRY_CAST(digits AS DOUBLE) * CASE lower(unit) WHEN 't' THEN 1e12 WHEN 'trillion' THEN 1e12 WHEN 'b' THEN 1e9 WHEN 'bn' THEN 1e9 WHEN 'billion' THEN 1e9
            WHEN 'm' THEN 1e6 WHEN 'mn' THEN 1e6 WHEN 'million' THEN 1e6 WHEN 'k' THEN 1e3 WHEN 'thousand' THEN 1e3 ELSE 1 END::DOUBLE AS found, {strip(f"{left} || m || {right}")} AS context
          FROM (SELECT *, replace(regexp_extract(m, {lit(NUM_PARTS)}, 1), ',', '') AS digits, regexp_extract(m, {lit(NUM_PARTS)}, 2) AS unit FROM (
            SELECT text_id, provider, entity, t, k, m, {a} AS a, {e} AS e FROM (
              SELECT *, sum(length(piece) + length(m)) OVER (PARTITION BY text_id, provider, entity ORDER BY k) AS e FROM (
                SELECT text_id, provider, entity, t, unnest(h) AS m, CAST(unnest(range(len(h))) AS BIGINT) AS k, unnest(p[:len(h)]) AS piece FROM (
                  SELECT text_id, provider, entity, t, regexp_extract_all(t, {lit(NUM)}) AS h, string_split_regex(t, {lit(NUM)}) AS p FROM (SELECT *, {plain("text")} AS t FROM {texts}))))))
          WHERE TRY_CAST(digits AS DOUBLE) > 0""",
    )


def text_matches(name: str, claims: str, numbers: str) -> None:
    """CTE of the evidence that claims (claim_id, provider, entity, subject, …) find among numbers."""
    raw = rf"coalesce(TRY_CAST(replace(regexp_replace(regexp_replace(regexp_replace({strip('raw')}, '^[$~]+', ''), '%+$', ''), '[TBMKk]$', ''), ',', '') AS DOUBLE), 0.0)"
    CTES[f"{name}asked"] = (
        (claims,),
        f"""SELECT *, sought <= 50 AND sought = floor(sought) AS is_small FROM (
          SELECT *, unnest(CASE WHEN provider = 'encyclopedia' AND rawn <> 0 AND rawn <> value AND abs(value / rawn) < 1000 THEN [rawn, value] WHEN provider = 'physical' AND rawn <> 0 AND rawn <> value THEN [value, rawn] ELSE [value] END) AS sought,
            unnest(CASE WHEN (provider = 'encyclopedia' AND rawn <> 0 AND rawn <> value AND abs(value / rawn) < 1000) OR (provider = 'physical' AND rawn <> 0 AND rawn <> value) THEN [0, 1] ELSE [0] END) AS try_no
          FROM (SELECT claim_id, provider, entity, metric, unit, value, {raw} AS rawn, unit = 'percent' OR contains(lower(sentence), 'percent') OR contains(sentence, '%') AS is_percent,
            list_distinct({words(plain("sentence"))} || {words(plain("coalesce(subject, '')"))}) AS cw, {words("metric")} AS mw, regexp_extract(coalesce(time_period, ''), '20[1-3]\\d') AS cy FROM {claims} WHERE value <> 0)) WHERE sought > 0""",
    )
    CTES[f"{name}met"] = (
        (f"{name}asked", numbers),
        rf"""SELECT *, (1.0::DOUBLE - off / tol) * 0.4::DOUBLE + ov * 0.25::DOUBLE + ms * 0.2::DOUBLE + ys * 0.15::DOUBLE AS score FROM (
          SELECT *, CASE WHEN len(cw) > 0 THEN len(list_intersect(cw, seen)) / len(cw)::DOUBLE ELSE 0.5 END AS ov, CASE WHEN len(mw) = 0 THEN 0.5::DOUBLE WHEN len(list_intersect(mw, seen)) > 0 THEN 1.0 ELSE 0.1 END AS ms,
            CASE WHEN cy = '' THEN 0.5::DOUBLE WHEN contains(context, cy) THEN 1.0 WHEN regexp_matches(context, '20[1-3]\d') THEN 0.2 ELSE 0.5 END AS ys FROM (
            SELECT c.*, n.text_id, n.number_no, n.found, n.digits, n.context, {words("n.context")} AS seen, abs(n.found / sought - 1.0::DOUBLE) AS off,
              CASE WHEN is_small THEN 0.001::DOUBLE WHEN is_percent THEN 0.015 WHEN sought BETWEEN 1800 AND 2100 AND sought = floor(sought) THEN 0.0002 ELSE 0.05 END AS tol
            FROM {name}asked c JOIN {numbers} n ON n.provider = c.provider AND n.entity = c.entity) WHERE off <= tol)
        WHERE NOT ((is_small OR is_percent) AND ov < 0.15::DOUBLE AND NOT (is_percent AND contains(regexp_replace(context, '\s+%', '%', 'g'), digits || '%'))) AND NOT (is_percent AND ov < 0.3::DOUBLE)
          AND NOT (metric <> '' AND ms <= 0.1::DOUBLE AND unit = 'currency' AND sought > 1e9)""",
    )
    CTES[name] = (
        (f"{name}met",),
        f"""SELECT claim_id, provider, match_type, {r("d", 4)} AS difference, found AS fact_value,
          {r("CASE provider WHEN 'physical' THEN CASE WHEN match_type = 'exact' THEN 0.9::DOUBLE ELSE 0.75 END WHEN 'web' THEN CASE match_type WHEN 'exact' THEN 0.75::DOUBLE WHEN 'close' THEN 0.6 ELSE 0.45 END ELSE least(0.95::DOUBLE, score * 0.9::DOUBLE) END", 4)} AS confidence, text_id
        FROM (SELECT *, CASE WHEN d < 0.01::DOUBLE THEN 'exact' WHEN d < CASE provider WHEN 'web' THEN 0.025::DOUBLE ELSE 0.05 END THEN 'close' WHEN provider <> 'web' OR d < 0.25::DOUBLE THEN 'contradicted' ELSE 'no_data' END AS match_type FROM (
          SELECT *, row_number() OVER (PARTITION BY claim_id, provider ORDER BY CASE WHEN provider = 'web' THEN d ELSE try_no END, CASE WHEN provider = 'web' THEN 0 ELSE -score END, text_id) AS rn FROM (
            SELECT *, abs(found - CASE WHEN provider = 'physical' THEN value ELSE sought END) / greatest(abs(CASE WHEN provider = 'physical' THEN value ELSE sought END), 1e-10::DOUBLE) AS d,
              row_number() OVER (PARTITION BY claim_id, provider, text_id ORDER BY try_no, -score, number_no) AS best FROM {name}met) WHERE best = 1) WHERE rn = 1) WHERE match_type <> 'no_data'""",
    )


CTES["turns"] = ((), "SELECT text AS passage, row_number() OVER (ORDER BY item_id) - 1 AS turn, count(*) OVER () AS n FROM benchmark")
_u = "CAST(round_even(value / 100::DOUBLE, 0) AS BIGINT)"
CTES["said"] = (
    ("facttab",),
    f"""SELECT 'article-' || entity AS text_id, 'encyclopedia' AS provider, entity, string_agg('Revenue of $' || CASE WHEN year % 2 = 0 THEN ({_u} // 10000) || '.' || lpad(CAST({_u} % 10000 AS VARCHAR), 4, '0') || ' million' ELSE CAST(CAST(round_even(value, 0) AS BIGINT) AS VARCHAR) END
        || ' was reported by ' || entity || ' in ' || year || '.', ' ' ORDER BY year) AS said FROM facttab WHERE provider = 'filings' AND period_type = 'annual' GROUP BY entity
    UNION ALL SELECT 'article-' || entity, 'encyclopedia', entity, entity || ' has a population of ' || CAST(value AS BIGINT) || ' people.' FROM facttab WHERE provider = 'countries'
    UNION ALL SELECT 'note-' || p_partkey, 'physical', 'part ' || p_partkey, 'The mass of the ' || p_name || ' is ' || (pu // 100) || '.' || lpad(CAST(pu % 100 AS VARCHAR), 2, '0') || ' kg and its length is ' || p_size || ' cm.'
      FROM (SELECT *, CAST(round_even(p_retailprice * 100, 0) AS BIGINT) AS pu FROM part)""",
)
CTES["evtexts"] = (
    ("said", "turns"),
    "SELECT text_id, provider, entity, concat_ws(chr(10), passage, said) AS text FROM said LEFT JOIN turns ON turn = CAST('0x' || substr(sha256(entity), 1, 6) AS BIGINT) % (SELECT count(*) FROM benchmark)",
)
text_numbers("evnums", "evtexts")
CTES["pclaims"] = (
    ("fclaims",),
    """SELECT claim_id, heading, sentence, raw FROM fclaims UNION ALL SELECT 'mass-' || p_partkey, 'part ' || p_partkey, 'The ' || p_name || ' weighs ' || raw || ' kg in all.', raw FROM (
      SELECT *, (pu // 10) || '.' || (pu % 10) AS raw FROM (SELECT *, CAST(round_even(p_retailprice * CASE p_partkey % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.03 ELSE 2.0 END::DOUBLE * 10, 0) AS BIGINT) AS pu FROM part))""",
)
clone("p", ("parts", "timed", "routed", "routes"), "fclaims", "pclaims")
CTES["evclaims"] = (("proutes",), "SELECT *, heading AS entity, heading AS subject FROM proutes WHERE provider IN ('encyclopedia', 'physical')")
text_matches("evmatch", "evclaims", "evnums")

SQL = {
    "claim_text_match": query("SELECT * FROM evmatch", "evmatch"),
}
