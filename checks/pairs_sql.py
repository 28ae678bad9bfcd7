"""SQL for pairs of documents and versions of texts."""

from __future__ import annotations

from checks import frames_sql as _f  # noqa: F401
from checks.claims_sql import claim_chain, number_chain
from checks.sql import CTES, lit, query, r, sentence_chain, strip
from checks.text_sql import PRODUCER, SLUG
from tessera.operators.claims import MAGNITUDE, QUALIFIER, SCALE_WORDS, SENTENCE_SCALE, UNIT_SCALES
from tessera.sources.seeding import EDITS, SLOTS, VERSION_SLOTS

CTES["peers"] = ((), f"SELECT doc_id, {SLUG} AS slug, doc_id // 4 AS peer_group, {PRODUCER} AS producer FROM documents")
_text = " || chr(10) || chr(10) || ".join(
    f"CASE doc_id % {len(ps)} " + " ".join(f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(ps)) + " END"
    for name, ps in SLOTS if name in VERSION_SLOTS
)


def _edit(text: str, edits) -> str:
    for old, new in edits:
        text = f"replace({text}, {lit(old)}, {lit(new)})"
    return text


CTES["vers0"] = ((), f"SELECT doc_id AS group_id, concat_ws(chr(10) || chr(10), text, {_text}) AS t0 FROM documents")
CTES["pvers0"] = ((), f"SELECT doc_id AS group_id, {_text} AS t0 FROM documents")
for _p in ("", "p"):
    CTES[f"{_p}vers"] = (
        (f"{_p}vers0",),
        f"""SELECT group_id, 0 AS version_id, t0 AS text FROM {_p}vers0
        UNION ALL SELECT group_id, 1, {_edit("t0", EDITS[0])} FROM {_p}vers0 UNION ALL SELECT group_id, 2, {_edit(_edit("t0", EDITS[0]), EDITS[1])} FROM {_p}vers0""",
    )
CTES["vtexts"] = (("vers",), "SELECT group_id * 10 + version_id AS doc_id, text FROM vers")
number_chain("v_", "vtexts")
sentence_chain("v_", "vtexts")
claim_chain("v_")


def shown(prefix: str) -> str:
    """(doc_id, claim_no, sentence, number_no, raw): the numbers of each claim, tidied."""
    return rf"""SELECT doc_id, claim_no, sentence, number_no, CASE
        WHEN regexp_matches(raw, '\s+[bBmMkKtT]$') THEN regexp_replace(raw, '\s+[bBmMkKtT]$', '') || upper(regexp_extract(raw, '\s+([bBmMkKtT])$', 1))
        WHEN regexp_matches(raw, '\s+(?:bi|mi|tr)$') THEN regexp_replace(raw, '\s+(?:bi|mi|tr)$', '') || upper(substr(regexp_extract(raw, '\s+(bi|mi|tr)$', 1), 1, 1))
        ELSE raw END AS raw FROM (
      SELECT c.doc_id, c.claim_no, c.sentence, n.raw, row_number() OVER (PARTITION BY c.doc_id, c.claim_no ORDER BY n.nord, n.nk) - 1 AS number_no
      FROM {prefix}claimrows c JOIN {prefix}claimnums n ON n.doc_id = c.doc_id AND n.bullet = c.bullet AND n.o1 = c.o1 AND n.o2 = c.o2)"""


CTES["shown"] = (("claimrows", "claimnums"), shown(""))
CTES["v_shown"] = (("v_claimrows", "v_claimnums"), shown("v_"))
_bare = strip(r"replace(regexp_replace(regexp_replace(raw, '^[$~]', ''), '[%xXBMK]$', ''), ',', '')")
CTES["numset"] = (
    ("shown",),
    rf"SELECT DISTINCT doc_id, value FROM (SELECT doc_id, {_bare} AS value FROM shown) WHERE regexp_full_match(value, '[+-]?(?:\d+\.?\d*|\.\d+)')",
)
CTES["pp"] = (
    ("peers",),
    """SELECT a.peer_group, a.doc_id AS a_doc_id, b.doc_id AS b_doc_id, a.producer AS a_producer, b.producer AS b_producer
    FROM peers a JOIN peers b ON a.peer_group = b.peer_group AND a.doc_id < b.doc_id""",
)
CTES["psets"] = (
    ("pp", "numset"),
    """SELECT a_doc_id, b_doc_id, value, CASE WHEN bool_or(s = 'a') AND bool_or(s = 'b') THEN 'both' WHEN bool_or(s = 'a') THEN 'only_a' ELSE 'only_b' END AS side FROM (
      SELECT a_doc_id, b_doc_id, value, 'a' AS s FROM pp JOIN numset n ON n.doc_id = a_doc_id
      UNION ALL SELECT a_doc_id, b_doc_id, value, 'b' FROM pp JOIN numset n ON n.doc_id = b_doc_id) GROUP BY ALL""",
)
CTES["pnear"] = (
    ("psets",),
    f"""SELECT * FROM (SELECT a.a_doc_id, a.b_doc_id, a.value AS value_a, b.value AS value_b,
      abs(a.value::DOUBLE - b.value::DOUBLE) / greatest(abs(a.value::DOUBLE), abs(b.value::DOUBLE)) AS apart
      FROM psets a JOIN psets b ON a.a_doc_id = b.a_doc_id AND a.b_doc_id = b.b_doc_id AND a.side = 'only_a' AND b.side = 'only_b'
      WHERE a.value::DOUBLE <> 0 AND b.value::DOUBLE <> 0) WHERE apart > 0.01::DOUBLE AND apart < 0.3::DOUBLE""",
)
_cols = (
    "missing, coverage_count, voice, voice_confidence, dominant, balanced, sourced_pct, total_claims, unhedged_count, top"
)
CTES["sides"] = (
    ("sig", "fr"),
    """SELECT s.doc_id, string_split(missing, ',') AS ml, missing, coverage_count, voice, voice_confidence, dominant, sourced_pct, total_claims, unhedged_count, top,
      greatest(past_pct, present_pct, future_pct) < 50 AND list_reverse_sort([past_pct, present_pct, future_pct])[1] - list_reverse_sort([past_pct, present_pct, future_pct])[2] < 10 AS balanced
    FROM sig s LEFT JOIN (SELECT doc_id, arg_min(fvs_id, rule_no) AS top FROM fr GROUP BY doc_id) f ON f.doc_id = s.doc_id""",
)
_pair = "FROM pp JOIN sides a ON a.doc_id = a_doc_id JOIN sides b ON b.doc_id = b_doc_id"
CTES["pdiff"] = (
    ("peers", "ready"),
    """SELECT a.peer_group, a.producer AS a_producer, b.producer AS b_producer, x.dimension, a.doc_id AS a_doc_id, b.doc_id AS b_doc_id, y.value - x.value AS value_delta,
      array_to_string(list_sort(list_filter(string_split(y.fired, ','), lambda f: f <> '' AND NOT list_contains(string_split(x.fired, ','), f))), ',') AS gained,
      array_to_string(list_sort(list_filter(string_split(x.fired, ','), lambda f: f <> '' AND NOT list_contains(string_split(y.fired, ','), f))), ',') AS lost,
      x.value IS NULL OR y.value IS NULL OR (x.dimension = 'robustness' AND x.companion = 0 AND y.companion = 0) AS non_comparable,
      x.value IS DISTINCT FROM y.value OR x.fired <> y.fired OR x.companion <> y.companion AS moved
    FROM peers a JOIN peers b ON a.peer_group = b.peer_group AND a.doc_id < b.doc_id JOIN ready x ON x.doc_id = a.doc_id JOIN ready y ON y.doc_id = b.doc_id AND y.dimension = x.dimension""",
)
CTES["vnum"] = (
    ("v_datanums",),
    "SELECT group_id, type, value, count(*) AS n_versions FROM (SELECT DISTINCT doc_id, doc_id // 10 AS group_id, type, value FROM v_datanums) GROUP BY ALL",
)


def _case(col: str, table: dict, default: str) -> str:
    return f"CASE {col} " + " ".join(f"WHEN '{k}' THEN {v:.0f}::DOUBLE" for k, v in table.items()) + f" ELSE {default} END"


def part(i: int) -> str:
    return f"regexp_extract(raw, {lit(MAGNITUDE)}, {i})"


_value = (
    f"TRY_CAST(replace({part(3)}, ',', '') AS DOUBLE) * "
    + _case(f"lower(CASE WHEN {part(5)} <> '' THEN {part(5)} ELSE {part(4)} END)", SCALE_WORDS, "1::DOUBLE")
    + f" * CASE WHEN {part(1)} <> '' OR {part(2)} <> '' THEN -1 ELSE 1 END"
)
KEY = rf"CASE WHEN regexp_matches(raw, '\d') THEN (CASE WHEN {_value} = round({_value}) THEN CAST(CAST({_value} AS BIGINT) AS VARCHAR) ELSE CAST({_value} AS VARCHAR) END) || {part(6)} END"
TYPE = r"CASE WHEN contains(raw, '%') THEN 'percentage' WHEN regexp_matches(raw, '[$€£¥₹]') THEN 'dollar' WHEN regexp_matches(raw, '(?i)\d+x\b') THEN 'multiplier' WHEN contains(raw, '.') THEN 'decimal' ELSE 'integer' END"
_b0 = rf"replace(regexp_replace(regexp_replace(regexp_replace({strip('raw')}, {lit(QUALIFIER)}, ''), '^[$€£¥₹~]+', ''), '%+$', ''), ',', '')"
_suf = rf"lower(regexp_extract(regexp_replace({strip('raw')}, '\.+$', ''), '(?:(?i:bn|mn)|[TBMKk])$'))"
_word = rf"lower(regexp_extract({_b0}, '(?i)\b(trillion|billion|million|thousand)\b', 1))"
CTES["vbase"] = (
    ("v_shown",),
    rf"""SELECT *, CASE WHEN suf <> '' THEN TRY_CAST({strip("regexp_replace(b0, '(?:(?i:bn|mn)|[TBMKk])$', '')")} AS DOUBLE)
        WHEN word <> '' THEN TRY_CAST({strip("regexp_replace(b0, '(?is)\\b(?:trillion|billion|million|thousand)\\b.*$', '')".replace(chr(92) * 2, chr(92)))} AS DOUBLE)
        ELSE TRY_CAST({strip("b0")} AS DOUBLE) END AS base FROM (SELECT *, {_b0} AS b0, {_suf} AS suf, {_word} AS word FROM v_shown)""",
)
_types = ("percentage", "dollar", "multiplier", "decimal", "integer")

SQL = {
    "peer_pairs": query("SELECT * FROM pp", "pp"),
    "producer_label": query("SELECT * FROM peers", "peers"),
    "number_sets": query("SELECT * FROM psets", "psets"),
    "near_matches": query(f"SELECT a_doc_id, b_doc_id, value_a, value_b, {r('apart', 4)} AS difference FROM pnear", "pnear"),
    "blind_spots": query(
        f"""SELECT a_doc_id, b_doc_id, array_to_string(list_filter(a.ml, lambda x: list_contains(b.ml, x)), ',') AS shared,
          array_to_string(list_filter(a.ml, lambda x: NOT list_contains(b.ml, x)), ',') AS only_a,
          array_to_string(list_filter(b.ml, lambda x: NOT list_contains(a.ml, x)), ',') AS only_b {_pair}""",
        "pp", "sides",
    ),
    "pair_findings": query(
        f"""SELECT a_doc_id, b_doc_id, n AS divergences, CASE WHEN n = 0 AND shared THEN 'similar_shared_gaps' WHEN n = 0 THEN 'similar' WHEN n >= 3 THEN 'different' END AS headline,
          array_to_string(list_filter([CASE WHEN cov THEN 'coverage' END, CASE WHEN v THEN 'voice' END, CASE WHEN s THEN 'sourcing' END, CASE WHEN c THEN 'certainty' END, CASE WHEN t THEN 'temporal' END], lambda x: x IS NOT NULL), ',') AS cards
        FROM (SELECT a_doc_id, b_doc_id, CAST((a.coverage_count <> b.coverage_count)::INT + (a.voice <> b.voice)::INT + (abs(a.sourced_pct - b.sourced_pct) >= 10)::INT + (a.dominant <> b.dominant)::INT AS BIGINT) AS n,
          len(list_filter(a.ml, lambda x: x <> '' AND list_contains(b.ml, x))) > 0 AS shared, a.coverage_count <> b.coverage_count OR a.coverage_count < 5 AS cov, a.voice <> b.voice AS v,
          abs(a.sourced_pct - b.sourced_pct) >= 10 AS s, a.dominant <> b.dominant AS t,
          a.total_claims >= 3 AND b.total_claims >= 3 AND abs(round_even(a.unhedged_count / a.total_claims * 100, 0) - round_even(b.unhedged_count / b.total_claims * 100, 0)) >= 20 AS c {_pair})""",
        "pp", "sides",
    ),
    "pair_summary": query(
        f"""SELECT p.a_doc_id, p.b_doc_id, voice_match, both_borderline, time_match, both_balanced, coverage_delta, sourced_delta, coalesce(agreed, 0) AS agreed_numbers, coalesce(n_near, 0) AS near_numbers,
          CASE WHEN ta = tb THEN 'shared:' || ta WHEN ta IS NOT NULL AND tb IS NOT NULL THEN 'divergent:' || ta || '/' || tb WHEN ta IS NOT NULL THEN 'one_sided_a:' || ta
               WHEN tb IS NOT NULL THEN 'one_sided_b:' || tb WHEN coalesce(agreed, 0) > 0 OR coalesce(n_near, 0) > 0 THEN 'counts' ELSE 'none' END AS verdict
        FROM (SELECT a_doc_id, b_doc_id, a.voice = b.voice AS voice_match, a.voice_confidence = 'borderline' AND b.voice_confidence = 'borderline' AS both_borderline, a.dominant = b.dominant AS time_match,
          a.balanced AND b.balanced AS both_balanced, b.coverage_count - a.coverage_count AS coverage_delta, b.sourced_pct - a.sourced_pct AS sourced_delta, a.top AS ta, b.top AS tb {_pair}) p
        LEFT JOIN (SELECT a_doc_id, b_doc_id, count(*) FILTER (side = 'both') AS agreed FROM psets GROUP BY ALL) s ON s.a_doc_id = p.a_doc_id AND s.b_doc_id = p.b_doc_id
        LEFT JOIN (SELECT a_doc_id, b_doc_id, count(*) AS n_near FROM pnear GROUP BY ALL) n ON n.a_doc_id = p.a_doc_id AND n.b_doc_id = p.b_doc_id""",
        "pp", "sides", "psets", "pnear",
    ),
    "frame_profile_diff": query("SELECT * EXCLUDE (a_producer, b_producer) FROM pdiff", "pdiff"),
    "frames_gained_lost": query("SELECT a_doc_id, b_doc_id, dimension, gained, lost FROM pdiff WHERE gained <> '' OR lost <> ''", "pdiff"),
    "number_stability": query(
        f"""SELECT *, CASE WHEN total_unique > 0 THEN {r("unstable_count / total_unique", 3)} END AS instability_rate, CASE WHEN total_unique < 10 THEN 'low' WHEN total_unique < 30 THEN 'adequate' ELSE 'good' END AS precision
        FROM (SELECT d.group_id, CAST(3 AS BIGINT) AS n_versions, count(value) AS total_unique, count(*) FILTER (n_versions = 3) AS stable_count, count(value) - count(*) FILTER (n_versions = 3) AS unstable_count
          FROM vers0 d LEFT JOIN vnum v ON v.group_id = d.group_id GROUP BY d.group_id)""",
        "vers0", "vnum",
    ),
    "regeneration_stability": query(
        f"""SELECT d.group_id, CAST(3 AS BIGINT) AS regenerations, sigs AS signatures, coalesce(total_unique, 0) AS total_unique, coalesce(stable_count, 0) AS stable_count, coalesce(unique_to_one, 0) AS unique_to_one,
          coalesce(total_unique - stable_count - unique_to_one, 0) AS partial_count, {", ".join(f"coalesce(stable_{t}, 0) AS stable_{t}" for t in _types)},
          CASE WHEN total_unique > 0 THEN {r("stable_count / total_unique", 4)} ELSE 0.0 END AS stability_rate
        FROM (SELECT group_id, string_agg(substr(sha256(text), 1, 8), ',' ORDER BY substr(sha256(text), 1, 8)) AS sigs FROM vers GROUP BY group_id) d LEFT JOIN (
          SELECT group_id, count(*) AS total_unique, count(*) FILTER (held = 3) AS stable_count, count(*) FILTER (held = 1) AS unique_to_one,
            {", ".join(f"count(*) FILTER (held = 3 AND type = '{t}') AS stable_{t}" for t in _types)} FROM (
            SELECT group_id, key, count(*) AS held, min(type) AS type FROM (SELECT DISTINCT doc_id, doc_id // 10 AS group_id, {KEY} AS key, {TYPE} AS type FROM v_shown) WHERE key IS NOT NULL GROUP BY ALL) GROUP BY group_id) k
        ON k.group_id = d.group_id""",
        "vers", "v_shown",
    ),
    "version_union": query("SELECT * FROM vnum", "vnum"),
    "verbatim_pairs": query(
        f"""SELECT group_id, a_version_id, b_version_id, {r("s", 4)} AS similarity FROM (
          SELECT a.group_id, CAST(a.version_id AS BIGINT) AS a_version_id, CAST(b.version_id AS BIGINT) AS b_version_id, 1.0::DOUBLE - levenshtein(a.text, b.text) / greatest(length(a.text), length(b.text)) AS s
          FROM pvers a JOIN pvers b ON a.group_id = b.group_id AND a.version_id < b.version_id) WHERE s >= 0.95::DOUBLE""",
        "pvers",
    ),
    "verbatim_copies": "SELECT sha256(text) AS content_hash, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1 HAVING count(*) > 1",
    "heading_overlap": query(
        rf"""SELECT doc_id, n_headings, matched, {r("matched / n_headings", 4)} AS heading_overlap FROM (
          SELECT h.doc_id, count(*) AS n_headings, count(*) FILTER (known / n > 0.5) AS matched FROM (
            SELECT doc_id, line_no, heading, doc_id // 4 AS g, len(ws) AS n, len(list_filter(ws, lambda w: list_contains(pw, w))) AS known FROM (
              SELECT a.doc_id, a.line_no, a.heading, a.ws, coalesce((SELECT flatten(list(b.ws)) FROM hs b WHERE b.doc_id // 4 = a.doc_id // 4 AND b.doc_id <> a.doc_id), []) AS pw FROM hs a)) h GROUP BY h.doc_id)""",
        "raw_lines",
        hs=rf"""SELECT doc_id, line_no, heading, list_distinct(list_filter(string_split_regex(lower(regexp_replace(heading, '[\*\d\.\s]+', ' ', 'g')), '\s+'), lambda w: w <> '')) AS ws FROM (
          SELECT doc_id, line_no, {strip(r"regexp_replace(regexp_replace(line, '^#+\s*', ''), '\*+', '', 'g')")} AS heading FROM raw_lines WHERE line LIKE '## %' OR line LIKE '### %') WHERE heading <> ''""",
    ),
    "normalize_value": query(
        rf"""SELECT doc_id // 10 AS group_id, doc_id % 10 AS version_id, claim_no, number_no, raw, CASE WHEN base IS NULL THEN 0.0 ELSE base * coalesce(
            CASE WHEN suf <> '' THEN {_case("suf", UNIT_SCALES, "NULL")} WHEN word <> '' THEN {_case("word", UNIT_SCALES, "NULL")} END,
            (list_filter(list_transform(regexp_extract_all(sentence, {lit(SENTENCE_SCALE)}), lambda m: {{'x': TRY_CAST(replace(regexp_extract(m, {lit(SENTENCE_SCALE)}, 1), ',', '') AS DOUBLE), 'f': {_case(f"lower(regexp_extract(m, {lit(SENTENCE_SCALE)}, 2))", UNIT_SCALES, "NULL")}}}),
              lambda z: abs(z.x - base) < 0.01::DOUBLE * greatest(abs(z.x), 1)))[1].f, 1) END AS base_value FROM vbase""",
        "vbase",
    ),
    "stability_key": query(f"SELECT doc_id // 10 AS group_id, doc_id % 10 AS version_id, claim_no, number_no, raw, {KEY} AS key FROM v_shown", "v_shown"),
    "number_type": query(f"SELECT doc_id // 10 AS group_id, doc_id % 10 AS version_id, claim_no, number_no, raw, {TYPE} AS type FROM v_shown", "v_shown"),
    "add_commas": query(
        "SELECT group_id, type, value, CASE WHEN NOT contains(value, '.') AND length(value) > 3 THEN format('{:,}', TRY_CAST(value AS BIGINT)) END AS comma_value FROM vnum",
        "vnum",
    ),
}
