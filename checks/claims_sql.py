"""SQL for numbers and claims."""

from __future__ import annotations

import re

from checks import framing_sql as _fs  # noqa: F401  (registers CTEs)
from checks.sql import CTES, ascii_letters, has, lit, query, r, strip
from tessera.functions import vocabulary as V

_CUR = "[$€£¥₹]"
# (pattern without lookaround, what may not stand before, what may not follow)
BASE = {
    "percentage": (V.TEXT_NUMBERS[0][2], None, None),
    "dollar": (V.TEXT_NUMBERS[1][2], None, None),
    "dollar_range": (V.TEXT_NUMBERS[2][2], None, None),
    "multiplier": (V.TEXT_NUMBERS[3][2], None, None),
    "scaled_integer": (r"(\d+(?:\.\d+)?)\s+(thousand|million|billion|trillion)\b", r"[$€£¥₹0-9.]", None),
    "decimal": (r"(\d+\.\d+)", r"[$€£¥₹0-9]", r"^%"),
    "integer_comma": (r"(\d{1,3}(?:,\d{3})+)", r"[$€£¥₹0-9.]", r"^(?:\.\d|%|\d)"),
    "integer_suffix": (r"(\d+)\s*[MBK]\b", r"[$€£¥₹0-9.]", None),
    "integer": (r"(\d+)", r"[$€£¥₹0-9.]", r"^(?:\.\d|%|,\d{3})"),
}


def _value(form: str) -> str:
    if form == "scaled_integer":
        n = r"CAST(regexp_extract(raw, '^(\d+(?:\.\d+)?)', 1) AS DOUBLE)"
        f = (
            "CASE WHEN raw ILIKE '%thousand' THEN 1e3 WHEN raw ILIKE '%million' THEN 1e6 "
            "WHEN raw ILIKE '%billion' THEN 1e9 ELSE 1e12 END"
        )
        v = f"({n} * CAST({f} AS DOUBLE))"
        return f"CASE WHEN {v} = round({v}) THEN CAST(CAST({v} AS BIGINT) AS VARCHAR) ELSE CAST({v} AS VARCHAR) END"
    if form in ("dollar", "dollar_range"):
        return r"replace(regexp_extract(raw, '(\d+(?:\.\d+)?(?:,\d{3})*)', 1), ',', '')"
    if form == "integer_comma":
        return "replace(raw, ',', '')"
    if form in ("percentage", "multiplier"):
        return r"regexp_extract(raw, '^(\d+(?:\.\d+)?)', 1)"
    if form == "integer_suffix":
        return r"regexp_extract(raw, '^(\d+)', 1)"
    return "raw"


_KIND = {form: kind for form, kind, _ in V.TEXT_NUMBERS}


def number_chain(prefix: str, texts: str) -> None:
    """CTEs `<prefix>nums` and `<prefix>datanums` over a table (doc_id, text)."""
    CTES[f"{prefix}masked"] = ((texts,), f"SELECT doc_id, {ascii_letters('text')} AS t FROM {texts}")
    for i, (form, (pattern, ahead, behind)) in enumerate(BASE.items()):
        conds = ["true"]
        if ahead:
            conds.append(f"NOT regexp_matches(substr(t, a, 1), {lit(ahead)}) OR a = 0")
        if behind:
            conds.append(f"NOT regexp_matches(substr(t, e + 1, 6), {lit(behind)})")
        if form == "integer":
            conds.append("length(raw) BETWEEN 2 AND 6")
        where = " AND ".join(f"({c})" for c in conds)
        CTES[f"{prefix}form{i}"] = (
            (f"{prefix}masked",),
            f"""SELECT doc_id, {i} AS rank, '{form}' AS form, '{_KIND[form]}' AS type, a, e, raw, {_value(form)} AS value FROM (
              SELECT doc_id, t, raw, CAST(e - length(raw) AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM (
                SELECT *, sum(length(piece) + length(raw)) OVER (PARTITION BY doc_id ORDER BY k) AS e FROM (
                  SELECT doc_id, t, unnest(h) AS raw, unnest(range(len(h))) AS k, unnest(p[:len(h)]) AS piece FROM (
                    SELECT doc_id, t, regexp_extract_all(t, {lit(pattern)}) AS h, string_split_regex(t, {lit(pattern)}) AS p
                    FROM {prefix}masked)))
            ) WHERE {where}""",
        )
        before = f"{prefix}taken{i - 1}"
        CTES[f"{prefix}taken{i}"] = (
            (f"{prefix}form0",) if i == 0 else (before, f"{prefix}form{i}"),
            f"SELECT * FROM {prefix}form0"
            if i == 0
            else f"""SELECT * FROM {before} UNION ALL SELECT * FROM {prefix}form{i} m WHERE NOT EXISTS (
                 SELECT 1 FROM {before} y WHERE y.doc_id = m.doc_id
                 AND ((y.a <= m.a AND m.a < y.e) OR (y.a < m.e AND m.e <= y.e)))""",
        )
    last = f"{prefix}taken{len(BASE) - 1}"
    ctx = rf"regexp_replace({strip('substr(text, greatest(a - 50, 0) + 1, e + 50 - greatest(a - 50, 0))')}, '\s+', ' ', 'g')"
    CTES[f"{prefix}nums"] = (
        (last, texts),
        f"SELECT t.*, {ctx} AS context, text FROM {last} t JOIN {texts} USING (doc_id)",
    )
    CTES[f"{prefix}noted"] = (
        (f"{prefix}nums",),
        f"""SELECT DISTINCT doc_id, raw FROM (
          SELECT doc_id, raw, text, sum(length(piece) + length(raw)) OVER (PARTITION BY doc_id, raw ORDER BY k) - length(raw) AS s FROM (
            SELECT doc_id, raw, text, unnest(ps[:len(ps) - 1]) AS piece, unnest(range(len(ps) - 1)) AS k FROM (
              SELECT DISTINCT doc_id, raw, text, string_split(text, raw) AS ps FROM {prefix}nums
              WHERE contains(lower(text), 'word count') OR contains(lower(text), 'total words'))))
        WHERE regexp_matches(lower(substr(text, CAST(greatest(s - 60, 0) AS BIGINT) + 1,
              CAST(s + length(raw) + 20 - greatest(s - 60, 0) AS BIGINT))), 'word count|total words')""",
    )
    CTES[f"{prefix}datanums"] = (
        (f"{prefix}nums", f"{prefix}noted"),
        rf"""SELECT n.* FROM {prefix}nums n ANTI JOIN {prefix}noted w ON w.doc_id = n.doc_id AND w.raw = n.raw
        WHERE NOT (regexp_full_match(value, '\d+') AND coalesce(TRY_CAST(value AS BIGINT) BETWEEN 1990 AND 2035, false))""",
    )


number_chain("", "docs")
def claim_chain(prefix: str) -> None:
    """CTEs from typed sentence numbers to claim rows, over `<prefix>sents` and `<prefix>datanums`."""
    made: dict[str, tuple[tuple[str, ...], str]] = {}
    made["sentnums"] = (
        ("sents",),
        " UNION ALL ".join(
            f"SELECT doc_id, sent_no, {i} AS ord, '{kind}' AS type, unnest(range(len(h))) AS k, unnest(h) AS raw0, unnest(g) AS val0 "
            f"FROM (SELECT doc_id, sent_no, regexp_extract_all(sentence, {lit(p)}) AS h, regexp_extract_all(sentence, {lit(p)}, 1) AS g FROM sents)"
            for i, (kind, p) in enumerate(V.SENTENCE_NUMBERS)
        ),
    )
    made["sentnum"] = (
        ("sentnums",),
        f"SELECT doc_id, sent_no, ord, k, type, {strip('raw0')} AS raw, TRY_CAST(replace(val0, ',', '') AS DOUBLE) AS val FROM sentnums",
    )
    made["realclaims"] = (
        ("sentnum", "sents"),
        """SELECT s.doc_id, s.sent_no, sentence, heading, para_no, ns, raws FROM sents s JOIN (
          SELECT doc_id, sent_no, count(*) AS ns, string_agg(raw, '|' ORDER BY ord, k) AS raws, bool_and(raw LIKE '000%') AS junk
          FROM sentnum GROUP BY doc_id, sent_no) n ON n.doc_id = s.doc_id AND n.sent_no = s.sent_no WHERE NOT junk""",
    )
    made["bullets"] = (
        ("datanums", "realclaims", "sentnum"),
        rf"""SELECT * FROM (
          SELECT *, row_number() OVER (PARTITION BY doc_id, val ORDER BY rank, a) AS nth FROM (
            SELECT n.*, TRY_CAST(value AS DOUBLE) AS val FROM datanums n
            WHERE NOT regexp_matches(context, '\d\s*[-–]\s*' || regexp_escape(raw))) n
          WHERE NOT EXISTS (SELECT 1 FROM sentnum x JOIN realclaims c ON c.doc_id = x.doc_id AND c.sent_no = x.sent_no
                            WHERE x.doc_id = n.doc_id AND x.val = n.val)) WHERE nth = 1""",
    )
    _TIGHT = (
        "CASE WHEN instr(context, raw) = 0 THEN context ELSE "
        + strip(
            "substr(context, greatest(instr(context, raw) - 31, 0) + 1, instr(context, raw) - 1 + length(raw) + 30 - greatest(instr(context, raw) - 31, 0))"
        )
        + " END"
    )
    made["claimrows"] = (
        ("realclaims", "bullets"),
        f"""SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY bullet, o1, o2) - 1 AS claim_no,
          CASE WHEN bullet THEN 'stated_as_fact' WHEN {has("sentence", V.CLAIM_HEDGE)} THEN 'hedged'
               WHEN {has("sentence", V.PREDICTION)} THEN 'prediction' ELSE 'stated_as_fact' END AS framing,
          NOT bullet AND {has("sentence", V.PREDICTION)} AS is_prediction,
          NOT bullet AND NOT {has("sentence", V.CLAIM_HEDGE)} AND {has("sentence", V.CLAIM_HEDGE_HINT)} AS hinted
        FROM (SELECT doc_id, sentence, heading, false AS bullet, raws AS numbers, sent_no AS o1, 0 AS o2 FROM realclaims
              UNION ALL SELECT doc_id, {_TIGHT}, '', true, raw, rank, a FROM bullets)""",
    )
    made["claimnums"] = (
        ("realclaims", "sentnum", "bullets"),
        """SELECT x.doc_id, false AS bullet, x.sent_no AS o1, 0 AS o2, x.type, x.raw, x.ord AS nord, x.k AS nk FROM sentnum x JOIN realclaims c ON c.doc_id = x.doc_id AND c.sent_no = x.sent_no
           UNION ALL SELECT doc_id, true, rank, a, type, raw, 0, 0 FROM bullets""",
    )
    made["highclaims"] = (
        ("claimrows", "claimnums"),
        f"""SELECT c.*, n.hp FROM claimrows c JOIN (
          SELECT doc_id, bullet, o1, o2, bool_or({has("raw", V.HIGH_PRECISION)}) AS hp FROM claimnums GROUP BY ALL) n
          ON n.doc_id = c.doc_id AND n.bullet = c.bullet AND n.o1 = c.o1 AND n.o2 = c.o2""",
    )
    names = (*made, "sents", "datanums")
    for name, (deps, body) in made.items():
        for old in names:
            body = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {prefix}{old}", body)
        CTES[prefix + name] = (tuple(prefix + d for d in deps), body)


claim_chain("")
_types = ("percentage", "dollar", "multiplier", "decimal", "integer")
CTES["cstats"] = (
    ("docs", "highclaims", "claimnums", "doc_words"),
    f"""SELECT w.doc_id, words, coalesce(total_claims, 0) AS total_claims, coalesce(hedged_count, 0) AS hedged_count,
      coalesce(unhedged_count, 0) AS unhedged_count, coalesce(prediction_count, 0) AS prediction_count,
      coalesce(high_precision_count, 0) AS high_precision_count, coalesce(candidate_hedge_count, 0) AS candidate_hedge_count,
      {", ".join(f"coalesce(claims_{t}, 0) AS claims_{t}" for t in _types)},
      CASE WHEN total_claims > 0 THEN {r("unhedged_count / total_claims", 3)} END AS confidence_uniformity
    FROM doc_words w LEFT JOIN (
      SELECT doc_id, count(*) AS total_claims, count(*) FILTER (framing = 'hedged') AS hedged_count,
        count(*) FILTER (framing = 'stated_as_fact') AS unhedged_count, count(*) FILTER (framing = 'prediction') AS prediction_count,
        count(*) FILTER (hp) AS high_precision_count, count(*) FILTER (hinted) AS candidate_hedge_count
      FROM highclaims GROUP BY doc_id) c ON c.doc_id = w.doc_id
    LEFT JOIN (SELECT doc_id, {", ".join(f"count(*) FILTER (CASE WHEN type = 'entity_count' THEN 'integer' ELSE type END = '{t}') AS claims_{t}" for t in _types)}
      FROM claimnums GROUP BY doc_id) k ON k.doc_id = w.doc_id""",
)
CTES["crisk"] = (
    ("cstats",),
    """SELECT *, CASE WHEN total_claims = 0 THEN 'info' WHEN flags >= 3 THEN 'high' WHEN flags >= 1 THEN 'moderate' ELSE 'low' END AS risk_level
    FROM (SELECT *, risk_density::INT + risk_uniform::INT + risk_precision::INT + risk_prediction::INT AS flags FROM (
      SELECT *, total_claims > 0 AND total_claims / greatest(words / 1000.0::DOUBLE, 0.1::DOUBLE) > 30 AS risk_density,
        total_claims >= 5 AND unhedged_count / greatest(total_claims, 1) > 0.85::DOUBLE AS risk_uniform,
        total_claims > 0 AND high_precision_count > total_claims * 0.3::DOUBLE AS risk_precision,
        prediction_count > 0 AS risk_prediction FROM cstats))""",
)
CTES["genres"] = (
    ("genremarks", "voices", "cstats"),
    f"""SELECT doc_id, CASE WHEN sure THEN rk[1].g END AS genre, CASE WHEN sure THEN rk[2].g END AS genre_runner_up,
      CASE WHEN sure THEN {r("rk[2].s - rk[1].s", 3)} END AS genre_margin,
      CASE WHEN NOT sure THEN 'low' WHEN {r("rk[2].s - rk[1].s", 3)} < 0.1::DOUBLE THEN 'borderline' ELSE 'high' END AS genre_confidence,
      {", ".join(f"CASE WHEN sure THEN {r(f's_{g} / whole', 3)} ELSE 0.0 END AS genre_{g}" for g in V.GENRES)}
    FROM (SELECT *, marks > 0 AND whole > 0 AS sure, list_sort([{", ".join(f"{{'s': -(s_{g} / whole), 'i': {i}, 'g': '{g}'}}" for i, g in enumerate(V.GENRES))}]) AS rk
    FROM (SELECT *, {" + ".join(f"s_{g}" for g in V.GENRES)} AS whole FROM (
      SELECT doc_id, marks,
        greatest(reck * 2.0::DOUBLE + advk * 0.5::DOUBLE + CASE WHEN voice = 'advisory' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN rec > 0 THEN 5.0::DOUBLE ELSE 0 END, 0) AS s_recommendation,
        greatest(h * 5.0::DOUBLE + altk * 0.5::DOUBLE + CASE WHEN voice = 'analytical' THEN 2.0::DOUBLE ELSE 0 END, 0) AS s_analysis,
        greatest(nark * 1.5::DOUBLE, 0) AS s_narrative,
        greatest(advk * 2.0::DOUBLE + CASE WHEN total_claims > 0 THEN (1.0::DOUBLE - h) * 1.5::DOUBLE ELSE 0 END
                 + CASE WHEN voice IN ('advisory', 'promotional') THEN 0.5::DOUBLE ELSE 0 END - reck * 0.5::DOUBLE, 0) AS s_advocacy,
        greatest(altk * 2.0::DOUBLE + h * 1.5::DOUBLE - reck * 0.7::DOUBLE, 0) AS s_exploration,
        greatest(insk * 3.0::DOUBLE + CASE WHEN voice = 'advisory' THEN 0.5::DOUBLE ELSE 0 END, 0) AS s_instruction
      FROM (SELECT g.*, voice, total_claims, CASE WHEN total_claims > 0 THEN hedged_count / total_claims ELSE 0 END AS h
            FROM genremarks g JOIN voices USING (doc_id) JOIN cstats USING (doc_id)))))""",
)


def _mentions(table: str) -> str:
    return query(
        f"""SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY rank, a) - 1 AS mention_no, form, type, value, raw,
            a AS start, e AS "end", context FROM {table}""",
        table,
    )


SQL = {
    "number_mentions": _mentions("nums"),
    "drop_years_and_wordcounts": _mentions("datanums"),
    "numeric_claim_sentences": query(
        """SELECT s.doc_id, row_number() OVER (PARTITION BY s.doc_id ORDER BY s.sent_no) - 1 AS claim_no, sentence, heading, para_no, n_numbers, numbers
        FROM sents s JOIN (SELECT doc_id, sent_no, count(*) AS n_numbers, string_agg(type || ':' || raw, '|' ORDER BY ord, k) AS numbers
          FROM sentnum GROUP BY doc_id, sent_no) n ON n.doc_id = s.doc_id AND n.sent_no = s.sent_no""",
        "sents",
        "sentnum",
    ),
    "claim_rows": query(
        "SELECT doc_id, claim_no, sentence, heading, bullet, framing, is_prediction, hp AS high_precision, numbers FROM highclaims",
        "highclaims",
    ),
    "short_claim_noise": query(
        r"""SELECT d.doc_id, coalesce(n_cut_off, 0) AS n_cut_off, coalesce(n_range_ends, 0) AS n_range_ends, coalesce(n_repeats, 0) AS n_repeats FROM docs d
        LEFT JOIN (SELECT doc_id, count(*) AS n_cut_off FROM (SELECT doc_id, sent_no FROM sentnum GROUP BY doc_id, sent_no HAVING bool_and(raw LIKE '000%')) GROUP BY doc_id) c ON c.doc_id = d.doc_id
        LEFT JOIN (SELECT doc_id, count(*) FILTER (closes) AS n_range_ends, count(val) FILTER (NOT closes) - count(DISTINCT val) FILTER (NOT closes) AS n_repeats FROM (
            SELECT n.*, TRY_CAST(value AS DOUBLE) AS val, regexp_matches(context, '\d\s*[-–]\s*' || regexp_escape(raw)) AS closes FROM datanums n
            WHERE NOT EXISTS (SELECT 1 FROM sentnum x JOIN realclaims c ON c.doc_id = x.doc_id AND c.sent_no = x.sent_no WHERE x.doc_id = n.doc_id AND x.val = TRY_CAST(n.value AS DOUBLE))) GROUP BY doc_id) m ON m.doc_id = d.doc_id""",
        "docs", "sentnum", "datanums", "realclaims",
    ),
    "claim_stats": query("SELECT * EXCLUDE (words) FROM cstats", "cstats"),
    "claim_risk": query("SELECT doc_id, risk_density, risk_uniform, risk_precision, risk_prediction, risk_level FROM crisk", "crisk"),
    "genre": query("SELECT * FROM genres", "genres"),
}
