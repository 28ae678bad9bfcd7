"""SQL for frames, absences, patterns, readiness and findings."""

from __future__ import annotations

from checks import claims_sql as _c, grounding_sql as _g  # noqa: F401  (register CTEs)
from checks.framing_sql import BUZZWORD, mask_buzz
from checks.sql import CTES, has, lit, n_hits, query, r
from tessera.functions import vocabulary as V
from tessera.sources import catalog as K

CLASSES = list(V.PERSPECTIVES)

CTES["covwide"] = (
    ("cov",),
    "SELECT doc_id, " + ", ".join(
        f"bool_or(covered) FILTER (perspective = '{c}') AS c_{c}, max(density) FILTER (perspective = '{c}') AS d_{c}, "
        f"CAST(max(dismissed) FILTER (perspective = '{c}') AS BIGINT) AS x_{c}" for c in CLASSES
    ) + ", count(*) FILTER (NOT covered) AS n_missing, count(*) FILTER (covered) AS coverage_count, "
    "min(density) FILTER (covered AND density > 0) AS lo, max(density) FILTER (covered AND density > 0) AS hi, "
    "min(density) FILTER (covered) AS lo0, max(density) FILTER (covered) AS hi0, "
    "count(*) FILTER (covered AND density > 0) AS n_pos FROM cov GROUP BY doc_id",
)
CTES["sig"] = (
    ("covwide", "covsum", "voices", "timeo", "attrib", "crisk", "scope", "roles", "falsif", "genres", "masked", "spaced"),
    f"""SELECT c.*, s.covered, s.missing, s.coverage_balance, voice, voice_confidence, voice_runner_up, n_sentences, you_pct, we_pct, imperative_count, spec_pct,
      past_pct, present_pct, future_pct,
      CASE WHEN present >= past AND present >= future THEN 'present' WHEN past >= future THEN 'past' ELSE 'future' END AS dominant,
      sourced, sourced_pct, numeric_sentences, unsupported_numeric, total_sentences, words, sw, total_claims, hedged_count, unhedged_count, prediction_count, risk_level,
      CASE WHEN p.sw >= 100 THEN proj END AS projection_phrases, role_count, falsification_count, genre, genre_confidence,
      {has("m.t", V.GROWTH_CONTENT)} AS growth_words
    FROM covwide c JOIN covsum s USING (doc_id) JOIN voices USING (doc_id) JOIN timeo USING (doc_id) JOIN attrib USING (doc_id)
    JOIN crisk USING (doc_id) JOIN (SELECT doc_id, proj FROM scope) USING (doc_id) JOIN falsif USING (doc_id) JOIN genres USING (doc_id)
    JOIN (SELECT doc_id, CASE WHEN sw >= 100 THEN count(*) FILTER (mentions > 0) END AS role_count FROM roles GROUP BY doc_id, sw) USING (doc_id)
    JOIN masked m USING (doc_id) JOIN spaced p USING (doc_id)""",
)
_engaged = "voice NOT IN ('descriptive', 'insufficient')"
_growth = f"((c_trends OR c_causes) AND NOT c_risks AND {_engaged} AND growth_words)"
RULES = [
    ("FVS-008", "present", _growth, "0"),
    ("FVS-002", "present", "voice = 'promotional' AND sourced_pct < 30", "0"),
    ("FVS-010", "present", "coverage_count >= 4 AND n_pos >= 2 AND hi / lo > 3", "0"),
    ("FVS-007", "absence", "NOT c_risks AND NOT c_uncertainty AND 100 - sourced_pct > 60", "0"),
    ("FVS-015", "present", f"(c_trends OR c_causes) AND NOT c_stakeholders AND NOT c_uncertainty AND {_engaged} AND NOT {_growth}", "0"),
    ("FVS-009", "present", "c_risks AND d_risks > 5 AND c_uncertainty AND voice = 'analytical'", "d_risks"),
    ("FVS-011", "present", "c_stakeholders AND d_stakeholders > 5 AND voice IN ('analytical', 'advisory')", "d_stakeholders"),
    ("FVS-012", "present", "c_uncertainty AND d_uncertainty > 3", "d_uncertainty"),
    ("FVS-014", "present_past", "past_pct >= 70", "0"),
    ("FVS-014", "present_future", "past_pct < 70 AND future_pct >= 60", "0"),
    ("FVS-016", "present", "sourced_pct >= 50", "0"),
]
CTES["fr"] = (
    ("sig",),
    " UNION ALL ".join(
        f"SELECT doc_id, CAST({i} AS BIGINT) AS rule_no, '{f}' AS fvs_id, '{k}' AS kind, "
        f"CAST({2 if k == 'absence' else 1} AS DOUBLE) + CAST({d} AS DOUBLE) * 0.1::DOUBLE AS priority "
        f"FROM sig WHERE n_sentences >= 5 AND ({c})"
        for i, (f, k, c, d) in enumerate(RULES)
    ),
)
CTES["frank"] = (
    ("fr",),
    "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY priority DESC, rule_no) AS rank FROM fr",
)
_frames = ", ".join(f"('{f}', '{s}')" for f, _, _, s in K.FRAMES)
_dims = ", ".join(f"('{d}', '{f}')" for d, ms in K.DIMENSION_FRAMES.items() for f in ms)
_gen = ", ".join(f"('{g}', '{f}', {i + 1})" for g, ms in K.GENRE_PRIORITY.items() for i, f in enumerate(ms))
_goal = ", ".join(f"('{g}', '{f}', {i + 1})" for g, ms in K.GOAL_PRIORITY.items() for i, f in enumerate(ms))
CTES["catalog"] = ((), f"SELECT * FROM (VALUES {_frames}) t(fvs_id, state) WHERE state = 'yes'")
CTES["dims"] = ((), f"SELECT * FROM (VALUES {_dims}) t(dimension, fvs_id)")
CTES["genrep"] = ((), f"SELECT * FROM (VALUES {_gen}) t(genre, fvs_id, prio)")
CTES["goalp"] = ((), f"SELECT * FROM (VALUES {_goal}) t(goal, fvs_id, prio)")
CTES["absent"] = (
    ("sig", "catalog", "fr", "dims"),
    """SELECT s.doc_id, c.fvs_id, s.genre, CASE WHEN nd >= 2 AND cov AND n_missing > 0 THEN 0 WHEN nd >= 1 THEN 1 ELSE 2 END AS tier_no
    FROM sig s CROSS JOIN catalog c ANTI JOIN fr ON fr.doc_id = s.doc_id AND fr.fvs_id = c.fvs_id
    LEFT JOIN (SELECT fvs_id, count(*) AS nd, bool_or(dimension = 'coverage') AS cov FROM dims GROUP BY fvs_id) d ON d.fvs_id = c.fvs_id""",
)
_TIER = "CASE tier_no WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END"


def absences(goal: str | None, k: int | None = None) -> str:
    return query(
        f"""SELECT * FROM (SELECT doc_id, fvs_id, {_TIER} AS tier, goal_rank, genre_rank,
          row_number() OVER (PARTITION BY doc_id ORDER BY tier_no, goal_rank, genre_rank, fvs_id) AS rank, count(*) OVER (PARTITION BY doc_id) AS total
        FROM (SELECT a.*, CAST(coalesce(o.prio, 999) AS BIGINT) AS goal_rank, CAST(coalesce(g.prio, 999) AS BIGINT) AS genre_rank FROM absent a
          LEFT JOIN genrep g ON g.genre = a.genre AND g.fvs_id = a.fvs_id LEFT JOIN goalp o ON o.goal = {lit(goal or '')} AND o.fvs_id = a.fvs_id))
        {f"WHERE rank <= {k}" if k else ""}""",
        "absent",
        "genrep",
        "goalp",
    )


CTES["clus"] = (
    ("absent", "dims", "sig", "fr"),
    f"""SELECT doc_id, dimension, members, member_count, canon_size, share, {_TIER} AS tier,
      row_number() OVER (PARTITION BY doc_id ORDER BY tier_no, share DESC, dimension) AS rank FROM (
      SELECT a.doc_id, d.dimension, string_agg(a.fvs_id, ',' ORDER BY a.fvs_id) AS members, count(*) AS member_count, any_value(n) AS canon_size,
        {r("count(*) / any_value(n)", 2)} AS share, min(tier_no) AS tier_no
      FROM absent a JOIN dims d ON d.fvs_id = a.fvs_id JOIN (SELECT dimension, count(*) AS n FROM dims GROUP BY dimension) c ON c.dimension = d.dimension
      JOIN sig s ON s.doc_id = a.doc_id AND s.sw >= 100 AND s.total_claims > 0 SEMI JOIN fr ON fr.doc_id = a.doc_id
      GROUP BY a.doc_id, d.dimension HAVING count(*) >= 2 AND count(*) / any_value(n) >= 0.5)""",
)


def _pattern(i: int, name: str, t: dict) -> str:
    conds = ["true"]
    if "genre" in t:
        conds.append(f"genre = '{t['genre']}'")
    conds += [f"list_contains(fired, '{f}')" for f in t.get("present_all", ())]
    conds += [f"list_contains(gone, '{f}')" for f in t.get("absent_all", ())]
    opt = "[" + ", ".join(f"'{f}'" for f in t.get("absent_any", ())) + "]"
    if "absent_any" in t:
        conds.append(f"list_has_any(gone, {opt})")
    for key, col in (("falsification_max", "falsification_count"), ("sourced_pct_max", "sourced_pct"), ("role_count_max", "role_count")):
        if key in t:
            conds.append(f"coalesce({col} <= {t[key]}, true)")
    for key, col in (("role_count_min", "role_count"), ("projection_min", "projection_phrases")):
        if key in t:
            conds.append(f"coalesce({col} >= {t[key]}, false)")
    if "voice" in t:
        conds.append(f"voice = '{t['voice']}'")
    extra = f"array_to_string(list_sort(list_intersect({opt}, gone)), ',')" if "absent_any" in t else "''"
    return (
        f"SELECT doc_id, CAST({i} AS BIGINT) AS pattern_no, '{name}' AS pattern, '{','.join(sorted(t.get('present_all', ())))}' AS frames_present, "
        f"'{','.join(sorted(t.get('absent_all', ())))}' AS frames_absent, {extra} AS frames_absent_optional, genre FROM facts WHERE "
        + " AND ".join(f"({c})" for c in conds)
    )


def shape(t: dict) -> str:
    conds = ["true"]
    conds += [f"list_contains(fired, '{f}')" for f in t.get("present_all", ())]
    conds += [f"NOT list_contains(fired, '{f}')" for f in t.get("absent_all", ())]
    if "absent_any" in t:
        conds.append("(" + " OR ".join(f"NOT list_contains(fired, '{f}')" for f in t["absent_any"]) + ")")
    return " AND ".join(conds)


CTES["facts"] = (
    ("sig", "fr", "absent"),
    """SELECT s.*, coalesce(f.ids, []) AS fired, coalesce(a.ids, []) AS gone FROM sig s
    LEFT JOIN (SELECT doc_id, list(DISTINCT fvs_id) AS ids FROM fr GROUP BY doc_id) f ON f.doc_id = s.doc_id
    LEFT JOIN (SELECT doc_id, list(fvs_id) AS ids FROM absent GROUP BY doc_id) a ON a.doc_id = s.doc_id""",
)
CTES["pats"] = (("facts",), " UNION ALL ".join(_pattern(i, n, t) for i, (n, t) in enumerate(K.PATTERNS)))
CTES["vsig"] = (
    ("facts", "fidelity"),
    """SELECT *, checked >= 3 AND sourced_pct >= 30 AND coalesce(verified / checked <= 0.5, false) AS citation_gap
    FROM facts JOIN fidelity USING (doc_id)""",
)
_canon = {d: "[" + ", ".join(f"'{f}'" for f in ms) + "]" for d, ms in K.DIMENSION_FRAMES.items()}
_fired = "CASE WHEN citation_gap THEN list_distinct(list_append(fired, 'FVS-016')) ELSE fired END"
_vals = {
    "coverage": ("CAST(coverage_count AS DOUBLE)", "coverage_balance", "coverage_count"),
    "calibration": ("CASE WHEN total_claims > 0 THEN hedged_count / total_claims END", "CAST(prediction_count AS DOUBLE)", "total_claims"),
    "evidence": ("CASE WHEN checked > 0 THEN verified / checked END", "CAST(sourced_pct AS DOUBLE)", "checked"),
    "robustness": ("CAST(0 AS DOUBLE)", "CAST(checked AS DOUBLE)", "checked"),
    "counterfactual": (
        "CAST(CASE WHEN NOT list_contains(fired, 'FVS-007') AND (c_risks OR c_uncertainty) THEN 1 ELSE 0 END AS DOUBLE)",
        "CAST(NULL AS DOUBLE)", "CAST(0 AS BIGINT)"),
}
CTES["ready"] = (
    ("vsig",),
    " UNION ALL ".join(
        f"SELECT doc_id, '{d}' AS dimension, {v} AS value, {s} AS secondary, {c} AS companion, "
        f"array_to_string(list_sort(list_intersect({_canon[d]}, {_fired})), ',') AS fired FROM vsig"
        for d, (v, s, c) in _vals.items()
    ),
)
_skew = "(coverage_count >= 2 AND hi0 > 2 AND lo0 > 0 AND hi0 > lo0 * 3)"
_fact = "(total_claims >= 5 AND unhedged_count / total_claims > 0.8::DOUBLE)"
HEADLINE = f"""CASE WHEN voice = 'promotional' AND unsupported_numeric >= 2 THEN 'promotional_unsourced'
  WHEN voice = 'prescriptive' AND n_missing >= 2 THEN 'prescriptive_gaps'
  WHEN unsupported_numeric >= 3 AND sourced = 0 THEN 'numbers_unsourced'
  WHEN voice = 'descriptive' AND n_missing >= 3 THEN 'reference_gaps'
  WHEN n_missing > 0 AND coverage_count >= 3 AND n_missing <= 2 THEN 'broad_with_gaps'
  WHEN n_missing > 0 THEN 'gaps' WHEN {_skew} THEN 'skewed_emphasis' WHEN {_fact} THEN 'all_stated_as_fact' WHEN contradicted > 0 THEN 'contradicted' END"""
_voice = "CASE WHEN voice = 'promotional' THEN CASE WHEN we_pct >= 20 THEN 'voice_promotional_we' ELSE 'voice_promotional_tone' END ELSE 'voice_' || voice END"
_sourcing = f"""CASE WHEN numeric_sentences > 0 AND unsupported_numeric = numeric_sentences AND sourced = 0 THEN
    CASE WHEN voice = 'descriptive' THEN 'numbers_as_knowledge' WHEN {_fact} THEN 'numbers_unsourced_as_fact' ELSE 'numbers_unsourced' END
  WHEN numeric_sentences > 0 AND sourced > 0 THEN CASE WHEN sourced_pct >= 70 THEN 'mostly_attributed' ELSE 'partly_attributed' END
  WHEN {_fact} THEN 'claims_as_fact' END"""
_gaps = f"""CASE WHEN n_missing = 0 THEN CASE WHEN {_skew} THEN 'complete_skewed' ELSE 'complete' END
  WHEN voice = 'descriptive' AND n_missing >= 3 THEN 'reference_low_coverage' WHEN voice = 'prescriptive' AND n_missing >= 2 THEN 'directs_without'
  WHEN voice = 'promotional' AND n_missing >= 2 THEN 'asserts_without' WHEN n_missing >= 3 THEN 'low_coverage'
  WHEN n_missing <= 2 AND coverage_count >= 3 THEN 'covers_most' ELSE 'some_gaps' END"""
_pos = """CASE WHEN n_missing = 0 AND voice = 'analytical' THEN CASE WHEN sourced_pct >= 70 THEN 'reader_evaluates' WHEN unsupported_numeric > 0 THEN 'verify_before_acting' END
  WHEN voice = 'descriptive' AND n_missing >= 3 THEN 'reader_looks_up'
  WHEN voice = 'prescriptive' AND unsupported_numeric > 2 AND n_missing >= 2 THEN 'reader_executes'
  WHEN voice = 'promotional' AND unsupported_numeric > 2 THEN 'reader_buys'
  WHEN voice = 'analytical' AND sourced_pct >= 70 AND n_missing <= 1 THEN 'reader_evaluates' WHEN n_missing >= 3 THEN 'narrow_coverage' END"""
_dis = ", ".join(f"CASE WHEN NOT c_{c} AND x_{c} >= 2 THEN 'dismisses_{c}' END" for c in V.DISMISSIBLE)

SQL = {
    "doc_signals": query(
        f"""SELECT s.doc_id, s.words, s.sw AS spaced_words, n_sentences, s.coverage_count, dominant, voice, sourced_pct, total_claims, hedged_count, risk_level,
          mechanism_ratio, numeric_per_kw, projection_phrases, role_count, falsification_count, genre, genre_confidence FROM sig s
        JOIN (SELECT doc_id, {r("a / greatest(a + b, 1)", 4)} AS mechanism_ratio FROM (SELECT doc_id, {n_hits("t", V.MECHANISM)} AS a, {n_hits(mask_buzz("t"), BUZZWORD)} AS b FROM masked)) USING (doc_id)
        JOIN (SELECT w.doc_id, {r("count(s.doc_id) / greatest(any_value(words) / 1000.0::DOUBLE, 0.1::DOUBLE)", 1)} AS numeric_per_kw FROM doc_words w
          LEFT JOIN (SELECT DISTINCT doc_id, sent_no FROM sentnum) s ON s.doc_id = w.doc_id GROUP BY w.doc_id) USING (doc_id)""",
        "sig", "sentnum", "doc_words", "masked",
    ),
    "evidence_gates": query(
        "SELECT doc_id, n_sentences >= 5 AS frames_open, sw >= 100 AS deeper_open, sw >= 100 AND len(fired) > 0 AND total_claims > 0 AS clusters_open FROM facts",
        "facts",
    ),
    "frame_suggestions": query("SELECT * FROM fr", "fr"),
    "rank_suggestions": query("SELECT doc_id, rule_no, fvs_id, rank FROM frank", "frank"),
    "top_frames": query("SELECT doc_id, fvs_id, rank FROM frank WHERE rank <= 3", "frank"),
    "absent_frames": absences(None),
    "rank_absences": absences("decide"),
    "list_caps": absences("learn", 3),
    "absence_tier": query(f"SELECT doc_id, fvs_id, {_TIER} AS tier FROM absent", "absent"),
    "absence_relevance": query(
        f"SELECT a.doc_id, a.fvs_id, {_TIER} AS tier, coalesce(d.dimension, 'none') AS dimension FROM absent a LEFT JOIN dims d ON d.fvs_id = a.fvs_id",
        "absent", "dims",
    ),
    "signal_strength": query(
        "SELECT doc_id, perspective, density, CASE WHEN density < 0.01 THEN 'none' WHEN density < 3 THEN 'nominal' WHEN density < 10 THEN 'moderate' ELSE 'substantive' END AS strength FROM cov",
        "cov",
    ),
    "absence_clusters": query("SELECT * FROM clus", "clus"),
    "budget_slice": query(
        """SELECT s.doc_id, level, least(coalesce(na, 0), ka) AS absences_returned, coalesce(na, 0) AS absences_total, least(coalesce(nc, 0), kc) AS clusters_returned,
          coalesce(nc, 0) AS clusters_total, least(coalesce(np, 0), kp) AS patterns_returned, coalesce(np, 0) AS patterns_total
        FROM sig s CROSS JOIN (VALUES ('minimal', 3, 1, 1), ('standard', 5, 99, 99), ('full', 99, 99, 99)) b(level, ka, kc, kp)
        LEFT JOIN (SELECT doc_id, count(*) AS na FROM absent GROUP BY doc_id) a ON a.doc_id = s.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS nc FROM clus GROUP BY doc_id) c ON c.doc_id = s.doc_id
        LEFT JOIN (SELECT doc_id, count(*) AS np FROM pats GROUP BY doc_id) p ON p.doc_id = s.doc_id""",
        "sig", "absent", "clus", "pats",
    ),
    "rule_match": query("SELECT doc_id, pattern_no, pattern FROM pats", "pats"),
    "frame_patterns": query("SELECT * EXCLUDE (genre) FROM pats", "pats"),
    "citation_gap": query("SELECT doc_id, checked, verified, sourced_pct, citation_gap FROM vsig", "vsig"),
    "next_actions": query(
        """SELECT f.doc_id, array_to_string(list_filter(['read:' || top, CASE WHEN total_claims >= 5 AND unhedged_count / total_claims >= 0.5 THEN 'ask_for_confidence' END,
          CASE WHEN total_sentences >= 5 AND sourced_pct < 10 THEN 'ask_for_sources' END, 'follow_up'], lambda x: x IS NOT NULL), ',') AS actions
        FROM sig f LEFT JOIN (SELECT a.doc_id, arg_min(a.fvs_id, (tier_no, coalesce(g.prio, 999), a.fvs_id)) AS top FROM absent a
          LEFT JOIN genrep g ON g.genre = a.genre AND g.fvs_id = a.fvs_id GROUP BY a.doc_id) t ON t.doc_id = f.doc_id""",
        "sig", "absent", "genrep",
    ),
    "custom_rules": query(
        f"""SELECT fvs_id, count(DISTINCT doc_id) AS n_fired FROM (SELECT doc_id, fvs_id FROM fr
          UNION ALL SELECT doc_id, 'USR-001' FROM sig JOIN (SELECT doc_id, {r("a / greatest(a + b, 1)", 4)} AS mr FROM (SELECT doc_id, {n_hits("t", V.MECHANISM)} AS a, {n_hits(mask_buzz("t"), BUZZWORD)} AS b FROM masked)) USING (doc_id)
            WHERE n_sentences >= 5 AND mr >= 0.9::DOUBLE
          UNION ALL SELECT doc_id, 'USR-002' FROM sig JOIN (SELECT w.doc_id, {r("count(s.doc_id) / greatest(any_value(words) / 1000.0::DOUBLE, 0.1::DOUBLE)", 1)} AS nk FROM doc_words w
            LEFT JOIN (SELECT DISTINCT doc_id, sent_no FROM sentnum) s ON s.doc_id = w.doc_id GROUP BY w.doc_id) USING (doc_id) WHERE n_sentences >= 5 AND nk > 10)
        GROUP BY fvs_id""",
        "fr", "sig", "masked", "sentnum", "doc_words",
    ),
}
