"""SQL for stream jobs run on tables, and for the measurement profile, which is the join of its layers."""

from __future__ import annotations

from checks import claims_sql, framing_sql, grounding_sql
from checks.sql import query

_LAYERS = {
    "mechanism_ratio": "mechanism_ratio", "assertion_ratio": "assertion_ratio", "claim_density": "numeric_per_kw, causal_per_kw",
    "source_fidelity": "unsourced_rate", "entity_provenance": "unsourced_entity_rate", "vocabulary_proximity": "mean_proximity",
    "presentation_features": "type_token_ratio", "epistemic_calibration": "calibration_score", "information_novelty": "mean_novelty",
    "quality_profile": "substance_index, presentation_index, quality_gap", "grounding_mix": "projected_share, derivation_regime",
}
_ALL = {**framing_sql.SQL, **claims_sql.SQL, **grounding_sql.SQL}

_kind = "CASE WHEN value < 10 THEN 'timeout' WHEN value < 20 THEN 'refused' ELSE 'malformed' END"

_ran = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '{n}' END"
    for n, c in (
        ("mechanism", "mechanism_ratio"), ("assertion", "assertion_ratio"), ("claims", "numeric_per_kw"), ("source", "unsourced_rate"), ("entities", "unsourced_entity_rate"), ("vocabulary", "mean_proximity"),
        ("presentation", "type_token_ratio"), ("calibration", "calibration_score"), ("novelty", "mean_novelty"), ("quality", "quality_gap"), ("grounding", "projected_share"),
    )
)
SQL = {
    "measure_profile": f"SELECT *, array_to_string(list_filter([{_ran}], lambda x: x IS NOT NULL), ',') AS layers_run FROM (SELECT doc_id, " + ", ".join(_LAYERS.values()) + " FROM "
    + " JOIN ".join(f"(SELECT doc_id, {columns} FROM ({_ALL[name]})) l{k}" + (" USING (doc_id)" if k else "") for k, (name, columns) in enumerate(_LAYERS.items())) + ")",
    "provider_error_window": f"""SELECT start AS window_start, start + INTERVAL 1 HOUR AS window_end, provider, kind, count(*) AS errors, max(ts) AS last_error FROM (
      SELECT ts, 'provider-' || (user_id % 9) AS provider, {_kind} AS kind,
        unnest(range(12)) AS k, time_bucket(INTERVAL 5 MINUTE, ts) - to_minutes(5 * unnest(range(12))) AS start FROM events WHERE event_type = 'error') GROUP BY ALL""",
    "stream_profiles": query(
        """SELECT s.doc_id, words, coverage_count, voice, dominant, sourced_pct, total_claims, risk_level, genre, coalesce(f.frames, '') AS frames FROM sig s
        LEFT JOIN (SELECT doc_id, string_agg(DISTINCT fvs_id, ',' ORDER BY fvs_id) AS frames FROM fr GROUP BY doc_id) f ON f.doc_id = s.doc_id""",
        "sig", "fr",
    ),
    "stream_frame_counts": query("SELECT fvs_id, count(DISTINCT doc_id) AS n FROM fr GROUP BY fvs_id", "fr"),
}
