"""SQL for corpus roll-ups, peers, raters and costs."""

from __future__ import annotations

from checks import pairs_sql as _p  # noqa: F401
from checks.frames_sql import shape
from checks.sql import CTES, query, r
from checks.text_sql import PRODUCER
from tessera.operators.corpus import CANON
from tessera.sources import catalog as K
from tessera.sources.corpus import DIMENSION_ORDER, PRICES

_canon = ", ".join(f"('{f}')" for f in CANON)
CTES["canon"] = ((), f"SELECT * FROM (VALUES {_canon}) t(fvs_id)")
CTES["fires"] = (
    ("facts", "canon"),
    "SELECT doc_id, coalesce(genre, '_unclassified') AS genre, fvs_id, list_contains(fired, fvs_id) AS fires FROM facts CROSS JOIN canon",
)


def _co(keep: str) -> str:
    return query(
        f"""SELECT fvs_id, other, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY fvs_id ORDER BY n DESC, other) AS rank FROM (
          SELECT a.fvs_id, b.fvs_id AS other, count(*) AS n FROM fires a JOIN fires b ON a.doc_id = b.doc_id AND a.fvs_id <> b.fvs_id
          WHERE {keep} GROUP BY ALL)) WHERE rank <= 3""",
        "fires",
    )


_sheet = " UNION ALL ".join(
    f"""SELECT doc_id, CAST(rater AS BIGINT) AS rater_id, '{d}' AS dimension, CASE WHEN (doc_id + rater * 2 + {k}) % 7 <> 0 THEN
      CAST(1 + (doc_id * 3 + rater * 5 + {k * 2}) % 3 + quality + (1 - toxic) AS BIGINT) END AS score FROM labels CROSS JOIN (SELECT unnest([0, 1, 2]) AS rater)"""
    for k, d in enumerate(DIMENSION_ORDER)
)
CTES["ratings"] = ((), f"SELECT * FROM ({_sheet}) WHERE score IS NOT NULL")
CTES["means"] = (("ratings",), "SELECT doc_id, dimension, avg(score) AS expert_mean, count(*) AS n_raters FROM ratings GROUP BY ALL")
CTES["rated"] = (
    ("ready", "means"),
    "SELECT r.*, expert_mean FROM ready r JOIN means m ON m.doc_id = r.doc_id AND m.dimension = r.dimension WHERE value IS NOT NULL",
)
CTES["outl"] = (
    ("ready",),
    f"""SELECT *, coalesce(max(distance) OVER (PARTITION BY peer_group, dimension) > 0 AND distance = max(distance) OVER (PARTITION BY peer_group, dimension), false) AS is_outlier FROM (
      SELECT peer_group, dimension, doc_id, producer, value, fired, CASE WHEN NOT nc THEN med END AS median, CASE WHEN NOT nc THEN abs(value - med) END AS distance, nc AS non_comparable FROM (
        SELECT *, count(value) OVER w < count(*) OVER w OR count(*) OVER w < 3 OR (dimension = 'robustness' AND max(coalesce(secondary, 0)) OVER w = 0) AS nc,
          quantile_cont(value, 0.5) OVER w AS med, count(*) OVER w AS members
        FROM (SELECT *, doc_id // 4 AS peer_group, {PRODUCER} AS producer FROM ready) WINDOW w AS (PARTITION BY peer_group, dimension)) WHERE members >= 2)""",
)
CTES["ocounts"] = (
    ("outl",),
    "SELECT producer, dimension, count(*) AS appearances, count(*) FILTER (is_outlier) AS outliers, count(*) FILTER (non_comparable) AS non_comparable FROM outl GROUP BY ALL",
)


def _findings(share: float) -> str:
    return query(
        f"""SELECT c.producer, c.dimension, outliers, appearances - non_comparable AS comparable, fvs_id, coalesce(n, 0) AS fired_in FROM ocounts c
        LEFT JOIN (SELECT producer, dimension, fvs_id, count(*) AS n FROM (SELECT producer, dimension, unnest(list_filter(string_split(fired, ','), lambda f: f <> '')) AS fvs_id FROM outl WHERE is_outlier) GROUP BY ALL) f
          ON f.producer = c.producer AND f.dimension = c.dimension
        WHERE appearances - non_comparable >= 2 AND outliers >= (appearances - non_comparable) * {share}::DOUBLE""",
        "ocounts", "outl",
    )


CTES["expout"] = (
    ("means",),
    f"""SELECT peer_group, dimension, bool_or(few) AS few, list_sort(list_distinct(list(producer) FILTER (d > 0 AND d = mx))) AS expert FROM (
      SELECT *, max(d) OVER (PARTITION BY peer_group, dimension) AS mx FROM (
        SELECT peer_group, dimension, producer, count(*) OVER w < 3 AS few, abs(expert_mean - quantile_cont(expert_mean, 0.5) OVER w) AS d
        FROM (SELECT *, doc_id // 4 AS peer_group, {PRODUCER} AS producer FROM means) WINDOW w AS (PARTITION BY peer_group, dimension))) GROUP BY ALL""",
)
_pat = " UNION ALL ".join(
    f"""SELECT '{n}' AS pattern, count(*) FILTER ({shape(t)}) AS matches, count(*) AS total, {r(f"count(*) FILTER ({shape(t)}) / count(*)", 3)} AS match_rate,
      {f"count(*) FILTER (({shape(t)}) AND genre = '{t['genre']}')" if "genre" in t else "NULL::BIGINT"} AS matches_in_genre,
      {f"count(*) FILTER (genre = '{t['genre']}')" if "genre" in t else "NULL::BIGINT"} AS genre_total,
      {f"CASE WHEN count(*) FILTER (genre = '{t['genre']}') > 0 THEN " + r(f"count(*) FILTER (({shape(t)}) AND genre = '{t['genre']}') / count(*) FILTER (genre = '{t['genre']}')", 3) + " ELSE 0.0 END" if "genre" in t else "NULL::DOUBLE"} AS genre_match_rate FROM facts"""
    for n, t in K.PATTERNS
)


def _rank(scope: str, rows: str = "rated") -> str:
    return f"""SELECT {scope}, value, expert_mean, rank() OVER (PARTITION BY {scope} ORDER BY value) + (count(*) OVER (PARTITION BY {scope}, value) - 1) / 2 AS value_rank,
      rank() OVER (PARTITION BY {scope} ORDER BY expert_mean) + (count(*) OVER (PARTITION BY {scope}, expert_mean) - 1) / 2 AS mean_rank FROM (SELECT *, {PRODUCER} AS producer FROM {rows})"""


def _rho(scope: str, rows: str = "rated") -> str:
    return query(
        f"""SELECT {scope}, count(*) AS n_documents, CASE WHEN count(*) >= 3 AND var_pop(value_rank) > 0 AND var_pop(mean_rank) > 0 THEN {r("corr(value_rank, mean_rank)", 6)} END AS spearman_rho
        FROM ({_rank(scope, rows)}) GROUP BY ALL""",
        rows,
    )


CTES["ratedgenre"] = (("rated", "genres"), "SELECT r.*, coalesce(genre, '_unclassified') AS genre FROM rated r JOIN genres g ON g.doc_id = r.doc_id")


_prices = ", ".join(f"('{p}', '{m}', {a}::DOUBLE, {b}::DOUBLE)" for p, m, a, b in PRICES)

SQL = {
    "frame_prevalence": query(
        f"SELECT fvs_id, count(*) AS n_docs, count(*) FILTER (fires) AS fires_in, count(*) FILTER (NOT fires) AS absent_in, {r('count(*) FILTER (fires) / count(*)', 3)} AS rate FROM fires GROUP BY fvs_id",
        "fires",
    ),
    "frame_prevalence_by_genre": query(
        f"SELECT fvs_id, genre, count(*) AS n_docs, count(*) FILTER (fires) AS fires_in, count(*) FILTER (NOT fires) AS absent_in, {r('count(*) FILTER (fires) / count(*)', 3)} AS rate, count(*) < 3 AS low_n FROM fires GROUP BY fvs_id, genre",
        "fires",
    ),
    "co_fires": _co("a.fires AND b.fires"),
    "co_absences": _co("NOT a.fires AND NOT b.fires"),
    "pattern_prevalence": query(_pat, "facts"),
    "detector_empirics": query(
        f"""SELECT kind, label, n, {r("n / (SELECT count(*) FROM facts)", 4)} AS rate FROM (
          SELECT 'document' AS kind, 'all' AS label, count(*) AS n FROM facts UNION ALL
          SELECT 'frame', fvs_id, count(DISTINCT doc_id) FROM fr GROUP BY fvs_id UNION ALL SELECT 'perspective', perspective, count(*) FROM cov WHERE covered GROUP BY perspective UNION ALL
          SELECT 'voice', voice, count(*) FROM facts GROUP BY voice UNION ALL SELECT 'genre', coalesce(genre, '_unclassified'), count(*) FROM facts GROUP BY 2 UNION ALL
          SELECT 'pattern', pattern, count(*) FROM pats GROUP BY pattern UNION ALL SELECT 'cluster', dimension, count(*) FROM clus GROUP BY dimension)""",
        "facts", "fr", "cov", "pats", "clus",
    ),
    "peer_outliers": query("SELECT * EXCLUDE (fired) FROM outl", "outl"),
    "outlier_counts": query("SELECT * FROM ocounts", "ocounts"),
    "cross_group_findings": _findings(1.0),
    "cross_group_leanings": _findings(0.3),
    "peer_divergence": query(
        """SELECT level, key, dimension, count(*) AS n_pairs, count(*) FILTER (NOT non_comparable AND moved) AS differs, count(*) FILTER (non_comparable) AS non_comparable, count(*) FILTER (NOT non_comparable AND NOT moved) AS agrees FROM (
          SELECT 'all' AS level, '' AS key, dimension, moved, non_comparable FROM pdiff UNION ALL SELECT 'group', CAST(peer_group AS VARCHAR), dimension, moved, non_comparable FROM pdiff
          UNION ALL SELECT 'producer', a_producer, dimension, moved, non_comparable FROM pdiff UNION ALL SELECT 'producer', b_producer, dimension, moved, non_comparable FROM pdiff) GROUP BY ALL""",
        "pdiff",
    ),
    "diff_findings": query(
        """SELECT 'dimension' AS level, dimension AS key, count(*) AS n_pairs, count(*) FILTER (moved) AS moved FROM pdiff GROUP BY dimension
        UNION ALL SELECT 'kind', b_producer, count(*), count(*) FILTER (moved) FROM pdiff WHERE dimension = 'coverage' GROUP BY b_producer""",
        "pdiff",
    ),
    "read_ratings": query("SELECT * FROM ratings", "ratings"),
    "expert_mean": query("SELECT * FROM means", "means"),
    "average_ranks": query(
        f"SELECT dimension, value, expert_mean, count(*) AS n, any_value(value_rank) AS value_rank, any_value(mean_rank) AS mean_rank FROM ({_rank('dimension')}) GROUP BY dimension, value, expert_mean",
        "rated",
    ),
    "spearman_by_dimension": _rho("dimension"),
    "spearman_by_genre": _rho("dimension, genre", "ratedgenre"),
    "spearman_by_producer": _rho("dimension, producer"),
    "icc_by_dimension": query(
        f"""SELECT dimension, n AS n_documents, CASE WHEN n >= 2 AND w + b <> 0 THEN {r("b / (w + b)", 6)} END AS icc FROM (
          SELECT dimension, count(*) AS n, avg(v) AS w, var_samp(m) AS b FROM (SELECT doc_id, dimension, var_samp(score) AS v, avg(score) AS m FROM ratings GROUP BY ALL HAVING count(*) >= 2) GROUP BY dimension)""",
        "ratings",
    ),
    "expert_agreement": query(
        """SELECT s.peer_group, s.dimension, CASE WHEN blocked OR coalesce(few, true) THEN 'non_comparable' WHEN list_has_any(structural, coalesce(expert, [])) THEN 'agree' ELSE 'disagree' END AS outcome,
          array_to_string(structural, ',') AS structural, coalesce(array_to_string(expert, ','), '') AS expert FROM (
          SELECT peer_group, dimension, bool_or(non_comparable) AS blocked, coalesce(list_sort(list_distinct(list(producer) FILTER (is_outlier))), []) AS structural FROM outl GROUP BY ALL) s
        LEFT JOIN expout e ON e.peer_group = s.peer_group AND e.dimension = s.dimension""",
        "outl", "expout",
    ),
    "divergence_cases": query("SELECT doc_id, dimension, value, expert_mean FROM rated WHERE abs(value - expert_mean) > 1.5", "rated"),
    "llm_cost": f"""SELECT u.provider, u.model, grounded, input_tokens, output_tokens, CASE WHEN grounded THEN 0.014::DOUBLE ELSE coalesce({r("input_tokens / 1000.0::DOUBLE * a + output_tokens / 1000.0::DOUBLE * b", 6)}, 0.0) END AS cost_usd FROM (
        SELECT CASE WHEN doc_id % 5 < 2 THEN 'alder' WHEN doc_id % 5 < 4 THEN 'birch' ELSE 'cedar' END AS provider, ['alder-small', 'alder-large', 'birch-one', 'birch-beta', 'cedar-free'][CAST(doc_id % 5 AS INT) + 1] AS model,
          doc_id % 10 = 9 AS grounded, n_chars // 8 AS input_tokens, n_chars // 4 AS output_tokens FROM documents) u LEFT JOIN (VALUES {_prices}) p(provider, model, a, b) ON p.provider = u.provider AND p.model = u.model""",
    "reader_agreement_tier": """SELECT source, score, CASE WHEN score >= 0.8::DOUBLE THEN 'strong' WHEN score >= 0.4::DOUBLE THEN 'moderate' ELSE 'weak' END AS tier FROM (
        SELECT source, avg(CASE WHEN quality + toxic = 1 THEN 1.0::DOUBLE ELSE 0 END) AS score FROM documents JOIN labels USING (doc_id) GROUP BY source)""",
}
