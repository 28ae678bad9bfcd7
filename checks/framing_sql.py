"""SQL for framing signals."""

from __future__ import annotations

from checks.sql import CTES, ascii_letters, has, lit, n_hits, pct, query, r, strip
from checks.text_sql import style_tokens
from tessera.functions import vocabulary as V

# -- lookaround-free forms of the vocabulary -------------------------------------


def mask_quantifiers(t: str) -> str:
    """`approximately 40` says how exact, not how sure: hide such words."""
    for word in ("approximately", "approximate", "roughly"):
        t = f"regexp_replace({t}, '(?i)\\b{word}(\\s*[0-9$%])', '{'x' * len(word)}\\1', 'g')"
    return t


def mask_buzz(t: str) -> str:
    t = (
        f"regexp_replace({t}, '(?i)\\bleverage\\b(\\s+(?:the|this|that|our|their|your|its|a|an|existing|new"
        "|current|available|key|core|unique|critical|strategic|digital|modern|data|technology|AI|cloud))', 'levxrage\\1', 'g')"
    )
    t = f"regexp_replace({t}, '(?i)\\brobust\\b(\\s+(?:framework|solution|approach|system))', 'robxst\\1', 'g')"
    return f"regexp_replace({t}, '(?i)\\bcomprehensive\\b(\\s+(?:framework|solution|approach|strategy))', 'comprxhensive\\1', 'g')"


def mask_since(t: str) -> str:
    return f"regexp_replace({t}, '(?i)\\bsince(\\s+[0-9])', 'xxxxx\\1', 'g')"


def mask_hints(t: str) -> str:
    t = (
        f"regexp_replace({t}, '(?i)\\bthe\\s+public\\b(\\s+(?:web|domain|sphere|record|opinion|sector|health|good"
        "|interest|eye|face|library|school|transport|transit|safety))', 'xxx xxxxxx\\1', 'g')"
    )
    return (
        f"regexp_replace({t}, '(?i)\\bperhaps(\\s+(?:the|a|an)\\s+(?:most|least|best|worst|first|last|defining"
        "|leading|dominant|primary|central|key|main|chief|top|greatest))', 'xxxxxxx\\1', 'g')"
    )


def mask_should(t: str) -> str:
    return f"regexp_replace({t}, '(?i)you\\s+should(\\s+(?:see|notice|observe|hear)\\b)', 'xxx xxxxxx\\1', 'g')"


PERSPECTIVES = {
    c: p.replace(r"(?!\s*[\d$%])", "") for c, p in V.PERSPECTIVES.items()
}
BUZZWORD = (
    V.BUZZWORD.replace("leverage", "levxrage").replace("robust", "robxst").replace("comprehensive", "comprxhensive")
)

def _drop_lookahead(p: str) -> str:
    """Remove every (?=…) or (?!…) group; what it asked for is in the mask."""
    out, i = "", 0
    while i < len(p):
        if p.startswith("(?=", i) or p.startswith("(?!", i):
            depth, i = 1, i + 3
            while depth:
                depth += {"(": 1, ")": -1}.get(p[i], 0)
                i += 1
        else:
            out += p[i]
            i += 1
    return out


BUZZWORD = _drop_lookahead(BUZZWORD)
CAUSAL = _drop_lookahead(V.CAUSAL_SENTENCE)
RECOMMENDATION = _drop_lookahead(V.RECOMMENDATION)
HINTS = {c: _drop_lookahead(p) for c, p in V.PERSPECTIVE_HINTS.items()}

CTES["qmasked"] = (("masked",), f"SELECT doc_id, {mask_quantifiers('t')} AS t FROM masked")
CTES["asents"] = (("sents",), f"SELECT *, {ascii_letters('sentence')} AS s FROM sents")

CTES["hits"] = (
    ("qmasked",),
    " UNION ALL ".join(
        f"SELECT doc_id, '{c}' AS perspective, t, unnest(hits) AS marker, unnest(range(len(hits))) AS k, "
        f"unnest(pieces[:len(hits)]) AS piece FROM (SELECT doc_id, t, regexp_extract_all(t, {lit(p)}) AS hits, "
        f"string_split_regex(t, {lit(p)}) AS pieces FROM qmasked)"
        for c, p in PERSPECTIVES.items()
    ),
)
CTES["placed"] = (
    ("hits",),
    """SELECT doc_id, perspective, t, k, marker, CAST(e - length(marker) AS BIGINT) AS a, CAST(e AS BIGINT) AS e FROM (
         SELECT *, sum(length(piece) + length(marker)) OVER (PARTITION BY doc_id, perspective ORDER BY k) AS e FROM hits)""",
)
_NEG = V.NEGATION_BEFORE
CTES["judged"] = (
    ("placed",),
    rf"""SELECT doc_id, perspective, t, marker, a, e,
      perspective IN ('risks', 'uncertainty') AND (
        {has("regexp_replace(pre, '(?s)^.*(?:[.] |[.]\\n|[?] |! )', '')".replace("\\\\", chr(92)), V.DIMINISHER)}
        OR {has(r"CASE WHEN regexp_matches(post, '[.!?]\s') THEN regexp_extract(post, '(?s)^(.*?)[.!?]\s', 1) ELSE substr(post, 1, 80) END", V.DIMINISHER)}
        OR {has("near", _NEG)}) AS gone
    FROM (SELECT *, substr(t, greatest(a - 60, 0) + 1, least(a, 60)) AS pre, substr(t, e + 1, 1000) AS post,
                 substr(t, greatest(a - 20, 0) + 1, least(a, 20)) AS near FROM placed)""",
)
CTES["cov"] = (
    ("judged", "doc_words"),
    f"""SELECT *, n >= 2 AND NOT (dismissed > n AND n < 6) AS covered FROM (
      SELECT w.doc_id, p.perspective, coalesce(n, 0) AS n, coalesce(dismissed, 0) AS dismissed,
             {r("coalesce(n, 0) / greatest(words / 1000.0::DOUBLE, 0.1::DOUBLE)", 1)} AS density
      FROM doc_words w CROSS JOIN (SELECT unnest(['causes','risks','stakeholders','trends','uncertainty']) AS perspective) p
      LEFT JOIN (SELECT doc_id, perspective, count(*) FILTER (NOT gone) AS n, count(*) FILTER (gone) AS dismissed
                 FROM judged GROUP BY ALL) h ON h.doc_id = w.doc_id AND h.perspective = p.perspective)""",
)
CTES["covsum"] = (
    ("cov",),
    f"""SELECT doc_id, coalesce(string_agg(CASE WHEN covered THEN perspective END, ',' ORDER BY perspective), '') AS covered,
       coalesce(string_agg(CASE WHEN NOT covered THEN perspective END, ',' ORDER BY perspective), '') AS missing,
       count(*) FILTER (covered) AS coverage_count,
       CASE WHEN count(*) FILTER (covered) >= 2 AND max(density) FILTER (covered) > 0
            THEN {r("min(density) FILTER (covered) / max(density) FILTER (covered)", 2)} END AS coverage_balance
    FROM cov GROUP BY doc_id""",
)
CTES["sflags"] = (
    ("asents",),
    f"""SELECT doc_id, sent_no, {has("s", V.PAST)} AS past, {has("s", V.FUTURE)} AS future,
      {has("s", V.YOU)} AS you, {has("s", V.WE)} AS we, {has("s", V.IMPERATIVE)} AS imp,
      {has("s", V.SPECIFICATION)} AS spec, {has("s", V.PROMOTION)} AS promo,
      {has("s", V.NUMERIC)} AS isnum,
      {has("s", V.SOURCE_MARKER)} OR len(list_filter(list_transform(
         regexp_extract_all(s, {lit(r"(?:^|[^\w-])" + V.NAMED_REPORTER)}, 1),
         lambda x: lower(regexp_extract(regexp_replace(x, '^(?:(?:The|A|An)(?:\\s+|$))+', ''), '^([A-Za-z]+)', 1))),
         lambda h: h <> '' AND h NOT IN ({", ".join(lit(w) for w in V.NOT_A_REPORTER)}))) > 0 AS sourced
    FROM asents""".replace("\\\\s", "\\s"),
)
CTES["timeo"] = (
    ("docs", "sflags"),
    """SELECT doc_id, n, past, present, future,
         CASE WHEN n = 0 THEN 0 ELSE pf + CASE WHEN pp_rank <= residue THEN 1 ELSE 0 END END AS past_pct,
         CASE WHEN n = 0 THEN 0 ELSE nf + CASE WHEN np_rank <= residue THEN 1 ELSE 0 END END AS present_pct,
         CASE WHEN n = 0 THEN 0 ELSE ff + CASE WHEN fp_rank <= residue THEN 1 ELSE 0 END END AS future_pct
    FROM (
      SELECT *, 100 - pf - nf - ff AS residue,
        list_position(names, 'past') AS pp_rank, list_position(names, 'present') AS np_rank, list_position(names, 'future') AS fp_rank
      FROM (
        SELECT *, list_transform(list_sort([
            {'k': -(fe - ff), 'n': 'future'}, {'k': -(pe - pf), 'n': 'past'}, {'k': -(ne - nf), 'n': 'present'}]), lambda x: x.n) AS names
        FROM (
          SELECT *, CAST(trunc(pe) AS BIGINT) AS pf, CAST(trunc(ne) AS BIGINT) AS nf, CAST(trunc(fe) AS BIGINT) AS ff FROM (
            SELECT *, past / greatest(n, 1) * 100 AS pe, present / greatest(n, 1) * 100 AS ne, future / greatest(n, 1) * 100 AS fe FROM (
              SELECT d.doc_id, count(f.doc_id) AS n, count(*) FILTER (past) AS past, count(*) FILTER (future) AS future,
                     count(f.doc_id) - count(*) FILTER (past) - count(*) FILTER (future) AS present
              FROM docs d LEFT JOIN sflags f ON d.doc_id = f.doc_id GROUP BY d.doc_id)))))""",
)
CTES["vcounts"] = (
    ("docs", "sflags"),
    f"""SELECT doc_id, n, {pct("you", "n")} AS you, {pct("we", "n")} AS we, imp, {pct("spec", "n")} AS spec, {pct("promo", "n")} AS promo
    FROM (SELECT d.doc_id, count(f.doc_id) AS n, count(*) FILTER (you) AS you, count(*) FILTER (we) AS we,
                 count(*) FILTER (imp) AS imp, count(*) FILTER (spec) AS spec, count(*) FILTER (promo) AS promo
          FROM docs d LEFT JOIN sflags f ON d.doc_id = f.doc_id GROUP BY d.doc_id)""",
)
CTES["voices"] = (
    ("vcounts",),
    """SELECT *, CASE WHEN voice = 'insufficient' THEN 'insufficient' WHEN voice_margin < 2 THEN 'borderline'
           WHEN voice_runner_up_margin > -2 THEN 'borderline' ELSE 'high' END AS voice_confidence
    FROM (SELECT doc_id, n AS n_sentences, you AS you_pct, we AS we_pct, imp AS imperative_count, spec AS spec_pct, promo AS promo_pct,
      CASE WHEN n = 0 THEN 'insufficient' ELSE won END AS voice,
      CAST(CASE WHEN n = 0 THEN 0
        WHEN won = 'prescriptive' THEN CASE WHEN r1 AND r2 THEN greatest(m1, m2) WHEN r1 THEN m1 ELSE m2 END
        WHEN won = 'promotional' THEN CASE WHEN r3 AND r4 THEN greatest(m3, m4) WHEN r3 THEN m3 ELSE m4 END
        WHEN won = 'descriptive' THEN m5 WHEN won = 'advisory' THEN m6
        ELSE -greatest(m1, m2, m3, m4, m5, m6) END AS DOUBLE) AS voice_margin,
      CASE WHEN n = 0 THEN NULL WHEN won = 'prescriptive' THEN 'promotional' WHEN won = 'promotional' THEN 'descriptive'
        WHEN won = 'descriptive' THEN 'advisory' WHEN won = 'advisory' THEN 'analytical' END AS voice_runner_up,
      CAST(CASE WHEN n = 0 THEN NULL WHEN won = 'prescriptive' THEN greatest(m3, m4) WHEN won = 'promotional' THEN m5
        WHEN won = 'descriptive' THEN m6
        WHEN won = 'advisory' THEN -greatest(CASE WHEN r1 THEN -999 ELSE m1 END, CASE WHEN r2 THEN -999 ELSE m2 END,
           CASE WHEN r3 THEN -999 ELSE m3 END, CASE WHEN r4 THEN -999 ELSE m4 END, CASE WHEN r5 THEN -999 ELSE m5 END,
           CASE WHEN r6 THEN -999 ELSE m6 END) END AS DOUBLE) AS voice_runner_up_margin
    FROM (SELECT *, CASE WHEN r1 OR r2 THEN 'prescriptive' WHEN r3 OR r4 THEN 'promotional' WHEN r5 THEN 'descriptive'
                         WHEN r6 THEN 'advisory' ELSE 'analytical' END AS won
    FROM (SELECT *, you >= 15 AND imp >= 2 AS r1, you >= 15 OR (imp >= 3 AND you >= 5) AS r2, we >= 20 AS r3,
        promo >= 20 AND you < 5 AND we < 5 AS r4, spec >= 20 AS r5, you >= 5 AS r6,
        least(you - 15, 5 * (imp - 2)) AS m1, greatest(you - 15, least(5 * (imp - 3), you - 5)) AS m2, we - 20 AS m3,
        least(promo - 20, 4 - you, 4 - we) AS m4, spec - 20 AS m5, you - 5 AS m6 FROM vcounts)))""",
)
CTES["attrib"] = (
    ("docs", "sflags"),
    f"""SELECT doc_id, sourced, {pct("sourced", "n")} AS sourced_pct, numeric_sentences, unsupported_numeric, n AS total_sentences
    FROM (SELECT d.doc_id, count(f.doc_id) AS n, count(*) FILTER (sourced) AS sourced, count(*) FILTER (isnum) AS numeric_sentences,
                 count(*) FILTER (isnum AND NOT sourced) AS unsupported_numeric
          FROM docs d LEFT JOIN sflags f ON d.doc_id = f.doc_id GROUP BY d.doc_id)""",
)
CTES["spaced"] = (("docs",), r"SELECT doc_id, CAST(len(regexp_extract_all(text, '\S+')) AS BIGINT) AS sw FROM docs")
CTES["bodies"] = (
    ("docs",),
    f"""SELECT doc_id, used, {ascii_letters("CASE WHEN used THEN body ELSE text END")} AS b FROM (
      SELECT d.doc_id, text, s.doc_id IS NOT NULL AS used, body FROM docs d LEFT JOIN (
        SELECT doc_id, string_agg(raw, chr(10) ORDER BY line_no) FILTER (NOT head AND section_no > 0) AS body FROM (
          SELECT *, sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) AS section_no FROM (
            SELECT *, {strip("raw")} LIKE '## %' OR {strip("raw")} LIKE '### %' AS head FROM (
              SELECT doc_id, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line_no FROM docs)))
        GROUP BY doc_id HAVING bool_or(head)) s ON d.doc_id = s.doc_id)""",
)
_regs = list(V.REGISTERS)
CTES["regs"] = (
    ("bodies",),
    "SELECT doc_id, used, " + ", ".join(f"{n_hits('b', V.REGISTERS[g])} AS reg_{g}" for g in _regs) + " FROM bodies",
)
_tot = " + ".join(f"reg_{g}" for g in _regs)
CTES["styletok"] = (
    ("docs",),
    f"SELECT doc_id, unnest({style_tokens('text')}) AS w FROM docs",
)
_SYL = r"len(regexp_extract_all(w, '[aeiouy]+'))"
CTES["styled"] = (
    ("docs", "styletok", "plain", "masked", "raw_lines"),
    rf"""SELECT d.doc_id, coalesce(n, 0) AS style_words,
      CASE WHEN n > 0 THEN {r("types / n", 4)} ELSE 0.0 END AS type_token_ratio,
      CASE WHEN ns > 0 THEN {r("len_sum / ns", 1)} ELSE 0.0 END AS mean_sentence_length,
      CASE WHEN n > 0 THEN {r("0.39::DOUBLE * (n / greatest(coalesce(ns, 0), 1)) + 11.8::DOUBLE * (syl / n) - 15.59::DOUBLE", 1)} ELSE 0.0 END AS grade_level,
      {r("(bold + items + coalesce(heads, 0)) / greatest(coalesce(n, 0) / 100.0::DOUBLE, 1.0::DOUBLE)", 2)} AS formatting_density,
      CASE WHEN n_hedges + n_asserts > 0 THEN {r("n_asserts / (n_hedges + n_asserts)", 4)} ELSE 0.5 END AS assertiveness_ratio,
      n_hedges, n_asserts, n_named_concepts
    FROM (SELECT m.doc_id, {n_hits("text", r"\*\*[^*]+\*\*")} AS bold,
                 {n_hits("text", r"(?m)^[-*•]\s+")} + {n_hits("text", r"(?m)^\d+\.\s+")} AS items,
                 {n_hits("t", V.STYLE_HEDGE)} AS n_hedges, {n_hits("t", V.STYLE_ASSERT)} AS n_asserts,
                 {n_hits("text", V.NAMED_CONCEPT)} AS n_named_concepts
          FROM masked m JOIN docs USING (doc_id)) d
    LEFT JOIN (SELECT doc_id, count(*) AS n, count(DISTINCT w) AS types,
        sum(CASE WHEN contains(w, '''') THEN 0 WHEN length(w) <= 3 THEN 1
             ELSE greatest(CASE WHEN w LIKE '%e' AND {_SYL} > 1 THEN {_SYL} - 1 ELSE {_SYL} END, 1) END) AS syl
        FROM styletok GROUP BY doc_id) t ON t.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS ns, sum(len({style_tokens("sentence")})) AS len_sum FROM plain GROUP BY doc_id) p ON p.doc_id = d.doc_id
    LEFT JOIN (SELECT doc_id, count(*) AS heads FROM (
        SELECT doc_id, {strip(r"regexp_replace(regexp_replace(line, '^#+\s*', ''), '\*+', '', 'g')")} AS h FROM raw_lines
        WHERE line LIKE '## %' OR line LIKE '### %') WHERE h <> '' GROUP BY doc_id) h ON h.doc_id = d.doc_id""",
)
STOP = ", ".join(lit(w) for w in V.STOP_WORDS)
CTES["novel"] = (
    ("plain",),
    f"""SELECT doc_id, i, n_new / n AS y, n_new_words FROM (
      SELECT doc_id, sent_no, count(*) AS n, count(*) FILTER (sent_no = first_no) AS n_new,
             count(DISTINCT w) FILTER (sent_no = first_no) AS n_new_words,
             row_number() OVER (PARTITION BY doc_id ORDER BY sent_no) - 1 AS i FROM (
        SELECT *, min(sent_no) OVER (PARTITION BY doc_id, w) AS first_no FROM (
          SELECT doc_id, sent_no, unnest(regexp_extract_all(lower(sentence), '[a-z]{{3,}}')) AS w FROM plain)
        WHERE w NOT IN ({STOP}))
      GROUP BY doc_id, sent_no)""",
)
CTES["roles"] = (
    ("masked", "spaced"),
    " UNION ALL ".join(
        f"SELECT doc_id, '{role}' AS role, {i} AS ord, {n_hits('t', p)} AS mentions, sw FROM masked JOIN spaced USING (doc_id)"
        for i, (role, p) in enumerate(V.ROLES.items())
    ),
)
CTES["falsif"] = (
    ("docs", "spaced"),
    rf"""SELECT doc_id, CASE WHEN sw >= 100 THEN count(*) FILTER (p) END AS falsification_count,
              CASE WHEN sw >= 100 THEN count(*) FILTER (c AND NOT p) END AS conditional_count FROM (
      SELECT doc_id, sw, {has("s", V.FALSIFICATION)} AS p, {has("s", V.CONDITIONAL)} AS c FROM (
        SELECT doc_id, sw, {ascii_letters(strip("unnest(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(57344), 'g'), chr(57344)))"))} AS s
        FROM docs JOIN spaced USING (doc_id)))
    GROUP BY doc_id, sw""".replace("\\\\", "\\"),
)
CTES["scope"] = (
    ("masked", "spaced"),
    f"""SELECT doc_id, sw, list_distinct(list_transform(regexp_extract_all(t, {lit(V.YEAR)}, 1), lambda y: CAST(y AS BIGINT))) AS ys,
        len(list_distinct(regexp_extract_all(t, {lit(V.DECADE)}))) AS dec,
        {n_hits("t", V.PROJECTION)} AS proj, {n_hits("t", V.RETROSPECTIVE)} AS retro
    FROM masked JOIN spaced USING (doc_id)""",
)
CTES["genremarks"] = (
    ("masked", "spaced", "docs"),
    f"""SELECT doc_id, sw, rec, ins, alt, adv, nar, rec + ins + alt + adv + nar AS marks,
      CASE WHEN sw > 0 THEN rec * 1000.0::DOUBLE / sw ELSE 0 END AS reck, CASE WHEN sw > 0 THEN ins * 1000.0::DOUBLE / sw ELSE 0 END AS insk,
      CASE WHEN sw > 0 THEN alt * 1000.0::DOUBLE / sw ELSE 0 END AS altk, CASE WHEN sw > 0 THEN adv * 1000.0::DOUBLE / sw ELSE 0 END AS advk,
      CASE WHEN sw > 0 THEN nar * 1000.0::DOUBLE / sw ELSE 0 END AS nark FROM (
      SELECT m.doc_id, sw, {n_hits(mask_should("t"), RECOMMENDATION)} AS rec, {n_hits("text", V.INSTRUCTION)} AS ins,
             {n_hits("t", V.ALTERNATIVES)} AS alt, {n_hits("t", V.ADVOCACY)} AS adv, {n_hits("t", V.NARRATIVE)} AS nar
      FROM masked m JOIN spaced USING (doc_id) JOIN docs USING (doc_id))""",
)

SQL = {
    "coverage": query(
        "SELECT doc_id, perspective, CAST(n AS BIGINT) AS count, density, CAST(dismissed AS BIGINT) AS dismissed, covered FROM cov", "cov"
    ),
    "coverage_summary": query("SELECT * FROM covsum", "covsum"),
    "marker_hits": query(
        r"""SELECT doc_id, perspective, lower(regexp_replace(marker, '\s+', ' ', 'g')) AS marker, a AS start, e AS "end" FROM placed""", "placed"
    ),
    "substantive_hits": query(
        r"""SELECT doc_id, perspective, lower(regexp_replace(marker, '\s+', ' ', 'g')) AS marker, a AS start, e AS "end" FROM judged WHERE NOT gone""", "judged"
    ),
    "sourced_sentences": query("SELECT doc_id, sent_no, sourced AS is_sourced FROM sflags", "sflags"),
    "numeric_sentences": query("SELECT doc_id, sent_no, isnum AS is_numeric FROM sflags", "sflags"),
    "markers_matched": query(
        r"""SELECT doc_id, perspective, coalesce(array_to_string(ms, '|'), '') AS markers, CAST(coalesce(len(ms), 0) AS BIGINT) AS n_markers FROM (
          SELECT doc_id, perspective, list_sort(list_distinct(list(lower(regexp_replace(marker, '\s+', ' ', 'g'))) FILTER (NOT gone))) AS ms
          FROM judged GROUP BY doc_id, perspective)
        UNION ALL SELECT d.doc_id, p.perspective, '', 0 FROM docs d
          CROSS JOIN (SELECT unnest(['causes','risks','stakeholders','trends','uncertainty']) AS perspective) p
          ANTI JOIN judged j ON j.doc_id = d.doc_id AND j.perspective = p.perspective""",
        "judged",
        "docs",
    ),
    "temporal_orientation": query(
        """SELECT doc_id, past_pct, present_pct, future_pct,
          CASE WHEN present >= past AND present >= future THEN 'present' WHEN past >= future THEN 'past' ELSE 'future' END AS dominant,
          o[1] - o[2] AS dominant_margin, o[1] < 50 AND o[1] - o[2] < 10 AS balanced
        FROM (SELECT *, list_reverse_sort([past_pct, present_pct, future_pct]) AS o FROM timeo)""",
        "timeo",
    ),
    "voice": query("SELECT * FROM voices", "voices"),
    "epistemic_basis": query("SELECT * FROM attrib", "attrib"),
    "mechanism_ratio": query(
        f"""SELECT doc_id, mechanism_count, buzzword_count, {r("mechanism_count / greatest(mechanism_count + buzzword_count, 1)", 4)} AS mechanism_ratio
        FROM (SELECT doc_id, {n_hits("t", V.MECHANISM)} AS mechanism_count, {n_hits(mask_buzz("t"), BUZZWORD)} AS buzzword_count FROM masked)""",
        "masked",
    ),
    "assertion_ratio": query(
        f"""SELECT doc_id, used AS used_section_bodies, {", ".join(f"reg_{g}" for g in _regs)},
          CASE WHEN {_tot} = 0 THEN 0.0 ELSE {r(f"reg_assertion / ({_tot})", 4)} END AS assertion_ratio,
          CASE WHEN {_tot} = 0 THEN 'no_data' WHEN {_tot} < 10 THEN 'low' ELSE 'adequate' END AS assertion_precision FROM regs""",
        "regs",
    ),
    "claim_density": query(
        f"""SELECT doc_id, numeric_claims, causal_claims, {r("numeric_claims / greatest(words / 1000.0::DOUBLE, 0.1::DOUBLE)", 1)} AS numeric_per_kw,
          {r("causal_claims / greatest(words / 1000.0::DOUBLE, 0.1::DOUBLE)", 1)} AS causal_per_kw
        FROM (SELECT w.doc_id, words, count(*) FILTER (num) AS numeric_claims, count(*) FILTER (cau) AS causal_claims FROM doc_words w
          LEFT JOIN (SELECT doc_id, {" OR ".join(has("sentence", p) for _, p in V.SENTENCE_NUMBERS)} AS num, {has(mask_since("s"), CAUSAL)} AS cau FROM asents) s
          ON s.doc_id = w.doc_id GROUP BY w.doc_id, words)""",
        "doc_words",
        "asents",
    ),
    "causal_sentences": query(
        f"""SELECT doc_id, sent_no, CAST(len(m) AS BIGINT) AS n_markers, array_to_string(list_transform(m, lambda x: lower({strip("x")})), '|') AS markers
        FROM (SELECT doc_id, sent_no, regexp_extract_all({mask_since("s")}, {lit(CAUSAL)}) AS m FROM asents) WHERE len(m) > 0""",
        "asents",
    ),
    "presentation_features": query("SELECT * FROM styled", "styled"),
    "information_novelty": query(
        f"""SELECT d.doc_id, coalesce(n, 0) AS novelty_sentences, coalesce(unique_words, 0) AS unique_words,
          coalesce({r("mean_y", 3)}, 0.0) AS mean_novelty, {r("low / n", 3)} AS repetition_rate,
          CASE WHEN n > 2 THEN {r("slope", 4)} WHEN n > 0 THEN 0.0 END AS information_decay,
          {r("first_q", 3)} AS first_quarter_novelty, {r("last_q", 3)} AS last_quarter_novelty
        FROM docs d LEFT JOIN (
          SELECT doc_id, count(*) AS n, CAST(sum(n_new_words) AS BIGINT) AS unique_words, sum(y) / count(*) AS mean_y,
            count(*) FILTER (y < 0.2) AS low, regr_slope(y, i) AS slope,
            avg(y) FILTER (i < q) AS first_q, avg(y) FILTER (i >= total - q) AS last_q
          FROM (SELECT *, count(*) OVER (PARTITION BY doc_id) AS total, greatest(count(*) OVER (PARTITION BY doc_id) // 4, 1) AS q FROM novel)
          GROUP BY doc_id) v ON v.doc_id = d.doc_id""",
        "docs",
        "novel",
    ),
    "temporal_scope": query(
        """SELECT doc_id, CASE WHEN sw >= 100 THEN CAST(len(ys) AS BIGINT) END AS year_count,
          CASE WHEN sw >= 100 THEN CAST(len(list_filter(ys, lambda y: abs(y - 2026) <= 2)) AS BIGINT) END AS near_now_years,
          CASE WHEN sw >= 100 THEN CAST(len(list_filter(ys, lambda y: 2026 - y > 5)) AS BIGINT) END AS historical_years,
          CASE WHEN sw >= 100 THEN CAST(len(list_filter(ys, lambda y: y - 2026 > 2)) AS BIGINT) END AS projection_years,
          CASE WHEN sw >= 100 THEN CAST(dec AS BIGINT) END AS decade_references,
          CASE WHEN sw >= 100 THEN proj END AS projection_phrases, CASE WHEN sw >= 100 THEN retro END AS retrospective_phrases FROM scope""",
        "scope",
    ),
    "stakeholder_map": query("SELECT doc_id, role, mentions FROM roles WHERE sw >= 100 AND mentions > 0", "roles"),
    "stakeholder_roles": query(
        """SELECT doc_id, CASE WHEN sw >= 100 THEN count(*) FILTER (mentions > 0) END AS role_count,
          CASE WHEN sw >= 100 THEN CAST(sum(mentions) AS BIGINT) END AS role_mentions,
          CASE WHEN sw >= 100 THEN coalesce(string_agg(CASE WHEN mentions > 0 THEN role END, ',' ORDER BY role), '') END AS roles_named,
          CASE WHEN sw >= 100 THEN coalesce(string_agg(CASE WHEN mentions = 0 THEN role END, ',' ORDER BY ord), '') END AS roles_absent
        FROM roles GROUP BY doc_id, sw""",
        "roles",
    ),
    "falsification": query("SELECT * FROM falsif", "falsif"),
}
