"""SQL for the text stage."""

from __future__ import annotations

from checks.sql import SPACE, lit, query, strip
from tessera.functions import vocabulary as V

STOP = ", ".join(lit(w) for w in V.STOP_WORDS)

PLAIN_STYLE = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace("
    r"{x}, '#{{1,6}}\s+', '', 'g'), '\*\*([^*]+)\*\*', '\1', 'g'), '\*([^*]+)\*', '\1', 'g'),"
    r" '`([^`]+)`', '\1', 'g'), '\[([^\]]+)\]\([^)]+\)', '\1', 'g')"
)


def style_tokens(x: str) -> str:
    return f"regexp_extract_all(lower({PLAIN_STYLE.format(x=x)}), '[a-zA-Z'']+')"


SLUG = (
    "concat_ws('-', 'panel', CAST(doc_id // 4 AS VARCHAR), CASE WHEN doc_id % 14 = 13 THEN 'unnamed' "
    "ELSE ['alder','birch','cedar','dogwood'][CAST(doc_id % 4 AS INT) + 1] END)"
)
PRODUCER = (
    "CASE WHEN doc_id % 14 = 13 THEN 'other' "
    "ELSE ['alder','birch','cedar','dogwood'][CAST(doc_id % 4 AS INT) + 1] END"
)

_SLICES = ", ".join(
    f"CAST(sum(CAST('0x' || substr(h, {1 + 8 * i}, 8) AS BIGINT)) AS BIGINT) AS s{i}" for i in range(4)
)

SQL = {
    "read_corpus": f"""SELECT d.doc_id, lang, source, n_chars, quality, toxic,
        {SLUG.replace('doc_id', 'd.doc_id')} AS slug, d.doc_id // 4 AS peer_group,
        {PRODUCER.replace('doc_id', 'd.doc_id')} AS producer
        FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "content_hash": query("SELECT doc_id, sha256(text) AS content_hash FROM docs", "docs"),
    "state_hash": query(
        f"""SELECT n_docs, substr(sha256(concat_ws('/', n_docs, s0, s1, s2, s3)), 1, 12) AS state_hash
        FROM (SELECT count(*) AS n_docs, {_SLICES}
              FROM (SELECT sha256(doc_id || ':' || sha256(text)) AS h FROM docs))""",
        "docs",
    ),
    "lines_with_heading": query("SELECT doc_id, line_no, line, kind, heading FROM lines", "lines"),
    "sentences": query("SELECT doc_id, sent_no, heading, para_no, sentence FROM sents", "sents"),
    "sentences_simple": query("SELECT doc_id, sent_no, sentence FROM plain", "plain"),
    "headings": query(
        rf"""SELECT doc_id, heading, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS heading_no
        FROM (SELECT doc_id, line_no, {strip(r"regexp_replace(regexp_replace(line, '^#+\s*', ''), '\*+', '', 'g')")} AS heading
              FROM raw_lines WHERE line LIKE '## %' OR line LIKE '### %') WHERE heading <> ''""",
        "raw_lines",
    ),
    "section_bodies": query(
        f"""SELECT doc_id, {strip("string_agg(CASE WHEN NOT head THEN raw END, chr(10) ORDER BY line_no)")} AS body, section_no FROM (
          SELECT *, CAST(sum(CASE WHEN head THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_no) - 1 AS BIGINT) AS section_no
          FROM (SELECT *, {strip("raw")} LIKE '## %' OR {strip("raw")} LIKE '### %' AS head FROM (
            SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                   unnest(range(len(string_split(text, chr(10))))) AS line_no FROM docs)))
        WHERE section_no >= 0 GROUP BY doc_id, section_no""",
        "docs",
    ).replace("SELECT doc_id, trim(", "SELECT doc_id, coalesce(trim(", 1).replace(
        f"{SPACE}) AS body, section_no", f"{SPACE}), '') AS body, section_no", 1
    ),
    "tokens": query(
        rf"""SELECT doc_id, rule, token, count(*) AS n FROM (
          SELECT doc_id, 'word' AS rule, unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+')) AS token FROM docs
          UNION ALL
          SELECT * FROM (SELECT doc_id, 'content' AS rule, unnest(regexp_extract_all(lower(text), '[a-z]{{3,}}')) AS token FROM docs)
            WHERE token NOT IN ({STOP})
          UNION ALL SELECT doc_id, 'style' AS rule, unnest({style_tokens("text")}) AS token FROM docs)
        GROUP BY doc_id, rule, token""",
        "docs",
    ),
    "year_mentions": query(
        " UNION ALL ".join(
            f"SELECT doc_id, '{kind}' AS kind, unnest(range(len(f))) AS pos, unnest(f) AS mention "
            f"FROM (SELECT doc_id, regexp_extract_all(t, {lit(pat)}, {g}) AS f FROM masked)"
            for kind, pat, g in (
                ("year", V.YEAR, 1),
                ("fiscal", V.FISCAL_YEAR, 1),
                ("decade", V.DECADE, 0),
            )
        ),
        "masked",
    ),
    "clean_documents": query("SELECT doc_id, sha256(text) AS content_hash FROM docs WHERE NOT (contains(lower(text), '<user_document') OR contains(lower(text), '</user_document>'))", "docs"),
    "quarantined_documents": query("SELECT doc_id, sha256(text) AS content_hash FROM docs WHERE contains(lower(text), '<user_document') OR contains(lower(text), '</user_document>')", "docs"),
    "unsafe_text_flag": query(
        "SELECT doc_id, contains(lower(text), '<user_document') OR contains(lower(text), '</user_document>') AS unsafe FROM docs",
        "docs",
    ),
}
