"""Building blocks of the DuckDB queries that check the Spark jobs.

The checks are written relationally (one row per line, windows, joins) where
the jobs use column expressions, so both sides reach a result by different
routes.  RE2 has no lookaround: where a vocabulary uses one, the text is masked
first (same length) and the pattern is used without it.
"""

from __future__ import annotations

import re

from tessera.sources.seeding import SLOTS


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def seeded() -> str:
    parts = ["text"]
    for _, passages in SLOTS:
        whens = " ".join(
            f"WHEN {i} THEN {lit(p)}" for i, p in enumerate(passages)
        )
        parts.append(f"CASE doc_id % {len(passages)} {whens} END")
    sep = " || chr(10) || chr(10) || "
    return sep.join(parts)


LETTERS = (
    r"[\x{00AA}\x{00B5}\x{00BA}\x{00C0}-\x{00D6}\x{00D8}-\x{00F6}\x{00F8}-\x{02FF}"
    r"\x{0370}-\x{1FFF}\x{3040}-\x{D7FF}]"
)
SPACE = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)"


def ascii_letters(text: str, by: str = "q") -> str:
    """Letters outside ASCII become `q`, so that RE2's ASCII word edges fit."""
    return f"regexp_replace({text}, '{LETTERS}', '{by}', 'g')"


def strip(x: str) -> str:
    return f"trim({x}, {SPACE})"


def n_hits(text: str, pattern: str) -> str:
    return f"CAST(len(regexp_extract_all({text}, {lit(pattern)})) AS BIGINT)"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def r(x: str, digits: int) -> str:
    s = float(10**digits)
    return f"(round_even(({x}) * {s}, 0) / {s})"


def pct(part: str, whole: str) -> str:
    return (
        f"CASE WHEN {whole} = 0 THEN 0 ELSE "
        f"CAST(round_even(CAST({part} AS DOUBLE) / {whole} * 100, 0) AS BIGINT) END"
    )


_CUT = "chr(57344)"
CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "docs": ((), f"SELECT doc_id, {seeded()} AS text FROM documents"),
    "masked": (("docs",), f"SELECT doc_id, {ascii_letters('text')} AS t FROM docs"),
    "plain": (
        ("docs",),
        rf"""SELECT doc_id, sentence,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS sent_no
        FROM (
          SELECT doc_id, k, replace({strip("piece")}, chr(57345), '.') AS sentence FROM (
            SELECT doc_id, unnest(string_split(cut, {_CUT})) AS piece,
                   unnest(range(len(string_split(cut, {_CUT})))) AS k FROM (
              SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
                  text, '(?m)^#{{1,6}}\s+.*$', '', 'g'), '\|[^\n]+\|', '', 'g'), '\*+', '', 'g'),
                  '\[([^\]]+)\]\([^)]+\)', '\1', 'g'),
                  '\b(U\.S|vs|Dr|Mr|Mrs|Ms|Jr|Sr|Inc|Ltd|Corp|etc|approx|est|i\.e|e\.g|Prof|Gen|Gov|Sen|Rep|Sgt|Rev|Vol|No|Fig|Eq|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sep|Oct|Nov|Dec)\.',
                  '\1' || chr(57345), 'g'),
                  '([.!?])\s+([A-Z])', '\1' || {_CUT} || '\2', 'g') AS cut
              FROM docs)))
        WHERE len(regexp_extract_all(sentence, '\S+')) >= 5 AND lower(sentence) NOT LIKE '%word count%'""",
    ),
    "doc_words": (
        ("docs",),
        "SELECT doc_id, " + n_hits("text", r"[\p{L}\p{N}_]+") + " AS words FROM docs",
    ),
}


def sentence_chain(prefix: str, texts: str) -> None:
    """CTEs `<prefix>raw_lines`, `lines`, `blocks` and `sents` over a table (doc_id, text)."""
    made = {
    "raw_lines": (
        ("{texts}",),
        f"""SELECT doc_id, {strip("raw")} AS line, line_no FROM (
          SELECT doc_id, unnest(string_split(text, chr(10))) AS raw,
                 CAST(unnest(range(len(string_split(text, chr(10))))) AS BIGINT) AS line_no
          FROM {texts})""",
    ),
    "lines": (
        ("raw_lines",),
        r"""SELECT doc_id, line_no, line,
          CASE WHEN line LIKE '#%' THEN 'heading' WHEN line = '' THEN 'blank'
               WHEN regexp_matches(line, '^(?:[-*•]\s+|\d+\.\s+)') THEN 'list' ELSE 'text' END AS kind,
          coalesce(last_value(CASE WHEN line LIKE '#%' THEN regexp_replace(line, '^#+\s*', '') END
            IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no), '') AS heading
        FROM raw_lines""",
    ),
    "blocks": (
        ("lines",),
        r"""SELECT doc_id, block_no, first(heading ORDER BY line_no) AS heading,
               string_agg(line, ' ' ORDER BY line_no) AS block FROM (
          SELECT *, sum(CASE WHEN kind <> 'text' OR prev IS DISTINCT FROM 'text' THEN 1 ELSE 0 END)
                      OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM (
            SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY line_no) AS prev FROM lines))
        WHERE kind IN ('text', 'list') GROUP BY doc_id, block_no""",
    ),
    "sents": (
        ("blocks",),
        rf"""SELECT doc_id, heading, para_no, sentence,
               CAST(row_number() OVER (PARTITION BY doc_id ORDER BY para_no, k) - 1 AS BIGINT) AS sent_no
        FROM (
          SELECT doc_id, heading, para_no, {strip("piece")} AS sentence, k FROM (
            SELECT doc_id, heading, para_no,
                   unnest(string_split(cut, {_CUT})) AS piece,
                   unnest(range(len(string_split(cut, {_CUT})))) AS k FROM (
              SELECT doc_id, heading,
                     CAST(row_number() OVER (PARTITION BY doc_id ORDER BY block_no) - 1 AS BIGINT) AS para_no,
                     regexp_replace(regexp_replace(regexp_replace(block, '^[-*•]\s+', ''), '^\d+\.\s+', ''),
                       '([.!?])\s+([A-Z])', '\1' || {_CUT} || '\2', 'g') AS cut
              FROM blocks)))
        WHERE length(sentence) > 30""",
    ),
    }
    for name, (deps, body) in made.items():
        for old in ("raw_lines", "lines", "blocks", "sents"):
            body = re.sub(rf"\bFROM {old}\b", f"FROM {prefix}{old}", body)
        deps = tuple(texts if x == "{texts}" else prefix + x for x in deps)
        CTES[prefix + name] = (deps, body.replace("{texts}", texts))


sentence_chain("", "docs")


def query(select: str, *needs: str, **extra: str) -> str:
    """A query with the CTEs it needs, in order; extra CTEs come after them."""
    done: dict[str, str] = {}

    def need(name: str) -> None:
        if name in done or name not in CTES:
            return
        deps, body = CTES[name]
        for d in deps:
            need(d)
        done[name] = f"{name} AS MATERIALIZED (\n{body}\n)"

    for n in needs:
        need(n)
    for name, body in extra.items():
        done[name] = f"{name} AS MATERIALIZED (\n{body}\n)"
    return "WITH " + ",\n".join(done.values()) + "\n" + select
