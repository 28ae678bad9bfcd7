"""SQL for short labels, with literals of its own."""

from __future__ import annotations

from checks.facts_sql import SQL as _facts  # noqa: F401  (its tables are registered on import)
from checks.framing_sql import SQL as _framing
from checks.sql import query


def _label(score: str, sets: list[tuple[str, float, float]]) -> str:
    parts = ", ".join(
        f"CASE WHEN abs({score} - {m}::DOUBLE) < {s}::DOUBLE THEN '~{n}' WHEN {score} > {m}::DOUBLE + {s}::DOUBLE THEN '>{n}' END" for n, m, s in sets
    )
    labels = f"list_filter([{parts}], lambda x: x IS NOT NULL)[:2]"
    return f"CASE WHEN len({labels}) > 0 THEN array_to_string({labels}, ', ') ELSE 'outside reference range' END"


_MECHANISM = [("BASIC", 0.861, 0.194), ("GAMING_V2", 0.976, 0.029), ("PROTOCOL", 0.817, 0.267), ("STANDARD", 0.884, 0.163)]
_ASSERTION = [("BASIC", 0.409, 0.161), ("GAMING_V2", 0.873, 0.116), ("PROTOCOL", 0.397, 0.292), ("STANDARD", 0.559, 0.283)]
_DOMAINS = "['brave.com','coingecko.com','wikipedia.org','stlouisfed.org','alphavantage.co','worldbank.org','restcountries.com','wolframalpha.com','sec.gov','github.com','evil.com','example.com']"
_NAMES = "['brave','coingecko','wikipedia','fred','alpha_vantage','world_bank','rest_countries','wolfram','sec_edgar','github','unknown','unknown']"

SQL = {
    "range_label": f"""SELECT m.doc_id, {_label("mechanism_ratio", _MECHANISM)} AS mechanism_label, {_label("assertion_ratio", _ASSERTION)} AS assertion_label
      FROM ({_framing["mechanism_ratio"]}) m JOIN ({_framing["assertion_ratio"]}) a ON a.doc_id = m.doc_id""",
    "preview": query(
        r"""SELECT doc_id, sent_no, marker, CASE WHEN marker <> '' THEN
            CASE WHEN p > 41 THEN '...' ELSE '' END || substr(sentence, greatest(p - 40, 1), p + length(marker) + 40 - greatest(p - 40, 1))
            || CASE WHEN p - 1 + length(marker) + 40 < length(sentence) THEN '...' ELSE '' END
          WHEN length(sentence) <= 80 THEN sentence ELSE substr(sentence, 1, 80) || '...' END AS preview
        FROM (SELECT *, instr(lower(sentence), marker) AS p FROM (SELECT *, lower(regexp_extract(sentence, '(?i)\b(?:risks?|growth|because|costs?)\b')) AS marker FROM sents))""",
        "sents",
    ),
    "provider_of_url": rf"""SELECT page_id, regexp_replace(url, 'example\.(?:com|net|org)', {_DOMAINS}[page_id % 12 + 1], 'g') AS link, {_NAMES}[page_id % 12 + 1] AS provider FROM pages""",
    "indicator_of": query(
        """SELECT claim_id, CASE WHEN claim_id LIKE 'indicators%' THEN 'NY.GDP.MKTP.CD' WHEN claim_id LIKE 'countries%' THEN 'SP.POP.TOTL' END AS indicator,
          CASE WHEN claim_id LIKE 'indicators%' THEN 'GDP' WHEN claim_id LIKE 'countries%' THEN 'POPTHM' END AS series,
          CASE WHEN claim_id LIKE 'indicators%' THEN 1e9::DOUBLE WHEN claim_id LIKE 'countries%' THEN 1e3::DOUBLE END AS scale FROM fclaims""",
        "fclaims",
    ),
}
