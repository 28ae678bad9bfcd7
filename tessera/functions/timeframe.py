"""Time scope and parts of a claim sentence, as ordered rules over columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.scalar import let

# --------------------------------------------------------------------------
# Forms of time
# --------------------------------------------------------------------------
QUARTER_YEAR = r"(?i)\bQ\s*-?\s*([1-4])\s+(?:FY\s*)?(\d{4})\b"
QUARTER_SPELLED = (
    r"(?i)\b(first|second|third|fourth)\s+quarter\b(?:\s+(?:of\s+)?(?:FY\s*)?(\d{4}))?"
)
QUARTER_WORDS = ("first", "second", "third", "fourth")
BETWEEN = r"(?i)\bbetween\s+(\d{4})\s+and\s+(\d{4})\b"
DASHED = r"\b(\d{4})\s*(?:-|–|to)\s*(\d{4})\b"
FISCAL = r"(?i)\b(?:fiscal\s+(?:year\s+)?|FY\s*)(\d{4})\b"
BARE_YEAR = (
    r"(?i)\b(?:in|during|for|as\s+of|ending|through|by|since|from|throughout|across|reported"
    r"|posted|announced|disclosed|ended)\s+(\d{4})\b"
)
MONTH_YEAR = (
    r"(?i)\b(?:January|February|March|April|May|June|July|August|September|October|November"
    r"|December)\s+(\d{4})\b"
)
NOW = (
    r"(?i)\b(?:currently|today|presently|at\s+present|as\s+of\s+now|right\s+now|these\s+days"
    r"|nowadays|at\s+this\s+time)\b"
)
TIME_MENTION = (
    r"(?i)\b((?:FY|fiscal\s+(?:year\s+)?)?20[1-3]\d|Q[1-4]\s+(?:FY\s*)?20[1-3]\d"
    r"|(?:January|February|March|April|May|June|July|August|September|October|November"
    r"|December)\s+20[1-3]\d)\b"
)
PRIOR_YEAR = r"(?i)\b(?:prior|previous|preceding|last)\s+year"
FIRST_YEAR, LAST_YEAR = 1900, 2100
HISTORICAL_AFTER = 5

# Metrics, first match wins
METRICS = [
    ("operating_expenses", r"(?i)\b(?:operating\s+expenses?|opex|cost\s+of\s+(?:goods|revenue|sales))\b"),
    ("cash", r"(?i)\b(?:cash(?:\s+and\s+(?:cash\s+)?equivalents)?|liquidity)\b"),
    ("revenue", r"(?i)\b(?:revenue|sales|turnover)\b"),
    ("profit", r"(?i)\b(?:profit|earnings|net\s+income|EBITDA)\b"),
    ("market_cap", r"(?i)\b(?:market\s+cap|valuation|valued\s+at)\b"),
    ("population", r"(?i)\b(?:population|inhabitants|residents|people)\b"),
    ("area", r"(?i)\b(?:area|square\s+(?:km|miles?|kilometers?)|sq\s+km)\b"),
    ("height", r"(?i)\b(?:height|tall|elevation|altitude)\b"),
    ("weight", r"(?i)\b(?:weight|mass|weighs?|kg|kilograms?|tonnes?)\b"),
    ("length", r"(?i)\b(?:length|long|span|arm\s+span|mantle)\b"),
    ("lifespan", r"(?i)\b(?:lifespan|life\s+span|life\s+expectancy|years?\s+old|longevity)\b"),
    ("price", r"(?i)\b(?:price|cost|priced?\s+at|trading\s+at|worth)\b"),
    ("gdp", r"(?i)\b(?:GDP|gross\s+domestic\s+product)\b"),
    ("growth", r"(?i)\b(?:grew|growth|increase[ds]?|decline[ds]?|change[ds]?)\s+"),
    ("count", r"(?i)\b(?:species|number\s+of|approximately|about|around|some)\b"),
]
DERIVED = (
    r"(?i)\b(?:grew|growth|increase[ds]?\s+(?:by|of)|decline[ds]?\s+(?:by|of)|change[ds]?\s+(?:by|of)"
    r"|up\s+\d|down\s+\d|rose\s+\d|fell\s+\d)\b"
)
PROJECTED = (
    r"(?i)\b(?:projected|forecast|expected\s+to|will\s+reach|by\s+20[3-9]\d|estimated\s+to\s+reach"
    r"|poised\s+to)\b"
)
SEGMENT = (
    r"(?i)\b(?:segments?|divisions?|business\s+units?|product\s+lines?|business\s+segments?"
    r"|reportable\s+segments?|operating\s+segments?)\b"
)
SEGMENT_LINE = (
    r"(?i)\b(?:data\s*center|datacenter|cloud|gaming|games?|streaming|automotive|services"
    r"|subscriptions?|app\s+store|advertising|ads?|search|workstation|networking|wireless"
    r"|broadband|fiber|enterprise\s+wireline|consumer\s+wireline|office)\s+(?:revenue|sales"
    r"|business|operations|advertising|ads?|segment)"
)
CURRENCY_WORD = r"(?i)dollar|euro|pound|yen|rupee|usd|eur|gbp|jpy|inr"
DISTANCE = r"(?i)\b(?:km|km2|miles?|meters?|metres?|m|ft|feet)\b"
MASS = r"(?i)\b(?:kg|kilograms?|tonnes?|grams?|lbs?|pounds?)\b"
DURATION = r"(?i)\b(?:years?|months?|weeks?|days?)\b"


def _group(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def classify_time(sentence: Column, hint: Column, this_year: int) -> Column:
    """struct<period_type, year, quarter, y_start, y_end, reason> of a claim.

    Rules go from the most to the least specific; each looks at the hint first."""

    def made(kind, reason, year=None, quarter=None, start=None, end=None) -> Column:
        none = F.lit(None).cast("int")
        as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
        return F.struct(
            as_column(kind).alias("period_type"),
            (none if year is None else year).alias("year"),
            (none if quarter is None else quarter).alias("quarter"),
            (none if start is None else start).alias("y_start"),
            (none if end is None else end).alias("y_end"),
            as_column(reason).alias("reason"),
        )

    def old(year: Column) -> Column:
        return F.coalesce((F.lit(this_year) - year) > HISTORICAL_AFTER, F.lit(False))

    def dated(kind: str, reason: str, year: Column, quarter=None, old_reason="historical_old_year") -> Column:
        return made(
            F.when(old(year), "historical").otherwise(kind),
            F.when(old(year), old_reason).otherwise(reason),
            year,
            quarter,
        )

    def plausible(year: Column) -> Column:
        return year.between(FIRST_YEAR, LAST_YEAR)

    def quarter_year(t: Column) -> Column:
        return let(
            _group(t, QUARTER_YEAR, 2),
            lambda year: F.when(
                plausible(year),
                dated("quarterly", "quarterly_q_notation", year, _group(t, QUARTER_YEAR, 1), "historical_old_year_quarterly"),
            ),
        )

    def quarter_spelled(t: Column) -> Column:
        word = F.lower(F.regexp_extract(t, QUARTER_SPELLED, 1))
        number = F.lit(None).cast("int")
        for i, w in enumerate(QUARTER_WORDS, start=1):
            number = F.when(word == w, F.lit(i)).otherwise(number)
        own = _group(t, QUARTER_SPELLED, 2)
        near = _group(sentence, r"\b(\d{4})\b", 1)
        year = F.when(plausible(own), own).when(plausible(near), near)
        return F.when(
            word != "",
            let(
                year,
                lambda y: dated("quarterly", "quarterly_spelled_out", y, number, "historical_old_year_quarterly"),
            ),
        )

    def span(pattern: str, reason: str):
        def rule(t: Column) -> Column:
            a, b = _group(t, pattern, 1), _group(t, pattern, 2)
            return F.when(
                plausible(a) & plausible(b),
                made("range", reason, start=F.least(a, b), end=F.greatest(a, b)),
            )

        return rule

    def annual(pattern: str, reason: str):
        def rule(t: Column) -> Column:
            return let(
                _group(t, pattern, 1), lambda year: F.when(plausible(year), dated("annual", reason, year))
            )

        return rule

    def now(t: Column) -> Column:
        return F.when(t.rlike(NOW), made("current", "current_marker", F.lit(this_year)))

    rules = [
        quarter_year,
        quarter_spelled,
        span(BETWEEN, "range_between"),
        span(DASHED, "range_dash"),
        annual(FISCAL, "annual_fy_notation"),
        annual(BARE_YEAR, "annual_bare_year"),
        annual(MONTH_YEAR, "annual_month_year"),
        now,
    ]
    tried = [rule(t) for rule in rules for t in (hint, sentence)]
    return F.coalesce(*tried, made("unknown", "no_time_anchor"))


def time_mention(sentence: Column, heading: Column, raw: Column) -> Column:
    """The time named with a claim; one year less if the number follows `prior year`."""
    own = F.regexp_extract(sentence, TIME_MENTION, 1)
    found = F.when(own != "", own).otherwise(F.regexp_extract(heading, TIME_MENTION, 1))
    bare = F.substring_index(F.btrim(F.regexp_replace(raw, r"^[$€£¥₹]+", "")), " ", 1)
    follows = F.exists(
        F.regexp_extract_all(sentence, F.lit(PRIOR_YEAR + r"(?=(.{0,50}))"), F.lit(1)),
        lambda window: F.contains(window, bare),
    )
    year = F.regexp_extract(found, r"20[1-3]\d", 0)
    shifted = F.replace(found, year, (year.try_cast("int") - 1).cast("string"))
    return F.when((year != "") & (bare != "") & follows, shifted).otherwise(found)


def metric_of(sentence: Column) -> Column:
    found = F.lit("")
    for name, pattern in reversed(METRICS):
        found = F.when(sentence.rlike(pattern), name).otherwise(found)
    return found


def claim_type_of(sentence: Column, raw: Column) -> Column:
    return (
        F.when(sentence.rlike(PROJECTED), "projection")
        .when(sentence.rlike(DERIVED) & F.contains(raw, F.lit("%")), "derived")
        .otherwise("direct")
    )


def unit_of(sentence: Column, raw: Column, metric: Column) -> Column:
    return (
        F.when(raw.rlike(r"^[$€£¥₹]") | sentence.rlike(r"[€£¥₹]") | sentence.rlike(CURRENCY_WORD), "currency")
        .when(F.endswith(raw, F.lit("%")) | sentence.rlike(r"(?i)percent"), "percent")
        .when(sentence.rlike(DISTANCE), "distance")
        .when(sentence.rlike(MASS), "mass")
        .when(sentence.rlike(DURATION) & (metric == "lifespan"), "time")
        .otherwise("count")
    )


def is_segment(sentence: Column, heading: Column) -> Column:
    both = F.concat_ws(" ", sentence, heading)
    return both.rlike(SEGMENT) | both.rlike(SEGMENT_LINE)
