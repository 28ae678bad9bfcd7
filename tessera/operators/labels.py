"""Short labels: reference ranges of scores, previews of sentences, providers of links, indicators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.scalar import let

# Mean and deviation of a score in each reference set
RANGES = {
    "mechanism_ratio": {
        "BASIC": (0.861, 0.194), "STANDARD": (0.884, 0.163), "PROTOCOL": (0.817, 0.267), "GAMING_V2": (0.976, 0.029),
    },
    "assertion_ratio": {
        "BASIC": (0.409, 0.161), "STANDARD": (0.559, 0.283), "PROTOCOL": (0.397, 0.292), "GAMING_V2": (0.873, 0.116),
    },
}
OUTSIDE = "outside reference range"
# Domains and the provider that answers there
PROVIDERS = {
    "brave.com": "brave", "coingecko.com": "coingecko", "wikipedia.org": "wikipedia", "stlouisfed.org": "fred",
    "alphavantage.co": "alpha_vantage", "worldbank.org": "world_bank", "restcountries.com": "rest_countries",
    "wolframalpha.com": "wolfram", "sec.gov": "sec_edgar", "github.com": "github",
}
# Indicators in the order of their rules (words in the sentence, metric, code)
INDICATORS = [
    (("per capita",), None, "NY.GDP.PCAP.CD"),
    (("gdp", "gross domestic"), "gdp", "NY.GDP.MKTP.CD"),
    (("population",), "population", "SP.POP.TOTL"),
    (("life expectancy",), "lifespan", "SP.DYN.LE00.IN"),
    (("inflation", "cpi"), None, "FP.CPI.TOTL.ZG"),
    (("unemployment",), None, "SL.UEM.TOTL.ZS"),
    (("poverty",), None, "SI.POV.DDAY"),
]
# Series in the order of their words (word, code, factor to base units)
SERIES = [
    ("gdp", "GDP", 1e9), ("gross domestic product", "GDP", 1e9), ("real gdp", "GDPC1", 1e9),
    ("unemployment", "UNRATE", 1.0), ("unemployment rate", "UNRATE", 1.0), ("inflation", "FPCPITOTLZGUSA", 1.0),
    ("inflation rate", "FPCPITOTLZGUSA", 1.0), ("cpi", "CPIAUCSL", 1.0), ("consumer price index", "CPIAUCSL", 1.0),
    ("federal funds rate", "FEDFUNDS", 1.0), ("interest rate", "FEDFUNDS", 1.0), ("fed funds", "FEDFUNDS", 1.0),
    ("national debt", "GFDEBTN", 1e6), ("debt", "GFDEBTN", 1e6), ("population", "POPTHM", 1e3),
    ("housing starts", "HOUST", 1e3), ("industrial production", "INDPRO", 1.0), ("retail sales", "RSXFS", 1e6),
    ("trade balance", "BOPGSTB", 1e6), ("money supply", "M2SL", 1e9), ("m2", "M2SL", 1e9),
]


def range_label(score: Column, measure: str) -> Column:
    """The first two reference sets, by name, that a score lies in (`~`) or above (`>`)."""
    found = [
        F.when(F.abs(score - mean) < spread, f"~{name}").when(score > mean + spread, f">{name}")
        for name, (mean, spread) in sorted(RANGES[measure].items())
    ]
    labels = F.slice(F.array_compact(F.array(*found)), 1, 2)
    return F.when(F.size(labels) > 0, F.array_join(labels, ", ")).otherwise(OUTSIDE)


def preview(sentence: Column, marker: Column, window: int = 80) -> Column:
    """Some signs of a sentence around a marker, or its beginning if the marker is not in it."""
    half = window // 2

    def around(place: Column) -> Column:
        start = F.greatest(place - 1 - half, F.lit(0))
        end = F.least(F.length(sentence), place - 1 + F.length(marker) + half)
        return F.concat(
            F.when(start > 0, "...").otherwise(""),
            F.substring(sentence, start + 1, end - start),
            F.when(end < F.length(sentence), "...").otherwise(""),
        )

    whole = F.when(F.length(sentence) <= window, sentence).otherwise(F.concat(F.substring(sentence, 1, window), F.lit("...")))
    return let(
        F.when(marker != "", F.call_function("instr", F.lower(sentence), marker)),
        lambda place: F.when(place > 0, around(place)).otherwise(whole),
    )


def provider_of_url(url: Column) -> Column:
    """The provider whose domain is the host's own or ends it."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    label = F.lit("unknown")
    for domain, name in reversed(PROVIDERS.items()):
        label = F.when((host == domain) | F.endswith(host, F.lit("." + domain)), name).otherwise(label)
    return label


def indicator_of(sentence: Column, metric: Column) -> Column:
    """The first indicator whose rule fits; null if none does."""
    text, code = F.lower(sentence), F.lit(None).cast("string")
    for words, own, name in reversed(INDICATORS):
        fits = metric == own if own else F.lit(False)
        for word in words:
            fits = fits | F.contains(text, F.lit(word))
        code = F.when(fits, name).otherwise(code)
    return code


def series_of(sentence: Column, metric: Column) -> Column:
    """The first series whose word is in the sentence or the metric, with its factor; null if none is."""
    text, found = F.lower(sentence), F.lit(None).cast("struct<code:string,scale:double>")
    for word, code, scale in reversed(SERIES):
        fits = F.contains(text, F.lit(word)) | F.contains(metric, F.lit(word))
        found = F.when(fits, F.struct(F.lit(code).alias("code"), F.lit(scale).alias("scale"))).otherwise(found)
    return found
