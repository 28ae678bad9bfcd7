"""Claims against reference facts: parts, routes, matches, verdicts.

Claims meet facts in one equi-join on (provider, entity, metric) after each claim
has been routed to at most three providers; the choice of the fact that speaks to a
claim is a `min` over a struct, so it is aggregated map-side and needs no window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import timeframe as T
from tessera.functions.scalar import rounded
from tessera.operators.claims import normal_value
from tessera.sources.corpus import spread

# Bands of relative difference per provider
# (exact below, close below, contradicted below; None: never contradicts)
BANDS = {
    "filings": (0.005, 0.03, float("inf")),
    "indicators": (0.01, 0.15, 1.0),
    "countries": (0.01, 0.05, None),
    "crypto": (0.02, 0.10, None),
    "macro": (0.01, 0.15, 2.0),
    "market": (0.01, 0.05, None),
    "encyclopedia": (0.01, 0.05, float("inf")),
    "physical": (0.01, 0.05, float("inf")),
    "web": (0.01, 0.025, 0.25),
}
# Weight of each provider's word
AUTHORITY = {
    "macro": 0.95, "indicators": 0.9, "physical": 0.85, "market": 0.75,
    "encyclopedia": 0.7, "countries": 0.65, "crypto": 0.6,
}
OTHER_AUTHORITY = 0.5
# Words that send a claim to a provider
COUNTRY_WORDS = r"gdp|population|life expectancy|unemployment|inflation|poverty|literacy"
PLACE_WORDS = r"population|area|square"
MACRO_WORDS = (
    r"gdp|unemployment|inflation|cpi|interest rate|federal funds|money supply|national debt"
    r"|industrial production|retail sales"
)
FINANCE_WORDS = (
    r"revenue|earnings|profit|market cap|valuation|sales|income|fiscal|quarterly|annual report"
    r"|cash|operating expenses|opex"
)
PHYSICAL_WORDS = (
    r"meters|metres|kilometers|miles|feet|kg|tonnes|speed|temperature|diameter|altitude|elevation"
)


def decompose(claims: DataFrame, this_year: int) -> DataFrame:
    """claims(heading, sentence, raw, …) → + value, metric, unit, type, segment, time."""
    s, h, raw = F.col("sentence"), F.col("heading"), F.col("raw")
    out = claims.select("*", T.metric_of(s).alias("metric"), T.time_mention(s, h, raw).alias("time_period"))
    out = out.select(
        "*",
        normal_value(raw, s).alias("value"),
        T.unit_of(s, raw, F.col("metric")).alias("unit"),
        T.claim_type_of(s, raw).alias("claim_type"),
        T.is_segment(s, h).alias("is_segment"),
        T.classify_time(s, F.col("time_period"), this_year).alias("time"),
    )
    out = out.select(*[c for c in out.columns if c != "time"], "time.*")
    said = F.regexp_extract("time_period", r"20[1-3]\d", 0)
    in_text = F.regexp_extract(s, r"(?i)(?:fiscal\s+(?:year\s+)?|FY\s*)?(20[1-3]\d)", 1)
    return out.select(
        "*",
        F.when(said != "", said).when(in_text != "", in_text).cast("long").alias("target_year"),
        F.coalesce(
            F.regexp_extract("time_period", r"(?i)Q([1-4])", 1).try_cast("long"),
            F.regexp_extract(s, r"(?i)Q([1-4])", 1).try_cast("long"),
        ).alias("target_quarter"),
    )


def decompose_copies(claims: DataFrame, this_year: int) -> DataFrame:
    """decompose() of claims many of which are copies: one sentence, heading and raw number is taken apart once."""
    said = ("sentence", "heading", "raw")
    parts = decompose(spread(claims.select(*said).distinct(), *said), this_year)
    made = [c for c in parts.columns if c not in said]
    parts = parts.select(*[F.col(c).alias(f"_{c}") for c in said], *made)
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in said]
    return claims.join(parts.hint("merge"), same).select(*claims.columns, *made)


# -- entities ------------------------------------------------------------------------

# Forms of companies
SUFFIXES = (" INC", " CORP", " LTD", " LLC", " CO", " PLC", " HOLDINGS", " GROUP")


# Common nouns that titles hold, which therefore stand for no company on their own
COMMON_NOUNS = (
    "semiconductor", "semiconductors", "technology", "technologies",
    "industry", "industries", "company", "companies", "corporation",
    "corporations", "group", "groups", "holdings", "service",
    "services", "financial", "bank", "banks", "manufacturing",
    "partners", "partnership", "international", "global", "national",
    "regional", "investment", "investments", "capital", "fund",
    "funds", "trust", "ventures", "consulting", "solutions", "systems",
    "growth", "challenges", "outlook", "findings",
)
GRAM = 3


def _grams(text: Column, size: int) -> Column:
    """All stretches of a text of this length, once each."""
    last = F.length(text) - size + 1
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda k: F.substring(text, k, F.lit(size))))).otherwise(F.array().cast("array<string>"))


def parts_of_titles(names: DataFrame, companies: DataFrame) -> DataFrame:
    """names(name), in capitals → name, best (length of title, ticker): titles that hold the name or are held by it.

    A name is looked up by its rarest stretch of three signs, and a title by its own: only titles
    that share it are compared. A name with a stretch that no title has is done at once. The
    shortest title wins, then the ticker."""
    titles = companies.select(F.upper("ticker").alias("ticker"), F.upper("title").alias("title")).distinct()
    asked = names.where((F.length("name") >= GRAM) & (F.contains("name", F.lit(" ")) | ~F.lower("name").isin(*COMMON_NOUNS))).select("name").distinct()
    held = titles.select("ticker", "title", F.explode(_grams(F.col("title"), GRAM)).alias("gram"))
    counts = held.groupBy("gram").agg(F.count("*").alias("n"))
    own = asked.select("name", F.explode(_grams(F.col("name"), GRAM)).alias("gram")).join(counts.hint("merge"), "gram", "left")
    rarest = own.groupBy("name").agg(F.min(F.struct("n", "gram")).alias("r"), F.count_if(F.col("n").isNull()).alias("missing"))
    inside = rarest.where("missing = 0").select("name", F.col("r.gram").alias("gram")).join(held.hint("merge"), "gram").where(F.contains("title", F.col("name")))
    key = held.join(counts.hint("merge"), "gram").groupBy("ticker", "title").agg(F.min(F.struct("n", "gram"))["gram"].alias("gram"))
    short = titles.where((F.length("title") > 0) & (F.length("title") < GRAM)).select("ticker", "title", F.col("title").alias("gram"))
    stretches = F.concat(*[_grams(F.col("name"), k) for k in range(1, GRAM + 1)])
    around = asked.select("name", F.explode(stretches).alias("gram")).join(key.unionByName(short).hint("merge"), "gram").where(F.contains("name", F.col("title")))
    both = inside.select("name", "ticker", "title").unionByName(around.select("name", "ticker", "title"))
    return both.groupBy("name").agg(F.min(F.struct(F.length("title").alias("size"), F.col("ticker"))).alias("best"))


def resolve_entities(subjects: DataFrame, aliases: DataFrame, companies: DataFrame) -> DataFrame:
    """subjects(subject_id, subject) → + entity_type, canonical, reason.

    Here and below, what grows with the companies is joined by merging: by its size on disk Spark
    would take it for small enough to be held whole by the driver.

    aliases(alias, entity_type, canonical); companies(ticker, title).  Every tier is an
    equi-join on a normalised name; the first tier that hits wins.  All names of a company
    (ticker, title, title without suffix) go into one list of keys with a rank, so a single
    join answers all company tiers.  What is left is looked up as a part of a title."""
    aliases = aliases.groupBy("alias").agg(F.min(F.struct("entity_type", "canonical")).alias("_a")).select("alias", "_a.*")
    key = F.regexp_replace(F.btrim("subject"), r"""[.,;:!?"')]+$""", "")
    asked = subjects.select("*", F.lower(key).alias("_low"), F.upper(key).alias("_up"))
    titled = companies.select("ticker", F.upper("title").alias("title"))
    stems = [F.when(F.endswith("title", F.lit(x)), F.expr(f"left(title, length(title) - {len(x)})")) for x in SUFFIXES]
    names = titled.select(
        F.explode(
            F.filter(
                F.array(
                    F.struct(F.lit(1).alias("tier"), F.upper("ticker").alias("name")),
                    F.struct(F.lit(2).alias("tier"), F.col("title").alias("name")),
                    *[F.struct(F.lit(3 + i).alias("tier"), x.alias("name")) for i, x in enumerate(stems)],
                ),
                lambda n: n["name"].isNotNull(),
            )
        ).alias("n"),
        "ticker",
        "title",
    )
    best = names.groupBy(F.col("n.name").alias("_up")).agg(
        F.min(F.struct(F.col("n.tier"), F.length("title"), F.col("ticker"))).alias("_c")
    )
    out = asked.join(aliases.withColumnRenamed("alias", "_low"), "_low", "left").join(best.hint("merge"), "_up", "left")
    left = out.where(F.col("entity_type").isNull() & F.col("_c").isNull()).select(F.col("_up").alias("name"))
    part = parts_of_titles(left, companies).select(F.col("name").alias("_up"), F.col("best").alias("_p"))
    out = out.join(part.hint("merge"), "_up", "left").withColumn("_c", F.coalesce("_c.ticker", F.when(F.col("entity_type").isNull(), F.col("_p.ticker"))))
    return out.select(
        *subjects.columns,
        F.when(F.btrim("subject") == "", "unknown")
        .when(F.col("entity_type").isNotNull(), F.col("entity_type"))
        .when(F.col("_c").isNotNull(), "company")
        .otherwise("unknown")
        .alias("entity_type"),
        F.coalesce("canonical", "_c", F.btrim("subject")).alias("canonical"),
        F.when(F.btrim("subject") == "", "empty_subject")
        .when(F.col("entity_type").isNotNull(), F.concat("entity_type", F.lit("_alias")))
        .when(F.col("_c").isNotNull(), "company_resolved")
        .otherwise("no_rule_matched")
        .alias("reason"),
    )


# -- routes --------------------------------------------------------------------------

MAX_ROUTES = 3


def route_claims(claims: DataFrame, enabled: tuple[str, ...] = ("macro", "market", "physical")) -> DataFrame:
    """One row per claim and provider, at most three, in order of preference.

    Needs `entity_type`; `enabled` names the providers that have to be switched on."""
    s, metric, kind = F.lower("sentence"), F.col("metric"), F.col("entity_type")
    country = kind == "country"
    finance = s.rlike(FINANCE_WORDS)
    named = F.col("heading").rlike(r"\b[A-Z][A-Za-z]+\b")
    open_to_companies = ~F.col("is_segment") & ~kind.isin("country", "crypto_asset")
    on = lambda name: F.lit(name in enabled)
    wanted = F.array(
        F.lit("encyclopedia"),
        F.when(country & (metric.isin("gdp", "population", "lifespan") | s.rlike(COUNTRY_WORDS)), "indicators"),
        F.when(country & (metric.isin("population", "area") | s.rlike(PLACE_WORDS)), "countries"),
        F.when(kind == "crypto_asset", "crypto"),
        F.when(on("macro") & ((metric == "gdp") | s.rlike(MACRO_WORDS)), "macro"),
        F.when(
            open_to_companies & (finance | ((F.col("unit") == "currency") & named & (F.col("value") > 1e8))),
            "filings",
        ),
        F.when(on("market") & open_to_companies & (finance | ((F.col("unit") == "currency") & named)), "market"),
        F.when(
            on("physical")
            & (
                metric.isin("height", "weight", "length", "area")
                | F.col("unit").isin("distance", "mass")
                | s.rlike(PHYSICAL_WORDS)
            ),
            "physical",
        ),
    )
    picked = F.slice(F.array_compact(wanted), 1, MAX_ROUTES)
    return claims.select("*", F.posexplode_outer(picked).alias("route_no", "provider")).withColumn(
        "route_no", F.col("route_no").cast("long")
    )


# -- matches ---------------------------------------------------------------------------


def match_facts(routes: DataFrame, facts: DataFrame) -> DataFrame:
    """claim_evidence(claim_id, provider, match_type, difference, fact_value, confidence).

    Filings: the year asked for at any distance, else a year next to it within 5 %, and
    without a year the closest within 30 % (31 % from 2023 on); quarterly claims see only
    quarterly facts.  Others: the year asked for, else the newest of 2020-2025."""
    claim = routes.where(F.col("value") != 0).select(
        "claim_id", "provider", F.col("canonical").alias("entity"), "metric", F.col("value").alias("claimed"),
        "target_year", "target_quarter", F.col("period_type").alias("asked_period"),
    )
    joined = claim.join(facts.hint("merge"), ["provider", "entity", "metric"])
    diff = F.abs(F.col("value") - F.col("claimed")) / F.greatest(F.abs("claimed"), F.lit(1e-10))
    filing = F.col("provider") == "filings"
    asks_quarter = (F.col("asked_period") == "quarterly") | F.col("target_quarter").isNotNull()
    right_period = F.when(
        asks_quarter, (F.col("period_type") == "quarterly") & (F.col("quarter") == F.col("target_quarter"))
    ).otherwise(F.col("period_type") == "annual")
    gap = F.abs(F.col("year") - F.col("target_year"))
    filing_ok = right_period & (
        F.when(F.col("target_year").isNull(), diff < F.when(F.col("year") >= 2023, 0.31).otherwise(0.30))
        .when(gap == 0, F.lit(True))
        .otherwise((gap <= 1) & (diff < 0.05))
    )
    undated = F.col("year").isNull()
    other_ok = F.when(undated, F.col("asked_period") != "historical").otherwise(
        F.when(F.col("target_year").isNotNull(), gap == 0).otherwise(F.col("year").between(2020, 2025))
    )
    usable = joined.where((F.col("value") != 0) & F.when(filing, filing_ok).otherwise(other_ok))
    order = F.struct(
        F.when(filing, F.coalesce(gap, F.lit(0))).otherwise(-F.coalesce("year", F.lit(0))).alias("first"),
        diff.alias("diff"),
        (-F.coalesce("year", F.lit(0))).alias("newest"),
        F.col("value").alias("value"),
    )
    best = usable.groupBy("claim_id", "provider").agg(F.min(order).alias("m"))
    d = F.col("m.diff")
    kind = F.lit("no_data")
    for provider, (exact, close, contra) in BANDS.items():
        against = (
            F.lit("no_data")
            if contra is None
            else F.when(d < contra, "contradicted").otherwise("no_data")
        )
        kind = F.when(
            F.col("provider") == provider,
            F.when(d < exact, "exact").when(d < close, "close").otherwise(against),
        ).otherwise(kind)
    judged = best.select(
        "claim_id",
        "provider",
        kind.alias("match_type"),
        rounded(d, 4).alias("difference"),
        F.col("m.value").alias("fact_value"),
    )
    return judged.where(F.col("match_type") != "no_data").select(
        "*", F.when(F.col("match_type") == "exact", 0.95).otherwise(0.85).alias("confidence")
    )


# -- verdicts ----------------------------------------------------------------------------


def verdicts(claims: DataFrame, evidence: DataFrame) -> DataFrame:
    """claim_verdicts: one row per claim, with the four dimensions of confidence.

    Projections and claims without a value are never put to the vote."""
    authority = F.lit(OTHER_AUTHORITY)
    for provider, weight in AUTHORITY.items():
        authority = F.when(F.col("provider") == provider, F.lit(weight)).otherwise(authority)
    m = F.col("match_type")
    votes = evidence.groupBy("claim_id").agg(
        F.count_if(m == "exact").alias("n_exact"),
        F.count_if(m == "close").alias("n_close"),
        F.count_if(m == "contradicted").alias("n_contra"),
        F.max(F.when(m == "exact", F.col("confidence"))).alias("c_exact"),
        F.max(F.when(m == "close", F.col("confidence"))).alias("c_close"),
        F.max(F.when(m == "contradicted", F.col("confidence"))).alias("c_contra"),
        F.max("confidence").alias("best_confidence"),
        F.max(authority).alias("authority"),
        F.min(
            F.struct(
                F.when(m == "exact", 0).when(m == "close", 1).otherwise(2).alias("r"), F.col("provider").alias("p")
            )
        ).alias("_best"),
    )
    out = claims.join(votes.hint("merge"), "claim_id", "left")
    e, c, x = (F.coalesce(n, F.lit(0)) for n in ("n_exact", "n_close", "n_contra"))
    voted = (F.col("claim_type") != "projection") & (F.col("value") != 0)
    verdict = (
        F.when(F.col("claim_type") == "projection", "projection")
        .when(~voted, "unverifiable")
        .when((x > 0) & (e + c > 0), "disputed")
        .when(e > 0, "verified")
        .when(c > 0, "close")
        .when(x > 0, "contradicted")
        .otherwise("unverifiable")
    )
    confidence = (
        F.when(~voted, 0.0)
        .when((x > 0) & (e > 0), 0.6)
        .when((x > 0) & (c > 0), 0.5)
        .when(e >= 2, F.least(F.col("c_exact") + 0.05, F.lit(0.98)))
        .when(e > 0, F.col("c_exact"))
        .when(c > 0, F.col("c_close"))
        .when(x > 0, F.col("c_contra"))
        .otherwise(0.0)
    )
    backing = e + c
    return out.select(
        *claims.columns,
        verdict.alias("verdict"),
        rounded(confidence, 4).alias("confidence"),
        F.when(voted, F.col("_best.p")).alias("best_provider"),
        F.coalesce("authority", F.lit(0.0)).alias("authority"),
        F.when(e > 0, 1.0).when(c > 0, 0.7).otherwise(0.0).alias("precision"),
        F.coalesce("best_confidence", F.lit(0.0)).alias("context"),
        F.when(e + c + x == 0, 0.0)
        .when(backing >= 3, 1.0)
        .when(backing == 2, 0.8)
        .when(backing == 1, 0.5)
        .otherwise(0.2)
        .alias("corroboration"),
    )


# How a rate of growth is said, and by how many points it may miss
GROWTH = (
    r"(?i)(?:grew|growth|increase[ds]?|decline[ds]?|rose|fell|change[ds]?|up|down)\s+(?:by\s+|of\s+)?"
    r"(\d+(?:\.\d+)?)\s*%"
)
GROWTH_POINTS = 2.0


STEP = 1.05  # ratio of neighbouring buckets of values


def check_derivations(judged: DataFrame) -> DataFrame:
    """Growth claims are recomputed from the verified values under their heading of their document.

    A rate that no two distinct values yield is contradicted; a heading with fewer than
    two values decides nothing.  For a rate and an earlier value the later value has to
    lie in a small interval, so it is looked up by bucket: the work grows with rates times
    values of a heading, and no table of value pairs is built."""
    held = (
        judged.where(F.col("verdict").isin("verified", "close") & (F.col("heading") != "") & (F.col("value") > 0))
        .select("doc_id", "heading", F.col("value").alias("v"))
        .distinct()
    )
    rate = F.regexp_extract("sentence", GROWTH, 1).try_cast("double")
    growth = judged.where((F.col("claim_type") == "derived") & rate.isNotNull()).select(
        "claim_id", "doc_id", "heading", rate.alias("rate")
    )
    bucket = lambda x: F.floor(F.log(x) / F.log(F.lit(STEP)))
    reach = (
        growth.select("doc_id", "heading", "rate").distinct().join(held.hint("merge"), ["doc_id", "heading"])
        .select(
            "doc_id", "heading", "rate", F.col("v").alias("earlier"),
            (F.col("v") * (1 + (F.col("rate") - GROWTH_POINTS) / 100)).alias("low"),
            (F.col("v") * (1 + (F.col("rate") + GROWTH_POINTS) / 100)).alias("high"),
        )
        .withColumn("bucket", F.explode(F.sequence(bucket(F.col("low")), bucket(F.col("high")))))
    )
    later = held.select("doc_id", "heading", F.col("v").alias("later"), bucket(F.col("v")).alias("bucket"))
    actual = (F.col("later") - F.col("earlier")) / F.col("earlier") * 100
    fitting = (
        reach.join(later.hint("merge"), ["doc_id", "heading", "bucket"])
        .where((F.col("later") != F.col("earlier")) & (F.abs(actual - F.col("rate")) <= GROWTH_POINTS))
        .groupBy("doc_id", "heading", "rate")
        .agg(F.count("*").alias("n_fitting"))
    )
    sizes = held.groupBy("doc_id", "heading").agg(F.count("*").alias("n_values"))
    tested = (
        growth.join(sizes.hint("merge"), ["doc_id", "heading"]).join(fitting.hint("merge"), ["doc_id", "heading", "rate"], "left")
        .where((F.col("n_values") >= 2) & F.col("n_fitting").isNull())
        .select("claim_id", F.lit(True).alias("broken"))
    )
    broken = F.coalesce("broken", F.lit(False))
    return judged.join(tested.hint("merge"), "claim_id", "left").select(
        *[c for c in judged.columns if c not in ("verdict", "confidence")],
        F.when(broken, "contradicted").otherwise(F.col("verdict")).alias("verdict"),
        F.when(broken, 0.8).otherwise(F.col("confidence")).alias("confidence"),
    )


def verification_rollup(judged: DataFrame, key: str = "doc_id") -> DataFrame:
    v = F.col("verdict")
    return judged.groupBy(key).agg(
        F.count_if(~v.isin("projection", "unverifiable")).alias("checked"),
        F.count_if(v.isin("verified", "close")).alias("verified"),
        F.count_if(v == "contradicted").alias("contradicted"),
        F.count_if(v == "disputed").alias("disputed"),
        F.count_distinct(F.when(v.isin("verified", "close"), F.col("best_provider"))).alias("verified_providers"),
    )
