"""Documents beside their sources: which numbers, names, words and years are backed.

Input rows carry `text` and `source_text`.  What the source offers is pulled out
of it once per row (typed number forms, vocabulary, years), and everything in the
document is looked up there; nothing is shuffled after the two are paired."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import spans as S, text as T, vocabulary as V
from tessera.functions.scalar import count_known, count_where, find_all, first_of_each, has, let, mean, precision_label, rounded
from tessera.operators import claims as N
from tessera.operators.text_tables import with_plain_sentences

# -- named entities -----------------------------------------------------------------

# How names are introduced (rule, type, pattern, context before, after)
ENTITY_RULES = [
    ("PERSON", "PERSON",
     r"(?:(?:['s]\s+)|(?:according to\s+)|(?:by\s+)|(?:,\s+)|(?:—\s*)|(?:\.\s+))"
     r"([A-Z][a-z]{2,15}\s+(?:[A-Z]\.?\s+)?[A-Z][a-z]{2,15})", 20),
    ("ORG", "ORG",
     r"([A-Z][a-zA-Z]+(?:\s+[A-Z][a-zA-Z]+)*(?:\s+(?:Labs|Corp|Inc|Foundation|University"
     r"|Institute|Survey|Report|Association|Group|Research)))", 20),
    ("ATTRIBUTED", "ATTRIBUTED",
     r"(?:according to|per|cited by|reported by)\s+([A-Z][a-zA-Z]+(?:[\s/][A-Z]?[a-zA-Z]+){0,4})", 10),
    ("CITATION", "CITATION", r"\(([A-Z][a-zA-Z/]+(?:\s+[a-zA-Z]+)*)[,\s]+(\d{4})\)", 30),
    ("ORG_CAMEL", "ORG",
     r"(?<![\p{L}\p{N}_])([A-Z][a-z]+[A-Z][a-zA-Z]+)(?![\p{L}\p{N}_])", 20),
]
ENTITY_AFTER = 30
# Words that show a match is not a name
NOT_A_PERSON = ("source", "extends", "mechanism", "falsifier", "section")
NOT_ATTRIBUTED = ("source", "the", "this", "one")


def _entity_value(rule: str, pattern: str, raw: Column) -> Column:
    if rule == "CITATION":
        return F.concat_ws(" ", F.regexp_extract(raw, pattern, 1), F.regexp_extract(raw, pattern, 2))
    return T.strip(F.regexp_extract(raw, pattern, 1))


def _is_name(rule: str, value: Column) -> Column:
    low = F.lower(value)
    if rule == "PERSON":
        return ~F.greatest(*[F.contains(low, F.lit(w)) for w in NOT_A_PERSON])
    if rule == "ATTRIBUTED":
        return ~low.isin(list(NOT_ATTRIBUTED))
    if rule == "CITATION":
        return ~F.contains(low, F.lit("source"))
    return F.lit(True)


def with_entities(docs: DataFrame) -> DataFrame:
    """Add `entities`: first mention of every (rule, value), in order of rule and place."""
    keep = list(docs.columns)
    docs = docs.select(*keep, T.drop_headings_and_tables(F.col("text")).alias("_body"))

    def by_rule(rule: str, kind: str, pattern: str, ahead: int) -> Column:
        named = F.filter(
            F.transform(
                S.spans(F.col("_body"), pattern),
                lambda h: F.struct(
                    F.lit(rule).alias("rule"),
                    F.lit(kind).alias("type"),
                    _entity_value(rule, pattern, h["marker"]).alias("value"),
                    T.strip(
                        F.substring(
                            F.col("_body"),
                            F.greatest(h["start"] - ahead, F.lit(0)) + 1,
                            h["end"] + ENTITY_AFTER - F.greatest(h["start"] - ahead, F.lit(0)),
                        )
                    ).alias("context"),
                ),
            ),
            lambda e: _is_name(rule, e["value"]),
        )
        return first_of_each(named, lambda e: e["value"])

    return docs.select(*keep, F.concat(*[by_rule(*rule) for rule in ENTITY_RULES]).alias("entities"))


def entity_rows(docs: DataFrame) -> DataFrame:
    rows = with_entities(docs.select("doc_id", "text"))
    return (
        rows.select("doc_id", F.posexplode_outer("entities").alias("mention_no", "e"))
        .where(F.col("e").isNotNull())
        .select("doc_id", F.col("mention_no").cast("long"), "e.rule", "e.type", "e.value", "e.context")
    )


# -- what a source offers ---------------------------------------------------------------


def with_source_facts(docs: DataFrame) -> DataFrame:
    """Add the `src_*` columns.

    Number forms are kept as digit strings, so that a lookup is a comparison and
    no pattern has to be built from data."""
    source = F.col("source_text")
    keep = list(docs.columns)
    docs = docs.select(
        *keep,
        find_all(source, r"(?i)([\d.]+)\s*(?:%|percent)", 1).alias("src_percents"),
        find_all(source, r"\$([\d.,]+)", 1).alias("src_dollars"),
        find_all(source, r"([\d.]+)[xX]", 1).alias("src_multiples"),
        F.array_distinct(find_all(source, r"\d+")).alias("src_runs"),
        F.array_distinct(find_all(source, r"(?<!\d)(?=(\d+\.\d+))", 1)).alias("src_decimals"),
        F.array_distinct(find_all(source, r"(?<!\d)(?=(\d+(?:,\d+)+))", 1)).alias("src_grouped"),
        F.lower(source).alias("src_lower"),
        F.array_distinct(T.content_words(source)).alias("src_words"),
        F.array_distinct(
            F.transform(
                F.concat(find_all(source, V.YEAR, 1), find_all(source, V.FISCAL_YEAR, 1)),
                lambda y: y.cast("long"),
            )
        ).alias("src_years"),
        N.typed_numbers(source).alias("_src_all"),
    )
    values = F.transform(
        N.data_numbers(F.col("_src_all"), source), lambda n: n["value"].try_cast("double")
    )
    return docs.select(
        *[c for c in docs.columns if c != "_src_all"],
        F.array_distinct(F.filter(values, lambda v: v.isNotNull())).alias("src_numbers"),
    )


def grouped_digits(value: Column) -> Column:
    """2000 → 2,000; NULL for decimals and up to three digits."""
    return F.when(
        ~F.contains(value, F.lit(".")) & (F.length(value) > 3),
        F.format_number(value.try_cast("long"), 0),
    )


def in_source(number: Column) -> Column:
    """Does the number stand in the source, in the form its type asks for?"""
    value, kind = number["value"], number["type"]
    whole = F.substring_index(value, ".", 1)
    comma = grouped_digits(value)
    percent = F.exists(
        "src_percents", lambda s: F.endswith(s, value) | (F.contains(value, F.lit(".")) & F.endswith(s, whole))
    )
    dollar = F.exists(
        "src_dollars", lambda s: F.startswith(s, value) | F.coalesce(F.startswith(s, comma), F.lit(False))
    )
    multiple = F.exists("src_multiples", lambda s: F.endswith(s, value))
    # The grouped form of 0085 is 85: it has no comma, and stands among the runs.
    plain = (
        F.array_contains("src_runs", value)
        | F.array_contains("src_decimals", value)
        | F.coalesce(F.array_contains("src_runs", comma), F.lit(False))
    )
    grouped = F.exists(
        "src_grouped",
        lambda s: F.coalesce((s == comma) | F.startswith(s, F.concat(comma, F.lit(","))), F.lit(False)),
    )
    return (
        F.when(kind == "percentage", percent)
        .when(kind == "dollar", dollar)
        .when(kind == "multiplier", multiple)
        .otherwise(plain | grouped)
    )


LOOSE, TIGHT = 0.02, 0.01


def derivable(value: Column, numbers: Column) -> Column:
    """Is the value arithmetic of one or two source numbers?

    Nested `exists` stops at the first hit and builds no table of pairs, so a
    source with many numbers costs time only until something fits."""

    def near(made: Column, tolerance: float) -> Column:
        return F.when(F.abs(value) < 0.001, F.abs(made) < 0.001).otherwise(
            F.abs(made - value) / F.abs(value) < tolerance
        )

    def pair(a: Column, b: Column) -> Column:
        usable = (a != 0) & (b != 0)
        return (
            (usable & (near(F.try_divide(a, b) * 100, TIGHT) | near(F.try_divide(a, b), LOOSE) | near(a * b, TIGHT)))
            | near(a + b, LOOSE)
            | ((F.abs(a - b) > 0.001) & near(a - b, LOOSE))
            | ((a != b) & near(a - b, TIGHT))
            | ((a > 0) & (a <= 100) & near(a / 100 * b, TIGHT))
        )

    return F.exists(
        numbers,
        lambda a: near(a / 100, LOOSE)
        | near(a * 100, LOOSE)
        | F.exists(numbers, lambda b: F.coalesce(pair(a, b), F.lit(False))),
    )


def with_number_backing(docs: DataFrame) -> DataFrame:
    """Add `backed`: the document's data numbers with in_source and derivable."""
    docs = with_source_facts(N.with_numbers(docs))
    return docs.withColumn("backed", backed_numbers()).drop("all_numbers")


def backed_numbers() -> Column:
    """`numbers` beside the `src_*` columns → array<struct<value, type, in_source>>."""
    return F.transform(
        "numbers",
        lambda n: F.struct(
            n["value"].alias("value"), n["type"].alias("type"), in_source(n).alias("in_source")
        ),
    )


def number_rows(docs: DataFrame) -> DataFrame:
    """number_mentions(+in_source, derivable), one row per data number."""
    docs = with_number_backing(docs)
    rows = docs.select(
        "doc_id",
        "src_numbers",
        F.posexplode_outer("backed").alias("number_no", "n"),
    ).where(F.col("n").isNotNull())
    return rows.select(
        "doc_id",
        F.col("number_no").cast("long"),
        F.col("n.type").alias("type"),
        F.col("n.value").alias("value"),
        F.col("n.in_source").alias("in_source"),
        F.coalesce(derivable(F.col("n.value").try_cast("double"), F.col("src_numbers")), F.lit(False)).alias("derivable"),
    )


def add_source_fidelity(docs: DataFrame) -> DataFrame:
    """Needs `backed`."""
    docs = docs.select(
        "*",
        F.size("backed").cast("long").alias("checked"),
        count_where(F.col("backed"), lambda n: n["in_source"]).alias("verified"),
    )
    n = F.col("checked")
    return docs.select(
        "*",
        F.when(n > 0, rounded((n - F.col("verified")) / n, 3)).otherwise(F.lit(0.0)).alias("unsourced_rate"),
        precision_label(n, 10, 30).alias("fidelity_precision"),
    )


# -- entities, words, assertions ---------------------------------------------------------


def entity_in_source(value: Column) -> Column:
    words = F.filter(
        F.split(value, r"\s+"), lambda w: (F.length(w) > 3) & ~F.lower(w).isin(V.STOP_WORDS)
    )
    return F.contains(F.col("src_lower"), F.lower(value)) | let(
        words,
        lambda ws: (F.size(ws) > 0) & F.forall(ws, lambda w: F.contains(F.col("src_lower"), F.lower(w))),
    )


def backed_entity_rows(docs: DataFrame) -> DataFrame:
    docs = with_entities(docs).select("doc_id", F.lower("source_text").alias("src_lower"), "entities")
    rows = docs.select(
        "doc_id", "src_lower", F.posexplode_outer("entities").alias("mention_no", "e")
    ).where(F.col("e").isNotNull())
    return rows.select(
        "doc_id",
        F.col("mention_no").cast("long"),
        "e.rule",
        "e.value",
        entity_in_source(F.col("e.value")).alias("in_source"),
    )


def add_entity_provenance(docs: DataFrame) -> DataFrame:
    """Needs `src_lower`."""
    keep = list(docs.columns)
    docs = with_entities(docs)
    docs = docs.select(
        *keep,
        F.size("entities").cast("long").alias("total_entities"),
        count_where(F.col("entities"), lambda e: entity_in_source(e["value"])).alias("entities_in_source"),
    )
    n = F.col("total_entities")
    return docs.select(
        "*",
        F.when(n > 0, rounded((n - F.col("entities_in_source")) / n, 3)).otherwise(F.lit(0.0)).alias("unsourced_entity_rate"),
        precision_label(n, 5, 15).alias("entity_precision"),
    )


def with_sentence_facts(docs: DataFrame) -> DataFrame:
    """Add `facts`: one struct per plain sentence with all that grounding asks.

    Needs `plain` and the `src_*` columns."""
    keep = list(docs.columns)
    prepared = F.transform(
        "plain",
        lambda s: F.struct(
            s.alias("sentence"),
            T.content_words(s).alias("words"),
            F.when(
                s.rlike(r"\d"),
                F.transform(
                    N.data_numbers(N.typed_numbers(s), s),
                    lambda n: F.struct(
                        n["value"].alias("value"), n["raw"].alias("raw"), in_source(n).alias("in_source")
                    ),
                ),
            )
            .otherwise(F.array().cast("array<struct<value:string,raw:string,in_source:boolean>>"))
            .alias("numbers"),
        ),
    )
    docs = docs.select(*keep, prepared.alias("_prepared"))
    used = F.array_distinct(F.flatten(F.transform("_prepared", lambda p: p["words"])))
    docs = docs.select(*keep, "_prepared", F.array_intersect("src_words", used).alias("_common"))

    def finish(common_words: Column):
        return lambda p: F.struct(
            p["sentence"].alias("sentence"),
            p["numbers"].alias("numbers"),
            F.size(p["words"]).alias("n_words"),
            count_known(p["words"], F.array_intersect(p["words"], common_words)).alias("n_known"),
            F.size(F.array_distinct(p["words"])).alias("n_types"),
            F.size(F.array_intersect(p["words"], common_words)).alias("n_known_types"),
            has(p["sentence"], V.FIRM_ASSERTION).alias("firm"),
            F.exists(
                find_all(p["sentence"], r"[A-Z][a-z]+(?:\s+[A-Z][a-z]+)+"),
                lambda name: F.contains(F.col("src_lower"), F.lower(name)),
            ).alias("known_name"),
        )

    return docs.select(
        *keep, let(F.col("_common"), lambda c: F.transform("_prepared", finish(c))).alias("facts")
    )


def _overlap(f: Column) -> Column:
    return F.when(f["n_words"] > 0, f["n_known"] / f["n_words"])


def vocab_overlap_rows(docs: DataFrame) -> DataFrame:
    """Needs `facts`."""
    rows = docs.select("doc_id", F.posexplode_outer("facts").alias("sent_no", "f")).where(
        F.col("f.n_words") > 0
    )
    return rows.select(
        "doc_id",
        F.col("sent_no").cast("long"),
        F.col("f.n_words").cast("long").alias("n_words"),
        F.col("f.n_known").cast("long").alias("n_known"),
        rounded(_overlap(F.col("f")), 3).alias("overlap"),
    )


def add_vocabulary_proximity(docs: DataFrame) -> DataFrame:
    """Needs `facts`."""
    keep = list(docs.columns)
    shares = F.filter(F.transform("facts", _overlap), lambda x: x.isNotNull())
    docs = docs.select(*keep, shares.alias("_shares"), F.size("facts").alias("_sents"))
    ordered = F.sort_array("_shares")
    n = F.size("_shares")
    median = let(
        ordered,
        lambda o: (
            F.try_element_at(o, F.floor((n - 1) / 2).cast("int") + 1)
            + F.try_element_at(o, F.floor(n / 2).cast("int") + 1)
        )
        / 2.0,
    )
    return docs.select(
        *keep,
        F.when(n > 0, F.col("_sents")).otherwise(0).cast("long").alias("proximity_sentences"),
        F.coalesce(rounded(mean(F.col("_shares")), 3), F.lit(0.0)).alias("mean_proximity"),
        F.when(n > 0, rounded(median, 3)).alias("median_proximity"),
        count_where(F.col("_shares"), lambda x: x < 0.5).alias("low_proximity_count"),
        F.when(n > 0, rounded(count_where(F.col("_shares"), lambda x: x < 0.5) / F.col("_sents"), 3)).alias(
            "low_proximity_rate"
        ),
    )


def is_grounded(f: Column) -> Column:
    return (
        F.exists(f["numbers"], lambda n: n["in_source"])
        | f["known_name"]
        | F.coalesce(_overlap(f) > 0.5, F.lit(False))
    )


def assertion_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode_outer("facts").alias("sent_no", "f")).where(F.col("f.firm"))
    return rows.select(
        "doc_id",
        F.col("sent_no").cast("long"),
        F.exists(F.col("f")["numbers"], lambda n: n["in_source"]).alias("sourced_number"),
        F.col("f.known_name").alias("sourced_name"),
        F.coalesce(_overlap(F.col("f")) > 0.5, F.lit(False)).alias("close_words"),
        is_grounded(F.col("f")).alias("grounded"),
    )


def add_epistemic_calibration(docs: DataFrame) -> DataFrame:
    firm = F.filter("facts", lambda f: f["firm"])
    docs = docs.select(
        "*",
        F.size(firm).cast("long").alias("total_assertions"),
        count_where(firm, is_grounded).alias("grounded_assertions"),
    )
    n = F.col("total_assertions")
    return docs.select(
        "*",
        F.when(n > 0, rounded(F.col("grounded_assertions") / n, 3)).alias("calibration_score"),
        F.when(n > 0, rounded((n - F.col("grounded_assertions")) / n, 3)).alias("overclaiming_rate"),
        precision_label(n, 5, 15).alias("calibration_precision"),
    )


# -- grounded, framed, projected ---------------------------------------------------------


def with_labels(docs: DataFrame) -> DataFrame:
    """Add `labels`: G, F, P or SKIP for every plain sentence, with the reason.  Needs `facts`."""
    keep = list(docs.columns)

    def judged(f: Column) -> Column:
        s = f["sentence"]
        left = F.filter(
            f["numbers"],
            lambda n: ~n["in_source"]
            & ~F.coalesce(derivable(n["value"].try_cast("double"), F.col("src_numbers")), F.lit(False)),
        )
        years = F.array_except(
            F.transform(
                F.concat(find_all(s, V.YEAR, 1), find_all(s, V.FISCAL_YEAR, 1)), lambda y: y.cast("long")
            ),
            "src_years",
        )
        return F.struct(
            f["n_types"].alias("n_types"),
            f["n_known_types"].alias("n_known_types"),
            F.length(T.strip(F.regexp_replace(s, r"[#*|_\-]", ""))).alias("length"),
            F.size(f["numbers"]).alias("n_numbers"),
            F.size(left).alias("n_open"),
            F.size(F.filter(left, lambda n: ~trivial(n, s))).alias("n_unsourced"),
            has(s, V.EXTERNAL_NAME).alias("external"),
            (F.size(years) > 0).alias("new_year"),
        )

    docs = docs.select(*keep, F.transform("facts", judged).alias("_j"))

    def label(j: Column) -> Column:
        unsourced = j["n_unsourced"] > 0
        new_year = j["new_year"] & (unsourced | (j["length"] > 50))
        reason = F.concat_ws(
            "+",
            F.when(unsourced, "unsourced_numbers"),
            F.when(j["external"], "external_entities"),
            F.when(new_year, "unsourced_years"),
        )
        backed = (j["n_numbers"] - j["n_open"]) > 0
        overlap = F.when(j["n_types"] > 0, j["n_known_types"] / j["n_types"]).otherwise(F.lit(0.0))
        score = (
            F.when(backed, F.lit(0.5)).otherwise(F.lit(0.0))
            + overlap * 0.3
            + F.when(backed & ~unsourced, F.lit(0.2)).otherwise(F.lit(0.0))
        )
        return F.struct(
            F.when(j["length"] < 20, "SKIP")
            .when(unsourced | j["external"] | new_year, "P")
            .when(score >= 0.4, "G")
            .otherwise("F")
            .alias("label"),
            F.when((j["length"] >= 20) & (unsourced | j["external"] | new_year), reason).alias("reason"),
        )

    return docs.select(*keep, F.transform("_j", label).alias("labels"))


def trivial(number: Column, sentence: Column) -> Column:
    """A whole number from 1 to 10, or the start of a range."""
    value = number["value"].try_cast("double")
    small = (value == F.rint(value)) & value.between(1, 10)
    # only the few numbers nothing else explains get here, so a pattern built from data is fine
    opens_range = F.regexp(
        sentence, F.concat(F.lit(r"\b\Q"), number["raw"], F.lit(r"\E\s*[-]\s*\d+\b"))
    )
    return F.coalesce(small, F.lit(False)) | opens_range


def label_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode_outer("labels").alias("sent_no", "l")).where(F.col("l").isNotNull())
    return rows.select("doc_id", F.col("sent_no").cast("long"), "l.label", "l.reason")


DIAGNOSTIC_BELOW, TRANSITION_BELOW = 10, 15


def add_grounding_mix(docs: DataFrame) -> DataFrame:
    """Needs `labels` and `src_numbers`."""
    names = F.transform("labels", lambda x: x["label"])
    docs = docs.select(
        "*",
        *[
            F.size(F.filter(names, lambda x: x == F.lit("G"))).cast("long").alias("n_grounded"),
            F.size(F.filter(names, lambda x: x == F.lit("F"))).cast("long").alias("n_framed"),
            F.size(F.filter(names, lambda x: x == F.lit("P"))).cast("long").alias("n_projected"),
            F.size(F.filter(names, lambda x: x == F.lit("SKIP"))).cast("long").alias("n_skipped"),
        ],
        F.size("src_numbers").cast("long").alias("source_numbers"),
    )
    n = F.col("n_grounded") + F.col("n_framed") + F.col("n_projected")
    return docs.select(
        "*",
        *[
            F.when(n > 0, rounded(F.col(f"n_{k}") / n, 3)).otherwise(F.lit(0.0)).alias(f"{k}_share")
            for k in ("grounded", "framed", "projected")
        ],
        F.when(F.col("source_numbers") < DIAGNOSTIC_BELOW, "diagnostic")
        .when(F.col("source_numbers") < TRANSITION_BELOW, "transition")
        .otherwise("saturated")
        .alias("derivation_regime"),
    )


def unsourced_year_rows(docs: DataFrame) -> DataFrame:
    """Years of the document that the source does not name."""
    found = lambda c: F.array_distinct(
        F.transform(
            F.concat(find_all(F.col(c), V.YEAR, 1), find_all(F.col(c), V.FISCAL_YEAR, 1)),
            lambda y: y.cast("long"),
        )
    )
    return (
        docs.select("doc_id", F.explode_outer(F.array_except(found("text"), found("source_text"))).alias("year"))
        .where(F.col("year").isNotNull())
    )


# -- substance against presentation --------------------------------------------------------


def add_quality(docs: DataFrame) -> DataFrame:
    """Needs fidelity, entity, calibration and presentation columns; `instability_rate`
    and `instability_precision` may be NULL."""
    keep = list(docs.columns)

    def unless_low(score: Column, precision: str) -> Column:
        return F.when(F.col(precision) != "low", score)

    substance = F.array_compact(
        F.array(
            unless_low(1 - F.col("unsourced_rate"), "fidelity_precision"),
            unless_low(1 - F.col("unsourced_entity_rate"), "entity_precision"),
            unless_low(F.col("calibration_score"), "calibration_precision"),
        )
    )
    surface = F.array_compact(
        F.array(
            F.col("assertiveness_ratio"),
            F.least(F.col("formatting_density") / 3, F.lit(1.0)),
            F.col("type_token_ratio"),
        )
    )
    docs = docs.select(*keep, substance.alias("_sub"), surface.alias("_pre"))
    docs = docs.select(
        *keep, mean(F.col("_sub")).alias("_s"), mean(F.col("_pre")).alias("_p"),
        F.size("_sub").cast("long").alias("n_substance"), F.size("_pre").cast("long").alias("n_presentation"),
    )
    gap = F.col("_p") - F.col("_s")
    return docs.select(
        *keep,
        rounded(F.col("_s"), 3).alias("substance_index"),
        rounded(F.col("_p"), 3).alias("presentation_index"),
        rounded(gap, 3).alias("quality_gap"),
        F.when(gap > 0.1, "overclaiming")
        .when(gap < -0.1, "understated")
        .when(gap.isNotNull(), "balanced")
        .otherwise("insufficient_data")
        .alias("gap_direction"),
        "n_substance",
        "n_presentation",
    )


def with_facts(docs: DataFrame) -> DataFrame:
    """documents(+source_text) → everything grounding needs, in one narrow pass."""
    return with_sentence_facts(with_source_facts(with_plain_sentences(docs)))
