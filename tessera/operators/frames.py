"""Named frames, absences, patterns and readiness over the signal row.

The catalogue is small and fixed, so its rows become expressions at plan time:
firing, absence, ranking and clustering are row-wise over `doc_signals`, and a
long table is exploded only where the result is one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions import vocabulary as V
from tessera.functions.scalar import count_where, has, rounded
from tessera.operators.framing import CLASSES
from tessera.sources import catalog as K

ENOUGH_SENTENCES = 5
CLUSTER_WORDS = 100


def _covered(c: str) -> Column:
    return F.col(f"cov_{c}_covered")


# -- firing rules ---------------------------------------------------------------


def add_frames(signals: DataFrame, user_rules: list[tuple[str, str, str, float]] | None = None) -> DataFrame:
    """Add `frames`, array<struct<rule_no, fvs_id, kind, priority>>, in order of the rules.

    `user_rules` are (id, signal column, operator, threshold) rows that are
    evaluated after the built-in rules."""
    moving = _covered("trends") | _covered("causes")
    engaged = ~F.col("voice").isin("descriptive", "insufficient")
    growth = moving & ~_covered("risks") & engaged & has(F.col("text"), V.GROWTH_CONTENT)
    positive = F.array_compact(
        F.array(
            *[F.when(_covered(c) & (F.col(f"cov_{c}_density") > 0), F.col(f"cov_{c}_density")) for c in CLASSES]
        )
    )
    skewed = (
        (F.col("coverage_count") >= 4)
        & (F.size(positive) >= 2)
        & (F.try_divide(F.array_max(positive), F.array_min(positive)) > 3)
    )
    risks, people, doubt = (F.col(f"cov_{c}_density") for c in ("risks", "stakeholders", "uncertainty"))
    past, future, sourced = F.col("past_pct"), F.col("future_pct"), F.col("sourced_pct")
    nothing = F.lit(0.0)
    rules = [
        ("FVS-008", "present", growth, nothing),
        ("FVS-002", "present", (F.col("voice") == "promotional") & (sourced < 30), nothing),
        ("FVS-010", "present", skewed, nothing),
        ("FVS-007", "absence", ~_covered("risks") & ~_covered("uncertainty") & (100 - sourced > 60), nothing),
        (
            "FVS-015",
            "present",
            moving & ~_covered("stakeholders") & ~_covered("uncertainty") & engaged & ~growth,
            nothing,
        ),
        (
            "FVS-009",
            "present",
            _covered("risks") & (risks > 5) & _covered("uncertainty") & (F.col("voice") == "analytical"),
            risks,
        ),
        (
            "FVS-011",
            "present",
            _covered("stakeholders") & (people > 5) & F.col("voice").isin("analytical", "advisory"),
            people,
        ),
        ("FVS-012", "present", _covered("uncertainty") & (doubt > 3), doubt),
        ("FVS-014", "present_past", past >= 70, nothing),
        ("FVS-014", "present_future", (past < 70) & (future >= 60), nothing),
        ("FVS-016", "present", sourced >= 50, nothing),
    ]
    compare = {
        ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b,
        "<=": lambda a, b: a <= b, "=": lambda a, b: a == b,
    }
    for fvs_id, signal, operator, threshold in user_rules or []:
        rules.append((fvs_id, "present", compare[operator](F.col(signal), F.lit(threshold)), nothing))
    made = [
        F.when(
            test,
            F.struct(
                F.lit(i).cast("long").alias("rule_no"),
                F.lit(fvs).alias("fvs_id"),
                F.lit(kind).alias("kind"),
                (F.lit(2.0 if kind == "absence" else 1.0) + bonus * 0.1).alias("priority"),
            ),
        )
        for i, (fvs, kind, test, bonus) in enumerate(rules)
    ]
    fired = F.when(F.col("n_sentences") >= ENOUGH_SENTENCES, F.array_compact(F.array(*made))).otherwise(
        F.array_compact(F.array(F.when(F.lit(False), made[0])))
    )
    return signals.select("*", fired.alias("frames"))


CITATION_MIN_SOURCED, CITATION_MIN_CHECKED, CITATION_MAX_RATIO = 30, 3, 0.5


def add_citation_gap(docs: DataFrame) -> DataFrame:
    """`citation_gap`: much is attributed, yet most checked numbers fail."""
    gap = (
        (F.col("checked") >= CITATION_MIN_CHECKED)
        & (F.col("sourced_pct") >= CITATION_MIN_SOURCED)
        & (F.try_divide(F.col("verified"), F.col("checked")) <= CITATION_MAX_RATIO)
    )
    return docs.select("*", F.coalesce(gap, F.lit(False)).alias("citation_gap"))


def fired_ids(docs_frames: str = "frames") -> Column:
    return F.array_distinct(F.transform(docs_frames, lambda f: f["fvs_id"]))


def frame_rows(docs: DataFrame) -> DataFrame:
    """doc_frames(doc_id, rule_no, fvs_id, kind, priority, rank): best first, ties by rule."""
    order = F.array_sort(
        F.transform(
            "frames",
            lambda f: F.struct(
                (-f["priority"]).alias("p"), f["rule_no"].alias("rule_no"), f["fvs_id"].alias("fvs_id"),
                f["kind"].alias("kind"), f["priority"].alias("priority"),
            ),
        )
    )
    rows = docs.select("doc_id", F.posexplode_outer(order).alias("pos", "f")).where(F.col("f").isNotNull())
    return rows.select(
        "doc_id", "f.rule_no", "f.fvs_id", "f.kind", "f.priority", (F.col("pos") + 1).cast("long").alias("rank")
    )


# -- absences ---------------------------------------------------------------------


def add_absences(docs: DataFrame, goal: str | None = None) -> DataFrame:
    """Add `absences`, the active frames that did not fire, best first.

    Order: tier, priority for the reader's goal, priority for the genre, id."""
    docs = docs.select("*", fired_ids().alias("fired"))
    records = []
    for fvs in K.ACTIVE:
        dims = K.dimensions_of(fvs)
        if len(dims) >= 2 and "coverage" in dims:
            tier = F.when(F.size("missing") > 0, F.lit(0)).otherwise(F.lit(1))
        else:
            tier = F.lit(1 if dims else 2)
        goal_list = K.GOAL_PRIORITY.get(goal or "", ())
        goal_rank = F.lit(goal_list.index(fvs) + 1 if fvs in goal_list else 999)
        genre_rank = F.lit(999)
        for genre, members in K.GENRE_PRIORITY.items():
            if fvs in members:
                genre_rank = F.when(F.col("genre") == genre, members.index(fvs) + 1).otherwise(genre_rank)
        records.append(
            F.when(
                ~F.array_contains("fired", fvs),
                F.struct(
                    tier.alias("tier"), goal_rank.alias("goal_rank"), genre_rank.alias("genre_rank"),
                    F.lit(fvs).alias("fvs_id"),
                ),
            )
        )
    return docs.select("*", F.array_sort(F.array_compact(F.array(*records))).alias("absences"))


TIERS = ("high", "medium", "low")


def tier_name(tier: Column) -> Column:
    return F.when(tier == 0, TIERS[0]).when(tier == 1, TIERS[1]).otherwise(TIERS[2])


BUDGETS = {"minimal": (3, 1, 1), "standard": (5, None, None), "full": (None, None, None)}


def absence_rows(docs: DataFrame, budget: str = "full") -> DataFrame:
    """absent_frames(doc_id, fvs_id, tier, goal_rank, genre_rank, rank, total)."""
    k = BUDGETS[budget][0]
    kept = F.col("absences") if k is None else F.slice("absences", 1, k)
    rows = docs.select(
        "doc_id", F.size("absences").cast("long").alias("total"), F.posexplode_outer(kept).alias("pos", "a")
    ).where(F.col("a").isNotNull())
    return rows.select(
        "doc_id",
        "a.fvs_id",
        tier_name(F.col("a.tier")).alias("tier"),
        F.col("a.goal_rank").cast("long").alias("goal_rank"),
        F.col("a.genre_rank").cast("long").alias("genre_rank"),
        (F.col("pos") + 1).cast("long").alias("rank"),
        "total",
    )


def absence_dimension_rows(docs: DataFrame) -> DataFrame:
    """Absent frames beside the dimensions they speak for (`none` if there is none)."""
    spoken = F.lit(None).cast("array<string>")
    for fvs in K.ACTIVE:
        dims = K.dimensions_of(fvs) or ["none"]
        spoken = F.when(F.col("fvs_id") == fvs, F.array(*[F.lit(d) for d in dims])).otherwise(spoken)
    return absence_rows(docs).select("doc_id", "fvs_id", "tier", F.explode(spoken).alias("dimension"))


def add_clusters(docs: DataFrame) -> DataFrame:
    """Add `clusters`: dimensions that miss two or more, and at least half, of their frames."""
    made = []
    for dim, members in K.DIMENSION_FRAMES.items():
        absent = F.filter("absences", _in(members))
        n = F.size(absent)
        share = n / F.lit(float(len(members)))
        made.append(
            F.when(
                (n >= 2) & (share >= 0.5),
                F.struct(
                    F.array_min(F.transform(absent, lambda a: a["tier"])).alias("tier"),
                    (-rounded(share, 2)).alias("neg_share"),
                    F.lit(dim).alias("dimension"),
                    n.cast("long").alias("member_count"),
                    F.lit(len(members)).cast("long").alias("canon_size"),
                    F.array_join(F.array_sort(F.transform(absent, lambda a: a["fvs_id"])), ",").alias("members"),
                ),
            )
        )
    gate = (F.col("spaced_words") >= CLUSTER_WORDS) & (F.size("frames") > 0) & (F.col("total_claims") > 0)
    return docs.select(
        "*", F.filter(F.array_sort(F.array_compact(F.array(*made))), lambda c: gate).alias("clusters")
    )


def _in(members):
    return lambda a: a["fvs_id"].isin(list(members))


def cluster_rows(docs: DataFrame) -> DataFrame:
    rows = docs.select("doc_id", F.posexplode_outer("clusters").alias("pos", "c")).where(F.col("c").isNotNull())
    return rows.select(
        "doc_id",
        "c.dimension",
        "c.members",
        "c.member_count",
        "c.canon_size",
        (-F.col("c.neg_share")).alias("share"),
        tier_name(F.col("c.tier")).alias("tier"),
        (F.col("pos") + 1).cast("long").alias("rank"),
    )


# -- patterns ---------------------------------------------------------------------


def shape_test(trigger: dict) -> Column:
    """The frame conditions of a pattern alone, against all frames that did not fire."""
    test = F.lit(True)
    for fvs in trigger.get("present_all", ()):
        test = test & F.array_contains("fired", fvs)
    for fvs in trigger.get("absent_all", ()):
        test = test & ~F.array_contains("fired", fvs)
    if "absent_any" in trigger:
        test = test & F.greatest(*[~F.array_contains("fired", f) for f in trigger["absent_any"]])
    return test


def pattern_test(trigger: dict, absent: Column) -> Column:
    """All conditions of one pattern.  A missing signal passes `max` tests only."""
    test = F.lit(True)
    if "genre" in trigger:
        test = test & F.coalesce(F.col("genre") == trigger["genre"], F.lit(False))
    for fvs in trigger.get("present_all", ()):
        test = test & F.array_contains("fired", fvs)
    for fvs in trigger.get("absent_all", ()):
        test = test & F.array_contains(absent, fvs)
    if "absent_any" in trigger:
        test = test & F.arrays_overlap(absent, F.array(*[F.lit(f) for f in trigger["absent_any"]]))
    for key, column in (
        ("falsification_max", "falsification_count"),
        ("sourced_pct_max", "sourced_pct"),
        ("role_count_max", "role_count"),
    ):
        if key in trigger:
            test = test & F.coalesce(F.col(column) <= trigger[key], F.lit(True))
    for key, column in (("role_count_min", "role_count"), ("projection_min", "projection_phrases")):
        if key in trigger:
            test = test & F.coalesce(F.col(column) >= trigger[key], F.lit(False))
    if "voice" in trigger:
        test = test & F.coalesce(F.col("voice") == trigger["voice"], F.lit(False))
    return test


def add_patterns(docs: DataFrame) -> DataFrame:
    docs = docs.select("*", F.transform("absences", lambda a: a["fvs_id"]).alias("_absent"))
    made = []
    for i, (pattern, trigger) in enumerate(K.PATTERNS):
        present = list(trigger.get("present_all", ()))
        required = list(trigger.get("absent_all", ()))
        optional = [F.lit(f) for f in trigger.get("absent_any", ())]
        made.append(
            F.when(
                pattern_test(trigger, F.col("_absent")),
                F.struct(
                    F.lit(i).cast("long").alias("pattern_no"),
                    F.lit(pattern).alias("pattern"),
                    F.lit(",".join(sorted(present))).alias("frames_present"),
                    F.lit(",".join(sorted(required))).alias("frames_absent"),
                    (
                        F.array_join(F.array_sort(F.array_intersect(F.array(*optional), "_absent")), ",")
                        if optional
                        else F.lit("")
                    ).alias("frames_absent_optional"),
                ),
            )
        )
    return docs.select("*", F.array_compact(F.array(*made)).alias("patterns")).drop("_absent")


def pattern_rows(docs: DataFrame) -> DataFrame:
    return (
        docs.select("doc_id", F.explode_outer("patterns").alias("p"))
        .where(F.col("p").isNotNull())
        .select("doc_id", "p.*")
    )


# -- readiness --------------------------------------------------------------------


def readiness_rows(docs: DataFrame) -> DataFrame:
    """readiness(doc_id, dimension, value, secondary, companion, fired): five rows per document.

    `companion` is the count that stands behind the value (claims, checks, …)."""
    d = "double"
    fired = F.array_union(
        F.col("fired"), F.when(F.col("citation_gap"), F.array(F.lit("FVS-016"))).otherwise(F.array().cast("array<string>"))
    )
    docs = docs.select("*", fired.alias("_fired"))
    claims = F.col("total_claims")
    engages = ~F.array_contains("fired", "FVS-007") & (_covered("risks") | _covered("uncertainty"))
    values = {
        "coverage": (F.col("coverage_count").cast(d), F.col("coverage_balance"), F.col("coverage_count")),
        "calibration": (
            F.when(claims > 0, F.col("hedged_count") / claims),
            F.col("prediction_count").cast(d),
            claims,
        ),
        "evidence": (
            F.when(F.col("checked") > 0, F.col("verified") / F.col("checked")),
            F.col("sourced_pct").cast(d),
            F.col("checked"),
        ),
        "robustness": (
            (F.col("contradicted") + F.col("disputed")).cast(d),
            F.col("checked").cast(d),
            F.col("checked"),
        ),
        "counterfactual": (engages.cast("int").cast(d), F.lit(None).cast(d), F.lit(0).cast("long")),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(dim).alias("dimension"),
                value.alias("value"),
                second.alias("secondary"),
                companion.cast("long").alias("companion"),
                F.array_join(
                    F.array_sort(
                        F.array_intersect(F.array(*[F.lit(f) for f in K.DIMENSION_FRAMES[dim]]), "_fired")
                    ),
                    ",",
                ).alias("fired"),
            )
            for dim, (value, second, companion) in values.items()
        ]
    )
    return docs.select("doc_id", F.explode(rows).alias("r")).select("doc_id", "r.*")


# -- findings ---------------------------------------------------------------------


def _share_over(part: Column, whole: Column, limit: float) -> Column:
    return (whole >= 5) & (F.try_divide(part, whole) > limit)


def _skew() -> Column:
    """The densest covered perspective is over 2 and over three times the thinnest."""
    densities = F.array_compact(F.array(*[F.when(_covered(c), F.col(f"cov_{c}_density")) for c in CLASSES]))
    low, high = F.array_min(densities), F.array_max(densities)
    return F.coalesce((F.size(densities) >= 2) & (high > 2) & (low > 0) & (high > low * 3), F.lit(False))


def add_headline(docs: DataFrame) -> DataFrame:
    """`headline`: code of the first true finding, by priority."""
    v, n_missing = F.col("voice"), F.size("missing")
    bare = F.col("unsupported_numeric")
    code = (
        F.when((v == "promotional") & (bare >= 2), "promotional_unsourced")
        .when((v == "prescriptive") & (n_missing >= 2), "prescriptive_gaps")
        .when((bare >= 3) & (F.col("sourced") == 0), "numbers_unsourced")
        .when((v == "descriptive") & (n_missing >= 3), "reference_gaps")
        .when((n_missing > 0) & (F.col("coverage_count") >= 3) & (n_missing <= 2), "broad_with_gaps")
        .when(n_missing > 0, "gaps")
        .when(_skew(), "skewed_emphasis")
        .when(_share_over(F.col("unhedged_count"), F.col("total_claims"), 0.8), "all_stated_as_fact")
        .when(F.col("contradicted") > 0, "contradicted")
    )
    return docs.select("*", code.alias("headline"))


def add_findings(docs: DataFrame) -> DataFrame:
    """`findings`: codes of all portrait findings, in order."""
    v, missing, n_missing = F.col("voice"), F.col("missing"), F.size("missing")
    numeric, bare, sourced = F.col("numeric_sentences"), F.col("unsupported_numeric"), F.col("sourced")
    sourced_pct, covered = F.col("sourced_pct"), F.col("coverage_count")
    as_fact = _share_over(F.col("unhedged_count"), F.col("total_claims"), 0.8)
    voice_code = (
        F.when(v == "promotional", F.when(F.col("we_pct") >= 20, "voice_promotional_we").otherwise("voice_promotional_tone"))
        .otherwise(F.concat(F.lit("voice_"), v))
    )
    contradiction = F.when(F.col("contradicted") > 0, "contradicted")
    sourcing = (
        F.when(
            (numeric > 0) & (bare == numeric) & (sourced == 0),
            F.when(v == "descriptive", "numbers_as_knowledge")
            .when(as_fact, "numbers_unsourced_as_fact")
            .otherwise("numbers_unsourced"),
        )
        .when(
            (numeric > 0) & (sourced > 0),
            F.when(sourced_pct >= 70, "mostly_attributed").otherwise("partly_attributed"),
        )
        .when(as_fact, "claims_as_fact")
    )
    gaps = (
        F.when(n_missing == 0, F.when(_skew(), "complete_skewed").otherwise("complete"))
        .when((v == "descriptive") & (n_missing >= 3), "reference_low_coverage")
        .when((v == "prescriptive") & (n_missing >= 2), "directs_without")
        .when((v == "promotional") & (n_missing >= 2), "asserts_without")
        .when(n_missing >= 3, "low_coverage")
        .when((n_missing <= 2) & (covered >= 3), "covers_most")
        .otherwise("some_gaps")
    )
    position = (
        F.when(
            (n_missing == 0) & (v == "analytical"),
            F.when(sourced_pct >= 70, "reader_evaluates").when(bare > 0, "verify_before_acting"),
        )
        .when((v == "descriptive") & (n_missing >= 3), "reader_looks_up")
        .when((v == "prescriptive") & (bare > 2) & (n_missing >= 2), "reader_executes")
        .when((v == "promotional") & (bare > 2), "reader_buys")
        .when((v == "analytical") & (sourced_pct >= 70) & (n_missing <= 1), "reader_evaluates")
        .when(n_missing >= 3, "narrow_coverage")
    )
    dismissals = [
        F.when(F.array_contains(missing, c) & (F.col(f"cov_{c}_dismissed") >= 2), f"dismisses_{c}")
        for c in V.DISMISSIBLE
    ]
    codes = F.array_compact(F.array(voice_code, contradiction, sourcing, gaps, *dismissals, position))
    return docs.select(
        "*", F.when(F.col("n_sentences") == 0, F.array(F.lit("insufficient"))).otherwise(codes).alias("findings")
    )


def add_next_actions(docs: DataFrame) -> DataFrame:
    """`actions`: up to four next steps, in order."""
    top = F.when(F.size("absences") > 0, F.concat(F.lit("read:"), F.col("absences")[0]["fvs_id"]))
    hedge = F.when(
        (F.col("total_claims") >= 5)
        & (F.try_divide(F.col("unhedged_count"), F.col("total_claims")) >= 0.5),
        "ask_for_confidence",
    )
    source = F.when((F.col("total_sentences") >= 5) & (F.col("sourced_pct") < 10), "ask_for_sources")
    return docs.select(
        "*",
        F.slice(F.array_compact(F.array(top, hedge, source, F.lit("follow_up"))), 1, 4).alias("actions"),
    )


#: Contradicted claims that the takeaways of a document name.
MOST_CONTRADICTED = 5


def takeaway_rows(docs: DataFrame, top: int = 3) -> DataFrame:
    """takeaways(doc_id, section, position, item, question): leading frames, then missing perspectives with the code of what to ask."""
    both = F.array(
        F.struct(
            F.lit("frame").alias("section"),
            F.transform(F.slice("frames", 1, top), lambda f: f["fvs_id"]).alias("items"),
        ),
        F.struct(F.lit("missing").alias("section"), F.col("missing").alias("items")),
    )
    rows = (
        docs.select("doc_id", F.explode(both).alias("b"))
        .select("doc_id", F.col("b.section").alias("section"), F.posexplode_outer("b.items").alias("position", "item"))
        .where(F.col("item").isNotNull())
    )
    return rows.select(
        "doc_id",
        "section",
        F.col("position").cast("long").alias("position"),
        "item",
        F.when(F.col("section") == "missing", F.concat(F.lit("ask_about_"), F.col("item"))).alias("question"),
    )


def contradicted_rows(judged: DataFrame, top: int = MOST_CONTRADICTED) -> DataFrame:
    """The first contradicted claims of each document as takeaways; the item is the number of the claim."""
    order = Window.partitionBy("doc_id").orderBy("claim_no")
    rows = judged.where(F.col("verdict") == "contradicted").withColumn("position", (F.row_number().over(order) - 1).cast("long")).where(F.col("position") < top)
    return rows.select("doc_id", F.lit("contradicted").alias("section"), "position", F.col("claim_no").cast("string").alias("item"), F.lit(None).cast("string").alias("question"))
