"""From documents to the corpus: prevalence, peers, raters, calibration, costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tessera.functions.scalar import rounded
from tessera.operators import frames as R, ranks
from tessera.operators.pairs import with_panel
from tessera.session import written
from tessera.sources import catalog as K, corpus as C

CANON = tuple(sorted({f for members in K.DIMENSION_FRAMES.values() for f in members} | set(K.ACTIVE)))
UNCLASSIFIED = "_unclassified"
LOW_N = 3


def with_total(counts: DataFrame, total: DataFrame) -> DataFrame:
    """Put a one-row total beside every row of a small table."""
    return counts.withColumn("_one", F.lit(1)).join(total.withColumn("_one", F.lit(1)), "_one").drop("_one")


# -- frames over the corpus -----------------------------------------------------------


def _fires(docs: DataFrame) -> DataFrame:
    """(fvs_id, genre, fires) for every frame of the canon: a fixed fan-out per document."""
    each = F.array(
        *[
            F.struct(F.lit(f).alias("fvs_id"), F.array_contains("fired", f).alias("fires"))
            for f in CANON
        ]
    )
    return docs.select(
        F.coalesce("genre", F.lit(UNCLASSIFIED)).alias("genre"), F.explode(each).alias("e")
    ).select("genre", "e.fvs_id", "e.fires")


def frame_prevalence(docs: DataFrame) -> DataFrame:
    """frame_stats(fvs_id, genre, n_docs, fires_in, absent_in, rate, low_n); genre NULL
    stands for the whole corpus.  Both levels come out of one pass."""
    rows = _fires(docs)
    stats = rows.groupingSets(
        [[F.col("fvs_id")], [F.col("fvs_id"), F.col("genre")]], F.col("fvs_id"), F.col("genre")
    ).agg(F.count("*").alias("n_docs"), F.count_if(F.col("fires")).alias("fires_in"))
    n = F.col("n_docs")
    return stats.select(
        "fvs_id",
        "genre",
        "n_docs",
        "fires_in",
        (n - F.col("fires_in")).alias("absent_in"),
        rounded(F.col("fires_in") / n, 3).alias("rate"),
        (n < LOW_N).alias("low_n"),
    )


def co_frames(docs: DataFrame, absent: bool = False, top: int = 3) -> DataFrame:
    """For each frame the frames that most often fire (or are absent) together with it.

    Pairs are taken within the catalogue's handful of frames per document and counted
    with partial aggregates; only (frame, frame) counts are shuffled."""
    canon = F.array(*[F.lit(f) for f in CANON])
    members = F.array_except(canon, F.col("fired")) if absent else F.col("fired")
    # every ordered pair within one document's set; the outer explode keeps the optimizer
    # from deriving a filter that would compute the whole signal row a second time
    ordered = F.flatten(
        F.transform(
            members,
            lambda a: F.transform(members, lambda b: F.struct(a.alias("fvs_id"), b.alias("other"))),
        )
    )
    pairs = docs.select(F.explode_outer(ordered).alias("p")).select("p.fvs_id", "p.other")
    counts = pairs.where(F.col("fvs_id") != F.col("other")).groupBy("fvs_id", "other").agg(F.count("*").alias("n"))
    w = Window.partitionBy("fvs_id").orderBy(F.desc("n"), "other")
    return counts.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top)


def pattern_prevalence(docs: DataFrame) -> DataFrame:
    """Corpus matches of each pattern's frame conditions, overall and inside its genre."""
    aggs = [F.count("*").alias("total")]
    for i, (_, trigger) in enumerate(K.PATTERNS):
        shape = R.shape_test(trigger)
        inside = F.coalesce(F.col("genre") == trigger.get("genre", ""), F.lit(False))
        aggs += [
            F.count_if(shape).alias(f"m{i}"),
            F.count_if(shape & inside).alias(f"g{i}"),
            F.count_if(inside).alias(f"t{i}"),
        ]
    rows = []
    for i, (name, trigger) in enumerate(K.PATTERNS):
        has_genre = "genre" in trigger
        none = F.lit(None).cast("long")
        rows.append(
            F.struct(
                F.lit(name).alias("pattern"),
                F.col(f"m{i}").alias("matches"),
                F.col("total"),
                rounded(F.col(f"m{i}") / F.col("total"), 3).alias("match_rate"),
                (F.col(f"g{i}") if has_genre else none).alias("matches_in_genre"),
                (F.col(f"t{i}") if has_genre else none).alias("genre_total"),
                (
                    F.when(F.col(f"t{i}") > 0, rounded(F.col(f"g{i}") / F.col(f"t{i}"), 3)).otherwise(F.lit(0.0))
                    if has_genre
                    else F.lit(None).cast("double")
                ).alias("genre_match_rate"),
            )
        )
    return docs.agg(*aggs).select(F.explode(F.array(*rows)).alias("p")).select("p.*")


def detector_empirics(docs: DataFrame) -> DataFrame:
    """firing_rates(kind, label, n, rate): how often each detector says what it says."""

    def entries(kind: str, labels: Column) -> Column:
        return F.transform(labels, lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("label")))

    one = lambda c: F.array(F.coalesce(F.col(c), F.lit(UNCLASSIFIED)))
    facts = F.concat(
        entries("document", F.array(F.lit("all"))),
        entries("frame", F.col("fired")),
        entries("perspective", F.col("covered")),
        entries("voice", one("voice")),
        entries("genre", one("genre")),
        entries("pattern", F.transform("patterns", lambda p: p["pattern"])),
        entries("cluster", F.transform("clusters", lambda c: c["dimension"])),
    )
    counts = (
        docs.select(F.explode_outer(facts).alias("f"))
        .select("f.kind", "f.label")
        .groupBy("kind", "label")
        .agg(F.count("*").alias("n"))
    )
    total = counts.where(F.col("kind") == "document").select(F.col("n").alias("n_docs"))
    return with_total(counts, total).select("kind", "label", "n", rounded(F.col("n") / F.col("n_docs"), 4).alias("rate"))


# -- peers -----------------------------------------------------------------------------


def peer_outliers(readiness: DataFrame) -> DataFrame:
    """Who lies farthest from the panel's median, per panel and dimension; ties all count."""
    rows = with_panel(readiness).withColumn("producer", C.producer_label(C.panel_slug(F.col("doc_id"))))
    w = Window.partitionBy("peer_group", "dimension")
    rows = rows.select(
        "peer_group", "dimension", "doc_id", "producer", "value", "fired",
        F.count("*").over(w).alias("members"),
        F.count("value").over(w).alias("valued"),
        F.max(F.coalesce("secondary", F.lit(0.0))).over(w).alias("_checked"),
        F.median("value").over(w).alias("_median"),
    ).where(F.col("members") >= 2)
    blocked = (
        (F.col("valued") < F.col("members"))
        | (F.col("members") < 3)
        | ((F.col("dimension") == "robustness") & (F.col("_checked") == 0))
    )
    rows = rows.withColumn("non_comparable", blocked)
    distance = F.when(~F.col("non_comparable"), F.abs(F.col("value") - F.col("_median")))
    rows = rows.withColumn("distance", distance)
    farthest = F.max("distance").over(w)
    return rows.select(
        "peer_group", "dimension", "doc_id", "producer", "value", "fired",
        F.when(~F.col("non_comparable"), F.col("_median")).alias("median"),
        "distance",
        "non_comparable",
        F.coalesce((farthest > 0) & (F.col("distance") == farthest), F.lit(False)).alias("is_outlier"),
    )


def outlier_counts(outliers: DataFrame) -> DataFrame:
    return outliers.groupBy("producer", "dimension").agg(
        F.count("*").alias("appearances"),
        F.count_if(F.col("is_outlier")).alias("outliers"),
        F.count_if(F.col("non_comparable")).alias("non_comparable"),
    )


def cross_group_findings(outliers: DataFrame, min_share: float = 1.0) -> DataFrame:
    """Producers that are the outlier in every comparable panel (two or more), with the
    frames that fired in those documents.  `min_share` below 1 asks for less than every."""
    counts = outlier_counts(outliers).withColumn("comparable", F.col("appearances") - F.col("non_comparable"))
    kept = counts.where((F.col("comparable") >= 2) & (F.col("outliers") >= F.col("comparable") * min_share))
    fired = (
        outliers.where(F.col("is_outlier"))
        .select("producer", "dimension", F.explode(F.filter(F.split("fired", ","), lambda f: f != "")).alias("fvs_id"))
        .groupBy("producer", "dimension", "fvs_id")
        .agg(F.count("*").alias("fired_in"))
    )
    return kept.join(fired, ["producer", "dimension"], "left").select(
        "producer", "dimension", "outliers", "comparable", "fvs_id", F.coalesce("fired_in", F.lit(0)).alias("fired_in")
    )


def peer_divergence(diffs: DataFrame) -> DataFrame:
    """divergence_rates(level, key, dimension, n_pairs, differs, non_comparable, agrees).

    `diffs` are profile diffs; a pair counts for the panel and for both producers."""
    label = lambda c: C.producer_label(C.panel_slug(F.col(c)))
    keys = F.array(
        F.struct(F.lit("all").alias("level"), F.lit("").alias("key")),
        F.struct(F.lit("group").alias("level"), F.col("peer_group").cast("string").alias("key")),
        F.struct(F.lit("producer").alias("level"), label("a_doc_id").alias("key")),
        F.struct(F.lit("producer").alias("level"), label("b_doc_id").alias("key")),
    )
    rows = diffs.select("dimension", "moved", "non_comparable", F.explode(keys).alias("k")).select(
        "k.level", "k.key", "dimension", "moved", "non_comparable"
    )
    off = F.col("non_comparable")
    return rows.groupBy("level", "key", "dimension").agg(
        F.count("*").alias("n_pairs"),
        F.count_if(~off & F.col("moved")).alias("differs"),
        F.count_if(off).alias("non_comparable"),
        F.count_if(~off & ~F.col("moved")).alias("agrees"),
    )


def diff_findings(diffs: DataFrame) -> DataFrame:
    """diff_counts(level, key, n_pairs, moved): by dimension, and pairs by kind of rewriting
    (the producer of the second document)."""
    kind = C.producer_label(C.panel_slug(F.col("b_doc_id")))
    keys = F.array_compact(
        F.array(
            F.struct(F.lit("dimension").alias("level"), F.col("dimension").alias("key")),
            F.when(
                F.col("dimension") == "coverage",
                F.struct(F.lit("kind").alias("level"), kind.alias("key")),
            ),
        )
    )
    rows = diffs.select("moved", F.explode(keys).alias("k")).select("k.level", "k.key", "moved")
    return rows.groupBy("level", "key").agg(
        F.count("*").alias("n_pairs"), F.count_if(F.col("moved")).alias("moved")
    )


# -- raters ------------------------------------------------------------------------------


def long_ratings(sheets: DataFrame) -> DataFrame:
    """One column per dimension → ratings(doc_id, rater_id, dimension, score), gaps dropped."""
    return sheets.unpivot(["doc_id", "rater_id"], list(K.DIMENSIONS), "dimension", "score").where(
        F.col("score").isNotNull()
    )


def expert_means(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy("doc_id", "dimension").agg(
        F.avg(F.col("score").cast("double")).alias("expert_mean"), F.count("*").alias("n_raters")
    )


def rated_signals(readiness: DataFrame, means: DataFrame) -> DataFrame:
    return readiness.join(means, ["doc_id", "dimension"]).where(F.col("value").isNotNull())


def average_ranks(rated: DataFrame, scope: list[str]) -> DataFrame:
    """Histogram of (value, mean) with tie-averaged ranks on both sides.

    Ranks are cumulated over distinct values, dealt out by range, so no task holds all
    values of a scope."""
    held = written(rated.groupBy(*scope, "value", "expert_mean").agg(F.count("*").alias("n")))
    cells = held
    for column, rank in (("value", "value_rank"), ("expert_mean", "mean_rank")):
        marginal = held.groupBy(*scope, column).agg(F.sum("n").alias("_m"))
        cells = cells.join(ranks.average_ranks(marginal, scope, column, "_m", rank), [*scope, column])
    return cells


def spearman(ranks: DataFrame, scope: list[str]) -> DataFrame:
    """Rank correlation over the histogram; NULL below three rows or without spread."""
    n, x, y = F.col("n"), F.col("value_rank"), F.col("mean_rank")
    sums = ranks.groupBy(*scope).agg(
        F.sum("n").alias("n_documents"),
        F.sum(n * x).alias("sx"), F.sum(n * y).alias("sy"),
        F.sum(n * x * x).alias("sxx"), F.sum(n * y * y).alias("syy"), F.sum(n * x * y).alias("sxy"),
    )
    k = F.col("n_documents")
    cov = k * F.col("sxy") - F.col("sx") * F.col("sy")
    vx = k * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = k * F.col("syy") - F.col("sy") * F.col("sy")
    rho = F.when((k >= 3) & (vx > 0) & (vy > 0), cov / F.sqrt(vx) / F.sqrt(vy))
    return sums.select(*scope, "n_documents", rounded(rho, 6).alias("spearman_rho"))


def icc(ratings: DataFrame) -> DataFrame:
    """Share of between-document variance in the ratings, per dimension."""
    per_doc = (
        ratings.groupBy("doc_id", "dimension")
        .agg(
            F.count("*").alias("k"),
            F.var_samp(F.col("score").cast("double")).alias("within"),
            F.avg(F.col("score").cast("double")).alias("mean"),
        )
        .where(F.col("k") >= 2)
    )
    per_dim = per_doc.groupBy("dimension").agg(
        F.count("*").alias("n_documents"), F.avg("within").alias("w"), F.var_samp("mean").alias("b")
    )
    total = F.col("w") + F.col("b")
    return per_dim.select(
        "dimension",
        "n_documents",
        rounded(F.when((F.col("n_documents") >= 2) & (total != 0), F.col("b") / total), 6).alias("icc"),
    )


def expert_outliers(means: DataFrame) -> DataFrame:
    rows = with_panel(means).withColumn("producer", C.producer_label(C.panel_slug(F.col("doc_id"))))
    w = Window.partitionBy("peer_group", "dimension")
    rows = rows.select(
        "peer_group", "dimension", "producer",
        (F.count("*").over(w) < 3).alias("few"),
        F.abs(F.col("expert_mean") - F.median("expert_mean").over(w)).alias("d"),
    )
    far = F.max("d").over(w)
    return rows.select("*", ((far > 0) & (F.col("d") == far)).alias("out")).groupBy("peer_group", "dimension").agg(
        F.max("few").alias("few"),
        # a panel holds four documents, so the set is small
        F.collect_set(F.when(F.col("out"), F.col("producer"))).alias("expert"),
    )


def expert_agreement(outliers: DataFrame, means: DataFrame) -> DataFrame:
    """Per panel and dimension: do signals and raters single out the same producer?"""
    structural = outliers.groupBy("peer_group", "dimension").agg(
        F.max("non_comparable").alias("blocked"),
        F.collect_set(F.when(F.col("is_outlier"), F.col("producer"))).alias("structural"),
    )
    both = structural.join(expert_outliers(means), ["peer_group", "dimension"], "left")
    outcome = (
        F.when(F.col("blocked") | F.coalesce("few", F.lit(True)), "non_comparable")
        .when(F.arrays_overlap("structural", "expert"), "agree")
        .otherwise("disagree")
    )
    return both.select(
        "peer_group",
        "dimension",
        outcome.alias("outcome"),
        F.array_join(F.sort_array("structural"), ",").alias("structural"),
        F.array_join(F.sort_array(F.coalesce("expert", F.array().cast("array<string>"))), ",").alias("expert"),
    )


DIVERGES_OVER = 1.5


def divergence_cases(rated: DataFrame) -> DataFrame:
    return rated.where(F.abs(F.col("value") - F.col("expert_mean")) > DIVERGES_OVER).select(
        "doc_id", "dimension", "value", "expert_mean"
    )


def agreement_tier(score: Column) -> Column:
    return F.when(score >= 0.8, "strong").when(score >= 0.4, "moderate").when(score.isNotNull(), "weak").otherwise("")


# -- costs -------------------------------------------------------------------------------

GROUNDED_CALL = 0.014


def llm_costs(usage: DataFrame, pricing: DataFrame) -> DataFrame:
    """Cost per call; 0 for unknown models, a flat price for grounded calls.

    The price list is one row per model; its size decides how it is joined."""
    priced = usage.join(pricing, ["provider", "model"], "left")
    tokens = (
        F.col("input_tokens") / 1000.0 * F.col("input_per_1k")
        + F.col("output_tokens") / 1000.0 * F.col("output_per_1k")
    )
    cost = F.when(F.col("grounded"), F.lit(GROUNDED_CALL)).otherwise(F.coalesce(rounded(tokens, 6), F.lit(0.0)))
    return priced.select("provider", "model", "grounded", "input_tokens", "output_tokens", cost.alias("cost_usd"))


# -- calibration ---------------------------------------------------------------------------


def calibration_scores(labelled: DataFrame, as_of: Column) -> DataFrame:
    """Precision, recall and F1 per provider, for all claims and without stale ones.

    labelled(provider, expected, verdict, as_of_date, edge).  Positive is `verified` or
    `close` on both sides; edge categories are left out."""
    positive = lambda c: F.col(c).isin("verified", "close")
    fresh = F.datediff(as_of, F.col("as_of_date")) <= 90
    scopes = F.array_compact(F.array(F.lit("all"), F.when(fresh, "fresh")))
    rows = labelled.where(~F.col("edge")).select(
        "provider", positive("expected").alias("e"), positive("verdict").alias("v"), F.explode(scopes).alias("scope")
    )
    e, v = F.col("e"), F.col("v")
    counts = rows.groupBy("provider", "scope").agg(
        F.count_if(e & v).alias("tp"), F.count_if(~e & v).alias("fp"),
        F.count_if(e & ~v).alias("fn"), F.count_if(~e & ~v).alias("tn"),
    )
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select(
        "*",
        rounded(F.try_divide(tp, tp + fp), 4).alias("precision"),
        rounded(F.try_divide(tp, tp + fn), 4).alias("recall"),
        rounded(F.try_divide(2 * tp, 2 * tp + fp + fn), 4).alias("f1"),
    )


STRONG_FROM, MODERATE_FROM = 0.8, 0.6


def reliability_tiers(scores: DataFrame, strong: float = STRONG_FROM, moderate: float = MODERATE_FROM) -> DataFrame:
    f1 = F.col("f1")
    return scores.where(F.col("scope") == "all").select(
        "provider",
        "f1",
        (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("claims_tested"),
        F.when(f1.isNull(), "uncalibrated")
        .when(f1 >= strong, "strong")
        .when(f1 >= moderate, "moderate")
        .otherwise("weak")
        .alias("tier"),
    )


def provider_provenance(verdicts: DataFrame, tiers: DataFrame) -> DataFrame:
    """Verified claims per provider beside the provider's calibration row."""
    held = verdicts.where(F.col("verdict").isin("verified", "close")).groupBy(
        F.col("best_provider").alias("provider")
    ).agg(F.count("*").alias("verified_count"))
    return held.join(tiers, "provider", "left").select(
        "provider",
        "verified_count",
        F.coalesce("tier", F.lit("uncalibrated")).alias("tier"),
        "f1",
        "claims_tested",
    )


