"""Documents beside documents: versions of one text, peers of one panel.

Pairs come from panels, which hold one document per producer, so a panel is small
by construction.  Both sides of a pair are read from one and the same exchange
(partitioned by the panel), so the signals are computed once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import text as T
from tessera.functions.scalar import edit_distance, rounded
from tessera.operators import claims as N
from tessera.sources import corpus as C


def with_panel(docs: DataFrame) -> DataFrame:
    return docs.withColumn("peer_group", F.floor(F.col("doc_id") / C.PANEL).cast("long"))


def side_by_side(rows: DataFrame, on: list[str], columns: list[str], key: str = "doc_id") -> DataFrame:
    """Rows paired within equal `on`, lower key first; columns get the prefixes a_ and b_.

    `rows` is partitioned once, and both sides use that exchange."""
    base = rows.select(*on, key, *columns).repartition(*on)
    a = base.select(*on, F.col(key).alias(f"a_{key}"), *[F.col(c).alias(f"a_{c}") for c in columns])
    b = base.select(*on, F.col(key).alias(f"b_{key}"), *[F.col(c).alias(f"b_{c}") for c in columns])
    return a.join(b, on).where(F.col(f"a_{key}") < F.col(f"b_{key}"))


def peer_pairs(peers: DataFrame) -> DataFrame:
    return side_by_side(peers, ["peer_group"], ["producer"])


PAIR_COLUMNS = [
    "missing", "coverage_count", "voice", "voice_confidence", "voice_runner_up", "dominant",
    "dominant_margin", "balanced", "sourced_pct", "total_claims", "unhedged_count", "numbers_in_claims",
    "leading_frame",
]


def pair_signals(framed: DataFrame) -> DataFrame:
    """framed signals → one row per peer pair with both sides' columns."""
    docs = with_panel(framed).select(
        "*",
        N.number_set(F.col("claims")).alias("numbers_in_claims"),
        F.try_element_at("frames", F.lit(1))["fvs_id"].alias("leading_frame"),
    )
    return side_by_side(docs, ["peer_group"], PAIR_COLUMNS)


def _sides(name: str) -> tuple[Column, Column]:
    return F.col(f"a_{name}"), F.col(f"b_{name}")


def number_sets(pairs: DataFrame) -> DataFrame:
    """Numbers both sides claim, and those only one side claims."""
    a, b = _sides("numbers_in_claims")
    sides = F.array(
        F.struct(F.lit("both").alias("side"), F.array_intersect(a, b).alias("v")),
        F.struct(F.lit("only_a").alias("side"), F.array_except(a, b).alias("v")),
        F.struct(F.lit("only_b").alias("side"), F.array_except(b, a).alias("v")),
    )
    return (
        pairs.select("peer_group", "a_doc_id", "b_doc_id", F.explode(sides).alias("s"))
        .select("peer_group", "a_doc_id", "b_doc_id", "s.side", F.explode_outer("s.v").alias("value"))
        .where(F.col("value").isNotNull())
    )


NEAR_LOW, NEAR_HIGH = 0.01, 0.30


def near_matches(sets: DataFrame) -> DataFrame:
    """Numbers of one side only that lie 1 to 30 per cent from one of the other side.

    Values within 30 per cent fall into the same or the next bucket of a log scale
    whose step is 1/0.7, so three equi-join keys stand for the range condition."""
    x = F.col("value").cast("double")
    step = -F.log(F.lit(1 - NEAR_HIGH))
    keyed = sets.where((F.col("side") != "both") & (x != 0)).select(
        "a_doc_id",
        "b_doc_id",
        "side",
        "value",
        x.alias("x"),
        F.signum(x).alias("sign"),
        F.floor(F.log(F.abs(x)) / step).alias("bucket"),
    )
    pair = ["a_doc_id", "b_doc_id", "sign", "bucket"]
    a = keyed.where(F.col("side") == "only_a").select(
        "a_doc_id", "b_doc_id", "sign", "bucket", F.col("value").alias("value_a"), F.col("x").alias("xa")
    )
    b = keyed.where(F.col("side") == "only_b").select(
        "a_doc_id",
        "b_doc_id",
        "sign",
        F.explode(F.sequence(F.col("bucket") - 1, F.col("bucket") + 1)).alias("bucket"),
        F.col("value").alias("value_b"),
        F.col("x").alias("xb"),
    )
    apart = F.abs(F.col("xa") - F.col("xb")) / F.greatest(F.abs("xa"), F.abs("xb"))
    return (
        a.join(b, pair)
        .where((apart > NEAR_LOW) & (apart < NEAR_HIGH))
        .select("a_doc_id", "b_doc_id", "value_a", "value_b", rounded(apart, 4).alias("difference"))
    )


def blind_spots(pairs: DataFrame) -> DataFrame:
    a, b = _sides("missing")
    return pairs.select(
        "a_doc_id",
        "b_doc_id",
        F.array_join(F.array_intersect(a, b), ",").alias("shared"),
        F.array_join(F.array_except(a, b), ",").alias("only_a"),
        F.array_join(F.array_except(b, a), ",").alias("only_b"),
    )


SOURCING_POINTS, CERTAINTY_POINTS, CERTAINTY_CLAIMS = 10, 20, 3


def pair_findings(pairs: DataFrame) -> DataFrame:
    """Cards on which the two sides differ, and a headline over the number of differences."""
    (ca, cb), (va, vb), (sa, sb) = _sides("coverage_count"), _sides("voice"), _sides("sourced_pct")
    (ta, tb), (na, nb), (ua, ub) = _sides("dominant"), _sides("total_claims"), _sides("unhedged_count")
    (ma, mb) = _sides("missing")
    apart = [ca != cb, va != vb, F.abs(sa - sb) >= SOURCING_POINTS, ta != tb]
    n = sum((t.cast("int") for t in apart), F.lit(0))
    shared = F.size(F.array_intersect(ma, mb)) > 0
    pa, pb = F.rint(F.try_divide(ua, na) * 100), F.rint(F.try_divide(ub, nb) * 100)
    certainty = (na >= CERTAINTY_CLAIMS) & (nb >= CERTAINTY_CLAIMS) & (F.abs(pa - pb) >= CERTAINTY_POINTS)
    cards = F.array_compact(
        F.array(
            F.when((ca != cb) | (ca < 5), "coverage"),
            F.when(apart[1], "voice"),
            F.when(apart[2], "sourcing"),
            F.when(F.coalesce(certainty, F.lit(False)), "certainty"),
            F.when(apart[3], "temporal"),
        )
    )
    return pairs.select(
        "a_doc_id",
        "b_doc_id",
        n.cast("long").alias("divergences"),
        F.when((n == 0) & shared, "similar_shared_gaps")
        .when(n == 0, "similar")
        .when(n >= 3, "different")
        .alias("headline"),
        F.array_join(cards, ",").alias("cards"),
    )


def pair_summary(pairs: DataFrame, near: DataFrame) -> DataFrame:
    """What two documents share and where they part, with one verdict code.

    `near` holds the near matches; a pair without any is kept."""
    (va, vb), (ta, tb), (top_a, top_b) = _sides("voice"), _sides("dominant"), _sides("leading_frame")
    (xa, xb), (ra, rb) = _sides("numbers_in_claims"), _sides("voice_confidence")
    counts = near.groupBy("a_doc_id", "b_doc_id").agg(F.count("*").alias("n_near"))
    docs = pairs.join(counts, ["a_doc_id", "b_doc_id"], "left")
    agreed = F.size(F.array_intersect(xa, xb)).cast("long")
    off = F.coalesce("n_near", F.lit(0))
    verdict = (
        F.when(top_a == top_b, F.concat(F.lit("shared:"), top_a))
        .when(top_a.isNotNull() & top_b.isNotNull(), F.concat(F.lit("divergent:"), top_a, F.lit("/"), top_b))
        .when(top_a.isNotNull(), F.concat(F.lit("one_sided_a:"), top_a))
        .when(top_b.isNotNull(), F.concat(F.lit("one_sided_b:"), top_b))
        .when((agreed > 0) | (off > 0), "counts")
        .otherwise("none")
    )
    return docs.select(
        "a_doc_id",
        "b_doc_id",
        (va == vb).alias("voice_match"),
        ((ra == "borderline") & (rb == "borderline")).alias("both_borderline"),
        (ta == tb).alias("time_match"),
        (F.col("a_balanced") & F.col("b_balanced")).alias("both_balanced"),
        (F.col("b_coverage_count") - F.col("a_coverage_count")).alias("coverage_delta"),
        (F.col("b_sourced_pct") - F.col("a_sourced_pct")).alias("sourced_delta"),
        agreed.alias("agreed_numbers"),
        off.alias("near_numbers"),
        verdict.alias("verdict"),
    )


def profile_diffs(readiness: DataFrame) -> DataFrame:
    """Two profiles side by side, one row per pair and dimension.

    A dimension moves if its value, the frames that fired, or the count behind it
    changes; it cannot be compared where one side has no value."""
    rows = with_panel(readiness)
    both = side_by_side(rows, ["peer_group", "dimension"], ["value", "secondary", "companion", "fired"])
    (va, vb), (fa, fb) = _sides("value"), _sides("fired")
    list_a, list_b = (F.filter(F.split(f, ","), lambda x: x != "") for f in (fa, fb))
    unmeasured = va.isNull() | vb.isNull() | (
        (F.col("dimension") == "robustness")
        & (F.coalesce("a_companion", F.lit(0)) == 0)
        & (F.coalesce("b_companion", F.lit(0)) == 0)
    )
    moved = ~va.eqNullSafe(vb) | (fa != fb) | (F.col("a_companion") != F.col("b_companion"))
    return both.select(
        "peer_group",
        "dimension",
        "a_doc_id",
        "b_doc_id",
        (vb - va).alias("value_delta"),
        F.array_join(F.array_except(list_b, list_a), ",").alias("gained"),
        F.array_join(F.array_except(list_a, list_b), ",").alias("lost"),
        unmeasured.alias("non_comparable"),
        moved.alias("moved"),
    )


# -- versions of one text -----------------------------------------------------------


def version_numbers(versions: DataFrame) -> DataFrame:
    """version_numbers(group_id, version_id, type, value): the distinct data numbers."""
    docs = N.with_numbers(versions)
    return (
        docs.select(
            "group_id",
            "version_id",
            F.explode_outer(
                F.array_distinct(
                    F.transform("numbers", lambda n: F.struct(n["type"].alias("type"), n["value"].alias("value")))
                )
            ).alias("n"),
        )
        .where(F.col("n").isNotNull())
        .select("group_id", "version_id", "n.type", "n.value")
    )


def version_union(versions: DataFrame) -> DataFrame:
    """All numbers of any version of a text, with the number of versions that hold them."""
    return version_numbers(versions).groupBy("group_id", "type", "value").agg(F.count("*").alias("n_versions"))


def number_stability(versions: DataFrame) -> DataFrame:
    sizes = versions.groupBy("group_id").agg(F.count("*").alias("n"))
    held = version_union(versions)
    rows = sizes.join(held, "group_id", "left")
    groups = rows.groupBy("group_id").agg(
        F.max("n").alias("n_versions"),
        F.count("value").alias("total_unique"),
        F.count_if(F.col("n_versions") == F.col("n")).alias("stable_count"),
    )
    total = F.col("total_unique")
    unstable = total - F.col("stable_count")
    return groups.select(
        "*",
        unstable.alias("unstable_count"),
        F.when(total > 0, rounded(unstable / total, 3)).alias("instability_rate"),
        F.when(total < 10, "low").when(total < 30, "adequate").otherwise("good").alias("precision"),
    )


def version_claims(versions: DataFrame) -> DataFrame:
    from tessera.operators.text_tables import with_sentences

    return N.with_claims(N.with_sentence_claims(N.with_numbers(with_sentences(versions))))


BUCKETS = ("percentage", "dollar", "multiplier", "decimal", "integer")


def regeneration_stability(versions: DataFrame) -> DataFrame:
    """How many magnitudes come back in every regeneration of a text."""
    docs = version_claims(versions).select(
        "group_id",
        "version_id",
        F.substring(F.sha2("text", 256), 1, 8).alias("signature"),
        F.array_distinct(
            F.filter(
                F.transform(
                    F.flatten(F.transform("claims", lambda c: N.shown_numbers(c))),
                    lambda r: F.struct(N.stability_key(r).alias("key"), N.number_type(r).alias("type")),
                ),
                lambda x: x["key"].isNotNull(),
            )
        ).alias("keys"),
    )
    marked = docs.select(
        "group_id", "version_id", "signature", F.posexplode_outer("keys").alias("pos", "k")
    )
    # one shuffle by the text's group: a group holds the few versions of one text
    per_key = marked.groupBy("group_id", F.col("k.key").alias("key")).agg(
        F.count("*").alias("held"), F.min("k.type").alias("type")
    )
    sizes = docs.groupBy("group_id").agg(
        F.count("*").alias("n"),
        F.array_join(F.sort_array(F.collect_list("signature")), ",").alias("signatures"),
    )
    rows = sizes.join(per_key.where(F.col("key").isNotNull()), "group_id", "left")
    stable = F.col("held") == F.col("n")
    groups = rows.groupBy("group_id").agg(
        F.max("n").alias("regenerations"),
        F.max("signatures").alias("signatures"),
        F.count("key").alias("total_unique"),
        F.count_if(stable).alias("stable_count"),
        F.count_if(F.col("held") == 1).alias("unique_to_one"),
        *[F.count_if(stable & (F.col("type") == t)).alias(f"stable_{t}") for t in BUCKETS],
    )
    total = F.col("total_unique")
    return groups.select(
        "*",
        (total - F.col("stable_count") - F.col("unique_to_one")).alias("partial_count"),
        F.when(total > 0, rounded(F.col("stable_count") / total, 4)).otherwise(F.lit(0.0)).alias("stability_rate"),
    )


def verbatim_pairs(versions: DataFrame, threshold: float = 0.95) -> DataFrame:
    """Pairs of versions that are the same text but for a few characters.

    The length ratio bounds the similarity from above and is tested first; the edit
    distance is then computed on the whole texts."""
    rows = versions.select("group_id", "version_id", "text", F.length("text").alias("n"))
    pairs = side_by_side(rows, ["group_id"], ["text", "n"], key="version_id")
    longest, shortest = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    close = pairs.where(shortest >= longest * threshold)
    # past this distance the answer is no: the banded distance gives up with -1
    limit = F.ceil(longest * (1 - threshold)).cast("int")
    away = edit_distance(F.col("a_text"), F.col("b_text"), limit)
    ratio = F.when(away >= 0, F.coalesce(F.lit(1.0) - F.try_divide(away, longest), F.lit(1.0)))
    return (
        close.select("group_id", "a_version_id", "b_version_id", ratio.alias("r"))
        .where(F.col("r") >= threshold)
        .select("group_id", "a_version_id", "b_version_id", rounded(F.col("r"), 4).alias("similarity"))
    )


def verbatim_copies(documents: DataFrame) -> DataFrame:
    """Texts that occur more than once: hash, first document, number of copies.

    Counted by hash with map-side partial aggregates, so a text that makes up a third
    of the corpus is one small row per task before the shuffle."""
    return (
        documents.groupBy(F.sha2("text", 256).alias("content_hash"))
        .agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1)
    )


# -- headings against the panel's headings ----------------------------------------------


def heading_overlap(docs: DataFrame) -> DataFrame:
    """Share of a document's headings whose words are mostly used in its peers' headings."""
    rows = with_panel(
        docs.select("doc_id", F.posexplode_outer(T.minor_headings(F.col("text"))).alias("no", "heading"))
    ).where(F.col("heading").isNotNull())
    words = rows.select(
        "peer_group",
        "doc_id",
        "no",
        F.explode_outer(
            F.array_distinct(
                F.filter(
                    F.split(F.lower(F.regexp_replace("heading", r"[\*\d\.\s]+", " ")), r"\s+"), lambda w: w != ""
                )
            )
        ).alias("word"),
    )
    # a word counts as known to the peers if another document of the panel uses it
    users = (
        words.where(F.col("word").isNotNull())
        .groupBy("peer_group", "word")
        .agg((F.min("doc_id") != F.max("doc_id")).alias("shared"))
    )
    per_heading = (
        words.join(users, ["peer_group", "word"], "left")
        .groupBy("doc_id", "no")
        .agg(
            F.count("word").alias("n"),
            F.count_if(F.coalesce("shared", F.lit(False))).alias("known"),
        )
    )
    hit = (F.col("n") > 0) & (F.try_divide(F.col("known"), F.col("n")) > 0.5)
    per_doc = per_heading.groupBy("doc_id").agg(
        F.count("*").alias("n_headings"), F.count_if(hit).alias("matched")
    )
    return per_doc.select(
        "doc_id", "n_headings", "matched", rounded(F.col("matched") / F.col("n_headings"), 4).alias("heading_overlap")
    )
