"""Per-document framing signals: coverage, time, voice, attribution, style.

Each `add_*` takes documents that already carry what it reads (`text`, and
`sentences` where it works on sentences) and adds plain columns.  All of it is
row-wise, so a whole profile is one narrow stage over the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import spans as S, text as T, vocabulary as V
from tessera.functions.scalar import (
    count_matches, count_where, counted, find_all, has, kilowords, let, mean, percent, rounded, total,
)

CLASSES = tuple(V.PERSPECTIVES)
COVERED_FROM = 2
LONG_ENOUGH = 100  # white-space words needed by the deeper detectors


def add_words(docs: DataFrame) -> DataFrame:
    return docs.select("*", T.word_count(F.col("text")).alias("words"))


# -- coverage ---------------------------------------------------------------


def add_coverage(docs: DataFrame) -> DataFrame:
    """cov_<class>_{count,dismissed,density,covered} plus the summary columns.

    Needs `text` and `words`."""
    text = F.col("text")
    keep = list(docs.columns)
    docs = docs.select(*keep, S.marked_clauses(text, V.PERSPECTIVES.values()).alias("_clauses"))
    docs = docs.select(*keep, "_clauses", F.array_join(F.transform("_clauses", lambda p: p["text"]), "").alias("_marked"))
    found = []
    for name, pattern in V.PERSPECTIVES.items():
        if name in V.DISMISSIBLE:
            found.append(S.spans_in(F.col("_clauses"), pattern).alias(f"_{name}_spans"))
        else:
            found.append(count_matches(F.col("_marked"), pattern).alias(f"cov_{name}_count"))
    docs = docs.select(*keep, *found)
    counts = []
    for name in CLASSES:
        if name in V.DISMISSIBLE:
            hits = F.col(f"_{name}_spans")
            gone = count_where(hits, lambda h: S.dismissed(F.col("text"), h))
            counts.append(gone.alias(f"cov_{name}_dismissed"))
            counts.append(F.size(hits).cast("long").alias(f"_{name}_raw"))
        else:
            counts.append(F.col(f"cov_{name}_count"))
            counts.append(F.lit(0).cast("long").alias(f"cov_{name}_dismissed"))
    docs = docs.select(*keep, *counts)
    plain = []
    for name in CLASSES:
        if name in V.DISMISSIBLE:
            plain.append((F.col(f"_{name}_raw") - F.col(f"cov_{name}_dismissed")).alias(f"cov_{name}_count"))
        else:
            plain.append(F.col(f"cov_{name}_count"))
        plain.append(F.col(f"cov_{name}_dismissed"))
    docs = docs.select(*keep, *plain)
    base = list(docs.columns)
    derived = []
    for name in CLASSES:
        n, gone = F.col(f"cov_{name}_count"), F.col(f"cov_{name}_dismissed")
        derived.append(rounded(n / kilowords(F.col("words")), 1).alias(f"cov_{name}_density"))
        derived.append(
            ((n >= COVERED_FROM) & ~((gone > n) & (n < COVERED_FROM * 3))).alias(f"cov_{name}_covered")
        )
    docs = docs.select(*base, *derived)
    covered = F.array(*[F.when(F.col(f"cov_{c}_covered"), F.lit(c)) for c in sorted(CLASSES)])
    missing = F.array(*[F.when(~F.col(f"cov_{c}_covered"), F.lit(c)) for c in sorted(CLASSES)])
    densities = F.array_compact(
        F.array(*[F.when(F.col(f"cov_{c}_covered"), F.col(f"cov_{c}_density")) for c in CLASSES])
    )
    docs = docs.select(
        "*",
        F.array_compact(covered).alias("covered"),
        F.array_compact(missing).alias("missing"),
        densities.alias("_densities"),
    )
    low, high = F.array_min("_densities"), F.array_max("_densities")
    return docs.select(
        "*",
        F.size("covered").cast("long").alias("coverage_count"),
        F.when((F.size("_densities") >= 2) & (high > 0), rounded(low / high, 2)).alias("coverage_balance"),
    ).drop("_densities")


def coverage_rows(docs: DataFrame) -> DataFrame:
    """coverage(doc_id, class, count, density, dismissed, covered, markers)."""
    signals = add_coverage(add_words(docs.select("doc_id", "text")))
    text = F.col("text")
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("perspective"),
                F.col(f"cov_{c}_count").alias("count"),
                F.col(f"cov_{c}_density").alias("density"),
                F.col(f"cov_{c}_dismissed").alias("dismissed"),
                F.col(f"cov_{c}_covered").alias("covered"),
            )
            for c in CLASSES
        ]
    )
    return signals.select("doc_id", F.explode(rows).alias("c")).select("doc_id", "c.*")


def markers_matched(docs: DataFrame) -> DataFrame:
    """Per document and perspective the distinct markers that count."""
    text = F.col("text")
    cols = []
    for name, pattern in V.PERSPECTIVES.items():
        cols.append(S.spans_in(F.col("_clauses"), pattern).alias(name))
    cut = docs.select("doc_id", "text", S.marked_clauses(text, V.PERSPECTIVES.values()).alias("_clauses"))
    cut = cut.select("doc_id", "text", *cols)
    kept = []
    for name in CLASSES:
        hits = F.col(name)
        if name in V.DISMISSIBLE:
            hits = F.filter(hits, lambda h: ~S.dismissed(F.col("text"), h))
        names = F.array_sort(F.array_distinct(F.transform(hits, lambda h: S.normal_marker(h["marker"]))))
        kept.append(F.struct(F.lit(name).alias("perspective"), names.alias("names")))
    rows = cut.select("doc_id", F.explode(F.array(*kept)).alias("m"))
    return rows.select(
        "doc_id",
        "m.perspective",
        F.array_join("m.names", "|").alias("markers"),
        F.size("m.names").cast("long").alias("n_markers"),
    )


# -- time -------------------------------------------------------------------


def add_time(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    sents = F.col("sentences")
    docs = docs.select(
        "*",
        count_where(sents, lambda s: has(s["sentence"], V.PAST)).alias("_past"),
        count_where(sents, lambda s: has(s["sentence"], V.FUTURE)).alias("_future"),
        F.size(sents).cast("long").alias("_n"),
    )
    docs = docs.withColumn("_present", F.col("_n") - F.col("_past") - F.col("_future"))
    total = F.greatest(F.col("_n"), F.lit(1))
    names = ("future", "past", "present")  # ties of remainders go by name
    exact = [F.col(f"_{k}") / total * 100 for k in names]
    docs = docs.select("*", *[e.alias(f"_{k}_exact") for k, e in zip(names, exact)])
    # towards zero, as an integer cast does
    docs = docs.select("*", *[F.col(f"_{k}_exact").cast("long").alias(f"_{k}_floor") for k in names])
    residue = F.lit(100) - sum((F.col(f"_{k}_floor") for k in names), F.lit(0))
    docs = docs.select(
        "*",
        residue.alias("_residue"),
        *[(F.col(f"_{k}_exact") - F.col(f"_{k}_floor")).alias(f"_{k}_rest") for k in names],
    )

    def place(i: int) -> Column:
        """How many tenses have a better claim to a spare point than tense i."""
        mine = F.col(f"_{names[i]}_rest")
        ahead = [
            ((F.col(f"_{o}_rest") > mine) | ((F.col(f"_{o}_rest") == mine) & F.lit(j < i))).cast("int")
            for j, o in enumerate(names)
            if j != i
        ]
        return sum(ahead, F.lit(0))

    shares = []
    for i, k in enumerate(names):
        share = F.col(f"_{k}_floor") + (place(i) < F.col("_residue")).cast("long")
        shares.append(F.when(F.col("_n") == 0, F.lit(0)).otherwise(share).cast("long").alias(f"{k}_pct"))
    docs = docs.select("*", *shares)
    present, past, future = (F.col(f"_{k}") for k in ("present", "past", "future"))
    top = F.greatest(present, past, future)
    dominant = F.when(present == top, "present").when(past == top, "past").otherwise("future")
    order = F.sort_array(F.array("past_pct", "present_pct", "future_pct"), asc=False)
    return docs.select(
        *keep, "past_pct", "present_pct", "future_pct", dominant.alias("dominant"), order.alias("_o")
    ).select(
        *keep,
        "past_pct",
        "present_pct",
        "future_pct",
        "dominant",
        (F.col("_o")[0] - F.col("_o")[1]).alias("dominant_margin"),
        ((F.col("_o")[0] < 50) & (F.col("_o")[0] - F.col("_o")[1] < 10)).alias("balanced"),
    )


# -- voice ------------------------------------------------------------------

IMPERATIVE_POINTS = 5
BORDERLINE = 2.0


def add_voice(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    sents = F.col("sentences")

    def share(pattern: str) -> Column:
        return percent(count_where(sents, lambda s: has(s["sentence"], pattern)), F.size(sents))

    def specifies(s: Column) -> Column:
        stops = F.contains(s["sentence"], F.lit(":")) | F.contains(s["sentence"], F.lit("/"))
        return stops & has(s["sentence"], V.SPECIFICATION)

    docs = docs.select(
        *keep,
        F.size(sents).cast("long").alias("n_sentences"),
        share(V.YOU).alias("you_pct"),
        share(V.WE).alias("we_pct"),
        count_where(sents, lambda s: has(s["sentence"], V.IMPERATIVE)).alias("imperative_count"),
        percent(count_where(sents, specifies), F.size(sents)).alias("spec_pct"),
        share(V.PROMOTION).alias("promo_pct"),
    )
    you, we, imp = F.col("you_pct"), F.col("we_pct"), F.col("imperative_count")
    spec, promo = F.col("spec_pct"), F.col("promo_pct")
    rules = [
        ("prescriptive", (you >= 15) & (imp >= 2), F.least(you - 15, IMPERATIVE_POINTS * (imp - 2))),
        (
            "prescriptive",
            (you >= 15) | ((imp >= 3) & (you >= 5)),
            F.greatest(you - 15, F.least(IMPERATIVE_POINTS * (imp - 3), you - 5)),
        ),
        ("promotional", we >= 20, we - 20),
        (
            "promotional",
            (promo >= 20) & (you < 5) & (we < 5),
            F.least(promo - 20, F.lit(4) - you, F.lit(4) - we),
        ),
        ("descriptive", spec >= 20, spec - 20),
        ("advisory", you >= 5, you - 5),
    ]
    fires = [f for _, f, _ in rules]
    margins = [m.cast("double") for _, _, m in rules]
    nobody = ~F.greatest(*fires)
    residual = -F.greatest(*[F.when(f, F.lit(-999.0)).otherwise(m) for f, m in zip(fires, margins)])
    classes = [c for c, _, _ in rules] + ["analytical"]
    fires.append(nobody)
    margins.append(residual)
    docs = docs.select(
        "*",
        *[f.alias(f"_f{i}") for i, f in enumerate(fires)],
        *[m.alias(f"_m{i}") for i, m in enumerate(margins)],
    )
    won = F.lit(None).cast("string")
    for i in reversed(range(len(classes))):
        won = F.when(F.col(f"_f{i}"), F.lit(classes[i])).otherwise(won)
    docs = docs.select("*", won.alias("_won"))
    at = [i for i in range(len(classes))]
    win_margin = F.greatest(
        *[
            F.when((F.lit(classes[i]) == F.col("_won")) & F.col(f"_f{i}"), F.col(f"_m{i}"))
            for i in at
        ]
    )
    nxt = {  # the class that comes after each winner in the cascade
        "prescriptive": "promotional",
        "promotional": "descriptive",
        "descriptive": "advisory",
        "advisory": "analytical",
    }
    runner = F.lit(None).cast("string")
    runner_margin = F.lit(None).cast("double")
    for cls, follower in nxt.items():
        best = [F.col(f"_m{i}") for i in at if classes[i] == follower]
        best_margin = F.greatest(*best) if len(best) > 1 else best[0]
        runner = F.when(F.col("_won") == cls, follower).otherwise(runner)
        runner_margin = F.when(F.col("_won") == cls, best_margin).otherwise(runner_margin)
    empty = F.col("n_sentences") == 0
    docs = docs.select(
        *keep,
        "n_sentences",
        "you_pct",
        "we_pct",
        "imperative_count",
        "spec_pct",
        "promo_pct",
        F.when(empty, "insufficient").otherwise(F.col("_won")).alias("voice"),
        F.when(empty, F.lit(0.0)).otherwise(win_margin).alias("voice_margin"),
        F.when(~empty, runner).alias("voice_runner_up"),
        F.when(~empty, runner_margin).alias("voice_runner_up_margin"),
    )
    return docs.select(
        "*",
        F.when(F.col("voice") == "insufficient", "insufficient")
        .when(F.col("voice_margin") < BORDERLINE, "borderline")
        .when(F.col("voice_runner_up_margin") > -BORDERLINE, "borderline")
        .otherwise("high")
        .alias("voice_confidence"),
    )


# -- attribution --------------------------------------------------------------

REPORTER = r"(?<![\w-])" + V.NAMED_REPORTER


def is_sourced(sentence: Column) -> Column:
    """A source marker, or a named entity in front of a reporting verb."""
    heads = F.transform(
        find_all(sentence, REPORTER, 1),
        lambda name: F.lower(
            F.regexp_extract(F.regexp_replace(name, r"^(?:(?:The|A|An)(?:\s+|$))+", ""), r"^([A-Za-z]+)", 1)
        ),
    )
    named = F.exists(heads, lambda h: (h != "") & ~h.isin(V.NOT_A_REPORTER))
    # The verb is sought first: a name stands before it or is none.
    return has(sentence, V.SOURCE_MARKER) | (sentence.rlike(r"\s" + V.REPORTING_VERBS) & named)


def is_numeric(sentence: Column) -> Column:
    return has(sentence, V.NUMERIC)


def add_attribution(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    flags = F.transform(
        "sentences",
        lambda s: F.struct(
            is_sourced(s["sentence"]).alias("sourced"), is_numeric(s["sentence"]).alias("numeric")
        ),
    )
    docs = docs.select(*keep, flags.alias("_flags"))
    f = F.col("_flags")
    n = F.size(f).cast("long")
    return docs.select(
        *keep,
        count_where(f, lambda x: x["sourced"]).alias("sourced"),
        percent(count_where(f, lambda x: x["sourced"]), n).alias("sourced_pct"),
        count_where(f, lambda x: x["numeric"]).alias("numeric_sentences"),
        count_where(f, lambda x: x["numeric"] & ~x["sourced"]).alias("unsupported_numeric"),
        n.alias("total_sentences"),
    )


# -- reasoning style ----------------------------------------------------------


def add_mechanism(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    docs = docs.select(*keep, S.marked_text(F.col("text"), (V.MECHANISM, V.BUZZWORD)).alias("_marked"))
    docs = docs.select(
        *keep,
        count_matches(F.col("_marked"), V.MECHANISM).alias("mechanism_count"),
        count_matches(F.col("_marked"), V.BUZZWORD).alias("buzzword_count"),
    )
    total = F.col("mechanism_count") + F.col("buzzword_count")
    return docs.select(
        "*", rounded(F.col("mechanism_count") / F.greatest(total, F.lit(1)), 4).alias("mechanism_ratio")
    )


def add_assertion(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    docs = docs.select("*", T.section_bodies(F.col("text")).alias("_bodies"))
    docs = docs.select(
        *keep,
        (F.size("_bodies") > 0).alias("used_section_bodies"),
        F.when(F.size("_bodies") > 0, F.array_join("_bodies", "\n")).otherwise(F.col("text")).alias("_body"),
    )
    regs = list(V.REGISTERS)
    docs = docs.select(
        *keep,
        "used_section_bodies",
        *[count_matches(F.col("_body"), V.REGISTERS[r]).alias(f"reg_{r}") for r in regs],
    )
    total = sum((F.col(f"reg_{r}") for r in regs), F.lit(0))
    return docs.select(
        "*",
        F.when(total == 0, F.lit(0.0)).otherwise(rounded(F.col("reg_assertion") / total, 4)).alias("assertion_ratio"),
        F.when(total == 0, "no_data")
        .when(total < V.RELIABLE_REGISTER_HITS, "low")
        .otherwise("adequate")
        .alias("assertion_precision"),
    )


def add_presentation(docs: DataFrame) -> DataFrame:
    """Surface form.  Needs `text` and `plain`."""
    text = F.col("text")
    keep = list(docs.columns)
    docs = docs.select(
        *keep,
        T.style_tokens(text).alias("_tokens"),
        F.transform("plain", lambda s: F.size(T.style_tokens(s))).alias("_lengths"),
        count_matches(text, r"\*\*[^*]+\*\*").alias("_bold"),
        (
            count_matches(text, r"(?m)^[-*•]\s+") + count_matches(text, r"(?m)^\d+\.\s+")
        ).alias("_items"),
        F.size(T.minor_headings(text)).cast("long").alias("_headings"),
        count_matches(text, V.STYLE_HEDGE).alias("n_hedges"),
        count_matches(text, V.STYLE_ASSERT).alias("n_asserts"),
        count_matches(text, V.NAMED_CONCEPT).alias("n_named_concepts"),
    )
    docs = docs.select(
        "*",
        F.aggregate(
            F.filter("_tokens", lambda w: ~F.contains(w, F.lit("'"))),
            F.lit(0),
            lambda acc, w: acc + syllables(w),
        ).alias("_syllables"),
        F.size("_tokens").alias("_n"),
        F.size(F.array_distinct("_tokens")).alias("_types"),
        F.size("_lengths").alias("_sents"),
        F.aggregate("_lengths", F.lit(0), lambda a, x: a + x).alias("_length_sum"),
    )
    n = F.col("_n")
    both = F.col("n_hedges") + F.col("n_asserts")
    grade = (
        F.lit(0.39) * (n / F.greatest(F.col("_sents"), F.lit(1)))
        + F.lit(11.8) * (F.col("_syllables") / n)
        - F.lit(15.59)
    )
    return docs.select(
        *keep,
        n.cast("long").alias("style_words"),
        F.when(n > 0, rounded(F.col("_types") / n, 4)).otherwise(F.lit(0.0)).alias("type_token_ratio"),
        F.when(F.col("_sents") > 0, rounded(F.col("_length_sum") / F.col("_sents"), 1))
        .otherwise(F.lit(0.0))
        .alias("mean_sentence_length"),
        F.when(n > 0, rounded(grade, 1)).otherwise(F.lit(0.0)).alias("grade_level"),
        rounded(
            (F.col("_bold") + F.col("_items") + F.col("_headings"))
            / F.greatest(n / F.lit(100.0), F.lit(1.0)),
            2,
        ).alias("formatting_density"),
        F.when(both > 0, rounded(F.col("n_asserts") / both, 4))
        .otherwise(F.lit(0.5))
        .alias("assertiveness_ratio"),
        "n_hedges",
        "n_asserts",
        "n_named_concepts",
    )


def syllables(word: Column) -> Column:
    """Vowel groups, less a final `e`, never below one; one for short words."""
    groups = F.regexp_count(word, F.lit(r"[aeiouy]+"))
    less = F.when(F.endswith(word, F.lit("e")) & (groups > 1), groups - 1).otherwise(groups)
    return F.when(F.length(word) <= 3, F.lit(1)).otherwise(F.greatest(less, F.lit(1)))


def add_novelty(docs: DataFrame) -> DataFrame:
    """How much of each sentence is new to the document.  Needs `plain`.

    A word is new in the first sentence that holds it, with all its repeats there.
    Sorting (word, sentence, repeats) puts that sentence in front of each word's
    run; the new words are then summed up by sentence in one pass.  Every sentence
    adds an empty entry of its own, so that none is missing from the sums."""
    keep = list(docs.columns)
    words = F.filter(F.transform("plain", T.content_words), lambda w: F.size(w) > 0)
    docs = docs.select(*keep, words.alias("_w"))

    def entries(w: Column, i: Column) -> Column:
        own = F.transform(counted(w), lambda c: F.struct(c["w"].alias("x"), i.alias("i"), c["m"].alias("m")))
        empty = F.struct(
            F.concat(F.lit("#"), i.cast("string")).alias("x"), i.alias("i"), F.lit(0).alias("m")
        )
        return F.array_append(own, empty)

    def first_of_run(ps: Column) -> Column:
        return F.filter(
            ps, lambda p, k: (k == 0) | (p["x"] != F.try_element_at(ps, F.greatest(k, F.lit(1)))["x"])
        )

    firsts = let(F.sort_array(F.flatten(F.transform("_w", entries))), first_of_run)
    docs = docs.select(*keep, "_w", firsts.alias("_firsts"))
    by_sentence = F.sort_array(
        F.transform("_firsts", lambda f: F.struct(f["i"].alias("i"), f["m"].alias("m")))
    )

    def by_run(ps: Column) -> Column:
        """Every sentence has a run, and a run's sum is the difference of two running sums."""
        places = F.filter(
            F.sequence(F.lit(0), F.size(ps) - 1), lambda k: (k == 0) | (ps[k]["i"] != ps[F.greatest(k - 1, F.lit(0))]["i"])
        )
        return let(
            S.running_sums(F.transform(ps, lambda p: p["m"])),
            lambda before: let(
                places,
                lambda at: F.transform(
                    at, lambda k, j: before[F.coalesce(F.try_element_at(at, j + 2), F.size(ps))] - before[k]
                ),
            ),
        )

    sums = F.when(F.size(by_sentence) > 0, let(by_sentence, by_run)).otherwise(F.array(F.lit(0)))
    shares = let(
        sums, lambda ss: F.transform("_w", lambda w, i: F.try_element_at(ss, i + 1) / F.size(w))
    )
    docs = docs.select(
        *keep, (F.size("_firsts") - F.size("_w")).cast("long").alias("unique_words"), shares.alias("novelty")
    )
    n = F.size("novelty")
    quarter = F.greatest(F.floor(n / 4), F.lit(1)).cast("int")
    middle = (n - 1) / F.lit(2.0)
    docs = docs.select("*", mean(F.col("novelty")).alias("_mean"))
    cov = total(
        F.transform("novelty", lambda y, i: (i - middle) * (y - F.col("_mean")))
    )
    var = total(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: (i - middle) * (i - middle)))
    return docs.select(
        *keep,
        n.cast("long").alias("novelty_sentences"),
        "unique_words",
        F.coalesce(rounded(F.col("_mean"), 3), F.lit(0.0)).alias("mean_novelty"),
        rounded(count_where(F.col("novelty"), lambda x: x < 0.2) / n, 3).alias("repetition_rate"),
        F.when(n > 2, rounded(cov / var, 4)).when(n > 0, F.lit(0.0)).alias("information_decay"),
        rounded(mean(F.slice("novelty", F.lit(1), quarter)), 3).alias("first_quarter_novelty"),
        F.when(n > 0, rounded(mean(F.slice("novelty", -F.least(quarter, n), quarter)), 3)).alias(
            "last_quarter_novelty"
        ),
    )


def add_density(docs: DataFrame) -> DataFrame:
    """Numeric and causal claim sentences per thousand words.  Needs `words`, `sentences`."""
    sents = F.col("sentences")

    def any_number(s: Column) -> Column:
        test = F.lit(False)
        for _, pattern in V.SENTENCE_NUMBERS:
            test = test | has(s["sentence"], pattern)
        # Each of the patterns asks for a digit.
        return s["sentence"].rlike(r"\d") & test

    docs = docs.select(
        "*",
        count_where(sents, any_number).alias("numeric_claims"),
        count_where(sents, lambda s: has(s["sentence"], V.CAUSAL_SENTENCE)).alias("causal_claims"),
    )
    kw = kilowords(F.col("words"))
    return docs.select(
        "*",
        rounded(F.col("numeric_claims") / kw, 1).alias("numeric_per_kw"),
        rounded(F.col("causal_claims") / kw, 1).alias("causal_per_kw"),
    )


# -- deeper detectors: abstain (NULL) on texts under a hundred words -----------


def add_spaced_words(docs: DataFrame) -> DataFrame:
    return docs.select("*", T.spaced_word_count(F.col("text")).alias("spaced_words"))


def add_time_scope(docs: DataFrame, this_year: int) -> DataFrame:
    text = F.col("text")
    keep = list(docs.columns)
    enough = F.col("spaced_words") >= LONG_ENOUGH
    docs = docs.select(*keep, S.marked_text(text, (V.PROJECTION, V.RETROSPECTIVE)).alias("_marked"))
    docs = docs.select(
        *keep,
        F.array_sort(F.array_distinct(F.transform(find_all(text, V.YEAR, 1), lambda y: y.cast("long")))).alias("_y"),
        F.when(F.contains(text, F.lit("0s")) | F.contains(text, F.lit("0S")), F.size(F.array_distinct(find_all(text, V.DECADE))))
        .when(text.isNotNull(), 0)
        .cast("long")
        .alias("_decades"),
        count_matches(F.col("_marked"), V.PROJECTION).alias("_projection"),
        count_matches(F.col("_marked"), V.RETROSPECTIVE).alias("_retro"),
    )

    def years(test) -> Column:
        return F.when(enough, count_where(F.col("_y"), test))

    return docs.select(
        *keep,
        F.when(enough, F.size("_y").cast("long")).alias("year_count"),
        years(lambda y: F.abs(y - this_year) <= 2).alias("near_now_years"),
        years(lambda y: (this_year - y) > 5).alias("historical_years"),
        years(lambda y: (y - this_year) > 2).alias("projection_years"),
        F.when(enough, F.col("_decades")).alias("decade_references"),
        F.when(enough, F.col("_projection")).alias("projection_phrases"),
        F.when(enough, F.col("_retro")).alias("retrospective_phrases"),
    )


def add_roles(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    enough = F.col("spaced_words") >= LONG_ENOUGH
    docs = docs.select(*keep, S.marked_text(F.col("text"), V.ROLES.values()).alias("_marked"))
    docs = docs.select(*keep, *[count_matches(F.col("_marked"), p).alias(f"role_{r}") for r, p in V.ROLES.items()])
    named = F.array_compact(
        F.array(*[F.when(F.col(f"role_{r}") > 0, F.lit(r)) for r in sorted(V.ROLES)])
    )
    silent = F.array_compact(F.array(*[F.when(F.col(f"role_{r}") == 0, F.lit(r)) for r in V.ROLES]))
    mentions = sum((F.col(f"role_{r}") for r in V.ROLES), F.lit(0))
    return docs.select(
        *keep,
        F.when(enough, named).alias("roles_named"),
        F.when(enough, silent).alias("roles_absent"),
        F.when(enough, F.size(named).cast("long")).alias("role_count"),
        F.when(enough, mentions).alias("role_mentions"),
    )


def role_rows(docs: DataFrame) -> DataFrame:
    """stakeholder_map(doc_id, role, mentions) of the roles that are named."""
    each = F.array(
        *[
            F.struct(F.lit(r).alias("role"), count_matches(F.col("_marked"), p).alias("mentions"))
            for r, p in V.ROLES.items()
        ]
    )
    return (
        add_spaced_words(docs.select("doc_id", "text"))
        .where(F.col("spaced_words") >= LONG_ENOUGH)
        .select("doc_id", S.marked_text(F.col("text"), V.ROLES.values()).alias("_marked"))
        .select("doc_id", F.explode(each).alias("r"))
        .select("doc_id", "r.role", "r.mentions")
        .where(F.col("mentions") > 0)
    )


def add_falsification(docs: DataFrame) -> DataFrame:
    keep = list(docs.columns)
    enough = F.col("spaced_words") >= LONG_ENOUGH
    pieces = F.filter(F.transform(T.cut_loosely(F.col("text")), T.strip), lambda s: s != "")
    kinds = F.transform(
        pieces,
        lambda s: F.when(has(s, V.FALSIFICATION), "primary").when(has(s, V.CONDITIONAL), "candidate"),
    )
    docs = docs.select(*keep, kinds.alias("_kinds"))
    return docs.select(
        *keep,
        F.when(enough, count_where(F.col("_kinds"), lambda k: k == "primary")).alias("falsification_count"),
        F.when(enough, count_where(F.col("_kinds"), lambda k: k == "candidate")).alias("conditional_count"),
    )


# -- genre --------------------------------------------------------------------

BORDERLINE_GENRE = 0.10


def add_genre(docs: DataFrame) -> DataFrame:
    """Needs `text`, `spaced_words`, `voice`, `total_claims`, `hedged_count`."""
    text = F.col("text")
    keep = list(docs.columns)
    marked = S.marked_text(text, (V.ALTERNATIVES, V.ADVOCACY, V.NARRATIVE))
    docs = docs.select(*keep, marked.alias("_marked"))
    docs = docs.select(
        *keep,
        count_matches(text, V.RECOMMENDATION).alias("_rec"),
        count_matches(text, V.INSTRUCTION).alias("_ins"),
        count_matches(F.col("_marked"), V.ALTERNATIVES).alias("_alt"),
        count_matches(F.col("_marked"), V.ADVOCACY).alias("_adv"),
        count_matches(F.col("_marked"), V.NARRATIVE).alias("_nar"),
    )
    marks = ("_rec", "_ins", "_alt", "_adv", "_nar")
    per = {
        m: F.when(F.col("spaced_words") > 0, F.col(m) * 1000.0 / F.col("spaced_words")).otherwise(F.lit(0.0))
        for m in marks
    }
    claims = F.col("total_claims")
    docs = docs.select(
        *keep,
        *marks,
        *[per[m].alias(f"{m}_kw") for m in marks],
        F.when(claims > 0, F.col("hedged_count") / claims).otherwise(F.lit(0.0)).alias("_hedge"),
    )
    voice = F.col("voice")
    rec, ins, alt, adv, nar = (F.col(f"{m}_kw") for m in marks)
    hedge = F.col("_hedge")

    def bonus(test: Column, points: float) -> Column:
        return F.when(test, F.lit(points)).otherwise(F.lit(0.0))

    scores = {
        "recommendation": rec * 2.0 + adv * 0.5
        + bonus(voice == "advisory", 1.0) + bonus(F.col("_rec") > 0, 5.0),
        "analysis": hedge * 5.0 + alt * 0.5 + bonus(voice == "analytical", 2.0),
        "narrative": nar * 1.5,
        "advocacy": adv * 2.0
        + F.when(claims > 0, (F.lit(1.0) - hedge) * 1.5).otherwise(F.lit(0.0))
        + bonus(voice.isin("advisory", "promotional"), 0.5)
        - rec * 0.5,
        "exploration": alt * 2.0 + hedge * 1.5 - rec * 0.7,
        "instruction": ins * 3.0 + bonus(voice == "advisory", 0.5),
    }
    docs = docs.select(
        *keep, *marks, *[F.greatest(scores[g], F.lit(0.0)).alias(f"_s_{g}") for g in V.GENRES]
    )
    whole = sum((F.col(f"_s_{g}") for g in V.GENRES[1:]), F.col(f"_s_{V.GENRES[0]}"))
    docs = docs.select(
        *keep,
        *[f"_s_{g}" for g in V.GENRES],
        whole.alias("_whole"),
        ((sum((F.col(m) for m in marks), F.lit(0)) > 0) & (whole > 0)).alias("_sure"),
    )
    shares = F.array(
        *[
            F.struct((-F.try_divide(F.col(f"_s_{g}"), F.col("_whole"))).alias("s"), F.lit(i).alias("i"), F.lit(g).alias("g"))
            for i, g in enumerate(V.GENRES)
        ]
    )
    docs = docs.select(*keep, "_sure", *[f"_s_{g}" for g in V.GENRES], "_whole", F.array_sort(shares).alias("_r"))
    first, second = F.col("_r")[0], F.col("_r")[1]
    margin = rounded(second["s"] - first["s"], 3)
    sure = F.col("_sure")
    return docs.select(
        *keep,
        F.when(sure, first["g"]).alias("genre"),
        F.when(sure, second["g"]).alias("genre_runner_up"),
        F.when(sure, margin).alias("genre_margin"),
        F.when(~sure, "low")
        .when(margin < BORDERLINE_GENRE, "borderline")
        .otherwise("high")
        .alias("genre_confidence"),
        *[
            F.when(sure, rounded(F.col(f"_s_{g}") / F.col("_whole"), 3)).otherwise(F.lit(0.0)).alias(f"genre_{g}")
            for g in V.GENRES
        ],
    )


# -- long tables of hits and sentence flags --------------------------------------


def with_hits(docs: DataFrame) -> DataFrame:
    """(doc_id, text, places): the hits of each document as array<struct<perspective, marker, start>>."""
    cut = docs.select("doc_id", "text", S.marked_clauses(F.col("text"), V.PERSPECTIVES.values()).alias("_clauses"))

    def hits(name: str, pattern: str) -> Column:
        return F.transform(
            S.spans_in(F.col("_clauses"), pattern),
            lambda h: F.struct(F.lit(name).alias("perspective"), S.normal_marker(h["marker"]).alias("marker"), h["start"].cast("long").alias("start")),
        )

    return cut.select("doc_id", "text", F.concat(*[hits(c, p) for c, p in V.PERSPECTIVES.items()]).alias("places"))


def hit_rows(docs: DataFrame, substantive: bool = False) -> DataFrame:
    """marker_hits(doc_id, perspective, marker, start, end), offsets counted from 0.

    With `substantive`, played-down and denied hits of the dismissible perspectives go."""
    text = F.col("text")
    cut = docs.select("doc_id", "text", S.marked_clauses(text, V.PERSPECTIVES.values()).alias("_clauses"))
    keep = cut.select("doc_id", "text", *[S.spans_in(F.col("_clauses"), p).alias(c) for c, p in V.PERSPECTIVES.items()])
    sets = []
    for c in CLASSES:
        hits = F.col(c)
        if substantive and c in V.DISMISSIBLE:
            hits = F.filter(hits, lambda h: ~S.dismissed(F.col("text"), h))
        sets.append(F.struct(F.lit(c).alias("perspective"), hits.alias("hits")))
    rows = (
        keep.select("doc_id", F.explode(F.array(*sets)).alias("s"))
        .select("doc_id", F.col("s.perspective").alias("perspective"), F.explode_outer("s.hits").alias("h"))
        .where(F.col("h").isNotNull())
    )
    return rows.select(
        "doc_id",
        "perspective",
        S.normal_marker(F.col("h.marker")).alias("marker"),
        F.col("h.start").cast("long").alias("start"),
        F.col("h.end").cast("long").alias("end"),
    )


def flagged_sentences(sentences: DataFrame) -> DataFrame:
    """sentences(+is_sourced, is_numeric)."""
    return sentences.select(
        "doc_id",
        "sent_no",
        is_sourced(F.col("sentence")).alias("is_sourced"),
        is_numeric(F.col("sentence")).alias("is_numeric"),
    )
