"""Numbers and numeric claims: mentions, claim sentences, how firmly they are put."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tessera.functions import spans as S, text as T, vocabulary as V
from tessera.functions.scalar import count_where, equals, find_all, first_of_each, has, kilowords, let, rounded

CONTEXT = 50
MENTIONS = (
    "array<struct<start:int,end:int,rank:int,form:string,type:string,value:string,raw:string>>"
)
WORD_COUNT_NOTE = r"(?i)word count|total words"


def _value(form: str, raw: Column) -> Column:
    """The number inside a raw mention, as text."""
    if form == "scaled_integer":
        number = F.regexp_extract(raw, r"^(\d+(?:\.\d+)?)", 1).cast("double")
        scale = F.lower(F.regexp_extract(raw, r"(?i)(thousand|million|billion|trillion)$", 1))
        factor = F.lit(V.SCALES["trillion"])
        for word in ("billion", "million", "thousand"):
            factor = F.when(scale == word, F.lit(V.SCALES[word])).otherwise(factor)
        return let(
            number * factor,
            lambda v: F.when(v == F.rint(v), v.cast("long").cast("string")).otherwise(v.cast("string")),
        )
    if form in ("dollar", "dollar_range"):
        return F.replace(F.regexp_extract(raw, r"(\d+(?:\.\d+)?(?:,\d{3})*)", 1), F.lit(","), F.lit(""))
    if form == "integer_comma":
        return F.replace(raw, F.lit(","), F.lit(""))
    if form in ("percentage", "multiplier"):
        return F.regexp_extract(raw, r"^(\d+(?:\.\d+)?)", 1)
    if form == "integer_suffix":
        return F.regexp_extract(raw, r"^(\d+)", 1)
    return raw


def _form_matches(text: Column, rank: int, form: str, kind: str, pattern: str) -> Column:
    return F.transform(
        S.spans(text, pattern),
        lambda h: F.struct(
            h["start"].alias("start"),
            h["end"].alias("end"),
            F.lit(rank).alias("rank"),
            F.lit(form).alias("form"),
            F.lit(kind).alias("type"),
            _value(form, h["marker"]).alias("value"),
            h["marker"].alias("raw"),
        ),
    )


def _take_free(matches: Column):
    """Append the matches that neither start nor end inside one already taken."""

    def step(taken: Column) -> Column:
        def free(x: Column) -> Column:
            return ~F.exists(
                taken,
                lambda y: ((y["start"] <= x["start"]) & (x["start"] < y["end"]))
                | ((y["start"] < x["end"]) & (x["end"] <= y["end"])),
            )

        return F.concat(taken, F.filter(matches, free))

    return step


#: Stretches that no number reaches into: from a word after a word up to the last letter before
#: the next digit. A mention holds one word at most, and looks one character behind its start.
NO_NUMBERS = r"([A-Za-z]\s)([A-Za-z]\D*)(?=[A-Za-z])"


def _typed_in(text: Column) -> Column:
    """The mentions of one stretch of text, in order of (priority, place)."""
    # All forms are matched before any is taken: nested one in the other, they would be more
    # than the analyzer follows.
    found = F.array(*[_form_matches(text, rank, *form) for rank, form in enumerate(V.TEXT_NUMBERS)])

    def take(matches: Column) -> Column:
        taken = matches[0]
        for rank in range(1, len(V.TEXT_NUMBERS)):
            taken = let(taken, _take_free(matches[rank]))
        return taken

    return let(found, take)


def typed_numbers(text: Column) -> Column:
    """array of number mentions in order of (priority, place).

    The forms go by priority: a match is dropped if it starts or ends inside one
    that an earlier form has taken.  Matches of one form never overlap, so each
    form only has to look at the forms before it.

    The text is cut at the stretches without numbers, and the forms are sought in the
    pieces between them that have digits, so that one pass reads the whole text."""
    cut = F.split(F.regexp_replace(text, NO_NUMBERS, f"$1{S.OPEN}$2{S.CLOSE}"), S.OPEN)

    def pieces(parts: Column) -> Column:
        # without the fence that each part but the first has
        lengths = F.transform(parts, lambda p, k: F.length(p) - F.when(k > 0, F.lit(1)).otherwise(F.lit(0)))
        placed = let(
            S.running_sums(lengths),
            lambda starts: F.transform(
                parts,
                lambda p, k: F.struct(
                    F.when(k > 0, F.substring_index(p, S.CLOSE, -1)).otherwise(p).alias("text"), starts[k + 1].alias("end")
                ),
            ),
        )
        return F.filter(placed, lambda p: p["text"].rlike(r"\d"))

    def mentions(piece: Column) -> Column:
        at = piece["end"] - F.length(piece["text"])
        return let(
            at,
            lambda a: F.transform(
                let(piece["text"], _typed_in),
                lambda n: F.struct(
                    (n["start"] + a).alias("start"), (n["end"] + a).alias("end"), *[n[c].alias(c) for c in ("rank", "form", "type", "value", "raw")]
                ),
            ),
        )

    def in_order(found: Column) -> Column:
        keyed = F.sort_array(F.transform(found, lambda n, i: F.struct(n["rank"].alias("rank"), i.alias("i"))))
        return F.transform(keyed, lambda k: found[k["i"]])

    found = F.flatten(F.transform(let(cut, pieces), mentions))
    return F.when(text.rlike(r"\d"), let(found, in_order)).otherwise(F.array().cast(MENTIONS))


def is_year(value: Column) -> Column:
    number = value.try_cast("long")
    return F.coalesce(
        value.rlike(r"^\d+$") & number.between(V.YEAR_LOW, V.YEAR_HIGH), F.lit(False)
    )


def near_word_count(text: Column, notes: Column, raw: Column) -> Column:
    """Does the raw number stand, anywhere in the text, next to a word-count note?

    `notes` are the spans of those notes; a number belongs to a note if it starts
    no more than 60 characters before its end of reach."""
    return F.exists(
        notes,
        lambda p: F.contains(
            F.substring(
                text,
                F.greatest(p["end"] - F.length(raw) - 20, F.lit(0)) + 1,
                p["start"] + 60 + F.length(raw) - F.greatest(p["end"] - F.length(raw) - 20, F.lit(0)),
            ),
            raw,
        ),
    )


def data_numbers(numbers: Column, text: Column) -> Column:
    """Number mentions that are neither years nor word counts."""
    return let(
        S.spans(text, WORD_COUNT_NOTE),
        lambda notes: F.filter(
            numbers, lambda n: ~is_year(n["value"]) & ~near_word_count(text, notes, n["raw"])
        ),
    )


def context(text: Column, start: Column, end: Column) -> Column:
    a = F.greatest(start - CONTEXT, F.lit(0))
    return F.regexp_replace(T.strip(F.substring(text, a + 1, end + CONTEXT - a)), r"\s+", " ")


def with_numbers(docs: DataFrame) -> DataFrame:
    """Add `all_numbers` (typed mentions) and `numbers` (years and word counts gone)."""
    docs = docs.select("*", typed_numbers(F.col("text")).alias("all_numbers"))
    return docs.select("*", data_numbers(F.col("all_numbers"), F.col("text")).alias("numbers"))


def number_mentions(docs: DataFrame, which: str = "all_numbers") -> DataFrame:
    docs = with_numbers(docs.select("doc_id", "text"))
    return (
        docs.select("doc_id", "text", F.posexplode_outer(which).alias("mention_no", "m"))
        .where(F.col("m").isNotNull())
        .select(
            "doc_id",
            F.col("mention_no").cast("long"),
            F.col("m.form").alias("form"),
            F.col("m.type").alias("type"),
            F.col("m.value").alias("value"),
            F.col("m.raw").alias("raw"),
            F.col("m.start").cast("long").alias("start"),
            F.col("m.end").cast("long").alias("end"),
            context(F.col("text"), F.col("m.start"), F.col("m.end")).alias("context"),
        )
    )


# -- claim sentences ------------------------------------------------------------


def sentence_numbers(sentence: Column) -> Column:
    """array<struct<type, value, raw>> in order of form, then place."""

    def found(kind: str, pattern: str) -> Column:
        return F.transform(
            find_all(sentence, pattern),
            lambda raw: F.struct(
                F.lit(kind).alias("type"),
                F.replace(F.regexp_extract(raw, pattern, 1), F.lit(","), F.lit(""))
                .try_cast("double")
                .alias("value"),
                T.strip(raw).alias("raw"),
            ),
        )

    return F.concat(*[found(kind, pattern) for kind, pattern in V.SENTENCE_NUMBERS])


def with_sentence_claims(docs: DataFrame) -> DataFrame:
    """Add `sentence_claims`: sentences with typed numbers.  Needs `sentences`."""
    keep = list(docs.columns)
    marked = F.transform(
        F.filter("sentences", lambda s: s["sentence"].rlike(r"\d")),
        lambda s: F.struct(
            s["sentence"].alias("sentence"),
            s["heading"].alias("heading"),
            s["para_no"].alias("para_no"),
            sentence_numbers(s["sentence"]).alias("numbers"),
        ),
    )
    return docs.select(*keep, F.filter(marked, lambda c: F.size(c["numbers"]) > 0).alias("sentence_claims"))


def numeric_claim_sentences(docs: DataFrame) -> DataFrame:
    from tessera.operators.text_tables import with_sentences

    docs = with_sentence_claims(with_sentences(docs.select("doc_id", "text")))
    return (
        docs.select("doc_id", F.posexplode_outer("sentence_claims").alias("claim_no", "c"))
        .where(F.col("c").isNotNull())
        .select(
            "doc_id",
            F.col("claim_no").cast("long"),
            F.col("c.sentence").alias("sentence"),
            F.col("c.heading").alias("heading"),
            F.col("c.para_no").cast("long").alias("para_no"),
            F.size("c.numbers").cast("long").alias("n_numbers"),
            F.array_join(F.transform("c.numbers", lambda n: F.concat_ws(":", n["type"], n["raw"])), "|").alias(
                "numbers"
            ),
        )
    )


def causal_sentences(docs: DataFrame) -> DataFrame:
    from tessera.operators.text_tables import sentences

    found = sentences(docs).select(
        "doc_id", "sent_no", find_all(F.col("sentence"), V.CAUSAL_SENTENCE).alias("m")
    )
    return found.where(F.size("m") > 0).select(
        "doc_id",
        "sent_no",
        F.size("m").cast("long").alias("n_markers"),
        F.array_join(F.transform("m", lambda x: T.strip(F.lower(x))), "|").alias("markers"),
    )


CLAIM = (
    "array<struct<sentence:string,heading:string,bullet:boolean,"
    "numbers:array<struct<type:string,value:double,raw:string>>>>"
)


def with_claims(docs: DataFrame) -> DataFrame:
    """Add `claims`: claim sentences, then numbers no claim sentence covers.

    Needs `text`, `numbers`, `sentence_claims`."""
    keep = list(docs.columns)
    real = F.filter(
        "sentence_claims",
        lambda c: ~F.forall(c["numbers"], lambda n: F.startswith(n["raw"], F.lit("000"))),
    )
    docs = docs.select(
        *keep,
        F.transform(
            real,
            lambda c: F.struct(
                c["sentence"].alias("sentence"),
                c["heading"].alias("heading"),
                F.lit(False).alias("bullet"),
                c["numbers"].alias("numbers"),
            ),
        ).alias("_real"),
    )
    covered = F.flatten(F.transform("_real", lambda c: F.transform(c["numbers"], lambda n: n["value"])))

    def fresh(values: Column) -> Column:
        """Numbers outside every claim sentence that do not close a range."""
        with_context = F.transform(
            F.filter(
                "numbers", lambda n: ~F.coalesce(F.array_contains(values, n["value"].try_cast("double")), F.lit(False))
            ),
            lambda n: F.struct(
                n["type"].alias("type"),
                n["value"].try_cast("double").alias("value"),
                n["raw"].alias("raw"),
                context(F.col("text"), n["start"], n["end"]).alias("context"),
            ),
        )
        return F.filter(
            with_context,
            lambda n: ~F.exists(
                find_all(n["context"], r"\d\s*[-–]\s*(?=(.*))", 1),
                lambda rest: F.startswith(rest, n["raw"]),
            ),
        )

    once = first_of_each(let(covered, fresh), lambda n: n["value"])

    def tight(n: Column) -> Column:
        at = F.call_function("instr", n["context"], n["raw"]) - 1
        a = F.greatest(at - 30, F.lit(0))
        return F.when(at < 0, n["context"]).otherwise(
            T.strip(F.substring(n["context"], a + 1, at + F.length(n["raw"]) + 30 - a))
        )

    bullets = F.transform(
        once,
        lambda n: F.struct(
            tight(n).alias("sentence"),
            F.lit("").alias("heading"),
            F.lit(True).alias("bullet"),
            F.array(F.struct(n["type"].alias("type"), n["value"].alias("value"), n["raw"].alias("raw"))).alias(
                "numbers"
            ),
        ),
    )
    docs = docs.select(*keep, F.concat(F.col("_real").cast(CLAIM), bullets.cast(CLAIM)).alias("_all"))
    put = F.transform(
        "_all",
        lambda c: F.struct(
            c["sentence"].alias("sentence"),
            c["heading"].alias("heading"),
            c["bullet"].alias("bullet"),
            c["numbers"].alias("numbers"),
            F.when(~c["bullet"] & has(c["sentence"], V.CLAIM_HEDGE), "hedged")
            .when(~c["bullet"] & has(c["sentence"], V.PREDICTION), "prediction")
            .otherwise("stated_as_fact")
            .alias("framing"),
            (~c["bullet"] & has(c["sentence"], V.PREDICTION)).alias("is_prediction"),
            F.exists(c["numbers"], lambda n: has(n["raw"], V.HIGH_PRECISION)).alias("high_precision"),
        ),
    )
    return docs.select(*keep, put.alias("claims"))


def claim_noise(docs: DataFrame) -> DataFrame:
    """(doc_id, n_cut_off, n_range_ends, n_repeats): what with_claims() leaves out of a document, by its reason.

    Needs `text`, `numbers`, `sentence_claims`: claim sentences whose numbers are all tails of longer
    ones, numbers outside every claim that close a range, and those whose value came before."""
    cut_off = lambda c: F.forall(c["numbers"], lambda n: F.startswith(n["raw"], F.lit("000")))
    rows = docs.select(
        "doc_id", "text", "numbers",
        F.filter("sentence_claims", cut_off).alias("_cut"),
        F.flatten(F.transform(F.filter("sentence_claims", lambda c: ~cut_off(c)), lambda c: F.transform(c["numbers"], lambda n: n["value"]))).alias("_covered"),
    )

    def left(values: Column) -> Column:
        return F.filter("numbers", lambda n: ~F.coalesce(F.array_contains(values, n["value"].try_cast("double")), F.lit(False)))

    rows = rows.select("doc_id", "text", "_cut", let(F.col("_covered"), left).alias("_left"))

    def closes(n: Column) -> Column:
        return F.exists(find_all(context(F.col("text"), n["start"], n["end"]), r"\d\s*[-–]\s*(?=(.*))", 1), lambda rest: F.startswith(rest, n["raw"]))

    ends = F.transform("_left", lambda n: F.struct(n["value"].try_cast("double").alias("value"), closes(n).alias("closes")))
    rows = rows.select("doc_id", F.size("_cut").cast("long").alias("n_cut_off"), ends.alias("_ends"))
    kept = F.transform(F.filter("_ends", lambda e: ~e["closes"] & e["value"].isNotNull()), lambda e: e["value"])
    return rows.select(
        "doc_id", "n_cut_off", count_where(F.col("_ends"), lambda e: e["closes"]).alias("n_range_ends"), (F.size(kept) - F.size(F.array_distinct(kept))).cast("long").alias("n_repeats")
    )


NUMBER_TYPES = ("percentage", "dollar", "multiplier", "decimal", "integer")


def add_claim_stats(docs: DataFrame) -> DataFrame:
    """Counts over `claims`; risk level over the counts.  Needs `words`, `claims`."""
    keep = list(docs.columns)
    c = F.col("claims")
    hinted = count_where(
        c,
        lambda x: (x["framing"] != "hedged") & ~x["bullet"] & has(x["sentence"], V.CLAIM_HEDGE_HINT),
    )
    kinds = F.flatten(
        F.transform(
            c,
            lambda x: F.transform(
                x["numbers"], lambda n: F.when(n["type"] == "entity_count", "integer").otherwise(n["type"])
            ),
        )
    )
    docs = docs.select(
        *keep,
        F.size(c).cast("long").alias("total_claims"),
        *[
            count_where(F.transform(c, lambda x: x["framing"]), equals(f)).alias(n)
            for f, n in (
                ("hedged", "hedged_count"),
                ("stated_as_fact", "unhedged_count"),
                ("prediction", "prediction_count"),
            )
        ],
        count_where(c, lambda x: x["high_precision"]).alias("high_precision_count"),
        hinted.alias("candidate_hedge_count"),
        kinds.alias("_kinds"),
    )
    docs = docs.select(
        *[x for x in docs.columns if x != "_kinds"],
        *[count_where(F.col("_kinds"), equals(t)).alias(f"claims_{t}") for t in NUMBER_TYPES],
    )
    n = F.col("total_claims")
    return docs.select(
        "*", F.when(n > 0, rounded(F.col("unhedged_count") / n, 3)).alias("confidence_uniformity")
    )


def add_claim_risk(docs: DataFrame) -> DataFrame:
    n = F.col("total_claims")
    share = F.col("unhedged_count") / F.greatest(n, F.lit(1))
    docs = docs.select(
        "*",
        ((n > 0) & (n / kilowords(F.col("words")) > 30)).alias("risk_density"),
        ((n >= 5) & (share > 0.85)).alias("risk_uniform"),
        ((n > 0) & (F.col("high_precision_count") > n * 0.3)).alias("risk_precision"),
        (F.col("prediction_count") > 0).alias("risk_prediction"),
    )
    flags = sum(
        (F.col(c).cast("int") for c in ("risk_density", "risk_uniform", "risk_precision", "risk_prediction")),
        F.lit(0),
    )
    return docs.select(
        "*",
        F.when(n == 0, "info")
        .when(flags >= 3, "high")
        .when(flags >= 1, "moderate")
        .otherwise("low")
        .alias("risk_level"),
    )


def claim_rows(docs: DataFrame) -> DataFrame:
    """claims(doc_id, claim_no, …), one row per claim."""
    return (
        docs.select("doc_id", F.posexplode_outer("claims").alias("claim_no", "c"))
        .where(F.col("c").isNotNull())
        .select("doc_id", F.col("claim_no").cast("long"), "c.*")
    )


# -- normalised values ------------------------------------------------------------


def shown_numbers(claim: Column) -> Column:
    """All raw numbers of a claim, cut-off suffixes tidied: `$2.47 b` → `$2.47B`."""

    def tidy(raw: Column) -> Column:
        short = F.regexp_extract(raw, r"\s+([bBmMkKtT])$", 1)
        cut = F.regexp_extract(raw, r"\s+(bi|mi|tr)$", 1)
        return (
            F.when(short != "", F.concat(F.regexp_replace(raw, r"\s+[bBmMkKtT]$", ""), F.upper(short)))
            .when(cut != "", F.concat(F.regexp_replace(raw, r"\s+(?:bi|mi|tr)$", ""), F.upper(F.substring(cut, 1, 1))))
            .otherwise(raw)
        )

    return F.transform(claim["numbers"], lambda n: tidy(n["raw"]))


def plain_number(raw: Column) -> Column:
    """Number text without sign of currency, unit and commas; NULL if no number is left."""
    bare = T.strip(F.replace(F.regexp_replace(F.regexp_replace(T.strip(raw), r"^[$~]", ""), r"[%xXBMK]$", ""), F.lit(","), F.lit("")))
    return F.when(bare.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)$"), bare)


def number_set(claims: Column) -> Column:
    """Distinct plain numbers of all claims of a document."""
    return F.sort_array(
        F.array_distinct(
            F.array_compact(
                F.transform(F.flatten(F.transform(claims, lambda c: shown_numbers(c))), plain_number)
            )
        )
    )


# A number with its sign, currency, scale and percent sign, and the scales
MAGNITUDE = (
    r"([-−]?)\s*(?:[$€£¥₹])?\s*([-−]?)\s*(\d[\d,]*(?:\.\d+)?)([BMKTbmkt])?"
    r"(?:\s+(billion|million|thousand|trillion|bn|mn|tr))?\s*(%)?"
)
SCALE_WORDS = {
    "billion": 1e9, "bn": 1e9, "b": 1e9, "million": 1e6, "mn": 1e6, "m": 1e6,
    "thousand": 1e3, "k": 1e3, "trillion": 1e12, "tr": 1e12, "t": 1e12,
}


def stability_key(raw: Column) -> Column:
    """Magnitude of the first number: `$2.47 billion` and `2.47B` meet in 2470000000."""

    def part(i: int) -> Column:
        return F.regexp_extract(raw, MAGNITUDE, i)

    scale = F.lower(F.when(part(5) != "", part(5)).otherwise(part(4)))
    factor = F.lit(1.0)
    for word, f in SCALE_WORDS.items():
        factor = F.when(scale == word, F.lit(f)).otherwise(factor)
    sign = F.when((part(1) != "") | (part(2) != ""), F.lit(-1.0)).otherwise(F.lit(1.0))
    value = F.replace(part(3), F.lit(","), F.lit("")).try_cast("double") * factor * sign
    key = let(
        value,
        lambda v: F.when(v == F.rint(v), v.cast("long").cast("string")).otherwise(v.cast("string")),
    )
    return F.when(raw.rlike(r"\d"), F.concat(key, part(6)))


def number_type(raw: Column) -> Column:
    return (
        F.when(F.contains(raw, F.lit("%")), "percentage")
        .when(raw.rlike(r"[$€£¥₹]"), "dollar")
        .when(raw.rlike(r"(?i)\d+x\b"), "multiplier")
        .when(F.contains(raw, F.lit(".")), "decimal")
        .otherwise("integer")
    )


# Scale words for base units, and words that only qualify
QUALIFIER = (
    r"(?i)^(?:approximately|approx\.?|roughly|about|around|nearly|over|under|more than|less than"
    r"|up to|at least)\s+"
)
SENTENCE_SCALE = r"(?i)(\d+(?:[.,]\d+)?)\s+(trillion|billion|million|thousand|bn|mn|mil)\b"
UNIT_SCALES = {
    "t": 1e12, "trillion": 1e12, "b": 1e9, "billion": 1e9, "bn": 1e9,
    "m": 1e6, "million": 1e6, "mn": 1e6, "mil": 1e6, "k": 1e3, "thousand": 1e3,
}


def _factor(word: Column) -> Column:
    factor = F.lit(None).cast("double")
    for w, f in UNIT_SCALES.items():
        factor = F.when(word == w, F.lit(f)).otherwise(factor)
    return factor


def normal_value(raw: Column, sentence: Column) -> Column:
    """A raw number in base units; the scale may stand at the number, or next to the
    same number in its sentence.  0.0 if there is no number."""
    bare = F.regexp_replace(T.strip(raw), QUALIFIER, "")
    bare = F.replace(F.regexp_replace(F.regexp_replace(bare, r"^[$€£¥₹~]+", ""), r"%+$", ""), F.lit(","), F.lit(""))
    suffix = F.lower(F.regexp_extract(F.regexp_replace(T.strip(raw), r"\.+$", ""), r"(?i:bn|mn)$|[TBMKk]$", 0))
    word = F.lower(F.regexp_extract(bare, r"(?i)\b(trillion|billion|million|thousand)\b", 1))
    number = (
        F.when(suffix != "", F.regexp_replace(bare, r"(?:(?i:bn|mn)|[TBMKk])$", ""))
        .when(word != "", T.strip(F.regexp_replace(bare, r"(?is)\b(?:trillion|billion|million|thousand)\b.*$", "")))
        .otherwise(bare)
    )
    base = T.strip(number).try_cast("double")
    own = F.when(suffix != "", _factor(suffix)).when(word != "", _factor(word))

    def nearby(b: Column) -> Column:
        fits = F.filter(
            find_all(sentence, SENTENCE_SCALE),
            lambda m: let(
                F.replace(F.regexp_extract(m, SENTENCE_SCALE, 1), F.lit(","), F.lit("")).try_cast("double"),
                lambda x: F.abs(x - b) < F.greatest(F.abs(x), F.lit(1.0)) * 0.01,
            ),
        )
        return _factor(F.lower(F.regexp_extract(F.try_element_at(fits, F.lit(1)), SENTENCE_SCALE, 2)))

    return let(
        base,
        lambda b: F.when(b.isNull(), F.lit(0.0)).otherwise(b * F.coalesce(own, nearby(b), F.lit(1.0))),
    )
