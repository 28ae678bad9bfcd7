"""Subjects, headings, evidence, near copies, lexicons and ranks on small tables, beside brute force."""

import itertools
import random
import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import evidence as E, facts as K, lexicon as L, located as O, near, ranks, subjects as J

COUNTRY = r"(?i)\b(?:atlantis)\b"


@pytest.fixture(scope="module")
def held(spark):
    """Documents that name the subject of their figure in each of the seven places, and nowhere."""
    small = "The harbor and the market and the revenue. the price the sales reached growth output in the house of the crew by day. "
    texts = {
        1: ("", "# Norsk Hydro\n\nThe revenue reached $12 million in the second year."),
        2: ("", "# overview\n\nThe revenue of Atlantis reached $12 million in the year."),
        3: ("", "# overview\n\nThe revenue of TSMC reached $12 million in the second year."),
        4: ("", "# overview\n\nThe revenue of Samsung reached $12 million in the second year."),
        5: ("", "Northwind sells. Northwind buys.\n\n# overview\n\nThe revenue reached $12 million in the second year."),
        6: ("", "All of it is about Oslo only.\n\n# overview\n\nThe revenue reached $12 million in the second year."),
        7: ("Baltic trade", "# overview\n\nThe revenue reached $12 million in the second year."),
        8: ("", "# overview\n\nThe revenue reached $12 million in the second year."),
        9: ("", "The GDP and the CEO said so.\n\n# key findings\n\nThe revenue reached $12 million in the second year."),
    }
    rows = [(i, topic, text) for i, (topic, text) in texts.items()] + [(100, "", small + "overview of all, it is about only so, second year said.")]
    docs = spark.createDataFrame(rows, "doc_id long, topic string, text string")
    return docs, J.document_claims(docs, COUNTRY)


def test_the_seven_places_of_a_subject(spark, held):
    docs, rows = held
    common = J.common_words(docs)
    words = {r.word for r in common.collect()}
    assert {"the", "revenue", "harbor"} <= words and not words & {"samsung", "northwind", "oslo"}
    entities = J.primary_entity(rows, common)
    assert {(r.doc_id, r.entity, r.mentions) for r in entities.collect()} >= {(5, "Northwind", 2)}
    claims = J.with_found_headings(J.claim_table(rows), rows)
    got = {r.doc_id: (r.tier, r.subject) for r in J.claim_subjects(claims, entities, common, COUNTRY).collect()}
    assert got == {
        1: (1, "Norsk Hydro"), 2: (2, "ATLANTIS"), 3: (3, "TSMC"), 4: (4, "Samsung"), 5: (5, "Northwind"), 6: (6, "Oslo"), 7: (7, "Baltic trade"), 8: (0, ""), 9: (0, ""),
    }


def test_names_by_their_form(spark):
    common = spark.createDataFrame([("customer",), ("our",), ("cloud",)], "word string")
    names = ["Tesla", "Novo Nordisk", "TSMC", "Customer", "Our Cloud", "GDP", "ROI", "AI", "we", "", "42", None, "Customer Tesla"]
    got = {r.subject: r.entity_like for r in J.entity_like(spark.createDataFrame([(n,) for n in names], "subject string"), common).collect()}
    assert {n for n, x in got.items() if x} == {"Tesla", "Novo Nordisk", "TSMC", "Customer Tesla"} and None not in got


def test_numbers_take_the_heading_over_them(spark):
    text = "Early 41 pots.\n\n## First 77\n\nThere are 52 pots.\n\n#\n\n63 pots.\n\n## Last\n\nAgain 41 and 77 pots and 52."
    rows = J.document_claims(spark.createDataFrame([(1, "", text), (2, "", "No heading, 88 pots."), (3, "", "")], "doc_id long, topic string, text string"), COUNTRY)
    got = {(r.doc_id, r.raw): r.found_heading for r in J.number_headings(rows).collect()}
    # A number in a heading line or under an empty heading has none there; the first place that has one counts.
    assert got == {(1, "41"): "Last", (1, "77"): "Last", (1, "52"): "First 77"}


def test_headings_of_long_documents(spark):
    def took(n):
        text = "\n".join(f"# Part {k}\n\n{k + 10_000} tons." for k in range(n))
        row = spark.createDataFrame([(1, [(f"{k + 10_000}", 0) for k in range(n)], [])], "doc_id long, places array<struct<raw:string,at:int>>, headings array<struct<at:int,end:int,title:string>>")
        at, places, headings = 0, [], []
        for k, part in enumerate(text.split("\n# ")):
            size = len(f"Part {k}") + 2
            headings.append((at, at + size, f"Part {k}"))
            places.append((f"{k + 10_000}", at + size + 2))
            at += size + 2 + len(f"{k + 10_000} tons.") + 1
        row = spark.createDataFrame([(1, places, headings)], row.schema)
        start = time.time()
        got = {r.raw: r.found_heading for r in J.number_headings(row).collect()}
        assert got == {f"{k + 10_000}": f"Part {k}" for k in range(n)}
        return time.time() - start

    took(100)
    assert took(10_000) < 20


def test_parts_of_titles_against_brute_force(spark):
    random.seed(3)
    titles = [(f"T{k}", "".join(random.choices("XY Z", k=random.randrange(1, 9)))) for k in range(60)] + [("N1", "Lattice Semiconductor"), ("N2", "")]
    names = {"".join(random.choices("XY Z", k=random.randrange(7))) for _ in range(80)} | {"SEMICONDUCTOR", "LATTICE", "THE LATTICE SEMICONDUCTOR OF OLD", "QQQ"}
    got = {r.name: r.best.ticker for r in K.parts_of_titles(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame(titles, "ticker string, title string")).collect()}
    want = {}
    for n in names:
        fits = [(len(t), k) for k, t in ((k, t.upper()) for k, t in titles) if t and (n in t or t in n)]
        if len(n) >= 3 and fits and (" " in n or n.lower() not in K.COMMON_NOUNS):
            want[n] = min(fits)[1]
    assert got == want and "SEMICONDUCTOR" not in got and got["LATTICE"] == "N1"


def evidence(spark, claims, texts):
    fields = ("claim_id", "provider", "entity", "subject", "sentence", "raw", "value", "metric", "unit", "time_period")
    rows = [tuple(({"provider": "encyclopedia", "entity": "e", "subject": "", "metric": "", "unit": "count", "time_period": ""} | c).get(f) for f in fields) for c in claims]
    frame = spark.createDataFrame(rows, ", ".join(f"{f} {'double' if f == 'value' else 'string'}" for f in fields))
    numbers = E.text_numbers(spark.createDataFrame(texts, "text_id string, kind string, entity string, text string"))
    return {r.claim_id: (r.match_type, r.fact_value, r.text_id) for r in E.match_texts(frame, numbers).collect()}


def test_claims_against_texts(spark):
    texts = [
        ("t", "encyclopedia", "e", "Founded in 1929, the firm had revenue of $60.922B in 2023 and employed 3.8M people; the fee is 80% of sales, 0.5 and 7,250 units."),
        ("p", "physical", "e", "The bridge weighs 1,250 kg."),
        ("other", "encyclopedia", "f", "Revenue was 500 in all."),
    ]
    claims = [
        dict(claim_id="exact", sentence="The firm had revenue of $60.9 billion.", raw="$60.9 billion", value=60.9e9, metric="revenue", unit="currency"),
        dict(claim_id="close", sentence="The firm sold 7,500 units.", raw="7,500", value=7500.0),
        dict(claim_id="far", sentence="The firm sold 9,500 units.", raw="9,500", value=9500.0),
        dict(claim_id="year", sentence="It was founded in 1943.", raw="1943", value=1943.0),
        dict(claim_id="same year", sentence="The firm was founded in 1929.", raw="1929", value=1929.0),
        dict(claim_id="percent", sentence="The fee is 80% of sales.", raw="80%", value=80.0, unit="percent"),
        dict(claim_id="idle percent", sentence="Of gains 80% came late though nobody knew why that was.", raw="80%", value=80.0, unit="percent"),
        dict(claim_id="other entity", sentence="Revenue was 500 in all.", raw="500", value=500.0),
        dict(claim_id="zero", sentence="It sold 0 units.", raw="0", value=0.0),
        dict(claim_id="negative", sentence="It sold -7,250 units.", raw="-7,250", value=-7250.0),
        dict(claim_id="heavy", provider="physical", sentence="The bridge weighs 1,250 kg.", raw="1,250", value=1250.0, metric="weight", unit="mass"),
    ]
    got = evidence(spark, claims, texts)
    assert got == {
        "exact": ("exact", 60.922e9, "t"), "close": ("close", 7250.0, "t"), "same year": ("exact", 1929.0, "t"), "percent": ("exact", 80.0, "t"), "heavy": ("exact", 1250.0, "p"),
    }


def test_copies_of_a_claim_are_looked_up_once(spark):
    """A claim of many documents is one class, and each of them takes the best text that is not its own."""
    texts = [(str(k), "web", w, f"Of all crews the port sold {n} units to Oslo and Bergen.") for k, n in ((0, 7250), (1, 7300), (2, 7400)) for w in ("oslo", "bergen")]
    numbers = E.text_numbers(spark.createDataFrame(texts, "text_id string, kind string, entity string, text string"))
    asked = [(f"{k}-0", k, "Oslo Bergen", "The port sold 7,250 units.", "7,250", 7250.0, "", "count", "") for k in range(40)]
    asked.append(("50-0", 50, "Oslo Bergen", "The port sold 7,390 units.", "7,390", 7390.0, "", "count", ""))
    claims = E.word_claims(spark.createDataFrame(asked, "claim_id string, doc_id long, subject string, sentence string, raw string, value double, metric string, unit string, time_period string"))
    assert E.claim_classes(claims).select("class_id").distinct().count() == 2
    got = {r.claim_id: (r.text_id, r.fact_value) for r in E.match_texts(claims, numbers).collect()}
    assert got == {f"{k}-0": ("0", 7250.0) if k else ("1", 7300.0) for k in range(40)} | {"50-0": ("2", 7400.0)}


def test_copies_of_a_claim_are_taken_apart_alike(spark):
    rows = [(f"{k}", "Sales of 2021" if k % 2 else None, "In Q2 2023 the firm reported revenue of $12 million.", "$12 million") for k in range(30)] + [("last", "", "It weighs 5 kg.", "5")]
    claims = spark.createDataFrame(rows, "claim_id string, heading string, sentence string, raw string")
    got, want = K.decompose_copies(claims, 2026), K.decompose(claims, 2026)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 31


def test_open_claims_are_the_first_of_a_document(spark):
    rows = [(d, n, "unverifiable" if n % 2 else "verified", n != 3, 1.0) for d in (1, 2) for n in range(20)]
    got = E.open_claims(spark.createDataFrame(rows, "doc_id long, claim_no long, verdict string, entity_like boolean, value double")).collect()
    assert sorted((r.doc_id, r.claim_no) for r in got) == [(d, n) for d in (1, 2) for n in (1, 5, 7, 9, 11)]


def test_near_copies_against_all_pairs(spark):
    random.seed(7)
    words = ["harbor", "quay", "crane", "tide", "rope", "mast", "hull", "deck", "sail", "bow"]
    base = [" ".join(random.choices(words, k=random.randrange(1, 200))) for _ in range(40)]
    texts = base + [t[: len(t) // 2] + "x" + t[len(t) // 2 :] for t in base] + base[:5] + ["", "", None]
    rows = spark.createDataFrame([*enumerate(texts), (None, "no id")], "doc_id long, text string").repartition(4)

    def distance(a, b):
        last = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            now = [i]
            for j, y in enumerate(b, 1):
                now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
            last = now
        return last[-1]

    first = {}
    for i, t in enumerate(texts):
        if t is not None:
            first.setdefault(t, i)
    want = set()
    for (a, i), (b, j) in itertools.combinations(first.items(), 2):
        longest = max(len(a), len(b), 1)
        if min(len(a), len(b)) >= 0.95 * longest and len(a) and 1 - distance(a, b) / longest >= 0.95:
            want.add((min(i, j), max(i, j)))
    got = {(r.a_id, r.b_id) for r in near.near_copy_pairs(near.classes(rows)).collect()}
    assert got <= want and len(got) >= 0.9 * len(want) and len(want) >= 30
    members = {r.doc_id: (r.class_id, r.copies, r.n_similar) for r in near.near_copies(rows).collect()}
    assert set(members) == {i for i, t in enumerate(texts) if t is not None}
    assert all(members[i][0] == first[t] for i, t in enumerate(texts) if t is not None)
    assert members[0][1] == 2 and all(members[i][2] == sum(first[t] in p for p in got) for i, t in enumerate(texts) if t is not None)


def test_rows_of_a_lexicon_change_what_is_covered(spark):
    docs = spark.createDataFrame([(1, "Worries and tensions at the quay."), (2, "The public record and the public."), (3, "")], "doc_id long, text string")
    user = spark.createDataFrame([("risks", r"(?i)\b(?:worries|tensions)\b", None), ("public", r"(?i)\bthe\s+public\b", r"\s+record"), ("public", "", None), (None, "x", None)], L.LEXICON)
    before = {(r["class"], r.doc_id): r.covered for r in L.lexicon_coverage(docs, L.load_lexicon(spark)).collect()}
    after = {(r["class"], r.doc_id): (r.hits, r.covered) for r in L.lexicon_coverage(docs, L.load_lexicon(spark).unionByName(user)).collect()}
    assert not before["risks", 1] and after["risks", 1] == (2, True) and after["public", 2] == (1, False)
    assert L.lexicon_coverage(docs, user.limit(0)).count() == 0
    with pytest.raises(ValueError):
        L.patterns(spark.createDataFrame([("a", r"(\d)\1", None)], L.LEXICON))


def test_numbers_and_ranks_over_ranges(spark):
    rows = spark.createDataFrame([(k * 7919 % 1009,) for k in range(1009)], "k long").repartition(5)
    got = {r.k: r.number for r in ranks.numbered(rows, "k").collect()}
    assert got == {k: k for k in range(1009)}
    values = [(g, v, random.randrange(1, 50)) for g in ("a", "b") for v in range(200)]
    got = {(r.g, r.v): r.rank for r in ranks.average_ranks(spark.createDataFrame(values, "g string, v int, n long").repartition(7), ["g"], "v", "n", "rank").collect()}
    for g in ("a", "b"):
        before = 0
        for _, v, n in (x for x in values if x[0] == g):
            assert got[g, v] == before + (n + 1) / 2
            before += n


def test_review_lists(spark):
    docs = spark.createDataFrame(
        [(1, "Worries were noted by all of the crew in the yard. Other worries, and worries again, were heard there.\n\n[3] This footnote names a ledger and no other mark at all.\n\nObservers note that the tolls are far too high.")], "doc_id long, text string"
    )
    assert [(r["class"], r.place, r.marker) for r in O.missed_perspectives(docs).orderBy("place").collect()] == [("risks", 0, "worries"), ("risks", 1, "worries")]
    assert [(r.place, r.marker) for r in O.missed_citations(docs).collect()] == [(3, "Observers note")]


def test_a_producer_that_stands_apart_everywhere(spark):
    from tessera.operators import corpus as U

    rows = [("alder", "coverage", True, False, "FVS-007,FVS-010"), ("alder", "coverage", True, False, "FVS-010"), ("alder", "coverage", False, True, "")]
    rows += [("birch", "coverage", True, False, "FVS-007"), ("birch", "coverage", False, False, ""), ("cedar", "evidence", True, False, ""), ("cedar", "evidence", True, False, "")]
    rows += [("dogwood", "evidence", True, False, "FVS-002")]
    outliers = spark.createDataFrame(rows, "producer string, dimension string, is_outlier boolean, non_comparable boolean, fired string")
    got = {tuple(r) for r in U.cross_group_findings(outliers).collect()}
    # birch stands apart in one of two groups, dogwood in one alone; cedar's documents fired nothing.
    assert got == {("alder", "coverage", 2, 2, "FVS-010", 2), ("alder", "coverage", 2, 2, "FVS-007", 1), ("cedar", "evidence", 2, 2, None, 0)}


def test_what_grows_with_companies_is_not_held_by_the_driver(spark):
    claims = spark.createDataFrame(
        [("c", "filings", "Acme", "revenue", 10.0, 2020, None, "annual")],
        "claim_id string, provider string, canonical string, metric string, value double, target_year long, target_quarter long, period_type string",
    )
    facts = spark.createDataFrame(
        [("filings", "Acme", "revenue", "annual", 2020, None, 10.0)],
        "provider string, entity string, metric string, period_type string, year long, quarter long, value double",
    )
    found = K.match_facts(claims, facts)
    names = spark.createDataFrame([("ACME WORKS",)], "name string")
    titles = spark.createDataFrame([("A", "Acme Works Inc"), ("B", "Other")], "ticker string, title string")
    parts = K.parts_of_titles(names, titles)
    for df in (found, parts):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert [r.match_type for r in found.collect()] == ["exact"]
    assert [r.best.ticker for r in parts.collect()] == ["A"]


def test_a_text_is_searched_once_for_the_number_of_a_claim(spark):
    rows = spark.createDataFrame([("At 12 they met, 12 men of Rome", "12"), ("12 men", "12"), ("none", "12"), ("a 5", "")], "text string, raw string")
    back = J.stretch_before(F.col("text"), F.col("raw")).alias("back")
    assert [r[0] for r in rows.select(back).collect()] == ["At ", "", "", ""]
    plan = rows.select(back)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("instr(") == 1


def test_common_words_are_counted_without_sorting_texts(spark):
    docs = spark.createDataFrame([("Rome met rome. Ports HQ ports x9y port1 aB a B Ab ab",), ("Rome, Zoë Rome",), (None,)], "text string")
    words = J.common_words(docs)
    assert {r["word"] for r in words.collect()} == {"met", "ports", "ab"}
    assert "sort" not in words._jdf.queryExecution().optimizedPlan().toString()


def test_claims_about_facts_are_dealt_out_before_they_are_taken_apart(spark):
    from tessera.plans import fact_queries as Q

    counts = [r["count"] for r in Q._decomposed(spark, "/root/testdata/sf0.001").groupBy(F.spark_partition_id()).count().collect()]
    assert max(counts) < 0.3 * sum(counts)


def test_all_open_claims_of_a_document_are_searched_for(spark):
    from tessera.plans import subject_queries as Q

    rows = [(1, n, "unverifiable" if n % 2 else "verified", n != 3, 1.0) for n in range(20)]
    judged = spark.createDataFrame(rows, "doc_id long, claim_no long, verdict string, entity_like boolean, value double")
    assert sorted(r.claim_no for r in E.open_claims(judged, None).collect()) == [1, 5, 7, 9, 11, 13, 15, 17, 19]

    class Found:
        def final(self, limit):
            # a verdict for each open claim that is searched for
            return E.open_claims(judged, limit).select("doc_id", F.lit("verified").alias("verdict"), F.lit("web").alias("best_provider"))

    held, Q.Checked = Q.Checked, lambda s, d: Found()
    try:
        got = Q.QUERIES["document_verification"](spark, "").collect()
    finally:
        Q.Checked = held
    assert [(r.doc_id, r.checked, r.verified) for r in got] == [(1, 9, 9)]


def test_nearest_numbers_are_searched_first(spark, monkeypatch):
    """The search by rounds finds what meeting all near numbers finds, and meets far fewer."""
    random.seed(11)
    names = ["Oslo", "Bergen", "Troms", "Narvik"]
    figure = lambda: random.choice((7250, 25, random.randrange(5000, 9000), round(random.uniform(0.3, 0.6), 3)))
    said = lambda w, n: f"The port of {w} sold {n} units in {random.choice((2019, 2020, 2021))}."
    docs = [(k, "\n".join(said(names[k % 40 % 4 if k % 10 == 0 else 0], figure()) + " x" * 60 for _ in range(3)) + " 80% of it." * (k % 3)) for k in range(200)]
    documents = spark.createDataFrame([*docs, docs[5], (1000, None)], "doc_id long, text string")
    rows = []
    for k in range(150):
        value = float(random.choice((figure(), figure(), 80, 2020, 0, -3)))
        subject = " ".join(random.sample(names, random.randrange(1, 3))) if k % 7 else random.choice(("", "Nowhere"))
        sentence = said(names[k % 4], value) if k % 5 else "Of all gains it was so."
        rows.append((f"{k}-0", k, subject, sentence, f"{value}", value, "", "percent" if value == 80 else "count", "2020" if k % 2 else None))
    asked = spark.createDataFrame(rows, "claim_id string, doc_id long, subject string, sentence string, raw string, value double, metric string, unit string, time_period string")
    claims = E.written(E.word_claims(asked))
    numbers, held = E.written(E.corpus_numbers(documents, asked)), E.written(E.corpus_words(documents, asked))
    every = numbers.join(held, "text_id")
    want = sorted(map(str, E.match_texts(claims, every.drop("step")).collect()))
    all_near = E._with_steps(E._sought(E.claim_classes(claims)).withColumn("entity", F.explode("entities"))).join(every, ["entity", "step"]).count()
    met, write = [], E.written
    monkeypatch.setattr(E, "written", lambda df: (write(df), met.append(df.count()) if "beyond" in df.columns else None)[0])
    got = E.search_texts(claims, numbers, held, rounds=((1 / 16, 2), (1.0, None)))
    assert sorted(map(str, got.collect())) == want and len(want) > 30
    assert len(met) == 2 and sum(met) < all_near / 2


def test_edit_distance_of_long_texts(spark):
    from tessera.functions.scalar import edit_distance

    random.seed(5)
    pairs = [("", ""), ("", "a"), ("a", ""), ("aa", "a"), ("abab", "ab"), ("éaé", "éé"), (None, "a"), ("kitten", "sitting")]
    pairs += [tuple("".join(random.choices("abé", k=random.randrange(12))) for _ in range(2)) for _ in range(200)]
    rows = spark.createDataFrame(pairs, "a string, b string")
    want = F.call_function("levenshtein", F.col("a"), F.col("b"), F.lit(4))
    assert [r for r in rows.select("a", "b", edit_distance(F.col("a"), F.col("b"), F.lit(4)).alias("got"), want.alias("want")).collect() if r.got != r.want] == []
    text = "".join(random.choices("abcde ", k=40_000))
    long = spark.createDataFrame([(text, text[:20_000] + "xx" + text[20_001:])] * 4, "a string, b string").repartition(1)
    start = time.time()
    assert [r[0] for r in long.select(edit_distance(F.col("a"), F.col("b"), F.lit(2_000))).collect()] == [2] * 4
    assert time.time() - start < 20
