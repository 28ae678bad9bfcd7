"""Hand-checked documents, one extreme each."""

import pytest
from pyspark.sql import functions as F

from tessera.functions import spans as S, text as T, vocabulary as V
from tessera.operators import claims as N, framing as A, grounding as G, text_tables as X


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_wrapped_lines_lists_and_headings(spark):
    text = (
        "intro words that are long enough to be kept\n# Title\nThis sentence is wrapped over\n  two lines of the text. "
        "And a second one follows right after it.\n- a list item that stands quite alone here\n\n## Next\nshort one."
    )
    rows = X.sentences(docs(spark, text)).orderBy("sent_no").collect()
    assert [(r.heading, r.para_no, r.sentence) for r in rows] == [
        ("", 0, "intro words that are long enough to be kept"),
        ("Title", 1, "This sentence is wrapped over two lines of the text."),
        ("Title", 1, "And a second one follows right after it."),
        ("Title", 2, "a list item that stands quite alone here"),
    ]
    kinds = [r.kind for r in X.lines_with_heading(docs(spark, text)).orderBy("line_no").collect()]
    assert kinds == ["text", "heading", "text", "text", "list", "blank", "heading", "text"]


def test_empty_text_is_one_blank_line(spark):
    row = X.lines_with_heading(docs(spark, "")).collect()
    assert [(r.line_no, r.kind) for r in row] == [(0, "blank")]


def test_spans_carry_exact_offsets(spark):
    text = "Risks here; no risk there.\nA threat, due\nto haste."
    row = docs(spark, text).select(
        S.spans(F.col("text"), V.PERSPECTIVES["risks"]).alias("r"),
        S.spans(F.col("text"), V.PERSPECTIVES["causes"]).alias("c"),
    ).first()
    for hit in list(row.r) + list(row.c):
        assert text[hit.start : hit.end] == hit.marker
    assert [h.marker for h in row.r] == ["Risks", "risk", "threat"]
    assert [h.marker for h in row.c] == ["due\nto"]


def test_dismissed_risks_do_not_cover(spark):
    out = A.coverage_rows(
        docs(
            spark,
            "There are no risks here. Concerns are overblown. Threats are minimal.",
            "The risks are real. A threat remains for all of them. No doubt that dangers exist.",
        )
    ).where(F.col("perspective") == "risks").orderBy("doc_id").collect()
    assert (out[0]["count"], out[0].dismissed, out[0].covered) == (0, 3, False)
    assert (out[1]["count"], out[1].dismissed, out[1].covered) == (3, 0, True)


def test_time_shares_may_leave_a_negative_present(spark):
    both = "It was sold in spring, and it will be sold again in autumn."
    row = A.add_time(X.with_sentences(docs(spark, both))).first()
    # one sentence, past and future: present is the residual -1
    assert (row.past_pct, row.future_pct, row.present_pct) == (100, 100, -100)
    assert row.dominant == "past" and row.dominant_margin == 0


def test_voice_classes(spark):
    you = "You should keep your papers in one safe place at home. "
    rows = A.add_voice(
        X.with_sentences(
            docs(
                spark,
                you * 3 + "Check the ledger before the ship has left. Verify the seal before the ship has left.",
                "We are proud of what our yards have built so far. " * 4,
                "The essay weighs both sides of the matter calmly. " * 4,
                "",
            )
        )
    ).orderBy("doc_id").collect()
    assert [r.voice for r in rows] == ["prescriptive", "promotional", "analytical", "insufficient"]
    assert rows[3].voice_confidence == "insufficient"


def test_reporters_have_to_be_named(spark):
    got = docs(
        spark,
        "Apple Inc. reported a gain.",
        "The company reported a gain.",
        "The Fed announced a rise.",
        "However reported, it holds.",
        "We reported it.",
    ).select(A.is_sourced(F.col("text")).alias("s")).collect()
    assert [r.s for r in got] == [True, False, True, False, False]


def test_number_mentions(spark):
    rows = N.number_mentions(docs(spark, "6 million or $6 million, 166 million; 24.35% of 1,240 and 7 of 45K.")).collect()
    assert [(r.type, r.value, r.raw) for r in sorted(rows, key=lambda r: r.start)] == [
        ("integer", "6000000", "6 million"),
        ("dollar", "6", "$6"),
        ("integer", "166000000", "166 million"),
        ("percentage", "24.35", "24.35%"),
        ("integer", "1240", "1,240"),
        ("integer", "45", "45K"),
    ]


def test_years_and_word_counts_are_no_data(spark):
    rows = N.number_mentions(docs(spark, "In 1998 it held 450 tons of grain and timber. Word count: 812 words."), "numbers").collect()
    assert [r.value for r in rows] == ["450"]


def test_value_forms(spark):
    raws = ["$2.47 billion", "2.47B", "100.0", "-5%", "1,250", "n/a"]
    got = spark.createDataFrame([(r,) for r in raws], "raw string").select(
        N.stability_key(F.col("raw")).alias("k"), N.normal_value(F.col("raw"), F.lit("")).alias("v")
    ).collect()
    assert [r.k for r in got] == ["2470000000", "2470000000", "100", "-5%", "1250", None]
    assert [r.v for r in got] == [2.47e9, 2.47e9, 100.0, -5.0, 1250.0, 0.0]


def test_derivable_against_brute_force(spark):
    numbers, values = [3.0, 12.5, 40.0, 0.0], [43.0, 52.4, 500.0, 0.125, 31.2, 777.0, 1.21, 4000.0]

    def near(a, v, tol):
        return abs(a) < 0.001 if abs(v) < 0.001 else abs(a - v) / abs(v) < tol

    def brute(v):
        for a in numbers:
            if near(a / 100, v, 0.02) or near(a * 100, v, 0.02):
                return True
            for b in numbers:
                if near(a + b, v, 0.02) or (abs(a - b) > 0.001 and near(a - b, v, 0.02)):
                    return True
                if a and b and (near(a / b * 100, v, 0.01) or near(a / b, v, 0.02) or near(a * b, v, 0.01)):
                    return True
                if 0 < a <= 100 and near(a / 100 * b, v, 0.01):
                    return True
        return False

    got = spark.createDataFrame([(v, numbers) for v in values], "v double, n array<double>").select(
        "v", G.derivable(F.col("v"), F.col("n")).alias("d")
    ).collect()
    assert {r.v: r.d for r in got} == {v: brute(v) for v in values}


def test_novelty_against_brute_force(spark):
    text = "Alpha beta gamma delta epsilon. Alpha beta zeta eta theta. Alpha beta gamma delta epsilon. Iota iota iota kappa alpha."
    row = A.add_novelty(X.with_plain_sentences(docs(spark, text))).first()
    seen, shares = set(), []
    for s in ("alpha beta gamma delta epsilon", "alpha beta zeta eta theta", "alpha beta gamma delta epsilon", "iota iota iota kappa alpha"):
        words = s.split()
        shares.append(sum(w not in seen for w in words) / len(words))
        seen |= set(words)
    assert row.mean_novelty == round(sum(shares) / 4, 3)
    assert row.unique_words == len(seen) and row.novelty_sentences == 4
    assert (row.first_quarter_novelty, row.last_quarter_novelty) == (shares[0], shares[-1])


def test_plain_sentences_keep_abbreviations(spark):
    row = docs(spark, "Dr. Malo met the U.S. Team in the port. Then **they** left for the [second](http://x) port.").select(
        T.plain_sentences(F.col("text")).alias("p")
    ).first()
    assert row.p == ["Dr. Malo met the U.S. Team in the port.", "Then they left for the second port."]


def test_leading_zeros_are_looked_up_without_them(spark):
    rows = spark.createDataFrame(
        [(1, "The code is 0085 on all of them.", "It lists 85 items."), (2, "The code is 0085 on all of them.", "It lists 850 and 985 items.")],
        "doc_id long, text string, source_text string",
    )
    found = {r.doc_id: (r.value, r.in_source) for r in G.number_rows(rows).collect()}
    assert found == {1: ("0085", True), 2: ("0085", False)}


def test_numbers_are_the_same_when_stretches_without_them_are_left_out(spark):
    texts = [
        "Of all that is told here, $5 - $6 million is known; 5 thousand 12 x 3x and 7.5x, then 12 M or 1,234,567 words.",
        "Ab 85% cd ef 85 \n\n% gh 1.2.3 ij $ 40 kl $40 mn.60 op£70–80 billion qr stu12 vw 34K xy 56\tthousands z",
        "é 12 ü 13 ö no digits at all for a long while, and then some: 1 million. 2 trillion!", "99", "no number", "", None,
        "a b 17 " * 300, "word 12 words " + "lorem ipsum dolor " * 50 + "$1,200-$1,300 thousand and 5 5 5 million",
    ]
    df = docs(spark, *texts).select("doc_id", F.col("text"), N.typed_numbers(F.col("text")).alias("cut"), F.coalesce(N._typed_in(F.col("text")), F.array()).alias("whole"))
    for r in df.collect():
        assert [tuple(n) for n in r.cut or []] == [tuple(n) for n in r.whole or []], r.text
        assert all(r.text[n.start : n.end] == n.raw for n in r.cut or [])


def test_patterns_by_first_letter_match_the_same():
    import re

    from tessera.functions.patterns import by_first_letter

    assert by_first_letter(r"(?i)\b(?:risks?|threats?|rise)\b") == r"(?i)(?=[rt])\b(?:r(?:isks?|ise)|t(?:hreats?))\b"
    assert by_first_letter(r"(?i)\bmust\b|\b(?:may|in)\s+be\b") == r"(?i)(?=[im])\b(?:m(?:ust\b|ay\s+be\b)|i(?:n\s+be\b))"
    # an optional first letter, a group that counts, a class, an edge that only one alternative has
    for kept in (r"(?i)\b(?:a?b|c)\b", r"(?i)\b(?:a(b)|c)", r"(?i)\b(?:[ab]c|d)", r"(?i)\bab|cd", r"(?i)\b(?:ab|cd)?ef", "ab|cd"):
        assert by_first_letter(kept) == kept
    text = "The RISKS grew because sales must rise; it was due to them that we may, in the U.S., never depend on \u00e9t\u00e9risk or risk_x. " * 2
    for value in vars(V).values():
        for pattern in value.values() if isinstance(value, dict) else [value]:
            if isinstance(pattern, str) and by_first_letter(pattern) != pattern:
                assert [m.span() for m in re.finditer(by_first_letter(pattern), text)] == [m.span() for m in re.finditer(pattern, text)]


def test_marked_clauses_hold_every_marker_of_a_text(spark):
    """One pass for many patterns: the same counts and places as each pattern has in the whole text."""
    from tessera.functions import spans as S
    from tessera.functions.patterns import any_of
    from tessera.functions.scalar import count_matches

    groups = [V.PERSPECTIVES, V.ROLES, {"m": V.MECHANISM, "b": V.BUZZWORD}, {"p": V.PROJECTION, "r": V.RETROSPECTIVE}, {"a": V.ALTERNATIVES, "d": V.ADVOCACY, "n": V.NARRATIVE}]
    texts = [
        "RISKS, risk.\nrisk! No; due\n\nto the plan: due. to roughly 40, roughly, 40 roughly.",
        ",riské x_risk risks-risk .risḱ the\tpublic; the. public Critics:patrons users funds",
        "é. risk \U0001f600 because, game.changer, game changer, in 2019, by 2030. last year\r\nyears ago",
        "When ships were few; either a or b, critical! Must? must", "", " ", ". , ;", "none of it.", None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for group in groups:
        assert any_of(tuple(group.values()))
        text, marked, clauses = F.col("text"), F.col("marked"), F.col("clauses")
        wide = docs.select("text", S.marked_text(text, group.values()).alias("marked"), S.marked_clauses(text, group.values()).alias("clauses"))
        each = [F.struct(count_matches(text, p).eqNullSafe(count_matches(marked, p)), S.spans(text, p).eqNullSafe(S.spans_in(clauses, p))) for p in group.values()]
        for row in wide.select("text", F.array(*each).alias("same")).collect():
            assert all(all(pair) for pair in row.same), row
    with pytest.raises(ValueError):
        S.marked_text(F.col("text"), [V.INSTRUCTION])
