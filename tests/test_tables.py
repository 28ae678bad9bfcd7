"""Registered queries beside their SQL, claims and facts, streams, partitions."""

import tempfile

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.functions import timeframe as T
from tessera.operators import corpus as U, facts as K, pairs as P
from tessera.sources import corpus as C
from tessera.sources.catalog import read_frame_catalog
from tessera.streaming import jobs as J
from tools.check import TABLES, norm

SMALL = "/root/testdata/sf0.001"
SAMPLE = [
    "lines_with_heading", "coverage", "voice", "number_mentions", "source_fidelity", "number_stability",
    "expert_mean", "icc_by_dimension", "load_facts", "provider_error_window", "verbatim_pairs",
]


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    df = entry.queries()[name](spark, SMALL)
    cols = sorted(df.columns)
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
    assert sorted(names) == cols and got == want


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_result_does_not_depend_on_partitions(spark):
    docs = C.documents(spark, SMALL)
    from tessera.operators import framing as A

    one = A.coverage_rows(docs.coalesce(1)).collect()
    many = A.coverage_rows(docs.repartition(13, "doc_id")).collect()
    assert sorted(map(str, one)) == sorted(map(str, many))


@pytest.mark.parametrize(
    "sentence, hint, want",
    [
        ("Revenue in Q4 2023 was high.", "", ("quarterly", 2023, 4, "quarterly_q_notation")),
        ("The fourth quarter 2024 was weak.", "", ("quarterly", 2024, 4, "quarterly_spelled_out")),
        ("It fell in 1990.", "", ("historical", 1990, None, "historical_old_year")),
        ("It grew between 2023 and 2020.", "", ("range", None, None, "range_between")),
        ("FY2025 was strong.", "", ("annual", 2025, None, "annual_fy_notation")),
        ("It is currently stable.", "", ("current", 2026, None, "current_marker")),
        ("Nothing is said.", "", ("unknown", None, None, "no_time_anchor")),
        ("Nothing is said.", "in 2024", ("annual", 2024, None, "annual_bare_year")),
    ],
)
def test_time_of_claims(spark, sentence, hint, want):
    row = spark.createDataFrame([(sentence, hint)], "s string, h string").select(
        T.classify_time(F.col("s"), F.col("h"), 2026).alias("t")
    ).first().t
    assert (row.period_type, row.year, row.quarter, row.reason) == want


def test_prior_year_number_moves_back(spark):
    row = spark.createDataFrame(
        [("FY2026 revenue of $215B, up from the prior year's $130B.",)], "s string"
    ).select(
        T.time_mention(F.col("s"), F.lit(""), F.lit("$215B")).alias("a"),
        T.time_mention(F.col("s"), F.lit(""), F.lit("$130B")).alias("b"),
    ).first()
    assert (row.a, row.b) == ("FY2026", "FY2025")


def test_consensus(spark):
    claims = spark.createDataFrame(
        [(c, "", "", "direct", 1.0) for c in "abcde"] + [("f", "", "", "projection", 1.0)],
        "claim_id string, heading string, sentence string, claim_type string, value double",
    )
    evidence = spark.createDataFrame(
        [
            ("a", "filings", "exact", 0.95), ("a", "market", "exact", 0.95),
            ("b", "filings", "exact", 0.95), ("b", "market", "contradicted", 0.85),
            ("c", "filings", "close", 0.85), ("d", "indicators", "contradicted", 0.85),
            ("f", "filings", "exact", 0.95),
        ],
        "claim_id string, provider string, match_type string, confidence double",
    )
    got = {r.claim_id: (r.verdict, r.confidence) for r in K.verdicts(claims, evidence).collect()}
    assert got == {
        "a": ("verified", 0.98), "b": ("disputed", 0.6), "c": ("close", 0.85), "d": ("contradicted", 0.85),
        "e": ("unverifiable", 0.0), "f": ("projection", 0.0),
    }


def test_growth_is_recomputed(spark):
    rows = [
        ("v1", 1, "H", "s", "direct", 100.0, "verified", 0.9), ("v2", 1, "H", "s", "direct", 130.0, "close", 0.9),
        ("g1", 1, "H", "It grew 30% in all", "derived", 30.0, "unverifiable", 0.0),
        ("g2", 1, "H", "It grew 50% in all", "derived", 50.0, "unverifiable", 0.0),
        ("g3", 1, "Other", "It grew 50% in all", "derived", 50.0, "unverifiable", 0.0),
        # the same heading in another document has no values of its own
        ("g4", 2, "H", "It grew 50% in all", "derived", 50.0, "unverifiable", 0.0),
    ]
    judged = spark.createDataFrame(
        rows, "claim_id string, doc_id long, heading string, sentence string, claim_type string, value double, verdict string, confidence double"
    )
    got = {r.claim_id: r.verdict for r in K.check_derivations(judged).collect()}
    assert [got[x] for x in ("g1", "g2", "g3", "g4")] == ["unverifiable", "contradicted", "unverifiable", "unverifiable"]


def test_near_matches_against_brute_force(spark):
    import itertools

    a, b = ["100", "0.5", "7", "2000"], ["131", "70.5", "0.36", "7.05", "1500", "101.5"]
    rows = [(1, 2, "only_a", v) for v in a] + [(1, 2, "only_b", v) for v in b] + [(1, 2, "both", "99")]
    sets = spark.createDataFrame(rows, "a_doc_id long, b_doc_id long, side string, value string")
    got = {(r.value_a, r.value_b) for r in P.near_matches(sets).collect()}
    want = set()
    for x, y in itertools.product(a, b):
        d = abs(float(x) - float(y)) / max(abs(float(x)), abs(float(y)))
        if 0.01 < d < 0.30:
            want.add((x, y))
    assert got == want


def test_spearman_with_ties(spark):
    rated = spark.createDataFrame(
        [("d", 1.0, 2.0), ("d", 2.0, 2.0), ("d", 2.0, 3.0), ("d", 4.0, 5.0)], "dimension string, value double, expert_mean double"
    )
    row = U.spearman(U.average_ranks(rated, ["dimension"]), ["dimension"]).first()
    import pandas as pd

    p = pd.DataFrame({"x": [1, 2, 2, 4], "y": [2, 2, 3, 5]}).rank()
    assert abs(row.spearman_rho - p.x.corr(p.y)) < 1e-6 and row.n_documents == 4


def test_catalogue_entries(spark):
    text = (
        "# My Frame\n\n**FVS entry:** FVS-101\n**Class:** text-side\n**Detection:** yes\n**Status:** draft\n**Version:** 2\n"
        "**Adjacent frames:** Other (FVS-102, near), itself (FVS-101), unknown (FVS-999), again (FVS-102)\n"
    )
    other = "# Other\n\n**FVS entry:** FVS-102\n"
    frames, near = read_frame_catalog(spark.createDataFrame([(text,), (other,)], "text string"))
    assert {r.fvs_id: r.title for r in frames.collect()} == {"FVS-101": "My Frame", "FVS-102": "Other"}
    assert [(r.fvs_id, r.adjacent_id) for r in near.collect()] == [("FVS-101", "FVS-102")]


def test_error_windows_on_a_stream_equal_the_table(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    events = C.read_table(spark, SMALL, "events")
    events.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{folder}/in")
    query = (
        J.error_windows(J.provider_errors(stream))
        .writeStream.format("memory").queryName("error_counts").outputMode("update")
        .option("checkpointLocation", f"{folder}/cp").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    cols = ["window_start", "provider", "kind", "errors"]
    got = sorted(map(str, spark.table("error_counts").select(*cols).collect()))
    want = sorted(map(str, J.error_windows(J.provider_errors(events)).select(*cols).collect()))
    assert got == want


def test_arriving_documents_are_profiled_once(spark):
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    schema = "doc_id long, text string, ts timestamp"
    base = C.documents(spark, SMALL).limit(6).withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:00:00")))
    again = base.withColumn("doc_id", F.col("doc_id") + 1000)
    base.unionByName(again).coalesce(1).write.parquet(f"{folder}/in")

    def run():
        J.stream_profiles(spark.readStream.schema(schema).parquet(f"{folder}/in"), f"{folder}/out", f"{folder}/cp").awaitTermination()
        J.stream_frame_counts(spark, f"{folder}/out", f"{folder}/cc").awaitTermination()
        profiles = J.current_profiles(spark, f"{folder}/out")
        got = {r.fvs_id: r.n for r in J.current_frame_counts(spark, f"{folder}/out").collect()}
        assert got == {r.fvs_id: r.n for r in J.frame_counts(profiles).collect()}
        return {r.doc_id: r for r in profiles.collect()}

    first = run()
    assert len(first) == 6
    # One document comes again with the text of a later one: its profile is replaced, the counts follow.
    changed = min(first)
    other = C.documents(spark, SMALL).where(F.col("doc_id") == 23).withColumn("doc_id", F.lit(changed)).withColumn("ts", F.to_timestamp(F.lit("2026-01-01 00:01:00")))
    other.coalesce(1).write.mode("append").parquet(f"{folder}/in")
    second = run()
    want = J.profile_rows(other).first()
    assert len(second) == 6 and second[changed] == want and second[changed] != first[changed]
    # The batch run again changes nothing.
    J._upsert(other, 1, f"{folder}/out")
    assert {r.doc_id: r for r in J.current_profiles(spark, f"{folder}/out").collect()} == second


def test_copies_of_one_text_are_profiled_each(spark, tmp_path):
    import math

    from tessera.plans.registry import QUERIES
    from tessera.sources.seeding import SLOTS

    # The passages behind a text come again after so many documents; three waves.
    turn = 3 * math.lcm(*[len(passages) for _, passages in SLOTS])
    rows = [(1, "A text that stands there twice."), (1 + turn, "A text that stands there twice.")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id for r in QUERIES["stream_profiles"](spark, str(tmp_path)).select("doc_id").collect()} == {1, 1 + turn}


def test_every_passage_serves_as_source(spark, tmp_path):
    for name, rows in (("documents", 400), ("benchmark", 200)):
        ids = spark.range(rows)
        key = "doc_id" if name == "documents" else "item_id"
        ids.selectExpr(f"id AS {key}", f"concat('{name} text number ', id) AS text").write.parquet(str(tmp_path / f"{name}.parquet"))
    paired = C.documents_with_sources(spark, str(tmp_path))
    held = paired.select(F.regexp_extract("source_text", r"benchmark text number (\d+)$", 1).alias("n")).distinct().count()
    assert held == 200


def test_offsets_of_hits(spark):
    import re
    import time

    from tessera.functions import spans as S

    texts = ["", "abc", "12 a 3", "é1é22é333", " ".join(f"é{k} x" for k in range(700))]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for row in df.select("t", S.spans(F.col("t"), r"\d+").alias("s")).collect():
        assert [tuple(x) for x in row.s] == [(m[0], m.start(), m.end()) for m in re.finditer(r"\d+", row.t)]
    long = spark.createDataFrame([(" ".join(map(str, range(40000))),)], "t string")
    counted = long.select(F.sum(F.transform(S.spans(F.col("t"), r"\d+"), lambda h: h["end"])[39999]).alias("n"))
    start = time.time()
    assert counted.first().n == len(" ".join(map(str, range(40000)))) and time.time() - start < 20


def test_hits_stand_in_their_sentences(spark):
    from tessera.operators.located import hits_in_sentences

    text = (
        "# Risks ahead\n\nThe plan carries risks that the crews\nhave named in their letter. Costs grew because the canal opened late.\n\n"
        "Short risks.\n\nThe plan carries risks that the crews have named in their letter. It is an uncertain matter for all of us."
    )
    rows = hits_in_sentences(spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id long, text string")).collect()
    at = {(r.marker, r.start): r.sent_no for r in rows}
    risks = [k for k in range(len(text)) if text.lower().startswith("risks", k)]
    # A heading and a sentence too short to count hold their hits outside of all sentences.
    assert [at["risks", k] for k in risks] == [None, 0, None, 2]
    assert at["because", text.index("because")] == 1
    assert {r.doc_id for r in rows} == {1}


def test_sentences_of_hits_are_found_in_the_row(spark):
    from tessera.operators.located import hits_in_sentences

    # Lists, wrapped lines, hits in a row, one at the very start and one behind the last sentence.
    text = "risks\n- The risks of a list stand in a sentence of their own.\n  1. Numbered risks and risks stand in another one of them.\nrisks run on\nover the risks of the next line here. risks"
    docs = spark.createDataFrame([(1, text), (2, "Nothing.")], "doc_id long, text string")
    found = hits_in_sentences(docs)
    assert [r.sent_no for r in found.where("marker = 'risks'").orderBy("start").collect()] == [None, 0, 1, 1, 2, 2, 2]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Window" not in plan
