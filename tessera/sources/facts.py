"""Reference facts and claims about them, derived from the order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tessera.sources.corpus import read_table

YEAR_SHIFT = 20  # order years 1995-2001 become 2015-2021


def _revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue in whole cents per customer, year and quarter: sums of integers are exact."""
    orders = read_table(spark, folder, "orders").select(
        F.col("o_custkey").alias("custkey"),
        (F.year("o_orderdate") + YEAR_SHIFT).cast("long").alias("year"),
        F.quarter("o_orderdate").cast("long").alias("quarter"),
        F.rint(F.col("o_totalprice") * 100).cast("long").alias("cents"),
    )
    return orders.groupBy("custkey", "year", "quarter").agg(F.sum("cents").alias("cents"))


def _rows(df: DataFrame, provider: str, metric: str, period: str, value: Column, year=None, quarter=None) -> DataFrame:
    none = F.lit(None).cast("long")
    return df.select(
        F.lit(provider).alias("provider"),
        "entity",
        F.lit(metric).alias("metric"),
        F.lit(period).alias("period_type"),
        (none if year is None else F.col(year)).alias("year"),
        (none if quarter is None else F.col(quarter)).alias("quarter"),
        value.alias("value"),
    )


def load_facts(spark: SparkSession, folder: str) -> DataFrame:
    """facts(provider, entity, metric, period_type, year, quarter, value)."""
    customers = read_table(spark, folder, "customer").select(
        F.col("c_custkey").alias("custkey"), F.col("c_name").alias("entity"), F.col("c_nationkey").alias("nationkey")
    )
    nations = read_table(spark, folder, "nation").select(
        F.col("n_nationkey").alias("nationkey"), F.col("n_name").alias("nation")
    )
    quarterly = _revenue(spark, folder).join(customers.hint("merge"), "custkey")
    annual = quarterly.groupBy("custkey", "entity", "nationkey", "year").agg(F.sum("cents").alias("cents"))
    national = (
        annual.groupBy("nationkey", "year").agg(F.sum("cents").alias("cents")).join(nations, "nationkey")
        .withColumnRenamed("nation", "entity")
    )
    people = (
        customers.groupBy("nationkey").agg(F.count("*").alias("n")).join(nations, "nationkey")
        .withColumnRenamed("nation", "entity")
    )
    money = F.col("cents") / 100.0
    return (
        _rows(annual, "filings", "revenue", "annual", money, "year")
        .unionByName(_rows(quarterly, "filings", "revenue", "quarterly", money, "year", "quarter"))
        .unionByName(
            _rows(annual.where(F.col("custkey") % 3 == 0), "market", "revenue", "annual", money * 1.03, "year")
        )
        .unionByName(_rows(national, "indicators", "gdp", "annual", money, "year"))
        .unionByName(_rows(national, "macro", "gdp", "annual", money * 1.004, "year"))
        .unionByName(_rows(people, "countries", "population", "annual", F.col("n").cast("double")))
    )


FACTORS = (1.0, 1.02, 1.1, 3.0, 1.0, 1.0)  # by key: exact, close, off, far off, wrong year, projected


def fact_claims(spark: SparkSession, folder: str) -> DataFrame:
    """claims(claim_id, doc_id, heading, sentence, raw, expected, primary_source).

    The factor a value is multiplied with says what a check should find.  What is claimed
    about one entity stands under its name in two documents, by odd and even years."""
    facts = load_facts(spark, folder).where(~F.col("provider").isin("market", "macro"))
    number = F.conv(F.substring(F.sha2("entity", 256), 1, 6), 16, 10).cast("long")
    doc = (number * 2 + F.coalesce("year", F.lit(0)) % 2).alias("doc_id")
    key = F.conv(F.substring(F.sha2(F.concat_ws("/", "provider", "entity", "period_type", "year", "quarter"), 256), 1, 6), 16, 10).cast("long")
    rows = facts.withColumn("_key", key)
    pick = F.col("_key") % len(FACTORS)
    factor = F.element_at(F.array(*[F.lit(f) for f in FACTORS]), (pick + 1).cast("int"))
    amount = F.rint(F.col("value") * factor).cast("long").cast("string")
    said = (F.col("year") + F.when(pick == 4, F.lit(1)).otherwise(F.lit(0))).cast("string")
    entity = F.col("entity")
    money = F.concat(F.lit("$"), amount)
    sentence = (
        F.when(F.col("provider") == "countries", F.concat_ws("", entity, F.lit(" has a population of "), amount, F.lit(" people.")))
        .when(F.col("provider") == "indicators", F.concat_ws("", entity, F.lit(" had a GDP of "), money, F.lit(" in "), said, F.lit(".")))
        .when(
            pick == 5,
            F.concat_ws("", F.lit("Revenue of "), entity, F.lit(" is projected to reach "), money, F.lit(" in "), said, F.lit(".")),
        )
        .when(
            F.col("period_type") == "quarterly",
            F.concat_ws("", F.lit("In Q"), F.col("quarter").cast("string"), F.lit(" "), said, F.lit(" "), entity, F.lit(" sales were "), money, F.lit(".")),
        )
        .otherwise(F.concat_ws("", F.lit("In "), said, F.lit(" "), entity, F.lit(" reported revenue of "), money, F.lit(".")))
    )
    raw = F.when(F.col("provider") == "countries", amount).otherwise(money)
    expected = (
        F.when((pick == 5) & (F.col("provider") == "filings"), "projection")
        .when(pick.isin(0, 5), "verified")
        .when(pick == 1, "close")
        .otherwise("contradicted")
    )
    growth = rows.where((F.col("provider") == "filings") & (F.col("period_type") == "annual") & (F.col("_key") % 5 == 0))
    derived = growth.select(
        F.concat_ws("-", F.lit("growth"), entity, F.col("year").cast("string")).alias("claim_id"),
        doc,
        entity.alias("heading"),
        F.concat_ws("", F.lit("Sales of "), entity, F.lit(" grew 25% in "), F.col("year").cast("string"), F.lit(".")).alias("sentence"),
        F.lit("25%").alias("raw"),
        F.lit("unverifiable").alias("expected"),
        F.lit("filings").alias("primary_source"),
    )
    direct = rows.select(
        F.concat_ws("-", "provider", "entity", "period_type", F.col("year").cast("string"), F.col("quarter").cast("string")).alias("claim_id"),
        doc,
        entity.alias("heading"),
        sentence.alias("sentence"),
        raw.alias("raw"),
        expected.alias("expected"),
        F.col("provider").alias("primary_source"),
    )
    return direct.unionByName(derived)
