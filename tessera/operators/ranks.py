"""Order over a whole table without a task that sees it whole.

Rows are dealt out by ranges of the key, counted part by part, and each part begins where the
counts of the parts before it end. Only one row for each part meets in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tessera.session import written


def numbered(df: DataFrame, *keys: str, name: str = "number") -> DataFrame:
    """The rows with their number, from 0, in the order of the keys, which have to be unique."""
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    parts = written(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")))
    first = parts.groupBy("_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_rows"))
    # parts are few, but their counts are still added up by key order, not by the driver
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = first.select("_part", "_first", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_base"))
    return parts.join(bases, "_part").select(*df.columns, (F.col("_base") + F.col("_at") - F.col("_first")).alias(name))


def average_ranks(counts: DataFrame, keys: list[str], value: str, n: str, name: str) -> DataFrame:
    """(keys, value) with its tie-averaged rank within the keys, from how often each value occurs.

    Ties are counted before anything is dealt out by range, so a value that a third of the rows
    share is one row here, and no task orders all values of one key."""
    dealt = written(counts.repartitionByRange(*keys, value).select("*", F.spark_partition_id().alias("_part")))
    sizes = dealt.groupBy(*keys, "_part").agg(F.sum(n).alias("_rows"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select(*keys, "_part", F.coalesce(F.sum("_rows").over(ahead), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*keys, "_part").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inner = dealt.select("*", F.coalesce(F.sum(n).over(within), F.lit(0)).alias("_inner"))
    rank = F.col("_base") + F.col("_inner") + (F.col(n) + 1) / 2.0
    return inner.join(bases, [*keys, "_part"]).select(*keys, value, rank.alias(name))
