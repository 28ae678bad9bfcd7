"""Reading tables, the folder that the whole cluster sees, and keys of rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The key given to rows without a doc_id, so that joins find them again.
NO_ID = -(2**63)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where none is named and the master is local."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the whole cluster sees")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="tessera-", dir="/tmp"))
    return context.getCheckpointDir()


def settle(df: DataFrame, *partition: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage is cut and the rows outlive executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition) if partition else df.write
    writer.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of texts that are handed to Python at once; both sides hold a batch several times over.
BATCH_BYTES = 4 << 20


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same table; from now on its session hands rows to Python in batches of BATCH_BYTES at most."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df
