"""Counts that grow as files arrive: an extension, for calls that come in parts.

Counts are sums, so the totals of a key are the sum of what each arrival brought. Every batch is added up on its own and
written beside the others under its batch number; a batch that is run again replaces itself, so totals stay exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locusflow.functions import genetics as g

CALLS = "rec long, sample string, gt string, dp int, gq int"


def call_stream(spark: SparkSession, folder: str, files_per_batch: int = 64) -> DataFrame:
    """Calls of Parquet files that arrive in a folder."""
    return spark.readStream.schema(CALLS).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def count_stream(calls: DataFrame, out: str, checkpoint: str, min_dp: int = 0, min_gq: int = 0) -> StreamingQuery:
    """Adds up the counts of each sample per batch below ``out``; runs until what is there has been read."""

    def add(batch: DataFrame, number: int) -> None:
        alleles = g.decode_gt(F.col("gt"))
        rows = batch.select("sample", alleles.alias("alleles"), g.category(alleles, F.col("dp"), F.col("gq"), min_dp, min_gq).alias("category"))
        counts = rows.groupBy("sample").agg(*g.count_columns(F.col("category"), F.col("alleles")))
        counts.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, out: str) -> DataFrame:
    """The counts of each sample over all batches."""
    return spark.read.parquet(out).groupBy("sample").agg(*(F.sum(c).alias(c) for c in g.COUNTS))
