"""Read quality of every library, kept up to date as files of reads arrive.

    python -m jobs.read_ledger --input TABLES --output LEDGER --config jobs/read_ledger.json

Sequencing delivers a library lane by lane and file by file, and whoever waits for it wants to know after each delivery
whether it is deep and clean enough. The table ``documents`` stands for the reads: a text is a read's quality string,
its source the library and its language the lane.

A file stream takes the files that the checkpoint below the output doesn't know yet. Each batch adds up its reads by library
and lane, with partial sums before the exchange, and writes these few rows beside those of other batches; a batch that is run again
after a crash replaces itself. Counts, smallest and largest lengths of parts make those of the whole, so the ledger
is the sum over batches, written anew by library. A run without new files leaves the same ledger.

Output: ``ledger/library=...`` (Parquet), ``parts/batch=...`` (the batches' counts) and ``checkpoint``. A null or empty
library or lane is called ``unnamed``; a null text is a read of length 0. A file that arrives twice under two names
counts twice; a file that is changed under its old name isn't read again.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, written
from locusflow.functions import genetics as g
from locusflow.session import scratch

log = logging.getLogger("jobs.read_ledger")

#: What the job reads of the table; other columns, if there are any, stay in the files.
READS = "doc_id long, text string, lang string, source string"
KEYS = ("library", "lane")
SUMS = ("reads", "bases", "low_bases", "short_reads", "passing_reads", "passing_bases")
LEDGER = "lane string, " + ", ".join(f"{c} long" for c in SUMS) + ", min_length long, max_length long, mean_length double, pass_rate double, status string, library string"
PARTS = "library string, lane string, " + ", ".join(f"{c} long" for c in SUMS) + ", min_length long, max_length long, batch long"


@dataclass(frozen=True)
class Settings:
    """A read passes with so many bases, of which at most so many percent are below the quality. A library's lane is sound
    with so many reads, of which at least so many percent pass."""

    min_length: int = 35
    qualified: int = 20
    unqualified_percent: int = 15
    least_reads: int = 20
    least_passing_percent: int = 60
    files_per_batch: int = 1000


def named(c: str) -> Column:
    return F.coalesce(F.when(F.col(c) != "", F.col(c)), F.lit("unnamed"))


def batch_counts(reads: DataFrame, s: Settings) -> DataFrame:
    """Counts of a batch's reads by library and lane: one row for each key and task travels."""
    text = F.coalesce("text", F.lit(""))
    rows = reads.select(named("source").alias("library"), named("lang").alias("lane"), F.length(text).cast("long").alias("n"), g.low_bases(text, s.qualified).cast("long").alias("low"))
    n, low = F.col("n"), F.col("low")
    passes = g.passes_quality(n, low, s.min_length, s.unqualified_percent)
    return rows.groupBy(*KEYS).agg(
        F.count("*").alias("reads"), F.sum(n).alias("bases"), F.sum(low).alias("low_bases"), F.count_if(n < s.min_length).alias("short_reads"),
        F.count_if(passes).alias("passing_reads"), F.sum(F.when(passes, n).otherwise(0)).alias("passing_bases"), F.min(n).alias("min_length"), F.max(n).alias("max_length"),
    )


def ledger_of(parts: DataFrame, s: Settings) -> DataFrame:
    """The ledger from the counts of all batches."""
    rows = parts.groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in SUMS), F.min("min_length").alias("min_length"), F.max("max_length").alias("max_length"))
    rate = g.ratio(F.col("passing_reads"), F.col("reads"))
    few, low = F.col("reads") < s.least_reads, F.col("passing_reads") * 100 < s.least_passing_percent * F.col("reads")
    status = F.when(few, "few_reads").when(low, "low_pass_rate").otherwise("sound")
    return rows.select("lane", *SUMS, "min_length", "max_length", F.round(g.ratio(F.col("bases"), F.col("reads")), 6).alias("mean_length"), F.round(rate, 9).alias("pass_rate"), status.alias("status"), "library")


def run(spark: SparkSession, tables: str, output: str, settings: Settings = Settings()) -> DataFrame:
    """Takes in what is new of ``tables``/documents.parquet and returns the ledger, read back from below ``output``."""

    def add(batch: DataFrame, number: int) -> None:
        counts = batch_counts(batch, settings).withColumn("batch", F.lit(number).cast("long"))
        counts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(f"{output}/parts")
        log.info("added batch %d to %s/parts", number, output)

    # A file's age decides nothing: one that arrives late is as new as any.
    source = spark.readStream.schema(READS).option("maxFilesPerTrigger", settings.files_per_batch).option("maxFileAge", "36500d")
    # A pattern that only the table's name matches: the stream takes a table of one file by it as well as a folder of files.
    query = source.parquet(f"{tables}/documents.parque[t]").writeStream.foreachBatch(add).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    log.info("read %d new reads from %s/documents.parquet", sum(p["numInputRows"] for p in query.recentProgress), tables)

    try:
        parts = spark.read.schema(PARTS).parquet(f"{output}/parts")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        parts = spark.createDataFrame([], PARTS)  # nothing has arrived yet
    # As many files for a library as its size asks for.
    ledger_of(parts, settings).hint("rebalance", "library").write.mode("overwrite").partitionBy("library").parquet(f"{output}/ledger")
    return written(spark, f"{output}/ledger", LEDGER, log)


def job1_read_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole table, twice into one new folder: the second run finds nothing new."""
    output = scratch(spark, "read-ledger")
    run(spark, sf_dir, output)
    return run(spark, sf_dir, output)


JOB1_SQL = """
WITH r AS (
  SELECT coalesce(nullif(source, ''), 'unnamed') AS library, coalesce(nullif(lang, ''), 'unnamed') AS lane, length(coalesce(text, '')) AS n,
         length(regexp_replace(coalesce(text, ''), '[^!-4]', '', 'g')) AS low FROM documents),
p AS (SELECT *, n >= 35 AND low * 100 <= 15 * n AS passes FROM r),
k AS (SELECT library, lane, count(*) AS reads, CAST(sum(n) AS BIGINT) AS bases, CAST(sum(low) AS BIGINT) AS low_bases,
        count(*) FILTER (n < 35) AS short_reads, count(*) FILTER (passes) AS passing_reads,
        CAST(sum(CASE WHEN passes THEN n ELSE 0 END) AS BIGINT) AS passing_bases, min(n) AS min_length, max(n) AS max_length FROM p GROUP BY ALL)
SELECT *, round(bases / reads, 6) AS mean_length, round(passing_reads / reads, 9) AS pass_rate,
       CASE WHEN reads < 20 THEN 'few_reads' WHEN passing_reads * 100 < 60 * reads THEN 'low_pass_rate' ELSE 'sound' END AS status FROM k
"""

QUERIES = {"job1_read_ledger": job1_read_ledger}
ORACLES = {"job1_read_ledger": JOB1_SQL}

if __name__ == "__main__":
    sys.exit(main("read_ledger", Settings, run, "Keeps the read quality of every library up to date."))
