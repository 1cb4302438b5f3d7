"""Is a numbered stream of records in the order of a key?"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Stretches that a stream is cut into, of so many numbers at least.
STRETCHES, LEAST = 10_000, 1000


def steps_back(rows: DataFrame, ordinal: str, key) -> DataFrame:
    """One row (records, steps_back): how often a record's key is less than that of the record before it.

    Numbers go up but needn't be dense. Neighbours are compared inside stretches of the numbers, then the last record of
    each stretch with the first of the next one that has any: no more than STRETCHES rows meet in one task.
    """
    low, high = rows.agg(F.min(ordinal), F.max(ordinal)).first()
    width = max(LEAST, ((high or 0) - (low or 0)) // STRETCHES + 1)
    cut = rows.select(F.floor((F.col(ordinal) - (low or 0)) / width).alias("s"), F.col(ordinal).alias("o"), key.alias("k"))
    step = cut.withColumn("back", (F.col("k") < F.lag("k").over(Window.partitionBy("s").orderBy("o"))).cast("int"))
    parts = step.groupBy("s").agg(F.count("*").alias("n"), F.coalesce(F.sum("back"), F.lit(0)).alias("b"), F.min_by("k", "o").alias("first"), F.max_by("k", "o").alias("last"))
    gap = (F.col("first") < F.lag("last").over(Window.orderBy("s"))).cast("int")
    parts = parts.withColumn("gap", F.coalesce(gap, F.lit(0)))
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("records"), F.coalesce(F.sum(F.col("b") + F.col("gap")), F.lit(0)).alias("steps_back"))
