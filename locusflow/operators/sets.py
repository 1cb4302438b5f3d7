"""Identity of sets of keys, and gates that stop a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class GateError(ValueError):
    """Input data break a rule; nothing was published."""


def identity(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """One row: left_only, right_only, both: distinct keys on either side. The sets are equal if the first two are 0."""
    a = left.select(*keys).distinct().withColumn("_l", F.lit(1))
    b = right.select(*keys).distinct().withColumn("_r", F.lit(1))
    out = a.join(b, keys, "full_outer")
    return out.agg(F.count_if(F.col("_r").isNull()).alias("left_only"), F.count_if(F.col("_l").isNull()).alias("right_only"), F.count_if(F.col("_l").isNotNull() & F.col("_r").isNotNull()).alias("both"))


def require_equal(left: DataFrame, right: DataFrame, keys: list[str], what: str) -> None:
    found = identity(left, right, keys).first()
    if found["left_only"] or found["right_only"]:
        raise GateError(f"{what} differ: {found['left_only']} only on the left, {found['right_only']} only on the right")


def require_unique(rows: DataFrame, keys: list[str], what: str) -> None:
    """Raises if a key occurs twice or is null or empty."""
    bad = F.lit(False)
    for k in keys:
        bad = bad | F.col(k).isNull() | (F.col(k).cast("string") == "")
    found = rows.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("twice"), F.count_if(bad).alias("empty")).first()
    if found["twice"] or found["empty"]:
        raise GateError(f"{what}: {found['twice']} repeated, {found['empty']} empty")


def top_per_group(rows: DataFrame, group: str, order: str, k: int) -> DataFrame:
    """The first k rows of each group in order; ties of ``order`` are broken by nothing, so it should be unique."""
    from pyspark.sql import Window

    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank") <= k)


#: Stretches that a running total is put together from, at most.
STRETCHES = 10_000


def running_budget(rows: DataFrame, size: str, order: str, limit: int, stretch: int = 100_000) -> DataFrame:
    """Rows with the running total of sizes in order, and whether it is within the limit.

    Totals of stretches of the order are added first, so no task sees all rows: ``order`` is an integer column. Stretches
    are as long as it takes for STRETCHES of them to hold all of the order, so what is broadcast is bounded.
    """
    from pyspark.sql import Window

    low, high = rows.agg(F.min(order), F.max(order)).first()
    if low is not None:
        stretch = max(stretch, -(-(high - low + 1) // STRETCHES))
    cut = rows.withColumn("_s", F.floor(F.col(order) / stretch))
    parts = cut.groupBy("_s").agg(F.sum(size).alias("_t"))
    before = parts.withColumn("_b", F.coalesce(F.sum("_t").over(Window.orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("_s", "_b")
    own = Window.partitionBy("_s").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    out = cut.join(F.broadcast(before), "_s").withColumn("running", F.sum(size).over(own) + F.col("_b"))
    return out.withColumn("within", F.col("running") <= limit).drop("_s", "_b")
