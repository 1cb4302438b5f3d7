"""Evaluation of calls against a truth set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genetics as g



def _sides(calls: DataFrame, side: str) -> DataFrame:
    """(contig, pos, multi, and for comparable calls what they say under the side's name)."""
    several = F.contains("alt", F.lit(",")) if "alt" in calls.columns else F.lit(False)
    rows = calls.select("contig", "pos", "ref", "alt", g.unphased(F.col("gt")).alias("gt"), several.alias("multi"))
    rows = rows.where(F.col("multi") | F.col("gt").isin("0/1", "1/1"))
    said = F.when(~F.col("multi"), F.struct(F.struct("ref", "alt").alias("variant"), "gt"))
    none = F.lit(None).cast("struct<variant:struct<ref:string,alt:string>,gt:string>")
    return rows.select("contig", "pos", "multi", *((said if n == side else none).alias(n) for n in ("t", "c")))


def ambiguous(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """(contig, pos) that :func:`evaluate` sets aside."""
    rows = _sides(truth, "t").unionByName(_sides(calls, "c"))
    return rows.groupBy("contig", "pos").agg(F.bool_or("multi").alias("multi"), F.count("t").alias("t"), F.count("c").alias("c")).where("multi OR t > 1 OR c > 1").select("contig", "pos")


def evaluate(truth: DataFrame, calls: DataFrame) -> DataFrame:
    """One row: true_positive, false_positive, false_negative, genotype_match, precision, recall, f1, concordance.

    truth and calls: contig, pos, ref, alt, gt. Comparable are calls with one alternative and the genotype 0/1 or 1/1
    after unphasing. Positions with several alternatives, and positions that occur more than once on a side, are ambiguous
    and set aside on both sides. So every other position has one call of each side at most, and one grouped aggregate over
    both sides says all: either is read once and moved once. Ratios have six digits and are null where undefined.
    """
    rows = _sides(truth, "t").unionByName(_sides(calls, "c"))
    at = rows.groupBy("contig", "pos").agg(F.bool_or("multi").alias("multi"), *(f(x).alias(f"{x}{n}") for x in ("t", "c") for n, f in (("", F.max), ("_n", F.count))))
    at = at.where("NOT multi AND t_n <= 1 AND c_n <= 1")
    same = F.coalesce(F.col("t.variant") == F.col("c.variant"), F.lit(False))
    out = at.agg(
        F.count_if(same).alias("true_positive"),
        F.count_if(F.col("c").isNotNull() & ~same).alias("false_positive"),
        F.count_if(F.col("t").isNotNull() & ~same).alias("false_negative"),
        F.count_if(same & (F.col("t.gt") == F.col("c.gt"))).alias("genotype_match"),
    )
    a, b, n, m = (F.col(x) for x in ("true_positive", "false_positive", "false_negative", "genotype_match"))
    return out.withColumns({"precision": F.round(g.ratio(a, a + b), 6), "recall": F.round(g.ratio(a, a + n), 6), "f1": F.round(g.ratio(2 * a, 2 * a + b + n), 6), "concordance": F.round(g.ratio(m, a), 6)})
