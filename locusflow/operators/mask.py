"""Masking of calls that fail the quality rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators.order import steps_back

#: INFO keys that a changed genotype makes stale (fixed values of the VCF format).
STALE_INFO = ("AC", "AN", "AF", "NS")
#: Categories of calls and what the report calls them.
MASKED = {"called": "kept", "missing": "missing", "filtered": "quality", "unsupported": "unsupported"}


class MaskError(ValueError):
    """The input breaks a rule of masking."""


def masked_genotype(gt: Column, category: Column) -> Column:
    """The genotype's text, or ``./.`` unless it is called."""
    return F.when(category == "called", gt).otherwise("./.")


def mask_report(calls: DataFrame) -> DataFrame:
    """Counts by sample, and one row for all samples (sample null)."""
    counts = [F.count_if(F.col("category") == c).alias(n) for c, n in MASKED.items()]
    return calls.rollup("sample").agg(*counts, F.count_if(F.col("category") != "called").alias("masked"))


def check_masking(variants: DataFrame, min_dp: int = 0, min_gq: int = 0) -> None:
    """Raises MaskError for unsorted records, negative quality or an allele other than 0 and 1 at a biallelic site.

    variants: rec, contig_rank, contig, pos, ref, alts, filters, calls. The rules are looked at in one aggregate and the order in another, before
    anything is written: a check inside a projection could be pruned away.
    """
    eligible = g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")).isNull()
    bad = lambda name, on: F.exists("calls", lambda c: c[name] < 0) if on else F.lit(False)
    rules = {
        "dp": eligible & bad("dp", min_dp),
        "gq": eligible & bad("gq", min_gq),
        "allele": eligible & F.exists("calls", lambda c: F.exists(c["gt"], lambda a: (a > 1) | (a < 0))),
    }
    found = variants.agg(*(F.coalesce(F.bool_or(c), F.lit(False)).alias(n) for n, c in rules.items())).first()
    if steps_back(variants.select("rec", "contig_rank", "pos"), "rec", F.struct("contig_rank", "pos")).first()["steps_back"]:
        raise MaskError("records aren't sorted by contig and position")
    for name in ("dp", "gq"):
        if found[name]:
            raise MaskError(f"negative {name.upper()}")
    if found["allele"]:
        raise MaskError("an allele is outside 0..1")


def mask_variants(variants: DataFrame, min_dp: int = 0, min_gq: int = 0) -> DataFrame:
    """Eligible records with calls that aren't kept set to missing, and stale INFO dropped. Kept calls keep order and phase.

    The calls stay arrays inside their records, so nothing is exploded and nothing moves.
    """
    rows = variants.where(g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")).isNull())

    def masked(call: Column) -> Column:
        keep = g.category(call["gt"], call["dp"], call["gq"], min_dp, min_gq) == "called"
        none = F.array(F.lit(None).cast("int"), F.lit(None).cast("int"))
        return call.withField("gt", F.when(keep, call["gt"]).otherwise(none)).withField("phased", F.when(keep, call["phased"]).otherwise(F.lit(False)))

    info = F.map_filter("info", lambda k, v: ~k.isin(*STALE_INFO))
    return rows.withColumns({"calls": F.transform("calls", masked), "info": info})
