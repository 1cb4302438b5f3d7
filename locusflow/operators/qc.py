"""Missingness, allele frequencies and the filters that rest on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genetics as g


def missing_by(dosages: DataFrame, key: str) -> DataFrame:
    """(key, missing, total, missing_rate) by sample or by marker."""
    absent = F.count_if(F.col("dose").isNull())
    return dosages.groupBy(key).agg(absent.alias("missing"), F.count("*").alias("total"), g.ratio(absent, F.count("*")).alias("missing_rate"))


def sample_qc(dosages: DataFrame, most: float = 0.1) -> DataFrame:
    """Dosages of samples whose missing rate isn't above the limit."""
    out = missing_by(dosages, "sample").where(F.col("missing_rate") > most).select("sample")
    return dosages.join(out, "sample", "left_anti")


def site_qc(dosages: DataFrame, most: float = 0.1) -> DataFrame:
    """Dosages of markers whose missing rate isn't above the limit; to be applied after sample_qc."""
    out = missing_by(dosages, "marker").where(F.col("missing_rate") > most).select("marker")
    return dosages.join(out, "marker", "left_anti")


def allele_frequencies(dosages: DataFrame) -> DataFrame:
    """(marker, called, alt_alleles, alt_frequency) over called genotypes; the frequency is null without one."""
    out = dosages.groupBy("marker").agg(F.count("dose").alias("called"), F.coalesce(F.sum("dose"), F.lit(0)).cast("long").alias("alt_alleles"))
    return out.withColumn("alt_frequency", g.alt_frequency(F.col("alt_alleles"), F.col("called")))


def maf_filter(dosages: DataFrame, least: float = 0.05) -> DataFrame:
    """(marker, alt_frequency, maf) of markers with at least this minor allele frequency."""
    p = F.col("alt_frequency")
    return allele_frequencies(dosages).withColumn("maf", F.least(p, 1 - p)).where(F.col("maf") >= least).select("marker", "alt_frequency", "maf")
