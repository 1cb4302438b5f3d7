"""Counts and ratios by site, sample and population.

Input is a frame of classified calls, one row per call: rec, sample, category, and alleles or their dose. All aggregates are sums of the same
additive counts, so each is one grouped aggregate with map-side partial sums.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genetics as g

DIGITS = 9
MOST_POPULATIONS = 10_000


def _counted(calls: DataFrame, *keys) -> DataFrame:
    of_call = {"dose": F.col("dose")} if "dose" in calls.columns else {"alleles": F.col("alleles")}
    return calls.groupBy(*keys).agg(*g.count_columns(F.col("category"), **of_call))


def _rounded(column, digits: int | None):
    return column if digits is None else F.round(column, digits)


def heterozygosity(digits: int | None = None) -> list:
    """Observed heterozygosity, alternative frequency and expected heterozygosity of the counts in a row."""
    alt, called = F.col("alt_alleles"), F.col("called")
    return [
        _rounded(g.ratio(F.col("heterozygous"), called), digits).alias("observed_heterozygosity"),
        _rounded(g.alt_frequency(alt, called), digits).alias("alt_frequency"),
        _rounded(g.expected_heterozygosity(alt, called), digits).alias("expected_heterozygosity"),
    ]


def site_stats(calls: DataFrame, sites: DataFrame, digits: int | None = None) -> DataFrame:
    """One row per site of ``sites`` (rec and any other columns), also for sites without a call."""
    counts = _counted(calls, "rec")
    out = sites.join(counts, "rec", "left").fillna(0, list(g.COUNTS))
    return out.select(*sites.columns, *g.COUNTS, *heterozygosity(digits))


def sample_stats(calls: DataFrame, samples: DataFrame, eligible: int, digits: int | None = None) -> DataFrame:
    """One row per sample of ``samples`` (sample, population); the call rate is over all eligible sites."""
    out = samples.join(_counted(calls, "sample"), "sample", "left").fillna(0, list(g.COUNTS))
    rate = _rounded(g.ratio(F.col("called"), F.lit(eligible)), digits).alias("call_rate")
    return out.select("sample", "population", *g.COUNTS, heterozygosity(digits)[0], rate)


def population_site_stats(calls: DataFrame, samples: DataFrame, sites: DataFrame, digits: int | None = None) -> DataFrame:
    """One row per (site, population), also where the population has no call. There are MOST_POPULATIONS at most."""
    return every_site(_counted(calls.join(samples, "sample"), "rec", "population"), samples, sites, digits)


def every_site(counts: DataFrame, samples: DataFrame, sites: DataFrame, digits: int | None = None) -> DataFrame:
    """What population_site_stats gives, from the counts of each (rec, population) that has calls."""
    names = [r[0] for r in samples.select("population").distinct().orderBy("population").limit(MOST_POPULATIONS + 1).collect()]
    if len(names) > MOST_POPULATIONS:
        raise ValueError(f"more than {MOST_POPULATIONS} populations")
    every = sites.withColumn("population", F.explode(F.array(*map(F.lit, names)))) if names else sites.withColumn("population", F.lit("")).limit(0)
    out = every.join(counts, ["rec", "population"], "left").fillna(0, list(g.COUNTS))
    return out.select(*sites.columns, "population", *g.COUNTS, *heterozygosity(digits))


def population_stats(by_site: DataFrame, digits: int | None = None) -> DataFrame:
    """Pooled counts of each population, and the unweighted mean of expected heterozygosity over sites with calls.

    ``by_site`` is what population_site_stats gives, with unrounded ratios.
    """
    sums = [F.sum(c).cast("long").alias(c) for c in g.COUNTS]
    out = by_site.groupBy("population").agg(*sums, F.count("expected_heterozygosity").alias("sites_with_calls"), _rounded(F.avg("expected_heterozygosity"), digits).alias("mean_expected_heterozygosity"))
    pooled = _rounded(g.ratio(F.col("heterozygous"), F.col("called")), digits).alias("observed_heterozygosity")
    return out.select("population", *g.COUNTS, pooled, "sites_with_calls", "mean_expected_heterozygosity")


def record_totals(sites: DataFrame) -> DataFrame:
    """One row: records, eligible and a counter for each reason to skip one."""
    reason = F.col("skip_reason")
    return sites.agg(F.count("*").alias("records"), F.count_if(reason.isNull()).alias("eligible"), *(F.count_if(F.coalesce(reason == r, F.lit(False))).alias(r) for r in g.SKIPS))


def explode_calls(variants: DataFrame, samples: DataFrame) -> DataFrame:
    """Long calls of variant records with arrays of calls: rec, sample, alleles, phased, dp, gq."""
    rows = variants.select("rec", F.posexplode("calls").alias("idx", "call"))
    return rows.join(samples.select("idx", "sample"), "idx").select("rec", "sample", F.col("call.gt").alias("alleles"), F.col("call.phased").alias("phased"), F.col("call.dp").alias("dp"), F.col("call.gq").alias("gq"))
