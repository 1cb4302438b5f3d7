"""Statistics of the cohort that passes quality control, one partition for each population.

    python -m jobs.cohort_release --input TABLES --output RELEASE --config jobs/cohort_release.json

A cohort is released after quality control: samples with too many missing calls go first, then sites with too many
missing calls among the samples that stay, then sites whose minor allele is too rare. What stays is counted by site and
population, so that a population can be read alone. The tables ``lineitem``, ``part`` and ``supplier`` (with ``nation`` and ``region``)
stand for calls, sites and samples.

Output: ``release/population=...`` (Parquet; one row for each retained site, also where the population has no call) and
``samples/retained=...`` (what became of every sample). Both are overwritten as a whole, and a rerun gives the same rows.
"""

from __future__ import annotations

import logging
import sys
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import main, written
from locusflow.functions import genetics as g
from locusflow.operators import stats
from locusflow.plans import derived as v
from locusflow.session import scratch

log = logging.getLogger("jobs.cohort_release")

COUNTS = ", ".join(f"{c} long" for c in g.COUNTS)
RELEASE = f"rec long, contig string, pos long, ref string, alt string, {COUNTS}, observed_heterozygosity double, alt_frequency double, expected_heterozygosity double, population string"
CALLS = "rec long, sample long, category string, dose int"
SAMPLES = "sample long, population string, calls long, missing_rate double, retained boolean"


@dataclass(frozen=True)
class Settings:
    """Calls count from a depth and a quality on; samples and sites may miss such a share of their calls, and the minor
    allele of a site has such a frequency at least."""

    min_dp: int = 10
    min_gq: int = 20
    max_sample_missing: float = 0.55
    max_site_missing: float = 0.5
    min_maf: float = 0.2


def run(spark: SparkSession, tables: str, output: str, settings: Settings = Settings()) -> DataFrame:
    """Writes both results below ``output`` and returns the release, read back."""
    s = settings
    sites = v.sites(spark, tables).where("skip_reason IS NULL").select("rec", "contig", "pos", "ref", F.element_at("alts", 1).alias("alt"))
    calls = v.calls(spark, tables, sites).select("rec", "sample", v.category(s.min_dp, s.min_gq).alias("category"), "dose")
    # The calls are read once; what both rounds of counting start from is a written table that outlives executors. A record's
    # calls lie in one file, so that a task has most of the counts of its records before anything travels again.
    calls.write.mode("overwrite").parquet(f"{output}/calls")
    log.info("read the calls of eligible sites from %s", tables)
    calls = written(spark, f"{output}/calls", CALLS, log)

    lost = g.ratio(F.count_if(F.col("category") != g.CATEGORIES[3]), F.count("*"))
    samples = v.populations(spark, tables)
    of_samples = samples.join(calls.groupBy("sample").agg(F.count("*").alias("calls"), lost.alias("missing_rate")), "sample", "left")
    # A sample without any call has nothing to be kept for.
    keep = F.coalesce(F.col("missing_rate") <= s.max_sample_missing, F.lit(False))
    of_samples.withColumn("retained", keep).write.mode("overwrite").partitionBy("retained").parquet(f"{output}/samples")
    stay = written(spark, f"{output}/samples", SAMPLES, log).where("retained").select("sample", "population")

    # The calls that stay are counted once, by site and population; the same counts tell which sites are sound. A sample
    # that is listed several times counts once for its sites and once for each of its populations.
    of_sample = stay.groupBy("sample").agg(F.sort_array(F.collect_list("population")).alias("populations"))
    counts = calls.join(of_sample, "sample").groupBy("rec", "populations").agg(*g.count_columns(F.col("category"), dose=F.col("dose")))
    counts.write.mode("overwrite").parquet(f"{output}/counts")
    counts = written(spark, f"{output}/counts", f"rec long, populations array<string>, {COUNTS}", log)

    called, others = F.sum("called"), sum(F.sum(c) for c in ("missing", "quality_filtered", "unsupported_ploidy"))
    by_site = counts.groupBy("rec").agg(g.ratio(others, called + others).alias("lost"), g.alt_frequency(F.sum("alt_alleles"), called).alias("p"))
    sound = by_site.where((F.col("lost") <= s.max_site_missing) & (F.least("p", 1 - F.col("p")) >= s.min_maf)).select("rec")
    kept = sites.join(sound, "rec", "left_semi")
    counts = counts.join(sound, "rec", "left_semi").withColumn("population", F.explode("populations"))
    release = stats.every_site(counts.groupBy("rec", "population").agg(*(F.sum(c).alias(c) for c in g.COUNTS)), stay, kept, stats.DIGITS)
    release = release.select([x.split()[0] for x in RELEASE.split(", ")]).hint("rebalance", "population")
    release.write.mode("overwrite").partitionBy("population").parquet(f"{output}/release")
    return written(spark, f"{output}/release", RELEASE, log)


def job2_cohort_release(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The job over the whole tables, twice into one new folder: the second run replaces what the first one wrote."""
    output = scratch(spark, "cohort-release")
    run(spark, sf_dir, output)
    return run(spark, sf_dir, output)


JOB2_SQL = f"""
WITH {v.CLASSIFIED_SQL},
keep AS (SELECT sample FROM classified_v GROUP BY sample HAVING count(*) FILTER (category <> 'called') / count(*) <= 0.55),
c AS (SELECT * FROM classified_v WHERE sample IN (SELECT sample FROM keep)),
f AS (SELECT rec, count(*) FILTER (category <> 'called') / count(*) AS lost,
        sum(dose) FILTER (category = 'called') / nullif(2 * count(*) FILTER (category = 'called'), 0) AS p FROM c GROUP BY rec),
s AS (SELECT rec, contig, pos, ref, alt FROM sites_v WHERE rec IN (SELECT rec FROM f WHERE lost <= 0.5 AND least(p, 1 - p) >= 0.2)),
stay AS (SELECT * FROM pops_v WHERE sample IN (SELECT sample FROM keep)),
g AS (SELECT s.*, p.population FROM s CROSS JOIN (SELECT DISTINCT population FROM stay) p),
k AS (SELECT rec, population, {v.COUNTS_SQL} FROM c JOIN stay USING (sample) GROUP BY ALL),
j AS (SELECT g.*, {", ".join(f"coalesce({n}, 0) AS {n}" for n in g.COUNTS)} FROM g LEFT JOIN k USING (rec, population))
SELECT *, round(heterozygous / nullif(called, 0), 9) AS observed_heterozygosity, round(alt_alleles / nullif(2 * called, 0), 9) AS alt_frequency,
       round(2 * (alt_alleles / nullif(2 * called, 0)) * (1 - alt_alleles / nullif(2 * called, 0)), 9) AS expected_heterozygosity FROM j
"""

QUERIES = {"job2_cohort_release": job2_cohort_release}
ORACLES = {"job2_cohort_release": JOB2_SQL}

if __name__ == "__main__":
    sys.exit(main("cohort_release", Settings, run, "Releases the statistics of a cohort after quality control."))
