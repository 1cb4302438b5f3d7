"""Queries over calls: counts by site, sample and population, skips and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators import mask, stats
from locusflow.plans import derived as v
from locusflow.plans.registry import query

D = stats.DIGITS
HET = f"""round(heterozygous / nullif(called, 0), {D}) AS observed_heterozygosity"""
FREQ = f"""round(alt_alleles / nullif(2 * called, 0), {D}) AS alt_frequency,
  round(2 * (alt_alleles / nullif(2 * called, 0)) * (1 - alt_alleles / nullif(2 * called, 0)), {D}) AS expected_heterozygosity"""
ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in g.COUNTS)


def _eligible(spark: SparkSession, d: str) -> DataFrame:
    return v.sites(spark, d).where("skip_reason IS NULL").select("rec", "contig", "pos", "ref", F.element_at("alts", 1).alias("alt"))


@query(f"""WITH {v.CLASSIFIED_SQL}, c AS (SELECT rec, {v.COUNTS_SQL} FROM classified_v GROUP BY rec),
z AS (SELECT s.rec, contig, pos, ref, alt, {ZERO} FROM sites_v s LEFT JOIN c ON s.rec = c.rec WHERE skip_reason IS NULL)
SELECT *, {HET}, {FREQ} FROM z""")
def site_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.site_stats(v.classified(spark, d), _eligible(spark, d), D)


@query(f"""WITH {v.CLASSIFIED_SQL}, c AS (SELECT sample, {v.COUNTS_SQL} FROM classified_v GROUP BY sample),
z AS (SELECT p.sample, population, {ZERO} FROM pops_v p LEFT JOIN c ON p.sample = c.sample)
SELECT *, {HET}, round(called / nullif((SELECT count(*) FROM sites_v WHERE skip_reason IS NULL), 0), {D}) AS call_rate FROM z""")
def sample_stats(spark: SparkSession, d: str) -> DataFrame:
    eligible = v.sites(spark, d).where("skip_reason IS NULL").count()
    return stats.sample_stats(v.classified(spark, d), v.populations(spark, d), eligible, D)


BY_SITE = f"""{v.CLASSIFIED_SQL}, c AS (
  SELECT rec, population, {v.COUNTS_SQL} FROM classified_v JOIN pops_v USING (sample) GROUP BY rec, population),
every AS (SELECT rec, contig, pos, population FROM sites_v, (SELECT DISTINCT population FROM pops_v) WHERE skip_reason IS NULL),
z AS (SELECT e.rec, contig, pos, e.population, {ZERO} FROM every e LEFT JOIN c ON e.rec = c.rec AND e.population = c.population)"""


def _by_site(spark: SparkSession, d: str, digits: int | None) -> DataFrame:
    return stats.population_site_stats(v.classified(spark, d), v.populations(spark, d), _eligible(spark, d).select("rec", "contig", "pos"), digits)


@query(f"WITH {BY_SITE} SELECT *, {HET}, {FREQ} FROM z")
def population_site_stats(spark: SparkSession, d: str) -> DataFrame:
    return _by_site(spark, d, D)


@query(f"""WITH {BY_SITE}, h AS (SELECT *, 2 * (alt_alleles / nullif(2 * called, 0)) * (1 - alt_alleles / nullif(2 * called, 0)) AS hexp FROM z),
t AS (SELECT population, {", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in g.COUNTS)},
  count(hexp) AS sites_with_calls, round(avg(hexp), {D}) AS mean_expected_heterozygosity FROM h GROUP BY population)
SELECT *, {HET} FROM t""")
def population_stats(spark: SparkSession, d: str) -> DataFrame:
    return stats.population_stats(_by_site(spark, d, None), D)


@query(f"""WITH {v.SITES_SQL} SELECT count(*) AS records, count(*) FILTER (skip_reason IS NULL) AS eligible,
{", ".join(f"count(*) FILTER (skip_reason = '{r}') AS {r}" for r in g.SKIPS)} FROM sites_v""")
def skip_counts(spark: SparkSession, d: str) -> DataFrame:
    return stats.record_totals(v.sites(spark, d))


@query(f"""WITH {v.CLASSIFIED_SQL} SELECT rec, sample, category, CASE category WHEN 'called' THEN gt ELSE './.' END AS gt FROM classified_v""")
def mask_calls(spark: SparkSession, d: str) -> DataFrame:
    return v.classified(spark, d).select("rec", "sample", "category", mask.masked_genotype(F.col("gt"), F.col("category")).alias("gt"))


@query(f"""WITH {v.CLASSIFIED_SQL} SELECT sample, {", ".join(f"CAST(count(*) FILTER (category = '{c}') AS BIGINT) AS {n}" for c, n in mask.MASKED.items())},
CAST(count(*) FILTER (category <> 'called') AS BIGINT) AS masked FROM classified_v GROUP BY ROLLUP (sample)""")
def mask_report(spark: SparkSession, d: str) -> DataFrame:
    return mask.mask_report(v.classified(spark, d))


@query(f"""WITH {v.SITES_SQL} SELECT rec, regexp_replace(contig, '^chr', '') || ':' || pos || ':' || ref || ':' || alt AS variant_id
FROM sites_v WHERE skip_reason IS NULL""")
def variant_ids(spark: SparkSession, d: str) -> DataFrame:
    return _eligible(spark, d).select("rec", g.variant_id(F.col("contig"), F.col("pos"), F.col("ref"), F.col("alt")).alias("variant_id"))


@query("""WITH m AS (SELECT p_partkey AS rec, substr('ACGT', CAST(1 + p_partkey % 4 AS INTEGER), 1) AS ref,
  [substr('ACGT', CAST(1 + (p_partkey + 1) % 4 AS INTEGER), 1), substr('ACGT', CAST(1 + (p_partkey + 2) % 4 AS INTEGER), 1)] AS alts,
  [p_size % 3, (p_size // 3) % 3] AS gt FROM part),
s AS (SELECT rec, ref, alts, gt, unnest([1, 2]) AS allele FROM m)
SELECT rec, CAST(allele AS INTEGER) AS allele, ref, alts[allele] AS alt,
  array_to_string(list_transform(gt, lambda a: CASE WHEN a = 0 THEN '0' WHEN a = allele THEN '1' ELSE '.' END), '/') AS gt FROM s""")
def split_multiallelic(spark: SparkSession, d: str) -> DataFrame:
    from locusflow.operators.normalize import split_alleles
    from locusflow.session import table

    base = lambda n: F.substring(F.lit("ACGT"), (n % 4).cast("int") + 1, F.lit(1))
    k, size = F.col("p_partkey"), F.col("p_size")
    rows = table(spark, d, "part").select(k.alias("rec"), base(k).alias("ref"), F.array(base(k + 1), base(k + 2)).alias("alts"), F.array(size % 3, F.floor(size / 3).cast("int") % 3).alias("gt"))
    text = F.array_join("gt", "/", ".")
    return split_alleles(rows, F.col("gt")).select("rec", "allele", "ref", "alt", text.alias("gt"))


@query("""WITH x0 AS (SELECT s, v, (s * 2654435769 + v * 2246822507 + 17) & 4294967295 AS x FROM range(200) a(s), range(500) b(v)),
x1 AS (SELECT s, v, xor(x, x >> 16) AS x FROM x0),
x2 AS (SELECT s, v, CAST((CAST(x AS HUGEINT) * 2146121005) % 4294967296 AS BIGINT) AS x FROM x1),
x3 AS (SELECT s, v, xor(x, x >> 15) AS x FROM x2),
x4 AS (SELECT s, v, CAST((CAST(x AS HUGEINT) * 2221713035) % 4294967296 AS BIGINT) AS x FROM x3),
c AS (SELECT s, xor(x, x >> 16) % 100 AS code FROM x4)
SELECT s AS sample, count(*) FILTER (code > 0) AS called, count(*) FILTER (code >= 50 AND code < 85) AS heterozygous,
  CAST(coalesce(sum(CASE WHEN code >= 85 THEN 2 WHEN code >= 50 THEN 1 ELSE 0 END), 0) AS BIGINT) AS alt_alleles,
  count(*) FILTER (code = 0) AS missing FROM c GROUP BY s""")
def bench_calls(spark: SparkSession, d: str) -> DataFrame:
    return synthetic_totals(spark, 200, 500)


def synthetic_totals(spark: SparkSession, samples: int, sites: int) -> DataFrame:
    """Counts by sample of the synthetic call set, generated and counted in one pass of generated code."""
    cells = spark.range(samples * sites).select((F.col("id") % samples).alias("s"), F.floor(F.col("id") / samples).alias("v"))
    code = cells.select(F.col("s").alias("sample"), g.synthetic_code(F.col("s"), F.col("v")).alias("code"))
    c = F.col("code")
    dose = F.when(c >= 85, 2).when(c >= 50, 1).otherwise(0)
    return code.groupBy("sample").agg(F.count_if(c > 0).alias("called"), F.count_if((c >= 50) & (c < 85)).alias("heterozygous"), F.sum(dose).cast("long").alias("alt_alleles"), F.count_if(c == 0).alias("missing"))
