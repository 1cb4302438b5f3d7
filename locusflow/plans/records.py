"""Queries of evaluation, intervals, sets, budgets and planning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions.times import epoch_seconds
from locusflow.operators import acquire, intervals, sets
from locusflow.operators import evaluate as ev
from locusflow.operators.order import steps_back
from locusflow.plans import derived as v
from locusflow.plans.registry import query
from locusflow.session import table


@query("""WITH s AS (SELECT event_id, ts, lag(ts) OVER (ORDER BY event_id) AS before FROM events)
SELECT count(*) AS records, count(*) FILTER (ts < before) AS steps_back, coalesce(count(*) FILTER (ts < before), 0) = 0 AS is_sorted FROM s""")
def sorted_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether events are in the order of their times."""
    found = steps_back(table(spark, d, "events").select("event_id", "ts"), "event_id", F.col("ts"))
    return found.withColumn("is_sorted", F.col("steps_back") == 0)


INTERVALS_SQL = """iv AS (SELECT o_custkey % 50 AS k, (o_orderkey * 97) % 80000 AS a, (o_orderkey * 97) % 80000 + 30 + o_orderkey % 400 AS b FROM orders),
pt AS (SELECT event_id, user_id % 50 AS k, CAST(floor(epoch(ts)) AS BIGINT) % 80000 AS sec FROM events)"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((F.col("o_custkey") % 50).alias("k"), ((k * 97) % 80000).alias("a"), ((k * 97) % 80000 + 30 + k % 400).alias("b"))


@query(f"WITH {INTERVALS_SQL} SELECT event_id, k, sec FROM pt WHERE EXISTS (SELECT 1 FROM iv WHERE iv.k = pt.k AND sec >= a AND sec < b)")
def interval_semi(spark: SparkSession, d: str) -> DataFrame:
    points = table(spark, d, "events").select("event_id", (F.col("user_id") % 50).alias("k"), (epoch_seconds(F.col("ts")) % 80000).alias("sec"))
    return intervals.interval_semi(points, "k", "sec", _intervals(spark, d), "k", "a", "b", 512)


@query(f"WITH {INTERVALS_SQL} SELECT k, CAST(sum(greatest(least(b, 60000) - greatest(a, 10000), 0)) AS BIGINT) AS bases FROM iv GROUP BY k")
def interval_bases(spark: SparkSession, d: str) -> DataFrame:
    n = intervals.clipped_length(F.col("a"), F.col("b"), F.lit(10000), F.lit(60000))
    return _intervals(spark, d).groupBy("k").agg(F.sum(n).alias("bases"))


TRUTH_SQL = f"""{v.SITES_SQL}, {v.CALLS_SQL},
x AS (SELECT CAST(c.sample AS VARCHAR) AS contig, s.pos, s.ref, CASE WHEN c.dp % 17 = 0 THEN s.alt || ',T' ELSE s.alt END AS alt, c.gt, c.dp, c.gq
  FROM calls_v c JOIN sites_v s USING (rec)),
t0 AS (SELECT contig, pos, ref, alt, gt FROM x WHERE gq % 4 <> 1 UNION ALL SELECT contig, pos, ref, alt, gt FROM x WHERE dp = 40),
c0 AS (SELECT contig, pos, ref, alt, CASE WHEN dp % 9 = 0 THEN '1/1' ELSE gt END AS gt FROM x WHERE dp % 5 <> 2),
t1 AS (SELECT * FROM t0 WHERE NOT contains(alt, ',') AND gt IN ('0/1', '1/1')),
c1 AS (SELECT * FROM c0 WHERE NOT contains(alt, ',') AND gt IN ('0/1', '1/1')),
aside AS (SELECT contig, pos FROM t0 WHERE contains(alt, ',') UNION SELECT contig, pos FROM c0 WHERE contains(alt, ',')
  UNION SELECT contig, pos FROM t1 GROUP BY ALL HAVING count(*) > 1 UNION SELECT contig, pos FROM c1 GROUP BY ALL HAVING count(*) > 1),
t AS (SELECT * FROM t1 ANTI JOIN aside USING (contig, pos)), c AS (SELECT * FROM c1 ANTI JOIN aside USING (contig, pos)),
j AS (SELECT t.gt AS tg, c.gt AS cg FROM t FULL JOIN c USING (contig, pos, ref, alt)),
n AS (SELECT count(*) FILTER (tg IS NOT NULL AND cg IS NOT NULL) AS true_positive, count(*) FILTER (tg IS NULL) AS false_positive,
  count(*) FILTER (cg IS NULL) AS false_negative, count(*) FILTER (tg = cg) AS genotype_match FROM j)"""


@query(f"""WITH {TRUTH_SQL} SELECT *, round(true_positive / nullif(true_positive + false_positive, 0), 6) AS precision,
round(true_positive / nullif(true_positive + false_negative, 0), 6) AS recall,
round(2 * true_positive / nullif(2 * true_positive + false_positive + false_negative, 0), 6) AS f1,
round(genotype_match / nullif(true_positive, 0), 6) AS concordance FROM n""")
def truth_eval(spark: SparkSession, d: str) -> DataFrame:
    sites = v.sites(spark, d).select("rec", "pos", "ref", F.element_at("alts", 1).alias("one"))
    x = v.calls(spark, d).join(sites, "rec").select(F.col("sample").cast("string").alias("contig"), "pos", "ref", F.when(F.col("dp") % 17 == 0, F.concat("one", F.lit(",T"))).otherwise(F.col("one")).alias("alt"), "gt", "dp", "gq")
    columns = ["contig", "pos", "ref", "alt", "gt"]
    truth = x.where("gq % 4 <> 1").select(*columns).union(x.where("dp = 40").select(*columns))
    calls = x.where("dp % 5 <> 2").withColumn("gt", F.when(F.col("dp") % 9 == 0, "1/1").otherwise(F.col("gt"))).select(*columns)
    return ev.evaluate(truth, calls)


@query("""SELECT c_nationkey, c_custkey, CAST(rank AS INTEGER) AS rank FROM (
  SELECT c_nationkey, c_custkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_name) AS rank FROM customer) WHERE rank <= 40""")
def topk_per_group(spark: SparkSession, d: str) -> DataFrame:
    return sets.top_per_group(table(spark, d, "customer"), "c_nationkey", "c_name", 40).select("c_nationkey", "c_custkey", "rank")


@query("""SELECT doc_id, n_chars, CAST(running AS BIGINT) AS running, running <= 500000 AS within FROM (
  SELECT doc_id, n_chars, sum(n_chars) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS running FROM documents)""")
def budget_running(spark: SparkSession, d: str) -> DataFrame:
    return sets.running_budget(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", "doc_id", 500_000)


@query("""SELECT doc_id, first, least(first + 1000, n_chars) - 1 AS last
FROM (SELECT doc_id, n_chars, unnest(range(0, n_chars, 1000)) AS first FROM documents WHERE n_chars > 0)""")
def range_chunks(spark: SparkSession, d: str) -> DataFrame:
    return acquire.chunks(table(spark, d, "documents").select("doc_id", "n_chars"), "n_chars", 1000).select("doc_id", "first", "last")


@query("""SELECT c_custkey, array_to_string(list_filter([CASE WHEN NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') THEN 'name' END,
  CASE WHEN NOT (c_acctbal >= 0) THEN 'balance' END, CASE WHEN c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD') THEN 'segment' END,
  CASE WHEN c_nationkey % 6 = 5 THEN 'nation' END], lambda x: x IS NOT NULL), ',') AS problems FROM customer""")
def record_problems(spark: SparkSession, d: str) -> DataFrame:
    found = acquire.problems(name=F.col("c_name").rlike("^Customer#[0-9]{9}$"), balance=F.col("c_acctbal") >= 0, segment=F.col("c_mktsegment").isin("BUILDING", "MACHINERY", "HOUSEHOLD"), nation=F.col("c_nationkey") % 6 != 5)
    return table(spark, d, "customer").select("c_custkey", F.array_join(found, ",").alias("problems"))


@query("""WITH a AS (SELECT DISTINCT c_custkey AS k FROM customer), b AS (SELECT DISTINCT o_custkey AS k FROM orders)
SELECT count(*) FILTER (b.k IS NULL) AS left_only, count(*) FILTER (a.k IS NULL) AS right_only,
  count(*) FILTER (a.k IS NOT NULL AND b.k IS NOT NULL) AS both FROM a FULL JOIN b ON a.k = b.k""")
def set_identity(spark: SparkSession, d: str) -> DataFrame:
    return sets.identity(table(spark, d, "customer").select(F.col("c_custkey").alias("k")), table(spark, d, "orders").select(F.col("o_custkey").alias("k")), ["k"])


@query("SELECT c_custkey, c_nationkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def anti_samples(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").select("c_custkey", "c_nationkey").join(done, "c_custkey", "left_anti")


@query("""WITH r AS (SELECT l_suppkey AS library, l_orderkey AS run, l_quantity AS n FROM lineitem WHERE l_linenumber <= 3
  UNION ALL SELECT l_suppkey, l_orderkey, l_quantity FROM lineitem WHERE l_linenumber > 3)
SELECT library, count(*) AS parts, count(DISTINCT run) AS runs, CAST(sum(n) AS BIGINT) AS reads FROM r GROUP BY library""")
def merge_runs(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("library"), F.col("l_orderkey").alias("run"), F.col("l_quantity").alias("n"), "l_linenumber")
    merged = rows.where("l_linenumber <= 3").unionByName(rows.where("l_linenumber > 3"))
    return merged.groupBy("library").agg(F.count("*").alias("parts"), F.countDistinct("run").alias("runs"), F.sum("n").cast("long").alias("reads"))


#: The tasks of a genotype run and what each waits for (fixed values).
TASKS = {
    "normalize": [], "mask": ["normalize"], "import": ["mask"], "missing": ["import"], "sample-qc": ["import"], "site-qc": ["sample-qc"], "king": ["site-qc"],
    "select": ["king"], "retained": ["select", "site-qc"], "bcf": ["retained"], "stats": ["bcf"], "prune": ["retained"], "pca": ["prune"], "validate": ["pca"],
}


@query(f"""WITH RECURSIVE e(task, needs) AS (VALUES {", ".join(f"('{t}', '{n}')" for t, ns in TASKS.items() for n in ns)}),
l AS (SELECT 'normalize' AS task, 0 AS level UNION ALL SELECT e.task, l.level + 1 FROM l JOIN e ON e.needs = l.task)
SELECT task, CAST(max(level) AS INTEGER) AS level FROM l GROUP BY task""")
def task_topology(spark: SparkSession, d: str) -> DataFrame:
    from locusflow.plans.workflow import levels

    return spark.createDataFrame(sorted(levels(TASKS).items()), "task string, level int")
