"""Queries of the read path, over tables that stand in for alignments and reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.functions.times import epoch_seconds
from locusflow.operators import reads
from locusflow.plans.registry import query
from locusflow.session import table

FRAGMENTS_SQL = """f AS (SELECT event_id, user_id, event_type, CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, value FROM events),
b AS (SELECT user_id, event_type, hour, max(value) AS top FROM f GROUP BY ALL),
w AS (SELECT user_id, event_type, hour, min(event_id) AS best FROM f JOIN b USING (user_id, event_type, hour) WHERE value = top GROUP BY ALL)"""


@query(f"WITH {FRAGMENTS_SQL} SELECT event_id, hour, event_id <> best AS duplicate FROM f JOIN w USING (user_id, event_type, hour)")
def mark_duplicates(spark: SparkSession, d: str) -> DataFrame:
    hour = F.floor(epoch_seconds(F.col("ts")) / 3600)
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type", hour.alias("hour"), "value")
    return reads.mark_duplicates(rows, ["user_id", "event_type", "hour"], "value", "event_id").select("event_id", "hour", "duplicate")


@query("""SELECT l_suppkey % 20 AS sample, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS pos, count(*) AS depth,
count(*) FILTER (l_returnflag = 'A') AS alt_depth FROM lineitem WHERE l_quantity >= 20 GROUP BY ALL""")
def depth_pileup(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    rows = table(spark, d, "lineitem").where("l_quantity >= 20").select((F.col("l_suppkey") % 20).alias("sample"), day.alias("pos"), "l_returnflag")
    return reads.depth(rows, ["sample", "pos"], F.col("l_returnflag") == "A")


@query("""SELECT l_orderkey, l_linenumber, l_partkey, day FROM (
  SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS INTEGER) AS day,
    row_number() OVER (PARTITION BY CAST(l_shipdate AS DATE) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
WHERE n <= 5""")
def depth_cap(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_diff(F.to_date("l_shipdate"), F.lit("1992-01-01").cast("date"))
    rows = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", day.alias("day"))
    return reads.capped(rows, ["day"], ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], 5).drop("l_suppkey")


FLAGS_SQL = """f AS (SELECT l_linenumber, (CAST(l_quantity AS INTEGER) * 37 + l_linenumber * 101 + CAST(l_orderkey % 97 AS INTEGER) * 53) % 4096 AS flag FROM lineitem)"""


@query(f"""WITH {FLAGS_SQL} SELECT l_linenumber AS library, count(*) AS records, count(*) FILTER ((flag & 4) = 0) AS mapped,
count(*) FILTER ((flag & 1024) <> 0) AS duplicates, count(*) FILTER ((flag & 2) = 2 AND (flag & 3844) = 0) AS usable FROM f GROUP BY 1""")
def flag_filter(spark: SparkSession, d: str) -> DataFrame:
    flag = (F.col("l_quantity").cast("int") * 37 + F.col("l_linenumber") * 101 + (F.col("l_orderkey") % 97).cast("int") * 53) % 4096
    return reads.library_counts(table(spark, d, "lineitem").select(F.col("l_linenumber").alias("library"), flag.alias("flag")))


@query("""WITH p AS (SELECT conv_id, turn // 2 AS n, count(*) AS mates, count(*) FILTER (turn % 2 = 0) AS firsts,
  max(CASE WHEN turn % 2 = 0 THEN role END) AS r1, max(CASE WHEN turn % 2 = 1 THEN role END) AS r2, sum(coalesce(length("text"), 0)) AS bases,
  min(length("text")) AS min_length, max(length("text")) AS max_length FROM conversations GROUP BY ALL)
SELECT conv_id, n, CASE WHEN mates <> 2 OR firsts <> 1 THEN 'mates' WHEN r1 = r2 THEN 'names' END AS problem,
  CAST(bases AS BIGINT) AS bases, CAST(min_length AS INTEGER) AS min_length, CAST(max_length AS INTEGER) AS max_length FROM p""")
def pair_check(spark: SparkSession, d: str) -> DataFrame:
    """Turns of a conversation as mates: put side by side by one grouped aggregate, with the totals of each pair."""
    n = F.length("text")
    of = lambda k: F.max(F.when(F.col("turn") % 2 == k, F.col("role")))
    pairs = table(spark, d, "conversations").groupBy("conv_id", F.floor(F.col("turn") / 2).alias("n")).agg(
        F.count("*").alias("mates"), F.count_if(F.col("turn") % 2 == 0).alias("firsts"), of(0).alias("r1"), of(1).alias("r2"), F.sum(F.coalesce(n, F.lit(0))).alias("bases"), F.min(n).alias("min_length"), F.max(n).alias("max_length")
    )
    problem = F.when((F.col("mates") != 2) | (F.col("firsts") != 1), "mates").when(F.col("r1") == F.col("r2"), "names")
    return pairs.select("conv_id", "n", problem.alias("problem"), "bases", "min_length", "max_length")


@query("""WITH q AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
c AS (SELECT doc_id, length(t) AS n, length(regexp_replace(t, '[^ !-4]', '', 'g')) AS low FROM q)
SELECT doc_id, CAST(n AS INTEGER) AS length, CAST(low AS INTEGER) AS unqualified, n >= 35 AND low * 100 <= 15 * n AS passes FROM c""")
def quality_filter(spark: SparkSession, d: str) -> DataFrame:
    """Texts as quality strings: characters below '5' are bases under quality 20. Counted without splitting the text."""
    text = F.coalesce("text", F.lit(""))
    n, low = F.length(text), F.length(F.regexp_replace(text, "[^ !-4]", ""))
    return table(spark, d, "documents").select("doc_id", n.alias("length"), low.alias("unqualified"), ((n >= 35) & (low * 100 <= 15 * n)).alias("passes"))


@query("""SELECT p_partkey, reverse(translate(s, 'ACGTacgt', 'TGCAtgca')) AS revcomp, sha256(s) AS sha256, md5(s) AS md5
FROM (SELECT p_partkey, upper(translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacg')) AS s FROM part)""")
def revcomp_hashes(spark: SparkSession, d: str) -> DataFrame:
    s = F.upper(F.translate("p_name", "abcdefghijklmnopqrstuvwxyz ", "acgtacgtacgtacgtacgtacgtacg"))
    return table(spark, d, "part").select("p_partkey", s.alias("s")).select("p_partkey", g.reverse_complement(F.col("s")).alias("revcomp"), F.sha2("s", 256).alias("sha256"), F.md5("s").alias("md5"))


@query("""SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN 'NA' ELSE printf('%.12g', r) END AS ratio
FROM (SELECT p_partkey, p_size, (p_size % 5) / nullif(CAST(4 AS DOUBLE) * (1 + p_partkey % 4), 0) AS r FROM part)""")
def format_ratio(spark: SparkSession, d: str) -> DataFrame:
    size, key = F.col("p_size"), F.col("p_partkey")
    r = F.when(size % 7 != 0, g.ratio(size % 5, 4 * (1 + key % 4)))
    return table(spark, d, "part").select("p_partkey", g.number_text(r).alias("ratio"))
