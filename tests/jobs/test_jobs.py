import json
import os
import subprocess
import sys
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from jobs import cohort_release, read_ledger
from jobs.common import configured
from locusflow.session import table

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
READS = "doc_id long, text string, lang string, source string, library string, reads long"


def arrive(spark, folder, rows):
    """Another file of reads, with columns whose names are those of results."""
    spark.createDataFrame([(*r, "clash", -1) for r in rows], READS).coalesce(1).write.mode("append").parquet(f"{folder}/documents.parquet")


def expected(rows, s=read_ledger.Settings()):
    groups = defaultdict(list)
    for _, text, lane, library in rows:
        groups[(library or "unnamed", lane or "unnamed")].append(text or "")
    out = {}
    for key, texts in groups.items():
        low = [sum("!" <= c < chr(33 + s.qualified) for c in t) for t in texts]
        ok = [len(t) >= s.min_length and 100 * n <= s.unqualified_percent * len(t) for t, n in zip(texts, low)]
        n, good = len(texts), sum(ok)
        status = "few_reads" if n < s.least_reads else "low_pass_rate" if 100 * good < s.least_passing_percent * n else "sound"
        out[key] = (n, sum(map(len, texts)), sum(low), sum(len(t) < s.min_length for t in texts), good, sum(len(t) for t, o in zip(texts, ok) if o), min(map(len, texts)), max(map(len, texts)), status)
    return out


def found(ledger):
    rows = ledger.collect()
    for r in rows:
        assert r["mean_length"] == pytest.approx(r["bases"] / r["reads"], abs=1e-6) and r["pass_rate"] == pytest.approx(r["passing_reads"] / r["reads"], abs=1e-9)
    return {(r["library"], r["lane"]): (*(r[c] for c in read_ledger.SUMS), r["min_length"], r["max_length"], r["status"]) for r in rows}


def batches(spark, out):
    return spark.read.schema(read_ledger.PARTS).parquet(f"{out}/parts").select("batch").distinct().count()


FIRST = [(i, "I" * (20 + i), "L1", "lib/1 ü") for i in range(40)] + [(90, None, "L1", None), (91, "", None, ""), (92, "é#" * 30, "L2", "007"), (None, "I" * 50, "L2", "007")]
SECOND = [(i, "I" * 60 + "#" * (i % 30), "L1", "lib/1 ü") for i in range(50, 90)] + [(93, "\\]^-!" * 9, "L3", "7"), (92, "é#" * 30, "L2", "007"), (94, "I" * 300_000, "L2", "007")]


def test_ledger_grows_with_its_input_and_takes_only_what_is_new(spark, tmp_path):
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    s = read_ledger.Settings(files_per_batch=1)
    arrive(spark, tables, FIRST)
    assert found(read_ledger.run(spark, tables, out, s)) == expected(FIRST)
    assert batches(spark, out) == 1
    assert found(read_ledger.run(spark, tables, out, s)) == expected(FIRST)
    assert batches(spark, out) == 1
    arrive(spark, tables, SECOND)
    arrive(spark, tables, FIRST[:3])
    # A file that was made long ago but arrives now.
    for name in os.listdir(f"{tables}/documents.parquet"):
        if name.endswith(".parquet"):
            os.utime(f"{tables}/documents.parquet/{name}", (10**9, 10**9))
    assert found(read_ledger.run(spark, tables, out, s)) == expected(FIRST + SECOND + FIRST[:3])
    assert batches(spark, out) == 3


def test_ledger_is_the_same_after_a_crash(spark, tmp_path, monkeypatch):
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, tables, FIRST)
    read_ledger.run(spark, tables, out)
    arrive(spark, tables, SECOND)
    with monkeypatch.context() as m:
        m.setattr(read_ledger, "ledger_of", lambda *a: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            read_ledger.run(spark, tables, out)
    # The second batch was written, but nobody noted that it was done: it runs again and replaces itself.
    os.remove(f"{out}/checkpoint/commits/1")
    if os.path.exists(f"{out}/checkpoint/commits/.1.crc"):
        os.remove(f"{out}/checkpoint/commits/.1.crc")
    assert found(read_ledger.run(spark, tables, out)) == expected(FIRST + SECOND)
    assert batches(spark, out) == 2


def test_ledger_without_reads(spark, tmp_path):
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, tables, [])
    assert read_ledger.run(spark, tables, out).count() == 0
    arrive(spark, tables, FIRST)
    assert found(read_ledger.run(spark, tables, out)) == expected(FIRST)


def test_settings_are_checked_and_files_hold_the_defaults():
    for name, kind in (("read_ledger", read_ledger.Settings), ("cohort_release", cohort_release.Settings)):
        with open(f"{ROOT}/jobs/{name}.json") as f:
            assert configured(kind, json.load(f)) == kind()
    for bad in ({"no_such": 1}, {"min_length": "35"}, {"min_length": True}, {"min_length": 3.5}):
        with pytest.raises(ValueError, match="setting"):
            configured(read_ledger.Settings, bad)


def test_command_line(spark, tmp_path):
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    arrive(spark, tables, FIRST)
    with open(tmp_path / "s.json", "w") as f:
        json.dump({"min_length": 50}, f)
    for _ in range(2):
        said = subprocess.run([sys.executable, "-m", "jobs.read_ledger", "--input", tables, "--output", out, "--config", str(tmp_path / "s.json")], cwd=ROOT, capture_output=True, text=True, timeout=300, env=os.environ | {"SPARK_LOCAL_IP": "127.0.0.1"})
        assert said.returncode == 0, said.stderr[-2000:]
    assert "read 0 new reads" in said.stderr and f"rows to {out}/ledger" in said.stderr
    assert found(spark.read.schema(read_ledger.LEDGER).parquet(f"{out}/ledger")) == expected(FIRST, read_ledger.Settings(min_length=50))


def copy_tables(spark, sf, folder, calls=lambda x: x):
    for name in ("part", "supplier", "nation", "region", "lineitem"):
        rows = table(spark, sf, name)
        (calls(rows) if name == "lineitem" else rows).coalesce(1).write.parquet(f"{folder}/{name}.parquet")


def release_by_hand(spark, folder, s):
    """The release from the views' rows, counted in Python."""
    from locusflow.plans import derived as v

    sites = {r["rec"]: r for r in v.sites(spark, folder).where("skip_reason IS NULL").collect()}
    of = {r["sample"]: r["population"] for r in v.populations(spark, folder).collect()}
    calls = []
    for r in v.calls(spark, folder).collect():
        if r["rec"] in sites:
            a = r["alleles"]
            kind = "missing" if None in a else "unsupported" if len(a) != 2 else "filtered" if r["dp"] is None or r["gq"] is None or r["dp"] < s.min_dp or r["gq"] < s.min_gq else "called"
            calls.append((r["rec"], r["sample"], kind, sum(x or 0 for x in a)))
    by_sample, by_site = defaultdict(list), defaultdict(list)
    for c in calls:
        by_sample[c[1]].append(c[2] != "called")
    stay = {x for x, lost in by_sample.items() if sum(lost) / len(lost) <= s.max_sample_missing and x in of}
    for c in calls:
        if c[1] in stay:
            by_site[c[0]].append(c)
    out = {}
    for rec, rows in by_site.items():
        doses = [c[3] for c in rows if c[2] == "called"]
        p = sum(doses) / (2 * len(doses)) if doses else -1
        if (len(rows) - len(doses)) / len(rows) <= s.max_site_missing and min(p, 1 - p) >= s.min_maf:
            for name in {of[x] for x in stay}:
                mine = [c for c in rows if of[c[1]] == name]
                called = [c[3] for c in mine if c[2] == "called"]
                out[(rec, name)] = (len(called), called.count(1), sum(called), *(sum(c[2] == k for c in mine) for k in ("missing", "filtered", "unsupported")))
    return out


def test_release_equals_counting_by_hand_and_a_rerun_changes_nothing(spark, sf, tmp_path):
    tables, out = str(tmp_path / "in"), str(tmp_path / "out")
    nulls = lambda x: x.unionByName(x.limit(50).withColumns({"l_returnflag": F.lit(None).cast("string"), "l_linestatus": F.lit(None).cast("string"), "l_discount": F.lit(None).cast("double"), "l_linenumber": F.lit(1)})).withColumns({"sample": F.lit("x"), "category": F.lit("y")})
    copy_tables(spark, sf, tables, nulls)
    s = cohort_release.Settings(max_sample_missing=0.6, max_site_missing=0.6, min_maf=0.1)
    first = sorted(map(tuple, cohort_release.run(spark, tables, out, s).collect()))
    again = cohort_release.run(spark, tables, out, s)
    assert sorted(map(tuple, again.collect())) == first
    got = {(r["rec"], r["population"]): (r["called"], r["heterozygous"], r["alt_alleles"], r["missing"], r["quality_filtered"], r["unsupported_ploidy"]) for r in again.collect()}
    assert len(got) == len(first) > 50
    assert got == release_by_hand(spark, tables, s)
    # Another bound leaves nothing of the first result behind.
    assert cohort_release.run(spark, tables, out, cohort_release.Settings(max_sample_missing=-1.0)).count() == 0
    kept = spark.read.schema(cohort_release.SAMPLES).parquet(f"{out}/samples")
    assert kept.count() == table(spark, sf, "supplier").count() and kept.where("retained").count() == 0


def test_release_without_calls(spark, sf, tmp_path):
    copy_tables(spark, sf, str(tmp_path / "in"), lambda x: x.limit(0))
    assert cohort_release.run(spark, str(tmp_path / "in"), str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("job", [read_ledger, cohort_release])
def test_registered_query_leaves_a_new_folder_and_the_settings_alone(spark, sf, job):
    before = dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode")
    query = next(iter(job.QUERIES.values()))
    one, two = query(spark, sf), query(spark, sf)
    assert one.inputFiles() and not set(one.inputFiles()) & set(two.inputFiles())
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect()))
    assert before == (dict(spark.sparkContext.getConf().getAll()), spark.conf.get("spark.sql.sources.partitionOverwriteMode"))


def test_calls_travel_once_and_those_of_a_record_lie_together(spark, sf, tmp_path):
    from locusflow.plans import derived as v

    plan = v.classified(spark, sf)._jdf.queryExecution().executedPlan().toString()
    # One exchange for the calls and one for the sites, and only the rows that stay are sorted.
    assert plan.count("Exchange ") == 2 and plan.count("Exchange hashpartitioning(rec#") == 1 and plan.count("Sort [") == 1
    name, out = "spark.sql.adaptive.coalescePartitions.enabled", str(tmp_path / "out")
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        cohort_release.run(spark, sf, out)
    finally:
        spark.conf.set(name, before)
    calls = spark.read.schema(cohort_release.CALLS).parquet(f"{out}/calls")
    assert calls.select(F.input_file_name()).distinct().count() > 1
    assert calls.select("rec", F.input_file_name()).distinct().count() == calls.select("rec").distinct().count() > 50


def test_release_with_repeated_samples_and_populations_without_a_name(spark, tmp_path):
    import duckdb

    sf, tables = "/root/testdata/sf0.01", str(tmp_path / "in")
    copy_tables(spark, sf, str(tmp_path / "whole"))
    for name in ("part", "nation", "lineitem"):
        os.makedirs(tables, exist_ok=True)
        os.symlink(tmp_path / "whole" / f"{name}.parquet", f"{tables}/{name}.parquet")
    supplier, region = table(spark, sf, "supplier"), table(spark, sf, "region")
    again = supplier.where("s_suppkey < 30").withColumn("s_nationkey", (F.col("s_nationkey") + F.col("s_suppkey") % 2) % 25)
    supplier.unionByName(again).coalesce(1).write.parquet(f"{tables}/supplier.parquet")
    region.withColumn("r_name", F.when(F.col("r_regionkey") != 2, F.col("r_name"))).coalesce(1).write.parquet(f"{tables}/region.parquet")
    got = cohort_release.run(spark, tables, str(tmp_path / "out"))
    with duckdb.connect() as db:
        for name in ("part", "nation", "lineitem", "supplier", "region"):
            db.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tables}/{name}.parquet/*.parquet')")
        want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({cohort_release.JOB2_SQL})").fetchall()
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key) and len(want) > 500
