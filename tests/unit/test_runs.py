import hashlib
import json
import os
import random

import pytest
from fixtures import COHORT, bcf, bgzf, vcf, write
from pyspark.sql import functions as F
from test_cohort import HEADER, SAMPLES, cohort
from test_reads import RUNS, TRUTH, make_run
from test_variants import META

from locusflow import cli
from locusflow.operators.sets import GateError
from locusflow.plans import runs
from locusflow.sources.pgen import read_pgen
from locusflow.sources.sequences import read_reference
from locusflow.sources.vcf import read_variants


def test_statistics_are_published_whole(spark, tmp_path, capsys):
    source, meta = write(tmp_path / "c.vcf", vcf(COHORT, ["S1", "S2", "S3", "S4"])), write(tmp_path / "m.tsv", META)
    out = str(tmp_path / "out")
    args = ["stats", "--input", source, "--samples", meta, "--out", out]
    assert cli.main(args) == 0
    report = json.loads(capsys.readouterr().out)
    assert (report["records"], report["eligible"]) == (9, 5)
    lines = open(f"{out}/samples.tsv").read().splitlines()
    assert lines[0].split("\t")[:3] == ["sample", "population", "called"] and lines[2] == "S2\tA\t3\t1\t1\t2\t0\t0\t0.333333333333\t0.6"
    assert sorted(os.listdir(out)) == ["population_sites.tsv", "populations.tsv", "provenance.json", "samples.tsv", "sites.tsv"]
    assert len(open(f"{out}/population_sites.tsv").read().splitlines()) == 11
    assert cli.main(args) == 1 and "exists" in capsys.readouterr().err
    assert cli.main([*args, "--replace", "--min-dp", "10", "--min-gq", "20"]) == 0
    capsys.readouterr()
    bad = write(tmp_path / "bad.vcf", vcf([r for r in COHORT if r[0] == "X"], ["S1", "S2", "S3", "S4"]))
    assert cli.main(["stats", "--input", bad, "--samples", meta, "--out", str(tmp_path / "none")]) == 1
    assert not os.path.exists(tmp_path / "none") and not [p for p in os.listdir(tmp_path) if "staging" in p]


STAGES = ["normalize", "mask", "import", "missing", "sample-qc", "site-qc", "king", "select", "retained", "bcf", "stats", "prune", "pca-check", "pca", "validate"]


def test_genotype_run_of_the_described_cohort(spark, tmp_path):
    """Every stage's result, from normalisation to the check of the components against the cohort's own BCF."""
    source = write(tmp_path / "c.vcf", vcf(cohort(), SAMPLES, HEADER))
    fasta = write(tmp_path / "r.fa", f">1\n{'A' * 2000}\n>X\n{'A' * 2000}\n")
    people = write(tmp_path / "p.tsv", "sample\tpopulation\n" + "".join(f"{x}\t{'AB'[i % 2]}\n" for i, x in enumerate(SAMPLES)))
    config = {"work_dir": str(tmp_path / "w"), "input": source, "reference": fasta, "assembly": "drawn", "samples": people, "relatedness_policy": "exclude", "min_dp": 10, "min_gq": 20, "pcs": 3}
    flow = lambda **kw: runs.genotype_workflow(spark, runs.GenotypeConfig.of(config | kw))
    first = flow().run()
    assert sorted(first["ran"]) == sorted(STAGES)
    where = first["results"]
    load = lambda path: json.load(open(path))
    assert load(f"{where['normalize']}/normalized.json")["records"] == 243
    mask = load(f"{where['mask']}/mask/report.json")
    assert [mask[k] for k in ("records", "eligible", "non_autosomal", "not_biallelic_snp", "site_filter")] == [243, 240, 1, 1, 1]
    assert mask["samples"][63] == {"sample": "S63", "kept": 0, "missing": 1, "quality": 239, "unsupported": 0, "masked": 240}
    assert mask["samples"][5]["unsupported"] == 1 and mask["totals"]["unsupported"] == 1
    masked = {r["pos"]: r["calls"] for r in read_variants(spark, f"{where['mask']}/mask/masked.bcf")[0].where("pos IN (25, 30, 35, 40, 45)").collect()}
    assert [masked[p][k]["gt"] for p, k in ((25, 2), (30, 3), (35, 4), (40, 5), (45, 6))] == [[None, None]] * 4 + [[0, 1]]
    missing = [x.split("\t") for x in open(f"{where['missing']}/data.smiss").read().splitlines()]
    assert missing[0] == ["IID", "MISSING_CT", "OBS_CT", "F_MISS"] and [r[0] for r in missing[1:] if float(r[3]) > 0.1] == ["S62", "S63"]
    assert open(f"{where['missing']}/data.vmiss").read().splitlines()[2].split("\t")[1:4] == ["1:10:A:G", str(sum(x.startswith("./.") or x.endswith(":1:1") for x in cohort()[1][7].split(" "))), "64"]
    assert spark.read.parquet(f"{where['site-qc']}/markers.parquet").count() == 238
    pairs = [x.split("\t") for x in open(f"{where['king']}/data.kin0").read().splitlines()]
    assert pairs == [["IID1", "IID2", "NSNP", "KINSHIP"], ["S00", "S61", pairs[1][2], "0.5"]]
    report = load(f"{where['select']}/selection/selection.json")
    assert report["sample_qc_excluded"] == ["S62", "S63"] and report["relatedness_excluded"] == [{"sample": "S61", "related_to": "S00"}]
    assert len(report["retained"]) == 61 and report["assembly"] == "drawn"
    calls, variants = read_pgen(spark, f"{where['retained']}/data")
    held = {r["id"]: r["data"] for r in spark.read.parquet(f"{where['retained']}/markers.parquet").collect()}
    assert {r["id"]: r["data"] for r in calls.join(variants, "at").collect()} == held and len(held) == 238
    assert [r["pos"] for r in variants.orderBy("at").collect()] == sorted(r["pos"] for r in variants.collect())
    records, samples, _ = read_variants(spark, f"{where['bcf']}/cohort.bcf")
    assert samples.count() == 61 and records.count() == 238 and os.path.exists(f"{where['bcf']}/cohort.bcf.csi")
    rows = [x.split("\t") for x in open(f"{where['stats']}/stats/samples.tsv").read().splitlines()]
    assert len(rows) == 62 and rows[2][:2] == ["S01", "B"]
    sites = open(f"{where['stats']}/stats/sites.tsv").read().splitlines()
    assert len(sites) == 239 and sites[1].split("\t")[:3] == ["1", "15", "1:15:A:C"]
    validation = load(f"{where['validate']}/validation.json")
    assert validation["samples"] == 61 and validation["validated"] and 3 < validation["markers"] < 236 and max(validation["residuals"]) < 1e-3
    assert validation["markers"] == len(open(f"{where['prune']}/data.prune.in").read().splitlines())
    assert flow().run()["ran"] == []
    again = flow(relatedness_policy="retain").run()
    assert sorted(again["ran"]) == sorted(STAGES[STAGES.index("select") :])
    assert load(f"{again['results']['validate']}/validation.json")["samples"] == 62
    assert len(open(f"{again['results']['stats']}/stats/samples.tsv").read().splitlines()) == 63


def test_genotype_run_normalises_first(spark, tmp_path):
    """Alternatives of one record count as records of their own, and a wrong REF stops the run."""
    records = [r for r in cohort() if r[0] == "1" and r[1] <= 1200]
    gts = [c.split(":")[0] for c in records[30][7].split(" ")]
    both = " ".join(f"{x.replace('1', '2') if i % 2 else x}:20:50" for i, x in enumerate(gts))
    records[30] = ("1", records[30][1], "multi", "A", "C,G", "PASS", "GT:DP:GQ", both)
    source = write(tmp_path / "c.vcf", vcf(records, SAMPLES, HEADER))
    fasta = write(tmp_path / "r.fa", f">1\n{'A' * 2000}\n")
    config = {"work_dir": str(tmp_path / "w"), "input": source, "relatedness_policy": "retain", "variant_missing": 1.0, "pcs": 3, "min_dp": 10, "min_gq": 20}
    flow = lambda **kw: runs.genotype_workflow(spark, runs.GenotypeConfig.of(config | kw))
    done = flow(reference=fasta).run()["results"]
    ids = {r["id"] for r in spark.read.parquet(f"{done['import']}/markers.parquet").collect()}
    assert len(ids) == 241 and {f"1:{records[30][1]}:A:C", f"1:{records[30][1]}:A:G"} <= ids
    masked = read_variants(spark, f"{done['mask']}/mask/masked.bcf")[0].where(f"pos = {records[30][1]}").orderBy("rec").collect()
    for k, r in enumerate(masked):
        want = [[int(a) if a == "0" else (1 if a == str(k + 1) else None) for a in c.split(":")[0].split("/")] if "." not in c.split(":")[0] else None for c in both.split(" ")]
        for got, x in zip(r["calls"][:61], want[:61], strict=True):
            assert got["gt"] == (x if x and None not in x else [None, None])
    without = flow(work_dir=str(tmp_path / "v")).run()["results"]
    assert spark.read.parquet(f"{without['import']}/markers.parquet").count() == 239
    other = write(tmp_path / "o.fa", f">1\n{'A' * 600}C{'A' * 1399}\n")
    with pytest.raises(GateError, match="isn't what the reference has"):
        records[120] = ("1", 601, *records[120][2:])
        flow(input=write(tmp_path / "d.vcf", vcf(records, SAMPLES, HEADER)), reference=other, work_dir=str(tmp_path / "x")).run()


@pytest.mark.parametrize("turn", [1 << 25, 64])
def test_packed_markers_equal_plain_counting(spark, monkeypatch, turn):
    import numpy as np

    from locusflow.operators import packed_markers as pm
    from locusflow.operators import relatedness as kin
    from locusflow.sources.vcf import code_of

    monkeypatch.setattr(pm, "TURNED", turn)
    monkeypatch.setattr(pm, "COUNTS", 4)
    rng = random.Random(4)
    kinds = [None, [], [0, 0], [0, 1], [1, 1], [1, 0], [None, None], [0, None], [1], [0, 0, 1], [0, 2], [None], [None, 5], [3]]
    rows = [(k, [(rng.choice(kinds), False, rng.choice([None, 7]), 9, None) for _ in range(11)]) for k in range(150)]
    records = spark.createDataFrame(rows, "rec long, calls array<struct<gt:array<int>,phased:boolean,dp:int,gq:int,rest:string>>").repartition(4)
    packed = pm.pack_calls(records)
    got = {r["rec"]: (list(r["codes"]), list(np.frombuffer(r["dp"], np.int32))) for r in packed.collect()}
    assert all(got[k] == ([code_of(c[0]) for c in calls], [c[2] if c[2] is not None else -(1 << 31) for c in calls]) for k, calls in rows)
    digit = {1: 0, 2: 1, 3: 2}
    x = np.array([[digit.get(code_of(c[0]), 3) for c in calls] for _, calls in rows])
    markers = pm.dosage_rows(packed)
    assert {r["rec"]: [b - 48 for b in r["data"]] for r in markers.collect()} == {k: x[k].tolist() for k in range(150)}
    assert {r["idx"]: (r["missing"], r["total"]) for r in pm.missing_by_sample(markers).collect()} == {i: (int((x[:, i] == 3).sum()), 150) for i in range(11)}
    keep = [9, 2, 4, 5]
    some = pm.with_maf(pm.choose_samples(pm.choose_samples(markers, list(range(11))), keep), 4)
    y = x[:, keep]
    for r in some.collect():
        row = y[r["rec"]]
        called = row[row != 3]
        p = called.sum() / (2 * len(called)) if len(called) else None
        assert [b - 48 for b in r["data"]] == row.tolist() and r["missing"] == 4 - len(called) and r["alt_alleles"] == called.sum()
        assert r["maf"] is None if p is None else r["maf"] == pytest.approx(min(p, 1 - p))
    turned, width = pm.turned(markers.select(F.col("rec").alias("at"), "data"), 11)
    cells = {}
    for r in turned.collect():
        cells.update({(r["sample"], r["part"] * width + i): b - 48 for i, b in enumerate(r["data"])})
    assert all(cells[s, k] == (x[k, s] if k < 150 else 3) for s, k in cells) and len({s for s, _ in cells}) == 11
    long = spark.createDataFrame([(s, k, None if x[k, s] == 3 else int(x[k, s])) for s in range(11) for k in range(150)], "sample long, marker int, dose int")
    plain = {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_pairs_relational(long, -9).collect()}
    assert {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_of_packed(turned, -9).collect()} == plain
    fewer = {r["rec"]: [c["gt"] for c in r["calls"]] for r in pm.calls_of(records, keep).collect()}
    assert fewer == {k: [calls[i][0] for i in keep] for k, calls in rows}


@pytest.mark.parametrize("change", [{"x": 1}, {"pcs": 0}, {"pcs": 2.5}, {"sample_missing": 2}, {"relatedness_policy": "drop"}, {"min_dp": True}, {"reference": ""}, {"assembly": 3}])
def test_bad_settings(change):
    with pytest.raises(GateError):
        runs.GenotypeConfig.of({"work_dir": "w", "input": "i", "relatedness_policy": "retain"} | change)
    for given in ({"work_dir": "w"}, {"work_dir": "w", "input": "i"}):
        with pytest.raises(GateError, match="missing"):
            runs.GenotypeConfig.of(given)


def test_reads_to_joint_calls(spark, tmp_path):
    rng = random.Random(12)
    reference = "".join(rng.choice("ACGT") for _ in range(10_000))
    fasta = write(tmp_path / "r.fa", f">1\n{reference}\n")
    digest = hashlib.sha256(open(fasta, "rb").read()).hexdigest()
    report = runs.prepare_reference(spark, fasta, digest, 20_000, str(tmp_path / "ref"))
    assert report == {"sha256": digest, "bases": 10_000, "contigs": {"1": 10_000}, "autosomes": 1}
    assert open(tmp_path / "ref" / "reference.fa").read() == open(fasta).read() and open(tmp_path / "ref" / "reference.fa.fai").read() == "1\t10000\t3\t10000\t10001\n"
    assert open(tmp_path / "ref" / "ploidy.txt").read() == "* * * * 2\n" and open(tmp_path / "ref" / "autosomes.bed").read() == "1\t0\t10000\n"
    for wrong in ((digest, 100), ("0" * 64, 20_000)):
        with pytest.raises(GateError):
            runs.prepare_reference(spark, fasta, *wrong, str(tmp_path / "no"))
    listed = []
    for run, sample, library in RUNS:
        a, b = make_run(reference, run, sample)
        listed.append({"id": run, "sample": sample, "library": library, "read1": write(tmp_path / f"{run}1.fq", a), "read2": write(tmp_path / f"{run}2.fq", b)})
    assert runs.check_fastq_pair(spark, listed[0]["read1"], listed[0]["read2"]) == {"pairs": 73, "bases": 21900, "min_length": 150, "max_length": 150, "encoding": "phred33"}
    with pytest.raises(GateError):
        runs.check_fastq_pair(spark, listed[0]["read1"], listed[4]["read2"])
    called = runs.call_variants(spark, listed, read_reference(spark, fasta, 1000), 1000).collect()
    got = {(r["pos"], r["sample"]): f"{r['gt']}:{r['dp']}" for r in called}
    assert got == {(p, s): "./.:0" if d is None else f"{('0/0', '0/1', '1/1')[d]}:{48 if s == 'A' else 24}" for p, t in TRUTH.items() for s, d in t.items()}


def test_doctor(capsys):
    assert cli.main(["doctor"]) == 0 and json.loads(capsys.readouterr().out)["ok"]


@pytest.mark.parametrize("least", [(0, 0), (8, 0), (0, 40), (8, 40)])
@pytest.mark.parametrize("name", ["a.vcf", "a.vcf.gz", "a.bcf"])
def test_packed_counts_equal_exploded_ones(spark, tmp_path, monkeypatch, least, name):
    from locusflow.functions import genetics as g
    from locusflow.operators import packed_calls, stats
    from locusflow.sources.vcf import read_variants

    rng = random.Random(3)
    call = lambda: f"{rng.choice(['0/0', '0/1', '1|1', './.', '0/.', '0', '1/1/1', '.'])}:{rng.choice(['.', '7', '300'])}:{rng.randrange(99)}"
    names = [f"N{i}" for i in range(7)]
    rows = [("1" if k % 5 else "X", 10 + k, f"rs{k}", "A", "C", "PASS" if k % 7 else "q10", "GT:DP:GQ", " ".join(call() for _ in names)) for k in range(60)]
    text = vcf(rows, names)
    path = write(tmp_path / name, {"vcf": text, "gz": bgzf(text.encode()), "bcf": bcf(text) if name == "a.bcf" else b""}[name.rpartition(".")[2]])
    monkeypatch.setattr(packed_calls, "CARRY", 7)
    sites = lambda d: d.withColumn("skip_reason", g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")))
    packed = sites(read_variants(spark, path, calls="packed", qualities="dp,gq", split=500)[0]).withColumn("eligible", F.col("skip_reason").isNull())
    populations = [k % 3 for k in range(7)]
    counted = packed_calls.count_packed(packed.drop("info", "format"), populations, 3, *least)
    records, samples, _ = read_variants(spark, path)
    calls = stats.explode_calls(sites(records).where("skip_reason IS NULL"), samples).join(records.select("rec", "pos"), "rec")
    calls = calls.withColumn("category", g.category(F.col("alleles"), F.col("dp"), F.col("gq"), *least))
    count = g.count_columns(F.col("category"), F.col("alleles"))
    want = lambda *keys: sorted(map(tuple, calls.groupBy(*keys).agg(*count).collect()))
    got = lambda df, *keys: sorted(map(tuple, df.select(*keys, *g.COUNTS).collect()))
    assert got(packed_calls.by_site(counted), "pos") == want("pos")
    people = samples.select("sample", "idx", (F.col("idx") % 3).alias("population_no"))
    assert got(packed_calls.by_sample(counted).join(people, "idx"), "sample") == want("sample")
    calls = calls.join(people, "sample")
    assert got(packed_calls.by_population(counted), "pos", "population_no") == want("pos", "population_no")
    assert counted.where("odd > 0").isEmpty()
    assert counted.where("site IS NOT NULL").count() == 60
