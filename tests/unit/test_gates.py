import json
import random
from types import SimpleNamespace

import numpy as np
import pytest
from fixtures import bcf, vcf, write
from pyspark.sql import functions as F
from test_reads import complement

from locusflow import cli
from locusflow.functions import genetics as g
from locusflow.operators import acquire, pca, placement, trim
from locusflow.operators.order import steps_back
from locusflow.operators.reports import normalised_report, parse_report
from locusflow.operators.sets import GateError
from locusflow.plans import runs


def test_steps_back_across_stretches(spark):
    rows = [(o, k) for o, k in zip(range(0, 50_000, 10), range(5000))]
    rows[2000] = (rows[2000][0], -1)  # two borders of stretches are near by
    frame = spark.createDataFrame(rows, "o long, k long").repartition(4)
    assert tuple(steps_back(frame, "o", F.col("k")).first()) == (5000, 1)
    for at in range(1, 5000, 97):
        swapped = [(o, k if i != at else k - 2) for i, (o, k) in enumerate(zip(range(0, 50_000, 10), range(5000)))]
        if at in (98, 1940):
            assert steps_back(spark.createDataFrame(swapped, "o long, k long"), "o", F.col("k")).first()[1] == 1
    assert tuple(steps_back(frame.where("false"), "o", F.col("k")).first()) == (0, 0)


def test_alignments_out_of_order_at_any_place(spark, tmp_path, monkeypatch):
    index = write(tmp_path / "r.fai", "1\t1000\t0\t60\t61\n")
    groups = {"x": {"SM": "S", "LB": "L", "PL": "ILLUMINA"}}
    monkeypatch.setattr(runs.sequences, "bam_header", lambda p: (None, ["1"], [1000], groups))
    monkeypatch.setattr(runs, "size_of", lambda p: 1)
    with pytest.raises(GateError, match="no index beside"):
        runs.check_alignments(spark, ["a.bam"], ["S"], ["L"], index)
    monkeypatch.setattr(runs, "index_beside", lambda p, ends: p)
    monkeypatch.setattr(runs, "Index", lambda p: SimpleNamespace(contigs=[1]))
    for wrong in (None, 1, 100_000, 100_001, 199_999):
        frame = spark.range(200_000).select(F.col("id").alias("ordinal"), F.lit("1").alias("contig"), (F.col("id") - (F.lit(5) if wrong is not None else F.lit(0)) * (F.col("id") == F.lit(wrong or 0)).cast("int")).alias("pos"), F.lit(99).alias("flag"))
        monkeypatch.setattr(runs.sequences, "read_alignments", lambda s, p, f=frame: f)
        if wrong is None:
            assert runs.check_alignments(spark, ["a.bam"], ["S"], ["L"], index)[0]["records"] == 200_000
        else:
            with pytest.raises(GateError, match="not sorted"):
                runs.check_alignments(spark, ["a.bam"], ["S"], ["L"], index)


def brute_fragment(a, b):
    rc = complement(b)
    for n in range(len(a) + len(b) - trim.OVERLAP, trim.OVERLAP - 1, -1):
        pairs = [(a[i], rc[i - (n - len(b))]) for i in range(n) if i < len(a) and 0 <= i - (n - len(b)) < len(b)]
        if len(pairs) >= trim.OVERLAP and sum(x != y for x, y in pairs) <= min(5, int(len(pairs) * 0.2)):
            return n if n < max(len(a), len(b)) else None
    return None


def test_adapters_are_cut_by_overlap(spark):
    rng = random.Random(4)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    rows, want = [], {}
    for k in range(60):
        fragment, n, m = base(rng.choice([31, 40, 70, 99, 100, 101, 130, 300])), rng.choice([100, 90]), 100
        one, two = (fragment + base(100))[:n], (complement(fragment) + base(100))[:m]
        one = "".join(rng.choice("ACGT") if rng.random() < 0.02 else c for c in one)
        got = trim.fragment_length(one.encode(), two.encode())
        assert got == brute_fragment(one, two)
        for mate, s in ((1, one), (2, two)):
            rows.append((k, mate, f"r{k}", s, "I" * len(s)))
            want[k, mate] = s if got is None else s[:got]
    rows += [(98, m, "empty", t, t) for m, t in ((1, ""), (2, ""))]
    want |= {(98, 1): "", (98, 2): ""}
    rows.append((99, 1, "alone", "ACGT" * 20, "I" * 80))
    want[99, 1] = "ACGT" * 20
    out = trim.trim_adapters(spark.createDataFrame(rows, "ordinal long, mate int, name string, seq string, qual string"), ["ordinal"])
    assert {(r["ordinal"], r["mate"]): r["seq"] for r in out.collect()} == want
    assert all(len(r["seq"]) == len(r["qual"]) for r in out.collect())
    assert sum(len(s) < 90 for s in want.values()) > 20


def test_reports_are_mended_and_checked(tmp_path):
    sound = {"summary": {"before_filtering": {"total_reads": 20}, "after_filtering": {"total_reads": 16}}, "command": "x"}
    text = json.dumps(sound)
    assert parse_report(text) == (sound, False)
    broken = text.replace('"command": "x"', '"command":"tool -i "a b" \\q "') + "\n"
    assert parse_report(broken) == (sound | {"command": None}, True)
    path = write(tmp_path / "r.json", broken)
    assert normalised_report(path, 10, 8)["adapter"] == {"command_removed": True, "counts_checked": True}
    for bad in ((9, 8), (10, 9)):
        with pytest.raises(GateError, match="reads"):
            normalised_report(path, *bad)
    for bad in ("{", '{"command":"x"', '{"a": [, "command": "x"}', "nothing"):
        with pytest.raises(GateError):
            parse_report(bad)


def manifest():
    files = [{"run": f"ERR{r}", "mate": m, "name": f"ERR{r}_{m}.fastq.gz", "sample_accession": f"SAMEA{s}", "individual": f"I{s}", "url": f"https://ftp.sra.ebi.ac.uk/vol1/fastq/ERR/ERR{r}/ERR{r}_{m}.fastq.gz", "md5": "AB" * 16, "bytes": 10} for r, s in ((100, 1), (101, 1), (102, 2)) for m in (1, 2)]
    return {"schema_version": 1, "status": "ready", "study": "PRJEB12", "reference": {"assembly": "a", "fasta_sha256": "0" * 64}, "files": files}


def test_manifests(spark, tmp_path):
    good = manifest()
    rows = acquire.read_manifest(spark, write(tmp_path / "m.json", json.dumps(good, indent=1)), 60)
    assert rows.count() == 6 and {r["md5"] for r in rows.collect()} == {"ab" * 16}

    def bad(change, match, most=60):
        m = manifest()
        change(m)
        with pytest.raises(GateError, match=match):
            acquire.read_manifest(spark, write(tmp_path / "bad.json", json.dumps(m)), most)

    bad(lambda m: None, "larger", 59)
    bad(lambda m: m.update(study="x"), "study")
    bad(lambda m: m.update(reference={}), "assembly, reference")
    bad(lambda m: m.update(files=[]), "files")
    bad(lambda m: m["files"].pop(), "pairs")
    bad(lambda m: m["files"].append(m["files"][0]), "repeated")
    for key, value in (("name", "../x"), ("url", "https://elsewhere/ERR100_1.fastq.gz"), ("md5", "x"), ("bytes", 0), ("individual", "a/b"), ("mate", 3), ("sample_accession", "x")):
        bad(lambda m, k=key, v=value: m["files"][0].update({k: v}), "mate" if key == "mate" else {"sample_accession": "sample"}.get(key, key))
    bad(lambda m: [f.update(individual="I1") for f in m["files"]], "individual is several")
    bad(lambda m: [f.update(individual="I9") for f in m["files"][2:4]], "sample is several")
    mapping = write(tmp_path / "map.tsv", "individual\tsample_accession\nI1\tSAMEA1\nI2\tSAMEA2\n")
    assert acquire.read_mapping(spark, mapping).count() == 2
    with pytest.raises(GateError, match="repeated"):
        acquire.read_mapping(spark, write(tmp_path / "two.tsv", "individual\tsample_accession\nI1\tSAMEA1\nI1\tSAMEA2\n"))


def test_selection(spark, tmp_path, capsys):
    original = write(tmp_path / "o.psam", "#IID\tSEX\nA\t1\nB\t1\nC\t2\nD\t2\nE\t1\n")
    kept = write(tmp_path / "k.psam", "#FID\tIID\nA\tA\nB\tB\nC\tC\nD\tD\n")
    pairs = write(tmp_path / "p.kin0", "#IID1\tIID2\tKINSHIP\nB\tA\t0.3\nC\tD\t0.01\n")
    people = write(tmp_path / "m.tsv", "sample\tpopulation\n" + "".join(f"{s}\tP{i % 2}\n" for i, s in enumerate("ABCDE")))
    args = ["cohort-select", "--original", original, "--psam", kept, "--kinship", pairs, "--policy", "exclude"]
    assert cli.main([*args, "--out", str(tmp_path / "s"), "--samples", people]) == 0
    report = json.loads((tmp_path / "s/selection.json").read_text())
    assert report == json.loads(capsys.readouterr().out) and report["reported_pairs"] == 1
    assert (report["retained"], report["relatedness_excluded"], report["sample_qc_excluded"]) == (["A", "C", "D"], [{"sample": "B", "related_to": "A"}], ["E"])
    assert (tmp_path / "s/keep.tsv").read_text() == "#FID\tIID\nA\tA\nC\tC\nD\tD\n"
    assert (tmp_path / "s/samples.tsv").read_text() == "sample\tpopulation\nA\tP0\nC\tP0\nD\tP1\n"
    short = write(tmp_path / "short.tsv", "sample\tpopulation\nA\tP\n")
    assert cli.main([*args, "--out", str(tmp_path / "t"), "--samples", short]) == 1
    assert cli.main([*args, "--out", str(tmp_path / "u")]) == 0 and "\tALL" in (tmp_path / "u/samples.tsv").read_text()


def test_eigenpairs_are_checked(spark, tmp_path):
    rng = np.random.default_rng(3)
    n, m, pcs = 12, 60, 3
    dose = rng.integers(0, 3, (m, n))
    dose[:, 0], dose[:, 1] = 0, 2
    dose[5, 3] = -1
    names = [f"N{i}" for i in range(n)]
    text = {0: "0/0", 1: "0|1", 2: "1/1", -1: "./."}
    rows = [("1", 10 + k, f"rs{k}", "A", "C", "PASS", "GT", " ".join(text[int(x)] for x in d)) for k, d in enumerate(dose)]
    rows += [("1", 900, "rs7", "A", "C", "PASS", "GT", " ".join(["0/1"] * n)), ("1", 901, "flat", "A", "C", "PASS", "GT", " ".join(["0/0"] * n)), ("1", 902, "two", "A", "C,G", "PASS", "GT", " ".join(["0/1"] * n))]
    source = write(tmp_path / "c.bcf", bcf(vcf(rows, names)))
    chosen = [f"rs{k}" for k in range(0, m, 2)]
    z = pca.standardised_rows([bytes((np.where(d < 0, 3, d) + 48).astype(np.uint8)) for d in dose[::2]])
    values, vectors = np.linalg.eigh(z.T @ z / len(z))
    values, vectors = values[::-1][:pcs], vectors[:, ::-1][:, :pcs]
    psam = write(tmp_path / "c.psam", "#IID\n" + "".join(f"{x}\n" for x in names))
    vec = lambda rows: write(tmp_path / "v.vec", "#FID\tIID\tPC1\tPC2\tPC3\n" + "".join(f"{x}\t{x}\t" + "\t".join(f"{y:.8g}" for y in v) + "\n" for x, v in rows))
    val = lambda v: write(tmp_path / "v.val", "".join(f"{x:.8g}\n" for x in v))
    mark = lambda ids: write(tmp_path / "m.in", "".join(f"{x}\n" for x in ids))
    good = list(zip(names, vectors))[::-1]
    report = runs.check_pca(spark, psam, pcs, vec(good), val(values), source, mark(chosen))
    assert report["validated"] and report["markers"] == 30 and max(report["residuals"]) < 1e-5
    assert runs.check_pca(spark, psam, pcs) == {"samples": n, "pcs": pcs}
    assert runs.check_pca(spark, psam, pcs, vec(good), val(values))["residuals"] is None
    for args, match in (
        ((vec(good), val(values * 1.01), source, mark(chosen)), "residual"),
        ((vec(good), val(values), source, mark([*chosen, "nowhere"])), "no record"),
        ((vec(good), val(values), source, mark([*chosen, "flat"])), "no variation"),
        ((vec(good), val(values), source, mark([*chosen, "two"])), "several"),
        ((vec(good), val(values), source, mark([*chosen, chosen[0]])), "repeated"),
        ((vec(good[1:]), val(values)), "differ"),
        ((vec([*good, good[0]]), val(values)), "repeated"),
        ((vec([(x, v * 1.1) for x, v in good]), val(values)), "orthonormal"),
        ((vec(good), None), "together"),
        ((vec(good), val(values), source, None), "together"),
    ):
        # The files are written anew for each case, in the order of the arguments.
        args = tuple(args)
        with pytest.raises(ValueError, match=match):
            if match == "residual":
                val(values * 1.01)
            elif match == "orthonormal":
                vec([(x, v * 1.1) for x, v in good])
            else:
                val(values)
                vec(good[1:] if match == "differ" else [*good, good[0]] if match == "repeated" and len(args) == 2 else good)
            if len(args) > 3 and args[3]:
                mark({"no record": [*chosen, "nowhere"], "no variation": [*chosen, "flat"], "several": [*chosen, "two"], "repeated": [*chosen, chosen[0]]}.get(match, chosen))
            runs.check_pca(spark, psam, pcs, *args)
    with pytest.raises(GateError):
        runs.check_pca(spark, psam, n)


def test_reads_in_repeats_are_placed_without_confidence(spark):
    rng = random.Random(6)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = base(200)
    reference = base(500) + unit * 90 + base(500)
    size = 1000
    chunks = spark.createDataFrame([("1", i // size, reference[i : i + size]) for i in range(0, len(reference), size)], "contig string, chunk long, bases string")
    wide = placement.overlapping_chunks(chunks, size, 400)
    starts = {1: 20, 2: 500 + 40 * 200 + 10, 3: 500 + 3 * 200}
    reads = spark.createDataFrame([("r", k, m, reference[s : s + 100] if m == 1 else complement(reference[s + 150 : s + 250])) for k, s in starts.items() for m in (1, 2)], "run string, ordinal long, mate int, seq string")
    out = {r["ordinal"]: r for r in placement.placed_pairs(reads, wide, size).collect()}
    assert set(out) == {1, 2, 3}
    assert (out[1]["start1"], out[1]["mapq"]) == (20, 42) and out[2]["mapq"] == out[3]["mapq"] == 0
    assert all((out[k]["start1"] - starts[k]) % 200 == 0 for k in (2, 3))


def test_file_offsets_and_random_states(spark):
    fasta = ">1\n" + "".join("ACGTACGTAC"[:10] + "\n" for _ in range(3)) + "ACG\n"
    rows = spark.range(33).select(g.fasta_offset(F.col("id"), F.lit(3), F.lit(10), F.lit(11)).alias("at"), "id")
    assert all(fasta[r["at"]] == "ACGTACGTAC"[r["id"] % 10] for r in rows.collect())
    sizes = spark.createDataFrame([(0,), (1,), (10,), (11,), (33,)], "n long").select(g.fasta_bytes(F.col("n"), F.lit(10), F.lit(11)).alias("b"))
    assert [r["b"] for r in sizes.collect()] == [0, 1, 10, 12, 36]
    state, want = spark.createDataFrame([(1729,)], "s long"), 1729
    for _ in range(5):
        state, want = state.select(g.next_random(F.col("s")).alias("s")), (want * 1664525 + 1013904223) % (1 << 32)
    assert state.first()["s"] == want
