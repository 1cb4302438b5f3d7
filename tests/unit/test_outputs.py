import json

import pytest
from fixtures import bcf, bgzf, vcf, write
from test_reads import bam

from locusflow.operators import acquire
from locusflow.operators.sets import GateError
from locusflow.plans import outputs
from locusflow.sources import tables


def test_evaluation(spark, tmp_path):
    row = lambda pos, ref, alt, gts: ("1", pos, ".", ref, alt, "PASS", "GT", gts)
    truth = [row(10, "A", "C", "0/1"), row(20, "A", "C", "1|1"), row(30, "A", "C", "1|0"), row(40, "A", "C,G", "1/2"), row(50, "A", "AC", "0/1"), row(60, "A", "C", "0/0"), row(70, "A", "C", "0/1"), row(200, "A", "C", "0/1"), row(80, "A", "G", "0/1"), row(80, "A", "T", "0/1")]
    calls = [row(10, "A", "C", "0/0 0/1"), row(20, "A", "C", "0/0 0/1"), row(30, "A", "G", "0/0 0/1"), row(40, "A", "C", "0/0 0/1"), row(55, "G", "T", "0/0 1/1"), row(80, "A", "G", "0/0 0/1"), row(95, "A", "C", "0/0 0/1")]
    files = write(tmp_path / "t.vcf", vcf(truth, ["T"])), write(tmp_path / "c.bcf", bcf(vcf(calls, ["X", "T"])))
    bed = write(tmp_path / "r.bed", "1\t0\t90\n1\t150\t151\nchr2\t0\t50\n")
    report = outputs.run_evaluation(spark, files[1], files[0], bed, "1:1-1000", str(tmp_path / "sub/e.json"), sample="T")
    assert report == json.loads((tmp_path / "sub/e.json").read_text())
    assert report["confident_bases_evaluated"] == 91
    s = report["snps"]
    assert (s["true_positive"], s["false_positive"], s["false_negative"], s["genotype_match"], s["ambiguous_positions"]) == (2, 2, 2, 1, 2)
    assert outputs.run_evaluation(spark, files[1], files[0], bed, "1:5-25", str(tmp_path / "f.json"), 4, "T")["confident_bases_evaluated"] == 13
    for args, match in ((("1:5-10", 9), "margin"), (("chr9:1-10", 0), "confident")):
        with pytest.raises(GateError, match=match):
            outputs.run_evaluation(spark, files[1], files[0], bed, args[0], str(tmp_path / "g.json"), args[1], "T")
    with pytest.raises(GateError, match="name one"):
        outputs.run_evaluation(spark, files[1], files[0], bed, "1", str(tmp_path / "g.json"))


def test_alignments_of_libraries(spark, tmp_path):
    data = bam([(f"r{k // 2}", 0, 10 + k, 20) for k in range(6)], (("1", 500),))
    path, index = write(tmp_path / "a.bam", bgzf(data)), write(tmp_path / "r.fai", "1\t500\t3\t500\t501\n")
    with pytest.raises(GateError, match="no index"):
        outputs.run_alignments(spark, [path], ["S"], ["L"], index, str(tmp_path / "n"))
    write(tmp_path / "a.bam.bai", b"BAI\x01" + (1).to_bytes(4, "little") + bytes(8))
    report = outputs.run_alignments(spark, [path], ["S"], ["L"], index, str(tmp_path / "o"))
    assert report["libraries"][0]["records"] == report["libraries"][0]["usable"] == 6
    assert (tmp_path / "o/bams.list").read_text() == f"{path}\n" and (tmp_path / "o/samples.tsv").read_text() == "sample\tpopulation\nS\tALL\n"
    people = write(tmp_path / "p.tsv", "sample\tpopulation\nS\tP\nT\tP\n")
    with pytest.raises(GateError, match="differ"):
        outputs.run_alignments(spark, [path], ["S"], ["L"], index, str(tmp_path / "q"), people)


def report_of(tmp_path, name="r.tsv", **change):
    rows = []
    for r, s in ((100001, 1), (100002, 1), (100003, 2)):
        url = ";".join(f"ftp.sra.ebi.ac.uk/vol1/fastq/ERR100/ERR{r}/ERR{r}_{m}.fastq.gz" for m in (1, 2))
        rows.append({"run_accession": f"ERR{r}", "sample_accession": f"SAMEA{s}", "secondary_sample_accession": f"ERS{s}", "study_accession": "PRJEB1", "library_layout": "PAIRED", "fastq_ftp": url, "fastq_md5": "a" * 32 + ";" + "b" * 32, "fastq_bytes": "10;20"})
    rows[0] |= change
    return write(tmp_path / name, "\t".join(acquire.REPORT) + "\n" + "".join("\t".join(r[c] for c in acquire.REPORT) + "\n" for r in rows))


def test_catalogues_and_manifests(spark, tmp_path):
    mapping = write(tmp_path / "map.tsv", "sample_accession\tindividual\nSAMEA1\tI1\nSAMEA2\tI2\n")
    out = str(tmp_path / "o")
    found = outputs.run_catalogue(spark, report_of(tmp_path), "PRJEB1", out, None, mapping, "x", "0" * 64)
    assert [r["problems"] for r in found["runs"]] == [[], [], []] and found == json.loads((tmp_path / "o/catalog.json").read_text())
    # What was written passes the gates of those who read it.
    files = acquire.read_manifest(spark, f"{out}/manifest.json", 90)
    assert files.count() == 6 and {r["individual"] for r in files.collect()} == {"I1", "I2"}
    some = outputs.run_catalogue(spark, report_of(tmp_path), "PRJEB1", str(tmp_path / "p"), ["ERR100002"])
    assert [r["run"] for r in some["runs"]] == ["ERR100002"] and not (tmp_path / "p/manifest.json").exists()
    bad = report_of(tmp_path, "bad.tsv", study_accession="PRJEB2", library_layout="SINGLE")
    assert outputs.run_catalogue(spark, bad, "PRJEB1", str(tmp_path / "q"))["runs"][0]["problems"] == ["layout", "study"]
    for args, match in (((bad, "PRJEB1", str(tmp_path / "z"), None, mapping, "x", "0" * 64), "problems"), ((bad, "x", str(tmp_path / "z")), "study"), ((report_of(tmp_path), "PRJEB1", str(tmp_path / "z"), ["ERR9"]), "differ"), ((report_of(tmp_path), "PRJEB1", str(tmp_path / "z"), None, mapping), "assembly")):
        with pytest.raises(GateError, match=match):
            outputs.run_catalogue(spark, *args)
        assert not (tmp_path / "z").exists()


def test_panels(spark, tmp_path):
    path = write(tmp_path / "p.tsv", "sample\tpop\tsuper_pop\tgender\nA\tX\tY\tmale\nB\tX\tY\n")
    assert tables.read_panel(spark, path, 2).columns == ["sample", "population", "group"]
    for text, count, match in (("sample\tpop\tg\nA\tX\tY\n", 2, "1 samples"), ("sample\tpop\tg\nA\tX\tY\nA\tX\tY\n", None, "repeated"), ("sample\tpop\nA\tX\n", None, "three"), ("sample\tpop\tg\nA\tX\n", None, "fewer")):
        with pytest.raises(GateError, match=match):
            tables.read_panel(spark, write(tmp_path / "q.tsv", text), count)
