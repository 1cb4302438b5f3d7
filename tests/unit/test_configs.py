import hashlib
import json
import random

import pytest
from fixtures import COHORT, vcf, write
from test_cohort import HEADER, SAMPLES, cohort
from test_reads import RUNS, TRUTH, make_run

from locusflow.operators.sets import GateError
from locusflow.plans import configs
from locusflow.plans.workflow import WorkflowError
from locusflow.sources.vcf import read_variants


def save(tmp_path, value):
    return write(tmp_path / "config.json", json.dumps(value))


def reads_config(tmp_path):
    rng = random.Random(11)
    reference = "".join(rng.choice("ACGT") for _ in range(10_000))
    fasta = write(tmp_path / "ref.fa", ">1 description\n" + "".join(reference[i : i + 60] + "\n" for i in range(0, 10_000, 60)) + ">X\n" + reference[:600] + "\n")
    listed = []
    for run, sample, library in RUNS:
        a, b = make_run(reference, run, sample)
        write(tmp_path / f"{run}_1.fastq", a)
        write(tmp_path / f"{run}_2.fastq", b)
        listed.append({"id": run, "sample": sample, "library": library, "read1": f"{run}_1.fastq", "read2": f"{run}_2.fastq"})
    write(tmp_path / "people.tsv", "sample\tpopulation\nA\tP\nB\tP\nC\tQ\n")
    return {
        "schema_version": 1, "workflow_type": "reads", "work_dir": "w", "assembly": "drawn", "reference": "ref.fa", "reference_sha256": hashlib.sha256(open(fasta, "rb").read()).hexdigest(), "samples": "people.tsv", "runs": listed,
        "limits": {"input_bytes": 10**7, "reference_bases": 20_000, "scratch_bytes": 10**9}, "qc": {"min_dp": 5, "min_gq": 10}, "resources": {"threads": 8},
    }


def test_reads_from_a_configuration(spark, tmp_path):
    path = save(tmp_path, reads_config(tmp_path))
    done = configs.of_file(spark, path).run()
    assert set(done["ran"]) == {"reference", *(f"r{i}-check" for i in range(1, 6)), "call", "normalize", "mask", "stats"}
    where = done["results"]
    assert json.load(open(f"{where['r1-check']}/reads.json"))["pairs"] == 73
    calls = json.load(open(f"{where['call']}/calls.json"))
    assert calls == {"records": 3, "samples": ["A", "B", "C"], "libraries": {"lib1": ["A", "A_lib1"], "lib2": ["A", "A_lib2"], "lib3": ["B", "B_lib1"], "lib4": ["C", "C_lib1"]}}
    found = {r["pos"]: [c["gt"] for c in r["calls"]] for r in read_variants(spark, f"{where['mask']}/mask/masked.bcf")[0].collect()}
    text = {0: [0, 0], 1: [0, 1], 2: [1, 1], None: [None, None]}
    assert found == {pos: [text[t[s]] for s in "ABC"] for pos, t in TRUTH.items()}
    samples = open(f"{where['stats']}/stats/samples.tsv").read().splitlines()
    assert samples[1].startswith("A\tP\t3\t1\t3") and samples[3].startswith("C\tQ\t2\t0\t2\t1")
    assert configs.of_file(spark, path).run()["ran"] == []


def test_wrong_reads_configurations(spark, tmp_path):
    good = reads_config(tmp_path)

    def bad(match, **change):
        with pytest.raises((GateError, ValueError), match=match):
            configs.of_file(spark, save(tmp_path, good | change))

    bad("unknown keys", more=1)
    bad("whole number", qc={"min_dp": 0})
    bad("whole number", processing={"max_depth": True})
    bad("trim_adapters", processing={"trim_adapters": 1})
    bad("room", limits=good["limits"] | {"scratch_bytes": 64 << 20})
    bad("larger", limits=good["limits"] | {"input_bytes": 10})
    bad("isn't a file", reference="none.fa")
    bad("1 to 64", runs=[])
    bad("one id", runs=[good["runs"][0], good["runs"][1] | {"id": good["runs"][0]["id"]}])
    bad("used twice", runs=[good["runs"][0], good["runs"][0] | {"id": "again"}])
    bad("bad name", runs=[good["runs"][0] | {"sample": "a/b"}])
    bad("workflow_type", workflow_type="other")
    write(tmp_path / "few.tsv", "sample\tpopulation\nA\tP\n")
    bad("differ", samples="few.tsv")
    with pytest.raises(GateError, match="twice"):
        configs.load(write(tmp_path / "twice.json", '{"a": 1, "a": 2}'))


def test_genotypes_from_sections(spark, tmp_path):
    write(tmp_path / "c.vcf", vcf(cohort(), SAMPLES, HEADER))
    write(tmp_path / "r.fa", ">1\nA\n")
    write(tmp_path / "r.fa.fai", "1\t1\t3\t1\t2\n")
    write(tmp_path / "other.fai", "1\t1\t3\t1\t2\n")
    base = {
        "schema_version": 1, "workflow_type": "genotypes", "work_dir": "g", "assembly": "x", "input": "c.vcf", "reference": "r.fa", "reference_index": "r.fa.fai", "qc": {"min_dp": 10, "min_gq": 20},
        "analysis": {"pcs": 3, "threads": 2, "timeout_seconds": 60, "ld_window": 3, "relatedness_policy": "retain"},
    }
    flow = configs.of_file(spark, save(tmp_path, base))
    assert [s["stage"] for s in flow.plan()][0] == "normalize" and [s["stage"] for s in flow.plan()][-1] == "validate"
    assert flow.stages["prune"].params["step"] == 3 and flow.stages["normalize"].params == {"assembly": "x"}

    def bad(match, **change):
        with pytest.raises(GateError, match=match):
            configs.of_file(spark, save(tmp_path, {k: v for k, v in (base | change).items() if v is not None}))

    bad("unknown", analysis={"pc": 3})
    bad("ld_step", analysis=base["analysis"] | {"ld_window": 3, "ld_step": 4})
    bad("missing keys: relatedness_policy", analysis={"pcs": 3})
    bad("timeout_seconds", analysis=base["analysis"] | {"timeout_seconds": 0})
    bad("memory_mb", analysis=base["analysis"] | {"memory_mb": 64})
    bad("reference must be a text", reference=None)
    bad("isn't a file", reference="none.fa")
    bad("beside", reference_index="other.fai")
    bad("assembly", assembly=None)


def task_config(tmp_path):
    write(tmp_path / "c.vcf", vcf(COHORT, ["S1", "S2", "S3", "S4"]))
    write(tmp_path / "m.tsv", "sample\tpopulation\nS1\tA\nS2\tA\nS3\tB\nS4\tB\n")
    return {
        "schema_version": 1, "work_dir": "t", "inputs": {"cohort": "c.vcf", "samples": "m.tsv"}, "tools": {"cat": {"path": "cat"}, "gzip": {"path": "gzip"}, "cp": {"path": "cp"}, "sleep": {"path": "sleep"}, "false": {"path": "false"}},
        "tasks": [
            {"id": "convert", "kind": "command", "commands": [{"argv": ["cat", "{input:cohort}"]}, {"argv": ["gzip", "-c"], "threads": 1}], "stdout": "cohort.vcf.gz", "outputs": ["cohort.vcf.gz"]},
            {"id": "stats", "kind": "stats", "depends_on": ["convert"], "input": "{task:convert}/cohort.vcf.gz", "samples": "{input:samples}", "min_dp": 5},
            {"id": "copy", "kind": "command", "depends_on": ["stats"], "commands": [{"argv": ["cp", "{task:stats}/samples.tsv", "{out}/kept.tsv"]}], "outputs": ["kept.tsv"]},
        ],
    }


def test_tasks_of_one_s_own(spark, tmp_path):
    config = task_config(tmp_path)
    done = configs.of_file(spark, save(tmp_path, config)).run()
    assert done["ran"] == ["convert", "stats", "copy"]
    assert open(f"{done['results']['copy']}/kept.tsv").read() == open(f"{done['results']['stats']}/samples.tsv").read()
    assert configs.of_file(spark, save(tmp_path, config)).run()["reused"] == ["convert", "stats", "copy"]
    config["tasks"][1]["min_dp"] = 6
    assert configs.of_file(spark, save(tmp_path, config)).run()["ran"] == ["stats", "copy"]


def test_wrong_tasks(spark, tmp_path):
    good = task_config(tmp_path)

    def bad(match, task=0, run=False, **change):
        tasks = [dict(t) for t in good["tasks"]]
        tasks[task] |= change
        with pytest.raises((GateError, WorkflowError), match=match):
            flow = configs.of_file(spark, save(tmp_path, good | {"tasks": tasks, "work_dir": "bad"}))
            if run:
                flow.run()

    cat = lambda *a: [{"argv": ["cat", *a]}]
    bad("no input", commands=cat("{input:none}"))
    bad("doesn't depend", commands=cat("{task:stats}/x"))
    bad("placeholder", commands=cat("{other}"))
    bad("placeholder", commands=cat("{input:cohort"))
    bad("tool", commands=[{"argv": ["rm", "x"]}])
    bad("commands", commands=[])
    bad("stdout", stdout="elsewhere")
    for name in ("../x", "/x", "a//b", "a/./b", ""):
        bad("safe name|text", outputs=[name])
    bad("an output of a task", 1, input="{task:convert}/other")
    bad("unknown keys", shell="x")
    bad("doesn't exist", depends_on=["none"])
    bad("kind", kind="other")
    bad("exit codes", run=True, commands=[{"argv": ["cat", "{input:cohort}"]}, {"argv": ["false"]}])
    bad("missing or empty", run=True, commands=cat("/dev/null"))
    bad("not done", run=True, commands=[{"argv": ["sleep", "30"]}], timeout_seconds=1)
    assert configs.fill("{input:a}{out}", {"a": "{out}"}, {}, "o") == "{out}o"
