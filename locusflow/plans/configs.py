"""Run configurations: JSON files that say what to run, for genotypes, for reads, or as tasks of one's own.

A configuration is checked as a whole before anything runs: unknown keys, values out of range, paths and references that
lead nowhere are errors. Relative paths are relative to the configuration's folder.
"""

from __future__ import annotations

import json
import os
import re
import shutil
import subprocess
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import acquire, normalize
from locusflow.operators.sets import GateError
from locusflow.plans import runs
from locusflow.plans import workflow as w
from locusflow.session import persisted
from locusflow.sources import sequences, tables
from locusflow.sources.bcf_sink import write_bcf
from locusflow.sources.vcf import OWN, parse_header, read_variants

NAME = re.compile("[A-Za-z0-9][A-Za-z0-9_.-]{0,127}")
PLACE = re.compile(r"\{(?:(input|task):([a-z0-9][a-z0-9_-]*)|(out))\}")
COMMANDS, OUTPUTS = 16, ("samples.tsv", "sites.tsv", "population_sites.tsv", "populations.tsv", "provenance.json")

# The ranges and defaults of settings, as (default, least, most); None has no default.
LIMITS = {"input_bytes": (None, 1, 500_000_000_000), "reference_bases": (None, 1, 3_900_000_000), "scratch_bytes": (None, 64 << 20, 500_000_000_000)}
PROCESSING = {
    "threads": (2, 1, 4), "memory_mb": (6144, 1024, 10240), "timeout_seconds": (3600, 1, 604_800), "min_length": (35, 15, 10_000), "qualified_quality": (20, 0, 40), "unqualified_percent": (40, 0, 100),
    "max_fragment": (1000, 1, 100_000), "min_mapping_quality": (20, 0, 60), "min_base_quality": (20, 0, 60), "max_depth": (250, 1, 1_000_000),
}
MACHINE = {"threads": (2, 1, 6), "memory_mb": (2048, 1152, 10240), "timeout_seconds": (3600, 1, 604_800)}
READS_QC = {"min_dp": (5, 1, 1_000_000_000), "min_gq": (10, 0, 1_000_000_000)}
MOST_RUNS = 64


def _once(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise GateError("a key occurs twice")
    return out


def _keys(value, known, what: str) -> dict:
    if not isinstance(value, dict):
        raise GateError(f"{what} must be an object")
    if unknown := value.keys() - set(known):
        raise GateError(f"{what}: unknown keys {', '.join(sorted(unknown))}")
    return value


def _numbers(value, ranges: dict, what: str) -> dict:
    """Whole numbers of a section, with its defaults."""
    out = {}
    for name, (default, least, most) in ranges.items():
        x = value.get(name, default)
        if isinstance(x, bool) or not isinstance(x, int) or not least <= x <= most:
            raise GateError(f"{what}: {name} must be a whole number within {least} and {most}")
        out[name] = x
    return out


def _text(value, what: str) -> str:
    if not isinstance(value, str) or not value:
        raise GateError(f"{what} must be a text")
    return value


def safe_name(name: str) -> str:
    """A relative path that stays where it is put: no empty part, no ``..``, no root, no control character."""
    parts = _text(name, "a file name").split("/")
    if any(p in ("", ".", "..") or re.search(r"[\x00-\x1f\\]", p) for p in parts):
        raise GateError(f"not a safe name: {name!r}")
    return name


def load(path: str) -> dict:
    """A configuration with its folder under ``_folder``."""
    with open(path, encoding="utf-8") as f:
        value = json.load(f, object_pairs_hook=_once)
    if not isinstance(value, dict) or value.get("schema_version", 1) != 1:
        raise GateError("the configuration must be an object of schema version 1")
    return value | {"_folder": os.path.dirname(os.path.abspath(path))}


def of_file(spark: SparkSession, path: str) -> w.Workflow:
    """The workflow that a configuration describes."""
    c = load(path)
    kind = c.get("workflow_type")
    if kind == "genotypes":
        return runs.genotype_workflow(spark, genotype_config(c))
    if kind == "reads":
        return reads_workflow(spark, c)
    if kind is None and "tasks" not in c:
        return runs.genotype_workflow(spark, runs.GenotypeConfig.of({k: x for k, x in c.items() if k != "_folder"}))
    if kind is not None:
        raise GateError("workflow_type must be genotypes or reads, or absent")
    return task_workflow(spark, c)


def _path(c: dict, value, what: str) -> str:
    return os.path.normpath(os.path.join(c["_folder"], _text(value, what)))


def _source(c: dict, value, what: str) -> str:
    path = _path(c, value, what)
    if not os.path.isfile(path):
        raise GateError(f"{what}: {path} isn't a file")
    return path


def genotype_config(c: dict) -> runs.GenotypeConfig:
    """Settings of a genotype run in sections, as the flat ones of GenotypeConfig."""
    _keys(c, ("_folder", "schema_version", "workflow_type", "work_dir", "assembly", "input", "reference", "reference_index", "samples", "resources", "qc", "analysis", "tools"), "the configuration")
    qc = _keys(c.get("qc", {}), ("min_dp", "min_gq", "sample_missing", "variant_missing"), "qc")
    analysis = _keys(c.get("analysis", {}), ("pcs", "pca_maf", "kinship_maf", "kinship_threshold", "relatedness_policy", "ld_window", "ld_step", "ld_r2", *MACHINE), "analysis")
    # Threads, memory and time are the session's; they are checked, so that a configuration means the same everywhere.
    _numbers(analysis, MACHINE, "analysis")
    reference = _source(c, c.get("reference"), "reference")
    index = _source(c, c.get("reference_index"), "reference_index")
    if not os.path.exists(f"{reference}.fai") or not os.path.samefile(index, f"{reference}.fai"):
        raise GateError("reference_index must be the index beside the reference")
    flat = {"work_dir": _path(c, c.get("work_dir"), "work_dir"), "input": _source(c, c.get("input"), "input"), "reference": reference, "assembly": _text(c.get("assembly"), "assembly")}
    if "samples" in c:
        flat["samples"] = _source(c, c["samples"], "samples")
    return runs.GenotypeConfig.of(flat | qc | {k: x for k, x in analysis.items() if k not in MACHINE})


# ---------------------------------------------------------------- reads


def _runs(c: dict, most: int) -> tuple[list[dict], int]:
    """(runs with ordinal names r1, r2, ... in their order, bytes of their files)."""
    listed = c.get("runs")
    if not isinstance(listed, list) or not 1 <= len(listed) <= MOST_RUNS:
        raise GateError(f"there must be 1 to {MOST_RUNS} runs")
    out, total, files = [], 0, []
    for i, r in enumerate(listed):
        _keys(r, ("id", "sample", "library", "read1", "read2"), "a run")
        for k in ("id", "sample", "library"):
            if not NAME.fullmatch(_text(r.get(k), f"a run's {k}")):
                raise GateError(f"bad name {r[k]!r}")
        paths = {k: _source(c, r.get(k), f"{k} of {r['id']}") for k in ("read1", "read2")}
        for p in paths.values():
            if any(os.path.samefile(p, q) for q in files):
                raise GateError(f"{p} is used twice")
            files.append(p)
            total += os.path.getsize(p)
            if not os.path.getsize(p):
                raise GateError(f"{p} is empty")
        out.append(r | paths | {"name": f"r{i + 1}"})
    if len({r["id"] for r in out}) != len(out):
        raise GateError("two runs have one id")
    if total > most:
        raise GateError("the reads are larger than allowed")
    return out, total


def read_people(spark: SparkSession, path: str | None, samples: list[str]) -> DataFrame:
    """(sample, population) of exactly these samples; without a file all are one population, ALL."""
    frame = spark.createDataFrame([(x,) for x in sorted(samples)], "sample string")
    if path is None:
        return frame.withColumn("population", F.lit("ALL"))
    return tables.read_metadata(spark, path, frame).select("sample", "population")


def records_of_calls(called: DataFrame, contigs: list[tuple[str, int]], samples: list[str]) -> tuple[DataFrame, object]:
    """(records as read_variants gives them, header) of one row per call: contig, pos, ref, alts, sample, gt, dp, gq."""
    spark = called.sparkSession
    lines = ["##fileformat=VCFv4.2", '##FILTER=<ID=PASS,Description="passed">', *(f"##contig=<ID={n},length={size}>" for n, size in contigs)]
    lines += [f'##FORMAT=<ID={k},Number=1,Type={t},Description="{k}">' for k, t in zip(OWN, ("String", "Integer", "Integer"), strict=True)]
    header = parse_header([*lines, "\t".join(["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT", *samples])], "calls")
    ranks = spark.createDataFrame([(n, i) for i, (n, _) in enumerate(contigs)], "contig string, contig_rank int")
    places = spark.createDataFrame(list(enumerate(samples)), "idx int, sample string")
    alleles = F.transform(F.split("gt", "[/|]"), lambda x: x.try_cast("int"))
    call = F.struct(alleles.alias("gt"), F.contains("gt", F.lit("|")).alias("phased"), F.col("dp").cast("int").alias("dp"), F.col("gq").cast("int").alias("gq"), F.lit(None).cast("string").alias("rest"))
    rows = called.join(F.broadcast(places), "sample").groupBy("contig", "pos", "ref", "alts").agg(F.sort_array(F.collect_list(F.struct("idx", call.alias("call")))).alias("c"))
    rows = rows.join(F.broadcast(ranks), "contig").withColumn("rec", F.xxhash64("contig", "pos", "ref", "alts"))
    empty = F.create_map().cast("map<string,string>")
    return rows.select("rec", "contig", "contig_rank", F.col("pos").cast("long").alias("pos"), F.lit(None).cast("string").alias("id"), "ref", "alts", F.lit(None).cast("double").alias("qual"), F.array(F.lit("PASS")).alias("filters"), empty.alias("info"), F.array(*map(F.lit, OWN)).alias("format"), F.transform("c", lambda x: x["call"]).alias("calls")), header


def reads_workflow(spark: SparkSession, c: dict) -> w.Workflow:
    """From reads to statistics: reference, checks of every run, calls on the autosomes, masking and counts."""
    _keys(c, ("_folder", "schema_version", "workflow_type", "work_dir", "assembly", "reference", "reference_sha256", "samples", "runs", "resources", "limits", "processing", "qc", "tools"), "the configuration")
    _text(c.get("assembly"), "assembly")
    reference, digest = _source(c, c.get("reference"), "reference"), _text(c.get("reference_sha256"), "reference_sha256")
    limits = _numbers(_keys(c.get("limits", {}), LIMITS, "limits"), LIMITS, "limits")
    given = _keys(c.get("processing", {}), [*PROCESSING, "trim_adapters"], "processing")
    p, trim = _numbers(given, PROCESSING, "processing"), given.get("trim_adapters", True)
    if not isinstance(trim, bool):
        raise GateError("trim_adapters must be true or false")
    q = _numbers(_keys(c.get("qc", {}), READS_QC, "qc"), READS_QC, "qc")
    listed, size = _runs(c, limits["input_bytes"])
    if acquire.scratch_bytes(os.path.getsize(reference), size) > limits["scratch_bytes"]:
        raise GateError("the run needs more room than allowed")
    people = _source(c, c["samples"], "samples") if "samples" in c else None
    samples = sorted({r["sample"] for r in listed})
    read_people(spark, people, samples)
    libraries = {key: f"lib{i + 1}" for i, key in enumerate(sorted({(r["sample"], r["library"]) for r in listed}))}
    chunk = sequences.CHUNK

    def prepared(_, out):
        runs.prepare_reference(spark, reference, digest, limits["reference_bases"], f"{out}/reference")

    def checked(run: dict) -> Callable:
        def check(_, out):
            w.write_json(f"{out}/reads.json", runs.check_fastq_pair(spark, run["read1"], run["read2"]))

        return check

    def called(done, out):
        folder = f"file://{done['reference']}/reference/reference.parquet"
        chunks = spark.read.parquet(folder).drop("of_contig")
        lengths = [(r["contig"], r["length"]) for r in chunks.where("length IS NOT NULL").orderBy("contig").select("contig", "length").collect()]
        autosomes = [r["contig"] for r in tables.read_bed(spark, f"file://{done['reference']}/reference/autosomes.bed").collect()]
        own = [r | {"library": libraries[r["sample"], r["library"]]} for r in listed]
        filters = {"min_length": p["min_length"], "qualified": p["qualified_quality"], "unqualified_percent": p["unqualified_percent"]}
        calls = runs.call_variants(spark, own, chunks.select("contig", "chunk", "bases"), chunk, p["min_mapping_quality"], p["min_base_quality"], p["max_depth"], trim, filters, p["max_fragment"], autosomes)
        records, header = records_of_calls(persisted(calls, "calls"), lengths, samples)
        n = write_bcf(records, header, f"{out}/cohort.bcf")
        w.write_json(f"{out}/calls.json", {"records": n, "samples": samples, "libraries": {v: list(k) for k, v in libraries.items()}})

    def normal(done, out):
        # A called site may have several alternatives; each becomes a record of its own.
        chunks = spark.read.parquet(f"file://{done['reference']}/reference/reference.parquet").select("contig", "chunk", "bases")
        found, _, header = read_variants(spark, f"{done['call']}/cohort.bcf")
        normalize.normalized(persisted(found, "records"), header, chunks, chunk).write.parquet(f"file://{out}/records.parquet")

    def masked(done, out):
        normal_records = spark.read.parquet(f"file://{done['normalize']}/records.parquet")
        runs.run_mask(spark, f"{done['call']}/cohort.bcf", f"{out}/mask", q["min_dp"], q["min_gq"], normal=normal_records)

    def counted(done, out):
        runs.write_table(read_people(spark, people, samples).orderBy("sample"), f"{out}/people.tsv")
        runs.run_stats(spark, f"{done['mask']}/mask/masked.bcf", f"{out}/people.tsv", f"{out}/stats")

    def s(name, run, needs=(), inputs=(), **params):
        return w.Stage(name, run, list(needs), params, runs.VERSION, list(inputs))

    checks = [s(f"{r['name']}-check", checked(r), inputs=[r["read1"], r["read2"]], id=r["id"]) for r in listed]
    return w.Workflow(
        _path(c, c.get("work_dir"), "work_dir"),
        [
            s("reference", prepared, inputs=[reference], sha256=digest, bases=limits["reference_bases"]),
            *checks,
            s("call", called, ["reference", *(x.name for x in checks)], runs=[[r[k] for k in ("id", "sample", "library")] for r in listed], trim=trim, **{k: x for k, x in p.items() if k not in ("threads", "memory_mb", "timeout_seconds")}),
            s("normalize", normal, ["reference", "call"]),
            s("mask", masked, ["call", "normalize"], **q),
            s("stats", counted, ["mask"], [people] if people else []),
        ],
    )


# ---------------------------------------------------------------- tasks


def _places(text: str, task: dict, inputs: dict) -> str:
    """A text whose placeholders all lead somewhere: an input, a task that this one depends on, its own output."""
    for m in PLACE.finditer(text):
        if m[1] == "input" and m[2] not in inputs:
            raise GateError(f"{task['id']}: there is no input {m[2]!r}")
        if m[1] == "task" and m[2] not in task.get("depends_on", []):
            raise GateError(f"{task['id']} doesn't depend on {m[2]!r}")
    if re.search("[{}]", PLACE.sub("", text)):
        raise GateError(f"{task['id']}: unknown placeholder in {text!r}")
    return text


def fill(text: str, inputs: dict[str, str], done: dict[str, str], out: str) -> str:
    """A text with its placeholders replaced, in one pass: what is put in isn't looked at again."""
    return PLACE.sub(lambda m: out if m[3] else inputs[m[2]] if m[1] == "input" else done[m[2]], text)


def run_commands(commands: list[list[str]], stdout: str | None, timeout: int, log: str) -> None:
    """Commands as one pipe, without a shell; the last one's output goes to a file. All must succeed in time."""
    with open(log, "wb") as errors, open(stdout or os.devnull, "wb") as last:
        started: list[subprocess.Popen] = []
        try:
            for i, argv in enumerate(commands):
                end = i == len(commands) - 1
                started.append(subprocess.Popen(argv, stdin=started[-1].stdout if started else subprocess.DEVNULL, stdout=last if end else subprocess.PIPE, stderr=errors))
                if len(started) > 1:
                    started[-2].stdout.close()  # so that a reader's end reaches its writer
            codes = [p.wait(timeout) for p in started]
        except subprocess.TimeoutExpired as e:
            raise w.WorkflowError(f"{commands[0][0]}: not done after {timeout} s") from e
        finally:
            for p in started:
                if p.poll() is None:
                    p.kill()
                    p.wait()
    if any(codes):
        with open(log, "rb") as f:
            f.seek(max(0, os.path.getsize(log) - 2000))
            raise w.WorkflowError(f"exit codes {codes}: {f.read().decode(errors='replace').strip()}")


def task_workflow(spark: SparkSession, c: dict) -> w.Workflow:
    """Tasks of one's own: statistics, and commands that are piped into each other."""
    _keys(c, ("_folder", "schema_version", "work_dir", "reference", "resources", "inputs", "tools", "tasks"), "the configuration")
    inputs = {n: _source(c, p, f"input {n}") for n, p in _keys(c.get("inputs"), c.get("inputs") or (), "inputs").items()}
    tools = {}
    for n, t in _keys(c.get("tools", {}), c.get("tools", {}), "tools").items():
        _keys(t, ("path", "version_args"), f"tool {n}")
        named = _text(t.get("path"), "a tool's path")
        found = shutil.which(named if os.sep not in named else _path(c, named, "a tool's path"))
        if found is None:
            raise GateError(f"tool {n}: {named} can't be run")
        tools[n] = found
    if not isinstance(c.get("tasks"), list) or not c["tasks"]:
        raise GateError("tasks must be a list")
    stages, outputs = [], {}
    for t in c["tasks"]:
        _keys(t, ("id", "kind", "depends_on", "pool", "memory_mb", "timeout_seconds", "commands", "outputs", "stdout", "input", "samples", "hts_threads", "min_dp", "min_gq"), "a task")
        _text(t.get("id"), "a task's id")
        if t.get("kind") not in ("stats", "command") or len(set(t.get("depends_on", []))) != len(t.get("depends_on", [])):
            raise GateError(f"{t['id']}: the kind must be stats or command, and each dependency named once")
        # Nothing is promised about a name of a task that isn't there: the workflow checks that.
        outputs[t["id"]] = list(OUTPUTS) if t["kind"] == "stats" else [safe_name(x) for x in t.get("outputs") or []]
    for t in c["tasks"]:
        needs = t.get("depends_on", [])
        timeout = _numbers(t, {"timeout_seconds": (3600, 1, 604_800)}, t["id"])["timeout_seconds"]
        if t["kind"] == "stats":
            least = _numbers(t, {"min_dp": (0, 0, 1_000_000_000), "min_gq": (0, 0, 1_000_000_000)}, t["id"])
            for k in ("input", "samples"):
                value = _places(_text(t.get(k), f"{t['id']}: {k}"), t, inputs)
                upstream = re.fullmatch(r"\{task:([a-z0-9][a-z0-9_-]*)\}/(.+)", value)
                if not re.fullmatch(r"\{input:[a-z0-9][a-z0-9_-]*\}", value) and not (upstream and upstream[2] in outputs.get(upstream[1], ())):
                    raise GateError(f"{t['id']}: {k} must be an input or an output of a task")

            def run(done, out, t=t, least=least):
                runs.run_stats(spark, fill(t["input"], inputs, done, out), fill(t["samples"], inputs, done, out), f"{out}/stats", **least)
                for name in os.listdir(f"{out}/stats"):
                    os.rename(f"{out}/stats/{name}", f"{out}/{name}")
                os.rmdir(f"{out}/stats")

            used = [inputs[m[2]] for k in ("input", "samples") for m in PLACE.finditer(t[k]) if m[1] == "input"]
            stages.append(w.Stage(t["id"], run, needs, least | {"from": [t["input"], t["samples"]]}, runs.VERSION, used))
            continue
        commands = t.get("commands")
        if not isinstance(commands, list) or not 1 <= len(commands) <= COMMANDS or not outputs[t["id"]] or "stdout" in t and t["stdout"] not in outputs[t["id"]]:
            raise GateError(f"{t['id']}: needs 1 to {COMMANDS} commands, outputs, and a stdout among them if any")
        argvs = []
        for x in commands:
            argv = _keys(x, ("argv", "threads"), "a command").get("argv")
            if not isinstance(argv, list) or not argv or argv[0] not in tools:
                raise GateError(f"{t['id']}: a command must begin with a tool that is named")
            argvs.append([argv[0], *(_places(_text(a, "an argument"), t, inputs) for a in argv[1:])])

        def run(done, out, t=t, argvs=argvs, timeout=timeout):
            log = f"{out}.log"
            run_commands([[tools[a[0]], *(fill(x, inputs, done, out) for x in a[1:])] for a in argvs], os.path.join(out, t["stdout"]) if "stdout" in t else None, timeout, log)
            os.remove(log)
            for name in outputs[t["id"]]:
                path = os.path.join(out, name)
                if not os.path.isfile(path) or os.path.islink(path) or not os.path.getsize(path):
                    raise w.WorkflowError(f"{t['id']}: {name} is missing or empty")

        used = sorted({inputs[m[2]] for a in argvs for x in a[1:] for m in PLACE.finditer(x) if m[1] == "input"})
        stages.append(w.Stage(t["id"], run, needs, {"commands": argvs, "outputs": outputs[t["id"]], "stdout": t.get("stdout")}, runs.VERSION, [*used, *(tools[a[0]] for a in argvs)]))
    return w.Workflow(_path(c, c.get("work_dir"), "work_dir"), stages)
