"""Command line: ``python -m locusflow.cli VERB ...``. A report goes to stdout as JSON, an error to stderr with exit code 1."""

from __future__ import annotations

import argparse
import importlib.metadata
import json
import shutil
import sys

from locusflow.operators.sets import GateError
from locusflow.plans.workflow import WorkflowError


def _spark():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("locusflow").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def doctor() -> dict:
    """What this machine has."""
    found = {}
    for name in ("pyspark", "pyarrow", "numpy", "pandas"):
        try:
            found[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            found[name] = None
    return {"python": sys.version.split()[0], "java": shutil.which("java"), "packages": found, "ok": all(found.values())}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="locusflow")
    verbs = p.add_subparsers(dest="verb", required=True)

    def verb(name: str, *options: tuple) -> None:
        v = verbs.add_parser(name)
        for names, kw in options:
            v.add_argument(*names, **kw)

    path = lambda n, **kw: ((f"--{n}",), {"required": True, **kw})
    least = [(("--min-dp",), {"type": int, "default": 0}), (("--min-gq",), {"type": int, "default": 0}), (("--replace",), {"action": "store_true"})]
    verb("stats", path("input"), path("samples"), path("out"), *least)
    verb("mask", path("input"), path("output"), *least)
    verb("doctor")
    verb("plan", path("config"), (("--verify-inputs",), {"action": "store_true"}))
    verb("run", path("config"), (("--verify-inputs",), {"action": "store_true"}))
    verb("cohort-select", path("original"), path("psam"), path("kinship"), path("out"), (("--policy",), {"required": True, "choices": ["retain", "exclude"]}), (("--threshold",), {"type": float, "default": 0.0884}), (("--samples",), {}), (("--assembly",), {}))
    verb("pca-check", path("psam"), path("pcs", type=int), (("--vectors",), {}), (("--values",), {}), (("--bcf",), {}), (("--markers",), {}))
    verb("region-ranges", (("index",), {}), (("region",), {}), (("header",), {"nargs": "?"}))
    verb("raw-fastq", path("first"), path("second"), (("--fastp-report",), {}), (("--before",), {}), (("--report-out",), {}))
    verb("raw-reference", path("input"), path("sha256"), path("max-bases", type=int), path("out"))
    verb("raw-bams", path("bam", action="append"), path("sample", action="append"), path("library", action="append"), path("reference-index"))
    return p


def execute(a: argparse.Namespace) -> dict | list:
    if a.verb == "doctor":
        return doctor()
    if a.verb == "region-ranges":
        from locusflow.sources import bgzf
        from locusflow.sources.sequences import bam_header

        return bgzf.byte_ranges(bgzf.Index(a.index), a.region, bam_header(a.header)[1] if a.header else None)
    from locusflow.plans import runs

    spark = _spark()
    if a.verb == "stats":
        return runs.run_stats(spark, a.input, a.samples, a.out, a.min_dp, a.min_gq, a.replace)
    if a.verb == "mask":
        return runs.run_mask(spark, a.input, a.output, a.min_dp, a.min_gq, a.replace)
    if a.verb in ("plan", "run"):
        from locusflow.plans import configs

        flow = configs.of_file(spark, a.config)
        return flow.plan(a.verify_inputs) if a.verb == "plan" else flow.run(a.verify_inputs)
    if a.verb == "cohort-select":
        return runs.run_selection(spark, a.original, a.psam, a.kinship, a.out, a.policy, a.threshold, a.samples, a.assembly)
    if a.verb == "pca-check":
        return runs.check_pca(spark, a.psam, a.pcs, a.vectors, a.values, a.bcf, a.markers)
    if a.verb == "raw-fastq":
        found = runs.check_fastq_pair(spark, a.first, a.second)
        return found if a.fastp_report is None else runs.check_trimming(a.fastp_report, a.before, found, a.report_out)
    if a.verb == "raw-reference":
        return runs.prepare_reference(spark, a.input, a.sha256, a.max_bases, a.out)
    return runs.check_alignments(spark, a.bam, a.sample, a.library, a.reference_index)


def main(args: list[str] | None = None) -> int:
    try:
        print(json.dumps(execute(parser().parse_args(args)), indent=1, ensure_ascii=False))
    except (GateError, WorkflowError, ValueError, OSError) as e:
        print(f"Error: {e}", file=sys.stderr)
        return 1
    except Exception as e:  # a worker's error keeps its own message
        print(f"Error: {str(e).strip().splitlines()[-1] if str(e).strip() else e!r}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
