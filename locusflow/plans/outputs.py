"""Reports that runs leave behind: evaluations, alignments of libraries, catalogues and manifests."""

from __future__ import annotations

import os
import re
import shutil

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators import acquire, evaluate, intervals
from locusflow.operators.sets import GateError, require_equal, require_unique
from locusflow.plans import runs
from locusflow.plans import workflow as w
from locusflow.session import persisted
from locusflow.sources import tables
from locusflow.sources.bgzf import parse_region
from locusflow.sources.vcf import read_variants

RULE = "SNPs with one alternative in confident regions, by contig, position, reference and alternative; genotypes without phase; no haplotypes"
POLICY = "marked per library over all its runs; left out of calls"
WIDTH = 4096


def _snps(spark: SparkSession, path: str, regions: DataFrame, sample: str | None) -> DataFrame:
    """(contig, pos, ref, alt, gt) of the SNPs of one sample inside the regions."""
    records, _, header = read_variants(spark, path)
    if sample is None and len(header.samples) != 1 or sample is not None and len(header.samples) > 1 and sample not in header.samples:
        raise GateError(f"{path}: name one of its samples")
    at = header.samples.index(sample) if sample in header.samples else 0
    single = (F.length("ref") == 1) & (F.size("alts") > 0) & F.forall("alts", lambda a: F.length(a) == 1)
    text = F.array_join(F.transform(F.get("calls", F.lit(at))["gt"], lambda a: a.cast("string")), "/", ".")
    rows = records.where(single).select("contig", "pos", "ref", F.array_join("alts", ",").alias("alt"), text.alias("gt"), intervals.bed_position(F.col("pos")).alias("at"))
    return intervals.interval_semi(rows, "contig", "at", regions, "contig", "start", "end", WIDTH).drop("at")


def run_evaluation(spark: SparkSession, calls: str, truth: str, bed: str, region: str, out: str, margin: int = 0, sample: str | None = None) -> dict:
    """Compares calls with a truth set inside the confident intervals of a region, less a margin on either side.

    A file with one sample needs no name; the report goes to the file ``out``.
    """
    contig, begin, end = parse_region(region)
    begin, end = begin + margin, end - margin
    if begin >= end:
        raise GateError("the margin takes the whole region")
    clipped = {"start": F.greatest("start", F.lit(begin)), "end": F.least("end", F.lit(end))}
    regions = persisted(tables.read_bed(spark, bed).where(F.col("contig") == contig).withColumns(clipped).where("start < `end`"), "regions")
    bases = regions.agg(F.sum(F.col("end") - F.col("start"))).first()[0] or 0
    if not bases:
        raise GateError("no confident bases in the region")
    sides = [persisted(_snps(spark, path, regions, sample), "snps") for path in (truth, calls)]
    found = evaluate.evaluate(*sides).first().asDict()
    report = {"calls": calls, "truth": truth, "confident_regions": bed, "region": region, "margin_bases": margin, "evaluated_interval": f"{contig}:{begin + 1}-{end}", "confident_bases_evaluated": bases, "snps": found | {"ambiguous_positions": evaluate.ambiguous(*sides).count()}, "method": RULE}
    os.makedirs(os.path.dirname(os.path.abspath(out)), exist_ok=True)
    w.write_json(out, report)
    return report


def run_alignments(spark: SparkSession, bams: list[str], samples: list[str], libraries: list[str], index: str, out: str, metadata: str | None = None) -> dict:
    """Checks alignments and leaves bams.list, samples.tsv and alignments.json in the folder ``out``."""
    from locusflow.plans.configs import read_people

    people = read_people(spark, metadata, sorted(set(samples)))
    found = runs.check_alignments(spark, bams, samples, libraries, index)
    with runs.Staged(out, inputs=(*bams, index)) as folder:
        with open(f"{folder}/bams.list", "w", encoding="utf-8") as f:
            f.writelines(f"{b}\n" for b in bams)
        runs.write_table(people.orderBy("sample"), f"{folder}/samples.tsv")
        report = {"samples": len(set(samples)), "libraries": found, "duplicate_policy": POLICY}
        w.write_json(f"{folder}/alignments.json", report)
    return report


def run_catalogue(spark: SparkSession, report: str, study: str, out: str, chosen: list[str] | None = None, mapping: str | None = None, assembly: str | None = None, sha256: str | None = None) -> dict:
    """Validates a study's file report: metadata.tsv, catalog.json and, with a mapping and a reference, manifest.json.

    ``chosen`` names runs; each must be there once. A manifest is only made if no run has a problem.
    """
    if not re.fullmatch(acquire.STUDY, study):
        raise GateError("not a study accession")
    rows = tables.read_tsv(spark, report, list(acquire.REPORT))
    if chosen:
        wanted = spark.createDataFrame([(x,) for x in chosen], "run_accession string")
        require_unique(wanted, ["run_accession"], "runs that were chosen")
        rows = rows.join(wanted, "run_accession", "left_semi")
        require_equal(rows, wanted, ["run_accession"], "runs of the report and those that were chosen")
    require_unique(rows, ["run_accession"], "runs of the report")
    checked = acquire.catalogue(rows)
    checked = persisted(checked.withColumn("problems", F.when(F.col("study_accession") == study, F.col("problems")).otherwise(F.array_append("problems", F.lit("study")))), "catalogue")
    listed = checked.orderBy("run_accession").collect()
    if not listed:
        raise GateError("the report has no runs")
    files = lambda r: [{"mate": i + 1, "url": f["url"], "md5": f["md5"], "bytes": int(f["bytes"])} for i, f in enumerate(r["files"])] if not r["problems"] else []
    catalogue = {"schema_version": 1, "study": study, "source": os.path.abspath(report), "runs": [{k: r[k] for k in ("sample_accession", "secondary_sample_accession", "library_layout", "problems")} | {"run": r["run_accession"], "files": files(r)} for r in listed]}
    with runs.Staged(out, inputs=(report,)) as folder:
        shutil.copyfile(report, f"{folder}/metadata.tsv")
        w.write_json(f"{folder}/catalog.json", catalogue)
        if mapping is not None:
            if not assembly or not re.fullmatch("[0-9a-fA-F]{64}", sha256 or ""):
                raise GateError("a manifest needs the reference's assembly and SHA-256")
            if any(r["problems"] for r in listed):
                raise GateError("a run has problems: no manifest is made")
            found = acquire.manifest(checked, acquire.read_mapping(spark, mapping)).orderBy("run_accession", "mate").collect()
            entries = [{"run": r["run_accession"], **{k: r[k] for k in ("mate", "name", "sample_accession", "individual", "url", "md5", "bytes")}} for r in found]
            w.write_json(f"{folder}/manifest.json", {"schema_version": 1, "status": "ready", "study": study, "reference": {"assembly": assembly, "fasta_sha256": sha256.lower()}, "files": entries})
    return catalogue
