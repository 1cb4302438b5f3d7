"""Whole runs: inputs are checked, results are written to a staging folder and appear under their name at once."""

from __future__ import annotations

import os
import re
import shutil
from dataclasses import dataclass, field, fields

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators import ld, mask, normalize, packed_calls, packed_markers, pca, placement, reads, stats, trim
from locusflow.operators import relatedness as kin
from locusflow.operators.order import steps_back
from locusflow.operators.reports import normalised_report
from locusflow.operators.packed import MISSING, ZERO
from locusflow.operators.sets import GateError, require_equal
from locusflow.plans import workflow as w
from locusflow.session import columns_of, persisted, release, remove, scratch
from locusflow.sources import files, sequences, tables
from locusflow.sources.bgzf import Index
from locusflow.sources.bcf_sink import write_bcf, write_index
from locusflow.sources.files import size_of
from locusflow.sources.pgen import write_pgen
from locusflow.sources.pushdown import index_beside
from locusflow.sources.vcf import HET, HOM_ALT, HOM_REF, OTHER_ALLELE, OTHER_PLOIDY, header_of, read_header, read_variants, require_format

VERSION = "1.0"


def write_table(df: DataFrame, path: str) -> None:
    """A tab-separated file with a header, numbers with twelve digits and NA for null; rows in the frame's order.

    Sorted ranges are written by as many tasks and put together in their order.
    """
    lines = tables.as_text(df).select(F.concat_ws("\t", *columns_of(df)))
    _write_lines(lines, path, "\t".join(df.columns))


def _write_lines(lines: DataFrame, path: str, head: str | None = None) -> None:
    spark, parts = lines.sparkSession, scratch(lines.sparkSession, "lines")
    lines.write.text(parts)
    fs, base = files.open_uri(parts)
    names = sorted(i.path for i in fs.get_file_info(pyarrow.fs.FileSelector(base)) if i.base_name.startswith("part-"))
    with open(f"{path}.draft", "wb") as out:
        if head is not None:
            out.write(head.encode() + b"\n")
        for name in names:
            with fs.open_input_stream(name, compression=None) as part:
                while block := part.read(1 << 20):
                    out.write(block)
    os.replace(f"{path}.draft", path)
    remove(spark, parts)


class Staged:
    """A folder that appears under its name when the block ends without an error, and not at all otherwise."""

    def __init__(self, out: str, replace: bool = False, inputs: tuple[str, ...] = ()):
        self.out, self.replace = os.path.abspath(out), replace
        if any(os.path.abspath(p).startswith(self.out + os.sep) for p in inputs):
            raise GateError("an input lies inside the output")
        if os.path.exists(self.out) and not replace:
            raise GateError(f"{out} exists")

    def __enter__(self) -> str:
        self.folder = f"{self.out}.staging-{os.getpid()}"
        os.makedirs(self.folder)
        return self.folder

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            w.publish(self.folder, self.out, self.replace)
        else:
            shutil.rmtree(self.folder, ignore_errors=True)


def _sites(records: DataFrame) -> DataFrame:
    return records.withColumn("skip_reason", g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")))


def _split(spark: SparkSession, source: str) -> int:
    """Bytes of a part, so that every core gets some, within 4 and 64 MB."""
    return max(4 << 20, min(64 << 20, size_of(source) // (2 * spark.sparkContext.defaultParallelism)))


def run_stats(spark: SparkSession, source: str, samples: str, out: str, min_dp: int = 0, min_gq: int = 0, replace: bool = False) -> dict:
    """Counts by sample, site, population and (site, population) of a variant file, as tables and a provenance record."""
    with Staged(out, replace, (source, samples)) as folder:
        before = [w.identity(source), w.identity(samples, full=True)]
        used = {"dp": min_dp, "gq": min_gq}
        records, header_samples, header = read_variants(spark, source, calls="packed", qualities=",".join(k for k, on in used.items() if on), split=_split(spark, source))
        for key, on in used.items():
            if on:
                require_format(header, key.upper(), "1", "Integer")
        people = tables.read_metadata(spark, samples, header_samples).select("sample", "population")
        # As many names as a record has calls, in the header's order.
        population = {r["sample"]: r["population"] for r in people.collect()}
        names = sorted(set(population.values()))
        numbers = [names.index(population[x]) for x in header.samples]
        rows = _sites(records).drop("qual", "info", "format").withColumn("eligible", F.col("skip_reason").isNull())
        counted = persisted(packed_calls.count_packed(rows, numbers, len(names), min_dp, min_gq), "counts")
        totals = stats.record_totals(counted.where("site IS NOT NULL").select("site.skip_reason")).first().asDict()
        if not totals["eligible"]:
            raise GateError("no eligible record")
        if not counted.where("odd > 0").isEmpty():
            raise GateError("an allele is outside 0..1")
        keys = [F.col("contig").alias("chrom"), "pos"]
        groups = F.broadcast(spark.createDataFrame(list(enumerate(names)), "population_no int, population string"))
        ratios = stats.heterozygosity()
        by_pair = packed_calls.by_population(counted).join(groups, "population_no").select("rec", *keys, "population", *g.COUNTS, *ratios)
        rate = g.ratio(F.col("called"), F.lit(totals["eligible"])).alias("call_rate")
        people = spark.createDataFrame([(i, x, population[x]) for i, x in enumerate(header.samples)], "idx int, sample string, population string")
        write_table(people.join(packed_calls.by_sample(counted), "idx").orderBy("idx").select("sample", "population", *g.COUNTS, ratios[0], rate), f"{folder}/samples.tsv")
        write_table(packed_calls.by_site(counted).orderBy("rec").select(*keys, "id", "ref", F.element_at("alts", 1).alias("alt"), *g.COUNTS, *ratios), f"{folder}/sites.tsv")
        write_table(by_pair.orderBy("rec", "population").drop("rec"), f"{folder}/population_sites.tsv")
        write_table(stats.population_stats(by_pair).orderBy("population"), f"{folder}/populations.tsv")
        release(counted)
        if [w.identity(source), w.identity(samples, full=True)] != before:
            raise GateError("an input changed meanwhile")
        report = {"version": VERSION, "inputs": before, "options": {"min_dp": min_dp, "min_gq": min_gq}, **totals, "outputs": w.inventory(folder)}
        w.write_json(f"{folder}/provenance.json", report)
    return report


def run_mask(spark: SparkSession, source: str, out: str, min_dp: int, min_gq: int, replace: bool = False, normal: DataFrame | None = None) -> dict:
    """Masked eligible records as Parquet, partitioned by contig and sorted, and as BCF with its index, with a report.

    ``normal`` are the source's records after normalisation, if it came first.
    """
    with Staged(out, replace, (source,)) as folder:
        records, samples, header = read_variants(spark, source)
        for key in ("DP", "GQ"):
            require_format(header, key, "1", "Integer")
        require_format(header, "GT", "1", "String")
        bad = [s for s in header.samples if s in ("", "0", ".") or s.startswith("#") or re.search(r"[\s\x00-\x1f]", s)]
        if bad:
            raise GateError(f"bad sample id {bad[0]!r}")
        records = persisted(records, "records") if normal is None else normal
        mask.check_masking(records, min_dp, min_gq)
        masked = mask.mask_variants(records, min_dp, min_gq)
        # The folder's value is a copy: read back, it would lose its type.
        masked.withColumn("of_contig", F.col("contig")).repartitionByRange("contig_rank", "pos").sortWithinPartitions("contig_rank", "pos", "rec").write.partitionBy("of_contig").parquet(f"{folder}/variants.parquet")
        samples.coalesce(1).write.parquet(f"{folder}/samples.parquet")
        write_bcf(spark.read.parquet(f"file://{folder}/variants.parquet").drop("of_contig"), header, f"{folder}/masked.bcf")
        write_index(spark, f"{folder}/masked.bcf")
        rows = _sites(records).withColumn("eligible", F.col("skip_reason").isNull())
        packed = packed_markers.pack_calls(rows.select("rec", "skip_reason", "eligible", "calls"))
        counted = persisted(packed_calls.count_packed(packed, [0] * len(header.samples), 1, min_dp, min_gq), "counts")
        by_sample = {r["idx"]: r for r in packed_calls.by_sample(counted).collect()}
        kinds = {"kept": "called", "missing": "missing", "quality": "quality_filtered", "unsupported": "unsupported_ploidy"}
        per = [{"sample": x, **{k: by_sample[i][c] if i in by_sample else 0 for k, c in kinds.items()}} for i, x in enumerate(header.samples)]
        per = [r | {"masked": r["missing"] + r["quality"] + r["unsupported"]} for r in per]
        total = {"sample": None, **{k: sum(r[k] for r in per) for k in (*kinds, "masked")}}
        report = {**stats.record_totals(counted.where("site IS NOT NULL").select("site.skip_reason")).first().asDict(), "totals": total, "samples": sorted(per, key=lambda r: r["sample"])}
        release(counted, *([records] if normal is None else []))
        w.write_json(f"{folder}/report.json", report)
    return report


def select_cohort(spark: SparkSession, original: DataFrame, kept: DataFrame, pairs: DataFrame, policy: str, threshold: float = 0.0884) -> tuple[DataFrame, DataFrame]:
    """(retained samples, excluded samples with their reason). Policies: retain and exclude related samples."""
    if policy not in ("retain", "exclude"):
        raise GateError("the policy must be retain or exclude")
    if not kept.join(original, "sample", "left_anti").isEmpty():
        raise GateError("a sample isn't in the original cohort")
    failed = original.join(kept, "sample", "left_anti").select("sample", F.lit("sample_qc").alias("reason"))
    close = pairs.where(F.col("kinship") >= threshold)
    related = kin.related_exclusions(close) if policy == "exclude" else close.limit(0).select(F.col("a").alias("sample"), F.col("b").alias("reason"))
    retained = kept.join(related, "sample", "left_anti").select("sample")
    if retained.limit(3).count() < 3:
        raise GateError("fewer than three samples are left")
    return retained, failed.unionByName(related.select("sample", F.concat(F.lit("related_to:"), F.col("reason").cast("string")).alias("reason")))


GREEDY = "pairs in order of their names: the later one goes while both are there; not a largest unrelated set"


def run_selection(spark: SparkSession, original: str, psam: str, kinship: str, out: str, policy: str, threshold: float = 0.0884, samples: str | None = None, assembly: str | None = None) -> dict:
    """Selects a cohort from tables of samples and pairs: keep.tsv, samples.tsv and selection.json.

    ``samples`` is metadata with exactly the samples of the original cohort; without it all are one population, ALL.
    """
    if not 0 <= threshold <= 0.5:
        raise GateError("the threshold must be within 0 and 0.5")
    every, kept = tables.read_psam(spark, original), tables.read_psam(spark, psam)
    people = tables.read_metadata(spark, samples, every).select("sample", "population") if samples else every.withColumn("population", F.lit("ALL"))
    pairs = persisted(tables.read_kinship(spark, kinship, kept), "pairs")
    retained, excluded = (persisted(x, "selection") for x in select_cohort(spark, every, kept, pairs, policy, threshold))
    with Staged(out, inputs=tuple(p for p in (original, psam, kinship, samples) if p)) as folder:
        write_table(retained.orderBy("sample").select(F.col("sample").alias("#FID"), F.col("sample").alias("IID")), f"{folder}/keep.tsv")
        write_table(people.join(retained, "sample", "left_semi").orderBy("sample"), f"{folder}/samples.tsv")
        rows = excluded.orderBy("sample").collect()
        report = {
            "assembly": assembly,
            "policy": policy,
            "threshold": threshold,
            "reported_pairs": pairs.where(F.col("kinship") >= threshold).select("a", "b").distinct().count(),
            "retained": [r["sample"] for r in retained.orderBy("sample").collect()],
            "relatedness_excluded": [{"sample": r["sample"], "related_to": r["reason"].removeprefix("related_to:")} for r in rows if r["reason"] != "sample_qc"],
            "sample_qc_excluded": [r["sample"] for r in rows if r["reason"] == "sample_qc"],
            "algorithm": GREEDY if policy == "exclude" else "all samples stay",
        }
        w.write_json(f"{folder}/selection.json", report)
    return report


def _dosage_bytes(variants: DataFrame) -> DataFrame:
    """(rec, id, data, problem) of records with packed codes: dosages as packed rows, and what keeps a record out of PCA."""

    def run(batches):
        digit = np.full(256, ZERO + MISSING, np.uint8)
        digit[[HOM_REF, HET, HOM_ALT]] = [ZERO, ZERO + 1, ZERO + 2]
        for batch in batches:
            data, problems = [], []
            for codes, several in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
                c = np.frombuffer(codes.as_buffer(), np.uint8)
                count = np.bincount(c, minlength=256)
                called, alt = int(count[[HOM_REF, HET, HOM_ALT]].sum()), int(count[HET] + 2 * count[HOM_ALT])
                problems.append("several alternatives" if several else "ploidy" if count[OTHER_PLOIDY] else "allele" if count[OTHER_ALLELE] else "no call" if not called else "no variation" if alt in (0, 2 * called) else None)
                data.append(digit[c].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(data, pa.binary()), pa.array(problems, pa.string())], ["rec", "id", "data", "problem"])

    return variants.select("rec", "id", "codes", (F.size("alts") != 1).alias("several")).mapInArrow(run, "rec long, id string, data binary, problem string")


def check_pca(spark: SparkSession, psam: str, pcs: int, vectors: str | None = None, values: str | None = None, variants: str | None = None, markers: str | None = None) -> dict:
    """What an exact PCA may be asked for, and whether eigenpairs are those of the genotypes.

    Without files, only the numbers of samples and components are checked. Eigenvectors and eigenvalues come together, and
    so do variants and the list of markers: each marker must be there and fit, and the products of the standardised
    genotypes with the vectors must be the values times the vectors.
    """
    people = tables.read_psam(spark, psam)
    samples = people.count()
    if not 1 <= pcs < samples:
        raise GateError("there must be fewer components than samples")
    if samples > pca.MAX_SAMPLES:
        raise GateError(f"exact components are limited to {pca.MAX_SAMPLES} samples")
    report = {"samples": samples, "pcs": pcs}
    if (vectors is None) != (values is None) or (variants is None) != (markers is None) or markers and not vectors:
        raise GateError("eigenvectors and eigenvalues come together, and so do variants and markers")
    if vectors is None:
        return report
    eigenvalues = np.array(tables.read_numbers(spark, values, pcs))
    by_sample = {r["sample"]: r["pc"] for r in tables.read_vectors(spark, vectors, people, pcs).collect()}
    residual, count, order = None, 0, sorted(by_sample)
    if variants is not None:
        records, _, header = read_variants(spark, variants, calls="packed")
        require_equal(spark.createDataFrame([(x,) for x in header.samples], "sample string"), people, ["sample"], "samples of the variants and of the cohort")
        order = header.samples
        chosen = tables.read_markers(spark, markers)
        count = chosen.count()
        # The first record of an id is the marker.
        rows = records.join(chosen, records["id"] == chosen["marker"], "left_semi")
        first = persisted(rows.groupBy("id").agg(F.min_by(F.struct("rec", "id", "alts", "codes"), "rec").alias("r")).select("r.*"), "markers")
        missing = chosen.join(first, chosen["marker"] == first["id"], "left_anti").limit(1).collect()
        if not count or missing:
            raise GateError(f"marker {missing[0][0]!r} has no record" if missing else "no markers")
        packed = persisted(_dosage_bytes(first), "dosages")
        bad = packed.where("problem IS NOT NULL").orderBy("rec").limit(1).collect()
        if bad:
            raise GateError(f"marker {bad[0]['id']!r}: {bad[0]['problem']}")
        found = pca.Components(order, eigenvalues, np.array([by_sample[x] for x in order]), count)
        residual = pca.residuals(packed, found)
    found = pca.Components(order, eigenvalues, np.array([by_sample[x] for x in order]), count)
    return report | pca.check_components(found, residual) | {"validated": True}


@dataclass
class GenotypeConfig:
    """Settings of a genotype run; unknown keys and values out of range are errors.

    With a reference, records are normalised first; without one, they are taken as they are. The policy has no default: it
    decides whether samples go.
    """

    work_dir: str
    input: str
    relatedness_policy: str
    samples: str | None = None
    reference: str | None = None
    assembly: str | None = None
    min_dp: int = field(default=0, metadata={"range": (0, 1_000_000_000)})
    min_gq: int = field(default=0, metadata={"range": (0, 1_000_000_000)})
    sample_missing: float = field(default=0.1, metadata={"range": (0, 1)})
    variant_missing: float = field(default=0.1, metadata={"range": (0, 1)})
    kinship_maf: float = field(default=0.05, metadata={"range": (1e-6, 0.5)})
    kinship_threshold: float = field(default=0.0884, metadata={"range": (0, 0.5)})
    pca_maf: float = field(default=0.05, metadata={"range": (1e-6, 0.5)})
    ld_window: int = field(default=50, metadata={"range": (2, 100_000)})
    ld_step: int = field(default=5, metadata={"range": (1, 100_000)})
    ld_r2: float = field(default=0.2, metadata={"range": (1e-6, 1)})
    pcs: int = field(default=10, metadata={"range": (1, 50)})

    @classmethod
    def of(cls, value: dict) -> GenotypeConfig:
        known = {f.name: f for f in fields(cls)}
        if unknown := value.keys() - known.keys():
            raise GateError(f"unknown keys: {', '.join(sorted(unknown))}")
        if missing := {"work_dir", "input", "relatedness_policy"} - value.keys():
            raise GateError(f"missing keys: {', '.join(sorted(missing))}")
        for k, x in value.items():
            if limits := known[k].metadata.get("range"):
                if isinstance(x, bool) or not isinstance(x, (int, float)) or not limits[0] <= x <= limits[1] or isinstance(known[k].default, int) and not isinstance(x, int):
                    raise GateError(f"{k} must be within {limits[0]} and {limits[1]}")
        out = cls(**{"ld_step": min(cls.ld_step, value.get("ld_window", cls.ld_window))} | value)
        if out.ld_step > out.ld_window:
            raise GateError("ld_step must not be larger than ld_window")
        if out.relatedness_policy not in ("retain", "exclude"):
            raise GateError("relatedness_policy must be retain or exclude")
        for k in ("work_dir", "input", "samples", "reference", "assembly"):
            if not (x := value.get(k, "-")) or not isinstance(x, str):
                raise GateError(f"{k} must be a text")
        return out


def _write_psam(samples: list[str], path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write("#FID\tIID\n" + "".join(f"{x}\t{x}\n" for x in samples))


def _read_samples(path: str) -> list[str]:
    """The samples of a .psam file in its order, which is that of the markers' data; a run's own, so their number is known."""
    with open(path, encoding="utf-8") as f:
        return [line.rstrip("\n").split("\t")[1] for line in f][1:]


def genotype_workflow(spark: SparkSession, c: GenotypeConfig) -> w.Workflow:
    """The stages of a genotype run, each with only the settings that it depends on, so a changed one reruns what it must.

    Stages hand on markers as packed rows over the samples of a .psam file beside them. Executors read and write below
    ``work_dir``, which must be a folder that all machines mount.
    """

    def table(folder: str, name: str = "markers") -> DataFrame:
        return spark.read.parquet(f"file://{folder}/{name}.parquet")

    def save(df: DataFrame, folder: str, name: str = "markers") -> None:
        df.write.parquet(f"file://{folder}/{name}.parquet")

    def people(folder: str) -> list[str]:
        return _read_samples(f"{folder}/data.psam")

    def normal(_, out):
        chunks = persisted(sequences.read_reference(spark, c.reference).select("contig", "chunk", "bases"), "reference")
        records, _, header = read_variants(spark, c.input)
        records = persisted(records, "records")
        save(normalize.normalized(records, header, chunks, sequences.CHUNK), out, "records")
        release(records, chunks)
        w.write_json(f"{out}/normalized.json", {"records": table(out, "records").count(), "reference": w.identity(c.reference), "assembly": c.assembly})

    def masked(done, out):
        run_mask(spark, c.input, f"{out}/mask", c.min_dp, c.min_gq, normal=table(done["normalize"], "records") if c.reference else None)

    def imported(done, out):
        records = spark.read.parquet(f"file://{done['mask']}/mask/variants.parquet")
        ident = g.variant_id(F.col("contig"), F.col("pos"), F.col("ref"), F.element_at("alts", 1))
        rows = records.select("rec", "contig", "contig_rank", "pos", ident.alias("id"), "ref", F.element_at("alts", 1).alias("alt"), "calls")
        save(packed_markers.dosage_rows(packed_markers.pack_calls(rows)), out)
        _write_psam(read_header(c.input).samples, f"{out}/data.psam")

    def missing(done, out):
        samples, markers = people(done["import"]), table(done["import"])
        names = spark.createDataFrame(list(enumerate(samples)), "idx long, IID string")
        rate = g.ratio(F.col("missing"), F.col("total"))
        by_sample = names.join(packed_markers.missing_by_sample(markers), "idx").orderBy("idx")
        write_table(by_sample.select("IID", F.col("missing").alias("MISSING_CT"), F.col("total").alias("OBS_CT"), rate.alias("F_MISS")), f"{out}/data.smiss")
        by_marker = packed_markers.choose_samples(markers, list(range(len(samples)))).withColumn("total", F.lit(len(samples))).orderBy("contig_rank", "pos", "rec")
        write_table(by_marker.select(F.col("contig").alias("CHROM"), F.col("id").alias("ID"), F.col("missing").alias("MISSING_CT"), F.col("total").alias("OBS_CT"), rate.alias("F_MISS")), f"{out}/data.vmiss")

    def sample_qc(done, out):
        samples = people(done["import"])
        stay = packed_markers.missing_by_sample(table(done["import"])).where(g.ratio(F.col("missing"), F.col("total")) <= c.sample_missing)
        kept = sorted(r["idx"] for r in stay.select("idx").collect())
        if not kept:
            raise GateError("no sample is left")
        save(packed_markers.choose_samples(table(done["import"]), kept), out)
        _write_psam([samples[i] for i in kept], f"{out}/data.psam")

    def site_qc(done, out):
        samples = people(done["sample-qc"])
        save(table(done["sample-qc"]).where(g.ratio(F.col("missing"), F.lit(len(samples))) <= c.variant_missing), out)
        _write_psam(samples, f"{out}/data.psam")

    def kinship(done, out):
        samples = people(done["site-qc"])
        markers = packed_markers.with_maf(table(done["site-qc"]), len(samples)).where(F.col("maf") >= c.kinship_maf)
        numbers = persisted(_numbered(markers.select("rec"), "rec"), "numbers")
        turned, _ = packed_markers.turned(markers.join(numbers, "rec").select("at", "data"), len(samples))
        pairs = kin.king_of_packed(turned, c.kinship_threshold)
        names = [spark.createDataFrame(list(enumerate(samples)), f"{k} long, {k}_name string") for k in ("a", "b")]
        pairs = pairs.join(names[0], "a").join(names[1], "b").select(F.least("a_name", "b_name").alias("IID1"), F.greatest("a_name", "b_name").alias("IID2"), F.col("nsnp").alias("NSNP"), F.col("kinship").alias("KINSHIP"))
        write_table(pairs.orderBy("IID1", "IID2"), f"{out}/data.kin0")

    def selected(done, out):
        run_selection(spark, f"file://{done['import']}/data.psam", f"file://{done['site-qc']}/data.psam", f"file://{done['king']}/data.kin0", f"{out}/selection", c.relatedness_policy, c.kinship_threshold, c.samples, c.assembly)

    def retained(done, out):
        samples = people(done["site-qc"])
        keep = set(_read_samples(f"{done['select']}/selection/keep.tsv"))
        places = [i for i, x in enumerate(samples) if x in keep]
        save(packed_markers.choose_samples(table(done["site-qc"]), places), out)
        _write_psam([samples[i] for i in places], f"{out}/data.psam")
        order = ["contig_rank", "pos", "rec"]
        write_pgen(table(out), order, len(places), f"{out}/data.pgen")
        sites = table(out).orderBy(*order)
        write_table(sites.select(F.col("contig").alias("#CHROM"), F.col("pos").cast("string").alias("POS"), F.col("id").alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT")), f"{out}/data.pvar")

    def cohort(done, out):
        header, samples = read_header(c.input), people(done["retained"])
        place = {x: i for i, x in enumerate(header.samples)}
        records = spark.read.parquet(f"file://{done['mask']}/mask/variants.parquet").drop("of_contig")
        markers = table(done["retained"]).select("rec", F.col("id").alias("_id"))
        rows = packed_markers.calls_of(records, [place[x] for x in samples]).join(markers, "rec").withColumn("id", F.col("_id")).drop("_id")
        own = header_of(header, samples)
        write_bcf(rows, own, f"{out}/cohort.bcf")
        write_index(spark, f"{out}/cohort.bcf")

    def counted(done, out):
        run_stats(spark, f"{done['bcf']}/cohort.bcf", f"{done['select']}/selection/samples.tsv", f"{out}/stats")

    def pruned(done, out):
        n = len(people(done["retained"]))
        markers = packed_markers.with_maf(table(done["retained"]), n).where(F.col("maf") >= c.pca_maf)
        markers = persisted(ld.ranked(markers.withColumn("marker", F.col("rec")), "contig", F.struct("pos", "rec")), "markers")
        stay = ld.ld_prune(markers.select("contig", "rank", "marker", "data"), markers.select("marker", "maf"), c.ld_window, c.ld_r2, c.ld_step)
        chosen = markers.join(stay.select("marker"), "marker", "left_semi").select("rec", "contig", "contig_rank", "pos", "id", "data")
        save(chosen, out)
        _write_lines(table(out).orderBy("contig_rank", "pos", "rec").select("id"), f"{out}/data.prune.in")
        release(markers)

    def checked(done, out):
        w.write_json(f"{out}/check.json", check_pca(spark, f"file://{done['retained']}/data.psam", c.pcs))

    def components(done, out):
        samples = people(done["retained"])
        found = pca.principal_components(table(done["prune"]), samples, c.pcs)
        with open(f"{out}/data.eigenval", "w", encoding="utf-8") as f:
            f.writelines(f"{x:.17g}\n" for x in found.values)
        with open(f"{out}/data.eigenvec", "w", encoding="utf-8") as f:
            f.write("\t".join(["#FID", "IID", *(f"PC{i + 1}" for i in range(c.pcs))]) + "\n")
            f.writelines("\t".join([x, x, *(f"{v:.17g}" for v in row)]) + "\n" for x, row in zip(samples, found.vectors, strict=True))

    def validated(done, out):
        report = check_pca(spark, f"file://{done['retained']}/data.psam", c.pcs, f"file://{done['pca']}/data.eigenvec", f"file://{done['pca']}/data.eigenval", f"{done['bcf']}/cohort.bcf", f"file://{done['prune']}/data.prune.in")
        w.write_json(f"{out}/validation.json", report)

    def s(name, run, needs=(), inputs=(), **params):
        return w.Stage(name, run, list(needs), params, VERSION, list(inputs))

    first = [s("normalize", normal, inputs=[c.input, c.reference], assembly=c.assembly)] if c.reference else []
    return w.Workflow(
        c.work_dir,
        [
            *first,
            s("mask", masked, ["normalize"] if first else [], [c.input], min_dp=c.min_dp, min_gq=c.min_gq),
            s("import", imported, ["mask"]),
            s("missing", missing, ["import"]),
            s("sample-qc", sample_qc, ["import"], sample_missing=c.sample_missing),
            s("site-qc", site_qc, ["sample-qc"], variant_missing=c.variant_missing),
            s("king", kinship, ["site-qc"], maf=c.kinship_maf, threshold=c.kinship_threshold),
            s("select", selected, ["import", "site-qc", "king"], [c.samples] if c.samples else [], policy=c.relatedness_policy, threshold=c.kinship_threshold, assembly=c.assembly),
            s("retained", retained, ["site-qc", "select"]),
            s("bcf", cohort, ["mask", "retained"]),
            s("stats", counted, ["bcf", "select"]),
            s("prune", pruned, ["retained"], maf=c.pca_maf, window=c.ld_window, step=c.ld_step, r2=c.ld_r2),
            s("pca-check", checked, ["retained"], pcs=c.pcs),
            s("pca", components, ["retained", "prune", "pca-check"], pcs=c.pcs),
            s("validate", validated, ["retained", "pca", "bcf", "prune"], pcs=c.pcs),
        ],
    )


def _numbered(rows: DataFrame, column: str) -> DataFrame:
    """Distinct values with dense numbers from 0 in order, from sorted ranges and their counts."""
    parts = persisted(rows.repartitionByRange(column).sortWithinPartitions(column).select(column, F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("raw")), "numbered")
    sizes = sorted(map(tuple, parts.groupBy("part").agg(F.count("*"), F.min("raw")).collect()))
    starts, total = [], 0
    for part, n, raw in sizes:
        starts.append((part, total - raw))
        total += n
    shift = rows.sparkSession.createDataFrame(starts, "part int, shift long")
    return parts.join(F.broadcast(shift), "part").select(column, (F.col("raw") + F.col("shift")).cast("int").alias("at"))


def check_fastq_pair(spark: SparkSession, first: str, second: str) -> dict:
    """Totals of a pair of FASTQ files, after all records and their pairing were checked."""
    rows = persisted(sequences.read_fastq_pair(spark, first, second), "reads")
    bad = reads.pair_problems(rows).orderBy("ordinal").limit(1).collect()
    if bad:
        raise GateError(f"pair {bad[0]['ordinal']}: {bad[0]['problem']}")
    return reads.pair_totals(rows).first().asDict() | {"encoding": "phred33"}


def check_trimming(report: str, before: str | None, after: dict, out: str | None) -> dict:
    """Writes a trimming report as sound JSON, checked against the counts of the pairs before (a file) and after."""
    if before is None or out is None:
        raise GateError("a trimming report needs the counts before it and a place for the result")
    if os.path.exists(out):
        raise GateError(f"{out} exists")
    counts = w.read_json(before)
    if not counts or "pairs" not in counts:
        raise GateError(f"{before}: no counts")
    found = normalised_report(report, counts["pairs"], after["pairs"])
    w.write_json(out, found)
    return after | {"adapter": found["adapter"]}


#: Two alleles everywhere, as callers read it (fixed value of the format).
PLOIDY = "* * * * 2\n"


def prepare_reference(spark: SparkSession, source: str, sha256: str, max_bases: int, out: str) -> dict:
    """A checked reference as Parquet chunks, as a copy with its index, with its autosomes as intervals and their ploidy."""
    found = w.identity(source, full=True)
    if not re.fullmatch("[0-9a-f]{64}", sha256) or found["sha256"] != sha256:
        raise GateError("the reference isn't the one that is expected")
    with Staged(out, inputs=(source,)) as folder:
        chunks = persisted(sequences.read_reference(spark, source), "reference")
        contigs = chunks.where("length IS NOT NULL").select("contig", "length")
        lengths = {r["contig"]: r["length"] for r in contigs.collect()}
        if sum(lengths.values()) > max_bases:
            raise GateError("the reference is larger than allowed")
        if not all(lengths.values()):
            raise GateError("a contig is empty")
        autosomes = [c for c in lengths if re.fullmatch("(chr)?([1-9]|1[0-9]|2[0-2])", c)]
        if len({c.removeprefix("chr") for c in autosomes}) != len(autosomes):
            raise GateError("an autosome is there with and without chr")
        if not autosomes:
            raise GateError("the reference has no autosome")
        shutil.copyfile(source.removeprefix("file://"), f"{folder}/reference.fa")
        if w.identity(f"{folder}/reference.fa", full=True)["sha256"] != sha256:
            raise GateError("the reference changed meanwhile")
        with open(f"{folder}/reference.fa.fai", "w", encoding="utf-8") as f:
            f.writelines("\t".join(map(str, row)) + "\n" for row in sequences.fasta_index(f"{folder}/reference.fa"))
        with open(f"{folder}/ploidy.txt", "w", encoding="utf-8") as f:
            f.write(PLOIDY)
        chunks.withColumn("of_contig", F.col("contig")).write.partitionBy("of_contig").parquet(f"file://{folder}/reference.parquet")
        with open(f"{folder}/autosomes.bed", "w", encoding="utf-8") as f:
            f.writelines(f"{c}\t0\t{lengths[c]}\n" for c in autosomes)
        report = {"sha256": sha256, "bases": sum(lengths.values()), "contigs": lengths, "autosomes": len(autosomes)}
        w.write_json(f"{folder}/reference.json", report)
    return report


def check_alignments(spark: SparkSession, bams: list[str], samples: list[str], libraries: list[str], index: str) -> list[dict]:
    """Counts of each library after read groups, dictionary, index and order were checked."""
    expected = tables.read_fai(spark, index).select(F.col("contig"), F.col("length"))
    groups: set[str] = set()
    out = []
    for path, sample, library in zip(bams, samples, libraries, strict=True):
        _, names, lengths, rgs = sequences.bam_header(path)
        require_equal(spark.createDataFrame(list(zip(names, lengths, strict=True)), "contig string, length long"), expected, ["contig", "length"], "contigs of the alignments and of the reference")
        for ident, tags in rgs.items():
            if ident in groups or tags.get("SM") != sample or tags.get("LB") != library or tags.get("PL", "").upper() != "ILLUMINA":
                raise GateError(f"{path}: read group {ident} doesn't fit")
            groups.add(ident)
        if not rgs:
            raise GateError(f"{path}: no read groups")
        beside = index_beside(path, sequences.BAM_INDEX)
        if beside is None or len(Index(beside).contigs) != len(names):
            raise GateError(f"{path}: no index beside it, or one of other contigs")
        rows = persisted(sequences.read_alignments(spark, path).withColumn("library", F.lit(library)), "alignments")
        ranks = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "contig string, rank int")
        ranked = rows.join(F.broadcast(ranks), "contig", "left").select("ordinal", F.coalesce("rank", F.lit(1 << 30)).alias("rank"), "pos")
        # Records without a contig come last, in any order.
        key = F.struct("rank", F.when(F.col("rank") < 1 << 30, F.col("pos")).otherwise(0).alias("pos"))
        if steps_back(ranked, "ordinal", key).first()["steps_back"]:
            raise GateError(f"{path}: not sorted")
        counts = reads.library_counts(rows).first()
        if counts is None or not counts["usable"]:
            raise GateError(f"{path}: no usable pair")
        out.append(counts.asDict() | {"sample": sample, "bytes": size_of(path)})
    return out


def call_variants(spark: SparkSession, runs: list[dict], reference: DataFrame, size: int, min_mapq: int = 20, min_base_quality: int = 20, max_depth: int = 250, trim_adapters: bool = True, filters: dict | None = None, fragment: int = placement.FRAGMENT, contigs: list[str] | None = None) -> DataFrame:
    """Genotypes of all samples at variant sites from paired FASTQ files: contig, pos, ref, alts, sample, gt, dp, gq.

    Adapters are cut off before reads are filtered (``filters``: options of passing_pairs). With ``contigs`` only sites on
    these are called; reads are placed on all.
    runs: id, sample, library, read1, read2. reference: chunks of ``size`` bases. A sample without reads at a site is
    there with ``./.`` and depth 0.
    """
    rows = None
    for r in runs:
        pair = sequences.read_fastq_pair(spark, r["read1"], r["read2"]).withColumn("run", F.lit(r["id"]))
        rows = pair if rows is None else rows.unionByName(pair)
    rows = trim.trim_adapters(rows, ["run", "ordinal"]) if trim_adapters else rows
    rows = persisted(reads.passing_pairs(rows, ["run", "ordinal"], **(filters or {})), "reads")
    libraries = spark.createDataFrame([(r["id"], r["sample"], r["library"]) for r in runs], "run string, sample string, library string")
    longest = rows.agg(F.max(F.length("seq"))).first()[0] or 1
    wide = persisted(placement.overlapping_chunks(reference, size, longest + placement.MARGIN), "reference")
    pairs = persisted(placement.placed_pairs(rows, wide, size, fragment), "places")
    placed = placement.alignments(placement.with_cigars(pairs, rows, wide, size), rows, libraries)
    placed = placed if contigs is None else placed.where(F.col("contig").isin(contigs))
    bases = persisted(reads.pileup(placed, min_mapq, min_base_quality, max_depth), "bases")
    sites = persisted(reads.candidate_sites(bases, reference, size), "sites")
    called = persisted(reads.joint_genotypes(reads.genotype_likelihoods(bases, sites)), "called")
    sites = called.select("contig", "pos", "ref", "alts").distinct()
    called = called.select("contig", "pos", "sample", "gt", "dp", "gq")
    every = sites.withColumn("sample", F.explode(F.array(*map(F.lit, sorted({r["sample"] for r in runs})))))
    out = every.join(called, ["contig", "pos", "sample"], "left")
    return out.select("contig", "pos", "ref", "alts", "sample", F.coalesce("gt", F.lit("./.")).alias("gt"), F.coalesce("dp", F.lit(0)).alias("dp"), "gq")
