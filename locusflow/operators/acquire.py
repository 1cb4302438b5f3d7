"""Validation of run catalogues and manifests, and planning of transfers. Nothing here touches a network."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.sets import GateError, require_unique
from locusflow.sources.tables import read_tsv

ACCESSION = "^[ESD]RR[0-9]{6,}$"
MD5 = "^[0-9a-f]{32}$"
# Forms of accessions and names, and where the archive's files lie.
STUDY = "^(PRJ[EDN][AB][0-9]+|[EDS]RP[0-9]+)$"
RUN = "^[EDS]RR[0-9]+$"
SAMPLE = "^(SAM[END][A-Z]?[0-9]+|[EDS]RS[0-9]+)$"
INDIVIDUAL = "^[A-Za-z0-9][A-Za-z0-9_.-]{0,127}$"
ADDRESS = r"^https://ftp\.sra\.ebi\.ac\.uk/vol1/fastq/[A-Za-z0-9/]+/[A-Za-z0-9_.]+$"
REPORT = ("run_accession", "sample_accession", "secondary_sample_accession", "study_accession", "library_layout", "fastq_ftp", "fastq_md5", "fastq_bytes")


def problems(**rules: Column) -> Column:
    """The names of the rules that a row breaks, in order. A rule that is null counts as broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items())))


def catalogue(report: DataFrame) -> DataFrame:
    """Rows of a file report with their files and the list of what is wrong with them. Needs the columns REPORT."""
    missing = [c for c in REPORT if c not in report.columns]
    if missing:
        raise ValueError(f"the report lacks {', '.join(missing)}")
    url, md5, size = (F.split(c, ";") for c in ("fastq_ftp", "fastq_md5", "fastq_bytes"))
    n = F.size(url)
    checks = problems(
        run=F.col("run_accession").rlike(ACCESSION),
        sample=F.length("sample_accession") > 0,
        layout=F.col("library_layout") == "PAIRED",
        files=(n == 2) & (F.size(md5) == n) & (F.size(size) == n),
        mates=F.get(url, F.lit(0)).rlike(r"_1\.fastq\.gz$") & F.get(url, F.lit(1)).rlike(r"_2\.fastq\.gz$"),
        md5=F.forall(md5, lambda x: x.rlike(MD5)),
        bytes=F.forall(size, lambda x: F.coalesce(x.try_cast("long") > 0, F.lit(False))),
    )
    files = F.arrays_zip(url.alias("url"), md5.alias("md5"), size.alias("bytes"))
    return report.withColumns({"problems": checks, "files": files})


def read_mapping(spark: SparkSession, path: str) -> DataFrame:
    """(sample_accession, individual) of a mapping table: both are valid and each stands for one of the other."""
    rows = read_tsv(spark, path, ["sample_accession", "individual"]).select("sample_accession", "individual")
    if not rows.where(~F.col("individual").rlike(INDIVIDUAL)).isEmpty():
        raise GateError("an individual has a bad name")
    require_unique(rows, ["sample_accession"], "samples of the mapping")
    require_unique(rows, ["individual"], "individuals of the mapping")
    return rows


def manifest(valid: DataFrame, mapping: DataFrame) -> DataFrame:
    """One row per file of the catalogue's sound rows, with the individual that the mapping gives their sample.

    A sample that the mapping doesn't name is an error.
    """
    sound = valid.where(F.size("problems") == 0)
    unknown = sound.join(mapping, "sample_accession", "left_anti").select("sample_accession").limit(1).collect()
    if unknown:
        raise GateError(f"the mapping doesn't name {unknown[0][0]}")
    rows = sound.join(mapping, "sample_accession")
    return rows.select("run_accession", "sample_accession", "individual", F.posexplode("files").alias("at", "f")).select(
        "run_accession", "sample_accession", "individual", (F.col("at") + 1).alias("mate"), F.concat(F.lit("https://"), "f.url").alias("url"), F.element_at(F.split("f.url", "/"), -1).alias("name"), F.col("f.bytes").cast("long").alias("bytes"), F.col("f.md5").alias("md5")
    )


MANIFEST = "schema_version int, status string, study string, reference struct<assembly:string,fasta_sha256:string>, files array<struct<run:string,mate:int,name:string,sample_accession:string,individual:string,url:string,md5:string,bytes:long>>"


def read_manifest(spark: SparkSession, path: str, max_bytes: int) -> DataFrame:
    """The files of an acquisition manifest, one row each with the columns of MANIFEST's files, after all gates.

    A manifest says which study and reference it is for. Each file has the name that its run and mate give, a canonical
    address, a checksum and a size; runs are whole pairs of one sample, samples and individuals stand for each other, and
    the sizes add up to ``max_bytes`` at most.
    """
    found = spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(path, multiLine=True)
    head = problems(
        version=F.col("schema_version") == 1,
        status=F.col("status") == "ready",
        study=F.col("study").rlike(STUDY),
        assembly=F.length(F.trim("reference.assembly")) > 0,
        reference=F.lower("reference.fasta_sha256").rlike("^[0-9a-f]{64}$"),
        files=F.size("files") > 0,
    )
    wrong = found.select(head.alias("p")).collect()
    if len(wrong) != 1 or wrong[0]["p"]:
        raise GateError(f"the manifest is wrong: {', '.join(wrong[0]['p']) if wrong else 'empty'}")
    files = found.select(F.inline("files"))
    name = F.concat("run", F.lit("_"), F.col("mate").cast("string"), F.lit(".fastq.gz"))
    own = problems(
        run=F.col("run").rlike(RUN),
        mate=F.col("mate").isin(1, 2),
        name=F.col("name") == name,
        sample=F.col("sample_accession").rlike(SAMPLE),
        individual=F.col("individual").rlike(INDIVIDUAL),
        url=F.col("url").rlike(ADDRESS) & (F.element_at(F.split("url", "/"), -1) == name),
        md5=F.lower("md5").rlike(MD5),
        bytes=F.col("bytes") > 0,
    )
    bad = files.select("name", own.alias("p")).where(F.size("p") > 0).orderBy("name").limit(1).collect()
    if bad:
        raise GateError(f"file {bad[0]['name']}: {', '.join(bad[0]['p'])}")
    require_unique(files, ["name"], "names of the manifest")
    gates = {
        "runs aren't pairs of one sample": files.groupBy("run").agg(F.count("*").alias("n"), F.countDistinct("sample_accession", "individual").alias("k")).where("n <> 2 OR k <> 1"),
        "a sample is several individuals": files.groupBy("sample_accession").agg(F.countDistinct("individual").alias("k")).where("k <> 1"),
        "an individual is several samples": files.groupBy("individual").agg(F.countDistinct("sample_accession").alias("k")).where("k <> 1"),
        "the files are larger than allowed": files.agg(F.sum("bytes").alias("n")).where(F.col("n") > max_bytes),
    }
    for what, rows in gates.items():
        if not rows.isEmpty():
            raise GateError(what)
    return files.withColumn("md5", F.lower("md5"))


def chunks(files: DataFrame, size: str, chunk: int) -> DataFrame:
    """Byte ranges [first, last] of at most ``chunk`` bytes of every file; an empty file has none."""
    first = F.explode(F.sequence(F.lit(0).cast("long"), F.col(size) - 1, F.lit(chunk).cast("long")))
    return files.where(F.col(size) > 0).select("*", first.alias("first")).withColumn("last", F.least(F.col("first") + chunk, F.col(size)) - 1)


def scratch_bytes(reference: int, fastq: int) -> int:
    """Room that a read run needs."""
    return 12 * reference + 16 * fastq + (64 << 20)
