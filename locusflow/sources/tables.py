"""Small text tables with strict schemas."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.operators.sets import GateError, require_equal, require_unique
from locusflow.session import columns_of

FAI = "contig string, length long, offset long, line_bases int, line_bytes int"
BED = "contig string, start long, end long"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.regexp_replace("value", r"^﻿|\r$", "").alias("value"))


def _header(rows: DataFrame, prefix: str) -> str:
    found = rows.where(F.col("value").startswith(prefix)).limit(1).collect() if prefix else rows.limit(1).collect()
    if not found:
        raise GateError("the table has no header")
    return found[0]["value"]


def read_tsv(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A tab-separated table with a header: all columns as text, byte order mark and carriage returns dropped.

    Columns may stand in any order and others may be there; a required one that is missing, a name that occurs twice and
    a row with another number of cells raise.
    """
    rows = _lines(spark, path)
    head = _header(rows, "")
    names = head.split("\t")
    if len(set(names)) != len(names):
        raise GateError("a column occurs twice")
    if missing := [c for c in required if c not in names]:
        raise GateError(f"columns missing: {', '.join(missing)}")
    cells = rows.where((F.col("value") != head) & (F.col("value") != "")).select(F.split("value", "\t", -1).alias("c"))
    if not cells.where(F.size("c") != len(names)).isEmpty():
        raise GateError("a row has another number of cells than the header")
    return cells.select(*(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def read_metadata(spark: SparkSession, path: str, samples: DataFrame | None = None) -> DataFrame:
    """Sample metadata: sample, population and other columns; unique samples and no empty cells in the two.

    With ``samples`` (column sample) both must name the same samples.
    """
    out = read_tsv(spark, path, ["sample", "population"])
    require_unique(out, ["sample"], "samples of the metadata")
    if not out.where("population = ''").isEmpty():
        raise GateError("a population is empty")
    if samples is not None:
        require_equal(out, samples, ["sample"], "samples of the metadata and of the data")
    return out


def read_panel(spark: SparkSession, path: str, count: int | None = None) -> DataFrame:
    """(sample, population, group) of a panel: at least three columns, the first ones in this order, unique samples.

    ``count`` is the number of samples that there must be.
    """
    rows = _lines(spark, path)
    head = _header(rows, "")
    names = head.split("\t")
    if len(names) < 3 or names[0] != "sample":
        raise GateError("the panel needs three columns, the first of which is sample")
    cells = rows.where((F.col("value") != head) & (F.col("value") != "")).select(F.split("value", "\t", -1).alias("c"))
    if not cells.where(F.size("c") < 3).isEmpty():
        raise GateError("a row of the panel has fewer than three cells")
    out = cells.select(*(F.col("c")[i].alias(n) for i, n in enumerate(("sample", "population", "group"))))
    require_unique(out, ["sample"], "samples of the panel")
    if count is not None and (found := out.count()) != count:
        raise GateError(f"the panel has {found} samples, not {count}")
    return out


def read_spaced(spark: SparkSession, path: str, required: list[str]) -> DataFrame:
    """A table with white space between cells: lines with ## are left out, the # of the header is dropped."""
    rows = _lines(spark, path).where(~F.col("value").startswith("##") & (F.trim("value") != ""))
    head = _header(rows, "")
    names = re.split(r"\s+", head.strip().removeprefix("#"))
    if missing := [c for c in required if c not in names]:
        raise GateError(f"columns missing: {', '.join(missing)}")
    cells = rows.where(F.col("value") != head).select(F.split(F.trim("value"), r"\s+").alias("c"))
    if not cells.where(F.size("c") != len(names)).isEmpty():
        raise GateError("a row has another number of cells than the header")
    return cells.select(*(F.col("c")[i].alias(n) for i, n in enumerate(names)))


def read_psam(spark: SparkSession, path: str) -> DataFrame:
    """Samples of a .psam table: IID must be unique, not empty, and equal FID where there is one."""
    out = read_spaced(spark, path, ["IID"])
    require_unique(out, ["IID"], "samples")
    if "FID" in out.columns and not out.where("FID <> IID").isEmpty():
        raise GateError("FID and IID differ")
    return out.select(F.col("IID").alias("sample"))


def read_kinship(spark: SparkSession, path: str, samples: DataFrame) -> DataFrame:
    """Pairs of a .kin0 table: a, b, kinship with a < b; both must be among ``samples`` and differ."""
    rows = read_spaced(spark, path, ["IID1", "IID2", "KINSHIP"])
    out = rows.select(F.least("IID1", "IID2").alias("a"), F.greatest("IID1", "IID2").alias("b"), F.col("KINSHIP").try_cast("double").alias("kinship"))
    if not out.where("a = b OR kinship IS NULL OR isnan(kinship)").isEmpty():
        raise GateError("a pair of one sample, or a kinship that isn't a number")
    for side in ("a", "b"):
        if not out.join(samples, out[side] == samples["sample"], "left_anti").isEmpty():
            raise GateError("a pair with an unknown sample")
    return out


def read_numbers(spark: SparkSession, path: str, count: int, slack: float = 1e-8) -> list[float]:
    """Eigenvalues: so many lines with one finite positive number each, descending."""
    raw = [r[0].strip() for r in spark.read.text(path, wholetext=False).limit(count + 1).collect()]
    try:
        out = [float(x) for x in raw if x]
    except ValueError as e:
        raise GateError(f"not a number: {e}") from e
    if len(out) != count or any(not 0 < x < float("inf") for x in out) or any(b > a + slack for a, b in zip(out, out[1:])):
        raise GateError(f"need {count} positive descending numbers")
    return out


def read_vectors(spark: SparkSession, path: str, samples: DataFrame, count: int) -> DataFrame:
    """(sample, pc array<double>) of an eigenvector table with FID, IID and PC1 to PCn: every sample of ``samples`` exactly once."""
    names = [f"PC{i + 1}" for i in range(count)]
    rows = read_spaced(spark, path, ["FID", "IID", *names])
    out = rows.select(F.col("IID").alias("sample"), F.col("FID").alias("family"), F.array(*(F.col(n).try_cast("double") for n in names)).alias("pc"))
    if not out.where("sample <> family").isEmpty():
        raise GateError("FID and IID differ")
    require_unique(out, ["sample"], "samples of the eigenvectors")
    require_equal(out, samples, ["sample"], "samples of the eigenvectors and of the data")
    if not out.where(F.exists("pc", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))).isEmpty():
        raise GateError("an eigenvector has an entry that isn't a number")
    return out.select("sample", "pc")


def read_markers(spark: SparkSession, path: str) -> DataFrame:
    """A list of markers: one unique, non-empty id per line."""
    out = _lines(spark, path).select(F.trim("value").alias("marker"))
    require_unique(out, ["marker"], "markers")
    return out


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """Intervals: contig, start (0-based), end (exclusive)."""
    out = spark.read.schema(BED).option("sep", "\t").option("mode", "FAILFAST").option("comment", "#").csv(path)
    if not out.where("NOT (start >= 0 AND end > start) OR contig IS NULL").isEmpty():
        raise GateError("an interval is empty or has no contig")
    return out


def read_fai(spark: SparkSession, path: str) -> DataFrame:
    """A FASTA index: contig, length, offset, line_bases, line_bytes."""
    return spark.read.schema(FAI).option("sep", "\t").option("mode", "FAILFAST").csv(path)


def as_text(df: DataFrame) -> DataFrame:
    """All columns as text: numbers with twelve digits, NA for null."""
    from locusflow.functions.genetics import number_text

    kinds = dict(df.dtypes)
    return df.select(*(number_text(c) if kinds[n] == "double" else F.coalesce(c.cast("string"), F.lit("NA")) for n, c in zip(df.columns, columns_of(df), strict=True))).toDF(*df.columns)
