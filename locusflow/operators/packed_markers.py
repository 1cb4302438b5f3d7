"""Markers as packed rows over samples: a genotype run's quality control without a row for each call.

A marker is one row, its calls one binary of a byte each. What is by marker is decided where the marker is; what is by
sample is added up in a vector by every task, and the vectors' blocks are added by a grouped aggregate.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.operators.packed import MISSING, ZERO
from locusflow.session import columns_of, prepare_workers
from locusflow.sources.vcf import ABSENT, HET, HOM_ALT, HOM_REF, MISSING_CALL, OTHER_ALLELE, OTHER_PLOIDY

#: Samples of a block of counts, and bytes of a stretch of markers that a task turns round.
COUNTS, TURNED = 4096, 32 << 20
_DIGIT = np.full(256, ZERO + MISSING, np.uint8)
_DIGIT[[HOM_REF, HET, HOM_ALT]] = [ZERO, ZERO + 1, ZERO + 2]


def call_codes(gt: pa.ListArray) -> np.ndarray:
    """The code of each call, as the variant source gives them, from lists of alleles."""
    n = gt.value_lengths().fill_null(0).to_numpy()
    values = gt.flatten()
    alleles = values.fill_null(-1).to_numpy().astype(np.int64)
    owner = np.repeat(np.arange(len(n)), n)
    total = lambda x: np.bincount(owner, weights=x, minlength=len(n))
    odd, absent = total((alleles > 1) | (alleles < -1)) > 0, total(alleles == -1) > 0
    alt = total(np.maximum(alleles, 0)).astype(np.int64)
    codes = np.where(n == 2, HOM_REF + alt, OTHER_PLOIDY)
    codes[absent | gt.is_null().to_numpy(zero_copy_only=False)] = MISSING_CALL
    codes[odd] = OTHER_ALLELE
    # An empty list of alleles is a call of no ploidy, not a missing one.
    return codes.astype(np.uint8)


def _with_columns(rows: DataFrame, without: list[str], new: list[tuple[str, T.DataType]], work) -> DataFrame:
    """Columns of ``rows`` but some, and new ones that ``work`` makes from a batch."""
    prepare_workers(rows.sparkSession)
    shape = T.StructType([f for f in rows.schema if f.name not in without])
    for name, kind in new:
        shape = shape.add(name, kind)
    keep = [i for i, c in enumerate(rows.columns) if c not in without]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), *work(batch)], shape.names)

    return rows.mapInArrow(run, shape)


def pack_calls(records: DataFrame) -> DataFrame:
    """Records with codes, dp and gq (as the variant source packs them) in place of their calls."""
    at = records.columns.index("calls")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(at)
        calls = lists.flatten()
        ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy())
        tables = [call_codes(calls.field("gt")), *(calls.field(k).fill_null(ABSENT).to_numpy().astype(np.int32) for k in ("dp", "gq"))]
        return [pa.array([x.tobytes() for x in np.split(t, ends[:-1])], pa.binary()) for t in tables]

    return _with_columns(records, ["calls"], [(c, T.BinaryType()) for c in ("codes", "dp", "gq")], work)


def dosage_rows(packed: DataFrame) -> DataFrame:
    """Markers with ``data``, a digit for each call (0, 1, 2 or MISSING), in place of codes, dp and gq."""
    at = packed.columns.index("codes")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array([_DIGIT[np.frombuffer(c.as_buffer(), np.uint8)].tobytes() for c in batch.column(at)], pa.binary())]

    return _with_columns(packed, ["codes", "dp", "gq"], [("data", T.BinaryType())], work)


def choose_samples(markers: DataFrame, keep: list[int]) -> DataFrame:
    """Markers over the samples at the given places only, in that order, with counts ``missing`` and ``alt_alleles``."""
    places = np.array(keep, np.int64)
    at = markers.columns.index("data")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        rows = [np.frombuffer(c.as_buffer(), np.uint8)[places] for c in batch.column(at)]
        missing = [int(np.count_nonzero(r == ZERO + MISSING)) for r in rows]
        alt = [int(np.count_nonzero(r == ZERO + 1) + 2 * np.count_nonzero(r == ZERO + 2)) for r in rows]
        return [pa.array([r.tobytes() for r in rows], pa.binary()), pa.array(missing, pa.int64()), pa.array(alt, pa.int64())]

    return _with_columns(markers, ["data", "missing", "alt_alleles"], [("data", T.BinaryType()), ("missing", T.LongType()), ("alt_alleles", T.LongType())], work)


def with_maf(markers: DataFrame, samples: int) -> DataFrame:
    """Markers of :func:`choose_samples` with their minor allele frequency, null without a call."""
    p = F.try_divide(F.col("alt_alleles").cast("double"), 2 * (samples - F.col("missing")))
    return markers.withColumn("maf", F.least(p, 1 - p))


def missing_by_sample(markers: DataFrame) -> DataFrame:
    """(idx, missing, total) of each sample over all markers."""
    prepare_workers(markers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, total = None, 0
        for batch in batches:
            for c in batch.column(0):
                row = np.frombuffer(c.as_buffer(), np.uint8) == ZERO + MISSING
                counts = row.astype(np.int64) if counts is None else counts + row
                total += 1
        if counts is not None:
            blocks = np.split(counts, range(COUNTS, len(counts), COUNTS))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(blocks)), pa.int64()), pa.array([b.tolist() for b in blocks], pa.list_(pa.int64())), pa.array([total] * len(blocks), pa.int64())], ["block", "missing", "total"])

    parts = markers.select("data").mapInArrow(run, "block long, missing array<long>, total long")
    cells = parts.select("block", "total", F.posexplode("missing").alias("at", "missing"))
    return cells.groupBy((F.col("block") * COUNTS + F.col("at")).alias("idx")).agg(F.sum("missing").alias("missing"), F.sum("total").alias("total"))


def turned(markers: DataFrame, samples: int) -> tuple[DataFrame, int]:
    """(rows (sample, part, data), width): the dosages of a stretch of ``width`` markers for each sample.

    markers: at (dense numbers from 0), data. A task turns round one stretch at a time, of bounded size; markers that the
    last one lacks are missing.
    """
    prepare_workers(markers.sparkSession)
    width = max(64, min(1 << 16, TURNED // max(samples, 1)))

    def emit(part: int, rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
        block = np.full((width, samples), ZERO + MISSING, np.uint8)
        for at, data in rows:
            block[at % width] = np.frombuffer(data, np.uint8)
        block = np.ascontiguousarray(block.T)
        return pa.RecordBatch.from_arrays([pa.array(np.arange(samples), pa.int64()), pa.array(np.full(samples, part, np.int32)), pa.array([r.tobytes() for r in block], pa.binary())], ["sample", "part", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, rows = None, []
        for batch in batches:
            for p, at, data in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if rows and p != part:
                    yield emit(part, rows)
                    rows = []
                part = p
                rows.append((at, data))
        if rows:
            yield emit(part, rows)

    keyed = markers.select(F.floor(F.col("at") / width).cast("int").alias("part"), "at", "data").repartition("part").sortWithinPartitions("part")
    return keyed.mapInArrow(run, "sample long, part int, data binary"), width


def calls_of(records: DataFrame, keep: list[int]) -> DataFrame:
    """Records with the calls at the given places only."""
    places = np.array(keep, np.int64)
    at = records.columns.index("calls")

    def work(batch: pa.RecordBatch) -> list[pa.Array]:
        lists = batch.column(at)
        sizes = lists.value_lengths().fill_null(0).to_numpy()
        begins = np.cumsum(sizes) - sizes
        chosen = lists.flatten().take(pa.array((begins[:, None] + places[None, :]).ravel()))
        return [pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * len(places)), chosen)]

    return _with_columns(records, ["calls"], [("calls", records.schema["calls"].dataType)], work).select(*columns_of(records))
