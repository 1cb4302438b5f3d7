"""Exact principal components of a dosage matrix and an independent check of them."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.operators.packed import MISSING, unpack
from locusflow.session import persisted, prepare_workers

#: Exact components need the relationship matrix of samples on one machine, or that of markers, which has the same
#: eigenvalues. Beyond so many samples and so many markers they are refused.
MAX_SAMPLES = MAX_MARKERS = 5000
RESIDUAL, ORTHONORMAL, DESCENDING = 1e-3, 2e-3, 1e-8


@dataclass
class Components:
    samples: list
    values: np.ndarray
    vectors: np.ndarray
    markers: int


def standardised_rows(data: list[bytes]) -> np.ndarray:
    """(g - 2p) / sqrt(2p(1 - p)) of packed markers, 0 where missing; markers without variation are left out."""
    x = np.array([unpack(d) for d in data], np.float64)
    called = x != MISSING
    n = called.sum(1)
    p = np.where(called, x, 0).sum(1) / np.maximum(2 * n, 1)
    own = (n > 0) & (p > 0) & (p < 1)
    x, called, p = x[own], called[own], p[own][:, None]
    return np.where(called, (x - 2 * p) / np.sqrt(2 * p * (1 - p)), 0.0)


def _gram(standardised):
    """Sum of z' z over a task's packed rows and the number of rows of z, one row of the matrix at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = None, 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                z = standardised(batch.slice(at, 1024).column(0).to_pylist())
                rows += len(z)
                total = z.T @ z if total is None else total + z.T @ z
        if total is not None:
            n = len(total)
            for at in range(0, n, 64):
                part = total[at : at + 64]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * n), pa.array(part.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + len(part), dtype=np.int32)), lists, pa.array(np.full(len(part), rows, np.int64))], ["i", "row", "m"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the rows with one number, which arrive one after another."""

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(total)], pa.int32()), pa.array(total)), pa.array([markers], pa.int64())], ["i", "row", "m"])

    key, total, markers = None, None, 0
    for batch in batches:
        for i, row, m in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
            values = row.values.to_numpy(zero_copy_only=False)
            if i != key:
                if key is not None:
                    yield out()
                key, total, markers = i, values.copy(), m
            else:
                total += values
                markers += m
    if key is not None:
        yield out()


def _eigenpairs(rows: DataFrame, standardised, pcs: int, divisor: int | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """The largest eigenpairs of the sum of z' z over all rows, divided by the number of rows of z or by what is given, and that number.

    Every task adds up the matrix of its own rows; the sums are added row by row in other tasks, so only one matrix comes to
    the driver.
    """
    parts = rows.select("data").mapInArrow(_gram(standardised), "i int, row array<double>, m long")
    sums = parts.repartition("i").sortWithinPartitions("i").mapInArrow(_added, "i int, row array<double>, m long").orderBy("i").toArrow()
    m = max(sums.column("m").to_pylist(), default=0)
    if not m:
        raise ValueError("no marker varies")
    n = len(sums)
    values, vectors = np.linalg.eigh(sums.column("row").combine_chunks().flatten().to_numpy().reshape(n, n) / (divisor or m))
    order = np.argsort(-values)[:pcs]
    return values[order], vectors[:, order], m


def principal_components(markers: DataFrame, samples: list, pcs: int = 10) -> Components:
    """The ``pcs`` largest eigenpairs of Z'Z / M. markers: data (packed dosages in the order of ``samples``).

    The matrix of samples by samples comes to the driver; its size is bounded by MAX_SAMPLES.
    """
    n = len(samples)
    if not 3 <= n <= MAX_SAMPLES or not 1 <= pcs < n:
        raise ValueError(f"{n} samples and {pcs} components: need 3 to {MAX_SAMPLES} samples and fewer components")
    prepare_workers(markers.sparkSession)
    values, vectors, m = _eigenpairs(markers, standardised_rows, pcs)
    return Components(list(samples), values, vectors, m)


def residuals(markers: DataFrame, found: Components) -> np.ndarray:
    """|C v - value v| / value of each component, from products with the genotypes and never the matrix itself."""
    vectors = found.vectors
    prepare_workers(markers.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros_like(vectors)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                z = standardised_rows(batch.slice(at, 1024).column(0).to_pylist())
                total += z.T @ (z @ vectors)
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["k", "x"])

    parts = markers.select("data").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    product = np.array([r["x"] for r in parts]).reshape(vectors.shape) / found.markers
    return np.linalg.norm(product - vectors * found.values, axis=0) / found.values


@dataclass
class SampleComponents:
    """Components of any number of samples: rows (sample, data, pc) stay a table."""

    rows: DataFrame
    samples: int
    values: np.ndarray
    markers: int
    standardised: Callable[[list[bytes]], np.ndarray]


def standardised_columns(own: np.ndarray, p: np.ndarray) -> Callable[[list[bytes]], np.ndarray]:
    """What :func:`standardised_rows` gives, for packed samples: markers ``own`` with frequencies ``p`` are the columns."""

    def run(data: list[bytes]) -> np.ndarray:
        x = np.array([unpack(d)[own] for d in data], np.float64)
        return np.where(x != MISSING, (x - 2 * p) / np.sqrt(2 * p * (1 - p)), 0.0)

    return run


def _calls(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Samples, calls and alternative alleles of each marker in a task's packed samples."""
    called, alt, n = 0, 0, 0
    for batch in batches:
        for data in batch.column(0).to_pylist():
            x = unpack(data).astype(np.int64)
            called, alt, n = called + (x != MISSING), alt + np.where(x != MISSING, x, 0), n + 1
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(alt), dtype=np.int32)), pa.array(np.full(len(alt), n, np.int64)), pa.array(called.astype(np.int64)), pa.array(alt)], ["at", "n", "called", "alt"])


def components_by_marker(packed: DataFrame, pcs: int = 10) -> SampleComponents:
    """The same eigenpairs from the relationship of markers. packed: sample, data (packed dosages, MAX_MARKERS at most).

    If Z Z' u = c u, then v = Z' u / sqrt(c) is the eigenvector of Z' Z with the same value and length 1. So what comes to
    the driver is bounded by the number of markers, and a sample's entries are made where its row is.
    """
    prepare_workers(packed.sparkSession)
    packed = persisted(packed.select("sample", "data"), "samples")
    counts = packed.select("data").mapInArrow(_calls, "at int, n long, called long, alt long").groupBy("at").agg(*(F.sum(c).alias(c) for c in ("n", "called", "alt"))).orderBy("at").limit(MAX_MARKERS + 1).collect()
    n = counts[0]["n"] if counts else 0
    if n < 3 or not 1 <= pcs < n or len(counts) > MAX_MARKERS:
        raise ValueError(f"{n} samples and {pcs} components: need 3 samples, fewer components and {MAX_MARKERS} markers at most")
    p = np.array([r["alt"] / max(2 * r["called"], 1) for r in counts])
    own = np.flatnonzero((p > 0) & (p < 1))
    if len(own) < pcs:
        raise ValueError("no marker varies" if not len(own) else f"{len(own)} markers vary: there are no {pcs} components")
    standardised, m = standardised_columns(own, p[own]), len(own)
    values, sides, _ = _eigenpairs(packed, standardised, pcs, m)
    if (values <= 0).any():
        raise ValueError("eigenvalues must be finite and positive")
    sides = sides / np.sqrt(values * m)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                entries = standardised(part.column(1).to_pylist()) @ sides
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(entries) + 1, dtype=np.int32) * pcs), pa.array(entries.ravel()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists], ["sample", "data", "pc"])

    kind = packed.schema["sample"].dataType.simpleString()
    return SampleComponents(persisted(packed.mapInArrow(run, f"sample {kind}, data binary, pc array<double>"), "components"), n, values, m, standardised)


def _summed(rows: DataFrame, work, shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all rows (data, pc) of what ``work`` makes of some of them, an array of this shape."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                total += work(part.column(0).to_pylist(), part.column(1).flatten().to_numpy().reshape(part.num_rows, -1))
        flat = total.ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat)), pa.int64()), pa.array(flat)], ["k", "x"])

    sums = rows.select("data", "pc").mapInArrow(run, "k long, x double").groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    return np.array([r["x"] for r in sums]).reshape(shape)


def overlaps(found: SampleComponents) -> np.ndarray:
    """Inner products of all components."""
    k = len(found.values)
    return _summed(found.rows, lambda _, v: v.T @ v, (k, k))


def residuals_of_samples(found: SampleComponents) -> np.ndarray:
    """:func:`residuals` of components in a table: products with the genotypes once by marker and once by sample."""
    values, m, standardised, k = found.values, found.markers, found.standardised, len(found.values)
    sides = _summed(found.rows, lambda data, v: standardised(data).T @ v, (m, k)) / m
    squares = _summed(found.rows, lambda data, v: ((standardised(data) @ sides - v * values) ** 2).sum(0), (k,))
    return np.sqrt(squares) / values


def check_components(found: Components | SampleComponents, residual: np.ndarray | None = None) -> dict:
    """The report of the gates; raises ValueError at the first that fails."""
    values = found.values
    overlap = overlaps(found) if isinstance(found, SampleComponents) else found.vectors.T @ found.vectors
    if not np.isfinite(values).all() or not np.isfinite(overlap).all() or (values <= 0).any():
        raise ValueError("eigenvalues must be finite and positive")
    if (np.diff(values) > DESCENDING).any():
        raise ValueError("eigenvalues must descend")
    gap = float(np.abs(overlap - np.eye(len(values))).max())
    if gap > ORTHONORMAL:
        raise ValueError(f"eigenvectors aren't orthonormal: {gap:g}")
    if residual is not None and not (residual < RESIDUAL).all():
        raise ValueError(f"an eigenpair's residual is {residual.max():g}")
    samples = found.samples if isinstance(found, SampleComponents) else len(found.samples)
    return {"samples": samples, "pcs": len(values), "markers": found.markers, "eigenvalues": values.tolist(), "orthonormality": gap, "residuals": None if residual is None else residual.tolist(), "validated": residual is not None}
