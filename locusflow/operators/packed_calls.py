"""Counts over records whose calls are packed bytes: one pass, nothing exploded.

Every task counts its own records. A record's counts by population come from one histogram of its codes, and a sample's
counts are added up in vectors over all samples, of which a task gives back one set. So what leaves a task is its sites
times populations, and its samples once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from locusflow.functions import genetics as g
from locusflow.session import columns_of, prepare_workers
from locusflow.sources.vcf import HET, HOM_ALT, HOM_REF, MISSING_CALL, OTHER_PLOIDY

#: What a code becomes here: six kinds of calls in eight slots. An allele that isn't 0 or 1 is a slot of its own.
FILTERED, OTHER, ALLELE, SLOTS = 4, 5, 6, 8
#: Records after which sums of 16 bits are carried over.
CARRY = 32_000
_SLOT = np.full(256, ALLELE, np.uint8)
_SLOT[[MISSING_CALL, HOM_REF, HET, HOM_ALT, OTHER_PLOIDY]] = [0, 1, 2, 3, OTHER]


def _terms(slots: np.ndarray) -> np.ndarray:
    """g.COUNTS from counts by slot (last axis)."""
    return np.stack([slots[..., 1] + slots[..., 2] + slots[..., 3], slots[..., 2], slots[..., 2] + 2 * slots[..., 3], slots[..., 0], slots[..., FILTERED], slots[..., OTHER]], -1)


class _Samples:
    """Counts of each sample by slot. Codes are added up as fields of 16 bits, four slots to a number."""

    def __init__(self, n: int):
        self.total = np.zeros((n, SLOTS), np.int64)
        self.low, self.high = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
        self.add_low, self.add_high = np.zeros(SLOTS, np.uint64), np.zeros(SLOTS, np.uint64)
        for k in range(4):
            self.add_low[k] = self.add_high[4 + k] = np.uint64(1 << 16 * k)
        self.rows = 0

    def add(self, slots: np.ndarray, rare: bool) -> None:
        self.low += self.add_low[slots]
        if rare:
            self.high += self.add_high[slots]
        self.rows += 1
        if self.rows >= CARRY:
            self.carry()

    def carry(self) -> None:
        for k in range(4):
            for part, at in ((self.low, k), (self.high, 4 + k)):
                self.total[:, at] += (part >> np.uint64(16 * k) & np.uint64(0xFFFF)).astype(np.int64)
        self.low[:], self.high[:], self.rows = 0, 0, 0


def count_packed(records: DataFrame, populations: list[int], count: int, min_dp: int = 0, min_gq: int = 0) -> DataFrame:
    """Rows (site, counts, odd): for each record what it holds besides its calls and, if it is eligible, its g.COUNTS of
    each population one after another; with site null, a task's g.COUNTS of each sample one after another. odd: calls of
    an eligible record with an allele that isn't 0 or 1.

    records: packed codes, dp and gq, whether each is ``eligible``, and other columns. populations: the number of each
    sample's population, of ``count`` many. Thresholds as in g.category. The records are read once.
    """
    prepare_workers(records.sparkSession)
    pops = np.array(populations, np.int64)
    n = len(pops)
    base = (pops * SLOTS).astype(np.uint16 if count * SLOTS < 1 << 16 else np.int64)
    site = F.struct(*columns_of(records, "codes", "dp", "gq", "eligible")).alias("site")
    source = records.select(site, F.when(F.col("eligible"), F.col("codes")).alias("codes"), "dp", "gq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples, kind, any_row = _Samples(n), None, False
        for batch in batches:
            kind = batch.column(0).type
            counts, odd = [], []
            for codes, dp, gq in zip(*(batch.column(k) for k in (1, 2, 3)), strict=True):
                if not codes.is_valid:
                    counts.append(None)
                    odd.append(0)
                    continue
                slots = _SLOT[np.frombuffer(codes.as_buffer(), np.uint8)]
                for value, least in ((dp, min_dp), (gq, min_gq)):
                    if least:
                        low = np.frombuffer(value.as_buffer(), np.int32) < least
                        slots[low & (slots >= 1) & (slots <= 3)] = FILTERED
                found = np.bincount(base + slots, minlength=count * SLOTS).reshape(count, SLOTS)
                samples.add(slots, bool(found[:, 4:].any()))
                any_row = True
                counts.append(_terms(found).ravel())
                odd.append(int(found[:, ALLELE].sum()))
            if counts:
                yield out(batch.column(0), counts, odd)
        if any_row:
            samples.carry()
            yield out(pa.nulls(1, kind), [_terms(samples.total).ravel()], [0])

    def out(site: pa.Array, counts: list, odd: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([site, pa.array(counts, pa.list_(pa.int64())), pa.array(odd, pa.int64())], ["site", "counts", "odd"])

    return source.mapInArrow(run, T.StructType().add("site", source.schema["site"].dataType).add("counts", T.ArrayType(T.LongType())).add("odd", "long"))


def _cells(counted: DataFrame, of: str) -> DataFrame:
    """One row for each group of g.COUNTS, numbered ``of``."""
    width = len(g.COUNTS)
    rows = counted.select("site", "counts", F.explode(F.sequence(F.lit(0), (F.size("counts") / width - 1).cast("int"))).alias(of))
    return rows.select("site.*", of, *(F.element_at("counts", F.col(of) * width + k + 1).alias(c) for k, c in enumerate(g.COUNTS)))


def by_population(counted: DataFrame) -> DataFrame:
    """Each eligible record once for each population: its columns, population_no and g.COUNTS."""
    return _cells(counted.where("site IS NOT NULL AND counts IS NOT NULL"), "population_no")


def by_site(counted: DataFrame) -> DataFrame:
    """Eligible records with g.COUNTS, without a shuffle: a record's populations are added up where they are."""
    width = len(g.COUNTS)
    total = lambda k: F.aggregate(F.filter("counts", lambda x, i: i % width == k), F.lit(0).cast("long"), lambda s, x: s + x)
    return counted.where("site IS NOT NULL AND counts IS NOT NULL").select("site.*", *(total(k).alias(c) for k, c in enumerate(g.COUNTS)))


def by_sample(counted: DataFrame) -> DataFrame:
    """(idx, g.COUNTS)."""
    rows = _cells(counted.where("site IS NULL"), "idx").select("idx", *g.COUNTS)
    return rows.groupBy("idx").agg(*(F.sum(c).alias(c) for c in g.COUNTS))
