"""Linkage disequilibrium of markers that are near each other, and pruning by it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.operators.packed import MISSING, unpack
from locusflow.session import persisted, prepare_workers


PAIR = ["contig", "a", "b", "rank_a", "rank_b"]
SUMS = ("n", "sx", "sy", "sxy", "sxx", "syy")


def pair_sums(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, ...]:
    """The SUMS of every row of x with every row of y over jointly called columns; sums of parts of the columns add up."""
    cx, cy = (x != MISSING).astype(float), (y != MISSING).astype(float)
    vx, vy = np.where(cx > 0, x, 0).astype(float), np.where(cy > 0, y, 0).astype(float)
    return cx @ cy.T, vx @ cy.T, cx @ vy.T, vx @ vy.T, (vx**2) @ cy.T, cx @ (vy**2).T


def pairwise_r2(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared correlation of every row of x with every row of y over jointly called columns; NaN where undefined."""
    n, sx, sy, sxy, sxx, syy = pair_sums(x, y)
    cov = n * sxy - sx * sy
    var = (n * sxx - sx**2) * (n * syy - sy**2)
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(var > 0, cov**2 / var, np.nan)


def ranked(packed: DataFrame, contig: str = "contig", order: Column | str = "pos") -> DataFrame:
    """Markers with their number in the contig, from 0."""
    return packed.withColumn("rank", F.row_number().over(Window.partitionBy(contig).orderBy(order)) - 1)


def ld_pairs(markers: DataFrame, window: int = 50, least: float = 0.2, step: int = 1) -> DataFrame:
    """(contig, a, b, r2) of markers a before b with both in one window and r2 above the limit.

    Windows hold ``window`` markers of a contig and begin at every ``step``-th. With a step of 1, b is less than
    ``window`` ranks further than a.

    markers: contig, rank, marker, data (packed dosages over samples). A band join: each stretch of ``window`` ranks is a
    task that also gets the next stretch, so a marker travels twice, however long the contig is. With a column ``part``
    a marker has one row for each block of samples: a task then gives the sums of its block, and r2 comes from their total.
    """
    return _ranked_pairs(markers, window, least, step).select("contig", "a", "b", "r2")


def _ranked_pairs(markers: DataFrame, window: int, least: float, step: int) -> DataFrame:
    """(contig, a, b, rank_a, rank_b, r2) of :func:`ld_pairs`."""
    if not 1 <= step <= window:
        raise ValueError("the step must be within 1 and the window")
    parts = "part" in markers.columns
    prepare_workers(markers.sparkSession)
    block = F.floor(F.col("rank") / window).cast("int")
    key = ["contig", "stretch", *(["part"] if parts else [])]
    rows = markers.select("contig", "rank", "marker", "data", *key[2:], F.explode(F.array(block, block - 1)).alias("stretch")).where("stretch >= 0")

    def work(rows: list) -> pa.RecordBatch:
        rows = sorted(rows, key=lambda r: r["rank"])
        rank = np.array([r["rank"] for r in rows])
        own = np.flatnonzero(rank // window == rows[0]["stretch"])
        data = np.array([unpack(r["data"]) for r in rows])
        gap = rank[None, :] - rank[own][:, None]
        # The last window that holds a begins at the step at or before it.
        near = (gap > 0) & (rank[None, :] < (rank[own] // step * step + window)[:, None])
        if parts:
            names, values = SUMS, pair_sums(data[own], data)
        else:
            names, values = ("r2",), (pairwise_r2(data[own], data),)
            near &= values[0] > least
        hit = np.argwhere(near)
        ids = [r["marker"] for r in rows]
        columns = [pa.array([rows[0]["contig"]] * len(hit), pa.string()), pa.array([ids[own[i]] for i, _ in hit], pa.int64()), pa.array([ids[j] for _, j in hit], pa.int64()), *(pa.array(rank[x], pa.int64()) for x in (own[hit[:, 0]], hit[:, 1]))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(v[hit[:, 0], hit[:, 1]], pa.float64()) for v in values)], [*PAIR, *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, []
        for batch in batches:
            for row in batch.to_pylist():
                mine = tuple(row[k] for k in key)
                if mine != last:
                    if held:
                        yield work(held)
                    last, held = mine, []
                held.append(row)
        if held:
            yield work(held)

    shape = "contig string, a long, b long, rank_a long, rank_b long"
    near = rows.repartition(*key).sortWithinPartitions(*key)
    if not parts:
        return near.mapInArrow(run, f"{shape}, r2 double")
    sums = near.mapInArrow(run, f"{shape}, " + ", ".join(f"{s} double" for s in SUMS)).groupBy(*PAIR).agg(*(F.sum(s).alias(s) for s in SUMS))
    n, sx, sy, sxy, sxx, syy = map(F.col, SUMS)
    cov, var = n * sxy - sx * sy, (n * sxx - sx * sx) * (n * syy - sy * sy)
    return sums.select(*PAIR, F.when(var > 0, cov * cov / var).alias("r2")).where(F.col("r2") > least)


def prune_order(ids: list[int], maf: dict[int, float], pairs: list[tuple[int, int]]) -> list[int]:
    """Markers that stay on one contig: pairs in order of their markers; of two that are left the rarer goes (the later of equals)."""
    place = {m: i for i, m in enumerate(ids)}
    gone: set[int] = set()
    for a, b in sorted(pairs, key=lambda p: (place[p[0]], place[p[1]])):
        if a not in gone and b not in gone:
            gone.add(a if maf[a] < maf[b] else b)
    return [m for m in ids if m not in gone]


def ld_prune(markers: DataFrame, maf: DataFrame, window: int = 50, least: float = 0.2, step: int = 1) -> DataFrame:
    """(contig, marker) that stay. maf: marker, maf.

    The choice is sequential along markers that pairs above the limit link, directly or through others. So a contig is
    cut wherever no pair reaches over the border between two stretches of ``window`` markers, and the pairs (not the
    genotypes) of a piece meet in one task; markers without a pair stay without being asked.
    """
    pairs = persisted(_ranked_pairs(markers, window, least, step), "pairs")
    linked = pairs.select("contig", F.explode(F.array(F.struct(F.col("a").alias("marker"), F.col("rank_a").alias("rank")), F.struct(F.col("b").alias("marker"), F.col("rank_b").alias("rank")))).alias("m")).select("contig", "m.*").distinct()
    # One row for each stretch that begins a pair, and whether one goes on into the next.
    stretch = lambda c: F.floor(F.col(c) / window)
    stretches = linked.select("contig", stretch("rank").alias("s")).distinct()
    over = pairs.where(stretch("rank_a") < stretch("rank_b")).select("contig", stretch("rank_b").alias("s")).distinct().withColumn("on", F.lit(True))
    flags = stretches.join(over, ["contig", "s"], "left").withColumn("begins", F.col("on").isNull().cast("int"))
    piece = flags.withColumn("piece", F.sum("begins").over(Window.partitionBy("contig").orderBy("s"))).select("contig", "s", "piece")
    by_piece = lambda rows, rank: rows.withColumn("s", stretch(rank)).join(piece, ["contig", "s"]).groupBy("contig", "piece")
    lists = by_piece(pairs, "rank_a").agg(F.collect_list(F.struct("a", "b")).alias("pairs"))
    rows = by_piece(linked.join(maf.select("marker", "maf"), "marker"), "rank").agg(F.sort_array(F.collect_list(F.struct("rank", "marker", "maf"))).alias("rows"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                rate = {r["marker"]: r["maf"] for r in row["rows"]}
                # A marker that maf doesn't name was left out before: its pairs don't count.
                kept = prune_order(list(rate), rate, [(p["a"], p["b"]) for p in row["pairs"] if p["a"] in rate and p["b"] in rate])
                gone = sorted(rate.keys() - set(kept))
                yield pa.RecordBatch.from_arrays([pa.array([row["contig"]] * len(gone), pa.string()), pa.array(gone, pa.int64())], ["contig", "marker"])

    gone = rows.join(lists, ["contig", "piece"]).select("contig", "rows", "pairs").mapInArrow(run, "contig string, marker long")
    every = markers.select("contig", "marker").distinct().join(maf.select("marker"), "marker", "left_semi")
    return every.join(gone, ["contig", "marker"], "left_anti").select("contig", "marker")
