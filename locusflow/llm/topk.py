"""Exact top-k inner-product search by multi-resolution segment statistics.

A vector is cut into segments, and a segment is known by its mean and its deviation. For two vectors,
``sum over segments of m * (mean_q * mean_c + dev_q * dev_c)`` is never below their inner product (Cauchy-Schwarz in each
segment), so with the distance ``-<q, c>`` it gives a lower bound. Bounds are tried coarse to fine: few long segments, more
short ones, then growing parts of the vector at full resolution (segments of one component, whose deviation is 0) with
short segments for the rest. A pair whose bound doesn't reach the query's k-th best so far is out; the others, and only
these, are scored exactly.

Vectors travel as packed blocks. The stated queries first meet a part of the candidates that is drawn by hashed id, which gives
each a k-th best to begin with, and then all others on a grid of blocks: each cell of the grid is a row of an equi-join on the
cell's number, whose size is bounded by the block sizes, and gives back k rows per query at most. Blocks gather vectors with
alike coarse statistics, and keep the ranges of these: a cell whose ranges can't reach what its queries need is left
out before any vector moves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.session import persisted, prepare_workers

#: Vectors with a component beyond this size, as an integer, would leave the exact range of double sums: their pairs are
#: scored in Python's integers, after a bound on rounding has left out those that can't be among the best.
LARGEST = 1 << 20
QUERY_BLOCK, CANDIDATE_BLOCK = 4096, 16384
#: Numbers of blocks are broadcast up to so many.
BROADCAST_BLOCKS = 100_000
#: Queries and candidates that are compared at a time inside a cell.
QUERY_STEP, CANDIDATE_STEP = 256, 2048
#: The bounds are computed in double precision; this share of the norms' product keeps rounding from ever cutting a true
#: neighbour.
SLACK = 1e-9
#: Numbers of equal segments of the coarse levels; parts of the vector that the fine levels have at full resolution, and
#: the length of segments in their rest.
COARSE, FINE, REST = (4, 16), (0.5, 0.75), 4
#: A level that rules out less than this share of what it looks at is left out for so many steps.
DULL, PAUSE = 0.1, 15


def segmentations(d: int) -> list[np.ndarray]:
    """The segments' lengths of each level for vectors of d components, coarse to fine."""
    out = []
    for n in COARSE:
        width = -(-d // n)
        out.append([width] * (d // width) + [d % width] * (d % width > 0))
    for part in FINE:
        units = int(d * part)
        rest = d - units
        out.append([1] * units + [REST] * (rest // REST) + [rest % REST] * (rest % REST > 0))
    # Short vectors make levels alike, and one with only single components would be the score itself.
    return [np.array(x) for i, x in enumerate(out) if x not in out[:i] and len(x) < d]


def segment_bounds(vectors: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Rows whose inner products bound those of the vectors: means and deviations by segment, scaled by its length.

    The last column adds the slack for rounding.
    """
    at = np.cumsum(widths) - widths
    means = np.add.reduceat(vectors, at, 1) / widths
    deviations = np.sqrt(np.add.reduceat((vectors - np.repeat(means, widths, 1)) ** 2, at, 1))[:, widths > 1]
    norms = np.sqrt(SLACK) * (1 + np.sqrt(np.einsum("ij,ij->i", vectors, vectors)))
    return np.concatenate([means * np.sqrt(widths), deviations, norms[:, None]], 1)


class TopK:
    """The k best candidates of some queries so far; ties go to the smaller id.

    floors: scores that are reached by k candidates elsewhere already, so less isn't wanted. scored counts the pairs
    that were scored exactly, offered all pairs.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int, floors: np.ndarray | None = None):
        self.ids, self.k = ids, k
        self.vectors = vectors.astype(np.float64)
        self.levels = [segment_bounds(self.vectors, s) for s in segmentations(vectors.shape[1])]
        self.scores = np.full((len(ids), k), -np.inf)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.floors = np.full(len(ids), -np.inf) if floors is None else floors
        self.pause = [0] * len(self.levels)
        self.scored = self.offered = 0

    def offer(self, ids: np.ndarray, vectors: np.ndarray, stats: list[np.ndarray]) -> None:
        """Takes in one step of candidates."""
        least = np.maximum(self.scores[:, -1], self.floors)
        self.offered += len(self.ids) * len(ids)
        alive = np.ones((len(self.ids), len(ids)), bool)
        at = np.arange(len(ids))
        if (least > -np.inf).any():
            for i, (mine, theirs) in enumerate(zip(self.levels, stats, strict=True)):
                if self.pause[i]:
                    self.pause[i] -= 1
                    continue
                was = np.count_nonzero(alive)
                alive &= mine @ theirs[at].T >= least[:, None]
                now = np.count_nonzero(alive)
                if not now:
                    return
                if now > (1 - DULL) * was:
                    self.pause[i] = PAUSE
                some = alive.any(0)
                at, alive = at[some], alive[:, some]
        self.scored += np.count_nonzero(alive)
        for r in np.flatnonzero(alive.any(1)):
            mine = at[alive[r]]
            score = vectors[mine] @ self.vectors[r]
            who = ids[mine]
            new = (score >= least[r]) & (who != self.ids[r])
            if new.any():
                both, who = np.concatenate([self.scores[r], score[new]]), np.concatenate([self.found[r], who[new]])
                order = np.lexsort((who, -both))[: self.k]
                self.scores[r], self.found[r] = both[order], who[order]


def search_blocks(q_ids, q_vecs, c_ids, c_vecs, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query ids, candidate ids, scores, exact scores computed) of the k best of each query among the candidates."""
    out: list = [[], [], []]
    c_vecs = c_vecs.astype(np.float64)
    stats = [segment_bounds(c_vecs, s) for s in segmentations(c_vecs.shape[1])]
    # Candidates with large norms first: they raise the thresholds soonest.
    order = np.argsort(-np.einsum("ij,ij->i", c_vecs, c_vecs), kind="stable")
    scored = 0
    for a in range(0, len(q_ids), QUERY_STEP):
        part = slice(a, a + QUERY_STEP)
        best = TopK(q_ids[part], q_vecs[part], k, None if floors is None else floors[part])
        for b in range(0, len(c_ids), CANDIDATE_STEP):
            some = order[b : b + CANDIDATE_STEP]
            best.offer(c_ids[some], c_vecs[some], [s[some] for s in stats])
        hit = np.isfinite(best.scores)
        out[0].append(np.repeat(best.ids, hit.sum(1)))
        out[1].append(best.found[hit])
        out[2].append(best.scores[hit].astype(np.int64))
        scored += best.scored
    return (*(np.concatenate(x) if x else np.empty(0, np.int64) for x in out), scored)


def large(vectors: np.ndarray) -> np.ndarray:
    """Which rows leave the exact range."""
    return (np.abs(vectors) >= LARGEST).any(1)


def search_large(q_ids, q_vecs, c_ids, c_vecs, k: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """As :func:`search_blocks` for vectors of any size (whole numbers as doubles), with scores in Python's integers."""
    out: tuple[list, list, list] = ([], [], [])
    c_abs = np.abs(c_vecs)
    for i, q in zip(q_ids, q_vecs, strict=True):
        at = np.flatnonzero(c_ids != i)
        with np.errstate(over="ignore", invalid="ignore"):
            near = c_vecs[at] @ q
            off = (len(q) + 2) * np.finfo(float).eps * (c_abs[at] @ np.abs(q))
            least, most = near - off, near + off
        # What overflows a double says nothing.
        least, most = np.where(np.isfinite(near) & np.isfinite(off), (least, most), [[-np.inf], [np.inf]])
        if len(at) > k:
            at = at[most >= np.partition(least, len(at) - k)[len(at) - k]]
        whole = [int(x) for x in q]
        best = sorted((-sum(a * int(b) for a, b in zip(whole, c_vecs[j]) if a), int(c_ids[j])) for j in at)[:k]
        out[0].extend([i] * len(best))
        out[1].extend(c for _, c in best)
        out[2].extend(-s for s, _ in best)
    return np.array(out[0], np.int64), np.array(out[1], np.int64), out[2]


def search_any(q_ids, q_vecs, c_ids, c_vecs, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, candidate ids, scores, side): all that can be among the k best; side is -1 or 1 for scores beyond 64 bits."""
    ql, cl = large(q_vecs), large(c_vecs)
    q, c, s, _ = search_blocks(q_ids[~ql], q_vecs[~ql], c_ids[~cl], c_vecs[~cl], k, None if floors is None else floors[~ql])
    parts = [(q, c, s, np.zeros(len(q), np.int8))]
    for mine, theirs in ((ql, np.ones(len(c_ids), bool)), (~ql, cl)):
        if mine.any() and theirs.any():
            q, c, s = search_large(q_ids[mine], q_vecs[mine].astype(float), c_ids[theirs], c_vecs[theirs].astype(float), k)
            side = np.array([(x >= 1 << 63) - (x < -(1 << 63)) for x in s], np.int8)
            parts.append((q, c, np.array([0 if o else x for x, o in zip(s, side, strict=True)], np.int64), side))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def block_ranges(vectors: np.ndarray, segment: int) -> tuple[list[float], list[float], list[float]]:
    """(least mean, largest mean, largest deviation) of each segment of so many components, scaled by the segment's length.

    Components behind a block's own width are zeros, and so are the ranges of segments that it doesn't reach.
    """
    wide = -(-vectors.shape[1] // segment) * segment
    parts = np.pad(vectors.astype(np.float64), ((0, 0), (0, wide - vectors.shape[1]))).reshape(len(vectors), -1, segment)
    means = parts.mean(2)
    deviations = np.sqrt(((parts - means[:, :, None]) ** 2).sum(2))
    means *= np.sqrt(segment)
    return means.min(0).tolist(), means.max(0).tolist(), deviations.max(0).tolist()


def _pack(block: int, segment: int):
    """Turns rows (id, numbers, floor) into rows (ids, components, width, floors, ranges) of at most ``block`` vectors, widths padded by zeros.

    Components take 4 bytes in blocks of ordinary vectors and are doubles in others.
    """

    def emit(rows: list) -> pa.RecordBatch:
        width = max(max((len(v) for _, v, _ in rows), default=0), 1)
        kind = np.float64 if any(len(v) and np.abs(v).max() >= LARGEST for _, v, _ in rows) else np.int32
        data = np.zeros((len(rows), width), kind)
        for i, (_, v, _) in enumerate(rows):
            data[i, : len(v)] = v
        ids = np.array([i for i, _, _ in rows], np.int64)
        floors = np.array([-np.inf if f is None else f for _, _, f in rows], np.float64)
        with np.errstate(over="ignore", invalid="ignore"):
            ranges = [pa.array([x], pa.list_(pa.float64())) for x in block_ranges(data, segment)]
        return pa.RecordBatch.from_arrays([*(pa.array([x.tobytes()], pa.binary()) for x in (ids, data)), pa.array([width], pa.int32()), pa.array([floors.tobytes()], pa.binary()), pa.array([float(floors.min())]), *ranges], ["ids", "data", "width", "floors", "least", "low", "high", "dev"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list = []
        for batch in batches:
            for i, v, f in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                rows.append((i, np.floor(v.values.to_numpy(zero_copy_only=False)), f))
                if len(rows) >= block:
                    yield emit(rows)
                    rows = []
        if rows:
            yield emit(rows)

    return run


def _cells(k: int):
    def unpack(ids, data, width):
        kind = np.int32 if len(data) == len(ids) // 2 * width else np.float64
        return np.frombuffer(ids, np.int64), np.frombuffer(data, kind).reshape(-1, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                qi, qv = unpack(row["q_ids"], row["q_data"], row["q_width"])
                ci, cv = unpack(row["c_ids"], row["c_data"], row["c_width"])
                wide = max(qv.shape[1], cv.shape[1])
                qv, cv = (np.pad(x, ((0, 0), (0, wide - x.shape[1]))) for x in (qv, cv))
                q, c, s, o = search_any(qi, qv, ci, cv, k, np.frombuffer(row["q_floors"], np.float64))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in (q, c, s)), pa.array(o, pa.int8())], ["query_id", "vec_id", "score", "side"])

    return run


def exact_top_k(vectors: DataFrame, is_query, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vec_col: str = "embedding", query_block: int = QUERY_BLOCK, candidate_block: int = CANDIDATE_BLOCK) -> DataFrame:
    """The k largest integer inner products of each query, over every row but those with the query's own id.

    Rows: (query_id, rank, vec_id, score), rank from 1, ties to the smaller vec_id. A component x counts as
    floor(scale * x) in double precision. ``is_query`` is a condition on the input's columns. Rows take no part if their
    id or vector is null, or if a component is null, NaN or infinite; one that only overflows by the scale is an error,
    and so is a score among the best that a long can't hold. Missing
    components of shorter vectors count as zero, so an empty vector scores 0. Repeated rows are each a candidate; rows with
    one query's id give its results once, for the largest of their vectors (compared component by component). Other columns are ignored; without queries or candidates there are no
    rows.
    """
    prepare_workers(vectors.sparkSession)
    scaled = F.transform(F.col(vec_col), lambda x: x.cast("double") * F.lit(float(scale)))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull()
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    sound &= F.coalesce(finite, F.lit(False))
    fits = F.transform(scaled, lambda x: F.when(F.abs(x) < float("inf"), x).otherwise(F.raise_error(F.lit("a component overflows by the scale")).cast("double")))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), fits.alias("v"), is_query.alias("is_query"))
    kept = persisted(rows, "vectors")
    # Of rows that share a query's id the one with the largest vector asks.
    asking = persisted(kept.where("is_query").groupBy("id").agg(F.max("v").alias("v")), "asking")
    facts = kept.agg(F.count("*"), F.max(F.size("v"))).first()
    segment = max(1, -(-(facts[1] or 1) // COARSE[-1]))
    none = F.lit(None).cast("long")
    drawn = F.pmod(F.xxhash64("id", F.lit("first")), F.lit(max(1, -(-facts[0] // candidate_block)))) == 0
    rest = _blocks(kept.where(~drawn).withColumn("floor", none), candidate_block, "c", segment)
    start = _blocks(kept.where(drawn).withColumn("floor", none), candidate_block, "c", segment)
    first = persisted(_grid(start, _blocks(asking.withColumn("floor", none), query_block, "q", segment), k), "first")
    # A k-th best among these: nothing less is among the best of all.
    reached = first.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.max(F.abs("side")).alias("wide"), F.slice(F.sort_array(F.collect_list("score"), asc=False), k, 1).alias("kth"))
    reached = reached.where((F.col("n") >= k) & (F.col("wide") == 0)).select("id", F.col("kth")[0].alias("floor"))
    found = first.unionByName(_grid(rest, _blocks(asking.join(reached, "id", "left"), query_block, "q", segment), k))
    best = Window.partitionBy("query_id").orderBy(F.desc("side"), F.desc("score"), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    score = F.when(F.col("side") == 0, F.col("score")).otherwise(F.raise_error(F.lit("a score among the best is beyond 64 bits")).cast("long"))
    return top.select("query_id", "rank", "vec_id", score.alias("score"))


SMALL = ("least", "low", "high", "dev")


def _blocks(rows: DataFrame, block: int, side: str, segment: int) -> DataFrame:
    """Rows (id, v, floor) packed into blocks with a number each: x_no, x_ids, x_data, x_width, x_floors and the block's
    ranges, x being the side's letter.

    Vectors are sorted by the segment that their mean is largest in, either way, and by that mean.
    """
    rows = rows.select("id", "v", "floor")
    begins = F.sequence(F.lit(0), F.greatest(F.size("v") - 1, F.lit(0)), F.lit(segment))
    sums = F.transform(begins, lambda i: F.aggregate(F.slice("v", i + 1, F.lit(segment)), F.lit(0.0), lambda s, x: s + F.floor(x)))
    top = F.array_max(F.transform(sums, lambda s, i: F.struct(F.abs(s).alias("size"), i.alias("i"), s.alias("s"))))
    keyed = rows.withColumn("_top", top).select("id", "v", "floor", (F.col("_top.i") * 2 + (F.col("_top.s") < 0).cast("int")).alias("_k"), F.col("_top.size").alias("_s"))
    order = ["_k", "_s", "id"]
    sized = keyed.repartitionByRange(max(1, -(-rows.count() // block)), *order).sortWithinPartitions(*order).select("id", "v", "floor")
    packed = sized.mapInArrow(_pack(2 * block, segment), "ids binary, data binary, width int, floors binary, least double, low array<double>, high array<double>, dev array<double>")
    packed = persisted(packed.withColumn("raw", F.monotonically_increasing_id()), f"{side}_blocks")
    # One number per block of thousands of vectors; the vectors stay where they are.
    raw = sorted(r[0] for r in packed.select("raw").collect())
    numbers = rows.sparkSession.createDataFrame([(r, i) for i, r in enumerate(raw)], "raw long, no long")
    packed = packed.join(F.broadcast(numbers) if len(raw) <= BROADCAST_BLOCKS else numbers.hint("merge"), "raw")
    return packed.select(*(F.col(c).alias(f"{side}_{c}") for c in ("ids", "data", "width", "floors", "no", *SMALL)))


def _reach() -> Column:
    """A bound of the inner products of a query of one block with a candidate of another, from both blocks' ranges."""
    ranges = F.arrays_zip(*(f"{x}_{c}" for x in "qc" for c in SMALL[1:]))
    corners = lambda r: F.greatest(*(r[f"q_{a}"] * r[f"c_{b}"] for a in ("low", "high") for b in ("low", "high")))
    # A segment that one side lacks adds nothing.
    part = lambda r: F.coalesce(corners(r) + r["q_dev"] * r["c_dev"], F.lit(0.0))
    size = lambda r: F.coalesce(F.greatest(F.abs(r["q_low"]), F.abs(r["q_high"])) * F.greatest(F.abs(r["c_low"]), F.abs(r["c_high"])) + r["q_dev"] * r["c_dev"], F.lit(0.0))
    total = lambda f: F.aggregate(F.transform(ranges, f), F.lit(0.0), lambda s, x: s + x)
    return total(part) + SLACK * (1 + total(size))


def _chosen(candidates: DataFrame, queries: DataFrame) -> DataFrame:
    """Cells (q_no, c_no) whose blocks' ranges reach what some query needs: a join of small rows, one for each block."""
    last = candidates.agg(F.max("c_no")).first()[0]
    small = lambda x, df: df.select(f"{x}_no", *(f"{x}_{c}" for c in SMALL))
    numbers = F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long")) if last is not None else F.array().cast("array<long>")
    met = small("q", queries).withColumn("c_no", F.explode(numbers)).join(small("c", candidates).drop("c_least"), "c_no")
    # A range that overflows says nothing; the ranges of a query without a floor aren't looked at.
    reach = _reach()
    return met.where(~F.coalesce((reach < F.col("q_least")) & ~F.isnan(reach), F.lit(False))).select("q_no", "c_no")


def _grid(candidates: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Partial results (query_id, vec_id, score, side): k rows at most for a query and a block of candidates."""
    left = queries.drop(*(f"q_{c}" for c in SMALL)).join(_chosen(candidates, queries), "q_no")
    right = candidates.drop("c_floors", *(f"c_{c}" for c in SMALL))
    return left.join(right, "c_no").mapInArrow(_cells(k), "query_id long, vec_id long, score long, side byte")
