"""Hard negatives by one-dimensional distance keys.

Every vector x becomes (x, sqrt(M - |x|^2)), M being the largest squared norm, and a query q becomes (q, 0). Then
``|q' - x'|^2 = M + |q|^2 - 2 <q, x>``: the largest inner products are the nearest points. Each point belongs to its
nearest pivot, and the table is stored sorted by (pivot, distance to the pivot), cut into blocks. A block is an annulus
around its pivot, and by the triangle inequality all of its points are at least as far from q' as q' is from the annulus.

A search begins with the blocks around the query's own key. The k-th best found there bounds the distance of everything
that is still wanted, which is an interval of keys at each pivot. The intervals grow in steps; a step scans the blocks
they newly reach and so shrinks the bound. When they cover the whole bound, the result is certain.

Queries are sorted by the same keys and travel in packs. Which pack meets which block is decided on the intervals alone, by
a join of two small tables, so vectors travel only to where they are needed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.worker import claim
from locusflow.session import persisted, prepare_workers

#: Vectors of a block and queries of a pack, at most, and their bytes (one vector at least).
BLOCK, PACK, BYTES = 2048, 128, 8 << 20
#: Pivots are fitted on so many vectors, by hashed id. They only decide how much is scanned.
SAMPLE_ROWS, PIVOTS, LLOYD = 2048, 64, 4
#: Rounding of distances, as a share of the norms, never keeps a block from being scanned.
SLACK = 1e-6
#: Shares of the bound that the key intervals cover, step by step; the first is the query's own key.
STEPS = (0.0, 0.5, 1.0)
#: Squared norms stay below this, so every inner product fits a long and sums below EXACT are exact in double precision.
LARGEST, EXACT = 2.0**62, 2.0**53
#: The directory of blocks, and packs of queries, are broadcast up to so many rows.
BROADCAST_BLOCKS, BROADCAST_PACKS = 100_000, 64
NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------- geometry


def augmented(vectors: np.ndarray, most: float) -> np.ndarray:
    """Points of equal norm sqrt(most)."""
    v = vectors.astype(np.float64)
    return np.concatenate([v, np.sqrt(np.maximum(most - np.einsum("ij,ij->i", v, v), 0))[:, None]], 1)


def fit_pivots(points: np.ndarray, count: int) -> np.ndarray:
    """Points far from each other, moved to the middle of what is nearest to them."""
    at = [0]
    near = np.full(len(points), np.inf)
    while len(at) < min(count, len(points)):
        near = np.minimum(near, ((points - points[at[-1]]) ** 2).sum(1))
        if not near.max() > 0:
            break
        at.append(int(near.argmax()))
    pivots = points[at]
    for _ in range(LLOYD):
        own = nearest(points, pivots)
        pivots = np.array([points[own == i].mean(0) if (own == i).any() else p for i, p in enumerate(pivots)])
    return pivots


def nearest(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return (np.einsum("ij,ij->i", pivots, pivots)[None, :] - 2 * points @ pivots.T).argmin(1)


def distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of each point to each pivot, from differences: without the cancellation of the expanded square."""
    return np.stack([np.sqrt(((points - p) ** 2).sum(1)) for p in pivots], 1)


def radius(score: np.ndarray, squares: np.ndarray, most: float) -> np.ndarray:
    """Distance at which a query of this squared norm has this score, a little more than less."""
    return np.sqrt(np.maximum(most + squares - 2 * score.astype(np.float64), 0)) + SLACK * (np.sqrt(most) + np.sqrt(squares))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers."""
    a, b = queries.astype(np.float64), vectors.astype(np.float64)
    if np.einsum("ij,ij->i", a, a).max(initial=0) * np.einsum("ij,ij->i", b, b).max(initial=0) < EXACT**2:
        return (a @ b.T).astype(np.int64)
    return queries @ vectors.T  # in 64-bit integers, which Cauchy's inequality and LARGEST keep from overflow


# ---------------------------------------------------------------- what travels


def _vectors(column: pa.ListArray, width: int) -> np.ndarray:
    """Rows of whole numbers, shorter ones filled up with zeros."""
    out = np.zeros((len(column), width), np.int64)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    sizes = np.diff(column.offsets.to_numpy())
    if len(flat):
        out[np.repeat(np.arange(len(column)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _fitting(rows: int, width: int) -> int:
    return max(1, min(rows, BYTES // (8 * width)))


def _keyed(pivots: np.ndarray, most: float, width: int, query: bool):
    """Adds (pivot, distance) to rows that begin with (id, label, v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hard_negatives", lambda: None)
        for batch in batches:
            v = _vectors(batch.column(2), width)
            points = np.pad(v.astype(np.float64), ((0, 0), (0, 1))) if query else augmented(v, most)
            own = nearest(points, pivots)
            away = np.sqrt(((points - pivots[own]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(away)], [*batch.schema.names, "pivot", "distance"])

    return run


def _blocks(width: int):
    """Cuts sorted rows (id, label, v, pivot, distance) into blocks of one pivot."""
    most_rows = _fitting(BLOCK, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        rest: pa.Table | None = None

        def emit(part: pa.Table) -> pa.RecordBatch:
            nonlocal made
            made += 1
            part = part.combine_chunks()
            v = _vectors(part["v"].combine_chunks(), width)
            kind = np.int32 if not len(v) or np.abs(v).max() < 1 << 31 else np.int64
            away = part["distance"].to_numpy()
            data = [part["id"].to_numpy().astype(np.int64), part["label"].to_numpy().astype(np.int64), away, v.astype(kind)]
            return pa.RecordBatch.from_arrays(
                [pa.array([(task << 32) | made], pa.int64()), part["pivot"].slice(0, 1).combine_chunks(), pa.array([away.min()]), pa.array([away.max()]), *(pa.array([x.tobytes()], pa.binary()) for x in data)],
                ["block", "pivot", "low", "high", "ids", "labels", "away", "data"],
            )

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rest = rows if rest is None or not rest.num_rows else pa.concat_tables([rest, rows])
            while rest.num_rows:
                own = rest["pivot"].to_numpy()
                end = int(np.searchsorted(own, own[0], "right"))
                if end == len(own) and end < most_rows:
                    break
                yield emit(rest.slice(0, min(end, most_rows)))
                rest = rest.slice(min(end, most_rows))
        if rest is not None and rest.num_rows:
            yield emit(rest)

    return run


BLOCK_ROW = "block long, pivot int, low double, high double, ids binary, labels binary, away binary, data binary"


def _numbered(width: int):
    """Deals sorted queries to packs."""
    size = _fitting(PACK, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            pack = (task << 32) | ((n + np.arange(batch.num_rows)) // size)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pack)], [*batch.schema.names, "pack"])

    return run


def _packs(pivots: np.ndarray, most: float, width: int, reach: float):
    """Packs sorted queries (pack, id, label, v, own, caps, floors, kth), with an interval of keys for each pivot.

    Columns: pack, queries (their numbers), and lists by pivot: low, high (keys within ``reach`` of the bound; at 0 the
    queries' own keys) and least (below that key everything scores more than any cap). A pack that wants nothing more is
    left out.
    """

    def emit(rows: list) -> pa.RecordBatch | None:
        n, wide = len(rows), max(len(r["caps"]) for r in rows)
        v = np.zeros((n, width), np.int64)
        caps, needs = np.full((n, wide), NONE), np.full((n, wide), np.iinfo(np.int64).max)
        kth = {(i, x["w"]): x["kth"] for i, r in enumerate(rows) for x in r["kth"] or ()}
        for i, r in enumerate(rows):
            v[i, : len(r["v"])] = r["v"]
            for w, (cap, floor) in enumerate(zip(r["caps"], r["floors"], strict=True)):
                caps[i, w], needs[i, w] = cap, max(floor, kth.get((i, w), NONE))
        squares = (v.astype(np.float64) ** 2).sum(1)
        wanted = caps >= needs
        if not wanted.any():
            return None
        # No score reaches beyond the norms: a cap beyond them has no inner edge, a floor below them no outer one.
        outer = np.where(wanted, np.where(needs == NONE, np.inf, radius(needs, squares[:, None], most)), -np.inf).max(1)
        edge = radius(caps, squares[:, None], most) - 4 * SLACK * (np.sqrt(most) + np.sqrt(squares))[:, None]
        inner = np.where(wanted, edge, np.inf).min(1)
        some = outer > -np.inf
        away = distances(np.pad(v.astype(np.float64), ((0, 0), (0, 1))), pivots)

        def interval(share: float) -> tuple[np.ndarray, np.ndarray]:
            if share:
                wide = share * outer[some, None]
                return (away[some] - wide).min(0), (away[some] + wide).max(0)
            own = np.array([r["own"] for r in rows])[:, None] == np.arange(len(pivots))
            return np.where(own, away, np.inf)[some].min(0), np.where(own, away, -np.inf)[some].max(0)

        low, high = interval(reach)
        # A point is no farther from a query than the pivot between them allows: nearer than inner, nothing is wanted.
        least = (inner[some, None] - away[some]).min(0)
        data = [np.array([r["id"] for r in rows], np.int64), np.array([r["label"] for r in rows], np.int64), v, caps, needs, outer]
        lists = [pa.array([x.tolist()], pa.list_(pa.float64())) for x in (low, high, least)]
        return pa.RecordBatch.from_arrays([pa.array([rows[0]["pack"]], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in data), *lists], [x.split()[0] for x in PACK_ROW.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hard_negatives", lambda: None)
        rows: list = []
        for batch in batches:
            for row in batch.to_pylist():
                if rows and row["pack"] != rows[0]["pack"]:
                    if (out := emit(rows)) is not None:
                        yield out
                    rows = []
                rows.append(row)
        if rows and (out := emit(rows)) is not None:
            yield out

    return run


PACK_ROW = "pack long, q_ids binary, q_labels binary, q_data binary, caps binary, needs binary, outer binary, low array<double>, high array<double>, least array<double>"
FOUND = "query long, w int, id long, score long"


def scan(q_ids, q_labels, q_vecs, caps, needs, ids, labels, vecs, k: int, alike: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, window, ids, scores): the k best of each query and window among the vectors; ties go to smaller ids."""
    scores = products(q_vecs, vecs)
    fit = (q_labels[:, None] == labels[None, :]) == alike
    out: tuple[list, ...] = ([], [], [], [])
    for w in range(caps.shape[1]):
        good = fit & (scores <= caps[:, w, None]) & (scores >= needs[:, w, None])
        for r in np.flatnonzero(good.any(1)):
            at = np.flatnonzero(good[r])
            mine = scores[r, at]
            if len(at) > k:
                some = mine >= np.partition(mine, len(at) - k)[len(at) - k]
                at, mine = at[some], mine[some]
            best = np.lexsort((ids[at], -mine))[:k]
            for x, y in zip(out, (np.full(len(best), q_ids[r]), np.full(len(best), w), ids[at[best]], mine[best]), strict=True):
                x.append(y)
    return tuple(np.concatenate(x) if x else np.empty(0, np.int64) for x in out)


def _scans(pivots: np.ndarray, width: int, k: int, alike: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("hard_negatives", lambda: None)
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                q_ids, q_labels, caps, needs = (np.frombuffer(row[c], np.int64) for c in ("q_ids", "q_labels", "caps", "needs"))
                q_vecs = np.frombuffer(row["q_data"], np.int64).reshape(-1, width)
                caps, needs = caps.reshape(len(q_ids), -1), needs.reshape(len(q_ids), -1)
                outer = np.frombuffer(row["outer"], np.float64)
                ids, labels, away = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["labels"], np.int64), np.frombuffer(row["away"], np.float64)
                vecs = np.frombuffer(row["data"], np.int32 if len(row["data"]) == 4 * width * len(ids) else np.int64).reshape(-1, width)
                # Keys that some query's whole interval reaches.
                own = np.sqrt(((np.pad(q_vecs.astype(np.float64), ((0, 0), (0, 1))) - pivots[row["pivot"]]) ** 2).sum(1))
                a, b = np.searchsorted(away, (own - outer).min()), np.searchsorted(away, (own + outer).max(), "right")
                found = scan(q_ids, q_labels, q_vecs, caps, needs, ids[a:b], labels[a:b], vecs[a:b].astype(np.int64), k, alike)
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["query", "w", "id", "score"])

    return run


# ---------------------------------------------------------------- the plan


class _Index:
    """The stored table: blocks sorted by (pivot, distance), and what a search has to know about all of them."""

    def __init__(self, rows: DataFrame, width: int, most: float):
        self.width, self.most = width, most
        drawn = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toPandas()["v"]
        sample = _vectors(pa.array(drawn.tolist(), pa.list_(pa.int64())), width)
        self.pivots = fit_pivots(augmented(sample, most), min(PIVOTS, max(1, len(sample) // 8)))
        keyed = rows.select("id", "label", "v").mapInArrow(_keyed(self.pivots, most, width, False), "id long, label long, v array<long>, pivot int, distance double")
        parts = max(1, -(-rows.count() // (4 * BLOCK)))
        order = ["pivot", "distance", "id"]
        cut = keyed.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_blocks(width), BLOCK_ROW)
        self.blocks = persisted(cut, "blocks")
        # From the end of the block before to the beginning of the one after, so that no key stands beside all blocks.
        beside = Window.partitionBy("at").orderBy("from", "to", "block")
        directory = self.blocks.select("block", F.col("pivot").alias("at"), F.col("low").alias("from"), F.col("high").alias("to"))
        edges = {"after": F.coalesce(F.lag("to").over(beside), F.lit(-np.inf)), "before": F.coalesce(F.lead("from").over(beside), F.lit(np.inf))}
        self.directory = persisted(directory.withColumns(edges), "directory")
        self.count = self.directory.count()

    def asks(self, queries: DataFrame) -> DataFrame:
        """Queries (id, label, v, caps, floors) dealt to packs of neighbours in keys."""
        kinds = ", ".join(f"{c} {t}" for c, t in queries.dtypes)
        keyed = queries.mapInArrow(_keyed(self.pivots, self.most, self.width, True), f"{kinds}, pivot int, distance double")
        parts = max(1, -(-queries.count() // (4 * PACK)))
        dealt = keyed.repartitionByRange(parts, "pivot", "distance", "id").sortWithinPartitions("pivot", "distance", "id")
        return persisted(dealt.mapInArrow(_numbered(self.width), f"{kinds}, pivot int, distance double, pack long"), "asks")

    def search(self, queries: DataFrame, k: int, alike: bool) -> DataFrame:
        """The k best rows (query, w, id, score, rank) of each query and window, among rows of the same label or of others.

        queries: (id, label, v, caps, floors); window w holds the scores from floors[w] to caps[w].
        """
        asks = self.asks(queries)
        best = Window.partitionBy("query", "w").orderBy(F.desc("score"), "id")
        found = queries.sparkSession.createDataFrame([], FOUND).withColumn("rank", F.lit(0))
        met: DataFrame | None = None
        for reach in STEPS:
            kth = found.where(F.col("rank") == k).groupBy("query").agg(F.collect_list(F.struct("w", F.col("score").alias("kth"))).alias("kth"))
            packs = self._packs(asks.join(kth, F.col("id") == F.col("query"), "left"), reach)
            pairs = self._pairs(packs, reach)
            pairs = persisted(pairs if met is None else pairs.join(met, ["pack", "block"], "left_anti"), "pairs")
            met = pairs if met is None else met.unionByName(pairs)
            top = found.drop("rank").unionByName(self._scan(packs, pairs, k, alike)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
            found = persisted(top, "found")
        return found

    def _packs(self, asks: DataFrame, reach: float) -> DataFrame:
        rows = asks.select("pack", "id", "label", "v", F.col("pivot").alias("own"), "caps", "floors", "kth").repartition("pack").sortWithinPartitions("pack", "id")
        return persisted(rows.mapInArrow(_packs(self.pivots, self.most, self.width, reach), PACK_ROW), "packs")

    def _pairs(self, packs: DataFrame, reach: float) -> DataFrame:
        """Rows (pack, block): the blocks whose keys a pack's intervals reach."""
        keys = packs.select("pack", F.posexplode(F.arrays_zip("low", "high", "least")).alias("pivot", "x")).select("pack", "pivot", "x.*")
        directory = F.broadcast(self.directory) if self.count <= BROADCAST_BLOCKS else self.directory.hint("merge")
        begin, end = (F.col(c) for c in (("from", "to") if reach else ("after", "before")))
        near = (end >= F.col("low")) & (begin <= F.col("high")) & (F.col("to") >= F.col("least"))
        return keys.join(directory, (F.col("pivot") == F.col("at")) & near).select("pack", "block")

    def _scan(self, packs: DataFrame, pairs: DataFrame, k: int, alike: bool) -> DataFrame:
        body = packs.drop("low", "high", "least")
        body = F.broadcast(body) if packs.count() <= BROADCAST_PACKS else body.hint("merge")
        meet = pairs.join(body, "pack").join(self.blocks.hint("merge"), "block")
        return meet.mapInArrow(_scans(self.pivots, self.width, k, alike), FOUND)


def hard_negatives(vectors: DataFrame, is_anchor: Column, label: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    ``label`` and ``is_anchor`` are columns of the input. A component x counts as floor(scale * x) in double precision, a
    score is the inner product with the anchor, and higher scores come first, ties by the smaller id. An anchor's positives
    are its first ``positives`` other rows with its label. For each of them come the first ``negatives`` rows of other
    labels with low * positive_score <= 100 * score <= high * positive_score; rank counts from 1. Fewer where there are
    fewer; anchors without a positive, and positives without a negative, give no rows.

    Rows with a null id, label or vector, or with a null, NaN or infinite component, take no part. An id stands for one
    row: of rows that share it, repeated ones too, the one with the largest label, then the largest vector counts. Missing
    components of shorter vectors count as zero. A squared norm of 2**62 or more after scaling is an error, so
    scores fit a long. Other columns are ignored; without anchors there are no rows.
    """
    spark = vectors.sparkSession
    prepare_workers(spark)
    # NaN from a product that overflows isn't finite, either, and ends as an error with the norm.
    finite = F.forall(F.col(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    sound = F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & label.isNotNull() & F.coalesce(finite, F.lit(False))
    scaled = F.transform(F.col(vec_col), lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("double"))
    rows = vectors.where(sound).select(F.col(id_col).cast("long").alias("id"), label.cast("long").alias("label"), scaled.alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("anchor"))
    rows = rows.withColumn("square", F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    small = F.when(F.col("square") < LARGEST, F.col("square")).otherwise(F.raise_error(F.lit("a vector's squared norm leaves a long")).cast("double"))
    rows = persisted(rows.withColumn("square", small).withColumn("v", F.transform("v", lambda x: x.cast("long"))), "vectors")
    if not rows.groupBy("id").count().where("count > 1").isEmpty():
        rows = persisted(rows.groupBy("id").agg(F.max(F.struct("label", "v", "square", "anchor")).alias("x")).select("id", "x.*"), "vectors")
    # Equal rows have equal scores: of those with one label, only so many with the smallest ids can be anyone's.
    most_of = max(positives + 1, negatives)
    alike = Window.partitionBy("label", "v").orderBy("id")
    wanted = rows.withColumn("nth", F.row_number().over(alike)).where(F.col("nth") <= most_of)
    wanted = persisted(wanted.select("id", "label", "v", "square"), "wanted")
    facts = wanted.agg(F.max("square"), F.max(F.size("v"))).first()
    shape = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if facts[0] is None:
        return spark.createDataFrame([], shape)
    index = _Index(wanted, max(facts[1], 1), float(facts[0]))

    # Equal anchors ask once; each then leaves itself out of what comes back.
    anchors = rows.where("anchor").select("id", "label", "v")
    asking = persisted(anchors.groupBy("label", "v").agg(F.min("id").alias("id")).select("id", "label", "v"), "asking")
    who = anchors.withColumnRenamed("id", "anchor_id").join(asking.withColumnRenamed("id", "query"), ["label", "v"]).select("anchor_id", "query")
    who = persisted(who, "anchors")
    open_ends = {"caps": F.array(F.lit(np.iinfo(np.int64).max)), "floors": F.array(F.lit(int(NONE)))}
    near = index.search(asking.withColumns(open_ends), positives + 1, True)
    order = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    pairs = who.join(near.select("query", "id", "score"), "query").where("id <> anchor_id").withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives)

    # One window of scores for each score that a positive can have, of which a query has positives + 1.
    windows = near.groupBy("query").agg(F.sort_array(F.collect_set("score")).alias("of"))
    edge = lambda x, percent, up: (F.ceil if up else F.floor)(x.cast("decimal(38,0)") * percent / 100).cast("decimal(38,0)").cast("long")
    windows = windows.select(F.col("query").alias("id"), "of", F.transform("of", lambda x: edge(x, high, False)).alias("caps"), F.transform("of", lambda x: edge(x, low, True)).alias("floors"))
    windows = persisted(windows, "windows")
    far = index.search(asking.join(windows, "id").select("id", "label", "v", "caps", "floors"), negatives, False)
    scores = windows.select(F.col("id").alias("query"), F.posexplode("of").alias("w", "score"))
    hard = far.join(scores.withColumnRenamed("score", "positive_score"), ["query", "w"])
    hard = hard.select("query", "positive_score", F.col("id").alias("negative_id"), F.col("score").alias("negative_score"), "rank")
    pairs = pairs.select("query", "anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return pairs.join(hard, ["query", "positive_score"]).select([x.split()[0] for x in shape.split(", ")])
