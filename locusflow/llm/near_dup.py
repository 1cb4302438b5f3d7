"""N-gram Jaccard self-join by MinHash banding, with exact verification.

1. One scan gives each text a digest of its n-gram set and one hash per band. Texts with equal sets form a class and from
   here on a class is one node, however many copies it has.
2. Nodes that share a band hash are candidates. A bucket of any size is kept as edges to its smallest node, and connected
   components of these edges gather all candidates that could be linked.
3. Pairs that share a band are verified on full n-gram sets. How they are brought together is a matter of cost alone: a
   component that fits a task is one unit. A larger one, which chance may have chained together, is taken bucket by
   bucket, buckets with the same members once, and a pair counts in the first bucket that it shares. Where that would
   compare more pairs than the component has (nodes that share nearly all bands), the component as a whole is the cheaper unit
   again. Units are cut into blocks, and each pair of blocks is a task, which gives back link counts and a spanning forest
   of its links, never pairs.
4. Connected components of the verified links are the groups.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.components import components
from locusflow.llm.kept import without
from locusflow.llm.ngrams import N, SEGMENT, forget, mix, new_key, ngram_hashes, ngram_sets, pieces
from locusflow.llm.worker import claim, give_back
from locusflow.session import persisted, prepare_workers, release

SIMILARITY = 0.8
#: A pair at the threshold shares at least one band with this probability at least.
RECALL = 0.99999
ROWS = 4
#: What a block holds on average at most: nodes, and n-grams of all its nodes. Nodes are dealt to blocks by hash.
BLOCK_NODES, BLOCK_GRAMS = 768, 1 << 19
#: Candidates' ids, and keys of rows to drop, are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_IDS = 100_000
SETS = ["k1", "k2", "n"]


def bands_for(similarity: float = SIMILARITY, recall: float = RECALL, rows: int = ROWS) -> int:
    """The fewest bands of so many rows that reach the recall at the threshold: 1 - (1 - s**rows)**bands >= recall."""
    miss = 1 - similarity**rows
    return 1 if miss <= 0 else math.ceil(math.log(1 - recall) / math.log(miss))


def _multipliers(n: int) -> tuple[np.ndarray, np.ndarray]:
    seeds = mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[:n] | np.uint64(1), seeds[n:]


def _identity(grams: np.ndarray, at=None) -> tuple:
    """Two sums over mixed n-grams, of all or of stretches that begin at the given places."""
    mixed = mix(grams), mix(grams ^ np.uint64(0x5851F42D4C957F2D))
    return tuple(m.sum(dtype=np.uint64) if at is None else np.add.reduceat(m, at) for m in mixed)


def sketch(texts: list[bytes], bands: int, key: bytes, rows: int = ROWS, n: int = N) -> tuple[np.ndarray, ...]:
    """(k1, k2, size, bands) of the n-gram sets of lower-case texts; k1 and k2 identify a set. Empty sets are zeros.

    Sets are identified by hashes with the run's key. Bands, which only choose what to compare, come from public hashes
    and are the same in every run.
    """
    k1, k2 = np.zeros(len(texts), np.uint64), np.zeros(len(texts), np.uint64)
    signature = np.zeros((len(texts), bands), np.uint64)
    sets = ngram_sets(texts, n, key)
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    full = np.flatnonzero(size)
    if len(full):
        k1[full], k2[full] = _identity(np.concatenate([sets[i] for i in full]), np.cumsum(size[full]) - size[full])
        grams, counts = ngram_hashes(texts, n)
        at = np.cumsum(counts[full]) - counts[full]
        a, b = _multipliers(bands * rows)
        for band in range(bands):
            value = np.full(len(full), band + 1, np.uint64)
            for k in range(band * rows, (band + 1) * rows):
                value = mix(value * np.uint64(0x2545F4914F6CDD1D) + np.minimum.reduceat(grams * a[k] + b[k], at))
            signature[full, band] = value
    return k1, k2, size, signature


def _sketches(bands: int, rows: int, n: int, key: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", forget)
        for batch in batches:
            for part in pieces(batch, 1):
                texts = part.column(1).to_pylist()
                k1, k2, size, signature = sketch(texts, bands, key, rows, n)
                sha = pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())
                flat = pa.array(signature[size > 0].view(np.int64).ravel())
                ends = np.concatenate([[0], np.cumsum(np.where(size > 0, bands, 0))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(k1.view(np.int64)), pa.array(k2.view(np.int64)), pa.array(size.astype(np.int64)), sha, pa.ListArray.from_arrays(pa.array(ends), flat)], ["id", *SETS, "sha", "bands"])
        give_back()

    return run


# ---------------------------------------------------------------- verification


def linked(sets: list[np.ndarray], similarity: float, left: np.ndarray | None = None) -> np.ndarray:
    """A symmetric matrix of which sets reach the similarity; where two blocks meet, left marks the sets of one.

    Counts of shared n-grams come from products of membership matrices, some columns at a time.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    grams = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(k), size)
    order = np.argsort(grams, kind="stable")
    grams, owner = grams[order], owner[order]
    starts = np.flatnonzero(np.append(True, grams[1:] != grams[:-1])) if len(grams) else np.empty(0, np.int64)
    reach = np.diff(np.append(starts, len(grams)))
    shared = np.repeat(reach > 1, reach)
    column = np.repeat(np.cumsum(reach > 1) - 1, reach)[shared]
    owner = owner[shared]
    both = np.zeros((k, k), np.float32)
    width = max(256, min(4096, (1 << 21) // max(k, 1)))
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + width, width))
    for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
        if a < b:
            member = np.zeros((k, width), np.float32)
            member[owner[a:b], column[a:b] - i * width] = 1
            both += member @ member.T
    out = np.zeros((k, k), bool)
    for a in range(0, k, 256):
        # A stretch of rows at a time: the tables of a large block are what a worker's memory goes to.
        union = (size[a : a + 256, None] + size[None, :]) - both[a : a + 256]
        out[a : a + 256] = (both[a : a + 256] >= similarity * union - 1e-6) & (union > 0)
    np.fill_diagonal(out, False)
    if left is not None:
        out &= left[:, None] != left[None, :]
    return out


def forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a boolean adjacency matrix."""
    fresh = links.any(1)
    edges = []
    while True:
        roots = np.flatnonzero(fresh)
        if not len(roots):
            return edges
        queue = [int(roots[0])]
        fresh[queue[0]] = False
        while queue:
            a = queue.pop()
            near = np.flatnonzero(links[a] & fresh)
            fresh[near] = False
            edges += [(a, int(b)) for b in near]
            queue += near.tolist()


def _sets_of(texts: list[bytes], n: int, key: bytes) -> Iterator[tuple[tuple[int, int, int], np.ndarray]]:
    """((k1, k2, size), sorted set) of each text's n-grams, some texts at a time."""
    at = 0
    while at < len(texts):
        end, total = at + 1, len(texts[at])
        while end < len(texts) and total + len(texts[end]) <= SEGMENT:
            total += len(texts[end])
            end += 1
        for grams in ngram_sets(texts[at:end], n, key):
            yield (*(int(x.view(np.int64)) for x in _identity(grams)), len(grams)), grams
        at = end


def _share_a_band(bands: list) -> np.ndarray:
    """Which pairs of nodes have a band in common."""
    wide = np.array(bands, np.int64)
    out = np.zeros((len(bands), len(bands)), bool)
    for band in wide.T:
        out |= band[:, None] == band[None, :]
    return out


def _met_before(mine: list, unit: int) -> np.ndarray:
    """Which pairs of nodes share a unit that comes before this one; mine holds the units of each node."""
    met = np.zeros((len(mine), len(mine)), bool)
    owner = np.repeat(np.arange(len(mine)), [len(m) for m in mine])
    units = np.concatenate([np.asarray(m, np.int64) for m in mine])
    owner, units = owner[units < unit], units[units < unit]
    order = np.argsort(units, kind="stable")
    owner, units = owner[order], units[order]
    edges = np.flatnonzero(np.concatenate([[True], units[1:] != units[:-1], [True]])) if len(units) else np.empty(0, np.int64)
    for a, b in zip(edges[:-1], edges[1:], strict=True):
        if b - a > 1:
            met[np.ix_(owner[a:b], owner[a:b])] = True
    return met


def _verify(similarity: float, n: int, key: bytes):
    """Tasks arrive as runs of rows with the same (unit, i, j); each is a pair of blocks of a unit."""

    def work(rows: list) -> pa.RecordBatch:
        held: set = set()
        nodes, sets = [], []
        for r, (mine, grams) in zip(rows, _sets_of([r["text"] for r in rows], n, key), strict=True):
            # A repeated id may bring in a text of another class; it isn't this node's.
            if mine == (r["k1"], r["k2"], r["n"]) and r["node"] not in held:
                held.add(r["node"])
                nodes.append(r)
                sets.append(grams)
        two = rows[0]["i"] != rows[0]["j"]
        links = linked(sets, similarity, np.array([r["block"] == r["i"] for r in nodes], bool) if two else None)
        if nodes:
            # Only pairs with a common band count, whatever the unit: each in the first that it shares.
            links &= _share_a_band([r["bands"] for r in nodes]) if rows[0]["units"] is None else ~_met_before([r["units"] for r in nodes], rows[0]["unit"])
        copies = np.array([r["copies"] for r in nodes], np.int64)
        counts = links @ copies
        ids = np.array([r["node"] for r in nodes], np.int64)
        tree = forest(links)
        some = np.flatnonzero(counts)
        a = np.concatenate([ids[some], ids[[x for x, _ in tree]]]) if tree else ids[some]
        b = [None] * len(some) + [int(ids[y]) for _, y in tree]
        c = [int(x) for x in counts[some]] + [0] * len(tree)
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], ["a", "b", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("ngrams", forget)
        task, rows = None, []
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                for row in batch.slice(at, 128).to_pylist():
                    mine = (row["unit"], row["i"], row["j"])
                    if mine != task:
                        if rows:
                            yield work(rows)
                        task, rows = mine, []
                    rows.append(row)
        if rows:
            yield work(rows)
        rows.clear()
        give_back()

    return run


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, n: int = N, recall: float = RECALL, rows: int = ROWS) -> DataFrame:
    """One row per input row: (id_col, class_id, n_links, class_size, kept).

    Two texts are linked if the Jaccard similarity of their sets of n-word shingles (see ngrams.py) is ``similarity`` or
    more. n_links counts the other rows a row is linked with, copies included. class_id is the smallest id of the group
    that links join, directly or through others, and class_size its rows. kept is true for one row of each group, that
    with the smallest id; of rows that tie in id exactly one. Texts without words (null and empty ones too) have equal,
    empty sets and form one group. A null id is larger than any other, and class_id is null only where all ids are.
    Other columns are ignored; no input rows give no rows.
    """
    prepare_workers(docs.sparkSession)
    bands, key = bands_for(similarity, recall, rows), new_key()
    source = docs.select(F.col(id_col).alias("id"), F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    sketches = persisted(source.mapInArrow(_sketches(bands, rows, n, key), f"id {kind}, k1 long, k2 long, n long, sha binary, bands array<long>"), "sketches")

    one = sketches.groupBy(*SETS).agg(F.count("*").alias("copies"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "sha")).alias("low"), F.first("bands").alias("bands"))
    classes = persisted(one.withColumn("node", F.monotonically_increasing_id()), "classes")
    banded = classes.select("node", F.explode("bands").alias("band"))
    buckets = banded.groupBy("band").agg(F.min("node").alias("first"), F.count("*").alias("size")).where("size > 1").select("band", "first")
    # A node's buckets share that node, so their smallest members are joined to the smallest of all: as connected as with
    # every edge, and a large group has little more than one edge a node, not one for each band.
    stars = banded.join(buckets, "band").where("node <> first").groupBy("node").agg(F.min("first").alias("b"), F.collect_set("first").alias("firsts"))
    edges = stars.select(F.explode(F.array_union(F.array("node"), "firsts")).alias("a"), "b").where("a <> b").distinct()
    near = components(edges)

    found = persisted(_links(source, classes, near, similarity, n, key), "links")
    some = classes.count()
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("links").alias("links"))
    joined = components(found.where("b IS NOT NULL").select("a", "b"))
    nodes = classes.select(*SETS, "node", "copies", "low").join(counts, F.col("node") == F.col("a"), "left").drop("a")
    nodes = nodes.join(joined.withColumnRenamed("node", "member"), F.col("node") == F.col("member"), "left").drop("member")
    nodes = persisted(nodes.withColumn("root", F.coalesce("root", "node")), "nodes", some)
    release(classes, found)
    groups = nodes.groupBy("root").agg(F.min("low").alias("top"), F.sum("copies").alias("class_size"))
    nodes = nodes.join(groups, "root").select(*SETS, "top", "class_size", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))

    same = sketches.groupBy("id", *SETS, "sha").agg(F.count("*").alias("same_rows"))
    out = same.join(nodes, SETS).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same_rows"))).alias("nth"))
    top = F.col("id").eqNullSafe(F.col("top.id")) & (F.col("sha") == F.col("top.sha")) & (F.col("nth") == 1)
    return out.select(F.col("id").alias(id_col), F.col("top.id").alias("class_id"), "n_links", "class_size", top.alias("kept"), "sha", "same_rows")


def _units(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Rows (node, SETS, copies, low, unit, units, bands, blocks): the units of verification that each candidate belongs to.

    Where the unit is a whole component, units is null and bands are the node's; else units are the sorted units of the
    node and bands is null.
    """
    weight = F.ceil(F.greatest(F.sum("n") / BLOCK_GRAMS, F.count("*") / BLOCK_NODES)).cast("int").alias("blocks")
    some = near.count()
    member = persisted(classes.join(near, "node"), "candidates", some)
    whole = persisted(member.groupBy("root").agg(weight, F.count("*").alias("size")), "components", some)
    large = whole.where("blocks > 1").select("root", "size")
    one = member.join(whole.select("root", "blocks"), "root").withColumns({"unit": F.col("root"), "units": F.lit(None).cast("array<long>")})
    columns = ["node", *SETS, "copies", "low", "unit", "units", "bands", "blocks"]
    if large.isEmpty():
        return one.select(columns)
    # Buckets of large components; of buckets with the same members the one with the smallest hash stands for all.
    banded = persisted(member.join(large, "root").select("root", "node", "n", F.explode("bands").alias("band")), "banded")
    buckets = banded.groupBy("root", "band").agg(weight, F.count("*").alias("members"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("who")).where("members > 1")
    buckets = persisted(buckets.groupBy("root", "members", "who").agg(F.min("band").alias("unit"), F.first("blocks").alias("blocks")), "buckets")
    cost = buckets.groupBy("root").agg(F.sum(F.col("members").cast("double") * F.col("members")).alias("pairs"))
    apart = large.join(cost, "root").where("pairs < double(size) * size").select("root")
    units = banded.withColumnRenamed("band", "unit").join(buckets.join(apart, "root", "left_semi").select("root", "unit", "blocks"), ["root", "unit"])
    units = persisted(units.select("node", "unit", "blocks"), "units")
    mine = units.groupBy("node").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    parts = member.withColumn("bands", F.lit(None).cast("array<long>")).join(units.join(mine, "node"), "node").select(columns)
    return one.join(apart, "root", "left_anti").select(columns).unionByName(parts)


def _links(source: DataFrame, classes: DataFrame, near: DataFrame, similarity: float, n: int, key: bytes) -> DataFrame:
    """Rows (a, null, count) with linked rows of each node, and (a, b, 0) with edges that join linked nodes."""
    wanted = _units(classes, near).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    wanted = persisted(wanted, "wanted")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_IDS else wanted.hint("merge")
    rows = source.join(wanted, source["id"].eqNullSafe(wanted["low.id"]))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = rows.select("node", *SETS, "copies", "text", "unit", "units", "bands", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return tasks.repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j").mapInArrow(_verify(similarity, n, key), "a long, b long, links long")


def keep_one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rules as in :func:`near_duplicates`."""
    out = near_duplicates(docs, id_col, text_col, **options).select(F.col(id_col).alias("__flow_id"), F.col("sha").alias("__flow_key"), "kept", F.col("same_rows").alias("__flow_same"))
    key = F.unhex(F.sha2(F.lower(F.coalesce(F.col(text_col), F.lit(""))).cast("binary"), 256))
    return without(docs, F.col(id_col), key, out, BROADCAST_IDS)
