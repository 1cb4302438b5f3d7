import numpy as np
import pytest
from pyspark.sql import functions as F

from locusflow.llm import topk as op


def brute(rows, k):
    ints = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q in {i: v for i, v in ints if i % 5 == 0}.items():
        scores = sorted((-sum(a * b for a, b in zip(q[1], v)), i) for i, v in ints if i != q[0])
        out += [(q[0], r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def run(spark, rows, k=4, **blocks):
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("x"), "rank": F.lit(1), "id": F.lit(2), "label": F.lit(None).cast("int")})
    out = op.exact_top_k(frame.repartition(3), F.col("vec_id") % 5 == 0, k=k, **blocks)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect())


def test_matches_brute_force_with_ties_nulls_and_small_blocks(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 11)]) for i in range(60)]
    rows += [(60 + i, rows[i][1]) for i in range(10)]
    rows += [(90, None), (91, [1.0, None]), (95, [float("nan")] * 11), (100, [float("inf")] * 11), (None, [1.0] * 11), (105, []), (110, [1.0]), (3, rows[4][1])]
    assert run(spark, rows, query_block=4, candidate_block=9) == brute(rows, 4)
    assert run(spark, rows) == brute(rows, 4)


def test_fewer_candidates_than_k_and_empty(spark):
    rows = [(0, [1.0]), (1, [2.0])]
    assert run(spark, rows) == [(0, 1, 1, 64 * 128)]
    assert run(spark, [(1, [1.0])]) == []
    assert run(spark, [(0, [1.0])]) == []


def test_bounds_never_fall_below_the_product():
    rng = np.random.default_rng(1)
    for scale in (200, 1_000_000):
        for d in (1, 2, 3, 7, 23, 64):
            v = rng.integers(-scale, scale, (50, d)).astype(float)
            v[:5] = scale - 1 + np.arange(d) % 2
            levels = op.segmentations(d)
            assert all(w.sum() == d and len(w) < d for w in levels) and (d < 8 or len(levels) >= 2)
            for widths in [np.array([d]), *levels]:
                b = op.segment_bounds(v, widths)
                assert (b @ b.T >= v @ v.T).all()


def test_smooth_vectors_are_pruned():
    t = np.linspace(0, 6, 64)
    rng = np.random.default_rng(2)
    v = np.floor(64 * np.sin(t + rng.uniform(0, 6, (3000, 1))) * rng.uniform(0.2, 1, (3000, 1))).astype(np.int32)
    ids = np.arange(3000)
    q, _, s, scored = op.search_blocks(ids[:8], v[:8], ids, v, 5)
    assert scored < 8 * 3000
    assert op.search_blocks(ids[:8], v[:8], ids, v, 5, np.array([s[q == i].min() for i in range(8)], float))[3] < 8 * 3000 // 20


def test_the_table_s_own_vectors_are_pruned(spark, sf):
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()
    ids = np.array([r["vec_id"] for r in rows])
    v = np.floor(64 * np.array([r["embedding"] for r in rows])).astype(np.int32)
    ask = ids % 20 == 0
    q, c, s, scored = op.search_blocks(ids[ask], v[ask], ids, v, 20)
    # Without a threshold to begin with, all of the first step is scored: here it is the whole table.
    assert scored == ask.sum() * len(ids)
    floors = np.array([s[q == i].min() for i in ids[ask]], float)
    again = op.search_blocks(ids[ask], v[ask], ids, v, 20, floors)
    assert again[3] < 0.25 * scored
    assert sorted(zip(q, c, s)) == sorted(zip(*again[:3]))


def test_large_components_are_searched_exactly(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(0, 0.3, 11)]) for i in range(40)]
    rows += [(i, [float(x) for x in rng.normal(0, 20000, 11)]) for i in (40, 41, 42, 45)]
    # Sums that only differ below a double's last bit, and ones that cancel.
    rows += [(46, [1e7] * 2 + [0.0] * 9), (47, [1e7] * 2 + [0.015625] + [0.0] * 8), (50, [1e7] * 2 + [0.015625] * 9), (51, [1e7, -1e7] + [1.0] * 9)]
    assert run(spark, rows, query_block=4, candidate_block=9) == brute(rows, 4)
    assert run(spark, rows) == brute(rows, 4)


def test_scores_beyond_a_long(spark):
    rows = [(0, [1e15, 0.0]), (1, [-1e15, 0.0]), *((i, [0.0, 1.0]) for i in range(2, 6))]
    # The one that is out of range is not among the four best; then it is.
    assert [r[2] for r in run(spark, rows) if r[0] == 0] == [2, 3, 4, 5]
    with pytest.raises(Exception, match="beyond 64 bits"):
        run(spark, [(0, [1e15]), (1, [1e15])])


def test_ranges_of_blocks_bound_their_products():
    rng = np.random.default_rng(3)
    for d, segment in ((7, 2), (64, 4), (5, 8)):
        q, c = (np.floor(rng.normal(0, 50, (n, d)) + rng.normal(0, 90, d)) for n in (6, 9))
        (ql, qh, qd), (cl, ch, cd) = (map(np.array, op.block_ranges(x, segment)) for x in (q, c))
        bound = (np.max([a * b for a in (ql, qh) for b in (cl, ch)], 0) + qd * cd).sum()
        assert (q @ c.T).max() <= bound * (1 + 1e-9) + 1e-9


def test_cells_that_can_t_hold_a_neighbour_never_meet(spark):
    """Clustered vectors, sorted into blocks by their coarse statistics: few cells are left, and nothing is lost."""
    rng = np.random.default_rng(8)
    middles = np.repeat(np.eye(16), 4, 1) * 8
    rows = [(i, [float(x) for x in middles[i % 16] + rng.normal(0, 0.3, 64)]) for i in range(640)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    out = op.exact_top_k(frame.repartition(3), F.col("vec_id") % 5 == 0, k=4, query_block=8, candidate_block=40)
    assert sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in out.collect()) == brute(rows, 4)
    kept = frame.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: x.cast("double") * 64.0).alias("v"))
    blocks = op._blocks(kept.withColumn("floor", F.lit(None).cast("long")), 40, "c", 4)
    asking = op._blocks(kept.where("id % 5 = 0").withColumn("floor", F.lit(64 * 64 * 150).cast("long")), 8, "q", 4)
    cells = op._chosen(blocks, asking).count()
    assert 0 < cells < blocks.count() * asking.count() / 4
