import random

import numpy as np
import pytest
from fixtures import ALL, HEAD, vcf, write
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators import ld, mask, pca, qc, stats
from locusflow.operators import relatedness as kin
from locusflow.operators.packed import packed_rows
from locusflow.sources.vcf import read_variants

POSITIONS = [5 * (i + 1) for i in range(240)]
SAMPLES = [f"S{i:02d}" for i in range(64)]
HEADER = HEAD.replace("##contig=<ID=chr2>\n", "")


def genotypes(seed=1729):
    """Dosages of 62 unrelated samples: a new one is drawn again until it is far from the kinship threshold."""
    rng = np.random.default_rng(seed)
    p = rng.uniform(0.25, 0.75, 240)
    rows: list[np.ndarray] = []
    while len(rows) < 61:
        new = rng.binomial(2, p).astype(np.uint8)
        if rows:
            m = [x.astype(float) for x in kin.king_matrices(new[None], np.array(rows))[:4]]
            if np.nanmax(kin.kinship(*m)) > 0.06:
                continue
        rows.append(new)
    return np.array(rows)


def cohort():
    x = genotypes()
    x[:, 10] = x[:, 9]  # 55 like 50
    x[:, 2], x[:, 3] = 0, 0  # 15 does not vary
    x[1, 3] = 1  # 20: one carrier
    rng = random.Random(5)
    half = set(rng.sample(range(61), 33))
    text = {0: "0/0", 1: "0/1", 2: "1/1"}
    records = []
    for k, pos in enumerate(POSITIONS):
        calls = []
        for s in range(64):
            who = 0 if s == 61 else s
            call = f"{text[int(x[who, k])]}:20:50" if s < 62 else "./.:20:50" if s == 62 else f"{text[int(x[0, k])]}:1:1"
            if pos == 5 or pos == 10 and who in half:
                call = "./.:20:50"
            special = {(25, 2): f"{text[int(x[2, k])]}:9:50", (30, 3): f"{text[int(x[3, k])]}:20:19", (35, 4): "0/.:20:50", (40, 5): "1:20:50", (45, 6): "0/1:10:20"}
            calls.append(special.get((pos, s), call))
        records.append(("1", pos, f"v{pos}", "A", "CG"[k % 2], "PASS", ALL, " ".join(calls)))
    extra = " ".join(["0/1:20:50"] * 64)
    records += [("1", 1500, "i", "A", "AC", "PASS", ALL, extra), ("1", 1505, "q", "A", "C", "q10", ALL, extra), ("X", 100, "x", "A", "C", "PASS", ALL, extra)]
    return records


@pytest.fixture(scope="module")
def run(spark, tmp_path_factory):
    path = write(tmp_path_factory.mktemp("cohort") / "c.vcf", vcf(cohort(), SAMPLES, HEADER))
    records, samples, _ = read_variants(spark, path)
    sites = records.withColumn("skip_reason", g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")))
    mask.check_masking(records, 10, 20)
    masked = mask.mask_variants(records, 10, 20).cache()
    long = stats.explode_calls(masked, samples)
    doses = long.select(F.col("sample"), F.col("rec").alias("marker"), g.dosage(F.col("alleles")).alias("dose")).cache()
    return sites, masked, doses


def test_masking_and_missingness(run):
    sites, masked, doses = run
    assert tuple(stats.record_totals(sites).first()) == (243, 240, 1, 1, 1)
    call = lambda pos, s: masked.where(F.col("pos") == pos).select(F.col("calls")[s]["gt"]).first()[0]
    assert all(call(p, s) == [None, None] for p, s in ((25, 2), (30, 3), (35, 4), (40, 5))) and call(45, 6) == [0, 1]
    kept = qc.sample_qc(doses, 0.1)
    gone = {r[0] for r in doses.select("sample").distinct().exceptAll(kept.select("sample").distinct()).collect()}
    assert gone == {"S62", "S63"}
    assert qc.site_qc(kept, 0.1).select("marker").distinct().count() == 238
    frequent = {r["marker"] for r in qc.maf_filter(qc.site_qc(kept, 0.1), 0.05).collect()}
    assert len(frequent) == 236 and not frequent & {2, 3}


def test_relatedness_ld_and_components(spark, run):
    _, masked, doses = run
    clean = qc.site_qc(qc.sample_qc(doses, 0.1), 0.1)
    maf = qc.maf_filter(clean, 0.05).cache()
    common = clean.join(maf.select("marker"), "marker").withColumn("sample", F.substring("sample", 2, 2).cast("long"))
    pairs = kin.king_pairs(common.withColumn("marker", F.col("marker").cast("int")), 240, 0.0884, block=16)
    found = pairs.collect()
    assert [(r["a"], r["b"], r["kinship"]) for r in found] == [(0, 61, 0.5)]
    plain = {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_pairs_relational(common, -9).collect()}
    tiles = {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_pairs(common, 240, -9, block=16).collect()}
    assert plain == tiles and len(plain) == 62 * 61 // 2
    # Markers in parts, some of which lack a sample.
    gaps = common.where("NOT (sample % 7 = 3 AND marker < 60)")
    parts = {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_pairs(gaps, 240, -9, block=16, part=50).collect()}
    assert parts == {(r["a"], r["b"]): (r["nsnp"], round(r["kinship"], 12)) for r in kin.king_pairs_relational(gaps, -9).collect()}
    assert [tuple(r) for r in kin.related_exclusions(pairs).collect()] == [(61, 0)]
    kept = common.where("sample <> 61")
    order = sorted(r[0] for r in kept.select("sample").distinct().collect())
    number = spark.createDataFrame([(s, i) for i, s in enumerate(order)], "sample long, at int")
    packed = packed_rows(kept.join(F.broadcast(number), "sample"), "marker", "at", len(order))
    places = masked.select(F.col("rec").alias("row"), "contig", "pos")
    markers = ld.ranked(packed.join(places, "row").select("contig", "pos", F.col("row").alias("marker"), "data")).cache()
    near = {(r["a"], r["b"]): r["r2"] for r in ld.ld_pairs(markers, 50, 0.2).collect()}
    assert near[(9, 10)] == pytest.approx(1.0)
    for window, step, least in ((50, 5, 0.2), (20, 20, 0.05), (7, 3, 0.02)):
        every = [(r["contig"], r["rank"], r["marker"]) for r in markers.collect()]
        place = {m: (c, k) for c, k, m in every}
        rate = {r["marker"]: r["maf"] for r in maf.collect()}
        r2 = {(r["a"], r["b"]): r["r2"] for r in ld.ld_pairs(markers, 200, least).collect()}
        linked = [(a, b) for a, b in r2 if a in rate and b in rate and place[b][1] < place[a][1] // step * step + window]
        want = [m for c in {c for c, _, _ in every} for m in ld.prune_order([m for d, _, m in sorted(every) if d == c and m in rate], rate, [p for p in linked if place[p[0]][0] == c])]
        assert sorted(r["marker"] for r in ld.ld_prune(markers, maf, window, least, step).collect()) == sorted(want)
    stay = ld.ld_prune(markers, maf, 50, 0.2)
    left = {r["marker"] for r in stay.collect()}
    assert 3 < len(left) < 236 and not {9, 10} <= left
    assert not any(a in left and b in left for a, b in near)
    chosen = markers.join(stay.select("marker"), "marker")
    c = pca.principal_components(chosen, order, 3)
    residual = pca.residuals(chosen, c)
    report = pca.check_components(c, residual)
    assert report["samples"] == 61 and report["markers"] == len(left) and max(report["residuals"]) < 1e-3
    flipped = pca.Components(c.samples, c.values, c.vectors * [-1, 1, -1], c.markers)
    assert pca.check_components(flipped, pca.residuals(chosen, flipped))["validated"]
    for values in (c.values[::-1], -c.values, c.values * 2):
        wrong = pca.Components(c.samples, values, c.vectors, c.markers)
        with pytest.raises(ValueError):
            pca.check_components(wrong, pca.residuals(chosen, wrong))
    with pytest.raises(ValueError):
        pca.principal_components(chosen, order[:2], 1)


@pytest.mark.parametrize("task_pairs", [10**6, 9, 0])
def test_exclusions_match_the_sequential_rule(spark, task_pairs):
    rng = random.Random(8)
    edges = [(a, b) for a in range(40) for b in range(a + 1, 40) if rng.random() < 0.06] + [(100 + 10 * k, 100 + 10 * k + rng.randrange(1, 9)) for k in range(30)]
    out: dict[int, int] = {}
    for a, b in sorted(edges):
        if a not in out and b not in out:
            out[b] = a
    frame = spark.createDataFrame(edges + [(b, a) for a, b in edges[:3]] + [(7, 7)], "a long, b long")
    assert {r["sample"]: r["reason"] for r in kin.related_exclusions(frame, task_pairs).collect()} == out
    named = frame.select(*(F.concat(F.lit("S"), F.lpad(F.col(c).cast("string"), 4, "0")).alias(c) for c in "ab"))
    assert {(int(r["sample"][1:]), int(r["reason"][1:])) for r in kin.related_exclusions(named, task_pairs).collect()} == set(out.items())
    assert kin.related_exclusions(spark.createDataFrame([], "a long, b long"), task_pairs).count() == 0


def test_a_long_chain_takes_few_jobs(spark):
    n = 10_000
    chain = spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.range(5).select((F.col("id") * 3 + 20_000).alias("a"), (F.col("id") * 3 + 20_001).alias("b")))
    tracker = spark.sparkContext.statusTracker()
    for task_pairs, most in ((10**6, 10), (n, 250)):
        spark.sparkContext.setJobGroup(f"chain-{task_pairs}", "")
        got = {r["sample"]: r["reason"] for r in kin.related_exclusions(chain, task_pairs).collect()}
        jobs = len(tracker.getJobIdsForGroup(f"chain-{task_pairs}"))
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        assert got == {**{i: i - 1 for i in range(1, n + 1, 2)}, **{20_001 + 3 * i: 20_000 + 3 * i for i in range(5)}}
        assert jobs < most


def test_components_match_a_union_of_sets(spark):
    from locusflow.operators.components import components

    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(500 + i, 501 + i) for i in range(70)] + [(900, 900 + i) for i in range(40)] + [(999, 999)]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["root"] for r in got} == {x: top(x) for x in root} and len(got) == len(root)


def test_band_join_matches_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.integers(0, 4, (70, 30)).astype(np.uint8)
    rows = [("1" if i < 40 else "2", i if i < 40 else i - 40, i, bytes(x[i] + 48)) for i in range(70)]
    got = {(r["a"], r["b"]) for r in ld.ld_pairs(spark.createDataFrame(rows, "contig string, rank int, marker long, data binary"), 7, 0.05).collect()}
    want = set()
    for i in range(70):
        for j in range(i + 1, 70):
            if rows[i][0] == rows[j][0] and rows[j][1] - rows[i][1] < 7:
                both = (x[i] != 3) & (x[j] != 3)
                r = np.corrcoef(x[i][both].astype(float), x[j][both].astype(float))[0, 1] ** 2
                if r > 0.05:
                    want.add((i, j))
    assert got == want


def test_ld_uses_all_samples_beyond_the_limit_of_components(spark, sf, monkeypatch):
    from locusflow.plans import cohort
    from locusflow.plans import derived as v

    monkeypatch.setattr(pca, "MAX_SAMPLES", 20)
    monkeypatch.setattr(cohort, "LD_SAMPLES", 16, raising=False)
    cells = v.dosages(spark, sf).toPandas()
    x = cells.pivot(index="sample", columns="marker", values="dose").astype(float)
    assert len(x) > 40
    r2 = x.corr() ** 2
    want = {(a, b): r2.loc[a, b] for a in x for b in x if 0 < b - a < cohort.LD_WINDOW and r2.loc[a, b] > cohort.LD_LEAST}
    got = {(r["a"], r["b"]): r["r2"] for r in cohort.ld_pairs(spark, sf).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-7 for k in want)
    maf = {r["marker"]: r["maf"] for r in qc.maf_filter(v.dosages(spark, sf), 0.05).collect()}
    close = [(a, b) for a in x for b in x if a in maf and b in maf and 0 < b - a < cohort.LD_WINDOW and r2.loc[a, b] > 0.01]
    kept = [r["marker"] for r in cohort.ld_prune(spark, sf).collect()]
    assert sorted(kept) == ld.prune_order(sorted(maf), maf, close)


def test_components_of_more_samples_than_a_matrix_of_samples_takes(spark, sf, monkeypatch):
    from locusflow.plans import cohort
    from locusflow.plans import derived as v

    monkeypatch.setattr(pca, "MAX_SAMPLES", 20)
    x = v.dosages(spark, sf).toPandas().pivot(index="sample", columns="marker", values="dose").astype(float)
    z = np.nan_to_num(((x - x.mean()) / np.sqrt(x.mean() * (1 - x.mean() / 2))).to_numpy())
    values, vectors = np.linalg.eigh(z @ z.T / z.shape[1])
    got = {r["sample"]: r["pc"] for r in cohort.pca_components(spark, sf).collect()}
    assert list(x.index) == sorted(got) and len(got) > 40
    mine = np.array([got[s] for s in x.index])
    want = vectors[:, ::-1][:, :4]
    want = want * np.sign(want[np.abs(want).argmax(0), range(4)])
    assert np.abs(mine - want).max() < 1e-8


def test_residuals_of_more_samples_than_a_matrix_of_samples_takes(spark, sf, monkeypatch):
    from locusflow.plans import cohort
    from locusflow.plans import derived as v

    monkeypatch.setattr(pca, "MAX_SAMPLES", 20)
    x = v.dosages(spark, sf).toPandas().pivot(index="sample", columns="marker", values="dose").astype(float)
    z = np.nan_to_num(((x - x.mean()) / np.sqrt(x.mean() * (1 - x.mean() / 2))).to_numpy())
    values = np.linalg.eigvalsh(z @ z.T / z.shape[1])
    report = cohort.pca_residual(spark, sf).orderBy("pc").collect()
    assert [r["eigenvalue"] for r in report] == pytest.approx(values[::-1][:4]) and all(r["passed"] and r["residual"] < 1e-9 for r in report)
    packed = v.packed_samples(spark, sf, 64, 40)
    assert {r["part"] for r in packed.collect()} == {0, 1} and {len(r["data"]) for r in packed.collect()} == {40}
    found = pca.components_by_marker(v.packed_samples(spark, sf, 64, 64), 3)
    found.values = found.values * 1.01
    with pytest.raises(ValueError):
        pca.check_components(found, pca.residuals_of_samples(found))


def packed_doses(spark, x, width):
    """Packed rows of an array of dosages (3: missing) whose row i is sample 3i + 1."""
    parts = [(3 * i + 1, k, bytes((row[k * width : (k + 1) * width] + 48).astype(np.uint8))) for i, row in enumerate(x) for k in range(x.shape[1] // width)]
    return spark.createDataFrame(parts, "sample long, part int, data binary")


def test_tiles_of_words_keep_ties_with_the_threshold_and_travel_little(spark):
    rng = np.random.default_rng(3)
    x = rng.choice(4, (90, 128), p=[0.25, 0.4, 0.25, 0.1])
    x[50:60] = x[0]
    m = [k.astype(float) for k in kin.king_matrices(x, x)]
    phi = kin.kinship(*m[:4])
    least = sorted(phi[np.triu_indices(90, 1)])[3000]  # a value that occurs
    want = {(3 * i + 1, 3 * j + 1): (int(m[4][i, j]), phi[i, j]) for i in range(90) for j in range(i + 1, 90) if phi[i, j] >= least}
    for width, block in ((128, 16), (128, None), (64, 16)):
        got = kin.king_of_packed(packed_doses(spark, x, width), float(least), block)
        assert {(r["a"], r["b"]): (r["nsnp"], r["kinship"]) for r in got.collect()} == want
    few = kin.king_of_packed(packed_doses(spark, x[:, :64], 64), 0.05, 16, 9).collect()
    n = [k.astype(float) for k in kin.king_matrices(x[:, :64], x[:, :64])]
    assert {(r["a"], r["b"]): r["kinship"] for r in few} == {(3 * i + 1, 3 * j + 1): round(p, 9) for i in range(90) for j in range(i + 1, 90) if (p := float(kin.kinship(*n[:4])[i, j])) >= 0.05}
    # 615,384 samples of 64 markers: a sample travels 64 times, not once for each 512 samples.
    assert kin._blocks((615_384, True, 64), None) <= 64


def test_pairs_leave_in_runs_that_take_little_room_in_files(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.choice(4, (2500, 64), p=[0.24, 0.5, 0.24, 0.02])
    packed = packed_doses(spark, x, 64).repartition(4)
    pairs = kin.king_of_packed(packed, 0.0884, 1250, 9)
    pairs.write.parquet(f"{tmp_path}/pairs")
    n = runs = falls = 0
    for _, part in pairs.withColumn("p", F.spark_partition_id()).toPandas().groupby("p", sort=False):
        a, phi = part["a"].to_numpy(), part["kinship"].to_numpy()
        same = a[1:] == a[:-1]
        n, runs, falls = n + len(a), runs + 1 + (~same).sum(), falls + (same & (phi[1:] < phi[:-1])).sum()
    # A sample is the smaller one in a run for each tile of its block at most, and kinship goes up in a run.
    assert n > 500_000 and runs <= 2500 * 2 and not falls
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 3.1 * n
    want = {(r["a"], r["b"]): (r["nsnp"], r["kinship"]) for r in kin.king_of_packed(packed, 0.0884, 700, 9).collect()}
    assert len(want) == n and {(r["a"], r["b"]): (r["nsnp"], r["kinship"]) for r in spark.read.parquet(f"{tmp_path}/pairs").collect()} == want
    # Blocks are as few as a task's work and the cores allow.
    assert kin._blocks((51_282, True, 64), None, 8) == 12 and kin._blocks((615_384, True, 64), None, 12) == 54


@pytest.mark.parametrize("width", [64, 32])
def test_related_samples_are_decided_without_the_pairs_of_those_that_went(spark, monkeypatch, width):
    rng = np.random.default_rng(4)
    x = rng.choice(4, (300, 64), p=[0.25, 0.4, 0.25, 0.1])
    x[20:280:2] = x[7]
    packed = packed_doses(spark, x, width)
    pairs = kin.king_of_packed(packed, 0.15)
    want = kin.exclusions_in_order([(r["a"], r["b"]) for r in pairs.collect()])
    made, between = [], kin.king_between
    monkeypatch.setattr(kin, "related_exclusions", lambda p, f=kin.related_exclusions: made.append(p.count()) or f(p))
    monkeypatch.setattr(kin, "king_between", lambda *a: made.append((p := between(*a)).count()) or p)
    got = {r["sample"]: r["reason"] for r in kin.related_samples(packed, 0.15, 32, 64).collect()}
    assert got == want and len(want) > 130 and len(made) > 4
    assert sum(made) < pairs.count() / 4
