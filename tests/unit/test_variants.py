import gzip
import random
import re
import struct

import pytest
from fixtures import ALL, COHORT, HEAD, bcf, bgzf, gz, vcf, write
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators import mask, normalize, stats
from locusflow.operators.sets import GateError
from locusflow.plans.genotypes import synthetic_totals
from locusflow.sources import files
from locusflow.sources.bcf_sink import write_bcf, write_index
from locusflow.sources.bgzf import Index, byte_ranges, parse_region, union_bytes
from locusflow.sources.files import FormatError
from locusflow.sources.tables import as_text, read_metadata
from locusflow.sources.vcf import VcfReader, read_header, read_variants, require_format, write_vcf

SAMPLES = ["S1", "S2", "S3", "S4"]
META = "﻿sample\tpopulation\tnote\r\nS4\tB\tx\r\nS2\tA\t\r\nS1\tA\ty\r\nS3\tB\tz\r\n"


@pytest.fixture
def cohort(tmp_path):
    return write(tmp_path / "cohort.vcf", vcf(COHORT, SAMPLES))


def tables(spark, path, meta, min_dp=0, min_gq=0):
    records, samples, _ = read_variants(spark, path)
    sites = records.withColumn("skip_reason", g.skip_reason(F.col("contig"), F.col("ref"), F.col("alts"), F.col("filters")))
    eligible = sites.where("skip_reason IS NULL")
    calls = stats.explode_calls(eligible, samples)
    calls = calls.withColumn("category", g.category(F.col("alleles"), F.col("dp"), F.col("gq"), min_dp, min_gq))
    people = read_metadata(spark, meta, samples).select("sample", "population")
    keys = eligible.select("rec", "contig", "pos")
    by_site = stats.population_site_stats(calls, people, keys)
    return {
        "totals": stats.record_totals(sites),
        "samples": stats.sample_stats(calls, people, eligible.count()).orderBy("sample"),
        "sites": stats.site_stats(calls, keys).orderBy("rec"),
        "by_site": by_site,
        "populations": stats.population_stats(by_site).orderBy("population"),
    }


def text(df):
    return ["\t".join(r) for r in as_text(df).collect()]


def test_golden_tables(spark, tmp_path, cohort):
    out = tables(spark, cohort, write(tmp_path / "m.tsv", META))
    assert tuple(out["totals"].first()) == (9, 5, 1, 2, 1)
    assert text(out["samples"]) == ["S1\tA\t4\t2\t2\t1\t0\t0\t0.5\t0.8", "S2\tA\t3\t1\t1\t2\t0\t0\t0.333333333333\t0.6", "S3\tB\t3\t0\t2\t1\t0\t1\t0\t0.6", "S4\tB\t2\t0\t2\t2\t0\t1\t0\t0.4"]
    assert text(out["populations"]) == ["A\t7\t3\t3\t3\t0\t0\t0.428571428571\t4\t0.3125", "B\t5\t0\t4\t3\t0\t2\t0\t3\t0.166666666667"]
    sites = text(out["sites"])
    assert sites[0].split("\t")[9] == "0.333333333333" and sites[0].split("\t")[11] == "0.5"
    assert sites[2].split("\t")[3] == "0" and sites[2].split("\t")[10] == "NA"
    assert out["by_site"].count() == 10


def test_thresholds(spark, tmp_path, cohort):
    rows = {r["sample"]: r for r in tables(spark, cohort, write(tmp_path / "m.tsv", META), 10, 20)["samples"].collect()}
    assert (rows["S1"]["called"], rows["S1"]["quality_filtered"]) == (2, 2)
    assert (rows["S3"]["called"], rows["S3"]["quality_filtered"]) == (2, 1)


def test_formats_and_parts_agree(spark, tmp_path, cohort):
    body = vcf(COHORT, SAMPLES)
    want = read_variants(spark, cohort)[0].drop("rec").collect()
    for name, data in (("a.vcf.gz", gz(body)), ("b.vcf.gz", bgzf(body.encode())), ("c.bcf", bcf(body))):
        got, samples, header = read_variants(spark, write(tmp_path / name, data))
        assert got.orderBy("rec").drop("rec").collect() == want, name
        assert [r["sample"] for r in samples.orderBy("idx").collect()] == SAMPLES == header.samples
    parts = read_variants(spark, cohort, split=90)[0]
    assert parts.rdd.getNumPartitions() > 5
    assert parts.orderBy("rec").drop("rec").collect() == want


def test_written_text_reads_back(spark, tmp_path, cohort):
    records, _, header = read_variants(spark, cohort)
    write_vcf(records, header, str(tmp_path / "out"))
    parts = sorted((tmp_path / "out").glob("part-*"))
    whole = "".join(p.read_text() for p in parts[:1]) + "".join("".join(x for x in p.read_text().splitlines(True) if not x.startswith("#")) for p in parts[1:])
    again = read_variants(spark, write(tmp_path / "again.vcf", whole))[0]
    columns = ["contig", "pos", "id", "ref", "alts", "filters", "info"]
    order = ["contig_rank", "pos"]
    assert again.select(*columns).collect() == records.orderBy(*order).select(*columns).collect()
    calls = lambda df: [[(c["gt"], c["dp"], c["gq"]) for c in r["calls"]] for r in df.orderBy(*order).collect()]
    assert calls(again) == calls(records)


@pytest.mark.parametrize(
    "data",
    [
        "",
        "not a vcf\n",
        vcf(COHORT, ["S1", "S1", "S3", "S4"]),
        vcf([], []),
        vcf(COHORT, SAMPLES).rstrip("\n").rsplit("\t", 1)[0],
        vcf([(*COHORT[0][:7], "0/x:1:1 0/0 0/0 0/0")], SAMPLES),
        bcf(vcf(COHORT, SAMPLES))[:-28],
        gz(vcf(COHORT, SAMPLES))[:-40],
    ],
)
def test_bad_files_are_refused(spark, tmp_path, data):
    path = write(tmp_path / "bad.vcf", data)
    with pytest.raises(Exception, match="(?s)bad.vcf|truncated|columns|invalid literal|twice|no samples|empty file"):
        read_variants(spark, path)[0].count()


def test_declarations(tmp_path):
    head = HEAD.replace("ID=GQ,Number=1,Type=Integer", "ID=GQ,Number=1,Type=Float")
    h = read_header(write(tmp_path / "a.vcf", vcf(COHORT, SAMPLES, head)))
    require_format(h, "DP", "1", "Integer")
    require_format(h, "XX", "1", "Integer")
    with pytest.raises(FormatError):
        require_format(h, "GQ", "1", "Integer")


@pytest.mark.parametrize("meta", [META + "S1\tA\tq\r\n", META.replace("S4\tB", "S5\tB"), META.replace("S3\tB", "S3\t"), META.replace("population", "sample"), META.replace("population", "pop"), META + "S9\tA\r\n"])
def test_bad_metadata_is_refused(spark, tmp_path, cohort, meta):
    samples = read_variants(spark, cohort)[1]
    with pytest.raises(GateError):
        read_metadata(spark, write(tmp_path / "m.tsv", meta), samples)


# ---- masking

MATRIX = [
    ("1", 10, "a", "A", "G", "PASS", ALL, "0|1:10:20 1|0:30:99"),
    ("1", 20, "b", "A", "G", "PASS", ALL, "0/1:9:50 0/1:50:19"),
    ("1", 30, "c", "A", "G", "PASS", ALL, "0/1:.:50 0/1:50:."),
    ("1", 40, "d", "A", "G", "PASS", ALL, "1:20:50 0/0/1:20:50"),
    ("1", 50, "e", "A", "G", "PASS", ALL, "0/.:20:50 ./.:20:50"),
]


def masked(spark, path, dp, gq):
    records, samples, _ = read_variants(spark, path)
    mask.check_masking(records, dp, gq)
    return records, samples, mask.mask_variants(records, dp, gq)


def test_mask_matrix(spark, tmp_path):
    path = write(tmp_path / "m.vcf", vcf(MATRIX, ["A", "B"]))
    records, samples, out = masked(spark, path, 10, 20)
    rows = out.orderBy("rec").collect()
    assert [(c["gt"], c["phased"]) for c in rows[0]["calls"]] == [([0, 1], True), ([1, 0], True)]
    assert all(c["gt"] == [None, None] and not c["phased"] for r in rows[1:] for c in r["calls"])
    assert all("AC" not in r["info"] for r in rows) and any("DB" in r["info"] for r in rows)
    calls = stats.explode_calls(records, samples).withColumn("category", g.category(F.col("alleles"), F.col("dp"), F.col("gq"), 10, 20))
    report = {r["sample"]: r for r in mask.mask_report(calls).collect()}
    assert tuple(report[None])[1:] == (2, 2, 4, 2, 8)
    assert report["A"]["masked"] == report["B"]["masked"] == 4
    _, _, same = masked(spark, path, 0, 0)
    assert [[c["dp"] for c in r["calls"]] for r in same.orderBy("rec").collect()][1] == [9, 50]


@pytest.mark.parametrize(
    "records, message",
    [
        ([MATRIX[1], MATRIX[0]], "sorted"),
        ([(*MATRIX[0][:7], "0/1:-1:5 0/1:5:5")], "DP"),
        ([(*MATRIX[0][:7], "0/1:1:-5 0/1:5:5")], "GQ"),
        ([(*MATRIX[0][:7], "0/8:1:5 0/1:5:5")], "allele"),
    ],
)
def test_mask_gates(spark, tmp_path, records, message):
    with pytest.raises(mask.MaskError, match=message):
        masked(spark, write(tmp_path / "m.vcf", vcf(records, ["A", "B"])), 1, 1)


# ---- functions and normalisation


def column(spark, values, kind, f):
    return [r[0] for r in spark.createDataFrame([(v,) for v in values], f"x {kind}").select(f(F.col("x"))).collect()]


def test_functions(spark):
    assert column(spark, ["1", "chr22", "chr01", "CHR1", "01", "1_random", "23", "X"], "string", g.is_autosome) == [True, True, False, False, False, False, False, False]
    assert column(spark, [0.0, 1 / 3, 2.0, 1e-7 / 3, 123456789012345.0, None, 0.25], "double", g.number_text) == ["0", "0.333333333333", "2", "3.33333333333e-08", "1.23456789012e+14", "NA", "0.25"]
    assert column(spark, ["1/0", "0|1", "./."], "string", g.unphased) == ["0/1", "0/1", "./."]
    assert column(spark, ["ACGTN"], "string", g.reverse_complement) == ["NACGT"]
    flags = [2, 2 | 4, 2 | 256, 2 | 512, 2 | 1024, 2 | 2048, 1, 99]
    assert column(spark, flags, "int", g.usable_alignment) == [True] + [False] * 6 + [True]
    assert column(spark, ["!I5"], "string", g.qualities) == [[0, 40, 20]]


def test_synthetic_calls(spark):
    total = synthetic_totals(spark, 1000, 1000).groupBy().sum("called", "missing", "heterozygous", "alt_alleles").first()
    assert tuple(total) == (990_028, 9_972, 349_929, 649_581)


def test_split_and_reference(spark, tmp_path, cohort):
    records, _, _ = read_variants(spark, cohort)
    out = normalize.split_alleles(records.where("id = 'multi'")).orderBy("allele").collect()
    assert [(r["alt"], [c["gt"] for c in r["calls"]]) for r in out] == [("C", [[0, 1], [0, None], [1, None], [0, 0]]), ("G", [[0, None], [0, 1], [None, 1], [0, 0]])]
    bases = "ACGTACGTAC" * 10
    chunks = spark.createDataFrame([("1", i, bases[i * 7 : i * 7 + 7]) for i in range(15)], "contig string, chunk long, bases string")
    sites = [(0, "1", 1, "A"), (1, "1", 6, "CGTACACGTA"[:5]), (2, "1", 2, "T"), (3, "1", 99, "AC"), (4, "1", 100, "CA"), (5, "2", 1, "A"), (6, "1", 3, "GTACGTACACGTAC")]
    bad = normalize.reference_mismatches(spark.createDataFrame(sites, "rec long, contig string, pos long, ref string"), chunks, 7)
    assert sorted(r["rec"] for r in bad.collect()) == [i for i, c, p, r in sites if c != "1" or bases[p - 1 : p - 1 + len(r)] != r]


def leftmost(pos, ref, alt, bases):
    """The textbook way, one base at a time: cut the last base while it is shared, take in the one before if nothing is left."""
    while ref != alt and ref and alt and ref[-1] == alt[-1]:
        if len(ref) > 1 and len(alt) > 1:
            ref, alt = ref[:-1], alt[:-1]
        elif pos > 1:
            pos, ref, alt = pos - 1, bases[pos - 2] + ref[:-1], bases[pos - 2] + alt[:-1]
        else:
            break
    while len(ref) > 1 and len(alt) > 1 and ref[0] == alt[0]:
        pos, ref, alt = pos + 1, ref[1:], alt[1:]
    return pos, ref, alt


def chunked(spark, contigs, size):
    rows = [(c, i, bases[i * size : (i + 1) * size]) for c, bases in contigs.items() for i in range(-(-len(bases) // size))]
    return spark.createDataFrame(rows, "contig string, chunk long, bases string")


@pytest.mark.parametrize("size, broadcast, rounds", [(7, 0, 2), (7, 10**6, 16), (1000, 10**6, 16)])
def test_indels_move_as_far_as_the_bases_allow(spark, monkeypatch, size, broadcast, rounds):
    """Repeats much longer than a chunk, up to a contig's first base, unknown bases, shared ends of any kind."""
    rng = random.Random(9)
    monkeypatch.setattr(normalize, "BROADCAST_INDELS", broadcast)
    monkeypatch.setattr(normalize, "ROUNDS", rounds)
    unit = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    contigs = {"1": "A" * 45 + unit(30) + "CAG" * 20 + unit(20) + "T" * 60 + "GT", "2": unit(15) + "N" + "AC" * 30 + unit(20) + unit(5) * 9, "X": "GATGATGATGAT" + unit(9)}
    rows = []
    for k in range(160):
        contig = rng.choice(list(contigs))
        bases = contigs[contig]
        pos, n = rng.randrange(1, len(bases) - 8), rng.randrange(1, 8)
        ref = bases[pos - 1 : pos - 1 + n]
        kind = k % 4
        if kind == 0:  # a deletion, anchored before or behind
            ref = bases[pos - 1 : pos + n]
            alt = ref[0] if k % 8 else ref[-1]
        elif kind == 1:  # an insertion of what stands there
            ref = bases[pos - 1]
            alt = ref + bases[max(0, pos - n) : pos]
        elif kind == 2:  # another copy of a unit, with shared ends
            ref, alt = bases[pos - 1 : pos + n], bases[pos - 1 : pos + n] + bases[pos : pos + n]
        else:
            alt = unit(rng.randrange(1, 6))
        rows.append((k, k % 3, contig, pos, ref, alt))
    rows += [(200, 1, "1", 45, "A", "<DEL>"), (201, 1, "1", 44, "AA", "*"), (202, 1, "1", 3, "aa", "A"), (203, 1, "1", 30, "A", "A"), (204, 1, "2", 60, "CAC", "TGT")]
    out = normalize.left_aligned(spark.createDataFrame(rows, "rec long, allele int, contig string, pos long, ref string, alt string"), chunked(spark, contigs, size), size)
    got = {(r["rec"], r["allele"]): (r["pos"], r["ref"].upper(), r["alt"].upper()) for r in out.collect()}
    symbols = {200, 201}
    want = {(k, a): (p, r, x) if k in symbols else leftmost(p, r.upper(), x.upper(), contigs[c]) for k, a, c, p, r, x in rows}
    assert got == want
    assert got[(202, 1)] == (1, "AA", "A") and sum(want[(k, a)][0] < p - 2 * 7 for k, a, c, p, r, x in rows if k < 200) > 10


def test_normalized_records(spark, tmp_path):
    """Alleles apart with their own values, indels in their place in the new order, and the two gates."""
    bases = "TT" + "CA" * 40 + "GGGG" + "ACGT" * 5
    head = HEAD + '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="by allele">\n##FORMAT=<ID=PL,Number=G,Type=Integer,Description="by genotype">\n##INFO=<ID=AF,Number=A,Type=Float,Description="f">\n'
    text = vcf([("1", 10, "a", bases[9], "G" if bases[9] != "G" else "T", "PASS", "GT", "0/1 1/1"), ("1", 80, "m", "ACA", "A,ACACA", "PASS", "GT:DP:AD:PL", "1/2:9:1,2,3:10,11,12,13,14,15 0/2:8:4,5,6:0,1,2"), ("1", 82, "s", "A", "C", "PASS", "GT", "./. 0|1")], ["S1", "S2"], head)
    text = text.replace("AC=1;DB", "AF=0.25,0.5;DB")
    path = write(tmp_path / "n.vcf", text)
    records, _, header = read_variants(spark, path)
    out = normalize.normalized(records, header, chunked(spark, {"1": bases}, 16), 16).orderBy("rec").collect()
    calls = lambda r: [(c["gt"], c["dp"], c["rest"]) for c in r["calls"]]
    assert [(r["pos"], r["ref"], r["alts"], r["id"]) for r in out] == [(2, "TCA", ["T"], "m"), (2, "T", ["TCA"], "m"), (10, "A", ["G"], "a"), (82, "A", ["C"], "s")]
    assert calls(out[0]) == [([1, None], 9, "1,2:10,11,12"), ([0, None], 8, "4,5:0,1")]
    assert calls(out[1]) == [([None, 1], 9, "1,3:10,13,15"), ([0, 1], 8, "4,6:0,2")]
    assert [r["info"] for r in out[:2]] == [{"AF": "0.25", "DB": ""}, {"AF": "0.5", "DB": ""}]
    assert [c["phased"] for c in out[3]["calls"]] == [False, True]
    with pytest.raises(GateError, match="1:80: ACA isn't"):
        normalize.normalized(records, header, chunked(spark, {"1": bases[:80] + "T" * 30}, 16), 16)
    with pytest.raises(GateError, match="sorted"):
        normalize.normalized(records.withColumn("pos", 100 - F.col("pos")), header, chunked(spark, {"1": bases}, 16), 16)


def many(n=400, samples=6):
    rng = random.Random(5)
    calls = lambda: " ".join(f"{rng.choice(['0/0', '0/1', '1|1', './.', '0', '0/2'])}:{rng.choice(['.', '7', '300'])}:{rng.randrange(99)}:{rng.choice(['a', 'b,c'])}" for _ in range(samples))
    return [(rng.choice(["1", "1", "chr2"]) if k > 200 else "1", 100 + 10 * k, f"rs{k}", "A", rng.choice(["C", "C,T"]), "PASS", "GT:DP:GQ:XX", calls()) for k in range(n)]


EXTRA = HEAD + '##FORMAT=<ID=XX,Number=.,Type=String,Description="other">\n'


def small_blocks(data, size):
    """BGZF with blocks of so many bytes."""
    return b"".join(bgzf(data[at : at + size])[: -len(files.BGZF_END)] for at in range(0, len(data), size)) + files.BGZF_END


@pytest.mark.parametrize("block", [37, 400, 5000])
def test_blocks_are_read_in_parts(spark, tmp_path, block):
    names = [f"N{i}" for i in range(6)]
    text = vcf(many(), names, EXTRA)
    want = sorted(map(str, read_variants(spark, write(tmp_path / "a.vcf", text))[0].drop("rec").collect()))
    assert "b,c" in want[0]
    plain = [r for r in many()]
    path = write(tmp_path / "a.vcf.gz", small_blocks(text.encode(), block))
    for split in (300, 1111, 3001):
        reader = VcfReader({"path": path, "split": str(split)})
        batches = [b for p in reader.partitions() for b in reader.read(p)]
        assert len(reader.partitions()) > 1
        recs = [x for b in batches for x in b.column(0).to_pylist()]
        assert len(recs) == len(plain) and recs == sorted(recs) and len(set(recs)) == len(recs)
        assert [x for b in batches for x in b.column(4).to_pylist()] == [r[2] for r in plain]
    assert sorted(map(str, read_variants(spark, path, split=3000)[0].drop("rec").collect())) == want


@pytest.mark.parametrize("block", [37, 400, 5000])
def test_binary_records_are_found_from_any_block(spark, tmp_path, block):
    names = [f"N{i}" for i in range(6)]
    rows = [(*r[:6], "GT:DP:GQ", " ".join(c.rpartition(":")[0] for c in r[7].split(" "))) for r in many()]
    text = vcf(rows, names)
    import gzip

    raw = gzip.decompress(bcf(text))
    path = write(tmp_path / "a.bcf", small_blocks(raw, block))
    want = sorted(map(str, read_variants(spark, write(tmp_path / "a.vcf", text))[0].drop("rec", "contig_rank").collect()))
    for split in (300, 1111, 3001):
        assert sorted(map(str, read_variants(spark, path, split=split)[0].drop("rec", "contig_rank").collect())) == want
    reader = VcfReader({"path": path, "split": "500"})
    recs = [x for p in reader.partitions() for b in reader.read(p) for x in b.column(0).to_pylist()]
    assert len(recs) == len(rows) and recs == sorted(recs)


def test_regions(spark, tmp_path):
    names = [f"N{i}" for i in range(6)]
    path = write(tmp_path / "a.vcf.gz", small_blocks(vcf(many(), names, EXTRA).encode(), 400))
    got = read_variants(spark, path, regions="1:500-700;chr2", split=2000)[0]
    ids = {r["id"] for r in got.collect()}
    assert ids == {r[2] for r in many() if r[0] == "chr2" or r[0] == "1" and 500 <= r[1] <= 700}


def tabix(chunks):
    """A tabix index with one contig and the given (bin, begin, end)."""
    names = b"1\0"
    out = b"TBI\1" + struct.pack("<8i", 1, 2, 1, 2, 0, 35, 0, len(names)) + names + struct.pack("<i", len(chunks))
    for number, a, b in chunks:
        out += struct.pack("<IiQQ", number, 1, a, b)
    return bgzf(out + struct.pack("<iQ", 1, 0))


def test_an_index_says_what_to_read(spark, tmp_path):
    rows = [("1", 100 + 40_000 * k, f"rs{k}", "A", "C", "PASS", "GT", "0/1 0/0") for k in range(8)]
    path = write(tmp_path / "a.vcf.gz", small_blocks(vcf(rows, ["A", "B"]).encode(), 50))
    at = [r["rec"] for r in read_variants(spark, path)[0].orderBy("rec").collect()] + [1 << 62]
    leaf = lambda pos: 4681 + (pos >> 14)
    index = write(tmp_path / "a.vcf.gz.tbi", tabix([(leaf(r[1] - 1), at[k], at[k + 1]) for k, r in enumerate(rows)]))
    got = read_variants(spark, path, regions="1:80000-130000", index=index)[0].collect()
    assert [r["id"] for r in got] == ["rs2", "rs3"]
    ranges = byte_ranges(Index(index), "1:80000-130000")
    assert ranges == [{"start": at[2] >> 16, "end": (at[4] >> 16) + 65535}]
    with pytest.raises(FormatError):
        byte_ranges(Index(index), "2")
    assert union_bytes(ranges, 10**6, 100) == [{"start": 0, "end": 99}, {"start": ranges[0]["start"], "end": ranges[0]["end"]}, {"start": 10**6 - 28, "end": 10**6 - 1}]


def test_other_fields_survive_masking_and_writing(spark, tmp_path):
    names = [f"N{i}" for i in range(6)]
    rows = [(*r[:4], "C", *r[5:7], r[7].replace("0/2", "0/1")) for r in many(30)]
    records, _, header = read_variants(spark, write(tmp_path / "a.vcf", vcf(rows, names, EXTRA)))
    write_vcf(mask.mask_variants(records, 5, 10), header, str(tmp_path / "out"))
    text = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part-*")))
    lines = [x.split("\t") for x in text.split("\n") if x and not x.startswith("#")]
    assert len(lines) == 30
    for want, got in zip(rows, lines, strict=True):
        assert got[8] == "GT:DP:GQ:XX"
        assert [c.split(":")[1:] for c in got[9:]] == [c.split(":")[1:] for c in want[7].split(" ")]


def test_records_written_as_bcf_come_back(spark, tmp_path):
    head = EXTRA + '##FORMAT=<ID=AD,Number=R,Type=Integer,Description="depths">\n##FORMAT=<ID=PL,Number=G,Type=Float,Description="x">\n##INFO=<ID=AF,Number=A,Type=Float,Description="f">\n'
    rng = random.Random(2)
    call = lambda: f"{rng.choice(['0/0', '0|1', '.', '1', './1', '0/1/2', '12/3'])}:{rng.choice(['.', '7', '40000'])}:{rng.choice(['3,4', '.', '1,.', '70000'])}:{rng.choice(['a', 'b,c', '.'])}:{rng.choice(['0.5', '1,2.5', '.'])}"
    rows = [(rng.choice(["1", "chr2"]), rng.randrange(1, 10**6), "." if k % 3 == 0 else f"rs{k}", "A" * (k % 20 + 1), "C,G" if k % 2 else ".", rng.choice(["PASS", ".", "q10"]), "GT:DP:AD:XX:PL" if k % 5 else "GT", " ".join(call() if k % 5 else "0/1" for _ in range(4))) for k in range(120)]
    rows.sort(key=lambda r: (r[0] != "1", r[1]))
    source = write(tmp_path / "a.vcf", vcf(rows, SAMPLES, head))
    records, _, header = read_variants(spark, source)
    assert write_bcf(records, header, str(tmp_path / "a.bcf")) == 120
    again, samples, got = read_variants(spark, str(tmp_path / "a.bcf"), split=900)
    assert got.samples == SAMPLES
    keep = lambda d: [(r["contig"], r["pos"], r["id"], r["ref"], r["alts"], r["qual"], r["filters"], dict(r["info"]), r["format"], [(c["gt"], c["phased"], c["dp"], c["gq"], c["rest"]) for c in r["calls"]]) for r in d.orderBy("rec").collect()]
    assert keep(again) == keep(records)
    masked = mask.mask_variants(records.withColumn("rec", F.col("rec")), 0, 0)
    assert write_bcf(masked, header, str(tmp_path / "m.bcf")) == masked.count()
    assert write_bcf(records.where("false"), header, str(tmp_path / "none.bcf")) == 0
    assert read_variants(spark, str(tmp_path / "none.bcf"))[0].count() == 0


def test_a_written_index_leads_to_its_records(spark, tmp_path):
    rng = random.Random(3)
    rows = [(c, p, f"{c}.{p}", "A" * rng.choice([1, 1, 1, 40_000 if p < 10**6 else 3]), "C", "PASS", "GT", "0/1 0/0") for c in ("1", "chr2") for p in sorted(rng.sample(range(1, 2_000_000), 150))]
    records, _, header = read_variants(spark, write(tmp_path / "a.vcf", vcf(rows, ["A", "B"])))
    path = str(tmp_path / "a.bcf")
    assert write_bcf(records, header, path) == 300
    index = write_index(spark, path)
    for region in ("1:1-100000", "chr2:500000-700000", "1", "chr2:1999990", "1:999000-1001000;chr2:1-20000"):
        want = sorted(r[2] for r in rows for x in region.split(";") for c, b, e in [parse_region(x)] if r[0] == c and r[1] - 1 < e and r[1] - 1 + len(r[3]) > b)
        assert sorted(r["id"] for r in read_variants(spark, path, regions=region, index=index)[0].collect()) == want
    # A small region reads less than the file.
    some = Index(index).chunks(0, 1_500_000, 1_500_100)
    assert sum((b >> 16) - (a >> 16) for a, b in some) < 0.9 * files.size_of(path)


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    """A BCF and a bgzipped VCF of 3 contigs in small blocks, the BCF with its index beside it."""
    folder = tmp_path_factory.mktemp("indexed")
    rng = random.Random(8)
    rows = [(c, 50 + 400 * k, f"rs{k}", "A", "C", "PASS", "GT:DP:GQ", " ".join(f"{rng.choice(['0/0', '0/1', '1|1', './.'])}:{rng.randrange(60)}:{rng.randrange(99)}" for _ in range(4))) for c in ("1", "chr2", "X") for k in range(400)]
    text = vcf(rows, SAMPLES)
    return rows, write(folder / "a.vcf.gz", small_blocks(text.encode(), 3000)), _indexed_bcf(spark, folder, text)


def _indexed_bcf(spark, folder, text):
    path = write(folder / "a.bcf", small_blocks(gzip.decompress(bcf(text)), 3000))
    write_index(spark, path)
    return path


CONDITIONS = [
    ("contig = 'chr2' AND pos BETWEEN 40000 AND 60000", True), ("contig IN ('1', 'X') AND pos > 100 AND pos < 900 AND pos >= 450", True), ("pos = 50", True), ("contig = 'X' AND contig = '1'", True), ("contig = 'none'", True),
    ("contig = 'chr2' AND pos IN (450, 850, 851)", False), ("contig = '1' OR pos = 50", False), ("contig = '1' AND id LIKE 'rs1%'", False), ("contig LIKE 'chr%' AND pos <= 2000", False), ("contig <> '1' AND 1000 > pos", False),
]


@pytest.mark.parametrize("condition, whole", CONDITIONS)
def test_conditions_on_places_are_pushed(spark, indexed, condition, whole):
    rows, text, binary = indexed
    every = spark.createDataFrame([(r[0], r[1], r[2]) for r in rows], "contig string, pos long, id string")
    want = sorted(map(tuple, every.where(condition).collect()))
    for path in (text, binary):
        found = read_variants(spark, path)[0].where(condition).select("contig", "pos", "id")
        assert sorted(map(tuple, found.collect())) == want
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert (re.search(r"\bFilter\b", plan) is None) == whole


def test_pushed_conditions_read_few_blocks(indexed, monkeypatch):
    """What Spark hands to the reader leads to the chunks of the index: counted in the blocks that are unpacked."""
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, LessThan

    from locusflow.sources import bgzf

    rows, _, path = indexed
    seen = set()
    real = bgzf.blocks
    monkeypatch.setattr(bgzf, "blocks", lambda p, begin=0: (seen.add(x[0]) or x for x in real(p, begin)))

    def read(*filters):
        seen.clear()
        reader = VcfReader({"path": path})
        assert list(reader.pushFilters(list(filters))) == []
        found = [(x["contig"], x["pos"]) for part in reader.partitions() for b in reader.read(part) for x in b.select(["contig", "pos"]).to_pylist()]
        return sorted(found), len(seen)

    every, all_blocks = read()
    assert len(every) == len(rows)
    some, few = read(EqualTo(("contig",), "chr2"), GreaterThanOrEqual(("pos",), 100_000), LessThan(("pos",), 110_000))
    assert some == [x for x in every if x[0] == "chr2" and 100_000 <= x[1] < 110_000] and some
    assert few < all_blocks / 4
    assert read(EqualTo(("contig",), "chr2"), EqualTo(("contig",), "X"))[0] == []


def test_only_the_samples_asked_for_are_decoded(spark, indexed):
    _, text, binary = indexed
    for path in (text, binary):
        whole = {r["rec"]: r["calls"] for r in read_variants(spark, path)[0].collect()}
        records, people, header = read_variants(spark, path, ["S3", "S1"])
        assert header.samples == ["S3", "S1"] and [tuple(r) for r in people.orderBy("idx").collect()] == [(0, "S3"), (1, "S1")]
        assert {r["rec"]: r["calls"] for r in records.collect()} == {k: [c[2], c[0]] for k, c in whole.items()}
        packed = {r["rec"]: (r["codes"], r["dp"], r["gq"]) for r in read_variants(spark, path, calls="packed", qualities="dp,gq")[0].collect()}
        got = {r["rec"]: (r["codes"], r["dp"], r["gq"]) for r in read_variants(spark, path, ["S4"], calls="packed", qualities="dp,gq", split=5000)[0].collect()}
        assert len(got) == len(packed)
        assert sorted(bytes(v[0]) + bytes(v[1]) + bytes(v[2]) for v in got.values()) == sorted(bytes(v[0])[3:] + bytes(v[1])[12:] + bytes(v[2])[12:] for v in packed.values())
        for bad in (["S9"], [], ["S1", "S1"]):
            with pytest.raises(FormatError):
                read_variants(spark, path, bad)
