import gzip
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import bgzf, write
from pyspark.sql import functions as F

from locusflow.operators import placement, reads
from locusflow.operators.sets import GateError
from locusflow.sources import tables
from locusflow.sources.files import FormatError
from locusflow.sources.sequences import fastq_records, read_alignments, read_fastq_pair, read_name, read_reference

RUNS = [("A_lane1", "A", "A_lib1"), ("A_lane2", "A", "A_lib1"), ("A_library2", "A", "A_lib2"), ("B_lane1", "B", "B_lib1"), ("C_lane1", "C", "C_lib1")]
#: Alternative alleles of each sample at each position; none where a sample has no reads.
TRUTH = {1000: {"A": 0, "B": 1, "C": 2}, 2000: {"A": 1, "B": 0, "C": None}, 3000: {"A": 2, "B": 1, "C": 0}}
OTHER = {"A": "C", "C": "G", "G": "T", "T": "A"}


def complement(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def make_run(reference, run, sample):
    one, two, n = [], [], 0
    for pos, truth in TRUTH.items():
        dose = truth[sample]
        if dose is None:
            continue
        for j in range(24):
            start = pos - 110 + j
            first = list(reference[start - 1 : start + 149])
            if dose == 2 or dose == 1 and j % 2:
                first[pos - start] = OTHER[reference[pos - 1]]
            n += 1
            one.append(f"@{run}_{n}/1\n{''.join(first)}\n+\n{'I' * 150}\n")
            two.append(f"@{run}_{n}/2\n{complement(reference[start + 199 : start + 349])}\n+\n{'I' * 150}\n")
    one.append(f"@{run}_low/1\n{reference[5000:5150]}\n+\n{'!' * 150}\n")
    two.append(f"@{run}_low/2\n{complement(reference[5200:5350])}\n+\n{'!' * 150}\n")
    return "".join(one), "".join(two)


def test_from_reads_to_calls(spark, tmp_path):
    rng = random.Random(11)
    reference = "".join(rng.choice("ACGT") for _ in range(10_000))
    fasta = write(tmp_path / "ref.fa", ">1 description\n" + "".join(reference[i : i + 60] + "\n" for i in range(0, 10_000, 60)))
    size = 1000
    chunks = read_reference(spark, fasta, size).cache()
    assert chunks.where("length IS NOT NULL").select("contig", "length").collect() == [("1", 10_000)]
    everything = None
    for run, sample, _ in RUNS:
        a, b = make_run(reference, run, sample)
        pair = read_fastq_pair(spark, write(tmp_path / f"{run}_1.fastq", a), write(tmp_path / f"{run}_2.fastq", b))
        assert reads.pair_problems(pair).count() == 0
        n = 49 if sample == "C" else 73
        assert tuple(reads.pair_totals(pair).first()) == (n, n * 300, 150, 150)
        pair = pair.withColumn("run", F.lit(run))
        everything = pair if everything is None else everything.unionByName(pair)
    good = reads.passing_pairs(everything, ["run", "ordinal"]).cache()
    assert good.count() == everything.count() - 2 * len(RUNS)
    libraries = spark.createDataFrame(RUNS, "run string, sample string, library string")
    overlapping = placement.overlapping_chunks(chunks, size, 150 + placement.MARGIN).cache()
    pairs = placement.placed_pairs(good, overlapping, size).cache()
    aligned = placement.alignments(placement.with_cigars(pairs, good, overlapping, size), good, libraries).cache()
    counts = {r["library"]: (r["records"], r["mapped"], r["duplicates"], r["usable"]) for r in reads.library_counts(aligned).collect()}
    assert counts == {"A_lib1": (288, 288, 144, 144), "A_lib2": (144, 144, 0, 144), "B_lib1": (144, 144, 0, 144), "C_lib1": (96, 96, 0, 96)}
    bases = reads.pileup(aligned).cache()
    sites = reads.candidate_sites(bases, chunks, size)
    called = reads.call_genotypes(reads.genotype_likelihoods(bases, sites))
    got = {(r["pos"], r["sample"]): (r["gt"], r["dp"]) for r in called.collect()}
    want = {}
    for pos, truth in TRUTH.items():
        for sample, dose in truth.items():
            if dose is not None:
                want[pos, sample] = (("0/0", "0/1", "1/1")[dose], 48 if sample == "A" else 24)
    assert got == want
    assert all(r["gq"] >= 10 for r in called.collect())
    assert {(r["ref"], *r["alts"]) for r in sites.collect()} == {(reference[p - 1], OTHER[reference[p - 1]]) for p in TRUTH}


@pytest.mark.parametrize(
    "text", ["@a/1\nACGT\n+\nIIII\n@b", "a/1\nACGT\n+\nIIII\n", "@a/1\nACGT\n-\nIIII\n", "@a/1\nACG\n+\nIIII\n", "@a/1\nACXT\n+\nIIII\n", "@a/1\nACGT\n+\nII I\n", "@a/2\nACGT\n+\nIIII\n", "@a 2:N:0:1\nACGT\n+\nIIII\n", "@\nACGT\n+\nIIII\n"]
)
def test_bad_fastq_is_refused(tmp_path, text):
    with pytest.raises(FormatError):
        list(fastq_records(write(tmp_path / "x.fastq", text), 1))


def test_names_and_pairs(spark):
    assert read_name("r7/1", 1) == read_name("r7 1:N:0:AC", 1) == read_name("r7", 2) == "r7"
    rows = [(0, 1, "a", "AC", "II"), (0, 2, "a", "AC", "II"), (1, 1, "b", "AC", "II"), (2, 1, "c", "A", "I"), (2, 2, "d", "A", "I"), (3, 1, "e", "AX", "II"), (3, 2, "e", "A", "I"), (4, 1, "f", "A", "II"), (4, 2, "f", "A", "I"), (5, 1, "g", "A", "\x7f"), (5, 2, "g", "A", "I")]
    out = reads.pair_problems(spark.createDataFrame(rows, "ordinal long, mate int, name string, seq string, qual string"))
    assert dict(map(tuple, out.collect())) == {1: "mates", 2: "names", 3: "bases", 4: "lengths", 5: "qualities"}


@pytest.mark.parametrize("text", ["", "ACGT\n", ">a\nAC\n>a\nGT\n", "> \nAC\n"])
def test_bad_fasta_is_refused(spark, tmp_path, text):
    with pytest.raises(Exception, match="contig|FASTA"):
        read_reference(spark, write(tmp_path / "x.fa", text)).count()


def test_bam(spark, tmp_path):
    import struct

    text = b"@HD\tVN:1.6\n@RG\tID:g1\tSM:S\tLB:L\tPL:ILLUMINA\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", 1) + struct.pack("<i", 2) + b"1\0" + struct.pack("<i", 500)
    for k in range(3):
        name = f"r{k}".encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", 0, 9 + k, len(name), 30, 0, 1, 99, 5, 0, 49, 60) + name + struct.pack("<I", 5 << 4) + bytes([0x12, 0x48, 0xF0]) + bytes([30, 31, 32, 33, 34]) + b"NMC\x01" + b"RGZg1\0"
        data += struct.pack("<i", len(body)) + body
    out = read_alignments(spark, write(tmp_path / "a.bam", bgzf(data))).orderBy("ordinal").collect()
    assert [(r["name"], r["pos"], r["cigar"], r["seq"], r["qual"], r["library"], r["sample"], r["mate_pos"]) for r in out] == [(f"r{k}", 10 + k, "5M", "ACGTN", "?@ABC", "L", "S", 50) for k in range(3)]
    with pytest.raises(Exception, match="truncated|end block"):
        read_alignments(spark, write(tmp_path / "b.bam", bgzf(data)[:-28])).count()


def bam(rows, contigs=(("1", 10**6), ("2", 5000))):
    import struct

    text = b"@HD\tVN:1.6\n@RG\tID:g1\tSM:S\tLB:L\tPL:ILLUMINA\n"
    data = b"BAM\x01" + struct.pack("<i", len(text)) + text + struct.pack("<i", len(contigs))
    for name, size in contigs:
        data += struct.pack("<i", len(name) + 1) + name.encode() + b"\0" + struct.pack("<i", size)
    for name, tid, pos, n in rows:
        raw = name.encode() + b"\0"
        body = struct.pack("<iiBBHHHiiii", tid, pos, len(raw), 30, 0, 1 if n else 0, 99, n, tid, pos, 0) + raw + (struct.pack("<I", n << 4) if n else b"") + bytes((n + 1) // 2) + bytes([30] * n) + b"NMC\x01RGZg1\0"
        data += struct.pack("<i", len(body)) + body
    return data


@pytest.mark.parametrize("block", [60, 700, 20_000])
def test_bam_is_read_in_parts(spark, tmp_path, block):
    from test_variants import small_blocks

    rng = random.Random(block)
    rows = [(f"read{k}.{rng.randrange(10**rng.randint(1, 9))}", rng.choice([0, 0, 1, -1]), k, rng.choice([0, 1, 50, 151])) for k in range(700)]
    path = write(tmp_path / "a.bam", small_blocks(bam(rows), block))
    for split in (400, 1777, 9000):
        out = read_alignments(spark, path, split=split).orderBy("ordinal").collect()
        assert [(r["name"], r["pos"] - 1, len(r["seq"])) for r in out] == [(n, p, k) for n, _, p, k in rows]
        assert len({r["ordinal"] for r in out}) == len(rows)
    assert read_alignments(spark, write(tmp_path / "none.bam", small_blocks(bam([]), block)), split=100).count() == 0


def test_mates_are_linked_by_name(spark):
    rows = [("L", "a", "1", 10, 0x41), ("L", "a", "1", 90, 0x81), ("L", "a", "2", 5, 0x141), ("L", "b", "1", 3, 0x41), ("M", "a", "1", 7, 0x41), ("L", "c", "1", 1, 0x41), ("L", "c", "1", 2, 0x41), ("L", "c", "1", 3, 0x81)]
    out = {(r["library"], r["name"]): (r["firsts"], r["seconds"], r["linked"], r["second"] and r["second"]["pos"]) for r in reads.mate_links(spark.createDataFrame(rows, "library string, name string, contig string, pos long, flag int")).collect()}
    assert out == {("L", "a"): (1, 1, True, 90), ("L", "b"): (1, 0, False, None), ("M", "a"): (1, 0, False, None), ("L", "c"): (2, 1, False, 3)}


def plain_posteriors(ls, alleles, steps=20):
    """Expectation-maximisation spelt out, a genotype at a time."""
    kinds = [(i, j) for j in range(alleles) for i in range(j + 1)]
    e = [[10 ** (x - max(l)) for x in l] for l in ls]
    f = [0.9] + [0.1 / (alleles - 1)] * (alleles - 1)
    weights = lambda x, f: [x[k] * f[i] * f[j] * (1 if i == j else 2) for k, (i, j) in enumerate(kinds)]
    for _ in range(steps):
        count = [0.0] * alleles
        for x in e:
            w = weights(x, f)
            for k, (i, j) in enumerate(kinds):
                count[i] += w[k] / sum(w)
                count[j] += w[k] / sum(w)
        f = [c / (2 * len(e)) for c in count]
    return [weights(x, f) for x in e], f, sum(math.log10(sum(weights(x, f))) - math.log10(x[0]) for x in e), kinds


def test_joint_genotypes_match_plain_iterations(spark):
    """Sites with one, two and three alternatives; who has what, how surely, and what nobody has."""
    rng = random.Random(5)
    rows, want = [], {}
    for pos in range(30):
        alts = ["C", "G", "T"][: 1 + pos % 3]
        n = len(alts) + 1
        kinds = [(i, j) for j in range(n) for i in range(j + 1)]
        used = [0, 1] if pos % 7 == 0 else range(n)  # an alternative that nobody has
        ls, names = [], []
        for s in range(rng.choice([1, 3, 20])):
            true = tuple(sorted(rng.choice([0, 0, *used]) for _ in range(2))) if pos % 4 else (0, 0)
            l = [-0.3 * rng.randint(5, 20) if kinds[k] != true else -0.1 for k in range(len(kinds))]
            ls.append(l)
            names.append(f"s{s:02}")
            rows.append((names[-1], "1", pos, "A", alts, 10, [5] * n, list(map(float, l))))
        w, f, gain, kinds = plain_posteriors(ls, n)
        if 10 * gain >= 10:
            best = [max(range(len(x)), key=lambda k: x[k]) for x in w]
            had = sorted({a for b in best for a in kinds[b]} - {0}) or [1 + max(range(n - 1), key=lambda k: f[k + 1])]
            number = {a: k for k, a in enumerate([0, *had])}
            for name, x, b in zip(names, w, best):
                gt = "/".join(str(number[a]) for a in kinds[b])
                want[name, pos] = (gt, min(99, round(-10 * math.log10(max(1 - x[b] / sum(x), 1e-10)))), [alts[a - 1] for a in had], [f[a] for a in had])
    frame = spark.createDataFrame(rows, "sample string, contig string, pos long, ref string, alts array<string>, dp int, depths array<int>, likelihoods array<double>")
    got = {(r["sample"], r["pos"]): r for r in reads.joint_genotypes(frame).collect()}
    assert got.keys() == want.keys() and 0 < len(want) < len(rows)
    for k, (gt, gq, alts, f) in want.items():
        r = got[k]
        assert (r["gt"], r["alts"]) == (gt, alts) and abs(r["gq"] - gq) <= 1 and r["frequencies"] == pytest.approx(f, abs=1e-6)
        assert len(r["depths"]) == len(alts) + 1
    assert {len(w[2]) for w in want.values()} == {1, 2, 3}


def test_likelihoods_of_several_alternatives(spark):
    rng = random.Random(2)
    rows = [(s, "1", p, rng.choice("AACCGT"[: 4 + p]), rng.randint(5, 40), 0) for s in ("x", "y") for p in (1, 2) for _ in range(rng.randint(3, 30))]
    bases = spark.createDataFrame(rows, "sample string, contig string, pos long, base string, quality int, strand int")
    chunks = spark.createDataFrame([("1", 0, "ACG")], "contig string, chunk long, bases string")
    sites = reads.candidate_sites(bases, chunks, 10)
    counts = {p: Counter(r[3] for r in rows if r[2] == p) for p in (1, 2)}
    alts = {p: [b for n, b in sorted((-n, b) for b, n in counts[p].items() if b != "AC"[p - 1] and n >= 2)] for p in (1, 2)}
    assert {r["pos"]: (r["ref"], r["alts"]) for r in sites.collect()} == {p: ("AC"[p - 1], a) for p, a in alts.items()}
    for r in reads.genotype_likelihoods(bases, sites).collect():
        alleles = [r["ref"], *r["alts"]]
        mine = [(b, 10 ** (-q / 10)) for s, _, p, b, q, _ in rows if (s, p) == (r["sample"], r["pos"])]
        prob = lambda b, e, a: 1 - e if b == a else e / 3
        want = [sum(math.log10((prob(b, e, alleles[i]) + prob(b, e, alleles[j])) / 2) for b, e in mine) for j in range(len(alleles)) for i in range(j + 1)]
        assert r["likelihoods"] == pytest.approx(want) and r["depths"] == [sum(b == a for b, _ in mine) for a in alleles] and r["dp"] == len(mine)


def test_small_tables(spark, tmp_path):
    samples = spark.createDataFrame([("a",), ("b",), ("c",)], "sample string")
    kin = write(tmp_path / "k.kin0", "##note\n#FID1 IID1 FID2 IID2 NSNP KINSHIP\nb b a a 10 0.25\n  c c  b b 10 0.1\n")
    assert sorted(map(tuple, tables.read_kinship(spark, kin, samples).collect())) == [("a", "b", 0.25), ("b", "c", 0.1)]
    with pytest.raises(GateError):
        tables.read_kinship(spark, write(tmp_path / "k2.kin0", "IID1 IID2 KINSHIP\na z 0.1\n"), samples)
    assert tables.read_psam(spark, write(tmp_path / "s.psam", "#FID IID SEX\na a 1\nb b 2\n")).count() == 2
    with pytest.raises(GateError):
        tables.read_psam(spark, write(tmp_path / "t.psam", "#FID IID\na b\n"))
    assert tables.read_numbers(spark, write(tmp_path / "v", "3.5\n1e-2\n"), 2) == [3.5, 0.01]
    for bad in ("1\n2\n", "2\n-1\n", "2\n", "x\n1\n", "3\n2\n1\n"):
        with pytest.raises(GateError):
            tables.read_numbers(spark, write(tmp_path / "v", bad), 2)
    assert tables.read_markers(spark, write(tmp_path / "m", "x\ny\n")).count() == 2
    with pytest.raises(GateError):
        tables.read_markers(spark, write(tmp_path / "m2", "x\nx\n"))
    assert tables.read_bed(spark, write(tmp_path / "b.bed", "1\t0\t10\n1\t5\t7\n")).count() == 2
    with pytest.raises(GateError):
        tables.read_bed(spark, write(tmp_path / "c.bed", "1\t5\t5\n"))
    assert tables.read_fai(spark, write(tmp_path / "r.fai", "1\t2000\t3\t2000\t2001\n")).first()["length"] == 2000


# ---- placement with gaps


def edits_from(read, bases):
    """The fewest edits of a read from each start on, to any end: the whole table, a row at a time from the read's end."""
    n, m = len(read), len(bases)
    row = np.zeros(m + 1, int)
    for k in range(n - 1, -1, -1):
        differ = np.array([x != read[k] or x == "N" for x in bases], int)
        new = np.concatenate([np.minimum(row[1:] + differ, row[:-1] + 1), [row[-1] + 1]])
        # From the right: a base of the reference that the read lacks.
        back = new[::-1] - np.arange(m + 1)
        row = (np.minimum.accumulate(back) + np.arange(m + 1))[::-1]
    return row[:m]


def all_places(read, contigs, most):
    e = min(most, len(read) // placement.BASES_AN_EDIT - 1)
    out = set()
    for strand, text in (("+", read), ("-", complement(read))):
        for contig, bases in contigs.items():
            found = edits_from(text, bases)
            for s in np.flatnonzero(found <= e).tolist():
                near = range(max(0, s - placement.NEAR), min(len(bases), s + placement.NEAR + 1))
                if (found[s], s) == min((found[t], t) for t in near):
                    out.add((strand, contig, s, int(found[s])))
    return out


def edited(rng, text, n):
    text = list(text)
    for _ in range(n):
        at = rng.randrange(len(text))
        kind = rng.randrange(3)
        if kind == 0:
            text[at] = rng.choice("ACGT")
        elif kind == 1:
            text.insert(at, rng.choice("ACGT"))
        elif len(text) > 1:
            del text[at]
    return "".join(text)


def chunked(spark, contigs, size):
    rows = [(c, i // size, bases[i : i + size]) for c, bases in contigs.items() for i in range(0, len(bases), size)]
    return spark.createDataFrame(rows, "contig string, chunk long, bases string")


@pytest.mark.parametrize("size, most", [(100, 8), (1000, 8), (1000, 3)])
def test_every_place_is_found(spark, size, most):
    """Against the whole table of edits: any kind of edits, ends of contigs, unknown bases, and a repeat that stands 70 times."""
    rng = random.Random(3)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    unit = base(23)
    contigs = {"1": base(400) + unit * 70 + base(300) + "N" * 40 + base(200), "X": base(260) + "ACAC" * 40}
    reads, texts = [], {}
    for k in range(60):
        contig = rng.choice(["1", "1", "X"])
        n = rng.choice([35, 60, 100, 110, 150])
        s = rng.randrange(0, len(contigs[contig]) - n + 1)
        if k % 10 == 0:
            s = rng.choice([0, len(contigs[contig]) - n])
        text = edited(rng, contigs[contig][s : s + n], rng.randrange(0, 10))
        texts[k] = text if k % 2 else complement(text)
        reads.append(("r", k, 1, texts[k]))
    texts[100], texts[101], texts[102] = (unit * 5)[:101], base(120), "ACGTACG"
    reads += [("r", k, 1, texts[k]) for k in (100, 101, 102)]
    wide = placement.overlapping_chunks(chunked(spark, contigs, size), size, 170 + placement.MARGIN).cache()
    frame = spark.createDataFrame(reads, "run string, ordinal long, mate int, seq string")
    got = {}
    for r in placement.place_reads(frame, wide, size, most).collect():
        assert r["length"] == len(texts[r["ordinal"]])
        got.setdefault(r["ordinal"], set()).add((r["strand"], r["contig"], r["start"], r["edits"]))
    want = {k: p for k, t in texts.items() if (p := all_places(t, contigs, most))}
    assert got == want
    assert len(want[100]) > 60 and sum(1 for p in want.values() for x in p if x[3] > 1) > 20


def test_pairs_are_the_best_of_all_places_whatever_the_tier(spark):
    rng = random.Random(8)
    base = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    half = base(600)
    contigs = {"1": base(700) + half + base(500) + edited(rng, half, 12), "2": base(300) + half[100:500] + base(200)}
    rows = []
    for k in range(50):
        c = rng.choice(["1", "1", "2"])
        s = rng.randrange(0, len(contigs[c]) - 320)
        one, two = edited(rng, contigs[c][s : s + 110], rng.choice([0, 0, 1, 2, 5, 8])), complement(edited(rng, contigs[c][s + 190 : s + 300], rng.choice([0, 1, 3, 6])))
        rows += [("r", k, 1 + k % 2, one), ("r", k, 2 - k % 2, two)]
    size = 500
    wide = placement.overlapping_chunks(chunked(spark, contigs, size), size, 130 + placement.MARGIN).cache()
    frame = spark.createDataFrame(rows, "run string, ordinal long, mate int, seq string").cache()
    tiers = sorted(map(str, placement.placed_pairs(frame, wide, size).collect()))
    whole = placement.placed_pairs(frame, wide, size, tiers=(8,)).collect()
    assert tiers == sorted(map(str, whole)) and len(whole) > 40
    assert {r["mapq"] for r in whole} >= {0, 42}
    out = {(r["ordinal"], m): (r[f"cigar{m}"], r[f"span{m}"], r["contig"], r[f"start{m}"], r["strand1"] if m == 1 else "-+"[r["strand1"] == "-"]) for r in placement.with_cigars(spark.createDataFrame(whole), frame, wide, size).collect() for m in (1, 2)}
    gaps = 0
    for _, k, m, seq in rows:
        if (k, m) not in out:
            continue
        cigar, span, contig, start, strand = out[k, m]
        text = seq if strand == "+" else complement(seq)
        runs = [(int(n), op) for n, op in re.findall(r"([0-9]+)([MID])", cigar)]
        assert sum(n for n, op in runs if op != "D") == len(text) and sum(n for n, op in runs if op != "I") == span
        assert start + span <= len(contigs[contig])
        at, cost, i = start, 0, 0
        for n, op in runs:
            if op == "M":
                cost += 4 * sum(a != b for a, b in zip(text[i : i + n], contigs[contig][at : at + n]))
            cost += 0 if op == "M" else 6 + n
            at, i = at + n * (op != "I"), i + n * (op != "D")
        plain = 4 * sum(a != b for a, b in zip(text, contigs[contig][start : start + len(text)].ljust(len(text))))
        assert cost <= plain
        gaps += len(runs) > 1
    assert gaps > 10


def test_gaps_stand_left_and_cost_as_said():
    pad = lambda x, n: np.frombuffer(x.encode().ljust(n, b"#"), np.uint8)[None]
    align = lambda read, window: "".join(f"{n}{op}" for n, op in placement.affine(pad(read, len(read)), pad(window, len(read) + 8), 8)[0])
    assert align("ACGTACGTTTTTGCA", "ACGTACGTTTTTTTGCA") == "7M2D8M"
    assert align("GATTACAAAAAACCGT", "GATTACAAAACCGTTG") == "6M2I8M"
    assert align("GGCATTTACC", "GGCAGTTACC") == "10M"
    assert align("ACGT" * 5, "ACGT" * 4) == "4I16M"


def test_pileup_follows_cigars(spark):
    rows = [("a", "1", 10, "4M2D3M", "ACGTTTA"), ("b", "1", 10, "2S3M1I2M", "NNACGTAC"), ("c", "1", 12, "*", "GG"), ("d", "1", 12, None, "GG"), ("e", "1", 12, "2M3N1=1X", "CCAT"), ("f", "1", 5, "3H2I", "AC"), ("g", "1", 5, "", "")]
    frame = spark.createDataFrame([("s", n, c, p, 2, 60, x, n, q, "I" * len(q)) for n, c, p, x, q in rows], "sample string, library string, contig string, pos long, flag int, mapq int, cigar string, name string, seq string, qual string")
    out = {}
    for lib in "abcdefg":
        found = reads.pileup(frame.where(F.col("library") == lib)).select("pos", "base").orderBy("pos").collect()
        out[lib] = [(r["pos"], r["base"]) for r in found]
    assert out["a"] == [(10, "A"), (11, "C"), (12, "G"), (13, "T"), (16, "T"), (17, "T"), (18, "A")]
    assert out["b"] == [(10, "A"), (11, "C"), (12, "G"), (13, "A"), (14, "C")]
    assert out["c"] == out["d"] == [(12, "G"), (13, "G")] and out["e"] == [(12, "C"), (13, "C"), (17, "A"), (18, "T")]
    assert out["f"] == out["g"] == []


# ---- FASTQ in parts


def fastq(n, seed=1, end="\n"):
    """Records whose qualities begin with @ and + and look like bases or names, of all lengths."""
    rng = random.Random(seed)
    out, rows = [], []
    for k in range(n):
        size = rng.choice([1, 2, 3, 30, 151])
        seq = "".join(rng.choice("ACGTN") for _ in range(size))
        qual = rng.choice(["@", "+", "A", "I", "@A"]) * size
        qual = qual[:size] if rng.random() < 0.8 else "".join(rng.choice("@+ACGT!~") for _ in range(size))
        name = rng.choice(["r", "ACGT", "@", "+"]) + str(k)
        plus = rng.choice(["+", "+" + name, "+@A"])
        out.append(f"@{name}{end}{seq}{end}{plus}{end}{qual}{end}")
        rows.append((k, 1, name, seq, qual))
    return "".join(out), rows


@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_fastq_is_cut_anywhere(tmp_path, end):
    """Every border of every part of a small file, plain and in blocks of every size."""
    from test_variants import small_blocks

    text, rows = fastq(14, end=end)
    path = write(tmp_path / "a.fq", text)
    whole = list(fastq_records(path, 1))
    assert whole == rows
    for cut in range(1, len(text)):
        both = [x[1:] for a, b in ((0, cut), (cut, None)) for x in fastq_records(path, 1, a, b)] if cut else []
        assert both == [x[1:] for x in rows]
    for block in (1, 2, 3, 7, 40, 333):
        path = write(tmp_path / f"a{block}.fq.gz", small_blocks(text.encode(), block))
        assert [x[1:] for x in fastq_records(path, 1)] == [x[1:] for x in rows]
        for split in (30, 64, 150, 700, 2000):
            from locusflow.sources.sequences import _splits

            found = [x for a, b in _splits(path, split) for x in fastq_records(path, 1, a, b)]
            assert [x[1:] for x in found] == [x[1:] for x in rows] and [x[0] for x in found] == sorted({x[0] for x in found})


@pytest.mark.parametrize("split", [300, 2500, 1 << 20])
def test_records_of_parts_are_numbered_like_those_of_the_whole(spark, tmp_path, split):
    from test_variants import small_blocks

    one, rows = fastq(400, 2)
    two = "".join(f"@{name}/2\n{seq}\n+\n{qual}\n" for _, _, name, seq, qual in rows)
    first, second = write(tmp_path / "1.fq", one), write(tmp_path / "2.fq.gz", small_blocks(two.encode(), 777))
    out = read_fastq_pair(spark, first, second, split)
    assert sorted(map(tuple, out.collect())) == sorted([*rows, *((k, 2, n, s, q) for k, _, n, s, q in rows)])
    assert reads.pair_problems(out).count() == 0
    with pytest.raises(Exception, match="cut off|begin with|qualities"):
        read_fastq_pair(spark, write(tmp_path / "3.fq", one[:-40]), second, split).count()


def test_numbers_of_split_variants_equal_those_of_the_whole(spark, tmp_path):
    from fixtures import bcf, vcf
    from test_variants import SAMPLES, small_blocks

    from locusflow.sources.sequences import dense_numbers
    from locusflow.sources.vcf import read_variants

    text = vcf([("1", 10 + k, f"rs{k}", "A", "C", "PASS", "GT", "0/0 0/1 ./. 1/1") for k in range(500)], SAMPLES)
    for path in (write(tmp_path / "a.vcf", text), write(tmp_path / "a.vcf.gz", small_blocks(text.encode(), 900)), write(tmp_path / "a.bcf", small_blocks(gzip.decompress(bcf(text)), 900))):
        records = read_variants(spark, path, split=2000)[0]
        assert records.rdd.getNumPartitions() > 2
        assert [(r["rec"], r["id"]) for r in dense_numbers(records, "rec").where("pos >= 10").orderBy("pos").select("rec", "id").collect()] == [(k, f"rs{k}") for k in range(500)]


# ---- BAM by index


def bai(rows, contigs):
    """A BAI index of records (virtual offset, place behind it, contig number, 0-based position, bases spanned)."""
    import struct

    out = b"BAI\x01" + struct.pack("<i", contigs)
    for c in range(contigs):
        bins, linear = {}, {}
        for at, behind, tid, pos, span in rows:
            if tid != c:
                continue
            end = pos + max(1, span) - 1
            level = next((k for k, shift in enumerate((14, 17, 20, 23, 26)) if pos >> shift == end >> shift), 5)
            number = 0 if level == 5 else ((1 << 15 - 3 * level) - 1) // 7 + (pos >> 14 + 3 * level)
            bins.setdefault(number, []).append((at, behind))
            for k in range(pos >> 14, (end >> 14) + 1):
                linear[k] = min(linear.get(k, at), at)
        out += struct.pack("<i", len(bins))
        for number, chunks in bins.items():
            out += struct.pack("<Ii", number, len(chunks)) + b"".join(struct.pack("<QQ", *x) for x in chunks)
        n = max(linear, default=-1) + 1
        out += struct.pack("<i", n) + b"".join(struct.pack("<Q", linear.get(k, 0)) for k in range(n))
    return out


def test_regions_of_alignments_touch_their_chunks_only(spark, tmp_path, monkeypatch):
    from test_variants import small_blocks

    from locusflow.sources import bgzf
    from locusflow.sources.sequences import BamReader

    rng = random.Random(3)
    places = sorted((rng.choice([0, 0, 1]), rng.randrange(900_000)) for _ in range(1500))
    places = [(t, p if t == 0 else p % 4000) for t, p in places]
    places.sort()
    rows = [(f"r{k}", t, p, rng.choice([1, 50, 151])) for k, (t, p) in enumerate(places)] + [(f"u{k}", -1, -1, 30) for k in range(20)]
    path = write(tmp_path / "a.bam", small_blocks(bam(rows), 2000))
    plain = read_alignments(spark, path).orderBy("ordinal").collect()
    offsets = [r["ordinal"] for r in plain]
    write(tmp_path / "a.bam.bai", bai([(at, behind, t, p, n) for at, behind, (_, t, p, n) in zip(offsets, [*offsets[1:], offsets[-1] + (1 << 16)], rows)], 2))
    span = {r["ordinal"]: n for r, (_, _, _, n) in zip(plain, rows)}
    for condition in ("contig = '1' AND pos BETWEEN 300000 AND 420000", "contig = '2' AND pos < 900", "contig IN ('1', '2') AND pos = 77", "contig = 'none'", "pos >= 899000 AND flag = 99", "contig IS NULL"):
        want = [r["ordinal"] for r in read_alignments(spark, path).select("ordinal", "contig", "pos", "flag").collect() if eval_sql(condition, r)]
        found = read_alignments(spark, path).where(condition).select("ordinal", "contig", "pos", "flag")
        assert sorted(r["ordinal"] for r in found.collect()) == sorted(want)
    for region, (c, b, e) in {"1:300001-420000": ("1", 300_000, 420_000), "2": ("2", 0, 1 << 40)}.items():
        got = sorted(r["ordinal"] for r in read_alignments(spark, path, regions=region).select("ordinal").collect())
        want = sorted(r["ordinal"] for r in plain if r["contig"] == c and r["pos"] - 1 < e and r["pos"] - 1 + span[r["ordinal"]] > b)
        assert got == want
    seen = set()
    real = bgzf.blocks
    monkeypatch.setattr(bgzf, "blocks", lambda p, begin=0: (seen.add(x[0]) or x for x in real(p, begin)))
    from pyspark.sql.datasource import EqualTo, GreaterThan, IsNotNull, LessThan

    def blocks_for(*filters):
        seen.clear()
        reader = BamReader({"path": path})
        assert list(reader.pushFilters(list(filters))) == []
        n = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
        return n, len(seen)

    every, all_blocks = blocks_for()
    some, few = blocks_for(IsNotNull(("contig",)), EqualTo(("contig",), "1"), GreaterThan(("pos",), 400_000), LessThan(("pos",), 410_000))
    assert every == len(rows) and some == sum(r["contig"] == "1" and 400_000 < r["pos"] < 410_000 for r in plain) > 0
    assert few < all_blocks / 4


def eval_sql(condition, r):
    contig, pos, flag = r["contig"], r["pos"], r["flag"]
    return {
        "contig = '1' AND pos BETWEEN 300000 AND 420000": contig == "1" and 300_000 <= pos <= 420_000, "contig = '2' AND pos < 900": contig == "2" and pos < 900, "contig IN ('1', '2') AND pos = 77": contig in ("1", "2") and pos == 77,
        "contig = 'none'": False, "pos >= 899000 AND flag = 99": pos >= 899_000 and flag == 99, "contig IS NULL": contig is None,
    }[condition]


def test_fasta_index(tmp_path):
    from locusflow.sources.sequences import fasta_index

    text = ">1 first\nACGTA\nACGTA\nAC\n>chr2\r\nAAAA\r\nCC\r\n>3\nACGT\n\n>4\nA"
    found = fasta_index(write(tmp_path / "a.fa", text))
    assert found == [("1", 12, 9, 5, 6), ("chr2", 6, text.index("AAAA"), 4, 6), ("3", 4, text.index("ACGT\n\n"), 4, 5), ("4", 1, len(text) - 1, 1, 1)]
    for bad in (">1\nAC\nACG\n", ">1\nACG\nA\nACG\n", "AC\n", ">1\nAC\n\nAC\n"):
        with pytest.raises(FormatError):
            fasta_index(write(tmp_path / "b.fa", bad))
