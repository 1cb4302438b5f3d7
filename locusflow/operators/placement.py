"""Placement of paired reads on a reference, with gaps, by seeds.

A read with at most e edits, cut into e + 1 pieces, has a piece without an edit. So reads are cut into pieces, an equi-join
of the pieces' first bases with the k-mers of the reference proposes places, and each is verified by a banded
alignment of the whole read: what has at most so many edits is found, in repeats of any frequency.

A pair is placed where both mates fit end to end, face each other and lie within the largest fragment. Pairs are looked for
with few edits first (long seeds, which stand in few places). All that have that many edits altogether are found
then, so a pair whose best place is among them is decided; the others are looked for again, with more edits and
shorter seeds. The chosen places are aligned with affine costs of gaps, for their CIGARs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.functions import genetics as g
from locusflow.operators.reads import mark_duplicates
from locusflow.session import persisted, prepare_workers

#: A place has at most so many edits, and one in so many bases. Starts within NEAR bases are one place.
EDITS, BASES_AN_EDIT, NEAR, FRAGMENT = 8, 12, 8, 1000
#: Edits of a mate that are allowed in turn.
TIERS = (1, 3, EDITS)
#: Lengths of seeds; a seed is 2 bits a base in a long.
SEEDS = (12, 16, 20, 25, 31)
#: Starts that are verified together.
BUCKET = 16
#: Costs of the final alignment: a mismatch, the first base of a gap, another base of it.
MISMATCH, OPEN, EXTEND = 4, 7, 1
#: Bases of the reference that a read may need beyond its own length.
MARGIN = BUCKET + 4 * EDITS + 2 * NEAR
READ = ["run", "ordinal", "mate"]
_CODE = np.full(256, 4, np.uint8)
_CODE[[65, 67, 71, 84, 97, 99, 103, 116]] = [0, 1, 2, 3] * 2
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
FAR = 1 << 14


# ---------------------------------------------------------------- seeds


def kmers(bases: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, codes) of the stretches of k known bases."""
    c = _CODE[bases]
    n = len(c) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    code = np.zeros(n, np.int64)
    for i in range(k):
        code = code << 2 | (c[i : i + n] & 3)
    unknown = np.concatenate([[0], np.cumsum(c > 3)])
    at = np.flatnonzero(unknown[k:] == unknown[:-k])
    return at, code[at]


def reference_seeds(reference: DataFrame, k: int) -> DataFrame:
    """(k, seed, contig, start) of the reference's k-mers. reference: contig, offset, seq in chunks that overlap by k - 1."""
    prepare_workers(reference.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for contig, offset, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                at, code = kmers(np.frombuffer(seq.as_buffer(), np.uint8), k)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(code), pa.array([contig] * len(at), pa.string()), pa.array(at + offset)], ["k", "seed", "contig", "start"])

    return reference.select("contig", "offset", F.substring("seq", 1, F.col("length") + k - 1).alias("seq")).mapInArrow(run, "k int, seed long, contig string, start long")


def allowed(length: int | np.ndarray, most: int):
    """Edits that a read of this length may have."""
    return np.minimum(most, length // BASES_AN_EDIT - 1)


def seed_length(length: int, most: int) -> int:
    """The longest seed that each piece of a read holds; 0 for reads that are too short to be placed."""
    e = int(allowed(length, most))
    return max((k for k in SEEDS if e >= 0 and k <= length // (e + 1)), default=0)


def _read_seeds(most: int):
    """Rows (run, ordinal, mate, seq) to (run, ordinal, mate, strand, length, k, at, seed)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, strand, length, ks, ats, seeds = [], [], [], [], [], []
            for i, seq in enumerate(batch.column(3)):
                raw = seq.as_buffer().to_pybytes()
                n, k = len(raw), seed_length(len(raw), most)
                if not k:
                    continue
                step = n // (int(allowed(n, most)) + 1)
                for sign, text in (("+", raw), ("-", raw.translate(_COMPLEMENT)[::-1])):
                    at, code = kmers(np.frombuffer(text, np.uint8), k)
                    mine = (at % step == 0) & (at // step <= allowed(n, most))
                    m = int(mine.sum())
                    owner += [i] * m
                    strand += [sign] * m
                    length += [n] * m
                    ks += [k] * m
                    ats += at[mine].tolist()
                    seeds += code[mine].tolist()
            keys = [batch.column(c).take(pa.array(owner, pa.int64())) for c in range(3)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(strand, pa.string()), *(pa.array(x, pa.int32()) for x in (length, ks, ats)), pa.array(seeds, pa.int64())], [*READ, "strand", "length", "k", "at", "seed"])

    return run


# ---------------------------------------------------------------- verification


def edits_by_start(reads: np.ndarray, windows: np.ndarray, most: int) -> np.ndarray:
    """The fewest edits of a read from each start of its window on, to any end: (reads, starts).

    reads: bytes of reads of one length n; windows: the bases from the first start to n + most behind the last one, with
    ``#`` where the contig has none. Read and window are aligned from behind, so that starts become ends: a row
    of a band at a time for all reads together.
    """
    count, n = reads.shape
    starts = windows.shape[1] - n - most
    r, t = reads[:, ::-1], windows[:, ::-1]
    wide = t.shape[1]
    # Column b of row i stands for i + b + base bases of the window.
    base, band = wide - (starts - 1) - n - most, starts + 2 * most
    places = np.arange(band)
    row = np.where((places + base >= 0) & (places + base <= wide), 0, FAR).astype(np.int32)
    row = np.repeat(row[None], count, 0)
    steps = places.astype(np.int32)
    for i in range(1, n + 1):
        j = i + places + base
        inside = (j >= 1) & (j <= wide)
        there = t[:, np.clip(j - 1, 0, wide - 1)]
        cost = np.where(there == 35, FAR, (there != r[:, i - 1, None]) | (there == 78)).astype(np.int32)
        new = np.where(inside, np.minimum(row + cost, FAR), FAR).astype(np.int32)
        new[:, :-1] = np.minimum(new[:, :-1], row[:, 1:] + 1)
        new[:, (j < 0) | (j > wide)] = FAR
        # A base of the window that the read lacks: the best on the left, plus the way from there.
        row = np.minimum.accumulate(new - steps, 1) + steps
    last = row[:, most : most + starts]  # i = n: j from wide - (starts - 1) to wide
    return last[:, ::-1].astype(np.int64)


def best_starts(edits: np.ndarray, most: int) -> np.ndarray:
    """Which starts have at most so many edits and no better one (fewer edits, or as many and farther left) within NEAR."""
    n = edits.shape[1]
    key = edits * (1 << 20) + np.arange(n)
    wide = np.full((len(edits), n + 2 * NEAR), np.iinfo(np.int64).max)
    wide[:, NEAR : NEAR + n] = key
    least = np.lib.stride_tricks.sliding_window_view(wide, 2 * NEAR + 1, 1).min(2)
    return (edits <= most) & (least == key)


def _windows(windows: list[str], before: list[int], width: int) -> np.ndarray:
    """Windows of one width; ``before`` is how many of their bases lie before the contig."""
    return np.array([np.frombuffer((b"#" * b + w.encode()).ljust(width, b"#")[:width], np.uint8) for w, b in zip(windows, before, strict=True)])


def _verify(most: int):
    """Rows (run, ordinal, mate, strand, contig, low, seq, window) to places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seqs = batch.column(6).to_pylist()
            lengths = np.array([len(x) for x in seqs])
            low = batch.column(5).to_numpy()
            for n in np.unique(lengths):
                mine = np.flatnonzero(lengths == n)
                e = int(allowed(n, most))
                for at in range(0, len(mine), 512):
                    part = mine[at : at + 512]
                    reads = np.array([np.frombuffer(seqs[i].encode(), np.uint8) for i in part])
                    windows = _windows([batch.column(7)[i].as_py() for i in part], np.maximum(-low[part], 0).tolist(), BUCKET + 3 * e + 2 * NEAR + int(n))
                    edits = edits_by_start(reads, windows, e)
                    edits[low[part, None] + np.arange(edits.shape[1]) < 0] = FAR
                    # The outermost starts are only there to be compared with.
                    best = best_starts(edits, e)
                    best[:, :NEAR] = best[:, best.shape[1] - NEAR :] = False
                    who, where = np.nonzero(best)
                    rows = pa.array(part[who])
                    keys = [batch.column(k).take(rows) for k in range(5)]
                    yield pa.RecordBatch.from_arrays([*keys, pa.array(low[part][who] + where), pa.array(np.full(len(who), n, np.int32)), pa.array(edits[who, where].astype(np.int32))], [*READ, "strand", "contig", "start", "length", "edits"])

    return run


def _with_reference(rows: DataFrame, reference: DataFrame, size: int, first: Column, width: Column) -> DataFrame:
    """Rows with ``window``: so many bases from ``first`` on (what lies before the contig isn't there)."""
    begin = F.greatest(first, F.lit(0))
    keyed = rows.withColumn("offset", (F.floor(begin / size) * size).cast("long"))
    met = keyed.join(reference.select("contig", "offset", F.col("seq").alias("bases")), ["contig", "offset"])
    return met.withColumn("window", F.substring(F.col("bases"), (begin - F.col("offset") + 1).cast("int"), (width - (begin - first)).cast("int"))).drop("bases", "offset")


def _sequences(reads: DataFrame) -> DataFrame:
    """Both strands of every read."""
    both = F.array(F.struct(F.lit("+").alias("strand"), F.col("seq").alias("seq")), F.struct(F.lit("-").alias("strand"), g.reverse_complement(F.col("seq")).alias("seq")))
    return reads.select(*READ, F.explode(both).alias("s")).select(*READ, "s.*")


def overlapping_chunks(chunks: DataFrame, size: int, overlap: int) -> DataFrame:
    """(contig, offset, length, seq): chunks of a reference, each with the first ``overlap`` bases of what follows it.

    length is the chunk's own. If the overlap is longer than a chunk, it goes on through as many as it needs.
    """
    out = chunks.select("contig", "chunk", "bases", F.col("bases").alias("seq"))
    for k in range(1, -(-overlap // size) + 1):
        following = chunks.select("contig", (F.col("chunk") - k).alias("chunk"), F.substring("bases", 1, max(0, overlap - (k - 1) * size)).alias("more"))
        out = out.join(following, ["contig", "chunk"], "left").withColumn("seq", F.concat("seq", F.coalesce("more", F.lit("")))).drop("more")
    return out.select("contig", (F.col("chunk") * size).alias("offset"), F.length("bases").alias("length"), "seq")


def place_reads(reads: DataFrame, reference: DataFrame, size: int, most: int = EDITS) -> DataFrame:
    """(run, ordinal, mate, strand, contig, start, length, edits) of all places of each read with at most ``most`` edits.

    A place is a start from which the whole read fits with so many edits (mismatches, inserted and missing bases; unknown
    bases match nothing), and from which it fits better than from any start within NEAR bases: with fewer edits, or with as many
    and farther left. A read of n bases may have n // BASES_AN_EDIT - 1 edits at most; shorter ones than that aren't placed.

    reads: run, ordinal, mate, seq. reference: contig, offset, length, seq in chunks of ``size`` bases that overlap by a read's
    length and MARGIN at least (see overlapping_chunks).
    """
    prepare_workers(reads.sparkSession)
    cut = persisted(reads.select(*READ, "seq").mapInArrow(_read_seeds(most), "run string, ordinal long, mate int, strand string, length int, k int, at int, seed long"), "seeds")
    seeds = None
    for k in sorted(r["k"] for r in cut.select("k").distinct().collect()):
        own = reference_seeds(reference, k)
        seeds = own if seeds is None else seeds.unionByName(own)
    shape = "run string, ordinal long, mate int, strand string, contig string, start long, length int, edits int"
    if seeds is None:
        return reads.sparkSession.createDataFrame([], shape)
    hits = cut.hint("merge").join(seeds.hint("merge"), ["k", "seed"])
    edits = F.least(F.lit(most), F.floor(F.col("length") / BASES_AN_EDIT) - 1)
    # What begins within one bucket, however many seeds say so, is verified once.
    buckets = hits.select(*READ, "strand", "contig", F.floor((F.col("start") - F.col("at")) / BUCKET).alias("bucket"), edits.alias("e"), "length").distinct()
    low = F.col("bucket") * BUCKET - F.col("e") - NEAR
    windows = _with_reference(buckets.withColumn("low", low), reference, size, F.col("low"), BUCKET + 3 * F.col("e") + 2 * NEAR + F.col("length"))
    rows = windows.join(_sequences(reads), [*READ, "strand"]).select(*READ, "strand", "contig", "low", "seq", "window")
    # Buckets overlap by the edits.
    return rows.mapInArrow(_verify(most), shape).distinct()


def place_pairs(places: DataFrame, fragment: int = FRAGMENT) -> DataFrame:
    """The best place of each pair: run, ordinal, contig, start1, strand1, start2, length1, length2, edits, mapq.

    Mates must face each other on one contig within the largest fragment. Pairs with several best places get quality 0.
    """
    one, two = (places.where(F.col("mate") == m) for m in (1, 2))
    names = ["strand", "start", "length", "edits"]
    pairs = one.withColumnsRenamed({n: f"{n}1" for n in names}).drop("mate").join(two.withColumnsRenamed({n: f"{n}2" for n in names}).drop("mate"), ["run", "ordinal", "contig"])
    left, right = F.least("start1", "start2"), F.greatest(F.col("start1") + F.col("length1"), F.col("start2") + F.col("length2"))
    forward_first = F.when(F.col("strand1") == "+", F.col("start1") <= F.col("start2")).otherwise(F.col("start2") <= F.col("start1"))
    pairs = pairs.where((F.col("strand1") != F.col("strand2")) & forward_first & (right - left <= fragment)).withColumn("edits", F.col("edits1") + F.col("edits2"))
    best = pairs.groupBy("run", "ordinal").agg(F.min_by(F.struct("contig", "start1", "strand1", "start2", "length1", "length2"), F.struct("edits", "contig", "start1", "strand1", "start2")).alias("p"), F.min("edits").alias("edits"))
    ties = pairs.join(best.select("run", "ordinal", F.col("edits").alias("_best")), ["run", "ordinal"]).where(F.col("edits") == F.col("_best")).groupBy("run", "ordinal").agg(F.count("*").alias("ties"))
    mapq: Column = F.when(F.col("ties") > 1, 0).otherwise(F.greatest(42 - 3 * F.col("edits"), F.lit(20)))
    return best.join(ties, ["run", "ordinal"]).select("run", "ordinal", "p.*", "edits", mapq.cast("int").alias("mapq"))


def placed_pairs(reads: DataFrame, reference: DataFrame, size: int, fragment: int = FRAGMENT, tiers: tuple[int, ...] = TIERS) -> DataFrame:
    """What :func:`place_pairs` gives of all places with the last tier's edits, found with as few edits as a pair needs."""
    out, left = None, reads
    for most in tiers:
        pairs = place_pairs(persisted(place_reads(left, reference, size, most), "places"), fragment)
        last = most == tiers[-1]
        # All pairs with so many edits altogether are known; of a pair with more, a better one may not be.
        sure = persisted(pairs if last else pairs.where(F.col("edits") <= most), "pairs")
        out = sure if out is None else out.unionByName(sure)
        if not last:
            left = persisted(left.join(sure.select("run", "ordinal"), ["run", "ordinal"], "left_anti"), "left")
    return out


# ---------------------------------------------------------------- CIGARs


def affine(reads: np.ndarray, windows: np.ndarray, most: int) -> list[list[tuple[int, str]]]:
    """The cheapest alignment of each read from its window's first base on, as runs of M, I and D; gaps stand left.

    Costs: MISMATCH, OPEN and EXTEND. A band of ``most`` gap bases on either side, a row at a time for all reads together.
    """
    count, n = reads.shape
    band = 2 * most + 1
    far = 1 << 20
    places = np.arange(band)
    diagonal, inserted, missing = (np.full((n + 1, count, band), far, np.int32) for _ in range(3))
    diagonal[0][:, most] = 0
    ramp = (EXTEND * places).astype(np.int32)
    for i in range(1, n + 1):
        j = i + places - most
        there = windows[:, np.clip(j - 1, 0, windows.shape[1] - 1)]
        cost = np.where((there == 35) | (j < 1) | (j > windows.shape[1]), far, np.where((there == reads[:, i - 1, None]) & (there != 78), 0, MISMATCH))
        before = np.minimum(np.minimum(diagonal[i - 1], inserted[i - 1]), missing[i - 1])
        diagonal[i] = np.minimum(before + cost, far)
        inserted[i][:, :-1] = np.minimum(np.minimum(diagonal[i - 1], missing[i - 1])[:, 1:] + OPEN, inserted[i - 1][:, 1:] + EXTEND)
        # A gap in the read begins behind an aligned base, as far to the left as is cheapest.
        opened = np.minimum.accumulate(diagonal[i] + OPEN - EXTEND - ramp, 1)[:, :-1] + ramp[1:]
        missing[i][:, 1:] = np.minimum(opened, far)
    out = []
    for r in range(count):
        ends = np.minimum(diagonal[n, r], inserted[n, r])
        b, i, ops = int(ends.argmin()), n, []
        kind = "M" if diagonal[n, r, b] <= inserted[n, r, b] else "I"
        while i > 0:
            ops.append(kind)
            if kind == "M":
                i -= 1
                values = (diagonal[i, r, b], inserted[i, r, b], missing[i, r, b]) if i else (0, far, far)
                kind = "MID"[int(np.argmin(values))]
            elif kind == "I":
                cost, i, b = inserted[i, r, b], i - 1, b + 1
                kind = "I" if inserted[i, r, b] + EXTEND == cost else "M" if diagonal[i, r, b] <= missing[i, r, b] else "D"
            else:
                cost, b = missing[i, r, b], b - 1
                kind = "M" if diagonal[i, r, b] + OPEN == cost else "D"
        runs: list[list] = []
        for op in reversed(ops):
            if runs and runs[-1][1] == op:
                runs[-1][0] += 1
            else:
                runs.append([1, op])
        out.append([tuple(x) for x in runs])
    return out


def _cigars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (run, ordinal, mate, seq, window) with cigar and the bases of the reference that it spans."""
    for batch in batches:
        seqs, windows = batch.column(3).to_pylist(), batch.column(4).to_pylist()
        texts: list = [None] * len(seqs)
        spans = [0] * len(seqs)
        rest: dict[int, list[int]] = {}
        for i, (seq, window) in enumerate(zip(seqs, windows, strict=True)):
            a, b = np.frombuffer(seq.encode(), np.uint8), np.frombuffer(window.encode().ljust(len(seq), b"#")[: len(seq)], np.uint8)
            wrong = int(np.count_nonzero((a != b) | (b == 78))) if 35 not in b else FAR
            # A gap costs more than a mismatch, so what has none or one is as it is.
            if wrong <= 1:
                texts[i], spans[i] = f"{len(seq)}M", len(seq)
            else:
                rest.setdefault(len(seq), []).append(i)
        for n, rows in rest.items():
            for at in range(0, len(rows), 256):
                part = rows[at : at + 256]
                reads = np.array([np.frombuffer(seqs[i].encode(), np.uint8) for i in part])
                found = affine(reads, _windows([windows[i] for i in part], [0] * len(part), n + EDITS), EDITS)
                for i, runs in zip(part, found, strict=True):
                    texts[i] = "".join(f"{k}{op}" for k, op in runs)
                    spans[i] = sum(k for k, op in runs if op != "I")
        yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(texts, pa.string()), pa.array(spans, pa.int32())], [*READ, "cigar", "span"])


def with_cigars(pairs: DataFrame, reads: DataFrame, reference: DataFrame, size: int) -> DataFrame:
    """Pairs with cigar1, cigar2, span1 and span2: how their mates lie at their places."""
    prepare_workers(pairs.sparkSession)
    other = F.when(F.col("strand1") == "+", "-").otherwise("+")
    mates = pairs.select("run", "ordinal", "contig", F.explode(F.array(*(F.struct(F.lit(m).alias("mate"), strand.alias("strand"), F.col(f"start{m}").alias("start"), F.col(f"length{m}").alias("length")) for m, strand in ((1, F.col("strand1")), (2, other))))).alias("m"))
    mates = mates.select("run", "ordinal", "contig", "m.*")
    rows = _with_reference(mates, reference, size, F.col("start"), F.col("length") + EDITS).join(_sequences(reads), [*READ, "strand"])
    found = rows.select(*READ, "seq", "window").mapInArrow(_cigars, "run string, ordinal long, mate int, cigar string, span int")
    of = lambda m, c: F.max(F.when(F.col("mate") == m, F.col(c))).alias(f"{c}{m}")
    return pairs.join(found.groupBy("run", "ordinal").agg(*(of(m, c) for m in (1, 2) for c in ("cigar", "span"))), ["run", "ordinal"])


def alignments(pairs: DataFrame, reads: DataFrame, libraries: DataFrame) -> DataFrame:
    """Placed pairs as alignments with flags, duplicates marked within a library: the input of a pileup.

    libraries: run, sample, library. pairs: as :func:`with_cigars` gives them. Of fragments with one library, contig and ends
    the best quality sum stays.
    """
    total = F.aggregate(g.qualities(F.col("qual")), F.lit(0), lambda a, q: a + q)
    score = reads.groupBy("run", "ordinal").agg(F.sum(total).alias("score"))
    placed = pairs.join(score, ["run", "ordinal"]).join(F.broadcast(libraries), "run")
    end = lambda k: F.struct(F.when(F.col(f"strand{k}") == "+", F.col(f"start{k}")).otherwise(F.col(f"start{k}") + F.col(f"span{k}")).alias("p"), F.col(f"strand{k}").alias("s"))
    placed = placed.withColumn("strand2", F.when(F.col("strand1") == "+", "-").otherwise("+"))
    placed = placed.withColumns({"low": F.least(end(1), end(2)), "high": F.greatest(end(1), end(2)), "name": F.format_string("%s_%012d", "run", "ordinal")})
    placed = mark_duplicates(placed, ["library", "contig", "low", "high"], "score", "name")
    mates = placed.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("mate")).join(reads.select("run", "ordinal", "mate", "seq", "qual"), ["run", "ordinal", "mate"])
    own, other = (F.when(F.col("mate") == a, F.col("strand1")).otherwise(F.col("strand2")) for a in (1, 2))
    flag = F.lit(g.PAIRED | g.PROPER) + F.when(own == "-", g.REVERSE).otherwise(0) + F.when(other == "-", 32).otherwise(0) + F.when(F.col("mate") == 1, g.FIRST).otherwise(g.SECOND) + F.when(F.col("duplicate"), g.DUPLICATE).otherwise(0)
    start, cigar = (F.when(F.col("mate") == 1, F.col(f"{c}1")).otherwise(F.col(f"{c}2")) for c in ("start", "cigar"))
    return mates.select(
        "sample", "library", "contig", (start + 1).alias("pos"), flag.cast("int").alias("flag"), "mapq", cigar.alias("cigar"), "name", F.when(own == "-", g.reverse_complement(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(own == "-", F.reverse("qual")).otherwise(F.col("qual")).alias("qual")
    )
