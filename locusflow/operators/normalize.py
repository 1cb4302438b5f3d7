"""Normalisation of variant records: splitting of alleles, reference check, left alignment.

An indel moves left as long as the bases before it allow, however far that is. The reference is a table of chunks, and
indels move in rounds: each is joined with the one chunk that ends before it, moves there as far as it can, and only those
that reach the chunk's beginning take part in the next round, with the chunk before.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.operators.order import steps_back
from locusflow.operators.sets import GateError
from locusflow.session import columns_of, persisted, prepare_workers, release
from locusflow.sources.vcf import OWN, Header, numbers_of

#: Indels that still move are broadcast up to so many; beyond that they meet their chunks in a shuffle.
BROADCAST_INDELS = 200_000
#: Tables of settled indels that are kept apart before they become one.
ROUNDS = 16
_BASES = re.compile("[ACGTNacgtn]+")


def remap(gt: Column, allele: Column) -> Column:
    """Alleles as seen from one alternative: 0 stays, it becomes 1, and others are missing."""
    return F.transform(gt, lambda a: F.when(a == 0, 0).when(a == allele, 1))


def _values_of(text: Column, number: Column, count: Column, allele: Column) -> Column:
    """What a value of several alleles says of one: number is A, R or G as the format declares; others stay whole.

    A value that hasn't as many parts as its number asks for stays whole, too.
    """
    parts = F.split(text, ",")
    at = lambda *places: F.concat_ws(",", *(F.get(parts, p.cast("int")) for p in places))
    zero, n = F.lit(0), F.size(parts)
    first = (allele * (allele + 1) / 2).cast("int")
    return (
        F.when((number == "A") & (n == count), at(allele - 1))
        .when((number == "R") & (n == count + 1), at(zero, allele))
        .when((number == "G") & (n == ((count + 1) * (count + 2) / 2).cast("int")), at(zero, first, first + allele))
        .when((number == "G") & (n == count + 1), at(zero, allele))
        .otherwise(text)
    )


def split_fields(rows: DataFrame, header: Header) -> DataFrame:
    """Rows of :func:`split_alleles` with INFO and FORMAT values that are by allele or genotype cut down to their allele.

    ``_count`` is the number of alternatives that the record had.
    """
    numbers = {kind: {k: n for k, n in numbers_of(header, kind).items() if n in ("A", "R", "G")} for kind in ("INFO", "FORMAT")}
    of = lambda kind: F.create_map(*(F.lit(x) for kv in numbers[kind].items() for x in kv))
    new = {}
    if numbers["INFO"]:
        known = of("INFO")
        new["info"] = F.transform_values("info", lambda k, v: _values_of(v, F.coalesce(F.try_element_at(known, k), F.lit("")), F.col("_count"), F.col("allele")))
    if any(k not in OWN for k in numbers["FORMAT"]):
        known = of("FORMAT")
        keys = F.filter("format", lambda k: ~k.isin(*OWN))
        one = lambda x: _values_of(x["v"], F.coalesce(F.try_element_at(known, x["k"]), F.lit("")), F.col("_count"), F.col("allele"))
        rest = lambda c: F.array_join(F.transform(F.arrays_zip(keys.alias("k"), F.split(c["rest"], ":").alias("v")), one), ":")
        new["calls"] = F.transform("calls", lambda c: c.withField("rest", F.when(c["rest"].isNotNull(), rest(c))))
    return rows.withColumns(new) if new else rows


def split_alleles(records: DataFrame, gt: Column | None = None) -> DataFrame:
    """One row per alternative: allele (from 1), alt, and genotypes remapped.

    ``gt`` is a column with one genotype; without it the records have an array ``calls`` whose genotypes are remapped.
    """
    rows = records.select("*", F.posexplode("alts").alias("_at", "alt")).withColumn("allele", (F.col("_at") + 1).cast("int")).drop("_at")
    if gt is not None:
        return rows.withColumn("gt", remap(F.col("gt"), F.col("allele")))
    calls = F.transform("calls", lambda c: c.withField("gt", remap(c["gt"], F.col("allele"))))
    return rows.withColumns({"calls": calls, "alts": F.array("alt")})


def reference_mismatches(records: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """Records whose REF isn't what the reference has there. chunks: contig, chunk, bases of ``size`` bases each.

    An equi-join on (contig, chunk); a REF that reaches into the next chunk is compared there too, piece by piece.
    """
    first, last = F.floor((F.col("pos") - 1) / size), F.floor((F.col("pos") - 2 + F.length("ref")) / size)
    pieces = records.select("rec", "contig", "pos", "ref", F.explode(F.sequence(first, last)).alias("chunk"))
    begin = F.greatest(F.col("pos") - 1, F.col("chunk") * size)
    end = F.least(F.col("pos") - 1 + F.length("ref"), (F.col("chunk") + 1) * size)
    want = F.substring(F.col("ref"), (begin - F.col("pos") + 2).cast("int"), (end - begin).cast("int"))
    have = F.substring(F.col("bases"), (begin - F.col("chunk") * size + 1).cast("int"), (end - begin).cast("int"))
    joined = pieces.join(chunks, ["contig", "chunk"], "left")
    return joined.where(F.upper(want) != F.coalesce(F.upper(have), F.lit(""))).select("rec").distinct()


# ---------------------------------------------------------------- left alignment


def trimmed(pos: int, ref: str, alt: str) -> tuple[int, str, str, str | None, str]:
    """(pos, ref, alt, moving, tail) of a variant without the ends that both alleles share.

    moving is ``-`` or ``+`` if nothing is left of one allele: a deletion or insertion of the other, which may move left
    from ``pos``; tail is the base behind it. Otherwise moving is null and the variant is as short as can be.
    """
    same = lambda x, y: x.upper() == y.upper()
    n = 0
    while n < min(len(ref), len(alt)) and same(ref[-1 - n], alt[-1 - n]):
        n += 1
    if n == len(ref) == len(alt):
        return pos, ref, alt, None, ""
    if n == min(len(ref), len(alt)):
        return pos, ref[: len(ref) - n], alt[: len(alt) - n], "-" if len(ref) > n else "+", ref[len(ref) - n]
    ref, alt = ref[: len(ref) - n], alt[: len(alt) - n]
    n = 0
    while n < min(len(ref), len(alt)) - 1 and same(ref[n], alt[n]):
        n += 1
    return pos + n, ref[n:], alt[n:], None, ""


def steps_left(bases: str, moved: str) -> int:
    """How many bases a sequence that is inserted or deleted behind ``bases`` can move left.

    It moves by one if the base before it is its last, which then becomes its first: so the bases read backwards must
    go on like the sequence read backwards again and again. Unknown bases match nothing.
    """
    before, cycle, done = bases.encode()[::-1], moved.upper().encode()[::-1], 0
    size = 64
    while done < len(before):
        part = np.frombuffer(before, np.uint8, min(size, len(before) - done), done)
        at = done % len(cycle)
        other = np.resize(np.frombuffer(cycle[at:] + cycle[:at], np.uint8), len(part))
        differ = np.flatnonzero((part != other) | (part == ord("N")))
        if len(differ):
            return done + int(differ[0])
        done += len(part)
        size *= 8
    return done


def _settled(pos: int, anchor: str, moved: str, moving: str, tail: str) -> tuple[int, str, str]:
    """A deletion or insertion at ``pos`` as alleles: with the base before it, or with that behind it where there is none."""
    alleles = (moved, "") if moving == "-" else ("", moved)
    return (pos - 1, *(anchor + x for x in alleles)) if pos > 1 else (1, *(x + tail for x in alleles))


MOVING = ("pos", "ref", "alt", "moving", "tail")


def _rows(kept: list[pa.Array], names: list[str], found: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*found, strict=True)) if found else [()] * len(MOVING)
    kinds = (pa.int64(), *[pa.string()] * 4)
    return pa.RecordBatch.from_arrays([*kept, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], [*names, *MOVING])


def _begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (rec, allele, contig, pos, ref, alt), trimmed."""
    for batch in batches:
        found = []
        for pos, ref, alt in zip(*(batch.column(k).to_pylist() for k in (3, 4, 5)), strict=True):
            plain = ref and alt and _BASES.fullmatch(ref) and _BASES.fullmatch(alt)
            pos, ref, alt, moving, tail = trimmed(pos, ref, alt) if plain else (pos, ref, alt, None, "")
            if moving and pos == 1:
                pos, ref, alt = _settled(1, "", ref or alt, moving, tail)
                moving = None
            found.append((pos, ref, alt, moving, tail))
        yield _rows([batch.column(k) for k in range(3)], ["rec", "allele", "contig"], found)


def _move(size: int):
    """Rows (rec, allele, contig, pos, ref, alt, moving, tail, chunk, bases), moved through the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                pos, ref, alt, moving, tail, chunk, bases = (batch.column(k)[i].as_py() for k in range(3, 10))
                moved, inside = ref or alt, pos - 1 - chunk * size
                if bases is None or len(bases) < inside:
                    raise ValueError(f"the reference has no base {pos - 1} of {batch.column(2)[i].as_py()}")
                k = steps_left(bases[:inside], moved)
                turn = k % len(moved)
                moved = moved[len(moved) - turn :] + moved[: len(moved) - turn]
                pos, tail = pos - k, moved[0] if k else tail
                if k < inside or chunk == 0:
                    pos, ref, alt = _settled(pos, bases[inside - k - 1] if k < inside else "", moved, moving, tail)
                    moving = None
                else:
                    ref, alt = (moved, "") if moving == "-" else ("", moved)
                found.append((pos, ref, alt, moving, tail))
            yield _rows([batch.column(k) for k in range(3)], ["rec", "allele", "contig"], found)

    return run


def left_aligned(variants: DataFrame, chunks: DataFrame, size: int) -> DataFrame:
    """(rec, allele, pos, ref, alt) of variants in their shortest, leftmost form. variants: rec, allele, contig, pos, ref, alt.

    chunks: contig, chunk, bases of ``size`` bases each, in upper case. Alleles that aren't spelt out (``<DEL>``, ``*``)
    stay as they are. At a contig's first base the base behind an indel takes the place of that before it.
    """
    prepare_workers(variants.sparkSession)
    shape = "rec long, allele int, contig string, pos long, ref string, alt string, moving string, tail string"
    rows = persisted(variants.select("rec", "allele", "contig", "pos", "ref", "alt").mapInArrow(_begin, shape), "indels")
    settled, tables = [rows.where("moving IS NULL")], [rows]
    while True:
        moving = rows.where("moving IS NOT NULL").withColumn("chunk", F.floor((F.col("pos") - 2) / size))
        found = moving.agg(F.count("*").alias("n"), F.min("chunk").alias("low"), F.max("chunk").alias("high")).first()
        if not found["n"]:
            break
        # Only chunks that can be asked for are read.
        near = chunks.where(F.col("chunk").between(found["low"], found["high"])).select("contig", "chunk", "bases")
        moving = F.broadcast(moving) if found["n"] <= BROADCAST_INDELS else moving.hint("merge")
        met = near.join(moving, ["contig", "chunk"], "right").select("rec", "allele", "contig", *MOVING, "chunk", "bases")
        rows = persisted(met.mapInArrow(_move(size), shape), "indels")
        tables.append(rows)
        settled.append(rows.where("moving IS NULL"))
        if len(settled) > ROUNDS:
            one = persisted(_all(settled), "settled")
            release(*(t for t in tables if t is not rows))
            settled, tables = [one], [one, rows]
    out = persisted(_all(settled).select("rec", "allele", "pos", "ref", "alt"), "aligned")
    release(*tables)
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def normalized(records: DataFrame, header: Header, chunks: DataFrame, size: int) -> DataFrame:
    """Records with one alternative each, in their shortest, leftmost form, sorted by contig and position.

    Alternatives of one record become records of their own; in each the others' alleles are missing, and values by
    allele or genotype are those of its own. ``rec`` is given anew and goes up in order. GateError for records out of order
    and for a REF that isn't the reference's. Only records that aren't single bases meet the reference to be moved.
    """
    if steps_back(records.select("rec", "contig_rank", "pos"), "rec", F.struct("contig_rank", "pos")).first()["steps_back"]:
        raise GateError("records aren't sorted by contig and position")
    wrong = reference_mismatches(records, chunks, size).join(records.select("rec", "contig", "pos", "ref"), "rec").orderBy("contig", "pos").limit(1).collect()
    if wrong:
        raise GateError(f"{wrong[0]['contig']}:{wrong[0]['pos']}: {wrong[0]['ref']} isn't what the reference has there")
    one = F.size("alts") <= 1
    single = records.where(one).withColumns({"allele": F.lit(1), "alt": F.get("alts", F.lit(0))})
    several = split_fields(split_alleles(records.where(~one).withColumn("_count", F.size("alts"))), header).drop("_count")
    rows = persisted(single.unionByName(several.select(single.columns)), "split")
    base = F.col("ref").rlike("^.$") & F.coalesce(F.col("alt").rlike("^.$"), F.lit(True))
    moved = left_aligned(rows.where(~base), chunks, size).withColumnsRenamed({c: f"_{c}" for c in ("pos", "ref", "alt")})
    fixed = rows.where(~base).join(moved, ["rec", "allele"]).withColumns({"pos": F.col("_pos"), "ref": F.col("_ref"), "alts": F.array("_alt")})
    out = rows.where(base).select(*columns_of(rows)).unionByName(fixed.select(*columns_of(rows)))
    order = ["contig_rank", "pos", "rec", "allele"]
    out = out.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("rec", F.monotonically_increasing_id())
    return out.select(*columns_of(records))
