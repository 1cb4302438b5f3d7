"""Hardcalls in the PGEN format, with its tables of variants (.pvar) and samples (.psam).

A record is one variant: two bits a sample (0 to 2 alternatives, 3 missing), or the commonest call and a list of the samples
that differ. The header has each record's kind and length and where every 65,536th record begins, so any record is
found by adding up lengths of its block. Files are written by many tasks and read in parts.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual

from locusflow.operators.packed import ZERO
from locusflow.session import prepare_workers, remove, scratch
from locusflow.sources import files
from locusflow.sources.files import FormatError
from locusflow.sources.pushdown import allow_pushdown
from locusflow.sources.sequences import dense_numbers

# Fixed values of the format: the first bytes of a file whose records differ in length, records of a block, samples of a
# group of a list, and the kinds of records.
MAGIC, BLOCK, GROUP = b"\x6c\x1b\x10", 1 << 16, 64
PLAIN, ONE_BIT, LIKE_LAST, UNLIKE_LAST, LIST = 0, 1, 2, 3, 4
#: Kinds of reference alleles that the header speaks of: all known.
KNOWN = 1 << 6
SPLIT = 1 << 14


def _packed(values: np.ndarray) -> bytes:
    """Two bits a value, the first one lowest."""
    v = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    v[: len(values)] = values
    return (v[::4] | v[1::4] << 2 | v[2::4] << 4 | v[3::4] << 6).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    b = np.frombuffer(data, np.uint8, -(-n // 4))
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6], 1).ravel()[:n]


def _varint(n: int) -> bytes:
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _id_bytes(samples: int) -> int:
    return next(k for k in range(1, 5) if samples < 1 << 8 * k)


def difference_list(at: np.ndarray, calls: np.ndarray, samples: int) -> bytes:
    """Samples (ascending) and their calls: the first sample of each group as it is, the others as steps."""
    if not len(at):
        return b"\0"
    width, starts = _id_bytes(samples), at[::GROUP]
    steps = [b"".join(_varint(int(x)) for x in np.diff(at[g : g + GROUP])) for g in range(0, len(at), GROUP)]
    firsts = b"".join(int(x).to_bytes(width, "little") for x in starts)
    # All groups but the last say how many bytes their steps take beyond one each.
    extra = bytes(len(x) - (GROUP - 1) for x in steps[:-1])
    return _varint(len(at)) + firsts + extra + _packed(calls) + b"".join(steps)


def encode(calls: np.ndarray) -> tuple[int, bytes]:
    """(kind, bytes) of a record, the shorter of both ways."""
    n = len(calls)
    common = int(np.bincount(calls, minlength=4)[[0, 2, 3]].argmax())
    common = (0, 2, 3)[common]
    at = np.flatnonzero(calls != common)
    if len(at) * 5 < n * 2:
        short = difference_list(at, calls[at], n)
        if len(short) < -(-n // 4):
            return LIST | common, short
    return PLAIN, _packed(calls)


class _Bytes:
    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        if len(out) != n:
            raise FormatError("a PGEN record is cut off")
        self.at += n
        return out

    def varint(self) -> int:
        out = shift = 0
        while True:
            b = self.take(1)[0]
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    def differences(self, samples: int) -> tuple[np.ndarray, np.ndarray]:
        n = self.varint()
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint8)
        width, groups = _id_bytes(samples), -(-n // GROUP)
        firsts = [int.from_bytes(self.take(width), "little") for _ in range(groups)]
        self.take(groups - 1)
        calls = _unpacked(self.take(-(-n // 4)), n)
        at: list[int] = []
        for g, first in enumerate(firsts):
            at.append(first)
            for _ in range(min(GROUP, n - g * GROUP) - 1):
                at.append(at[-1] + self.varint())
        return np.array(at), calls


def decode(kind: int, data: bytes, samples: int, last: np.ndarray | None) -> np.ndarray:
    """A record's calls; ``last`` are those of the last record before it that doesn't lean on another."""
    if kind & 8:
        raise FormatError("records of several alternatives aren't supported")
    kind, b = kind & 7, _Bytes(data)
    if kind == PLAIN:
        return _unpacked(b.take(-(-samples // 4)), samples)
    if kind == ONE_BIT:
        code = b.take(1)[0]
        bits = np.unpackbits(np.frombuffer(b.take(-(-samples // 8)), np.uint8), bitorder="little")[:samples]
        out = (code // 4 + (code & 3) * bits).astype(np.uint8)
    elif kind in (LIKE_LAST, UNLIKE_LAST):
        if last is None:
            raise FormatError("a PGEN record leans on one that isn't there")
        out = last.copy()
    else:
        out = np.full(samples, kind & 3, np.uint8)
    at, calls = b.differences(samples)
    out[at] = calls
    if kind == UNLIKE_LAST:
        out = np.array([2, 1, 0, 3], np.uint8)[out]
    return out


# ---------------------------------------------------------------- reading


@dataclass
class Pgen:
    """A file's header: what it takes to find any record."""

    path: str
    variants: int
    samples: int
    control: int
    offsets: list[int]

    @classmethod
    def of(cls, path: str) -> Pgen:
        fs, p = files.open_uri(path)
        with fs.open_input_file(p) as f:
            head = f.read(12)
            if head[:3] != MAGIC or len(head) != 12:
                raise FormatError(f"{path}: not a PGEN file of records of any length")
            variants, samples, control = struct.unpack("<IIB", head[3:])
            if control >> 4 & 3:
                raise FormatError(f"{path}: variants of several alternatives aren't supported")
            blocks = -(-variants // BLOCK)
            return cls(path, variants, samples, control, list(struct.unpack(f"<{blocks}Q", f.read(8 * blocks))))

    def block(self, number: int) -> tuple[np.ndarray, np.ndarray]:
        """(kinds, ends) of a block's records; ends are bytes behind the block's first one."""
        fs, p = files.open_uri(self.path)
        at = 12 + 8 * len(self.offsets)
        size = lambda k: min(BLOCK, self.variants - k * BLOCK)
        wide, width = self.control & 15 >= 4, (self.control & 3) + 1
        part = lambda n: (n if wide else -(-n // 2)) + n * width + (-(-n // 8) if self.control >> 6 == 3 else 0)
        at += number * part(BLOCK)
        n = size(number)
        with fs.open_input_file(p) as f:
            f.seek(at)
            raw = np.frombuffer(f.read(n if wide else -(-n // 2)), np.uint8)
            lengths = np.zeros((n, 8), np.uint8)
            lengths[:, :width] = np.frombuffer(f.read(n * width), np.uint8).reshape(n, width)
        kinds = raw if wide else np.stack([raw & 15, raw >> 4], 1).ravel()[:n]
        return kinds, np.cumsum(lengths.view("<u8").ravel().astype(np.int64))

    def records(self, begin: int, end: int, wanted=None) -> Iterator[tuple[int, np.ndarray]]:
        """(number, calls) of the records from one number to another that are wanted; no others are read."""
        fs, p = files.open_uri(self.path)
        with fs.open_input_file(p) as f:
            for block in range(begin // BLOCK, -(-end // BLOCK)):
                kinds, ends = self.block(block)
                begins = np.concatenate([[0], ends[:-1]])
                leans = (kinds & 6) == LIKE_LAST
                base, last = -1, None

                def read(i: int) -> bytes:
                    f.seek(self.offsets[block] + int(begins[i]))  # noqa: B023
                    return f.read(int(ends[i] - begins[i]))  # noqa: B023

                for i in range(max(0, begin - block * BLOCK), min(len(kinds), end - block * BLOCK)):
                    if wanted is not None and block * BLOCK + i not in wanted:
                        continue
                    if leans[i]:
                        before = np.flatnonzero(~leans[:i])
                        if not len(before):
                            raise FormatError(f"{self.path}: record {block * BLOCK + i} leans on one that isn't there")
                        if before[-1] != base:
                            base = int(before[-1])
                            last = decode(int(kinds[base]), read(base), self.samples, None)
                        calls = decode(int(kinds[i]), read(i), self.samples, last)
                    else:
                        calls = decode(int(kinds[i]), read(i), self.samples, None)
                        base, last = i, calls
                    yield block * BLOCK + i, calls


@dataclass
class Part(InputPartition):
    begin: int
    end: int


class PgenReader(DataSourceReader):
    """Records in parts; conditions on ``at`` lead to their records alone."""

    def __init__(self, options: dict):
        self.path, self.split = options["path"], int(options.get("split", SPLIT))
        self.low, self.high, self.only = 0, 1 << 40, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if getattr(f, "attribute", None) != ("at",):
                yield f
            elif isinstance(f, (EqualTo, In)):
                found = frozenset([f.value] if isinstance(f, EqualTo) else f.value)
                self.only = found if self.only is None else self.only & found
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + 1 - isinstance(f, LessThan))
            elif not isinstance(f, IsNotNull):
                yield f

    def partitions(self) -> list[Part]:
        low, high = self.low, min(self.high, Pgen.of(self.path).variants)
        if self.only is not None:
            some = [x for x in self.only if low <= x < high]
            low, high = min(some, default=0), max(some, default=-1) + 1
        return [Part(a, min(a + self.split, high)) for a in range(low, high, self.split)] or [Part(0, 0)]

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in held], pa.int64()), pa.array([d for _, d in held], pa.binary())], ["at", "data"])

        for number, calls in Pgen.of(self.path).records(part.begin, part.end, self.only):
            held.append((number, (calls + ZERO).tobytes()))
            if len(held) >= 256:
                yield batch()
                held = []
        if held:
            yield batch()


class PgenSource(DataSource):
    """Data source ``pgen``: at (number of the record), data (a digit for each sample; 3 is missing). Option split: records of a part."""

    @classmethod
    def name(cls) -> str:
        return "pgen"

    def schema(self) -> str:
        return "at long, data binary"

    def reader(self, schema) -> PgenReader:
        return PgenReader(self.options)


def read_pgen(spark: SparkSession, prefix: str, **options) -> tuple[DataFrame, DataFrame]:
    """(calls (at, data), variants (at, contig, pos, id, ref, alt)) of ``prefix``.pgen and .pvar."""
    prepare_workers(spark)
    allow_pushdown(spark)
    spark.dataSource.register(PgenSource)
    lines = dense_numbers(spark.read.text(f"{prefix}.pvar").withColumn("at", F.lit(0).cast("long")), "at")
    head = lines.where(F.col("value").startswith("#")).agg(F.count("*"), F.max(F.when(F.col("value").startswith("#CHROM"), F.col("value")))).first()
    if not head[1] or head[1].split("\t")[:5] != ["#CHROM", "POS", "ID", "REF", "ALT"]:
        raise FormatError(f"{prefix}.pvar: no header")
    cells = F.split("value", "\t")
    sites = lines.where(~F.col("value").startswith("#")).select((F.col("at") - head[0]).alias("at"), cells[0].alias("contig"), cells[1].cast("long").alias("pos"), cells[2].alias("id"), cells[3].alias("ref"), cells[4].alias("alt"))
    return spark.read.format("pgen").options(**options).load(f"{prefix}.pgen"), sites


# ---------------------------------------------------------------- writing


def write_pgen(markers: DataFrame, order: list[str], samples: int, path: str) -> int:
    """Writes the calls (data) of markers in order as one PGEN file; returns the number of records.

    Ranges of markers are encoded and written by as many tasks; what comes back of a record is its kind and its length.
    """
    spark = markers.sparkSession
    prepare_workers(spark)
    folder = scratch(spark, "pgen")
    rows = markers.repartitionByRange(*order).sortWithinPartitions(*order).select("data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, kinds, lengths, sink = TaskContext.get(), bytearray(), [], None
        fs, base = files.open_uri(folder)
        name = f"{task.partitionId():06d}-{task.taskAttemptId()}"
        for batch in batches:
            for data in batch.column(0):
                kind, raw = encode(np.frombuffer(data.as_buffer(), np.uint8) - ZERO)
                if sink is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(raw)
                kinds.append(kind)
                lengths.append(len(raw))
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([name]), pa.array([bytes(kinds)], pa.binary()), pa.array([np.array(lengths, np.uint32).tobytes()], pa.binary())], ["part", "name", "kinds", "lengths"])

    written = sorted(((r["part"], r["name"], bytes(r["kinds"]), bytes(r["lengths"])) for r in rows.mapInArrow(run, "part long, name string, kinds binary, lengths binary").collect()))
    kinds = np.frombuffer(b"".join(w[2] for w in written), np.uint8)
    lengths = np.frombuffer(b"".join(w[3] for w in written), np.uint32)
    n, width = len(kinds), _id_bytes(int(lengths.max(initial=0)))
    tables = b""
    for at in range(0, n, BLOCK):
        k = np.zeros(-(-len(kinds[at : at + BLOCK]) // 2) * 2, np.uint8)
        k[: len(kinds[at : at + BLOCK])] = kinds[at : at + BLOCK]
        tables += (k[::2] | k[1::2] << 4).tobytes() + lengths[at : at + BLOCK].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()
    first = 12 + 8 * -(-n // BLOCK) + len(tables)
    starts = first + np.concatenate([[0], np.cumsum(lengths.astype(np.int64))])[:-1][::BLOCK] if n else np.empty(0, np.int64)
    fs, target = files.open_uri(path)
    with fs.open_output_stream(f"{target}.draft", compression=None) as out:
        out.write(MAGIC + struct.pack("<IIB", n, samples, width - 1 | KNOWN) + starts.astype("<u8").tobytes() + tables)
        for _, name, _, _ in written:
            source, base = files.open_uri(folder)
            with source.open_input_stream(f"{base}/{name}", compression=None) as part:
                while block := part.read(1 << 20):
                    out.write(block)
    fs.move(f"{target}.draft", target)
    if written:
        remove(spark, folder)
    return n
