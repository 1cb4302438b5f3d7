"""Variant records as BCF files: the counterpart of reading them.

Every partition of the sorted records is encoded and compressed by its own task into BGZF blocks, which lie in the shared
folder; blocks stand for themselves, so the file is their concatenation between a header's blocks and the end block.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locusflow.session import prepare_workers, remove, scratch
from locusflow.sources import files
from locusflow.sources.vcf import ABSENT, OWN, Header, _attributes, read_variants

#: Data bytes of a block.
BLOCK = 65_280
# Fixed values of the format: type codes, and how missing values and ends of vectors are stored.
INT8, INT16, INT32, FLOAT, CHAR = 1, 2, 3, 5, 7
_KINDS = ((INT8, np.int8), (INT16, np.int16), (INT32, np.int32))
MISSING_FLOAT, END_FLOAT = 0x7F800001, 0x7F800002


def bgzf_block(data: bytes, level: int = 6) -> bytes:
    """Up to BLOCK bytes as one block."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    return b"\x1f\x8b\x08\x04" + bytes(5) + b"\xff\x06\0BC\x02\0" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def bgzf_blocks(data: bytes, level: int = 6) -> bytes:
    return b"".join(bgzf_block(data[at : at + BLOCK], level) for at in range(0, len(data), BLOCK))


def _size(kind: int, n: int) -> bytes:
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _whole([n])


def _fit(low: int, high: int) -> tuple[int, type]:
    """The smallest type that holds a range, besides the values that stand for missing ones and ends."""
    return next((k, t) for k, t in _KINDS if low >= np.iinfo(t).min + 8 and high <= np.iinfo(t).max)


def _whole(values: list) -> bytes:
    """Whole numbers with their type; None is a missing one."""
    known = [v for v in values if v is not None] or [0]
    kind, dtype = _fit(min(known), max(known))
    return _size(kind, len(values)) + np.array([np.iinfo(dtype).min if v is None else v for v in values], dtype).tobytes()


def _text(value: str) -> bytes:
    raw = value.encode()
    return _size(CHAR, len(raw)) + raw


def _numbers(text: str, kind: str) -> list:
    return [None if x in (".", "") else int(x) if kind == "Integer" else float(x) for x in text.split(",")]


def _floats(values: list) -> bytes:
    return b"".join(struct.pack("<I", MISSING_FLOAT) if v is None else struct.pack("<f", v) for v in values)


class Encoder:
    """Encodes records under a header, whose lines number the strings and contigs that records refer to."""

    def __init__(self, h: Header):
        self.n = len(h.samples)
        self.strings = {s: i for i, s in h.strings.items()}
        self.contigs = {c: i for i, c in enumerate(h.names)}
        self.types = {}
        for line in h.lines:
            if m := re.match("##(INFO|FORMAT)=<", line):
                a = _attributes(line)
                self.types[m[1], a["ID"]] = a.get("Type", "String")

    def _value(self, text: str, kind: str) -> bytes:
        if kind == "Flag" or text == "":
            return b"\0"
        if kind == "Integer":
            return _whole(_numbers(text, kind))
        if kind == "Float":
            values = _numbers(text, kind)
            return _size(FLOAT, len(values)) + _floats(values)
        return _text(text)

    def _genotypes(self, calls: pa.StructArray) -> bytes:
        gt = calls.field("gt")
        lists = gt.to_pylist()
        phased = calls.field("phased").to_pylist()
        width = max([1, *(len(x) for x in lists if x is not None)])
        top = max([0, *(a for x in lists if x for a in x if a is not None)])
        kind, dtype = _fit(0, 2 * top + 3)
        out = np.full((self.n, width), np.iinfo(dtype).min + 1, dtype)
        for i, (x, p) in enumerate(zip(lists, phased, strict=True)):
            for j, a in enumerate(x if x is not None else [None]):
                out[i, j] = (0 if a is None else a + 1) << 1 | (1 if p and j else 0)
        return _size(kind, width) + out.tobytes()

    def _single(self, values: pa.Array) -> bytes:
        v = values.fill_null(ABSENT).to_numpy()
        known = v[v != ABSENT]
        kind, dtype = _fit(int(known.min()), int(known.max())) if len(known) else _fit(0, 0)
        return _size(kind, 1) + np.where(v == ABSENT, np.iinfo(dtype).min, v).astype(dtype).tobytes()

    def _others(self, texts: list[str], kind: str) -> bytes:
        if kind not in ("Integer", "Float"):
            raw = [t.encode() for t in texts]
            width = max([1, *map(len, raw)])
            return _size(CHAR, width) + b"".join(r.ljust(width, b"\0") for r in raw)
        rows = [_numbers(t, kind) for t in texts]
        width = max(map(len, rows))
        if kind == "Float":
            end = struct.pack("<I", END_FLOAT)
            return _size(FLOAT, width) + b"".join(_floats(r) + end * (width - len(r)) for r in rows)
        known = [x for r in rows for x in r if x is not None] or [0]
        code, dtype = _fit(min(known), max(known))
        low = np.iinfo(dtype).min
        return _size(code, width) + np.array([[*(low if x is None else x for x in r), *[low + 1] * (width - len(r))] for r in rows], dtype).tobytes()

    def record(self, r: dict, calls: pa.StructArray) -> bytes:
        """One record; r has all columns but the calls."""
        alleles, info, keys = [r["ref"], *r["alts"]], r["info"] or [], r["format"]
        qual = struct.pack("<I", MISSING_FLOAT) if r["qual"] is None else struct.pack("<f", r["qual"])
        shared = struct.pack("<iii", self.contigs[r["contig"]], r["pos"] - 1, len(r["ref"])) + qual + struct.pack("<II", len(alleles) << 16 | len(info), len(keys) << 24 | self.n)
        shared += _text(r["id"] or ".") + b"".join(map(_text, alleles))
        shared += _whole([self.strings[f] for f in r["filters"]]) if r["filters"] else b"\0"
        for k, v in info:
            shared += _whole([self.strings[k]]) + self._value(v, self.types.get(("INFO", k), "String"))
        others = [k for k in keys if k not in OWN]
        texts = [(t or "").split(":") for t in calls.field("rest").to_pylist()] if others else []
        individual = b""
        for k in keys:
            individual += _whole([self.strings[k]])
            if k == "GT":
                individual += self._genotypes(calls)
            elif k in OWN:
                individual += self._single(calls.field(k.lower()))
            else:
                at = others.index(k)
                individual += self._others([t[at] if at < len(t) else "." for t in texts], self.types.get(("FORMAT", k), "String"))
        return struct.pack("<II", len(shared), len(individual)) + shared + individual


def write_bcf(variants: DataFrame, header: Header, path: str) -> int:
    """Writes sorted records (as read_variants gives them) as one BCF file; returns their number.

    A filter, contig or key that the header doesn't declare is an error.
    """
    spark = variants.sparkSession
    prepare_workers(spark)
    folder = scratch(spark, "bcf")
    columns = ["contig", "pos", "id", "ref", "alts", "qual", "filters", F.map_entries("info").alias("info"), "format", "calls"]
    order = ["contig_rank", "pos", "rec"]
    rows = variants.repartitionByRange(*order).sortWithinPartitions(*order).select(*columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(header), TaskContext.get()
        fs, base = files.open_uri(folder)
        name, count, held, sink = f"{task.partitionId():06d}-{task.taskAttemptId()}", 0, bytearray(), None
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                r = row.drop_columns(["calls"]).to_pylist()[0]
                r["info"] = [(x["key"], x["value"]) for x in r["info"] or []]
                held += encoder.record(r, row.column("calls")[0].values)
                count += 1
                while len(held) >= BLOCK:
                    if sink is None:
                        fs.create_dir(base, recursive=True)
                        sink = fs.open_output_stream(f"{base}/{name}", compression=None)
                    sink.write(bgzf_block(bytes(held[:BLOCK])))
                    del held[:BLOCK]
        if held:
            if sink is None:
                fs.create_dir(base, recursive=True)
                sink = fs.open_output_stream(f"{base}/{name}", compression=None)
            sink.write(bgzf_blocks(bytes(held)))
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([task.partitionId()]), pa.array([name]), pa.array([count], pa.int64())], ["part", "name", "records"])

    # What counts is what the tasks that succeeded name.
    written = sorted(map(tuple, rows.mapInArrow(run, "part long, name string, records long").collect()))
    text = ("\n".join(header.lines) + "\n").encode() + b"\0"
    fs, target = files.open_uri(path)
    with fs.open_output_stream(f"{target}.draft", compression=None) as out:
        out.write(bgzf_blocks(b"BCF\x02\x02" + struct.pack("<I", len(text)) + text))
        for _, name, _ in written:
            source, base = files.open_uri(folder)
            with source.open_input_stream(f"{base}/{name}", compression=None) as part:
                while block := part.read(1 << 20):
                    out.write(block)
        out.write(files.BGZF_END)
    fs.move(f"{target}.draft", target)
    if written:
        remove(spark, folder)
    return sum(n for *_, n in written)


# ---- index

#: Bits of the smallest bins' positions, and levels of bins below the whole (fixed values of the format's usual index).
SHIFT, DEPTH = 14, 5


def _bins(begin: np.ndarray, end: np.ndarray, depth: int) -> np.ndarray:
    """The smallest bin that holds each [begin, end)."""
    out = np.zeros(len(begin), np.int64)
    open_ = np.ones(len(begin), bool)
    for level in range(depth, 0, -1):
        size = SHIFT + 3 * (depth - level)
        same = open_ & (begin >> size == (end - 1) >> size)
        out[same] = ((1 << 3 * level) - 1) // 7 + (begin[same] >> size)
        open_ &= ~same
    return out


def write_index(spark: SparkSession, path: str) -> str:
    """Writes the CSI index of a sorted BCF file beside it and returns its path.

    Tasks turn their part of the records into stretches of one bin each, so what comes to the driver grows with the bins
    that the genome has, not with the records.
    """
    records, _, header = read_variants(spark, path, calls="packed")
    longest = max((int(m[1]) for x in header.lines if (m := re.match("##contig=<.*length=([0-9]+)", x))), default=0)
    depth = DEPTH
    while longest > 1 << SHIFT + 3 * depth:
        depth += 1
    rows = records.select("contig_rank", (F.col("pos") - 1).alias("b"), (F.col("pos") - 1 + F.greatest(F.length("ref"), F.lit(1))).alias("e"), "rec")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank, b, e, rec = (c.to_numpy() for c in batch.columns)
            if not len(rank):
                continue
            bins = _bins(b, e, depth)
            cuts = np.flatnonzero(np.concatenate([[True], (bins[1:] != bins[:-1]) | (rank[1:] != rank[:-1]) | (rec[1:] < rec[:-1])]))
            last = np.append(cuts[1:], len(rank)) - 1
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in (rank[cuts], bins[cuts], rec[cuts], rec[last] + 1)], ["rank", "bin", "begin", "end"])

    prepare_workers(spark)
    found: dict[int, dict[int, list]] = {}
    for rank, number, begin, end in sorted(map(tuple, rows.mapInArrow(run, "rank long, bin long, begin long, end long").collect())):
        found.setdefault(rank, {}).setdefault(number, []).append((begin, end))
    out = [b"CSI\x01", struct.pack("<iiii", SHIFT, depth, 0, len(header.names))]
    for rank in range(len(header.names)):
        mine = found.get(rank, {})
        out.append(struct.pack("<i", len(mine)))
        for number, chunks in sorted(mine.items()):
            out.append(struct.pack("<IQi", number, 0, len(chunks)) + b"".join(struct.pack("<QQ", *c) for c in chunks))
    fs, target = files.open_uri(f"{path}.csi")
    with fs.open_output_stream(f"{target}.draft", compression=None) as f:
        f.write(bgzf_blocks(b"".join(out)) + files.BGZF_END)
    fs.move(f"{target}.draft", target)
    return f"{path}.csi"
