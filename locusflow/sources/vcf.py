"""Variant records of VCF, compressed VCF and BCF files as a Spark data source, and a text sink.

``spark.read.format("vcf").load(path)`` after :func:`register`. A record is one row; its calls are an array in the order
of the header's samples, or, with ``calls=packed``, bytes for kernels that work on whole records. Plain files and BGZF files
(VCF or BCF) are read in parts; other gzip files can't be split. ``rec`` goes up in input order: it is a record's number,
its byte offset in a plain file, or its virtual offset in a BGZF file.
"""

from __future__ import annotations

import io
import json
import struct
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusflow.sources import bgzf, files
from locusflow.sources.bgzf import NOWHERE, Stream
from locusflow.sources.files import FormatError
from locusflow.sources.pushdown import Places, allow_pushdown
from locusflow.session import prepare_workers

CALL = "struct<gt:array<int>,phased:boolean,dp:int,gq:int,rest:string>"
SITE = "rec long, contig string, contig_rank int, pos long, id string, ref string, alts array<string>, qual double, filters array<string>, info map<string,string>, format array<string>"
SCHEMA = f"{SITE}, calls array<{CALL}>"
#: One byte for each call (see codes_of), and depths and qualities as 32-bit integers, ABSENT where there is none.
PACKED = f"{SITE}, codes binary, dp binary, gq binary"
_CALL = pa.struct([("gt", pa.list_(pa.int32())), ("phased", pa.bool_()), ("dp", pa.int32()), ("gq", pa.int32()), ("rest", pa.string())])
_SITE = [("rec", pa.int64()), ("contig", pa.string()), ("contig_rank", pa.int32()), ("pos", pa.int64()), ("id", pa.string()), ("ref", pa.string()), ("alts", pa.list_(pa.string())), ("qual", pa.float64()), ("filters", pa.list_(pa.string())), ("info", pa.map_(pa.string(), pa.string())), ("format", pa.list_(pa.string()))]
SPLIT = 64 << 20
ROWS = 256
#: Calls of a batch at most (one record at least).
CALLS, PACKED_CALLS = 1 << 18, 1 << 22
#: Codes of calls: a missing allele, the number of alternatives of a call with two alleles plus one, an allele that isn't 0
#: or 1, another number of alleles.
MISSING_CALL, HOM_REF, HET, HOM_ALT, OTHER_ALLELE, OTHER_PLOIDY = 0, 1, 2, 3, 254, 255
ABSENT = -(1 << 31)
#: Keys whose values have fields of their own.
OWN = ("GT", "DP", "GQ")


@dataclass
class Header:
    """What a file says about itself."""

    samples: list[str]
    contigs: dict[str, int] = field(default_factory=dict)
    formats: dict[str, tuple[str, str]] = field(default_factory=dict)
    strings: dict[int, str] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)
    size: int = 0


def _attributes(line: str) -> dict[str, str]:
    """Keys and values of ##KEY=<...>, commas inside quotes respected."""
    body = line[line.index("<") + 1 : line.rindex(">")]
    out, key, value, quoted, at_key = {}, "", "", False, True
    for c in body + ",":
        if c == '"':
            quoted = not quoted
        elif c == "," and not quoted:
            out[key], key, value, at_key = value, "", "", True
        elif c == "=" and at_key:
            at_key = False
        elif at_key:
            key += c
        else:
            value += c
    return out


def parse_header(lines: list[str], path: str) -> Header:
    """Raises for a missing column line, no samples, or a sample that occurs twice."""
    if not lines or not lines[0].startswith("##fileformat=VCF"):
        raise FormatError(f"{path}: not a VCF or BCF file")
    columns = lines[-1].split("\t")
    if columns[0] != "#CHROM" or len(columns) < 8:
        raise FormatError(f"{path}: no column line")
    h = Header(columns[9:], lines=lines, size=sum(len(x.encode()) + 1 for x in lines))
    if not all(h.samples) or not h.samples:
        raise FormatError(f"{path}: no samples")
    if len(set(h.samples)) != len(h.samples):
        raise FormatError(f"{path}: a sample occurs twice")
    h.strings[0] = "PASS"
    numbers = {"PASS": 0}
    for line in lines:
        kind = line[2 : line.find("=")] if line.startswith("##") and "=<" in line else ""
        if kind not in ("FILTER", "INFO", "FORMAT", "contig"):
            continue
        a = _attributes(line)
        if kind == "contig":
            h.contigs.setdefault(a["ID"], len(h.contigs))
            h.names.append(a["ID"])
            continue
        number = int(a["IDX"]) if "IDX" in a else numbers.setdefault(a["ID"], max(numbers.values()) + 1)
        numbers[a["ID"]] = number
        h.strings[number] = a["ID"]
        if kind == "FORMAT":
            h.formats[a["ID"]] = (a.get("Number", ""), a.get("Type", ""))
    return h


def read_header(path: str) -> Header:
    """The header of a file, read where this is called."""
    if files.size_of(path) == 0:
        raise FormatError(f"{path}: empty file")
    if _is_bcf(path):
        reader = files.Reader(files.data_of(path), path)
        return _bcf_header(reader, path)
    lines = []
    for raw in files.lines_of(path):
        if not raw.startswith(b"#"):
            break
        lines.append(raw.decode())
        if raw.startswith(b"#CHROM"):
            break
    return parse_header(lines, path)


def header_of(h: Header, samples: list[str]) -> Header:
    """The same header for some of its samples."""
    lines = [*h.lines[:-1], "\t".join([*h.lines[-1].split("\t")[:9], *samples])]
    return parse_header(lines, "a header of fewer samples")


def numbers_of(h: Header, kind: str) -> dict[str, str]:
    """How many values each key of a kind (INFO or FORMAT) has, as the header declares it."""
    declared = [_attributes(x) for x in h.lines if x.startswith(f"##{kind}=<")]
    return {a["ID"]: a.get("Number", "") for a in declared}


def require_format(h: Header, key: str, number: str, kind: str) -> None:
    """Raises if a FORMAT key is declared in another way; a key that isn't declared is fine."""
    if key in h.formats and h.formats[key] != (number, kind):
        raise FormatError(f"FORMAT {key} must be Number={number}, Type={kind}")


# ---- calls


def code_of(alleles: list | None) -> int:
    """A call's code; alleles are None where missing."""
    if alleles and any(x is not None and not 0 <= x <= 1 for x in alleles):
        return OTHER_ALLELE
    if alleles is None or any(x is None for x in alleles):
        return MISSING_CALL
    return HOM_REF + sum(alleles) if len(alleles) == 2 else OTHER_PLOIDY


def parse_call(text: str, keys: tuple[str, ...]) -> dict:
    """A call's alleles (null where missing), phase, depth, quality, and the values of all other keys as text."""
    values = dict(zip(keys, text.split(":")))
    gt = values.get("GT")
    alleles = None if gt is None else [None if a == "." else int(a) for a in gt.replace("|", "/").split("/")]
    whole = lambda v: None if v in (None, "", ".") else int(v)
    rest = ":".join(values.get(k, ".") for k in keys if k not in OWN) if any(k not in OWN for k in keys) else None
    return {"gt": alleles, "phased": bool(gt) and "|" in gt, "dp": whole(values.get("DP")), "gq": whole(values.get("GQ")), "rest": rest}


class Batch:
    """Records whose calls are columns: what is equal is parsed once."""

    def __init__(self, samples: int, packed: str | None):
        self.n, self.packed = samples, packed is not None
        self.wants = [k in (packed or "").split(",") for k in ("dp", "gq")]
        self.sites: list[dict] = []
        self.flat: list = []  # pieces of the calls' array, or (codes, dp, gq) of a record

    @property
    def full(self) -> bool:
        return len(self.sites) >= ROWS or (len(self.sites) + 1) * self.n > (PACKED_CALLS if self.packed else CALLS)

    def add_texts(self, texts: list[bytes], keys: tuple[str, ...]) -> None:
        """The calls of some records with the same keys, each a piece of a line."""
        data = b"\t".join([*texts, b""])
        ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 9) + 1
        offsets = np.concatenate([[0], ends]).astype(np.int64)
        values = pa.LargeStringArray.from_buffers(len(ends), pa.py_buffer(offsets), pa.py_buffer(data)).dictionary_encode()
        calls = [parse_call(t[:-1], keys) for t in values.dictionary.to_pylist()]
        self._take(calls, values.indices.to_numpy())

    def _take(self, calls: list[dict], at: np.ndarray) -> None:
        if not self.packed:
            self.flat.append(pa.array(calls, _CALL).take(pa.array(at)))
            return
        tables = [np.array([code_of(c["gt"]) for c in calls], np.uint8)[at]]
        tables += [np.array([ABSENT if c[k] is None else c[k] for c in calls], np.int32)[at] if want else None for k, want in zip(("dp", "gq"), self.wants, strict=True)]
        rows = range(0, len(at), self.n)
        self.flat += [tuple(None if t is None else t[r : r + self.n] for t in tables) for r in rows]

    def rows(self) -> pa.RecordBatch:
        site = {n: pa.array([s[n] for s in self.sites], k) for n, k in _SITE}
        if self.packed:
            for i, n in enumerate(("codes", "dp", "gq")):
                site[n] = pa.array([None if x[i] is None else x[i].tobytes() for x in self.flat], pa.binary())
        else:
            calls = pa.concat_arrays(self.flat)
            site["calls"] = pa.ListArray.from_arrays(pa.array(np.arange(len(self.sites) + 1, dtype=np.int32) * self.n), calls)
        self.sites, self.flat = [], []
        return pa.RecordBatch.from_pydict(site)


# ---- text


def text_batches(lines: Iterator[tuple[int, bytes]], h: Header, path: str, packed: str | None, wanted, keep: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the records in numbered lines; wanted tests a contig and a position, keep are the places of the samples asked for."""
    batch, texts, form = Batch(len(h.samples) if keep is None else len(keep), packed), [], b""

    def parsed() -> None:
        nonlocal texts
        try:
            if texts:
                batch.add_texts(texts, tuple(form.decode().split(":")))
        except ValueError as e:
            raise FormatError(f"{path}, record {batch.sites[-len(texts)]['rec']} or one of the {len(texts) - 1} after it: {e}") from e
        texts = []

    for rec, raw in lines:
        raw = raw.removesuffix(b"\r")
        if not raw or raw.startswith(b"#"):
            continue
        c = raw.split(b"\t", 9)
        found = len(c) - 1 + (c[9].count(b"\t") + 1 if len(c) == 10 else 1)
        if found != 9 + len(h.samples):
            raise FormatError(f"{path}, record {rec}: {found} columns, should be {9 + len(h.samples)}")
        try:
            contig, pos, ident, ref, alt, qual, filters, info = (x.decode() for x in c[:8])
            if not wanted(contig, int(pos), len(ref)):
                continue
            if c[8] != form:
                parsed()
                form = c[8]
            pairs = {} if info == "." else {k: v for k, _, v in (x.partition("=") for x in info.split(";"))}
            batch.sites.append({
                "rec": rec, "contig": contig, "contig_rank": h.contigs.get(contig, len(h.contigs)), "pos": int(pos), "id": None if ident == "." else ident, "ref": ref, "alts": [] if alt == "." else alt.split(","),
                "qual": None if qual == "." else float(qual), "filters": [] if filters == "." else filters.split(";"), "info": list(pairs.items()), "format": form.decode().split(":"),
            })
        except ValueError as e:
            raise FormatError(f"{path}, record {rec}: {e}") from e
        if keep is not None:
            cells = c[9].split(b"\t")
            c[9] = b"\t".join([cells[i] for i in keep])
        texts.append(c[9])
        if batch.full:
            parsed()
            yield batch.rows()
    parsed()
    if batch.sites:
        yield batch.rows()


# ---- BCF


def _is_bcf(path: str) -> bool:
    if not files.is_gzip(path):
        return files.head(path, 3) == b"BCF"
    return next(files.data_of(path), b"")[:3] == b"BCF"


def _bcf_header(reader: files.Reader, path: str) -> Header:
    magic = reader.take(5)
    if magic[:4] != b"BCF\x02":
        raise FormatError(f"{path}: not BCF version 2")
    (size,) = reader.unpack("<I")
    text = reader.take(size).rstrip(b"\0").decode()
    return parse_header(text.rstrip("\n").split("\n"), path)


_SIZES = {1: 1, 2: 2, 3: 4, 5: 4, 7: 1}
_MISSING = {1: -128, 2: -32768, 3: -2147483648}


class _Typed:
    """Typed values of BCF in a buffer."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def descriptor(self) -> tuple[int, int]:
        b = self.data[self.at]
        self.at += 1
        kind, n = b & 15, b >> 4
        if n == 15:
            n = self.value()
            n = n if isinstance(n, int) else n[0]
        return kind, n

    def raw(self, kind: int, n: int) -> list | str | None:
        if kind == 0 or n == 0:
            return None
        size = _SIZES[kind] * n
        part = self.data[self.at : self.at + size]
        if len(part) != size:
            raise FormatError("truncated value")
        self.at += size
        if kind == 7:
            return part.rstrip(b"\0").decode()
        if kind == 5:
            bits = struct.unpack(f"<{n}I", part)
            values = struct.unpack(f"<{n}f", part)
            return [None if b == 0x7F800001 else v for b, v in zip(bits, values) if b != 0x7F800002]
        values = struct.unpack(f"<{n}{'bhi'[kind - 1]}", part)
        missing = _MISSING[kind]
        return [None if x == missing else x for x in values if x != missing + 1]

    def value(self):
        kind, n = self.descriptor()
        out = self.raw(kind, n)
        return out[0] if isinstance(out, list) and n == 1 and out else out


_DTYPES = {1: np.int8, 2: np.int16, 3: np.int32}


def _matrix(x: _Typed, n: int) -> tuple[int, np.ndarray | None]:
    """(kind, values) of a FORMAT field: a row for each sample, as they are stored."""
    kind, width = x.descriptor()
    size = _SIZES.get(kind, 0) * width * n
    part = np.frombuffer(x.data, np.uint8, size, x.at) if size else None
    x.at += size
    if part is None or kind in (5, 7):
        return kind, None if part is None else part.reshape(n, -1)
    return kind, part.view(_DTYPES[kind]).reshape(n, width)


def _alleles(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(is there an allele, its number, is it missing) of stored genotypes."""
    low = np.iinfo(values.dtype).min
    there = values != low + 1
    missing = (values == low) | (values >> 1 == 0)
    return there, (values >> 1).astype(np.int32) - 1, missing & there


_pairs = np.zeros(0, np.uint8)


def _pair_codes() -> np.ndarray:
    """Codes of all calls with two alleles of one byte each, by the two bytes as one number."""
    global _pairs
    if not len(_pairs):
        _pairs = codes_of(np.arange(1 << 16, dtype="<u2").view(np.int8).reshape(-1, 2), False)
    return _pairs


def codes_of(values: np.ndarray, quick: bool = True) -> np.ndarray:
    """The code of each row of stored genotypes."""
    if quick and values.dtype == np.int8 and values.shape[1] == 2:
        return _pair_codes()[np.ascontiguousarray(values).view("<u2").ravel()]
    there, number, missing = _alleles(values)
    known = there & ~missing
    count = there.sum(1)
    out = np.where(missing.any(1), MISSING_CALL, np.where(count == 2, HOM_REF + np.where(known, number, 0).sum(1), OTHER_PLOIDY))
    return np.where((known & ((number < 0) | (number > 1))).any(1), OTHER_ALLELE, out).astype(np.uint8)


def _first(field: tuple[int, np.ndarray | None] | None, n: int) -> np.ndarray:
    """The first value of each sample, ABSENT where there is none."""
    if field is None or field[1] is None or field[0] not in _DTYPES:
        return np.full(n, ABSENT, np.int32)
    low = np.iinfo(field[1].dtype).min
    v = field[1][:, 0]
    return np.where(v <= low + 1, ABSENT, v.astype(np.int32))


def _texts(field: tuple[int, np.ndarray | None], n: int) -> pa.Array:
    """A field's values as text, equal ones made once."""
    kind, values = field
    if values is None:
        return pa.array(["."] * n)
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(n, -1)
    rows, at = np.unique(raw.view(np.dtype((np.void, raw.shape[1]))).ravel(), return_inverse=True)
    width = raw.shape[1] // _SIZES[kind]
    out = []
    for r in rows:
        v = _Typed(r.tobytes()).raw(kind, width)
        if isinstance(v, list):
            v = ",".join("." if y is None else f"{y:g}" if isinstance(y, float) else str(y) for y in v)
        out.append(v or ".")
    return pa.array(out).take(pa.array(at.ravel()))


def _calls(fields: dict[str, tuple], n: int) -> pa.StructArray:
    """The calls of a record."""
    number = lambda v: pa.array(v, mask=v == ABSENT)
    _, gt = fields.get("GT", (0, None))
    if gt is None:
        alleles = pa.array([[] if "GT" in fields else None] * n, pa.list_(pa.int32()))
        phased = np.zeros(n, bool)
    else:
        there, values, missing = _alleles(gt)
        offsets = np.concatenate([[0], np.cumsum(there.sum(1))]).astype(np.int32)
        alleles = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values[there], mask=missing[there]))
        phased = (there[:, 1:] & (gt[:, 1:] & 1 == 1)).any(1)
    others = [_texts(f, n) for k, f in fields.items() if k not in OWN]
    rest = pc.binary_join_element_wise(*others, ":") if others else pa.nulls(n, pa.string())
    return pa.StructArray.from_arrays([alleles, pa.array(phased), number(_first(fields.get("DP"), n)), number(_first(fields.get("GQ"), n)), rest], fields=list(_CALL))


def _bcf_record(shared: bytes, individual: bytes, h: Header, path: str, rec: int, batch: Batch, wanted, keep: np.ndarray | None = None) -> None:
    s, x = _Typed(shared), _Typed(individual)
    chrom, pos, _, qual_bits, alleles_info, samples_formats = struct.unpack("<iiiIII", shared[:24])
    s.at = 24
    n_allele, n_info = alleles_info >> 16, alleles_info & 0xFFFF
    n_format, n_sample = samples_formats >> 24, samples_formats & 0xFFFFFF
    if n_sample != len(h.samples) or not 0 <= chrom < len(h.names):
        raise FormatError(f"{path}, record {rec}: doesn't fit the header")
    ident = s.value()
    alleles = [s.value() or "" for _ in range(n_allele)]
    if not wanted(h.names[chrom], pos + 1, len(alleles[0]) if alleles else 1):
        return
    filters = s.value()
    filters = [] if filters is None else [filters] if isinstance(filters, int) else filters
    info = {}
    for _ in range(n_info):
        key = h.strings[s.value()]
        v = s.value()
        info[key] = "" if v is None else v if isinstance(v, str) else ",".join("." if y is None else f"{y:g}" if isinstance(y, float) else str(y) for y in (v if isinstance(v, list) else [v]))
    fields = {}
    for _ in range(n_format):
        key = h.strings[x.value()]
        kind, values = _matrix(x, n_sample)
        fields[key] = (kind, values if keep is None or values is None else values[keep])
    qual = None if qual_bits == 0x7F800001 else struct.unpack("<f", struct.pack("<I", qual_bits))[0]
    batch.sites.append({"rec": rec, "contig": h.names[chrom], "contig_rank": chrom, "pos": pos + 1, "id": None if ident in (None, ".") else ident, "ref": alleles[0] if alleles else "", "alts": alleles[1:], "qual": qual, "filters": [h.strings[f] for f in filters], "info": list(info.items()), "format": list(fields)})
    if batch.packed:
        _, gt = fields.get("GT", (0, None))
        none = np.full(batch.n, OTHER_PLOIDY if "GT" in fields else MISSING_CALL, np.uint8)
        batch.flat.append((none if gt is None else codes_of(gt), *(_first(fields.get(k), batch.n) if want else None for k, want in zip(("DP", "GQ"), batch.wants, strict=True))))
    else:
        batch.flat.append(_calls(fields, batch.n))


def _plausible(stream: Stream, at: int, h: Header, deep: int = 4) -> bool:
    """Whether a record may begin at an offset from the present place, judged by it and the ones after it."""
    for _ in range(deep):
        if not stream.reach(at + 32):
            return len(stream.held) == at
        shared, individual, chrom, pos, _, _, alleles_info, samples_formats = struct.unpack_from("<IIiiiIII", stream.held, at)
        if not (24 <= shared < 1 << 28 and individual < 1 << 31 and 0 <= chrom < len(h.names) and pos >= -1 and alleles_info >> 16 and samples_formats & 0xFFFFFF == len(h.samples) and individual >= 3 * (samples_formats >> 24)):
            return False
        at += 8 + shared + individual
    return stream.reach(at)


def sync(path: str, block: int, h: Header) -> int:
    """The virtual offset of the first record that begins in or after a block; NOWHERE if there is none.

    Records carry no mark, so a place counts if a chain of records that fit the header begins there. The part before
    finds its end by following records from its own begin and raises unless it arrives at this very place.
    """
    stream = Stream(path, block)
    mark = len(h.samples).to_bytes(3, "little")
    at = 28
    while True:
        found = stream.held.find(mark, at)
        if found < 0:
            at = max(at, len(stream.held) - 2)
            if not stream.reach(len(stream.held) + 1):
                return NOWHERE
        elif _plausible(stream, found - 28, h):
            stream.skip(found - 28)
            return stream.place()
        else:
            at = found + 1


def bcf_batches(path: str, begin: int | None, end: int | None, h: Header, packed: str | None, wanted, exact: bool = True, keep: list[int] | None = None) -> Iterator[pa.RecordBatch]:
    """Batches of the records that begin between two virtual offsets; ``exact`` says that a record begins at the second."""
    batch = Batch(len(h.samples) if keep is None else len(keep), packed)
    places = None if keep is None else np.array(keep, np.int64)
    stream = Stream(path, 0 if begin is None else begin >> 16)
    if begin is None:
        stream.reach(9)
        size = 9 + struct.unpack_from("<I", stream.held, 5)[0]
        stream.reach(size)
        stream.skip(size)
    else:
        stream.reach((begin & 0xFFFF) + 1)
        stream.skip(begin & 0xFFFF)
    count = 0
    while stream.reach(1):
        place = stream.place()
        if end is not None and place >= end:
            if exact and place != end:
                raise FormatError(f"{path}: records can't be told apart at {end >> 16}; read it in one part")
            break
        if not stream.reach(8):
            raise FormatError(f"{path}: truncated record")
        shared, individual = struct.unpack_from("<II", stream.held)
        if not stream.reach(8 + shared + individual) or shared < 24:
            raise FormatError(f"{path}: truncated record")
        _bcf_record(bytes(stream.held[8 : 8 + shared]), bytes(stream.held[8 + shared : 8 + shared + individual]), h, path, count if stream.plain else place, batch, wanted, places)
        stream.skip(8 + shared + individual)
        count += 1
        if batch.full:
            yield batch.rows()
    if batch.sites:
        yield batch.rows()


# ---- source


@dataclass
class Part(InputPartition):
    """A part of a file. kind: whole, bytes (of a plain file), blocks (of a BGZF text), records (of a BCF file)."""

    path: str
    kind: str
    begin: int = 0
    end: int | None = None


class VcfReader(Places, DataSourceReader):
    index_ends = (".csi", ".tbi")

    def __init__(self, options: dict):
        self.paths = [p for p in options["path"].split(",") if p]
        self.split = int(options.get("split", SPLIT))
        self.packed = options.get("qualities", "") if options.get("calls") == "packed" else None
        self.regions = [bgzf.parse_region(r) for r in options.get("regions", "").split(";") if r]
        self.index = options.get("index")
        self.samples = json.loads(options["samples"]) if "samples" in options else None

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            h = read_header(path)
            if self.nothing():
                continue
            size, bcf = files.size_of(path), _is_bcf(path)
            if not files.is_bgzf(path):
                if files.is_gzip(path) or bcf or size <= self.split:
                    out.append(Part(path, "whole"))
                else:
                    out += [Part(path, "bytes", at, min(at + self.split, size)) for at in range(0, size, self.split)]
                continue
            files.require_bgzf_end(path)
            kind = "records" if bcf else "blocks"
            if (self.regions or self.contigs is not None) and (index := self.index_of(path, self.index)):
                out += [Part(path, f"indexed {kind}", a, b) for a, b in self.chunks(index, h.names, self.regions)]
            elif size <= self.split:
                out.append(Part(path, "whole"))
            else:
                out += [Part(path, kind, at, min(at + self.split, size)) for at in range(0, size, self.split)]
        # A source without parts is read as one that has none in particular.
        return out or [Part("", "nothing")]

    def _lines(self, part: Part) -> Iterator[tuple[int, bytes]]:
        """Numbered lines of a part of a text."""
        if part.kind == "whole":
            if files.is_bgzf(part.path):
                yield from bgzf.lines(part.path, 0, files.size_of(part.path))
            else:
                rec = 0
                for raw in files.lines_of(part.path):
                    yield rec, raw
                    rec += not raw.startswith(b"#")
        elif part.kind == "blocks":
            yield from bgzf.lines(part.path, bgzf.next_block(part.path, part.begin), bgzf.next_block(part.path, part.end))
        elif part.kind == "indexed blocks":
            first = part.begin & 0xFFFF
            for at, raw in _lines_from(part.path, part.begin >> 16, first):
                if at >= part.end:
                    return
                yield at, raw
        else:
            fs, p = files.open_uri(part.path)
            with io.BufferedReader(fs.open_input_file(p), 1 << 20) as f:
                # A line belongs to the part in which it begins.
                at = part.begin
                if at:
                    f.seek(at - 1)
                    at += len(f.readline()) - 1
                f.seek(at)
                while at < part.end and (raw := f.readline()):
                    yield at, raw.rstrip(b"\r\n")
                    at += len(raw)

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        if part.kind == "nothing":
            return
        h, wanted = read_header(part.path), self.wanted(self.regions)
        keep = None if self.samples is None else places_of(h, self.samples, part.path)
        if not _is_bcf(part.path):
            yield from text_batches(self._lines(part), h, part.path, self.packed, wanted, keep)
        elif part.kind == "whole":
            yield from bcf_batches(part.path, None, None, h, self.packed, wanted, keep=keep)
        elif part.kind == "indexed records":
            yield from bcf_batches(part.path, part.begin, part.end, h, self.packed, wanted, False, keep)
        else:
            # The first records lie behind the header, and no part begins before them.
            least, whole = _records_begin(part.path), files.size_of(part.path)
            first, last = ((least if at == 0 else max(sync(part.path, block, h), least)) if (block := bgzf.next_block(part.path, at)) < whole else NOWHERE for at in (part.begin, part.end))
            if first < last:
                yield from bcf_batches(part.path, first, last, h, self.packed, wanted, keep=keep)


def places_of(h: Header, samples: list[str], path: str) -> list[int]:
    """Where some samples stand in a file."""
    place = {x: i for i, x in enumerate(h.samples)}
    if unknown := [x for x in samples if x not in place]:
        raise FormatError(f"{path}: no sample {unknown[0]!r}")
    if not samples or len(set(samples)) != len(samples):
        raise FormatError(f"{path}: no samples are asked for, or one twice")
    return [place[x] for x in samples]


def _records_begin(path: str) -> int:
    """The virtual offset of a BCF file's first record."""
    stream = Stream(path, 0)
    stream.reach(9)
    size = 9 + struct.unpack_from("<I", stream.held, 5)[0]
    stream.reach(size)
    stream.skip(size)
    return stream.place()


def _lines_from(path: str, block: int, skip: int) -> Iterator[tuple[int, bytes]]:
    """Numbered lines from a place on at which a line begins."""
    for at, raw in bgzf.lines(path, block, files.size_of(path), whole=True):
        if at >= block << 16 | skip:
            yield at, raw


class VcfSource(DataSource):
    """Data source ``vcf``.

    Options: path (one or several, with commas between), split (bytes of a part), regions (``contig:from-to``, 1-based,
    semicolons between: records that overlap one), index (of the one path; without it the one beside the file), calls
    (``packed`` for bytes instead of arrays), qualities (which of dp and gq packed rows carry) and samples (a JSON list: only
    their calls are decoded, in that order). Conditions on contig and pos are taken over from Spark, which reads only
    their chunks of an indexed file; that needs ``spark.sql.python.filterPushdown.enabled``, which read_variants sets.
    """

    @classmethod
    def name(cls) -> str:
        return "vcf"

    def schema(self) -> str:
        return PACKED if self.options.get("calls") == "packed" else SCHEMA

    def reader(self, schema) -> VcfReader:
        return VcfReader(self.options)


def read_variants(spark: SparkSession, path: str, samples: list[str] | None = None, **options) -> tuple[DataFrame, DataFrame, Header]:
    """(records, samples (idx, sample), header) of a file, of some of its samples if they are named."""
    prepare_workers(spark)
    allow_pushdown(spark)
    spark.dataSource.register(VcfSource)
    h = read_header(path)
    if samples is not None:
        places_of(h, samples, path)
        h, options = header_of(h, samples), options | {"samples": json.dumps(samples)}
    people = spark.createDataFrame(list(enumerate(h.samples)), "idx int, sample string")
    return spark.read.format("vcf").options(**options).load(path), people, h


# ---- sink


def vcf_lines(variants: DataFrame) -> Column:
    """The text of each record, its calls with the keys of its format."""
    dot = lambda c: F.coalesce(c.cast("string"), F.lit("."))
    joined = lambda c, sep: F.when(F.size(c) == 0, ".").otherwise(F.array_join(c, sep, "."))
    pair = lambda e: F.when(e["value"] == "", e["key"]).otherwise(F.concat(e["key"], F.lit("="), e["value"]))
    info = joined(F.transform(F.map_entries("info"), pair), ";")
    # GT is first in the format, and the other keys stand in the order in which a call's parts are joined here.
    has = lambda k: F.array_contains("format", k)
    others = F.filter("format", lambda k: ~k.isin(*OWN))
    keys = F.concat(F.array(F.lit("GT")), *(F.when(has(k), F.array(F.lit(k))).otherwise(F.array()) for k in OWN[1:]), others)
    calls = F.transform("calls", lambda c: F.concat_ws(":", _gt_text(c), *(F.when(has(k), dot(c[k.lower()])) for k in OWN[1:]), c["rest"]))
    qual = F.when(F.col("qual") == F.floor("qual"), F.col("qual").cast("long").cast("string")).otherwise(F.col("qual").cast("string"))
    return F.concat_ws("\t", "contig", F.col("pos").cast("string"), dot(F.col("id")), "ref", joined(F.col("alts"), ","), dot(qual), joined(F.col("filters"), ";"), info, F.array_join(keys, ":"), F.array_join(calls, "\t"))


def _gt_text(call: Column) -> Column:
    alleles = F.transform(call["gt"], lambda a: F.coalesce(a.cast("string"), F.lit(".")))
    text = F.when(call["phased"], F.array_join(alleles, "|")).otherwise(F.array_join(alleles, "/"))
    return F.coalesce(text, F.lit("./."))


def write_vcf(variants: DataFrame, header: Header, path: str) -> None:
    """Writes one sorted text file per partition of the range (contig, pos), each with the header: parts in name order."""
    spark = variants.sparkSession
    body = variants.repartitionByRange(F.col("contig_rank"), F.col("pos"), F.col("rec")).sortWithinPartitions("contig_rank", "pos", "rec").select(vcf_lines(variants).alias("value"))
    head = "\n".join(header.lines)
    prepare_workers(spark)

    def with_header(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = True
        for batch in batches:
            if first:
                yield pa.RecordBatch.from_arrays([pa.array([head])], schema=batch.schema)
                first = False
            yield batch

    body.mapInArrow(with_header, "value string").write.text(path)
