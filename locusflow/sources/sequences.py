"""FASTQ and FASTA files as Spark data sources, and alignments of BAM files.

FASTQ is read strictly: four lines a record, equal lengths, known bases, Phred+33 qualities. Rows carry the record's
ordinal, so mates can be put side by side by a join and no order of rows is relied on. Plain and BGZF files are read in
parts: a line begins a record if it begins with ``@`` and bases follow it, since behind a quality that begins like this comes
another record's name. Numbers of records come from a count of each part and the sums of the counts before.
"""

from __future__ import annotations

import io
import re
import struct
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from locusflow.session import columns_of, prepare_workers
from locusflow.sources import bgzf, files
from locusflow.sources.bgzf import LARGEST, NOWHERE, Stream
from locusflow.sources.files import FormatError
from locusflow.sources.pushdown import Places, allow_pushdown

LONGEST_LINE = 1 << 20
CHUNK = 1 << 16
#: Bytes of a part of a BAM file.
SPLIT = 64 << 20
BAM_INDEX = (".csi", ".bai")
READS = "ordinal long, mate int, name string, seq string, qual string"
BASES = "contig string, chunk long, bases string, length long"
ALIGNMENTS = "ordinal long, read_group string, library string, sample string, flag int, contig string, pos long, mapq int, cigar string, name string, seq string, qual string, mate_contig string, mate_pos long, template_length int"
_BASES = re.compile(rb"[ACGTNacgtn]+")
_QUALITIES = re.compile(rb"[!-~]*")


@dataclass
class File(InputPartition):
    """A file or a part of it: between two bytes, or, if it was found by an index, between two virtual offsets."""

    path: str
    mate: int = 0
    begin: int = 0
    end: int | None = None
    indexed: bool = False


def read_name(line: str, mate: int) -> str:
    """The name without the mate's suffix; a suffix or a tag that belongs to the other mate raises."""
    name, _, tag = line.partition(" ")
    other = 3 - mate
    if name.endswith(f"/{other}") or re.match(rf"{other}:[YN]:\d+:", tag):
        raise FormatError(f"{line!r} is of mate {other}, not {mate}")
    if not name:
        raise FormatError("a read without a name")
    return name.removesuffix(f"/{mate}")


def fastq_records(path: str, mate: int, begin: int = 0, end: int | None = None) -> Iterator[tuple[int, int, str, str, str]]:
    """The records that begin between two bytes of a file: of the whole file numbered, of a part with their places."""
    whole = begin == 0 and end is None
    lines = enumerate(files.lines_of(path, LONGEST_LINE)) if whole else _fastq_lines(path, begin, end)
    n, last, size = 0, next(lines, None), end
    if not whole:
        # A border may fall anywhere in a record: this part's first name is a line that bases follow.
        while begin and last is not None:
            following = next(lines, None)
            if last[1].startswith(b"@") and following is not None and _BASES.fullmatch(following[1]):
                lines = chain([following], lines)
                break
            last = following
        size = NOWHERE if end is None else end << 16 if files.is_bgzf(path) else end
    while last is not None:
        place, head = last
        # In blocked files a line that begins where a part ends belongs to the part before.
        if not whole and (place > size if files.is_bgzf(path) else place >= size):
            return
        seq, plus, qual = ((next(lines, None) or (0, None))[1] for _ in range(3))
        where = f"{path}, record {n}" + ("" if whole else f" of the part at {begin}")
        if qual is None:
            raise FormatError(f"{where}: cut off")
        if not head.startswith(b"@") or not plus.startswith(b"+"):
            raise FormatError(f"{where}: lines don't begin with @ and +")
        if len(seq) != len(qual):
            raise FormatError(f"{where}: {len(seq)} bases and {len(qual)} qualities")
        if not _BASES.fullmatch(seq) or not _QUALITIES.fullmatch(qual):
            raise FormatError(f"{where}: unknown base or quality")
        yield n if whole else place, mate, read_name(head[1:].decode(), mate), seq.decode().upper(), qual.decode()
        n, last = n + 1, next(lines, None)


def _fastq_lines(path: str, begin: int, end: int | None) -> Iterator[tuple[int, bytes]]:
    """(place, line) from the first line on that begins at or after a byte, to the file's end; places as in the parts."""
    if files.is_bgzf(path):
        block = bgzf.next_block(path, begin)
        for place, raw in bgzf.lines(path, block, files.size_of(path)):
            yield place, raw.removesuffix(b"\r")
        return
    fs, p = files.open_uri(path)
    with io.BufferedReader(fs.open_input_file(p), 1 << 20) as f:
        at = begin
        if at:
            f.seek(at - 1)
            at += len(f.readline(2 * LONGEST_LINE)) - 1
        while raw := f.readline(LONGEST_LINE + 2):
            if len(raw) > LONGEST_LINE + 1:
                raise FormatError(f"{path}: a line is longer than {LONGEST_LINE} bytes")
            yield at, raw.removesuffix(b"\n").removesuffix(b"\r")
            at += len(raw)


def _splits(path: str, split: int) -> list[tuple[int, int | None]]:
    """Parts of a FASTQ file; one that is compressed as a whole is one part."""
    size = files.size_of(path)
    if size <= split or files.is_gzip(path) and not files.is_bgzf(path):
        return [(0, None)]
    if files.is_bgzf(path):
        files.require_bgzf_end(path)
    edges = [bgzf.next_block(path, at) if files.is_bgzf(path) else at for at in range(0, size, split)]
    edges = sorted(set(edges) - {size})
    return list(zip(edges, [*edges[1:], None], strict=True))


def fasta_index(path: str) -> list[tuple[str, int, int, int, int]]:
    """(contig, length, offset of its first base, bases and bytes of a line) of a reference, read once.

    All lines of a contig but the last must be equally long, or bases couldn't be found by arithmetic.
    """
    out: list[list] = []
    at, ended = 0, False
    fs, p = files.open_uri(path)
    with io.BufferedReader(fs.open_input_file(p), 1 << 20) as f:
        for line in f:
            at += len(line)
            bases = len(line.rstrip(b"\r\n"))
            if line.startswith(b">"):
                out.append([line[1:].split()[0].decode() if line[1:].split() else "", 0, at, 0, 0])
                ended = False
            elif bases or out and not ended:
                if not out or ended and bases:
                    raise FormatError(f"{path}: lines of {out[-1][0] if out else 'no contig'} differ in length")
                c = out[-1]
                if not c[3]:
                    c[3], c[4] = bases, len(line)
                ended = bases != c[3] or len(line) != c[4]
                if bases > c[3]:
                    raise FormatError(f"{path}: lines of {c[0]} differ in length")
                c[1] += bases
    return [tuple(c) for c in out]


def fasta_chunks(path: str, chunk: int = CHUNK) -> Iterator[tuple[str, int, str, int]]:
    """(contig, chunk, bases, length of the contig, given with chunk 0 only after its end: null elsewhere)."""
    if files.is_gzip(path):
        raise FormatError(f"{path}: a reference must not be compressed")
    seen: set[str] = set()
    name, held, no, total = None, b"", 0, 0
    for line in files.lines_of(path):
        if line.startswith(b">"):
            if name is not None:
                yield name, no, held.decode(), total
            name = line[1:].split()[0].decode() if line[1:].split() else ""
            if not name or name in seen:
                raise FormatError(f"{path}: contig name {name!r} is empty or occurs twice")
            seen.add(name)
            held, no, total = b"", 0, 0
        elif name is None or line.startswith((b"@", b"+")):
            raise FormatError(f"{path}: not FASTA")
        else:
            held += line.strip().upper()
            total += len(line.strip())
            while len(held) > chunk:
                yield name, no, held[:chunk].decode(), None
                held, no = held[chunk:], no + 1
    if name is None:
        raise FormatError(f"{path}: no contig")
    yield name, no, held.decode(), total


class _Rows(DataSourceReader):
    def __init__(self, options: dict, schema: pa.Schema, rows, parts: bool = False):
        self.options, self.arrow, self.rows, self.parts = dict(options), schema, rows, parts

    def partitions(self) -> list[File]:
        mate = int(self.options.get("mate", 0))
        paths = [p for p in self.options["path"].split(",") if p]
        if self.options.get("split") and self.rows is _fastq_rows:
            return [File(p, mate, a, b) for p in paths for a, b in _splits(p, int(self.options["split"]))]
        if self.parts:
            split = int(self.options.get("split", SPLIT))
            return [File(p, mate, at, at + split if at + split < size else None) for p in paths for size in (files.size_of(p),) for at in range(0, max(size, 1), split)]
        return [File(p, mate) for p in paths]

    def read(self, part: File) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in self.rows(part, self.options):
            held.append(row)
            if len(held) == 2048:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), self.arrow, strict=True)], schema=self.arrow)


def _arrow(schema: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in schema.split(", "))])


def _fastq_rows(part: File, options: dict):
    return fastq_records(part.path, part.mate, part.begin, part.end)


def _fasta_rows(part: File, options: dict):
    return fasta_chunks(part.path, int(options.get("chunk", CHUNK)))


def _bam_rows(part: File, options: dict):
    return bam_records(part.path, part.begin, part.end)


class BamReader(Places, _Rows):
    """Alignments, of which conditions and regions need only the chunks that the index beside the file names."""

    index_ends = BAM_INDEX

    def __init__(self, options: dict):
        _Rows.__init__(self, options, _arrow(ALIGNMENTS), _bam_rows, True)
        self.regions = [bgzf.parse_region(r) for r in options.get("regions", "").split(";") if r]

    def partitions(self) -> list[File]:
        out = []
        for part in [] if self.nothing() else _Rows.partitions(self):
            index = self.index_of(part.path, self.options.get("index")) if self.regions or self.contigs is not None else None
            if index is None:
                out.append(part)
            elif part.begin == 0:
                out += [File(part.path, 0, a, b, True) for a, b in self.chunks(index, bam_header(part.path)[1], self.regions)]
        return out or [File("")]

    def read(self, part: File) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        test = self.wanted(self.regions)
        rows = bam_chunk(part.path, part.begin, part.end) if part.indexed else bam_records(part.path, part.begin, part.end)
        held: list[tuple] = []
        for row in rows:
            # A record without aligned bases counts as one base long.
            if test(row[5], row[6], max(1, sum(int(n) for n, op in _SPAN.findall(row[8])))):
                held.append(row)
            if len(held) == 2048:
                yield self._batch(held)
                held = []
        if held:
            yield self._batch(held)


def _source(label: str, shape: str, rows, parts: bool = False, own: type | None = None) -> type[DataSource]:
    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return label

        def schema(self) -> str:
            return shape

        def reader(self, schema) -> DataSourceReader:
            return own(self.options) if own else _Rows(self.options, _arrow(shape), rows, parts)

    return Source


FastqSource = _source("fastq", READS, _fastq_rows)
FastaSource = _source("fasta", BASES, _fasta_rows)


# ---- BAM

#: Operations of a CIGAR that take bases of the reference.
_SPAN = re.compile("([0-9]+)([MDN=X])")
_CIGAR, _SEQ = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"


def bam_header(path: str) -> tuple[files.Reader, list[str], list[int], dict[str, dict[str, str]]]:
    """(reader behind the header, contigs, lengths, read groups) of a BAM file."""
    if not files.is_bgzf(path):
        raise FormatError(f"{path}: not BAM")
    files.require_bgzf_end(path)
    reader = files.Reader(files.data_of(path), path)
    if reader.take(4) != b"BAM\x01":
        raise FormatError(f"{path}: not BAM")
    (size,) = reader.unpack("<i")
    text = reader.take(size).rstrip(b"\0").decode()
    (n,) = reader.unpack("<i")
    names, lengths = [], []
    for _ in range(n):
        (k,) = reader.unpack("<i")
        names.append(reader.take(k).rstrip(b"\0").decode())
        lengths.append(reader.unpack("<i")[0])
    groups = {}
    for line in text.split("\n"):
        if line.startswith("@RG"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:] if ":" in x)
            groups[tags.get("ID", "")] = tags
    return reader, names, lengths, groups


def _fixed(held: bytearray, kind: str, at: int, n: int) -> np.ndarray:
    """The number of a kind that stands ``at`` bytes behind each of the first n places."""
    return np.ndarray((n,), kind, held, at, (1,))


def bam_sync(path: str, block: int, contigs: int, deep: int = 5) -> int:
    """The virtual offset of the first record that begins in or after a block; NOWHERE if there is none.

    Records carry no mark: a place counts if a chain of records that fit begins there, as in BCF files. The part before
    arrives at this place by following its own records, or raises.
    """
    stream, at = Stream(path, block), 0
    while True:
        stream.reach(at + 2 * LARGEST)
        n = len(stream.held) - 36 - at
        if n <= 0:
            return NOWHERE
        held = stream.held[at:]
        size, tid, pos, l_name, n_cigar, l_seq, mate = (_fixed(held, k, o, n).astype(np.int64) for k, o in (("<i4", 0), ("<i4", 4), ("<i4", 8), ("u1", 12), ("<u2", 16), ("<i4", 20), ("<i4", 24)))
        need = 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq
        fits = (tid >= -1) & (tid < contigs) & (mate >= -1) & (mate < contigs) & (pos >= -1) & (l_name >= 2) & (l_seq >= 0) & (size >= need) & (size < 1 << 28)
        del held
        for o in (np.flatnonzero(fits) + at).tolist():
            if _chain(stream, o, contigs, deep):
                stream.skip(o)
                return stream.place()
        at += n


def _chain(stream: Stream, at: int, contigs: int, deep: int) -> bool:
    """Whether records follow one another from an offset on, or up to the file's end."""
    for _ in range(deep):
        if not stream.reach(at + 36):
            return len(stream.held) == at
        size, tid, pos, l_name, _, _, n_cigar, _, l_seq, mate = struct.unpack_from("<iiiBBHHHii", stream.held, at)
        if not (-1 <= tid < contigs and -1 <= mate < contigs and pos >= -1 and l_name >= 2 and l_seq >= 0 and 32 + l_name + 4 * n_cigar + (l_seq + 1) // 2 + l_seq <= size < 1 << 28):
            return False
        if not stream.reach(at + 36 + l_name) or stream.held[at + 36 + l_name - 1] or not stream.held[at + 36 : at + 36 + l_name - 1].isascii():
            return False
        at += 4 + size
    return stream.reach(at)


def bam_records(path: str, begin: int = 0, end: int | None = None) -> Iterator[tuple]:
    """Records that begin in the blocks between two bytes of the file, numbered by their virtual offsets."""
    reader, names, _, groups = bam_header(path)
    size = files.size_of(path)
    # The header's blocks are read alike by every part; no record begins before their end.
    first = Stream(path, 0)
    first.reach(reader.taken)
    first.skip(reader.taken)
    least = first.place()
    block, last = bgzf.next_block(path, begin), size if end is None else bgzf.next_block(path, end)
    start = least if begin == 0 else max(bam_sync(path, block, len(names)), least) if block < size else NOWHERE
    stop = max(bam_sync(path, last, len(names)), least) if last < size else NOWHERE
    if start >= stop:
        return
    yield from _bam_between(path, first if begin == 0 else None, start, stop, names, groups, True)


def bam_chunk(path: str, begin: int, end: int) -> Iterator[tuple]:
    """Records that begin between two virtual offsets, the first of which begins one."""
    _, names, _, groups = bam_header(path)
    yield from _bam_between(path, None, begin, end, names, groups, False)


def _bam_between(path: str, stream: Stream | None, start: int, stop: int, names: list[str], groups: dict, exact: bool) -> Iterator[tuple]:
    if stream is None:
        stream = Stream(path, start >> 16)
        stream.reach((start & 0xFFFF) + 1)
        stream.skip(start & 0xFFFF)
    while stream.reach(1):
        place = stream.place()
        if place >= stop:
            if exact and place != stop:
                raise FormatError(f"{path}: records can't be told apart at {stop >> 16}; read it in one part")
            return
        if not stream.reach(4) or not stream.reach(4 + struct.unpack_from("<i", stream.held)[0]):
            raise FormatError(f"{path}: truncated record")
        n = struct.unpack_from("<i", stream.held)[0]
        data = bytes(stream.held[4 : 4 + n])
        stream.skip(4 + n)
        yield _bam_row(place, data, names, groups)


def _bam_row(place: int, data: bytes, names: list[str], groups: dict) -> tuple:
    tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mate_tid, mate_pos, tlen = struct.unpack("<iiBBHHHiiii", data[:32])
    at = 32
    name = data[at : at + l_name - 1].decode()
    at += l_name
    ops = struct.unpack(f"<{n_cigar}I", data[at : at + 4 * n_cigar])
    at += 4 * n_cigar
    packed = data[at : at + (l_seq + 1) // 2]
    at += len(packed)
    seq = "".join(_SEQ[b >> 4] + _SEQ[b & 15] for b in packed)[:l_seq]
    qual = "" if data[at : at + 1] == b"\xff" else bytes(q + 33 for q in data[at : at + l_seq]).decode()
    rg = _text_tag(data, at + l_seq, b"RG")
    tags = groups.get(rg or "", {})
    contig = lambda t: names[t] if 0 <= t < len(names) else None
    return place, rg, tags.get("LB"), tags.get("SM"), flag, contig(tid), pos + 1, mapq, "".join(f"{o >> 4}{_CIGAR[o & 15]}" for o in ops) or "*", name, seq, qual, contig(mate_tid), mate_pos + 1, tlen


def _text_tag(data: bytes, at: int, want: bytes) -> str | None:
    sizes = {65: 1, 99: 1, 67: 1, 115: 2, 83: 2, 105: 4, 73: 4, 102: 4}
    while at + 3 <= len(data):
        tag, kind = data[at : at + 2], data[at + 2]
        at += 3
        if kind in (90, 72):
            end = data.index(0, at)
            if tag == want:
                return data[at:end].decode()
            at = end + 1
        elif kind == 66:
            sub, k = data[at], struct.unpack("<i", data[at + 1 : at + 5])[0]
            at += 5 + sizes[sub] * k
        else:
            at += sizes[kind]
    return None


BamSource = _source("bam", ALIGNMENTS, _bam_rows, True, BamReader)


def _load(spark: SparkSession, source: type[DataSource], path: str, **options) -> DataFrame:
    prepare_workers(spark)
    allow_pushdown(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(path)


def dense_numbers(scan: DataFrame, column: str) -> DataFrame:
    """A scan whose parts are in the order of one file, with its records numbered from 0 on in ``column``.

    One pass counts the records of each part; in the next one a part begins with the sum of the counts before it. What is
    broadcast is a number for each part.
    """
    marked = scan.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    counts = sorted(map(tuple, marked.groupBy(part.alias("part")).count().collect()))
    starts, total = [], 0
    for p, n in counts:
        starts.append((p, total))
        total += n
    first = scan.sparkSession.createDataFrame(starts, "_part long, _first long")
    out = marked.join(F.broadcast(first), part == F.col("_part"), "left")
    return out.withColumn(column, F.col("_first") + F.col("_id").bitwiseAND((1 << 33) - 1)).select(*columns_of(scan))


def read_fastq(spark: SparkSession, path: str, mate: int, split: int = SPLIT) -> DataFrame:
    """The reads of a file: ordinal (from 0 on), mate, name, seq, qual; large plain and BGZF files in parts."""
    parts = _splits(path, split)
    rows = _load(spark, FastqSource, path, mate=mate, **({"split": split} if len(parts) > 1 else {}))
    return dense_numbers(rows, "ordinal") if len(parts) > 1 else rows


def read_fastq_pair(spark: SparkSession, first: str, second: str, split: int = SPLIT) -> DataFrame:
    """The reads of two files of mates: ordinal, mate, name, seq, qual."""
    return read_fastq(spark, first, 1, split).unionByName(read_fastq(spark, second, 2, split))


def read_reference(spark: SparkSession, path: str, chunk: int = CHUNK) -> DataFrame:
    """A reference in chunks: contig, chunk, bases, length (of the contig; with its last chunk, else null)."""
    return _load(spark, FastaSource, path, chunk=chunk)


def read_alignments(spark: SparkSession, path: str, **options) -> DataFrame:
    """Alignments of BAM files, read in parts of ``split`` bytes; library and sample come from the read groups.

    ordinal goes up in the order of the file: it is a record's virtual offset. With ``regions`` (as for variants) or
    conditions on contig and pos, only the chunks of an index beside the file (or the option ``index``) are read.
    """
    return _load(spark, BamSource, path, **options)
