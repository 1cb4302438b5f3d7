"""Small inputs made from their descriptions: cohorts, reads, and encoders of binary formats."""

import gzip
import struct
import zlib

HEAD = """##fileformat=VCFv4.2
##contig=<ID=1>
##contig=<ID=chr2>
##contig=<ID=X>
##FILTER=<ID=q10,Description="low, quality">
##INFO=<ID=AC,Number=A,Type=Integer,Description="count">
##INFO=<ID=DB,Number=0,Type=Flag,Description="known">
##FORMAT=<ID=GT,Number=1,Type=String,Description="genotype">
##FORMAT=<ID=DP,Number=1,Type=Integer,Description="depth">
##FORMAT=<ID=GQ,Number=1,Type=Integer,Description="quality">
"""
COLUMNS = "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t"
ALL = "GT:DP:GQ"

#: contig, pos, id, ref, alt, filter, format, calls of S1 to S4.
COHORT = [
    ("1", 10, "rs1", "A", "G", "PASS", ALL, "0/0:20:50 0/1:15:40 1/1:30:60 ./.:.:."),
    ("1", 20, "rs2", "C", "T", "PASS", ALL, "0/1:4:50 0/.:20:50 0/0:20:5 1/1:20:50"),
    ("1", 30, "rs3", "G", "A", "PASS", ALL, "./.:.:. ./.:.:. ./.:.:. ./.:.:."),
    ("chr2", 40, "rs4", "T", "C", ".", "GT", "0|1 0/0 1 0/1/1"),
    ("1", 50, "rs5", "A", "C", "PASS", ALL, "0/0:20:50 0/0:20:50 0/0:20:50 0/0:20:50"),
    ("X", 60, "x", "A", "G", "PASS", ALL, "0/1:20:50 0/1:20:50 0/1:20:50 0/1:20:50"),
    ("1", 70, "multi", "A", "C,G", "PASS", ALL, "0/1:20:50 0/2:20:50 1/2:20:50 0/0:20:50"),
    ("1", 80, "indel", "A", "AC", "PASS", ALL, "0/1:20:50 0/1:20:50 0/1:20:50 0/1:20:50"),
    ("1", 90, "filtered", "A", "G", "q10", ALL, "0/1:20:50 0/1:20:50 0/1:20:50 0/1:20:50"),
]


def vcf(records, samples, head=HEAD):
    lines = ["\t".join([c, str(p), i, r, a, ".", f, "AC=1;DB" if k % 2 else ".", form, *calls.split(" ")]) for k, (c, p, i, r, a, f, form, calls) in enumerate(records)]
    return head + COLUMNS + "\t".join(samples) + "\n" + "".join(x + "\n" for x in lines)


def bgzf(data: bytes) -> bytes:
    out = b""
    for at in [*range(0, len(data), 60_000), None]:
        part = b"" if at is None else data[at : at + 60_000]
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        body = c.compress(part) + c.flush()
        out += b"\x1f\x8b\x08\x04" + bytes(4) + b"\x00\xff\x06\x00BC\x02\x00" + struct.pack("<H", len(body) + 25) + body + struct.pack("<II", zlib.crc32(part), len(part))
    return out


def _typed(values, kind=None):
    if isinstance(values, str):
        raw = values.encode()
        return _descriptor(7, len(raw)) + raw
    if kind is None:
        kind = 1 if all(v is None or -120 <= v <= 127 for v in values) else 2 if all(v is None or -32760 <= v <= 32767 for v in values) else 3
    return _descriptor(kind, len(values)) + b"".join(_int(v, kind) for v in values)


def _int(v, kind):
    low = {1: -128, 2: -32768, 3: -2147483648}[kind]
    return struct.pack("<" + "bhi"[kind - 1], low if v is None else low + 1 if v == "end" else v)


def _descriptor(kind, n):
    return bytes([n << 4 | kind]) if n < 15 else bytes([15 << 4 | kind]) + _typed([n])


def bcf(text: str) -> bytes:
    """A BCF file with the content of a VCF text."""
    head, _, body = text.partition(COLUMNS)
    samples, *lines = body.rstrip("\n").split("\n")
    strings, contigs = ["PASS"], []
    for line in head.split("\n"):
        if "=<ID=" in line:
            name = line.split("<ID=")[1].split(",")[0].rstrip(">")
            if line.startswith("##contig"):
                contigs.append(name)
            elif name not in strings:
                strings.append(name)
    header = (head + COLUMNS + samples + "\n").encode() + b"\0"
    out = b"BCF\x02\x02" + struct.pack("<I", len(header)) + header
    n = len(samples.split("\t"))
    for line in lines if lines != [""] else []:
        c = line.split("\t")
        alleles = [c[3], *([] if c[4] == "." else c[4].split(","))]
        info = [] if c[7] == "." else c[7].split(";")
        keys = c[8].split(":")
        shared = struct.pack("<iiiIII", contigs.index(c[0]), int(c[1]) - 1, len(c[3]), 0x7F800001, len(alleles) << 16 | len(info), len(keys) << 24 | n)
        shared += _typed(c[2]) + b"".join(map(_typed, alleles))
        shared += b"\x00" if c[6] == "." else _typed([strings.index(f) for f in c[6].split(";")])
        for x in info:
            k, _, v = x.partition("=")
            shared += _typed([strings.index(k)]) + (_typed([int(v)]) if v else b"\x00")
        individual = b""
        calls = [dict(zip(keys, x.split(":"))) for x in c[9:]]
        for k in keys:
            individual += _typed([strings.index(k)])
            if k == "GT":
                rows = []
                for call in calls:
                    row, mark = [], 0
                    for token in call["GT"].replace("/", " / ").replace("|", " | ").split():
                        if token in "/|":
                            mark = token == "|"
                        else:
                            row.append((0 if token == "." else int(token) + 1) << 1 | int(mark))
                    rows.append(row)
                width = max(map(len, rows))
                individual += _descriptor(1, width) + b"".join(_int(v, 1) for row in rows for v in row + ["end"] * (width - len(row)))
            else:
                individual += _descriptor(2, 1) + b"".join(_int(None if call.get(k, ".") == "." else int(call[k]), 2) for call in calls)
        out += struct.pack("<II", len(shared), len(individual)) + shared + individual
    return bgzf(out)


def write(path, data):
    path.write_bytes(data if isinstance(data, bytes) else data.encode())
    return str(path)


def gz(text: str, members: int = 3) -> bytes:
    raw = text.encode()
    step = len(raw) // members + 1
    return b"".join(gzip.compress(raw[at : at + step]) for at in range(0, len(raw), step))
