"""BGZF files in parts: blocks from any place on, lines of a part, and what indexes say about regions.

A place in a file is a virtual offset: where its block begins in the file, shifted by 16 bits, and its offset in the block.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

from locusflow.sources import files
from locusflow.sources.files import FormatError

READ = 1 << 20
#: A block's first bytes, and the largest size of a block (fixed values of the format).
MAGIC, LARGEST = b"\x1f\x8b\x08\x04", 1 << 16


def _block_size(head: bytes) -> int:
    """Bytes of the block that begins with ``head``; 0 if that isn't one, -1 if more bytes are needed to tell."""
    if len(head) < 12:
        return -1
    if head[:4] != MAGIC:
        return 0
    extra = 12 + int.from_bytes(head[10:12], "little")
    at = 12
    while at + 4 <= extra:
        if len(head) < at + 6:
            return -1
        size = int.from_bytes(head[at + 2 : at + 4], "little")
        if head[at : at + 2] == b"BC" and size == 2:
            return int.from_bytes(head[at + 4 : at + 6], "little") + 1
        at += 4 + size
    return 0


def next_block(path: str, at: int) -> int:
    """Where the first block at or after a byte begins; the file's size if there is none."""
    fs, p = files.open_uri(path)
    with fs.open_input_file(p) as f:
        end = f.size()
        if at >= end:
            return end
        f.seek(at)
        data = f.read(4 * LARGEST)
    found = data.find(MAGIC)
    while found >= 0:
        # What looks like a block must be followed by others, as far as the bytes at hand go.
        place = found
        while 0 < (size := _block_size(data[place : place + 64])):
            place += size
        if size < 0 or at + place == end:
            return at + found
        found = data.find(MAGIC, found + 1)
    if at + len(data) < end:
        raise FormatError(f"{path}: no BGZF block after byte {at}")
    return end


def blocks(path: str, begin: int = 0) -> Iterator[tuple[int, bytes]]:
    """(where it begins in the file, data) of each block from ``begin`` on."""
    fs, p = files.open_uri(path)
    with fs.open_input_file(p) as f:
        f.seek(begin)
        held, at = b"", begin
        while more := f.read(READ):
            held += more
            place = 0
            while 0 < (size := _block_size(held[place : place + 64])) <= len(held) - place:
                extra = 12 + int.from_bytes(held[place + 10 : place + 12], "little")
                try:
                    yield at + place, zlib.decompress(held[place + extra : place + size - 8], -15)
                except zlib.error as e:
                    raise FormatError(f"{path}: damaged block at byte {at + place}") from e
                place += size
            if size == 0 and place < len(held):
                raise FormatError(f"{path}: no BGZF block at byte {at + place}")
            held, at = held[place:], at + place
        if held:
            raise FormatError(f"{path}: truncated, a block is cut off")


def lines(path: str, begin: int, end: int, whole: bool = False) -> Iterator[tuple[int, bytes]]:
    """(virtual offset, line) of the lines that belong to the part between two block beginnings.

    The first line that ends in a part belongs to the part before it, unless the part begins the file (or ``whole`` says
    that its first byte begins a line): so the line after a border is read once, wherever the border falls.
    """
    skipping = begin > 0 and not whole
    if begin >= end:
        return
    carry, place = b"", None
    for at, data in blocks(path, begin):
        past = at >= end
        pos = 0
        if skipping:
            pos = data.find(b"\n") + 1
            if not pos:
                if past:
                    return
                continue
            skipping = False
            if past:
                return
        if past:
            stop = data.find(b"\n", pos)
            if stop < 0:
                place = at << 16 | pos if place is None and data else place
                carry += data[pos:]
                continue
            yield place if place is not None else at << 16 | pos, carry + data[pos:stop]
            return
        while (stop := data.find(b"\n", pos)) >= 0:
            yield place if place is not None else at << 16 | pos, carry + data[pos:stop]
            carry, place, pos = b"", None, stop + 1
        if pos < len(data):
            place = at << 16 | pos if place is None else place
            carry += data[pos:]
    if carry:
        yield place, carry


# ---- records

#: A virtual offset beyond all files.
NOWHERE = 1 << 62


class Stream:
    """Bytes of a BGZF file from a block on, with their virtual offsets; a plain file is one block."""

    def __init__(self, path: str, begin: int):
        self.path, self.pieces = path, blocks(path, begin) if files.is_bgzf(path) else ((0, d) for d in files.data_of(path))
        self.plain = not files.is_bgzf(path)
        self.held, self.base = bytearray(), 0  # base: the stream's offset of held[0]
        self.starts: list[int] = []  # stream offsets of blocks, and where they begin in the file
        self.places: list[int] = []
        self.size = 0

    def reach(self, n: int) -> bool:
        """Whether n bytes from the present place on are held, after reading on if need be."""
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                return False
            at, data = piece
            if data:
                self.starts.append(self.size)
                self.places.append(at)
                self.size += len(data)
                self.held += data
        return True

    def skip(self, n: int) -> None:
        del self.held[:n]
        self.base += n

    def place(self) -> int:
        """The virtual offset of the present place (the plain offset in a plain file)."""
        if self.plain:
            return self.base
        self.reach(1)
        i = bisect.bisect_right(self.starts, self.base) - 1
        if i < 0 or self.base >= self.size:
            return NOWHERE
        return self.places[i] << 16 | self.base - self.starts[i]


# ---- indexes


class Index:
    """Chunks of an index (tabix, CSI or BAI): where records of a contig's positions can lie."""

    def __init__(self, path: str):
        data = b"".join(files.data_of(path))
        self.names: list[str] = []
        try:
            self._read(data)
        except (struct.error, IndexError) as e:
            raise FormatError(f"{path}: truncated index") from e

    def _read(self, data: bytes) -> None:
        kind = data[:4]
        self.at = 4
        self.data = data
        self.shift, self.depth = 14, 5
        if kind == b"CSI\1":
            self.shift, self.depth, aux = self._take("<iii")
            if aux >= 28:
                names = self.data[self.at + 28 : self.at + aux]
                self.names = [x.decode() for x in names.split(b"\0") if x]
            self.at += aux
            (n,) = self._take("<i")
        elif kind == b"TBI\1":
            n, *_, size = self._take("<8i")
            self.names = [x.decode() for x in data[self.at : self.at + size].split(b"\0") if x]
            self.at += size
        elif kind == b"BAI\1":
            (n,) = self._take("<i")
        else:
            raise FormatError("not an index")
        self.contigs: list[tuple[dict[int, list], dict[int, int], list[int]]] = []
        for _ in range(n):
            bins, low, linear = {}, {}, []
            for _ in range(self._take("<i")[0]):
                if kind == b"CSI\1":
                    number, low_at, chunks = self._take("<IQi")
                    low[number] = low_at
                else:
                    number, chunks = self._take("<Ii")
                bins[number] = [self._take("<QQ") for _ in range(chunks)]
            if kind != b"CSI\1":
                linear = [self._take("<Q")[0] for _ in range(self._take("<i")[0])]
            self.contigs.append((bins, low, linear))
        del self.data

    def _take(self, form: str) -> tuple:
        out = struct.unpack_from(form, self.data, self.at)
        self.at += struct.calcsize(form)
        return out

    def chunks(self, contig: int, begin: int, end: int) -> list[tuple[int, int]]:
        """Virtual ranges, sorted and merged, with all records of a contig that overlap [begin, end), 0-based."""
        if not 0 <= contig < len(self.contigs) or begin >= end:
            return []
        bins, low, linear = self.contigs[contig]
        top = self.shift + 3 * self.depth
        end = min(end, 1 << top)
        found, first, size = [], 0, top
        least = linear[min(begin >> self.shift, len(linear) - 1)] if linear else 0
        for level in range(self.depth + 1):
            found += [c for b in range(first + (begin >> size), first + ((end - 1) >> size) + 1) for c in bins.get(b, ())]
            if level == self.depth and low:
                least = low.get(first + (begin >> size), 0)
            first += 1 << 3 * level
            size -= 3
        return merged([c for c in found if c[1] > least])


def merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of ranges, as ranges that don't touch."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def parse_region(text: str) -> tuple[str, int, int]:
    """(contig, begin, end), 0-based and half open, of ``contig``, ``contig:from`` or ``contig:from-to`` (1-based, commas allowed)."""
    name, colon, span = text.rpartition(":")
    if not colon:
        return text, 0, 1 << 60
    first, dash, last = span.replace(",", "").partition("-")
    try:
        begin, end = int(first) - 1, int(last) if last else 1 << 60
    except ValueError as e:
        raise FormatError(f"not a region: {text}") from e
    if not name or begin < 0 or end <= begin:
        raise FormatError(f"not a region: {text}")
    return name, begin, end


def byte_ranges(index: Index, region: str, names: list[str] | None = None) -> list[dict]:
    """Compressed bytes to fetch for a region: start and end of each chunk, the last block counted at its largest size."""
    names = names or index.names
    name, begin, end = parse_region(region)
    found = index.chunks(names.index(name), begin, end) if name in names else []
    if not found:
        raise FormatError(f"no indexed chunks for {region}")
    return [{"start": a >> 16, "end": (b >> 16) + LARGEST - 1} for a, b in found]


def union_bytes(ranges: list[dict], size: int, head: int = 0) -> list[dict]:
    """Byte ranges (both ends inclusive) of a file's first ``head`` bytes, of some ranges and of its end block, merged."""
    whole = [(0, head)] if head else []
    whole += [(r["start"], min(r["end"] + 1, size)) for r in ranges]
    whole += [(max(0, size - len(files.BGZF_END)), size)]
    return [{"start": a, "end": b - 1} for a, b in merged([(a, b) for a, b in whole if a < b])]
