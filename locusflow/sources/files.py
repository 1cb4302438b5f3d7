"""Bytes of files behind URIs, plain or compressed, and the blocks of BGZF."""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import pyarrow.fs as pafs

#: The empty block that ends a BGZF file (fixed value of the format).
BGZF_END = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
BLOCK = 1 << 20


class FormatError(ValueError):
    """A file isn't what it should be."""


def open_uri(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), os.path.abspath(path)


def size_of(path: str) -> int:
    fs, p = open_uri(path)
    info = fs.get_file_info(p)
    if info.type != pafs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def head(path: str, n: int) -> bytes:
    fs, p = open_uri(path)
    with fs.open_input_file(p) as f:
        return f.read(n)


def is_gzip(path: str) -> bool:
    return head(path, 2) == b"\x1f\x8b"


def is_bgzf(path: str) -> bool:
    h = head(path, 18)
    return len(h) == 18 and h[:4] == b"\x1f\x8b\x08\x04" and h[12:14] == b"BC"


def require_bgzf_end(path: str) -> None:
    """Raises unless a BGZF file ends with its empty block."""
    fs, p = open_uri(path)
    with fs.open_input_file(p) as f:
        n = f.size()
        f.seek(max(0, n - len(BGZF_END)))
        if f.read(len(BGZF_END)) != BGZF_END:
            raise FormatError(f"{path}: truncated, the BGZF end block is missing")


def data_of(path: str) -> Iterator[bytes]:
    """A file's bytes in bounded pieces, decompressed if it is gzip of any number of members. A cut-off member raises."""
    fs, p = open_uri(path)
    packed = is_gzip(path)
    with fs.open_input_stream(p, compression=None) as f:
        unzip = None
        while block := f.read(BLOCK):
            if not packed:
                yield block
                continue
            while block:
                unzip = unzip or zlib.decompressobj(31)
                out = unzip.decompress(block)
                if out:
                    yield out
                block = unzip.unused_data if unzip.eof else b""
                if unzip.eof:
                    unzip = None
        if unzip is not None:
            raise FormatError(f"{path}: truncated gzip data")


def lines_of(path: str, longest: int | None = None) -> Iterator[bytes]:
    """Lines without their ends. A line beyond ``longest`` bytes raises."""
    rest = b""
    for block in data_of(path):
        rest += block
        *whole, rest = rest.split(b"\n")
        yield from (x.removesuffix(b"\r") for x in whole)
        if longest is not None and len(rest) > longest:
            raise FormatError(f"{path}: a line is longer than {longest} bytes")
    if rest:
        yield rest.removesuffix(b"\r")


class Reader:
    """Exact reads from a stream of pieces."""

    def __init__(self, pieces: Iterator[bytes], path: str):
        self.pieces, self.path, self.held, self.taken = pieces, path, bytearray(), 0

    def take(self, n: int, may_end: bool = False) -> bytes | None:
        while len(self.held) < n:
            piece = next(self.pieces, None)
            if piece is None:
                if may_end and not self.held:
                    return None
                raise FormatError(f"{self.path}: truncated record")
            self.held += piece
        out = bytes(self.held[:n])
        del self.held[:n]
        self.taken += n
        return out

    def unpack(self, form: str) -> tuple:
        return struct.unpack(form, self.take(struct.calcsize(form)))
