"""Word n-grams of whole texts, vectorised over the bytes of many texts at once.

A word is a run of ASCII letters, digits and underscores, or of any characters beyond ASCII, in lower case. A text with
fewer words than n has one n-gram of all its words; a text without words has none.

Hashes have a key. Whatever decides that two words are equal uses a key that the driver draws for the run: no text can be
written so that unlike words get one hash, and chance gives two of them one with a probability below 2**-56.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

N = 5
#: Fixed odd multiplier of the polynomial over words, modulo 2**64.
WORD_BASE = 0xC2B2AE3D27D4EB4F
#: The key of hashes that only choose among equals, so that they are the same in every run.
PUBLIC = bytes(16)
_MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)

_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[[*range(48, 58), *range(65, 91), 95, *range(97, 123), *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX[0])
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(_MIX[1])
    return x ^ (x >> np.uint64(33))


def new_key() -> bytes:
    """A key that nobody knows before the run."""
    return os.urandom(16)


_tables: dict[bytes, np.ndarray] = {}


def _multipliers(n: int, key: bytes) -> np.ndarray:
    """A multiplier for each place in a word, from the key."""
    if key not in _tables or len(_tables[key]) < n:
        a, b = np.frombuffer(key, np.uint64)
        _tables[key] = mix(mix(np.arange(1, 2 * n + 65, dtype=np.uint64) * np.uint64(WORD_BASE) + a) ^ b)
    return _tables[key]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words in an array of bytes."""
    inside = np.empty(len(data) + 2, bool)
    inside[0] = inside[-1] = False
    inside[1:-1] = _WORD_BYTE[data]
    turns = np.flatnonzero(inside[1:] != inside[:-1])
    return turns[::2], turns[1::2]


#: Bytes that are hashed at a time, which bounds memory for long texts.
SEGMENT = 1 << 18
#: Longer words are hashed one by one.
LONG_WORD = 1 << 14


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes = PUBLIC) -> np.ndarray:
    """A 64-bit hash of each word, wherever it stands."""
    if len(data) <= SEGMENT or len(starts) < 2:
        return _hashes(data, starts, ends, key)
    out = np.empty(len(starts), np.uint64)
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), SEGMENT)), len(starts)))
    for i, j in zip(cuts[:-1], cuts[1:], strict=True):
        out[i:j] = _hashes(data, starts[i:j], ends[i:j], key)
    return out


def _hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, key: bytes) -> np.ndarray:
    """Sums of bytes times the multipliers of their places: two words differ in one place, and its multiplier is drawn."""
    sizes = ends - starts
    out = np.empty(len(starts), np.uint64)
    long = np.flatnonzero(sizes > LONG_WORD)
    for i in long.tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), key=key, digest_size=8).digest(), "little")
    short = np.flatnonzero(sizes <= LONG_WORD) if len(long) else slice(None)
    begins, sizes = starts[short], sizes[short]
    if len(begins):
        at = np.cumsum(sizes) - sizes
        every = np.arange(at[-1] + sizes[-1], dtype=np.int32)
        place = every - np.repeat(at.astype(np.int32), sizes)
        bytes_ = data[every + np.repeat((begins - at).astype(np.int32), sizes)].astype(np.uint64) + np.uint64(1)
        out[short] = np.add.reduceat(bytes_ * _multipliers(int(sizes.max()), key)[place], at)
    return mix(out)


def same_bytes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, other: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """Which stretches of data hold the same bytes as those of the same sizes in another array."""
    if not len(starts):
        return np.empty(0, bool)
    at = np.cumsum(sizes) - sizes
    place = np.arange(at[-1] + sizes[-1], dtype=np.int32)
    differ = data[place + np.repeat((starts - at).astype(np.int32), sizes)] != other[place + np.repeat((begins - at).astype(np.int32), sizes)]
    # Hardly ever any: only then it matters which.
    return ~np.logical_or.reduceat(differ, at) if differ.any() else np.ones(len(starts), bool)


def forget() -> None:
    """Drops the tables of multipliers."""
    _tables.clear()


def ngram_hashes(texts: list[bytes], n: int = N, key: bytes = PUBLIC) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram hashes of all texts one after another, repeats included; count of n-grams of each text)."""
    data = np.frombuffer(b"\n".join(texts), np.uint8)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]) if len(texts) else np.empty(0, np.int64)
    starts, ends = word_spans(data)
    words = word_hashes(data, starts, ends, key)
    first = np.searchsorted(starts, begins)
    counts = np.diff(np.append(first, len(starts)))
    grams = np.zeros(max(len(words) - n + 1, 0), np.uint64)
    for k in range(n):
        if len(grams):
            grams += words[k : k + len(grams)] * np.uint64(pow(WORD_BASE, k + 1, 1 << 64))
    sizes = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    out = np.empty(int(sizes.sum()), np.uint64)
    ends_out = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(len(out)) - np.repeat(ends_out - sizes, sizes)
    long = counts[owner] >= n
    out[long] = grams[(first[owner] + place)[long]]
    for i in np.flatnonzero((counts > 0) & (counts < n)):
        value = 0
        for k in range(counts[i]):
            value += int(words[first[i] + k]) * pow(WORD_BASE, k + 1, 1 << 64)
        out[ends_out[i] - 1] = value % (1 << 64)
    return mix(out), sizes


def ngram_sets(texts: list[bytes], n: int = N, key: bytes = PUBLIC) -> list[np.ndarray]:
    """The sorted set of n-gram hashes of each text."""
    grams, sizes = ngram_hashes(texts, n, key)
    return [np.unique(x) for x in np.split(grams, np.cumsum(sizes)[:-1])] if texts else []


def pieces(batch: pa.RecordBatch, column: int, most: int = SEGMENT) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with a bounded number of bytes in one column (one row at least)."""
    start, total = 0, 0
    for i, s in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > start and total + (s or 0) > most:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += s or 0
    if start < batch.num_rows:
        yield batch.slice(start)
