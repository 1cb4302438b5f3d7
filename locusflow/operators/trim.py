"""Adapter trimming of read pairs by their overlap.

Where a fragment is shorter than its reads, each mate runs through it into the adapter. Then the first mate, cut to the
fragment's length, is the reverse complement of the second one, cut alike. So the adapter shows without being known.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.session import prepare_workers

#: Bases that must overlap, and mismatches allowed there: so many at most and no larger share.
OVERLAP, MISMATCHES, SHARE = 30, 5, 0.2

_COMPLEMENT = np.arange(256, dtype=np.uint8)
for _a, _b in zip(b"ACGTacgt", b"TGCATGCA", strict=True):
    _COMPLEMENT[_a] = _b


def fragment_lengths(first: np.ndarray, second: np.ndarray, overlap: int = OVERLAP, mismatches: int = MISMATCHES, share: float = SHARE) -> np.ndarray:
    """The length of each pair's fragment if it is shorter than a read; 0 if it isn't or the mates don't overlap.

    first, second: bytes of mates, those of each side equally long. The longest fragment for which the mates agree
    counts: lengths are tried from the sum of the reads' downwards, each for all pairs at once that haven't agreed yet.
    """
    a, b = first, _COMPLEMENT[second][:, ::-1]
    n, m = a.shape[1], b.shape[1]
    out = np.zeros(len(a), np.int32)
    left = np.arange(len(a))
    for length in range(n + m - overlap, overlap - 1, -1):
        # b ends where the fragment does; both cover [from_b, to_a) of it.
        from_b, to_a = max(0, length - m), min(n, length)
        size = to_a - from_b
        if size < overlap or not len(left):
            continue
        skip = from_b - (length - m)
        agree = np.count_nonzero(a[:, from_b:to_a] != b[:, skip : skip + size], 1) <= min(mismatches, int(size * share))
        if agree.any():
            if length < max(n, m):
                out[left[agree]] = length
            a, b, left = a[~agree], b[~agree], left[~agree]
    return out


def fragment_length(first: bytes, second: bytes, **options) -> int | None:
    """:func:`fragment_lengths` of one pair; None for 0."""
    found = fragment_lengths(*(np.frombuffer(x, np.uint8)[None] for x in (first, second)), **options)
    return int(found[0]) or None


def trim_adapters(reads: DataFrame, key: list[str]) -> DataFrame:
    """The reads with seq and qual cut to their fragment where that is shorter; all other columns stay.

    reads: the columns of ``key``, mate (1 or 2), seq, qual and others. Mates are brought together by one grouped
    aggregate; a pair without both mates stays as it is.
    """
    prepare_workers(reads.sparkSession)
    mate = lambda k: F.max(F.when(F.col("mate") == k, F.upper("seq"))).alias(f"seq{k}")
    pairs = reads.groupBy(*key).agg(mate(1), mate(2)).where("seq1 IS NOT NULL AND seq2 IS NOT NULL").select(F.struct(*key).alias("key"), "seq1", "seq2")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[t.encode() for t in batch.column(k).to_pylist()] for k in (1, 2)]
            found = np.zeros(batch.num_rows, np.int32)
            alike: dict[tuple[int, int], list[int]] = {}
            for i, pair in enumerate(zip(*texts, strict=True)):
                alike.setdefault((len(pair[0]), len(pair[1])), []).append(i)
            for rows in alike.values():
                for at in range(0, len(rows), 512):
                    part = rows[at : at + 512]
                    found[part] = fragment_lengths(*(np.array([np.frombuffer(t[i], np.uint8) for i in part]) for t in texts))
            some = np.flatnonzero(found)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(some)), pa.array(found[some])], ["key", "fragment"])

    kind = pairs.schema["key"].dataType
    short = pairs.mapInArrow(run, f"key {kind.simpleString()}, fragment int").select("key.*", "fragment")
    rows = reads.join(short, key, "left")
    cut = {c: F.when(F.col("fragment") < F.length(c), F.expr(f"substring({c}, 1, fragment)")).otherwise(F.col(c)) for c in ("seq", "qual")}
    return rows.withColumns(cut).select(*reads.columns)
