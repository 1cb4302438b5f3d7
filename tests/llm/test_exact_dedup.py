import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from locusflow.llm import exact_dedup as op


def brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out, taken = [], set()
    for i, t in rows:
        ids = groups[t or ""]
        top = max((x for x in ids if x is not None), default=None)
        kept = i == top and (top, t or "") not in taken
        if kept:
            taken.add((top, t or ""))
        out.append((i, top, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(1, "a"), (2, "a"), (2, "a"), (3, None), (4, ""), (None, "a"), (None, None), (5, "é" * 100_000), (6, "é" * 100_000), (7, "é" * 99_999 + "x"), (8, "b "), (9, "b"), (10, "A")]


@pytest.mark.parametrize("fields", [op.FIELDS, ((3, 2), (2, 1)), ((1, 1), (1, 1))])
def test_groups_match_brute_force_even_when_fingerprints_collide(docs_of, fields):
    rows = ROWS + [(100 + i, "ab" if i % 2 else "ba") for i in range(9)]
    got = op.exact_duplicates(docs_of(rows), fields=fields).drop("same_rows")
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows)


@pytest.mark.parametrize("huge", [0, 1, 2000])
def test_huge_texts_are_hashed_in_pieces(docs_of, monkeypatch, huge):
    monkeypatch.setattr(op, "PIECE_BYTES", 999)
    monkeypatch.setattr(op, "BROADCAST_KEYS", -1)
    seen = []
    monkeypatch.setattr(op, "fingerprint_of_chunks", lambda *a, of=op.fingerprint_of_chunks: seen.append(1) or of(*a))
    got = op.exact_duplicates(docs_of(ROWS), huge=huge).drop("same_rows")
    assert sorted(map(tuple, got.collect()), key=str) == brute(ROWS) and seen


def test_kept_rows_keep_their_columns(docs_of):
    docs = docs_of(ROWS)
    kept = op.keep_first_copies(docs)
    assert kept.columns == docs.columns
    want = sorted((i, h) for i, _, _, k, h in brute(ROWS) if k)
    assert sorted((r["doc_id"], hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r in kept.collect()) == want


def test_empty_table(docs_of):
    docs = docs_of([(1, "a")]).where("doc_id < 0")
    assert op.exact_duplicates(docs).count() == 0
    assert op.keep_first_copies(docs).count() == 0


def test_hashes_combine():
    data = bytes(range(256)) * 900
    whole = op.fingerprint(data)
    for cut in (0, 1, 70_000, len(data)):
        a, b = op.fingerprint(data[:cut]), op.fingerprint(data[cut:])
        assert tuple(op.combine(a[k], b[k], b[2], op.FIELDS[k]) for k in (0, 1)) + (a[2] + b[2],) == whole


def test_fingerprint_of_chunk_rows(spark):
    data = {k: bytes([k]) * (1000 * k + 7) + b"tail" for k in range(1, 6)}
    rows = [(k, no, d[at : at + 999]) for k, d in data.items() for no, at in enumerate(range(0, len(d), 999))] + [(9, 0, None)]
    chunks = spark.createDataFrame(rows, "doc int, no int, part binary").orderBy(F.rand(3))
    got = {r["doc"]: (r["h1"], r["h2"], r["n_bytes"]) for r in op.fingerprint_of_chunks(chunks, "doc", "no", "part").collect()}
    assert got == {k: op.fingerprint(d) for k, d in data.items()} | {9: (0, 0, 0)}
