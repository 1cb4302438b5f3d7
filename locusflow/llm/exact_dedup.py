"""Exact duplicates by composable polynomial fingerprints.

A text's UTF-8 bytes are cut into chunks. Each chunk gets its own polynomial hash; two neighbours combine as
``h(ab) = h(a) * base**len(b) + h(b)``, so chunks may be hashed anywhere, in any order, and only their hashes and lengths
travel. Texts with equal fingerprints are then compared chunk by chunk: every chunk of a group member meets the same
chunk of the group's representative in a join, so no task ever holds a whole group or a whole huge text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locusflow.llm.kept import without
from locusflow.llm.worker import claim
from locusflow.session import persisted, prepare_workers, release

#: (modulus, base) of the two halves of a fingerprint.
FIELDS = ((2_147_483_647, 1_103_515_245), (2_147_483_629, 214_013_011))
CHUNK_BYTES = 1 << 16
#: Texts of more bytes are cut into pieces of so many, which are hashed wherever they go.
HUGE_BYTES, PIECE_BYTES = 32 << 20, 1 << 20
#: Keys of rows to drop, and of groups, are broadcast up to so many; beyond that they are joined by shuffle.
BROADCAST_KEYS = 200_000
FINGERPRINT = ["h1", "h2", "n_bytes"]


def _powers(modulus: int, base: int) -> np.ndarray:
    out = np.empty(CHUNK_BYTES, np.uint64)
    x = 1
    for i in range(CHUNK_BYTES - 1, -1, -1):
        out[i] = x
        x = x * base % modulus
    return out


_tables: dict = {}


def _table(field: tuple[int, int]) -> np.ndarray:
    """Powers of the base, highest first, so that a chunk's hash is a dot product with the table's tail."""
    if field not in _tables:
        _tables[field] = _powers(*field)
    return _tables[field]


def chunk_hash(data: bytes, field: tuple[int, int] = FIELDS[0]) -> int:
    """The polynomial hash of at most CHUNK_BYTES bytes."""
    if not data:
        return 0
    values = np.frombuffer(data, np.uint8).astype(np.uint64)
    return int(np.dot(values, _table(field)[-len(values) :])) % field[0]


def combine(left: int, right: int, right_bytes: int, field: tuple[int, int] = FIELDS[0]) -> int:
    """The hash of two joined byte strings from their hashes and the right one's length."""
    modulus, base = field
    return (left * pow(base, right_bytes, modulus) + right) % modulus


def fingerprint(data: bytes, fields=FIELDS) -> tuple[int, int, int]:
    """(h1, h2, bytes) of a whole text: its chunks' hashes, combined."""
    out = []
    for field in fields:
        h = 0
        for at in range(0, len(data), CHUNK_BYTES):
            piece = data[at : at + CHUNK_BYTES]
            h = combine(h, chunk_hash(piece, field), len(piece), field)
        out.append(h)
    return out[0], out[1], len(data)


def fingerprint_of_chunks(chunks: DataFrame, key: str, order: str, data: str, fields=FIELDS) -> DataFrame:
    """Fingerprints of texts that are stored as many rows, one a chunk of any size.

    Each row is hashed where it lies. A chunk's share in the whole is its hash times the base to the power of the bytes
    after it, so the shares add up in an ordinary sum with map-side partial aggregates. Rows: (key, h1, h2, n_bytes).
    Null chunks count as empty; a key without rows has none.
    """
    prepare_workers(chunks.sparkSession)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [fingerprint(x or b"", fields) for x in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1), *(pa.array([p[i] for p in prints], pa.int64()) for i in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["k", "o", *FINGERPRINT])

    def shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h1, h2, after = (batch.column(i).to_pylist() for i in (1, 2, 4))
            moved = [pa.array([h * pow(f[1], a, f[0]) % f[0] for h, a in zip(hs, after, strict=True)], pa.int64()) for hs, f in ((h1, fields[0]), (h2, fields[1]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *moved, batch.column(3)], ["k", *FINGERPRINT])

    kind = chunks.schema[key].dataType.simpleString()
    source = chunks.select(F.col(key).alias("k"), F.col(order).cast("long").alias("o"), F.col(data).cast("binary").alias("d"))
    rows = source.mapInArrow(hashed, f"k {kind}, o long, h1 long, h2 long, n_bytes long")
    after = F.coalesce(F.sum("n_bytes").over(Window.partitionBy("k").orderBy(F.desc("o")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("k", "h1", "h2", "n_bytes", after.alias("after")).mapInArrow(shifted, f"k {kind}, h1 long, h2 long, n_bytes long")
    return rows.groupBy("k").agg(*((F.sum(c) % f[0]).alias(c) for c, f in zip(("h1", "h2"), fields, strict=True)), F.sum("n_bytes").alias("n_bytes")).withColumnRenamed("k", key)


def _prints(fields):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact_dedup", _tables.clear)
        for batch in batches:
            h1, h2, size, digest = [], [], [], []
            for text in batch.column(1):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                a, b, n = fingerprint(data, fields)
                h1.append(a)
                h2.append(b)
                size.append(n)
                digest.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(size, pa.int64()), pa.array(digest, pa.binary())], ["id", *FINGERPRINT, "sha"])

    return run


def _chunks(fields):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("exact_dedup", _tables.clear)
        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                whole = fingerprint(data, fields)
                for no, at in enumerate(range(0, max(len(data), 1), CHUNK_BYTES)):
                    for out, x in zip(rows, (key, *whole, no, data[at : at + CHUNK_BYTES]), strict=True):
                        out.append(x)
            kinds = [batch.column(0).type, *[pa.int64()] * 4, pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows, kinds, strict=True)], ["id", *FINGERPRINT, "no", "chunk"])

    return run


def _unequal(source: DataFrame, groups: DataFrame, fields) -> DataFrame:
    """Fingerprints of groups whose members' texts are not all the same, found by comparing chunk with chunk."""
    kind = source.schema["id"].dataType.simpleString()
    several = persisted(groups.where("copies > 1").select(*FINGERPRINT, "top"), "several")
    few = several.count() <= BROADCAST_KEYS
    listed = lambda df: F.broadcast(df) if few else df.hint("merge")
    shape = f"id {kind}, h1 long, h2 long, n_bytes long, no long, chunk binary"
    # Only rows with a representative's id are cut into chunks for the models.
    tops = source.join(listed(several.select("top").distinct()), source["id"].eqNullSafe(F.col("top")), "left_semi")
    model = tops.mapInArrow(_chunks(fields), shape).join(listed(several), FINGERPRINT).where(F.col("id").eqNullSafe(F.col("top")))
    # Written first: a join of two plain exchanges can be split where a group is large.
    model = persisted(model.groupBy(*FINGERPRINT, "no").agg(F.min("chunk").alias("model")), "models")
    members = source.mapInArrow(_chunks(fields), shape).join(listed(several.select(*FINGERPRINT)), FINGERPRINT, "left_semi")
    out = persisted(members.join(model, [*FINGERPRINT, "no"]).where("chunk <> model").select(*FINGERPRINT).distinct(), "unequal")
    release(several, model)
    return out


def _all_prints(source: DataFrame, fields, huge: int) -> DataFrame:
    """(id, FINGERPRINT, sha) of each row. Texts of more than ``huge`` bytes are hashed chunk by chunk, wherever those go."""
    kind = source.schema["id"].dataType.simpleString()
    size = F.octet_length("text")
    whole = source.where(size <= huge).mapInArrow(_prints(fields), f"id {kind}, h1 long, h2 long, n_bytes long, sha binary")
    long = source.where(size > huge).select("id", F.col("text").cast("binary").alias("data")).withColumns({"sha": F.unhex(F.sha2("data", 256)), "row": F.monotonically_increasing_id()})
    numbers = F.sequence(F.lit(0), F.floor((F.length("data") - 1) / PIECE_BYTES).cast("int"))
    cut = F.transform(numbers, lambda i: F.struct(i.alias("no"), F.substring("data", i * PIECE_BYTES + 1, F.lit(PIECE_BYTES)).alias("piece")))
    # Written: a row has its number before it has pieces, and the pieces then lie by themselves.
    long = persisted(long.select("id", "sha", "row", F.inline(cut)), "pieces")
    if long.isEmpty():
        release(long)
        return whole
    pieces = long.select(F.struct("id", "row", "sha").alias("key"), "no", "piece")
    found = fingerprint_of_chunks(pieces.repartition("key", "no"), "key", "no", "piece", fields)
    return whole.unionByName(found.select("key.id", *FINGERPRINT, "key.sha"))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fields=FIELDS, huge: int = HUGE_BYTES) -> DataFrame:
    """One row per input row: (id_col, keep_id, group_size, kept, text_sha256, same_rows).

    Texts are equal if their characters are; a null text counts as empty. In each group of equal texts the row with the
    largest id stays; of rows that tie in id and text exactly one does. A null id is smaller than any other. same_rows
    counts the input rows with this id and text. Other columns of the input are ignored, whatever their names; no input
    rows give no rows.

    A fingerprint takes one scan without a shuffle, but for texts of more than ``huge`` bytes, whose pieces are hashed by
    many tasks. Only fingerprints move to find groups (partial counts first, so a
    group of any size is a handful of rows), and only texts of groups of two and more are compared. Should different
    texts share a fingerprint, the comparison shows it and their group is split by SHA-256.
    """
    prepare_workers(docs.sparkSession)
    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    prints = persisted(_all_prints(source, fields, huge), "prints")
    groups = persisted(prints.groupBy(*FINGERPRINT).agg(F.max("id").alias("top"), F.count("*").alias("copies")).where("copies > 1"), "groups")
    mixed = _unequal(source, groups, fields)
    rows = prints.groupBy("id", *FINGERPRINT, "sha").agg(F.count("*").alias("same_rows"))
    if mixed.isEmpty():
        rows = rows.join(groups.select(*FINGERPRINT, F.col("top").alias("g_top"), F.col("copies").alias("g_copies")), FINGERPRINT, "left")
    else:
        parted = prints.join(mixed, FINGERPRINT, "left_semi").groupBy(*FINGERPRINT, "sha").agg(F.max("id").alias("g_top"), F.count("*").alias("g_copies"))
        whole = groups.join(mixed, FINGERPRINT, "left_anti").select(*FINGERPRINT, F.col("top").alias("w_top"), F.col("copies").alias("w_copies"))
        rows = rows.join(parted, [*FINGERPRINT, "sha"], "left").join(whole, FINGERPRINT, "left")
        rows = rows.withColumns({"g_top": F.coalesce("g_top", "w_top"), "g_copies": F.coalesce("g_copies", "w_copies")})
    alone = F.col("g_copies").isNull()
    rows = rows.select(F.col("id"), F.when(alone, F.col("id")).otherwise(F.col("g_top")).alias("keep"), F.coalesce("g_copies", F.lit(1).cast("long")).alias("copies"), F.lower(F.hex("sha")).alias("text_sha256"), "same_rows")
    nth = rows.select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("same_rows"))).alias("nth"))
    return nth.select(
        F.col("id").alias(id_col),
        F.col("keep").alias("keep_id"),
        F.col("copies").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep")) & (F.col("nth") == 1)).alias("kept"),
        "text_sha256",
        "same_rows",
    )


def keep_first_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Rules as in :func:`exact_duplicates`."""
    out = exact_duplicates(docs, id_col, text_col).select(F.col(id_col).alias("__flow_id"), F.col("text_sha256").alias("__flow_key"), "kept", F.col("same_rows").alias("__flow_same"))
    key = F.sha2(F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8"), 256)
    return without(docs, F.col(id_col), key, out, BROADCAST_KEYS)
