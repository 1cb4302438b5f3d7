"""Text quality by compression: two zstandard dictionaries, built from good and from bad labelled text.

A text is compressed twice in short independent chunks, so that the dictionary helps everywhere in it and not only at its
beginning. The normalised difference ``(bad - good) / (bad + good)`` of the two compressed sizes says which dictionary
knows the text better; a logistic curve, fitted on labelled texts that no dictionary has seen, turns it into the
probability of the good label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.llm.worker import claim
from locusflow.session import prepare_workers

#: Bytes of a chunk, of a dictionary, and the level of compression.
CHUNK, DICTIONARY, LEVEL = 512, 1 << 18, 3
#: Labelled texts of each kind that a dictionary is built from, and texts that the curve is fitted on, at most.
DICTIONARY_ROWS, CURVE_ROWS = 2_500, 4_000
#: Chunks of one text that go into a dictionary's sample, at most; they are spread over the whole text.
SAMPLE_CHUNKS = 16
#: A document is held out from fitting if the CRC-32 of its id, as text, is divisible by this.
FOLDS = 5
#: One labelled text of so many is for the curve, the others for the dictionaries.
CURVE_SHARE = 4
GOOD_FROM = 0.3


@dataclass(frozen=True)
class Quality:
    """Two dictionaries and a curve; without dictionaries the score is the same for every text."""

    bad: bytes
    good: bytes
    slope: float
    offset: float


def held_out(ident: Column, folds: int = FOLDS) -> Column:
    """Whether a document is kept from fitting; a null id counts as an empty text."""
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % folds == 0


def chunks(data: bytes) -> list[bytes]:
    return [data[i : i + CHUNK] for i in range(0, len(data), CHUNK)]


def build(samples: list[bytes]) -> bytes:
    """A dictionary from sample chunks: zstandard's training, or the chunks themselves where they are too few for it."""
    if sum(map(len, samples)) > 8 * DICTIONARY:
        try:
            return zstandard.train_dictionary(DICTIONARY, samples).as_bytes()
        except zstandard.ZstdError:
            pass  # samples that it finds nothing in
    return b"".join(samples)[-DICTIONARY:]


class Sizes:
    """Compressed sizes of texts with each of some dictionaries."""

    def __init__(self, *dictionaries: bytes):
        self.compressors = []
        for data in dictionaries:
            known = zstandard.ZstdCompressionDict(data)
            known.precompute_compress(level=LEVEL)
            self.compressors.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False))

    def difference(self, text: str) -> float:
        """(first - second) / (first + second), over all chunks of the whole text; 0 for an empty one."""
        parts = chunks(text.encode())
        first, second = (sum(len(c.compress(p)) for p in parts) for c in self.compressors)
        return (first - second) / (first + second) if parts else 0.0


def fit_curve(x: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """(slope, offset) of the logistic curve, by Newton's method.

    Each kind gets one text's weight of doubt, so that perfectly separated kinds don't send the slope to infinity.
    """
    good, bad = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    scale = x.std() or 1.0
    a = np.stack([x / scale, np.ones(len(x))], 1)
    w = np.array([0.0, np.log((good + 1) / (bad + 1))])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        gradient = a.T @ (p - goal) + 1e-6 * w
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 1e-6 * np.eye(2), gradient)
        w = w - step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-10:
            break
    return float(w[0] / scale), float(w[1])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", dictionary_rows: int = DICTIONARY_ROWS, curve_rows: int = CURVE_ROWS, folds: int = FOLDS) -> Quality:
    """Fits a model on labelled rows that aren't held out.

    Bounded samples, by hashed id: ``dictionary_rows`` texts of each label for the dictionaries, ``curve_rows`` others for
    the curve. Rows with a null id, text or label take no part, and an id that is labelled several times has the smallest
    of its labels (1 is good, all below bad). Without labels of both kinds in both parts the model has no dictionaries,
    and its score is the share of good labels (0.5 without any).
    """
    prepare_workers(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y"))
    known = known.where(~held_out(F.col("id"), folds)).groupBy("id").agg((F.min("y") > 0).cast("int").alias("y"))
    known = known.withColumn("h", F.xxhash64("id", F.lit("quality")))
    for_curve = F.pmod("h", F.lit(CURVE_SHARE)) == 0
    parts = [known.where(~for_curve & (F.col("y") == y)).orderBy("h", "id").limit(dictionary_rows) for y in (0, 1)]
    curve = known.where(for_curve).orderBy("h", "id").limit(curve_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                found = chunks(batch.column(1)[i].as_py().encode())
                some = [found[j] for j in np.unique(np.linspace(0, len(found) - 1, min(len(found), SAMPLE_CHUNKS)).astype(int))] if found else []
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[i].as_py()], pa.int32()), pa.array([some], pa.list_(pa.binary()))], ["y", "parts"])

    chosen = F.broadcast(parts[0].unionByName(parts[1]))
    seen = texts.join(chosen, "id").select("y", "text").mapInArrow(sample, "y int, parts array<binary>").collect()
    samples = [sorted(bytes(p) for r in seen if r["y"] == y for p in r["parts"]) for y in (0, 1)]
    if not all(samples):
        return _without(known)
    # In an order that doesn't depend on partitions, but isn't that of the alphabet either.
    order = np.random.default_rng(0)
    bad, good = (build([s[i] for i in order.permutation(len(s))]) for s in samples)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        sizes = Sizes(bad, good)
        for batch in batches:
            x = [sizes.difference(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["y", "x"])

    points = np.array(sorted((r["x"], r["y"]) for r in texts.join(F.broadcast(curve), "id").select("y", "text").mapInArrow(measure, "y int, x double").collect()))
    if not len(points) or len(np.unique(points[:, 1])) < 2:
        return _without(known)
    return Quality(bad, good, *fit_curve(points[:, 0], points[:, 1]))


def _without(known: DataFrame) -> Quality:
    share = known.agg(F.avg("y")).first()[0]
    share = 0.5 if share is None else min(max(float(share), 1e-6), 1 - 1e-6)
    return Quality(b"", b"", 0.0, float(np.log(share / (1 - share))))


def score_quality(docs: DataFrame, model: Quality, id_col: str = "doc_id", text_col: str = "text", folds: int = FOLDS, good_from: float = GOOD_FROM) -> DataFrame:
    """One row per input row: (id_col, held_out, score, predicted).

    score is the probability of label 1, from the whole text; predicted is 1 from ``good_from`` on. A null text counts as
    empty, and an empty text scores as one that both dictionaries know equally well. Repeated rows and null ids are rows
    like others (a null id is held out); other columns are ignored; no rows give no rows. The model is of bounded size
    (two dictionaries of DICTIONARY bytes) and travels with the code.
    """
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("quality", lambda: None)
        sizes = Sizes(model.bad, model.good) if model.slope else None
        for batch in batches:
            x = np.array([sizes.difference(t) if sizes else 0.0 for t in batch.column(2).to_pylist()], np.float64)
            score = 1 / (1 + np.exp(-np.clip(model.slope * x + model.offset, -500, 500)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= good_from).astype(np.int32))], ["id", "held_out", "score", "predicted"])

    source = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col), folds).alias("held_out"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)
