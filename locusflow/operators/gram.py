"""Sums of outer products of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.session import prepare_workers


def gram(rows: DataFrame, vector: str) -> DataFrame:
    """(a, b, dot) for a <= b: the sum over rows of vector[a] * vector[b]. All vectors have one length.

    Each task multiplies its rows as a matrix and gives back its sum once, so the size of what moves is tasks times the
    matrix, whatever the number of rows.
    """
    prepare_workers(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                total = x.T @ x if total is None else total + x.T @ x
        if total is not None:
            a, b = np.triu_indices(len(total))
            yield pa.RecordBatch.from_arrays([pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(total[a, b])], ["a", "b", "dot"])

    return rows.select(vector).mapInArrow(run, "a int, b int, dot double").groupBy("a", "b").agg(F.sum("dot").alias("dot"))
