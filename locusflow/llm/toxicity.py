"""Severity grades by cumulative-link ordinal regression on sparse text features.

``P(grade > k) = sigmoid(w . x - theta_k)`` with one weight vector for all thresholds and ordered thetas. x is sparse: which
of a fitted vocabulary's terms a text holds. A term is a word or the first four or five characters of a longer word (written with a
``^``), so inflected forms of a root count together. The output is the expected severity, the sum over k of P(grade > k).
"""

from __future__ import annotations

import re
import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locusflow.llm.worker import claim
from locusflow.session import persisted, prepare_workers

#: Documented bound of the sample that the model is fitted on, in labelled documents.
SAMPLE_ROWS = 12_000
#: Terms kept, those that tell the labels apart best.
TERMS = 1_000
#: A term needs this share of the sampled toxic documents, and this many standard deviations above chance.
TOXIC_SHARE, DEVIATIONS = 0.01, 4.0
#: Grades: none, mild, severe.
GRADES = 3
ROOTS = (4, 5)
_WORD = re.compile(r"[^\W\d_]+")


def terms(text: str) -> set[str]:
    """The terms of a text."""
    words = set(_WORD.findall(text.lower()))
    return words.union(*({"^" + w[:k] for w in words if len(w) > k} for k in ROOTS))


@dataclass
class Ordinal:
    """A fitted model: weights by term, ordered thresholds."""

    weights: dict[str, float]
    thetas: list[float]


def fit(indices: list[np.ndarray], grades: np.ndarray, width: int, levels: int = GRADES, penalty: float = 1e-4, steps: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thetas) of the regression with an L2 penalty, by full-batch Adam on sparse rows.

    Terms are chosen as signs of toxicity, so weights stay at zero or above: no word makes up for an insult.

    Thetas are kept ordered through ``theta_k = theta_0 + sum of exp(gaps)``.
    """
    rows = np.repeat(np.arange(len(indices)), [len(i) for i in indices])
    columns = np.concatenate(indices) if indices else np.empty(0, np.int64)
    n, cuts = max(len(indices), 1), levels - 1
    over = (grades[:, None] > np.arange(cuts)[None, :]).astype(float)
    share = np.clip(over.mean(0) if len(grades) else np.full(cuts, 0.5), 1 / (2 * n), 1 - 1 / (2 * n))
    start = np.log((1 - share) / share)
    params = np.concatenate([np.zeros(width), [start[0]], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, first, gaps = params[:width], params[width], np.exp(params[width + 1 :])
        thetas = first + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(rows, weights=w[columns], minlength=len(indices))
        # Probabilities of the cumulative events, then of the grade itself.
        p = 1 / (1 + np.exp(-np.clip(z[:, None] - thetas, -50, 50)))
        edge = np.concatenate([np.ones((len(z), 1)), p, np.zeros((len(z), 1))], 1)
        slope = np.concatenate([np.zeros((len(z), 1)), p * (1 - p), np.zeros((len(z), 1))], 1)
        at = np.arange(len(z))
        own = np.maximum(edge[at, grades] - edge[at, grades + 1], 1e-12)
        dz = -(slope[at, grades] - slope[at, grades + 1]) / own / n
        dt = np.zeros(levels + 1)
        np.add.at(dt, grades, slope[at, grades] / own / n)
        np.add.at(dt, grades + 1, -slope[at, grades + 1] / own / n)
        dt = dt[1:-1]
        tail = np.cumsum(dt[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, weights=dz[rows], minlength=width)[:width] + penalty * w, [tail[0]], tail[1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        params = params - 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        np.maximum(params[:width], 0, out=params[:width])
    thetas = params[width] + np.concatenate([[0.0], np.cumsum(np.exp(params[width + 1 :]))])
    return params[:width], thetas


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS, levels: int = GRADES) -> Ordinal:
    """Fits a model on a bounded sample of the labelled rows: the ``sample_rows`` with the smallest hashed ids.

    Labels only say toxic or not, so the grades of toxic documents come from how much evidence their terms carry (the sum
    of the terms' deviations from chance): those above the quantiles between them are the more severe ones. Rows with a null id, text or label take no part; an id that
    is labelled several times is toxic if one of its labels says so. Without labels of
    both kinds, or without a term that tells them apart, the model has no terms and calls nothing toxic; the latter gives
    a warning.
    """
    prepare_workers(docs.sparkSession)
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).groupBy("id").agg(F.max("y").alias("y"))
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    texts = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for batch in batches:
            found = pa.array([list(terms(t)) for t in batch.column(1).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), found], ["y", "terms"])

    rows = texts.join(F.broadcast(chosen), "id").select("y", "text").mapInArrow(reduce, "y int, terms array<string>")
    rows = persisted(rows, "labelled")
    numbered = rows.withColumn("row", F.monotonically_increasing_id())
    pairs = numbered.select("row", "y", F.explode("terms").alias("t"))
    frequency = pairs.groupBy("t").agg(F.sum("y").alias("a"), F.count("*").alias("n"))
    totals = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not totals.get(0) or not totals.get(1) or levels < 2:
        return Ordinal({}, [1e9] * (levels - 1))
    rate = float(totals[1] / (totals[0] + totals[1]))
    a, n = F.col("a").cast("double"), F.col("n").cast("double")
    # Terms of so many toxic documents, twice as likely there as in clean ones and far beyond chance; the best come first.
    # Shares of the two kinds are compared, so the test means the same whatever part of the labels is toxic.
    apart = a * totals[0] > 2 * (n - a) * totals[1]
    gain = (a - n * rate) / F.sqrt(n * rate * (1 - rate))
    enough = max(3.0, TOXIC_SHARE * totals[1])
    best = [(r["t"], r["g"]) for r in frequency.where((a >= enough) & apart & (gain > DEVIATIONS)).orderBy(F.desc(gain), "t").limit(TERMS).select("t", gain.alias("g")).collect()]
    if not best:
        warnings.warn("no term tells toxic documents from clean ones: nothing will be rejected", stacklevel=2)
        return Ordinal({}, [1e9] * (levels - 1))
    vocabulary = {t: i for i, (t, _) in enumerate(best)}
    strength = np.array([g for _, g in best])
    numbers = docs.sparkSession.createDataFrame([(t, i) for t, i in vocabulary.items()], "t string, i int")
    sparse = pairs.join(F.broadcast(numbers), "t").groupBy("row").agg(F.collect_list("i").alias("i"))
    data = numbered.select("row", "y").join(sparse, "row", "left").orderBy("row").select("y", "i").collect()
    indices = [np.array(sorted(r["i"] or []), np.int64) for r in data]
    evidence = np.array([strength[i].sum() for i in indices])
    grades = np.zeros(len(data), np.int64)
    own = np.flatnonzero([r["y"] for r in data])
    cuts = np.quantile(evidence[own], np.arange(1, levels - 1) / (levels - 1))
    grades[own] = 1 + np.searchsorted(cuts, evidence[own], side="left")
    weights, thetas = fit(indices, grades, len(vocabulary), levels)
    return Ordinal({t: float(weights[i]) for t, i in vocabulary.items() if abs(weights[i]) > 1e-6}, [float(t) for t in thetas])


def predict(docs: DataFrame, model: Ordinal, id_col: str = "doc_id", text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """One row per input row: (id_col, expected_severity, p_toxic, grade, rejected).

    p_toxic is P(grade > 0), grade the most probable grade (the lower one in a tie) and a row is rejected from
    ``reject_from`` of p_toxic on. A null text counts as empty and an empty text has the severity of a text without any
    known term. Repeated rows and null ids are rows like others; other columns are ignored; no rows give no rows. The
    model is of bounded size (TERMS) and travels with the code.
    """
    prepare_workers(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    score = _scores(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for batch in batches:
            above = score(batch.column(1).to_pylist())
            edge = np.concatenate([np.ones((len(above), 1)), above, np.zeros((len(above), 1))], 1)
            grade = (edge[:, :-1] - edge[:, 1:]).argmax(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(above.sum(1)), pa.array(above[:, 0]), pa.array(grade.astype(np.int32)), pa.array(above[:, 0] >= reject_from)], ["id", "expected_severity", "p_toxic", "grade", "rejected"])

    source = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return source.mapInArrow(run, f"id {kind}, expected_severity double, p_toxic double, grade int, rejected boolean").withColumnRenamed("id", id_col)


def keep_harmless(docs: DataFrame, model: Ordinal, text_col: str = "text", reject_from: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that :func:`predict` doesn't reject, with all their columns, in one scan."""
    prepare_workers(docs.sparkSession)
    score, at = _scores(model), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("toxicity", lambda: None)
        for batch in batches:
            above = score([t or "" for t in batch.column(at).to_pylist()])
            yield batch.filter(pa.array(above[:, 0] < reject_from))

    # Plain names on the way through Arrow, whatever the columns are called.
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


def _scores(model: Ordinal):
    """A function from texts to P(grade > k) for each threshold k."""
    thetas = np.array(model.thetas)
    whole = {t: w for t, w in model.weights.items() if not t.startswith("^")}
    roots = {t[1:]: w for t, w in model.weights.items() if t.startswith("^")}

    def score(texts: list[str]) -> np.ndarray:
        z = np.zeros(len(texts))
        for i, text in enumerate(texts):
            words = set(_WORD.findall(text.lower()))
            # In a fixed order, for equal sums everywhere.
            z[i] = sum(whole[w] for w in sorted(words & whole.keys()))
            for k in ROOTS:
                z[i] += sum(roots[r] for r in sorted({w[:k] for w in words if len(w) > k} & roots.keys()))
        return 1 / (1 + np.exp(-np.clip(z[:, None] - thetas[None, :], -500, 500)))

    return score
