import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from locusflow.llm import quality as op
from locusflow.session import table

LABELS = "doc_id long, quality int, text string"


def prose(rng, n):
    words = ["river", "stone", "light", "garden", "window", "slowly", "under", "the", "a", "walked", "morning"]
    return " ".join(rng.choice(words) for _ in range(n))


def junk(rng, n):
    return " | ".join(rng.choice(["BUY$$", "win!!", "click%%", "free##"]) for _ in range(n))


def corpus(n=400):
    rng = random.Random(2)
    rows = [(i, (junk if i % 3 == 0 else prose)(rng, rng.randrange(20, 400))) for i in range(n)]
    return rows, [(i, int(i % 3 != 0), "clash") for i in range(n)]


def test_tells_held_out_texts_apart_and_learns_nothing_from_them(spark, docs_of):
    rows, labels = corpus()
    rows += [(1000, None), (1001, ""), (1002, "x"), (1003, prose(random.Random(3), 300_000)), (None, "no id"), rows[4], (2, "another text of the same id")]
    docs, frame = docs_of(rows), spark.createDataFrame(labels + [(5, None, ""), (None, 1, ""), (9999, 0, "")], LABELS)
    model = op.train_quality(docs, frame)
    out = op.score_quality(docs, model).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(i) for i, _ in rows)
    truth = {i: q for i, q, _ in labels}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)
        assert r["held_out"] == (zlib.crc32(("" if r["doc_id"] is None else str(r["doc_id"])).encode()) % 5 == 0)
        if r["doc_id"] in truth and r["doc_id"] != 2:
            assert (r["score"] >= 0.5) == bool(truth[r["doc_id"]])
    empty = {r["score"] for r in out if r["doc_id"] in (1000, 1001)}
    assert len(empty) == 1
    assert next(r["score"] for r in out if r["doc_id"] == 1003) > 0.9
    # Wrong labels of held-out rows change nothing.
    wrong = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, t) for i, q, t in labels]
    again = op.train_quality(docs.repartition(5), spark.createDataFrame(wrong, LABELS))
    assert again == op.train_quality(docs, spark.createDataFrame(labels, LABELS))


def test_scores_are_those_of_the_definition(spark, docs_of):
    """Against sizes counted straight from the compressor, chunk by chunk."""
    import zstandard

    rows, labels = corpus(120)
    docs = docs_of(rows)
    model = op.train_quality(docs, spark.createDataFrame(labels, LABELS))
    got = {r["doc_id"]: r["score"] for r in op.score_quality(docs, model).collect()}
    for i, text in rows:
        data, size = text.encode(), [0, 0]
        for k, d in enumerate((model.bad, model.good)):
            for at in range(0, len(data), op.CHUNK):
                one = zstandard.ZstdCompressor(level=op.LEVEL, dict_data=zstandard.ZstdCompressionDict(d), write_content_size=False, write_dict_id=False)
                size[k] += len(one.compress(data[at : at + op.CHUNK]))
        x = (size[0] - size[1]) / (size[0] + size[1])
        assert np.isclose(got[i], 1 / (1 + np.exp(-(model.slope * x + model.offset))))


def test_without_labels_of_both_kinds(spark, docs_of):
    docs = docs_of([(1, "a"), (2, None)])
    for labels, score in (([], 0.5), ([(i, 1, "") for i in range(9)], 1 - 1e-6)):
        out = op.score_quality(docs, op.train_quality(docs, spark.createDataFrame(labels, LABELS))).collect()
        assert [round(r["score"], 6) for r in out] == [round(score, 6)] * 2
    none = docs_of([])
    assert op.score_quality(none, op.train_quality(none, spark.createDataFrame([(1, 0, "")], LABELS))).count() == 0


def test_the_curve_is_calibrated():
    rng = np.random.default_rng(0)
    x = rng.normal(0, 0.02, 20_000)
    y = (rng.random(len(x)) < 1 / (1 + np.exp(-(90 * x + 0.7)))).astype(float)
    slope, offset = op.fit_curve(x, y)
    assert abs(slope - 90) < 5 and abs(offset - 0.7) < 0.1
    slope, offset = op.fit_curve(np.array([-1.0, -0.9, 0.9, 1.0]), np.array([0.0, 0, 1, 1]))
    assert 0 < slope < 100


def test_held_out_accuracy_on_the_given_table(spark, sf):
    sf = sf.replace("0.001", "0.1")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    out = op.score_quality(docs, op.train_quality(docs, labels)).where("held_out").join(labels.where("quality IS NOT NULL"), "doc_id")
    seen = out.select((F.col("predicted") == F.col("quality")).cast("int").alias("hit"), F.pow(F.col("score") - F.col("quality"), 2).alias("brier")).agg(F.avg("hit"), F.avg("brier"), F.count("*")).first()
    assert seen[2] > 500 and seen[0] > 0.95 and seen[1] < 0.04
