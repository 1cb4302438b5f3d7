import random

import corpus_pipeline
from locusflow.llm.queries import ORACLES, QUERIES


def test_every_operator_has_its_query():
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 13)]
    assert set(ORACLES) <= set(QUERIES)


def test_stages_take_effect(spark, tmp_path):
    rng = random.Random(4)

    def words(n):
        return [f"{rng.choice('abcdefgh')}{rng.randrange(3000)}" for _ in range(n)]

    passage = words(80)
    rows, labels = [], []
    for i in range(120):
        w = words(120)
        if i % 6 == 0:
            w[5:5] = ["idiot", "moron", "scum", "trash"]
            labels.append((i, 1, 1))
        else:
            labels.append((i, 1, 0))
        rows.append((i, " ".join(w)))
    clean = [i for i in range(120) if i % 6]
    rows += [(200, rows[1][1]), (201, rows[1][1] + " more"), (202, " ".join(words(30) + passage)), (203, " ".join(passage + words(30))), (204, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    ids, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "packing":
            assert now.dtypes == docs.dtypes
            ids[name] = sorted(r["doc_id"] for r in now.collect())
    assert ids["toxicity"] == [*clean, 200, 201, 202, 203, 204]
    assert ids["exact_dedup"] == [*(i for i in clean if i != 1), 200, 201, 202, 203, 204]
    assert ids["near_dedup"] == ids["substring_dedup"] == [*(i for i in clean if i != 1), 200, 202, 203, 204]
    cut = spark.read.parquet(f"{tmp_path}/substring_dedup").where("doc_id = 203").first()
    assert len(cut["text"].split()) == 30 and cut["n_chars"] == len(cut["text"])
    run = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(run.drop("sequence_id").collect()) == sorted(now.drop("sequence_id").collect())
    assert {r["doc_id"] for r in run.collect()} == set(ids["substring_dedup"])


SHAPE = "doc_id long, text string, lang string, source string, n_chars long"


def run(spark, folder, rows):
    spark.createDataFrame([(i, t, "en", None, None) for i, t in rows], SHAPE).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i == 1)) for i, _ in rows if i is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return corpus_pipeline.run(spark, str(folder)).collect()


def test_empty_table(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_nulls_repeats_and_long_texts(spark, tmp_path):
    """Texts without words are one group of copies; a repeated row stays once; a null id is an id like others."""
    rng = random.Random(6)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(150_000))
    rows = [(1, "some text of its own"), (1, "some text of its own"), (2, None), (3, ""), (None, "a text without an id"), (4, long), (5, "x" * 300_000)]
    out = run(spark, tmp_path, rows)
    assert {r["doc_id"] for r in out} == {1, 3, 4, 5, None} or {r["doc_id"] for r in out} == {1, 2, 4, 5, None}
    per = {}
    for r in out:
        per.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["doc_tokens"]))
    for pieces in per.values():
        assert sum(n for _, n, _ in pieces) == pieces[0][2]
