import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Makes a documents table, over several partitions, with columns whose names clash with those of results."""

    def make(rows, clash=True):
        frame = spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], DOC)
        if clash:
            from pyspark.sql import functions as F

            for name in ("id", "h", "kept", "keep_id", "class_id", "n_links", "text_sha256", "row", "node", "a.b"):
                frame = frame.withColumn(name, F.lit("other"))
        return frame.repartition(3)

    return make
