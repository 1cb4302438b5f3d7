"""Rows that stay after duplicates were decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locusflow.session import columns_of, persisted


def without(docs: DataFrame, ident: Column, key: Column, decided: DataFrame, broadcast_rows: int) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    ``ident`` and ``key`` are columns of docs; ``decided`` has them as __flow_id and __flow_key, with ``kept`` and
    __flow_same, the number of rows with this id and key, one row for each input row. What goes is the smaller part, so
    the documents meet a list of what goes, not of what stays. Of rows that tie in id and key, one stays at most.
    """
    go = persisted(decided.where("NOT kept OR __flow_same > 1").groupBy("__flow_id", "__flow_key").agg({"kept": "max"}).withColumnRenamed("max(kept)", "__flow_kept"), "go")
    lists = F.broadcast(go) if go.count() <= broadcast_rows else go.hint("merge")
    marked = docs.withColumn("__flow_with", key)
    same = ident.eqNullSafe(F.col("__flow_id")) & (F.col("__flow_with") == F.col("__flow_key"))
    stay = marked.join(lists, same, "left_anti").select(*columns_of(docs))
    tied = go.where("__flow_kept")
    if tied.isEmpty():
        return stay
    one = marked.join(F.broadcast(tied) if go.count() <= broadcast_rows else tied.hint("merge"), same).dropDuplicates(["__flow_id", "__flow_key"])
    return stay.unionByName(one.select(*columns_of(docs)))
