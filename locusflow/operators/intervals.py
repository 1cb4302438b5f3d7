"""Joins of points with intervals by bins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def interval_semi(points: DataFrame, key: str, at: str, intervals: DataFrame, interval_key: str, start: str, end: str, width: int) -> DataFrame:
    """Points inside at least one interval [start, end) of their key, each once.

    An interval is listed in every bin of ``width`` that it touches and a point in its own, so the join is an equi-join on
    (key, bin) that Spark can shuffle, broadcast or split by itself.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    bins = intervals.where(F.col(start) < F.col(end)).select(F.col(interval_key).alias("_key"), F.col(start).alias("_start"), F.col(end).alias("_end"), F.explode(F.sequence(first, last)).alias("_bin"))
    p = points.withColumn("_of", F.floor(F.col(at) / width))
    inside = (p[key] == bins["_key"]) & (p["_of"] == bins["_bin"]) & (p[at] >= bins["_start"]) & (p[at] < bins["_end"])
    return p.join(bins, inside, "left_semi").drop("_of")


def clipped_length(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Bases of [start, end) inside [low, high)."""
    return F.greatest(F.least(end, high) - F.greatest(start, low), F.lit(0))


def bed_position(pos: Column) -> Column:
    """The 0-based position of a 1-based one."""
    return pos - 1
