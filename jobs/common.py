"""What the jobs share: their configuration, their log and their command line."""

from __future__ import annotations

import argparse
import dataclasses
import json
import logging
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def configured(kind: type, given: dict):
    """The configuration of a job: its defaults with what is given; unknown keys and other types are errors."""
    known = {f.name: f.type for f in dataclasses.fields(kind)}
    for key, value in given.items():
        if key not in known:
            raise ValueError(f"unknown setting {key}; there are {', '.join(known)}")
        wanted = {"int": int, "float": (int, float), "str": str}[known[key]]
        if isinstance(value, bool) or not isinstance(value, wanted):
            raise ValueError(f"setting {key} isn't of type {known[key]}")
    return kind(**given)


def written(spark: SparkSession, path: str, schema: str, log: logging.Logger) -> DataFrame:
    """What has been written to a path, read back; the log says how many rows that are (the files' footers tell)."""
    out = spark.read.schema(schema).parquet(path)
    log.info("wrote %d rows to %s", out.count(), path)
    return out


def main(name: str, kind: type, run: Callable, text: str) -> int:
    """Command line of a job: makes a session, runs the job with the file of settings, and ends the session."""
    parser = argparse.ArgumentParser(prog=f"python -m jobs.{name}", description=text)
    parser.add_argument("--input", required=True, help="folder of the tables; any path that Spark reads")
    parser.add_argument("--output", required=True, help="folder of the results; any path that Spark writes")
    parser.add_argument("--config", help="JSON file of settings; any path that Spark reads")
    given = parser.parse_args()
    logging.basicConfig(stream=sys.stderr, level=logging.WARNING, format="%(asctime)s %(name)s %(message)s")
    logging.getLogger("jobs").setLevel(logging.INFO)
    spark = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        settings = json.loads(spark.read.text(given.config, wholetext=True).first()[0]) if given.config else {}
        run(spark, given.input, given.output, configured(kind, settings))
    finally:
        spark.stop()
    return 0
