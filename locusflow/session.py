"""Session helpers shared by every part of the engine."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_own_dirs: dict[str, str] = {}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` below ``folder``; only Spark's reader touches the path."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver can reach, as a URI.

    It is the one that the cluster names in ``spark.checkpoint.dir``. Only a local session, where driver and executors
    are one process, may fall back to a temporary folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named if "://" in named else f"file://{os.path.abspath(named)}"
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_dirs:
        path = tempfile.mkdtemp(prefix="locusflow-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _own_dirs[app] = f"file://{path}"
    return _own_dirs[app]


def scratch(spark: SparkSession, tag: str) -> str:
    """A path below the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/locusflow/{tag}-{uuid.uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a path of the shared folder, wherever that lives."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: Rows of a small table's file.
FILE_ROWS = 50_000


def persisted(df: DataFrame, tag: str, most_rows: int | None = None) -> DataFrame:
    """``df`` written once to the shared folder and read again: short lineage that outlives any executor.

    ``most_rows``, if known, bounds the number of its rows: a small table becomes a few files, not one for each of many
    partitions.
    """
    spark = df.sparkSession
    path = scratch(spark, tag)
    if most_rows is not None:
        df = df.coalesce(max(1, -(-most_rows // FILE_ROWS)))
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _written[out] = path
    return out


#: Paths of written frames, for as long as somebody holds the frame.
_written: weakref.WeakKeyDictionary = weakref.WeakKeyDictionary()


def release(*frames: DataFrame) -> None:
    """Deletes what :func:`persisted` wrote for these frames: nothing that is still to run may read them."""
    for df in frames:
        remove(df.sparkSession, _written.pop(df))


def columns_of(df: DataFrame, *without: str) -> list:
    """A frame's columns, quoted so that any name will do."""
    return [F.col(f"`{c}`") for c in df.columns if c not in without]


#: Bytes of rows that a Python worker gets at a time: with several workers on an executor, batches are what takes memory.
BATCH_BYTES = 2 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def prepare_workers(spark: SparkSession) -> None:
    """Sees to it that Python workers can import this package and get rows in small batches.

    Clusters have the package installed; a local session is told where it is. A smaller batch that the session asks for
    is left alone.
    """
    sc = spark.sparkContext
    if sc.master.startswith("local["):
        known = sc.environment.get("PYTHONPATH", "")
        if ROOT not in known.split(os.pathsep):
            sc.environment["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, known) if x)
    now = spark.conf.get(_BATCH, None)
    digits = "".join(c for c in now or "" if c.isdigit())
    if not digits or not (now or "").rstrip("bB").isdigit() or not 0 < int(digits) <= BATCH_BYTES:
        spark.conf.set(_BATCH, str(BATCH_BYTES))
