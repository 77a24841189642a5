"""Session helpers: table loading and tables written to the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_LOCAL_FOLDER: list[str] = []
#: Folders written in each open `temporary_tables`.
_OPEN: list[list[str]] = []


def load(spark: SparkSession, folder: str, table: str) -> DataFrame:
    """One of the Parquet tables in `folder`; read by Spark, so any file system will do."""
    return spark.read.parquet(f"{folder}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of `spark.checkpoint.dir`, which driver and executors share.

    A session of one process (a local test) that names none gets a temporary folder, which goes
    when the process ends. On a cluster every executor would write to a disk of its own, so there it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"spark.checkpoint.dir must name a folder that driver and executors share (master {master})")
    if not _LOCAL_FOLDER:
        _LOCAL_FOLDER.append(tempfile.mkdtemp(prefix="panolith-"))
        atexit.register(shutil.rmtree, _LOCAL_FOLDER[0], ignore_errors=True)
    return f"file://{_LOCAL_FOLDER[0]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again.

    This cuts the lineage with files that outlive any executor, and the reread table has no
    partitioning of its own, so that joins on it get plain exchanges, which adaptive
    execution can split at hot keys. `discard` or `temporary_tables` removes the files.
    """
    spark = df.sparkSession
    folder = f"{shared_folder(spark)}/panolith-{uuid.uuid4().hex}"
    if _OPEN:
        _OPEN[-1].append(folder)
    df.write.parquet(f"{folder}/{name}")
    again = spark.read.schema(df.schema).parquet(f"{folder}/{name}")
    again._panolith_folder = folder
    return again


def discard(df: DataFrame) -> None:
    """Delete the files of a table from `written` that no later plan reads."""
    _delete(df.sparkSession, df._panolith_folder)


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Remove what `written` wrote inside, but the tables put on the list that this gives.

    Results made inside are plans over those files: write or collect them before the end.
    """
    kept: list[DataFrame] = []
    _OPEN.append([])
    try:
        yield kept
    finally:
        stay = {df._panolith_folder for df in kept}
        made = _OPEN.pop()
        for folder in made:
            if folder not in stay:
                _delete(spark, folder)
        if _OPEN:
            _OPEN[-1].extend(f for f in made if f in stay)
