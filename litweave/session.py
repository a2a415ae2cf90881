"""Session helpers: where tables shared by all executors may be written."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder named by `spark.checkpoint.dir`.

    A session in one process (tests) gets a temporary one when the setting is missing; with
    executors of their own, a machine-local folder would not be readable by all, so it must be set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors can reach")
    app = spark.sparkContext.applicationId
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="litweave-")
    return _own_folder[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def packed(df: DataFrame, path: str, *folders: str, file_rows: int | None = None) -> None:
    """Write `df` at `path`, in zstd: such tables are read a few times by machines, so size counts most."""
    to = df.write.partitionBy(*folders).option("compression", "zstd")
    (to.option("maxRecordsPerFile", file_rows) if file_rows else to).parquet(path)


def written(df: DataFrame, name: str, file_rows: int | None = None) -> DataFrame:
    """Write `df` as a table in the shared folder, of files of at most `file_rows` rows if given, and read it back.

    Cuts the lineage for good: a lost executor re-reads files instead of re-running the job.
    """
    path = new_folder(df.sparkSession, name)
    packed(df, path, file_rows=file_rows)
    return df.sparkSession.read.parquet(path)
