"""Tables in the folder that driver and executors share, which cut the lineage of long plans."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Only where the session has none and runs in one process (tests) is a temporary folder
    made and set; executors elsewhere would not see it.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="checkpoints-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to the shared folder and read it back.

    This cuts the lineage: a lost executor costs only the tasks it was running.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/logloom-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by written() that nothing needs any more."""
    root = shared_dir(spark).removeprefix("file://")
    folders = {f.rpartition("/")[0] for f in df.inputFiles()}
    jvm = spark.sparkContext._jvm
    for folder in folders:
        if "/logloom-" in folder and root in folder:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """written() for tables that are removed at the end; what is made of them must be written by then."""
    made: list[DataFrame] = []

    def put(df: DataFrame, label: str) -> DataFrame:
        made.append(written(df, label))
        return made[-1]

    try:
        yield put
    finally:
        for df in made:
            removed(spark, df)
