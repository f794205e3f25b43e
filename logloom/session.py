"""A session with the settings that the operators expect."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

#: Rows and bytes of one Arrow batch (a longer row is a batch of its own): they bound what a
#: Python worker holds at once.
ARROW_ROWS, ARROW_BYTES = 512, 4 << 20


def session(app: str = "logloom", **settings: str) -> SparkSession:
    """UTC times, adaptive execution, state of streams in RocksDB; settings override."""
    conf = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    } | {k.replace("__", "."): v for k, v in settings.items()}
    return SparkSession.builder.appName(app).config(map=conf).getOrCreate()


def ship(spark: SparkSession) -> None:
    """See that Python workers can import this package.

    They can if its parent folder is on PYTHONPATH or is the working folder; otherwise a zip
    of the package is added to the session, once.
    """
    root = Path(__file__).resolve().parent.parent
    paths = [Path(p).resolve() for p in [*os.environ.get("PYTHONPATH", "").split(os.pathsep), "."] if p]
    context = spark.sparkContext
    if root in paths or getattr(context, "_logloom_shipped", False):
        return
    made = shutil.make_archive(f"{tempfile.mkdtemp()}/logloom", "zip", root, "logloom")
    context.addPyFile(made)
    context._logloom_shipped = True


def short_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of this session's Python stages: Spark reads the setting when a
    stage starts, so it holds for the session and not for one plan."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
