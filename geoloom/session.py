"""Session helpers."""

from __future__ import annotations

import logging
import os
import tempfile
import time
import uuid
import zipfile
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

LOG = logging.getLogger("geoloom")
_SHIPPED: set[str] = set()
_KEPT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    at = os.path.join(tempfile.mkdtemp(prefix="geoloom-code-"), "geoloom.zip")
    with zipfile.ZipFile(at, "w") as z:
        for folder, _, names in os.walk(root):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(p := os.path.join(folder, n), os.path.join("geoloom", os.path.relpath(p, root)))
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_path(spark: SparkSession, name: str = "work") -> str:
    """A fresh path that driver and executors share; it goes when the application's file systems close.

    It lies under spark.checkpoint.dir, else the context's checkpoint folder. Without both, a local folder serves a
    local master; on a cluster that is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
        base = known.get()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="geoloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    own = f"{base.rstrip('/')}/geoloom-{spark.sparkContext.applicationId}"
    if own not in _KEPT:
        _KEPT.add(own)
        path = spark._jvm.org.apache.hadoop.fs.Path(own)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return f"{own}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """df written once to shared storage and read back: shared by several consumers, safe when executors go."""
    path = shared_path(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def measured(title: str):
    """Logs how long the block took."""
    began = time.perf_counter()
    yield
    LOG.info("%s: %.1f ms", title, (time.perf_counter() - began) * 1000)
