"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from py4j.protocol import Py4JError
from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # let a skewed join be split even where that costs one more exchange
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # wide cleaning projections: do not generate methods that the JVM refuses to compile
    "spark.sql.codegen.hugeMethodLimit": "8000",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def get_session(master: str | None = None, app: str = "cantiere", **conf: str) -> SparkSession:
    """Session with the defaults above; explicit settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


#: Folders this process has named, removed when it ends.
_MADE: list[tuple[SparkSession, str]] = []


def scratch_dir(spark: SparkSession, purpose: str) -> str:
    """New folder name below the shared folder of ``spark.checkpoint.dir``, removed when the process ends.

    The cluster names that folder; only a local session without the setting gets a
    folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="cantiere-")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if not _MADE:
        atexit.register(_remove_made)
    _MADE.append((spark, path))
    return path


def _remove_made() -> None:
    """Delete the folders of this process, as far as its JVM still answers."""
    for spark, path in _MADE:
        try:
            _file_system(spark, path).delete(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path), True)
        except (Py4JError, OSError, AttributeError):
            return


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path).getFileSystem(jvm.org.apache.hadoop.conf.Configuration())


def qualified(spark: SparkSession, path: str) -> str:
    """Path with the scheme of Spark's default file system where it has none."""
    name = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return name.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(name).toString()
