"""Session defaults."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def session(cpus: int | None = None, **conf: str) -> SparkSession:
    """A local session of so many cores; under spark-submit, one with its master and settings, and only ``conf`` on top.

    What code sets outranks what spark-submit was told, so there nothing is set by default.
    """
    submitted = "PYSPARK_GATEWAY_PORT" in os.environ
    builder = SparkSession.builder
    if not submitted:
        cpus = cpus or os.cpu_count() or 1
        builder = builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", str(cpus))
    for k, v in (conf if submitted else DEFAULTS | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def scratch(spark: SparkSession) -> str:
    """A new path in the shared folder that spark.checkpoint.dir names; in a temporary one only where that is unset, which
    on a cluster is an error."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="gridloom-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    return f"{named.rstrip('/')}/gridloom-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A file on whatever file system the path is of."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at)
    out.write(bytearray(data))
    out.close()
