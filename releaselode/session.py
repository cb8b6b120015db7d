"""What sessions need besides Spark's own settings."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
_scratch: list[str] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver was started."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    fd, name = tempfile.mkstemp(prefix=f"{_PACKAGE.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as z:
        for p in sorted(_PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(_PACKAGE.parent))
    spark.sparkContext.addPyFile(name)
    atexit.register(Path(name).unlink, missing_ok=True)
    _shipped.add(app)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Only on a single machine, as in tests, a local folder is chosen and set where that setting is absent; a cluster needs it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = Path(tempfile.mkdtemp(prefix="checkpoints-")).as_uri()
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _scratch.append(path)
    return path


def clean(spark: SparkSession) -> None:
    """Delete all scratch folders that this process has made. Results that were not written yet read from them."""
    while _scratch:
        path = spark._jvm.org.apache.hadoop.fs.Path(_scratch.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df, written below spark.checkpoint.dir and read again: cuts the lineage, and survives lost executors."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
