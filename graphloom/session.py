"""Session defaults and the shared folder that tables are handed over in."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "graphloom", cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the engine is tuned for."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def reach(spark: SparkSession) -> SparkSession:
    """Let Python workers that start from now on import this package, wherever the driver found it."""
    root, known = str(Path(__file__).resolve().parent.parent), spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(":"):
        spark.sparkContext.environment["PYTHONPATH"] = f"{known}:{root}".strip(":")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    ``spark.checkpoint.dir`` where the session has it. Only a local session without it gets a
    temporary folder; on a cluster the warehouse stands in.
    """
    found = spark.conf.get("spark.checkpoint.dir", "") or ""
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local[") or spark.sparkContext.master == "local":
        found = "file://" + tempfile.mkdtemp(prefix="graphloom-")
    else:
        found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_graphloom"
    spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder by whatever file system holds it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


_made: list[tuple[SparkSession, str]] = []


def _clear() -> None:
    while _made:
        spark, path = _made.pop()
        try:
            delete_path(spark, path)
        except Exception:  # the session may have ended before the interpreter
            return


atexit.register(_clear)


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the interpreter ends."""
    path = f"{shared_dir(spark)}/graphloom/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and outlives executors.

    Returns the table and its path, so that a loop can drop what it no longer needs.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def release(spark: SparkSession, path: str) -> None:
    """Drop a materialised table that nothing reads any more."""
    delete_path(spark, path)
    if (spark, path) in _made:
        _made.remove((spark, path))
