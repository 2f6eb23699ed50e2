"""Tables written to the folder all nodes share, to cut lineage and to reuse costly results."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_WRITTEN: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; in local mode a fresh one, if that is unset.

    A cluster without the setting is refused, as executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all nodes share")
    configured = "file://" + tempfile.mkdtemp(prefix="tessera-")
    spark.conf.set("spark.checkpoint.dir", configured)
    return configured


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is written there goes when the driver ends."""
    path = f"{shared_dir(spark)}/tessera/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: later plans start from the files,
    so a lost executor costs the lost tasks and not the whole history."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a written path through the file system that owns it."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(df: DataFrame) -> None:
    """Delete the files of a table from materialize() that no later plan reads."""
    for root in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/tessera/" in root:
            remove(df.sparkSession, root)


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already; then nothing can be removed
            return
