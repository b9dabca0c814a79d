"""Shared storage for intermediate tables.

Intermediate results that are read more than once are written as Parquet under
the folder named by ``spark.checkpoint.dir``: the driver and all executors see
it, so losing an executor costs a re-read and never a re-computation.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set and all runs on this machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.conf.get("spark.master", "")
        if master.split("[")[0] != "local":
            raise ValueError(f"spark.checkpoint.dir must name a folder that all machines of {master} share")
        path = f"file://{tempfile.gettempdir()}/checkpoints"
        spark.conf.set("spark.checkpoint.dir", path) if spark.conf.isModifiable("spark.checkpoint.dir") else None
    return path.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; removed when the driver exits."""
    path = f"{shared_dir(spark)}/loomkb-{uuid.uuid4().hex}/{name}"
    _written.append((spark, path.rsplit("/", 1)[0]))
    return path


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back.

    Cuts the lineage, fixes the result against task retries and gives the
    optimizer real sizes. Column names must be unique.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_scratch(spark: SparkSession) -> None:
    """Delete the tables written for ``spark``; call it when their results are no longer read."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for owner, path in list(_written):
        if owner is spark:
            folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(hadoop).delete(folder, True)
            _written.remove((owner, path))


@atexit.register
def _at_exit() -> None:
    for spark in {id(s): s for s, _ in _written}.values():
        try:
            if spark.sparkContext._jsc is not None:
                remove_scratch(spark)
        except Exception:  # the engine may already be gone at interpreter exit
            return
