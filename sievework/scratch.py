"""Tables that cut lineage, kept in the folder the cluster names in ``spark.checkpoint.dir``.

A written table survives the loss of any executor, unlike a local checkpoint, and Parquet is
compressed, unlike a checkpointed RDD.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: (session, path, owner) of the tables that were written and not yet deleted.
_OPEN: list[tuple[SparkSession, str, str]] = []
_OWNER: ContextVar[str] = ContextVar("owner", default="")


@contextmanager
def owned(owner: str) -> Iterator[None]:
    """Tables written inside belong to ``owner``, and only ``release`` with that name deletes them."""
    before = _OWNER.set(owner)
    try:
        yield
    finally:
        _OWNER.reset(before)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, ``spark.checkpoint.dir``; in local mode, where every task runs on this machine, one of our own if the session names none."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.gettempdir()}/checkpoints/sievework"
    return base.rstrip("/")


def new_dir(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    _OPEN.append((spark, path, _OWNER.get()))
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later uses neither recompute nor lose it."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession, owner: str) -> None:
    """Delete the tables of ``owner``, for callers whose results are stored elsewhere; nobody else's are touched."""
    for entry in [x for x in _OPEN if x[0] is spark and x[2] == owner]:
        delete(spark, entry[1])
        _OPEN.remove(entry)
