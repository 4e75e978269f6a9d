"""What the operators of this subpackage share: table access, bounded Arrow batches, shared files."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

#: Bounds of what one Python worker holds at a time.
BATCH_ROWS, BATCH_BYTES = 2000, "16m"

#: White space as the contracts know it: U+0020 and U+0009 to U+000D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def arrow_map(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """mapInArrow with batches bounded in rows and bytes, so long texts cannot fill a worker."""
    conf = df.sparkSession.conf
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return df.mapInArrow(fn, schema)


def spare(name: str, *frames: DataFrame) -> str:
    """``name``, with underscores before it until no column of ``frames`` has it."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(folder: str, name: str, data: bytes) -> str:
    """Write whole under a name of its own: a retried or doubled task never touches another's file.

    Readers take the names from the rows of the attempt that succeeded.
    """
    fs, path = file_system(folder)
    fs.create_dir(path, recursive=True)
    own = f"{name}-{uuid.uuid4().hex}"
    with fs.open_output_stream(f"{path}/.{own}") as f:
        f.write(data)
    fs.move(f"{path}/.{own}", f"{path}/{own}")
    return own


def get_file(folder: str, name: str) -> bytes:
    fs, path = file_system(folder)
    with fs.open_input_file(f"{path}/{name}") as f:
        return f.read()
