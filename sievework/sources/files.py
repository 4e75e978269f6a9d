"""Source records by the content of their files: hashes are taken on executors, and the same file twice is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.skew import lookup
from sievework.operators.upsert import Table, insert_new

#: A record is its file's content, the sheet and the row.
KEY = ["file_sha256", "source_sheet", "row_no"]


def file_hashes(spark: SparkSession, *paths: str) -> DataFrame:
    """path, length, sha256 of every file under ``paths``, hashed where it is read; a file is one row of up to 2 GB."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(paths))
    return read.select("path", "length", F.sha2("content", 256).alias("sha256"))


def _name(path):
    """The last two parts of a path, which name a file alike in whatever form its path is written."""
    return F.regexp_extract(path, r"([^/]+/[^/]+)$", 1)


def records(spark: SparkSession, sheets: dict[str, str]) -> DataFrame:
    """file_sha256, source_file, source_sheet, row_no, row_sha256, raw (JSON) of every row of Parquet tables, given as sheet to path.

    Rows are numbered from 1 within their file. A table of several files has several contents; files of
    equal content hold the same records, which are kept once when they are saved.
    """
    out = None
    for sheet, path in sheets.items():
        rows = spark.read.parquet(path)
        raw = F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(rows.columns)]))
        rows = rows.select(F.lit(sheet).alias("source_sheet"), F.col("_metadata.file_path").alias("source_file"), (F.col("_metadata.row_index") + 1).alias("row_no"), raw.alias("raw"))
        # many rows look one file up: a hot key where a table is one file
        hashes = file_hashes(spark, path).select(_name(F.col("path")).alias("of"), F.col("sha256").alias("file_sha256"))
        own = lookup(rows.withColumn("file", _name(F.col("source_file"))), hashes, "file", "of")
        own = own.select("file_sha256", "source_file", "source_sheet", "row_no", F.sha2("raw", 256).alias("row_sha256"), "raw")
        out = own if out is None else out.unionByName(own)
    return out


def add_records(new: DataFrame, path: str) -> DataFrame:
    """Save records under their key: those of a file that is stored already change nothing, those of a changed file are added."""
    table = Table(new.sparkSession, path)
    old = table.read()
    return table.write(new.dropDuplicates(KEY) if old is None else insert_new(old, new, KEY))
