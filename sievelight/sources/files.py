"""Directory trees as tables."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.planning import SIZE_SKIPPED, SKIPPED


def open_root(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), root.removeprefix("file:").rstrip("/"))


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(path, parts, length) of all files below ``root``, hidden ones too; contents are not read.

    The driver lists one level; the folders of that level are listed by the tasks.  A missing root has no rows, and a
    root that is a file is one row.
    """
    disk, base = open_root(root)
    info = disk.get_file_info(base)
    if info.type == fs.FileType.File:
        rows = [(info.base_name, info.size, False)]
    elif info.type == fs.FileType.Directory:
        rows = [(f.base_name, f.size, f.type == fs.FileType.Directory) for f in disk.get_file_info(fs.FileSelector(base))]
    else:
        rows = []
    top = spark.createDataFrame(rows, "path string, length long, folder boolean")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, base = open_root(root)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                found = [f for f in disk.get_file_info(fs.FileSelector(f"{base}/{name}", recursive=True)) if f.is_file]
                yield pa.RecordBatch.from_arrays([pa.array([f.path[len(base) + 1 :] for f in found], pa.string()), pa.array([f.size for f in found], pa.int64())], ["path", "length"])

    folders = top.where("folder").select("path")
    spread = folders.repartition(max(1, min(len(rows), int(spark.conf.get("spark.sql.shuffle.partitions")))))
    files = top.where("NOT folder").select("path", "length").unionByName(spread.mapInArrow(below, "path string, length long"))
    return files.withColumn("parts", F.split("path", "/"))


def scan_dir(spark: SparkSession, root: str, max_depth: int = 5) -> DataFrame:
    """(path, length) of files at most ``max_depth`` below root; hidden names and build folders are skipped."""
    skip = F.exists("parts", lambda p: p.startswith(".") | p.isin(*SKIPPED))
    return walk(spark, root).where((F.size("parts") <= max_depth) & ~skip).select("path", "length")


def scan_size(spark: SparkSession, root: str) -> DataFrame:
    """One row: all bytes below root outside of the ignored folders; null if there is no such root."""
    skip = F.exists("parts", lambda p: p.isin(*SIZE_SKIPPED))
    disk, base = open_root(root)
    missing = disk.get_file_info(base).type == fs.FileType.NotFound
    return walk(spark, root).where(~skip).agg(F.when(F.lit(not missing), F.coalesce(F.sum("length"), F.lit(0))).alias("bytes"))
