"""Token counts per document of flat token files without an index, by a separator scan.

A flat file is nothing but ids of fixed width, each document followed by the end-of-document id.  Files are cut into
blocks at any place; every block is searched by one vectorised comparison, and yields its separators and the open
runs at its two ends.  A prefix scan over the (small) block summaries numbers the documents and joins the runs that
a block boundary cut.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK_BYTES = 8 << 20


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def write_flat(docs: DataFrame, folder: str, vocabulary: str = tokens.VOCABULARY) -> None:
    """Tokenise ``text`` into flat files of ``folder``, one a task; null and empty text is a document of 0 tokens.

    Texts are written whole; repeated rows are written each; an empty table leaves files without ids; further columns
    are ignored.

    A task writes under a name of its own attempt and renames at its end, so a repeated task leaves one file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder, (disk, root) = tokens.Encoder(vocabulary), _open(folder)
        disk.create_dir(root, recursive=True)
        part = TaskContext.get().partitionId()
        draft, n = f"{root}/_{part}-{uuid.uuid4().hex}", 0
        with disk.open_output_stream(draft) as out:
            for batch in common.slices(batches, "text"):
                ids, off = encoder.encode(batch.column(0))
                n += batch.num_rows
                out.write(np.insert(ids, off[1:], tokens.END_OF_DOCUMENT).tobytes())
        disk.move(draft, f"{root}/part-{part:06d}.bin")
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    docs.select("text").mapInArrow(write, "n long").agg(F.sum("n")).collect()


def scan(spark: SparkSession, folder: str, width: int = 2, separator: int = tokens.END_OF_DOCUMENT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(file, doc_no, start, n_tokens) for every document in the flat files of ``folder``.

    ``start`` is the place of the document's first token in its file and ``n_tokens`` excludes the separator.
    Separators next to each other bound documents of 0 tokens.  Tokens after the last separator of a file form a last
    document; a file that ends with its separator has none.  Empty files and folders give no rows.  A size that is
    no multiple of ``width`` is an error.
    """
    disk, root = _open(folder)
    files = [f for f in disk.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.is_file and not os.path.basename(f.path).startswith(("_", "."))]
    for f in files:
        if f.size % width:
            raise ValueError(f"{f.path}: {f.size} bytes are no whole number of ids")
    names = spark.createDataFrame([(os.path.basename(f.path), f.size) for f in files], "file string, size long")
    step = block_bytes // width * width
    blocks = names.where("size > 0").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(step).cast("long"))))
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.uint64}[width]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        disk, root = _open(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with disk.open_input_file(f"{root}/{row['file']}") as source:
                    ids = np.frombuffer(source.read_at(min(step, row["size"] - row["at"]), row["at"]), kind)
                ends = np.flatnonzero(ids == separator) + row["at"] // width
                yield pa.RecordBatch.from_pylist([{"file": row["file"], "at": row["at"], "n": len(ends), "last": int(ends[-1]) if len(ends) else None, "ends": ends, "total": row["size"] // width}], pa.schema([("file", pa.string()), ("at", pa.int64()), ("n", pa.int64()), ("last", pa.int64()), ("ends", pa.list_(pa.int64())), ("total", pa.int64())]))

    # Every file is read once: the blocks' separators are written, and only their counts and last places are scanned.
    found = common.table(blocks.repartition(max(1, common.partitions(spark)), "file", "at").mapInArrow(search, "file string, at long, n long, last long, ends array<long>, total long"), "separator-blocks")
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    heads = found.select("file", "at", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry"))
    stitched = found.select("file", "at", "ends").join(common.checked(common.table(heads, "separator-heads")), ["file", "at"])
    inner = stitched.select("file", "base", "carry", "ends", F.posexplode("ends").alias("k", "end"))
    previous = F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1))
    closed = inner.select("file", (F.col("base") + F.col("k")).alias("doc_no"), (previous + 1).alias("start"), (F.col("end") - previous - 1).alias("n_tokens"))
    tail = found.groupBy("file").agg(F.sum("n").alias("doc_no"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("total").alias("total"))
    return closed.unionByName(tail.where("start < total").select("file", "doc_no", "start", (F.col("total") - F.col("start")).alias("n_tokens")))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents as flat token files in the shared folder and counts every document of those files."""
    folder = f"{common.shared_dir(spark)}/flat-{uuid.uuid4().hex}"
    write_flat(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return scan(spark, folder)
