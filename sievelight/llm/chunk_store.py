"""Content-addressed store of token ids.

A rolling hash over the id stream of a document cuts it into chunks; equal content gives equal cuts.  A chunk is
addressed by the SHA-256 of its bytes and stored once.  A document is a recipe, the list of its chunk addresses, with
the root of the Merkle tree over them; a manifest row holds the Merkle root over a bucket of documents, so that a
bucket is verified without reading the others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

WINDOW = 16
MASK_BITS = 7
LONGEST = 1024
#: A manifest row is for about so many documents.
BUCKET_DOCUMENTS = 4096
SCHEMA = "kind string, doc_id long, row_hash long, bucket int, digest binary, ids binary, recipe array<binary>, n_tokens long"


def merkle(digests: list[bytes]) -> bytes:
    """Root of the binary tree; an odd node moves up unchanged; no digests: the hash of nothing."""
    if not digests:
        return hashlib.sha256(b"").digest()
    while len(digests) > 1:
        up = [hashlib.sha256(b"\x01" + digests[i] + digests[i + 1]).digest() for i in range(0, len(digests) - 1, 2)]
        digests = up + digests[len(digests) & ~1 :]
    return digests[0]


def cuts(ids: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Ends of the chunks of all documents: where the hash of the last ``WINDOW`` ids has ``MASK_BITS`` zero bits,
    every ``LONGEST`` ids after the last such place, and at the documents' ends."""
    n = len(ids)
    hit = np.zeros(n + 1, bool)
    if n >= WINDOW:
        ends = np.arange(WINDOW, n + 1)
        rolled = common.range_hash(common.mix(ids.astype(np.uint64) + np.uint64(1)), ends - WINDOW, ends)
        hit[ends] = (rolled & np.uint64((1 << MASK_BITS) - 1)) == 0
        early = np.zeros(n + 1, bool)  # a window must not reach into the document before
        for k in range(1, WINDOW):
            at = off[:-1] + k
            early[at[at <= n]] = True
        hit &= ~early
    hit[off[1:]] = True
    hit[0] = False
    at = np.flatnonzero(hit)
    before = np.r_[0, at[:-1]]
    extra = np.maximum(at - before - 1, 0) // LONGEST
    if extra.any():
        more = np.repeat(before, extra) + LONGEST * (np.arange(extra.sum()) - np.repeat(np.cumsum(extra) - extra, extra) + 1)
        at = np.union1d(at, more)
    return at


def build(docs: DataFrame, vocabulary: str = tokens.VOCABULARY, bucket_documents: int = BUCKET_DOCUMENTS) -> DataFrame:
    """The store as one table: rows of kind ``chunk`` (digest, ids), ``document`` (recipe; digest = Merkle root) and
    ``manifest`` (bucket; digest = Merkle root over its documents in order of id and row hash).

    Null and empty texts are documents with an empty recipe.  A null doc_id is kept and sorts first.  Repeated rows
    give repeated document rows, and their chunks once; documents alike in id and text are ordered by nothing else.
    Long texts are cut like any.  Further columns of any name are ignored.  An empty table gives an empty store.
    There is a power of two of buckets, so many that one holds about ``bucket_documents`` documents.
    """
    buckets = 1 << max(0, docs.count() // bucket_documents).bit_length()

    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sent = tokens.Encoder(vocabulary), set()
        for batch in common.slices(batches, "text"):
            ids, off = encoder.encode(batch.column(1))
            ends = cuts(ids, off)
            raw, width = ids.astype(np.uint32 if ids.dtype == np.uint32 else np.uint16).tobytes(), ids.dtype.itemsize
            digest, data, keys = [], [], []
            for a, b in zip(np.r_[0, ends[:-1]].tolist(), ends.tolist(), strict=True):
                piece = raw[a * width : b * width]
                key = hashlib.sha256(piece).digest()
                keys.append(key)
                if key not in sent:
                    sent.add(key)
                    digest.append(key)
                    data.append(piece)
            if len(sent) > 400_000:
                sent = set()
            first = np.searchsorted(ends, off[:-1], side="right")
            last = np.searchsorted(ends, off[1:], side="right")
            recipes = [keys[i:j] if n else [] for i, j, n in zip(first.tolist(), last.tolist(), np.diff(off).tolist(), strict=True)]
            m, d = len(digest), batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(["chunk"] * m + ["document"] * d),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), batch.column(0)]),
                    pa.concat_arrays([pa.nulls(m, pa.int64()), batch.column(2)]),
                    pa.concat_arrays([pa.nulls(m, pa.int32()), batch.column(3)]),
                    pa.array(digest + [merkle(r) for r in recipes], pa.binary()),
                    pa.array(data + [None] * d, pa.binary()),
                    pa.array([None] * m + recipes, pa.list_(pa.binary())),
                    pa.array([None] * m + np.diff(off).tolist(), pa.int64()),
                ],
                ["kind", "doc_id", "row_hash", "bucket", "digest", "ids", "recipe", "n_tokens"],
            )

    row = F.xxhash64("doc_id", "text")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int")
    made = docs.select(F.col("doc_id").cast("long"), "text", row.alias("row_hash"), bucket.alias("bucket")).mapInArrow(chunk, SCHEMA)
    # One shuffle stores each chunk once and brings the documents of a bucket together; the manifest is made in it.
    target = F.when(F.col("kind") == "chunk", F.xxhash64("digest")).otherwise(F.xxhash64("bucket"))
    placed = made.repartition(common.partitions(docs.sparkSession), target).sortWithinPartitions("digest")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, roots, schema = np.zeros((1, 32), np.uint8), {}, None
        for batch in batches:
            schema = batch.schema
            chunk = np.asarray(pc.equal(batch.column(0), "chunk"))
            raw, _ = common.string_buffers(batch.column(4))
            digest = raw.reshape(-1, 32)
            keep = ~chunk
            own = np.r_[last, digest[chunk]]
            keep[chunk] = (own[1:] != own[:-1]).any(axis=1)
            last = own[-1:]
            at = np.flatnonzero(~chunk)
            docs_ = batch.take(pa.array(at)).select(["doc_id", "row_hash", "bucket"]).to_pylist() if len(at) else []
            for k, r in zip(at.tolist(), docs_, strict=True):
                roots.setdefault(r["bucket"], []).append((r["doc_id"] is not None, r["doc_id"] or 0, r["row_hash"], digest[k].tobytes()))
            yield batch.filter(pa.array(keep))
        for b, found in sorted(roots.items()):
            yield pa.RecordBatch.from_pylist([{"kind": "manifest", "bucket": b, "digest": merkle([x for *_, x in sorted(found)]), "n_tokens": None}], schema)

    return placed.mapInArrow(store, SCHEMA)


def reconstruct(store: DataFrame) -> DataFrame:
    """(doc_id, row_hash, ids, verified): each document's id bytes from its recipe, and whether everything holds: the
    hashes of its chunks, the Merkle root over them, and its bucket's manifest over all documents of the bucket.

    A chunk that is missing or damaged makes ``verified`` false for the documents that use it; a document row that is
    lost, added or exchanged, or a lost manifest, does so for its bucket.  Documents without tokens have empty ids.
    Null ids are kept, repeated documents are each given, an empty store gives an empty result, and further columns
    are ignored.
    """
    documents = store.where("kind = 'document'").select("doc_id", "row_hash", "bucket", F.col("digest").alias("root"), "recipe")
    recipes = documents.withColumn("n", F.monotonically_increasing_id())
    steps = recipes.select("n", F.posexplode("recipe").alias("k", "digest"))
    chunks = store.where("kind = 'chunk'").select("digest", "ids")
    joined = steps.join(chunks, "digest", "left").withColumn("good", F.coalesce(F.unhex(F.sha2("ids", 256)) == F.col("digest"), F.lit(False)))
    parts = joined.groupBy("n").agg(F.sort_array(F.collect_list(F.struct("k", "ids"))).alias("parts"), F.min("good").alias("good"))
    put = recipes.join(parts, "n", "left").select("doc_id", "row_hash", "bucket", "root", "recipe", F.coalesce("good", F.lit(True)).alias("good"), F.coalesce(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""), F.lit("")).alias("hex"))
    order = F.sort_array(F.collect_list(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("i"), "row_hash", "root")))
    held = documents.groupBy("bucket").agg(F.transform(order, lambda x: x["root"]).alias("recipe"))
    manifests = held.join(store.where("kind = 'manifest'").select("bucket", F.col("digest").alias("root")), "bucket", "left")

    def roots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [merkle(r) == x for r, x in zip(batch.column("recipe").to_pylist(), batch.column("root").to_pylist(), strict=True)]
            own = [c for c in batch.schema.names if c not in ("recipe", "root")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(good, pa.bool_())], [*own, "holds"])

    whole = manifests.mapInArrow(roots, "bucket int, holds boolean").withColumnRenamed("holds", "bucket_holds")
    each = put.mapInArrow(roots, "doc_id long, row_hash long, bucket int, good boolean, hex string, holds boolean")
    verified = F.col("good") & F.col("holds") & F.coalesce("bucket_holds", F.lit(False))
    return each.join(whole, "bucket", "left").select("doc_id", "row_hash", F.unhex("hex").alias("ids"), verified.alias("verified"))


def op4_chunk_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return build(spark.read.parquet(f"{sf_dir}/documents.parquet"))
