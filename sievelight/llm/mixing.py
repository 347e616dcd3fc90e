"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

1. Each source is put into a random order (a keyed hash of the document) and cut into blocks.
2. The target weights give every source an exact number of blocks; a source is never repeated.
3. A binary tree over the output shards splits the vector of block quotas: at each node the left half draws its
   blocks from the node's blocks without replacement, which is a multivariate hypergeometric draw.  The draw of a
   node is seeded by the node alone, so every leaf is reproducible.
4. The leaves name disjoint ranges of each source's permuted blocks.  Where those ranges end is known as a hash
   value of the source's order, so the documents themselves are moved once, straight to their shard, and shuffled
   there by a second hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BLOCK = 8
SHARD_BLOCKS = 1024
TEMPERATURE = 0.5
SEED = 20240607
#: Nodes of the tree over so many shards or less are split by the tasks.
SUBTREE = 256
#: Buckets of the hash order of one source; ranks are counted per bucket and joined by a prefix sum.
BUCKET_BITS = 12
#: As a total: what ``fair_total`` says.
FAIR = "fair"


def target_blocks(available: dict[str, int], weights: dict[str, float]) -> dict[str, int]:
    """Exact block quotas: the largest mix at these weights that no source is too small for, by largest remainder.

    ``available`` counts blocks.  Sources without a positive weight get none.
    """
    live = {s: w for s, w in weights.items() if w > 0 and available.get(s, 0) > 0}
    if not live:
        return {}
    whole = sum(live.values())
    total = math.floor(min(available[s] * whole / w for s, w in live.items()) + 1e-9)
    exact = {s: total * w / whole for s, w in live.items()}
    quota = {s: min(available[s], math.floor(x + 1e-9)) for s, x in exact.items()}
    for s in sorted(live, key=lambda s: (quota[s] - exact[s], s)):
        if sum(quota.values()) < total and quota[s] < available[s]:
            quota[s] += 1
    return quota


def fair_total(available: dict[str, int], weights: dict[str, float]) -> int:
    """The target total of the registered mix, in documents: sources that hold half of all the weight get no less than
    their weight asks for, each with as many documents a unit of weight as the weighted median source has; no source
    is asked for more than it has.
    """
    live = sorted((available[s] / w, w, s) for s, w in weights.items() if w > 0 and available.get(s, 0) > 0)
    half, level = sum(w for _, w, _ in live) / 2, 0.0
    for level, w, _ in live:
        half -= w
        if half <= 0:
            break
    return sum(min(available[s], math.floor(level * w + 1e-9)) for _, w, s in live)


def water_fill(available: dict[str, int], weights: dict[str, float], total: int) -> dict[str, int]:
    """Quotas in documents that sum to ``total``, or to all there is: a source that has less than its share gives all
    it has, and the rest is shared by weight among the others, by largest remainder.
    """
    live = {s: w for s, w in weights.items() if w > 0 and available.get(s, 0) > 0}
    left, quota = min(total, sum(available[s] for s in live)), {}
    for s in sorted(live, key=lambda s: (available[s] / live[s], s)):
        rest = sum(w for x, w in live.items() if x not in quota)
        if available[s] > left * live[s] / rest + 1e-9:
            break
        quota[s] = available[s]
        left -= available[s]
    open_ = {s: w for s, w in live.items() if s not in quota}
    exact = {s: left * w / sum(open_.values()) for s, w in open_.items()}
    quota |= {s: math.floor(x + 1e-9) for s, x in exact.items()}
    left -= sum(quota[s] for s in open_)
    for s in sorted(open_, key=lambda s: (quota[s] - exact[s], s))[:left]:
        quota[s] += 1
    return quota


def split(low: int, high: int, left: np.ndarray, seed: int) -> tuple[int, np.ndarray]:
    """The middle of a node over the shards [low, high) and the blocks of each source that its left half draws."""
    mid, total = (low + high) // 2, int(left.sum())
    first, rest = divmod(total, high - low)
    take = first * (mid - low) + min(rest, mid - low)
    rng = np.random.default_rng([seed, low, high])
    return mid, rng.multivariate_hypergeometric(left, take, method="marginals") if total else left


def leaves(low: int, high: int, left: np.ndarray, seed: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, blocks of each source) of every leaf below a node, in order."""
    stack = [(low, high, np.asarray(left, np.int64))]
    while stack:
        low, high, left = stack.pop()
        if high - low == 1:
            yield low, left
        elif high > low:
            mid, drawn = split(low, high, left, seed)
            stack += [(mid, high, left - drawn), (low, mid, drawn)]


def splitting_tree(quota: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """shards x sources: how many blocks of each source each shard holds.

    Shard sizes differ by at most one block; column sums are ``quota`` exactly.
    """
    return np.array([blocks for _, blocks in leaves(0, shards, quota, seed)], np.int64).reshape(shards, len(quota))


def _tree(spark: SparkSession, quota: np.ndarray, shards: int, seed: int) -> DataFrame:
    """(shard, source, blocks) of the tree, sources by number: the top is split here, the nodes of ``SUBTREE`` shards
    or less by the tasks.  A node is seeded by itself, so it doesn't matter where it is split."""
    nodes, small = [(0, shards, np.asarray(quota, np.int64))] if shards else [], []
    while nodes:
        low, high, left = nodes.pop()
        if high - low <= SUBTREE:
            small.append((low, high, left.tolist()))
        else:
            mid, drawn = split(low, high, left, seed)
            nodes += [(low, mid, drawn), (mid, high, left - drawn)]

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                found = list(leaves(r["low"], r["high"], np.array(r["left"], np.int64), seed))
                shard, blocks = np.array([x for x, _ in found]), np.array([x for _, x in found])
                at, source = np.nonzero(blocks)
                yield pa.RecordBatch.from_arrays([pa.array(shard[at].astype(np.int32)), pa.array(source.astype(np.int32)), pa.array(blocks[at, source])], ["shard", "source", "blocks"])

    top = spark.createDataFrame(small, "low long, high long, left array<long>")
    return top.repartition(max(1, min(len(small), common.partitions(spark)))).mapInArrow(common.lean(grow), "shard int, source int, blocks long")


def _order(seed: int) -> Column:
    """Random order of a source's documents: unsigned 63-bit hash of id and text."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text")), 1)


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit("<null>"))


def plan(docs: DataFrame, weights: dict[str, float] | None, block: int, shard_blocks: int, temperature: float, seed: int, total: int | str | None = None) -> tuple[DataFrame, int]:
    """The table (source, bucket, low, high, shard) of hash ranges, and how many shards there are.

    Only counts by source and bucket and the top of the tree pass through the driver.
    """
    spark = docs.sparkSession
    narrow = docs.select(_source().alias("s"), _order(seed).alias("o"))
    ordered = common.table(narrow.withColumn("b", F.shiftright("o", 63 - BUCKET_BITS).cast("int")), "mix-order")
    # At most 2**BUCKET_BITS rows a source, whatever the number of documents.
    sizes = ordered.groupBy("s", "b").count().orderBy("s", "b").collect()
    names = sorted({r["s"] for r in sizes})
    by_bucket = {s: np.zeros(1 << BUCKET_BITS, np.int64) for s in names}
    for r in sizes:
        by_bucket[r["s"]][r["b"]] = r["count"]
    upto = {s: np.cumsum(n) for s, n in by_bucket.items()}
    counts = {s: int(n[-1]) for s, n in upto.items()}
    if weights is None:
        weights = {s: float(n) ** temperature for s, n in counts.items()}
    if total is None:
        quota, most = target_blocks({s: n // block or 1 for s, n in counts.items()}, weights), counts
    else:
        most = water_fill(counts, weights, fair_total(counts, weights) if total == FAIR else total)
        quota = {s: -(-n // block) for s, n in most.items()}  # the last block of a source may be a partial one
    vector = np.array([quota.get(s, 0) for s in names], np.int64)
    shards = math.ceil(int(vector.sum()) / shard_blocks)
    order = Window.partitionBy("source").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    ends = _tree(spark, vector, shards, seed).select("shard", "source", (F.sum("blocks").over(order) * block).alias("end"))
    sent = spark.sparkContext.broadcast((names, [most.get(s, 0) for s in names], upto, by_bucket))

    def locate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, most, upto, by_bucket = sent.value
        for batch in batches:
            shard, source, end = (batch.column(k).to_numpy() for k in range(3))
            bucket, within = np.zeros(len(end), np.int64), np.zeros(len(end), np.int64)
            for j in np.unique(source).tolist():
                own = np.flatnonzero(source == j)
                stop = np.minimum(end[own], most[j])
                bucket[own] = at = np.searchsorted(upto[names[j]], stop)
                within[own] = stop - (upto[names[j]] - by_bucket[names[j]])[at]
            yield pa.RecordBatch.from_arrays([pa.array([names[j] for j in source.tolist()], pa.string()), pa.array(bucket.astype(np.int32)), pa.array(within), pa.array(shard)], ["s", "b", "r", "shard"])

    cuts = common.table(ends.mapInArrow(common.lean(locate), "s string, b int, r long, shard int"), "mix-cuts")
    # A range ends with the document of rank r in bucket b.
    rank = Window.partitionBy("s", "b").orderBy("o")
    cut_buckets = common.table(cuts.select("s", "b").distinct(), "mix-buckets")
    ranked = ordered.join(common.checked(cut_buckets), ["s", "b"], "left_semi").withColumn("r", F.row_number().over(rank))
    short = cuts.join(ranked, ["s", "b", "r"]).select("s", "shard", F.col("o").alias("high"))
    low = F.coalesce(F.lag("high").over(Window.partitionBy("s").orderBy("shard")), F.lit(-1))
    span = F.sequence(F.shiftright(F.col("low") + 1, 63 - BUCKET_BITS), F.shiftright("high", 63 - BUCKET_BITS))
    return common.table(short.withColumn("low", low).withColumn("b", F.explode(span.cast("array<int>"))), "mix-plan"), shards


def mix(docs: DataFrame, weights: dict[str, float] | None = None, block: int = BLOCK, shard_blocks: int = SHARD_BLOCKS, temperature: float = TEMPERATURE, seed: int = SEED, total: int | str | None = None) -> DataFrame:
    """``docs`` at the target weights, with ``mix_shard`` and ``mix_position`` (0.. within each shard).

    ``weights`` maps source to weight; None means count ** ``temperature``.  Weights of absent sources are ignored and
    sources without a weight are left out.  ``total`` is the number of documents aimed at, or FAIR (``fair_total``):
    a source too small for its share gives all it has, the others share the rest by weight, and the last block of a
    source may be a partial one.  With None the weights are kept exactly, so the smallest source bounds the mix:
    quotas are whole blocks of ``block`` documents, a source with fewer counts as one block and gives all.  Null sources form one source of their own,
    named ``<null>`` in ``weights``; null ids and texts are ordinary values.  Ties: rows alike in id and text have the
    same place in the order and stay together, so a quota can be off by their number.  Further columns are kept,
    except that columns of the two names above are replaced.  An empty table gives an empty result.
    """
    own = [c for c in docs.columns if c not in ("mix_shard", "mix_position")]
    ranges, shards = plan(docs, weights, block, shard_blocks, temperature, seed, total)
    row = docs.select(F.struct(*[F.col(c) for c in own]).alias("row"), _source().alias("s"), _order(seed).alias("o"))
    # About sources x (shards + buckets) rows: broadcast while that is small, a sort-merge join beyond it.
    row = row.withColumn("b", F.shiftright("o", 63 - BUCKET_BITS).cast("int"))
    placed = row.join(common.checked(ranges), ["s", "b"]).where((F.col("o") > F.col("low")) & (F.col("o") <= F.col("high")))
    local = Window.partitionBy("shard").orderBy("k", "o", F.xxhash64("row"))
    spread = placed.select("row", "shard", "o", F.xxhash64(F.lit(seed + 1), "o").alias("k")).repartition(max(1, min(shards, common.partitions(docs.sparkSession))), "shard")
    return spread.withColumn("pos", F.row_number().over(local) - 1).select("row.*", F.col("shard").alias("mix_shard"), F.col("pos").alias("mix_position"))


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"), total=FAIR)
