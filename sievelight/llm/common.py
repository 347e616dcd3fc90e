"""Shared pieces: reliable checkpoints, Arrow slicing, word hashing, packed exchanges."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import cut, shared_dir  # noqa: F401

U64 = np.uint64
SLICE_BYTES = 1 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 28, 29, 30, 31, 32]] = True
_BYTE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.int64).astype(U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_PINV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: list[np.ndarray] = []


def table(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back (schema known, no inference)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def parts_for(spark: SparkSession, size: float) -> int:
    """Targets of a packed exchange of about ``size`` bytes: no more than 16 MB each, whatever the setting."""
    return max(partitions(spark), int(size // PART_BYTES) + 1)


PART_BYTES = 16 << 20
#: A side is broadcast only if it has at most this many rows and its files this many bytes; beyond that the join shuffles.
BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 32 << 20


def checked(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table or a projection of one) with a broadcast hint if it is small, by Catalyst's own figure
    for the bytes of its files and by its row count; else as it is."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) > BROADCAST_BYTES:
        return df
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """P**i and P**-i modulo 2**64 for i <= n."""
    if not _powers or len(_powers[0]) <= n:
        size = max(n + 1, SLICE_BYTES + 1)
        _powers[:] = [np.cumprod(np.concatenate([[U64(1)], np.full(size - 1, p, U64)]), dtype=U64) for p in (_P, _PINV)]
    return _powers[0], _powers[1]


def range_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Position-independent polynomial hashes of values[start:end], all at once by one prefix sum."""
    p, inv = powers(len(values))
    total = np.empty(len(values) + 1, U64)
    total[0] = 0
    np.cumsum(values * p[: len(values)], dtype=U64, out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(U64))


#: A polynomial modulo 2**64 lets long words over two symbols collide (Thue-Morse); up to this length none can.
_POLYNOMIAL = 32


def span_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges raw[start:end]: short ones by one prefix sum, long ones by XXH3."""
    out = range_hash(_BYTE[raw], starts, ends)
    long = np.flatnonzero(ends - starts > _POLYNOMIAL)
    if len(long):
        whole, name = raw.tobytes(), xxhash.xxh3_64_intdigest
        out[long] = np.fromiter((name(whole[a:b]) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True)), U64, len(long))
    return out


def wide_hash(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit XXH3 of each byte range, as two columns."""
    whole, name = raw.tobytes(), xxhash.xxh3_128_digest
    both = np.frombuffer(b"".join([name(whole[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]), np.int64).reshape(-1, 2)
    return both[:, 0], both[:, 1]


def distinct(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of the pieces that part ``raw`` at ``starts``: (index of each into the distinct ones, those, where each is first)."""
    if not len(starts):
        return np.zeros(0, np.int64), [], np.zeros(0, np.int64)
    off = np.r_[starts, len(raw)].astype(np.int32)
    column = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(raw))])
    coded = pc.dictionary_encode(column)
    index, unique = np.asarray(coded.indices), coded.dictionary.to_pylist()
    first = np.empty(len(unique), np.int64)
    first[index[::-1]] = np.arange(len(index))[::-1]
    return index, unique, first


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) else "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of text and 60,000 rows, so that working memory is bounded."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = batch.schema.get_field_index(column)
        _, off = string_buffers(batch.column(at))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(off, off[start] + most, side="right")) - 1)
            end = min(end, start + 60_000)
            yield batch.slice(start, end - start)
            start = end


def word_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words (runs without ASCII white space) and each text's offset into them."""
    n = len(raw)
    space = _SPACE[raw]
    before = np.ones(n + 1, bool)
    before[1:] = np.concatenate([space, [True]])[:n]
    before[off] = True
    starts = np.flatnonzero(~space & before[:n])
    after = np.ones(n + 1, bool)
    after[:n] = space
    after[off] = True
    ends = np.flatnonzero(~space & after[1:]) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every word, and each text's offset into them."""
    raw, off = string_buffers(column)
    starts, ends, docs = word_spans(raw, off)
    return span_hash(raw, starts, ends), docs


#: glibc alone has it; elsewhere only Arrow's pool is emptied.
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)


def give_back() -> None:
    """Return freed memory to the system, which neither glibc nor Arrow's pool does by itself."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, giving memory back at its end: Spark keeps the worker, which would hold it beside later stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def owner(off: np.ndarray) -> np.ndarray:
    """For offsets of groups, the group of each element."""
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


#: A packed exchange: each map task sends one row of raw numpy bytes to each target instead of a row per item.
PACKED = "part int, blob binary"


def pack(part: np.ndarray, columns: list[np.ndarray]) -> Iterator[tuple[int, bytes]]:
    """Split aligned columns by target; a blob is the item count and then each column's bytes."""
    if not len(part):
        return
    order = np.argsort(part, kind="stable")
    part = part[order]
    columns = [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    for a, b in zip(cuts, np.r_[cuts[1:], len(part)], strict=True):
        yield int(part[a]), np.int64(b - a).tobytes() + b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)


def packed_batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["part", "blob"])


def unpack(blob: bytes, kinds: list) -> list[np.ndarray]:
    n, at, out = int(np.frombuffer(blob, np.int64, 1)[0]), 8, []
    for kind in kinds:
        out.append(np.frombuffer(blob, kind, n, at))
        at += n * np.dtype(kind).itemsize
    return out


def unpack_all(batches: Iterator[pa.RecordBatch], kinds: list) -> list[np.ndarray]:
    """Every item that reached this task, as aligned columns."""
    got = [unpack(b.as_py(), kinds) for batch in batches for b in batch.column(batch.schema.get_field_index("blob"))]
    return [np.concatenate([g[i] for g in got]) if got else np.zeros(0, kind) for i, kind in enumerate(kinds)]


def exchange(packed: DataFrame, parts: int) -> DataFrame:
    """All blobs of one target in one task."""
    return packed.repartition(parts, "part")


def to_batches(columns: dict[str, pa.Array], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays(list(columns.values()), list(columns))
    for at in range(0, whole.num_rows, most):
        yield whole.slice(at, most)
