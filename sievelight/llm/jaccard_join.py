"""Exact n-gram Jaccard join as a metric-space join.

Texts are sets of word n-grams; Jaccard distance is a metric, and texts within r = 1 - threshold are joined.

Far-apart sets all have distance 1 to every pivot, so pivots alone can't part a corpus.  Regions are therefore found in
two exact steps, each of which only rules pairs out:

1. Prefix principle: under any global order of the n-grams, two sets that match share at least l of their first
   |x| - ceil(t|x|) + l n-grams.  Rare n-grams come first.  Sets that meet often enough are candidates of each other;
   the sets of a large neighbourhood are all candidates of each other.
2. Bitmaps of 2 to 4 bits an n-gram travel to the region of a candidate's pivot.  An n-gram whose bit the other set
   doesn't have isn't shared, which bounds the overlap from above; pairs below the bound go.

The pairs that stay are nearly those that match; only the members that have one stay in a region.  Whole sets travel
only here, as texts.  Inside a region pivots create Voronoi cells; a set is replicated into another one if the triangle
inequality leaves a match there possible; cells join recursively, and by exact overlaps once they are small or pivots
rule too little out.  A pair is given by the region of the smallest pivot that both of its sets belong to, so no pair is
given twice.  Regions of more n-grams than a task should hold are cut into a grid of blocks.

A family of m near copies has m (m - 1) / 2 pairs.  They are all compared, but only ``join`` and ``join_all`` make rows of
them; ``classes`` adds them up in the tasks to a count of links and a spanning forest.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

N = 3
THRESHOLD = 0.5
#: n-grams are ordered by classes: those of at most this many sets, of at most twice as many, and so on.  Any choice
#: gives the same result.
FREQUENT = 8
#: The classes of so many n-grams are sent to all tasks at most: the bound above doubles until they are no more.
FREQUENT_TOTAL = 2_000_000
#: A neighbourhood of more nodes than this is joined as a region instead of by pairs.  Any choice gives the same result.
PAIRWISE = 48
#: A region of more n-grams than this is cut into blocks that meet in pairs.  Any choice gives the same result.
REGION_BITS = 64_000_000
REGION_SETS = 4_000_000
_WINDOW = 1 << 22
_PAIRS = 1 << 21
#: Overlaps are matrix products if at most so many times as many n-grams are shared as a set has; else by look-up.
_DENSE = 64
_CELLS = 1 << 18


def gram_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct n-gram hashes of all texts, offsets).  A text of 1..n-1 words is one n-gram; none: no n-gram."""
    words, off = common.word_hashes(column)
    count = np.diff(off)
    size = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    doc = np.repeat(np.arange(len(count)), size)
    first = np.repeat(off[:-1], size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    last = np.minimum(first + n, off[1:][doc])
    grams = common.range_hash(words, first, last) if len(first) else np.zeros(0, np.uint64)
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(count) + 1))


def node_ids(grams: np.ndarray, off: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of each set."""
    total = np.r_[np.uint64(0), np.cumsum(common.mix(grams), dtype=np.uint64)]
    return common.mix((total[off[1:]] - total[off[:-1]]) + np.diff(off).astype(np.uint64))


def least_common(size: np.ndarray, t: float) -> np.ndarray:
    """l(x): a share of the ceil(t|x|) n-grams that any match of x has in common with it.  A larger one makes prefixes
    longer and candidates fewer; any choice gives the same result."""
    return np.maximum(1, np.ceil(size * t - 1e-9).astype(np.int64) // 16)


def bitmaps(grams: np.ndarray, off: np.ndarray) -> list[bytes]:
    """A bitmap of each set: a power of two of at least 2 bits an n-gram and 64 bits; an n-gram's bit is its hash modulo that."""
    size = np.diff(off)
    bits = 1 << np.maximum(6, np.ceil(np.log2(np.maximum(2 * size, 1)))).astype(np.int64)
    begin = np.cumsum(bits) - bits
    at = (common.mix(grams) & np.repeat(bits - 1, size).astype(np.uint64)).astype(np.int64) + np.repeat(begin, size)
    flat = np.zeros(int(bits.sum()), np.uint8)
    flat[at] = 1
    raw = np.packbits(flat, bitorder="little").tobytes()
    return [raw[a // 8 : (a + n) // 8] for a, n in zip(begin.tolist(), bits.tolist(), strict=True)]


def _most(x: np.ndarray, size_x: np.ndarray, y: np.ndarray, size_y: np.ndarray) -> np.ndarray:
    """(len(x), len(y)): the most n-grams that sets with these bitmaps can share."""
    while x.shape[1] > y.shape[1]:
        x = x[:, : x.shape[1] // 2] | x[:, x.shape[1] // 2 :]
    while y.shape[1] > x.shape[1]:
        y = y[:, : y.shape[1] // 2] | y[:, y.shape[1] // 2 :]
    both = np.bitwise_count(x[:, None, :] & y[None, :, :]).sum(axis=2, dtype=np.int64)
    spare_x = size_x - np.bitwise_count(x).sum(axis=1, dtype=np.int64)  # n-grams that share their bit with another
    spare_y = size_y - np.bitwise_count(y).sum(axis=1, dtype=np.int64)
    return both + np.minimum(spare_x[:, None], spare_y[None, :])


def possible(size: np.ndarray, maps: list[bytes], t: float, group: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks (i, j), i before j by size, of the pairs that sizes and bitmaps don't rule out; of different groups, if given."""
    order = np.argsort(size, kind="stable")
    width = np.array([len(maps[k]) for k in order.tolist()], np.int64)
    cuts = np.flatnonzero(np.r_[True, width[1:] != width[:-1]][: len(width)])
    classes = [(order[a:b], np.frombuffer(b"".join([maps[k] for k in order[a:b].tolist()]), np.uint64).reshape(b - a, -1)) for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(width)].tolist(), strict=True)]
    for c, (own, x) in enumerate(classes):
        for d in range(c, len(classes)):
            other, y = classes[d]
            if t * size[other[0]] > size[own[-1]] + 1e-9:
                break
            step = max(1, (1 << 20) // max(1, len(other) * min(x.shape[1], y.shape[1])))
            for at in range(0, len(own), step):
                some = own[at : at + step]
                whole = size[some][:, None] + size[other][None, :]
                good = (_most(x[at : at + step], size[some], y, size[other]) * (1 + t) >= t * whole - 1e-6) & (size[some][:, None] >= t * size[other][None, :] - 1e-9)
                if c == d:
                    good &= np.arange(at, at + len(some))[:, None] < np.arange(len(other))[None, :]
                if group is not None:
                    good &= group[some][:, None] != group[other][None, :]
                i, j = np.nonzero(good)
                if len(i):
                    yield some[i], other[j]


def region_join(sets: list[np.ndarray], t: float, leaf: int = 24, cells: int = 12) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of all pairs with Jaccard >= t, i < j, by recursive pivots; exact."""
    return [x for i, j, o in region_blocks(sets, t, leaf, cells) for x in zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), o.tolist(), strict=True)]


def region_blocks(sets: list[np.ndarray], t: float, leaf: int = 24, cells: int = 12) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of ``region_join``, each pair once, in any order of its two sets."""
    if not sets:
        return
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    size = np.array([len(s) for s in sets], np.int64)
    off = np.r_[0, np.cumsum(size)]
    flag = np.zeros(codes.max(initial=0) + 1, bool)
    Found = Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def flat(ids: np.ndarray) -> np.ndarray:
        each = size[ids]
        return codes[np.repeat(off[ids] - (np.cumsum(each) - each), each) + np.arange(each.sum())]

    def overlaps(p: int, ids: np.ndarray) -> np.ndarray:
        mine = codes[off[p] : off[p + 1]]
        flag[mine] = True
        got = np.r_[0, np.cumsum(flag[flat(ids)])]
        flag[mine] = False
        ends = np.cumsum(size[ids])
        return got[ends] - got[ends - size[ids]]

    def matches(both: np.ndarray, p: np.ndarray | int, ids: np.ndarray) -> np.ndarray:
        return both >= t * (size[p] + size[ids] - both) - 1e-9

    def every(own: np.ndarray, guests: np.ndarray) -> Found:
        """Without pivots: all sets of ``own`` against those after them and the guests."""
        both = np.r_[own, guests]
        column, row = flat(both), np.repeat(np.arange(len(both)), size[both])
        _, column, times = np.unique(column, return_inverse=True, return_counts=True)
        shared = times > 1
        row, column = row[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
        width = int(shared.sum())
        if not width:
            return
        if width * len(both) > _DENSE * size[both].sum():
            for k, p in enumerate(own.tolist()):
                ids = np.r_[own[k + 1 :], guests]
                ids = ids[(size[ids] >= t * size[p] - 1e-9) & (size[p] >= t * size[ids] - 1e-9)]
                if len(ids):
                    o = overlaps(p, ids)
                    good = matches(o, p, ids)
                    yield np.full(int(good.sum()), p), ids[good], o[good]
            return
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        wide = max(1, 8 * _CELLS // len(both))
        cuts = [(c, *np.searchsorted(column, [c, c + wide]).tolist()) for c in range(0, width, wide)]

        def matrix(c: int, a: int, b: int) -> np.ndarray:
            got = np.zeros((len(both), min(wide, width - c)), np.float32)
            got[row[a:b], column[a:b] - c] = 1
            return got

        whole = matrix(*cuts[0]) if len(cuts) == 1 else None
        step = max(1, _CELLS // len(both))
        for at in range(0, len(own), step):
            end = min(at + step, len(own))
            o = np.zeros((end - at, len(both) - at), np.float32)
            for cut in cuts:
                part = matrix(*cut) if whole is None else whole
                o += part[at:end] @ part[at:].T
            i, j = np.nonzero(matches(o, own[at:end][:, None], both[None, at:]) & (np.arange(len(both) - at)[None, :] > np.arange(end - at)[:, None]))
            yield own[at + i], both[at + j], o[i, j].astype(np.int64)

    def join(own: np.ndarray, guests: np.ndarray) -> Found:
        """All pairs inside ``own`` and between ``own`` and ``guests``."""
        if not len(own):
            return
        both = np.r_[own, guests]
        if len(own) <= leaf or len(both) <= 2 * leaf:
            yield from every(own, guests)
            return
        pivots = own[np.linspace(0, len(own) - 1, min(cells, len(own) // 2)).astype(np.int64)]
        distance = np.empty((len(both), len(pivots)))
        for c, p in enumerate(pivots.tolist()):
            o = overlaps(p, both)
            distance[:, c] = 1 - o / np.maximum(1, size[both] + size[p] - o)
        nearest = distance.argmin(axis=1)
        r = 1 - t
        found, work = [], 0.0
        for c in range(len(pivots)):
            mine = nearest[: len(own)] == c
            if not mine.any():
                continue
            radius = distance[: len(own)][mine, c].max()
            # Triangle inequality: a match of a member of this cell is within radius + r of its pivot.  Each pair of
            # two cells is joined in the later one; guests visit every cell that they can match in.
            window = (distance[:, c] <= radius + r + 1e-9) & (distance[:, c] <= distance[np.arange(len(both)), nearest] + 2 * r + 1e-9)
            visits = np.r_[window[: len(own)] & (nearest[: len(own)] < c), distance[len(own) :, c] <= radius + r + 1e-9]
            found.append((both[: len(own)][mine], both[visits]))
            work += mine.sum() * (mine.sum() / 2 + visits.sum())
        if work > 0.5 * len(own) * (len(own) / 2 + len(guests)):  # the pivots rule too little out
            yield from every(own, guests)
            return
        for cell, visitors in found:
            yield from join(cell, visitors)

    yield from join(np.argsort(size, kind="stable"), np.zeros(0, np.int64))


def _several(blocks: Iterator[tuple[np.ndarray, ...]], least: int = 1 << 18) -> Iterator[tuple[np.ndarray, ...]]:
    """The same rows in blocks of ``least`` rows or more."""
    held, n = [], 0
    for block in blocks:
        held.append(block)
        n += len(block[0])
        if n >= least:
            yield tuple(np.concatenate(c) for c in zip(*held, strict=True))
            held, n = [], 0
    if n:
        yield tuple(np.concatenate(c) for c in zip(*held, strict=True))


def unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the trees of i[k] and j[k] in place; ``root`` has for every item the smallest item of its tree."""
    while True:
        a, b = root[i], root[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root[:] = root[root]


def _covered(lower: pa.ChunkedArray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """Whether two members share one of the pivots in their lists ``lower``, for arrays of members."""
    lists = lower.combine_chunks() if isinstance(lower, pa.ChunkedArray) else lower
    pivot = lists.flatten().to_numpy(zero_copy_only=False)
    who = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    _, code, times = np.unique(pivot, return_inverse=True, return_counts=True)
    shared = times[code] > 1
    if not shared.any():
        return lambda i, j: np.zeros(len(i), bool)
    who, (_, code) = who[shared], np.unique(code[shared], return_inverse=True)
    bits = np.zeros((len(lists), code.max() // 64 + 1), np.uint64)
    np.bitwise_or.at(bits, (who, code >> 6), np.uint64(1) << (code & 63).astype(np.uint64))
    step = max(1, _CELLS // bits.shape[1])
    return lambda i, j: np.concatenate([np.zeros(0, bool), *((bits[i[a : a + step]] & bits[j[a : a + step]]).any(axis=1) for a in range(0, len(i), step))])


def nodes(docs: DataFrame, n: int) -> tuple[DataFrame, tuple[np.ndarray, np.ndarray], int]:
    """((doc_id, rid, node, size, bits) of every document, sorted hashes of frequent n-grams with their classes, how many
    n-grams there are).

    A node is a set; of the rows of one node in a batch, the first has its bitmap.  An n-gram is counted in a task if
    several sets of a window of n-grams have it; the counts are then added up.
    """
    schema = "part int, blob binary, doc_id long, rid long, node long, size int, bits binary"
    names = [x.split()[0] for x in schema.split(", ")]
    parts = common.partitions(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n_held = [], 0

        def flush() -> list[tuple[int, bytes]]:
            grams, times = np.unique(np.concatenate(held), return_counts=True)
            grams, times = grams[times > 1], times[times > 1].astype(np.uint32)
            return list(common.pack((grams % np.uint64(parts)).astype(np.int64), [grams, times]))

        for batch in common.slices(batches, "text"):
            grams, off = gram_sets(batch.column(2), n)
            node, size = node_ids(grams, off), np.diff(off)
            _, once = np.unique(node, return_index=True)
            pick = np.zeros(len(node), bool)
            pick[once] = True
            maps = bitmaps(grams, off)
            d = len(node)
            yield pa.RecordBatch.from_arrays([pa.nulls(d, pa.int32()), pa.nulls(d, pa.binary()), batch.column(0), batch.column(1), pa.array(node.view(np.int64)), pa.array(size.astype(np.int32)), pa.array([m if p else None for m, p in zip(maps, pick.tolist(), strict=True)], pa.binary())], names)
            held.append(grams[np.repeat(pick, size)])
            n_held += len(held[-1])
            if n_held > _WINDOW:
                yield _only_packed(flush(), names)
                held, n_held = [], 0
        if n_held:
            yield _only_packed(flush(), names)

    made = common.table(_source(docs).mapInArrow(common.lean(count), schema), "jaccard-nodes")
    total = made.agg(F.sum("size")).first()[0] or 0

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, times = common.unpack_all(batches, [np.uint64, np.uint32])
        unique, index = np.unique(grams, return_inverse=True)
        times = np.bincount(index, times, len(unique))
        keep = times > FREQUENT
        yield pa.RecordBatch.from_arrays([pa.array(unique[keep].view(np.int64)), pa.array(np.ceil(np.log2(times[keep] / FREQUENT)).astype(np.int8))], ["gram", "class"])

    often = common.table(common.exchange(made.where("part IS NOT NULL").select("part", "blob"), parts).mapInArrow(common.lean(add), "gram long, class byte"), "jaccard-often")
    left, least = 0, 1
    for row in often.groupBy("class").count().orderBy(F.desc("class")).collect():
        left += row["count"]
        if left > FREQUENT_TOTAL:
            least = row["class"] + 1
            break
    top = often.where(F.col("class") >= least).orderBy("gram").toArrow()
    grams, classes = top["gram"].to_numpy().view(np.uint64), top["class"].to_numpy()
    order = np.argsort(grams)
    return made.where("node IS NOT NULL").drop("part", "blob"), (grams[order], classes[order]), total


def _only_packed(rows: list[tuple[int, bytes]], names: list[str]) -> pa.RecordBatch:
    packed, m = common.packed_batch(rows), len(rows)
    return pa.RecordBatch.from_arrays([packed.column(0), packed.column(1), *(pa.nulls(m, pa.int64()) for _ in range(3)), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary())], names)


def _source(docs: DataFrame) -> DataFrame:
    """(doc_id, rid, text): the text in lower case; rid tells texts of one id apart."""
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.coalesce("text", F.lit(""))).alias("text"))
    return named.select("doc_id", F.xxhash64("text").alias("rid"), "text")


def _blocks(regions: DataFrame, most: int) -> DataFrame:
    """``regions`` (pivot, member, size, ...) with ``low``, ``high`` and ``block``: a region of more than ``most``
    n-grams is cut into g blocks by member, and a member goes to the g pairs of blocks that hold its own."""
    large = common.table(regions.groupBy("pivot").agg(F.ceil(F.sum("size") / most).alias("g")).where("g > 1"), "jaccard-large")
    placed = regions.join(common.checked(large), "pivot", "left").withColumn("g", F.coalesce("g", F.lit(1)))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("member"), F.col("g"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("g") - 1)))
    return placed.withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")}).drop("g", "other")


_KEY = ("pivot", "low", "high")


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each (pivot, low, high), which come sorted, as one table, each member once."""
    held: list[pa.RecordBatch] = []
    last = None

    def whole() -> pa.Table:
        found = pa.Table.from_batches(held)
        member = found["member"].to_numpy()
        once = np.sort(np.unique(member, return_index=True)[1])
        return found.take(pa.array(once)) if len(once) < len(member) else found

    for batch in batches:
        if not batch.num_rows:
            continue
        keys = np.stack([batch.column(batch.schema.get_field_index(k)).to_numpy() for k in _KEY])
        cuts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
        for a, b in zip(cuts.tolist(), np.r_[cuts[1:], batch.num_rows].tolist(), strict=True):
            now = tuple(keys[:, a].tolist())
            if held and now != last:
                yield whole()
                held = []
            held.append(batch.slice(a, b - a))
            last = now
    if held:
        yield whole()


def _candidates(docs: DataFrame, frequent: tuple[np.ndarray, np.ndarray], total: int, n: int, t: float) -> DataFrame:
    """(pivot, member) of the regions in which every pair with Jaccard >= t meets; a pivot is a member of its region."""
    spark = docs.sparkSession
    parts = common.parts_for(spark, 5 * total)
    often = spark.sparkContext.broadcast(frequent)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, classes = often.value
        for batch in common.slices(batches, "text"):
            grams, off = gram_sets(batch.column(2), n)
            node, size = node_ids(grams, off), np.diff(off)
            _, once = np.unique(node, return_index=True)
            pick = np.zeros(len(node), bool)
            pick[once] = size[once] > 0
            doc = common.owner(off)
            keep = pick[doc]
            grams, doc = grams[keep], doc[keep]
            if len(known):
                at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
                late = np.where(known[at] == grams, classes[at], 0)
                order = np.lexsort((late, doc))  # stable: by text, then class, then hash
                grams, doc = grams[order], doc[order]
            need = least_common(size, t)
            most = size - np.ceil(size * t - 1e-9).astype(np.int64) + need
            start = np.searchsorted(doc, np.arange(len(size)))
            keep = np.arange(len(doc)) - start[doc] < most[doc]
            grams, doc = grams[keep], doc[keep]
            if not len(grams):
                continue
            part = (grams % np.uint64(parts)).astype(np.int64)
            short = (grams >> np.uint64(32)).astype(np.uint32)
            # n-grams of a text that look alike by target and half a hash count once, so so many less may be met.
            order = np.lexsort((short, part, doc))
            alike = order[1:][(doc[order][1:] == doc[order][:-1]) & (part[order][1:] == part[order][:-1]) & (short[order][1:] == short[order][:-1])]
            need = np.maximum(1, need - np.bincount(doc[alike], minlength=len(size)))
            order = np.lexsort((doc, part))
            part, short, doc = part[order], short[order], doc[order]
            cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
            rows = []
            for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(part)].tolist(), strict=True):
                first = np.flatnonzero(np.r_[True, doc[a + 1 : b] != doc[a : b - 1]])
                own = doc[a:b][first]
                head = np.array([b - a, len(own)], np.int64).tobytes()
                rows.append((int(part[a]), head + node[own].tobytes() + _planes(size[own]) + _planes(need[own]) + _planes(np.diff(np.r_[first, b - a])) + short[a:b].tobytes()))
            yield common.packed_batch(rows)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, sizes, needs, grams, where, base = [], [], [], [], [], 0
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m, k = np.frombuffer(blob, np.int64, 2).tolist()
                ids.append(np.frombuffer(blob, np.uint64, k, 16))
                size, need, times = (_from_planes(blob, k, 16 + 8 * k + 4 * k * c) for c in range(3))
                sizes.append(size)
                needs.append(need)
                grams.append(np.frombuffer(blob, np.uint32, m, 16 + 20 * k).astype(np.uint64) | (np.uint64(part) << np.uint64(32)))
                where.append(np.repeat(np.arange(base, base + k, dtype=np.int32), times))
                base += k
        if not ids:
            return
        node, first, code = np.unique(np.concatenate(ids), return_index=True, return_inverse=True)
        size, need = np.concatenate(sizes)[first].astype(np.int64), np.concatenate(needs)[first].astype(np.int64)
        del ids, sizes, needs
        grams, who = np.concatenate(grams), code[np.concatenate(where)]
        order = np.lexsort((who, grams))
        grams, who = grams[order], who[order]
        keep = np.r_[True, (grams[1:] != grams[:-1]) | (who[1:] != who[:-1])]
        grams, who = grams[keep], who[keep]
        cuts = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        m = np.diff(np.r_[cuts, len(grams)])

        # Pairs are counted in blocks of a fixed number; the counts of several blocks add up in the next step.
        low: list[np.ndarray] = []
        held = 0
        for k in np.unique(m[(m > 1) & (m <= PAIRWISE)]).tolist():
            i, j = np.triu_indices(k, 1)
            at = cuts[m == k]
            for c in range(0, len(at), max(1, _PAIRS // len(i))):
                block = who[at[c : c + max(1, _PAIRS // len(i))][:, None] + np.arange(k)[None, :]]
                x, y = block[:, i].ravel(), block[:, j].ravel()
                fits = (size[x] >= t * size[y] - 1e-9) & (size[y] >= t * size[x] - 1e-9)
                low.append(x[fits] * len(node) + y[fits])
                held += len(low[-1])
                if held > _PAIRS:
                    yield _pack_pairs(node, need, *np.unique(np.concatenate(low), return_counts=True), parts)
                    low, held = [], 0
        if held:
            yield _pack_pairs(node, need, *np.unique(np.concatenate(low), return_counts=True), parts)
        star, held = [], 0
        for c, k in zip(cuts[m > PAIRWISE].tolist(), m[m > PAIRWISE].tolist(), strict=True):
            star.append(who[c] * len(node) + who[c : c + k])
            held += k
            if held > _PAIRS:
                star = [np.unique(np.concatenate(star))]
                held = len(star[0])
        if star:
            both = np.unique(np.concatenate(star))
            yield _pack_pairs(node, need, both, np.full(len(both), _STAR), parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [_unpack_pairs(x) for batch in batches for x in batch.column(1).to_pylist()]
        if not found:
            return
        x, y, times, need = (np.concatenate(c) for c in zip(*found, strict=True))
        order = np.lexsort((y, x))
        x, y, times, need = x[order], y[order], times[order], need[order]
        head = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
        times = np.add.reduceat(times, head)
        full, need = times >= _STAR, np.minimum.reduceat(need, head)
        keep = full | (times >= need)
        yield from common.to_batches({"pivot": pa.array(x[head][keep].view(np.int64)), "member": pa.array(y[head][keep].view(np.int64)), "full": pa.array(full[keep])})

    met = common.exchange(_source(docs).mapInArrow(common.lean(send), common.PACKED), parts).mapInArrow(common.lean(meet), common.PACKED)
    met = common.table(common.exchange(met, parts).mapInArrow(common.lean(add), "pivot long, member long, full boolean"), "jaccard-met")
    # Each node's pivot is its smallest candidate partner; both nodes of a pair go to the pivot of the first, so a
    # family of near copies is one region that has each set once, and not a region for each pair.
    pairs = met.where("NOT full").select(F.col("pivot").alias("x"), F.col("member").alias("y"))
    placed = pairs.join(common.checked(common.table(_homes(pairs), "jaccard-first-homes")), "x")
    regions = met.where("full").select("pivot", "member").unionByName(placed.select("pivot", F.col("x").alias("member"))).unionByName(placed.select("pivot", F.col("y").alias("member")))
    return common.table(regions.distinct(), "jaccard-regions")


def _planes(x: np.ndarray) -> bytes:
    """Small whole numbers as 32-bit ones, all lowest bytes first: the planes of zeros compress to nothing."""
    return np.ascontiguousarray(x.astype("<i4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _from_planes(raw: bytes, n: int, at: int) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at).reshape(4, n).T).view("<i4").ravel().astype(np.int64)


def _homes(pairs: DataFrame) -> DataFrame:
    """(x, pivot): for every node of ``pairs`` (x, y) the smallest of its partners and itself."""
    return pairs.unionByName(pairs.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("pivot"))


#: Stands for a count where a node is in a large neighbourhood of a pivot; more than n-grams that any two sets share.
_STAR = 1 << 40
_MOST = (1 << 31) - 1


def _pack_pairs(node: np.ndarray, need: np.ndarray, pair: np.ndarray, times: np.ndarray, parts: int) -> pa.RecordBatch:
    """Sorted pairs x * len(node) + y with their counts, packed by x.  A blob names each node once, and its columns are
    compressed, as a pair is met in almost every task."""
    import zstandard

    press, rows = zstandard.ZstdCompressor(level=1), []
    x, y = pair // len(node), pair % len(node)
    target = (common.mix(node[x]) % np.uint64(parts)).astype(np.int64)
    order = np.argsort(target, kind="stable")
    target, x, y, times = target[order], x[order], y[order], times[order]
    cuts = np.flatnonzero(np.r_[True, target[1:] != target[:-1]][: len(target)])
    for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(target)].tolist(), strict=True):
        own, local = np.unique(np.r_[x[a:b], y[a:b]], return_inverse=True)
        left, right = local[: b - a], local[b - a :]
        columns = _planes(need[own]) + _planes(np.diff(left, prepend=0)) + _planes(right) + _planes(np.minimum(times[a:b], _MOST))
        rows.append((int(target[a]), press.compress(np.array([b - a, len(own)], np.int64).tobytes() + node[own].tobytes() + columns)))
    return common.packed_batch(rows)


def _unpack_pairs(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(x, y, times, need) of a blob of ``_pack_pairs``."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, k = np.frombuffer(raw, np.int64, 2).tolist()
    node, need = np.frombuffer(raw, np.uint64, k, 16), _from_planes(raw, k, 16 + 8 * k)
    left, right, times = (_from_planes(raw, n, 16 + 12 * k + 4 * n * c) for c in range(3))
    left = np.cumsum(left)
    return node[left], node[right], np.where(times == _MOST, _STAR, times), np.minimum(need[left], need[right])


def join_nodes(docs: DataFrame, members: DataFrame, frequent: tuple[np.ndarray, np.ndarray], total: int, n: int, t: float, weights: DataFrame | None = None) -> DataFrame:
    """(a, b, overlap, jaccard) of all pairs of different nodes with Jaccard >= t, a < b, each once.

    With ``weights`` (node, weight, listed) rows (node, root, links, a, b) instead.  Those with a node: the nodes of the
    partners that it meets in one region add up to ``links`` by weight, and root is the smallest node that it is
    connected with there.  The others are the pairs of which a node is listed.
    """
    parts = common.partitions(docs.sparkSession)
    regions = _candidates(docs, frequent, total, n, t)
    # One document stands for each node.
    wanted = common.table(regions.groupBy(F.col("member").alias("node")).agg(F.collect_list("pivot").alias("pivots")), "jaccard-wanted")
    mapped = members.where("bits IS NOT NULL").join(common.checked(wanted.select("node")), "node", "left_semi")
    chosen = mapped.groupBy("node").agg(F.min(F.struct("doc_id", "rid")).alias("of"), F.first("size").alias("size")).join(common.checked(wanted), "node")
    if weights is not None:
        chosen = weights.join(common.checked(common.table(chosen, "jaccard-stand-ins")), "node")
    extra = [c for c in ("weight", "listed") if weights is not None]
    chosen = common.table(chosen.select(F.col("node").alias("member"), "of.*", "size", "pivots", *extra), "jaccard-chosen")
    whole = regions.join(common.checked(chosen), "member").withColumn("lower", F.filter("pivots", lambda p: p < F.col("pivot"))).drop("pivots")
    whole = common.table(whole, "jaccard-whole")
    placed = common.table(_blocks(whole.drop(*extra), REGION_BITS), "jaccard-placed")
    maps = members.where("bits IS NOT NULL").select("doc_id", "rid", "bits")
    sifted = maps.join(common.checked(placed), ["doc_id", "rid"]).select(*_KEY, "block", "member", "size", "bits", "lower")

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Those who have a possible partner in the region and not in one of a smaller pivot."""
        for group in _groups(batches):
            size, covered = group["size"].to_numpy().astype(np.int64), _covered(group["lower"])
            cross = group["low"][0].as_py() != group["high"][0].as_py()
            stays = np.zeros(len(size), bool)
            for i, j in possible(size, group["bits"].to_pylist(), t, group["block"].to_numpy() if cross else None):
                fresh = ~(stays[i] & stays[j])
                i, j = i[fresh], j[fresh]
                fresh = ~covered(i, j)
                stays[i[fresh]] = stays[j[fresh]] = True
            if stays.any():
                yield from common.to_batches({"pivot": pa.array(group["pivot"].to_numpy()[stays]), "member": pa.array(group["member"].to_numpy()[stays])})

    stays = sifted.repartition(parts, *_KEY).sortWithinPartitions(*_KEY).mapInArrow(common.lean(sift), "pivot long, member long")
    stays = common.table(stays.distinct(), "jaccard-sifted")
    cells = common.table(_blocks(whole.join(common.checked(stays), ["pivot", "member"]), REGION_SETS), "jaccard-cells")
    # Few cells are broadcast, so that the texts move once, to their cells; many are joined by a shuffle.
    cells = _source(docs).join(common.checked(cells), ["doc_id", "rid"]).select(*_KEY, "block", "member", "lower", "text", *extra)

    def pairs(group: pa.Table) -> Iterator[tuple[np.ndarray, ...]]:
        """(i, j, overlap, jaccard) of the pairs that the group gives; the node of i is the smaller one."""
        grams, off = gram_sets(group["text"].combine_chunks(), n)
        member, block, covered, size = group["member"].to_numpy(), group["block"].to_numpy(), _covered(group["lower"]), np.diff(off)
        cross = group["low"][0].as_py() != group["high"][0].as_py()
        for i, j, o in _several(region_blocks([grams[a:b] for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)], t)):
            keep = ~covered(i, j) & ((block[i] != block[j]) | (not cross))
            i, j, o = i[keep], j[keep], o[keep]
            swap = member[i] > member[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            yield i, j, o, o / (size[i] + size[j] - o)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            member = group["member"].to_numpy()
            for i, j, o, jaccard in pairs(group):
                yield from common.to_batches({"a": pa.array(member[i]), "b": pa.array(member[j]), "overlap": pa.array(o), "jaccard": pa.array(jaccard)})

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches):
            member, weight, listed = group["member"].to_numpy(), group["weight"].to_numpy(), np.asarray(group["listed"].combine_chunks())
            root, links, met = np.arange(len(member)), np.zeros(len(member), np.int64), np.zeros(len(member), bool)
            for i, j, _, _ in pairs(group):
                unite(root, i, j)
                met[i] = met[j] = True
                for x, y in ((i, j), (j, i)):
                    links += np.bincount(x, weight[y], len(member)).astype(np.int64)
                known = listed[i] | listed[j]
                yield from common.to_batches({c: pa.nulls(int(known.sum()), pa.int64()) for c in ("node", "root", "links")} | {"a": pa.array(member[i[known]]), "b": pa.array(member[j[known]])})
            if met.any():
                least = np.full(len(member), np.iinfo(np.int64).max)
                np.minimum.at(least, root, member)
                yield from common.to_batches({"node": pa.array(member[met]), "root": pa.array(least[root[met]]), "links": pa.array(links[met])} | {c: pa.nulls(int(met.sum()), pa.int64()) for c in ("a", "b")})

    placed = cells.repartition(parts, *_KEY).sortWithinPartitions(*_KEY)
    if weights is None:
        return placed.mapInArrow(common.lean(join), "a long, b long, overlap long, jaccard double")
    return placed.mapInArrow(common.lean(link), "node long, root long, links long, a long, b long")


def _math_guard(t: float) -> None:
    if not 0 < t <= 1 or not math.isfinite(t):
        raise ValueError("the threshold must lie in (0, 1]")


def join(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): pairs of documents whose sets of word n-grams (lower case) have Jaccard >= threshold.

    Documents with equal sets are one group, stood for by its smallest doc_id: each further member is paired with that
    (jaccard 1), and pairs between groups are given for the two that stand for them, doc_a < doc_b.  The pairs that
    this leaves out follow from those, so the result grows with the groups and not with their squares.  Null, empty
    and blank texts have no n-gram and no partner; a text of fewer than n words is one n-gram.  Rows with a null
    doc_id are not joined; rows with equal doc_id are one document with several sets and are not paired with
    themselves.  Texts are read whole; further columns are ignored; an empty table gives an empty result.
    """
    _math_guard(threshold)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    members, frequent, total = nodes(docs, n)
    members = members.where("size > 0")
    pairs = common.table(join_nodes(docs, members, frequent, total, n, threshold), "jaccard-node-pairs")
    named = common.table(members.groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n")), "jaccard-names")
    near = _touched(named, pairs)
    between = pairs.join(near.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), F.round("jaccard", 6).alias("jaccard"))
    several = common.table(named.where("n > 1").select("node", F.col("doc_id").alias("first")), "jaccard-several")
    equal = members.join(common.checked(several), "node").select(F.col("first").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard"))
    return between.unionByName(equal).where("doc_a < doc_b").groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def _touched(named: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of ``named`` whose node is in ``pairs`` (a, b), to be broadcast if they are few."""
    inside = common.table(pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct(), "jaccard-inside")
    return common.checked(common.table(named.join(common.checked(inside), "node", "left_semi"), "jaccard-touched"))


def join_all(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_a, doc_b, jaccard): all pairs of documents with Jaccard >= threshold, doc_a < doc_b.

    Like ``join``, but every member of a group of equal sets is paired with all other members and with all members of
    the groups near it: k copies give k (k - 1) / 2 rows.
    """
    _math_guard(threshold)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows, frequent, total = nodes(docs, n)
    members = common.table(rows.where("size > 0").select("node", "doc_id").distinct(), "jaccard-members")
    pairs = common.table(join_nodes(docs, rows.where("size > 0"), frequent, total, n, threshold), "jaccard-node-pairs").select("a", "b", F.round("jaccard", 6).alias("jaccard"))
    near = _touched(members, pairs)
    between = pairs.join(near.select(F.col("node").alias("a"), F.col("doc_id").alias("x")), "a").join(near.select(F.col("node").alias("b"), F.col("doc_id").alias("y")), "b").where("x != y")
    several = common.table(members.groupBy("node").count().where("count > 1").select("node"), "jaccard-several")
    copies = common.checked(common.table(members.join(common.checked(several), "node", "left_semi"), "jaccard-copies"))
    equal = copies.select("node", F.col("doc_id").alias("x")).join(copies.select("node", F.col("doc_id").alias("y")), "node").where("x < y").withColumn("jaccard", F.lit(1.0))
    out = between.select("x", "y", "jaccard").unionByName(equal.select("x", "y", "jaccard")).select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b"), "jaccard")
    # Two documents can meet more than once only if one of them has several sets.
    if members.groupBy("doc_id").count().where("count > 1").isEmpty():
        return out
    return out.groupBy("doc_a", "doc_b").agg(F.max("jaccard").alias("jaccard"))


def components(pairs: DataFrame) -> DataFrame:
    """(id, root): the smallest id that each id of ``pairs`` (u, v) is connected with.

    Alternating large-star and small-star steps; each round is checkpointed in the shared folder.
    """
    edges = common.cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u > v").distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        near = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(near, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        root = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(root, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(root.select("u", F.col("m").alias("v"))).where("u > v").distinct()
        fresh = common.cut(small)
        if fresh.exceptAll(edges).isEmpty() and edges.exceptAll(fresh).isEmpty():
            return fresh.select(F.col("u").alias("id"), F.col("v").alias("root"))
        edges = fresh


def classes(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, links): every document once, with the smallest doc_id of the documents that it is connected with
    by pairs of Jaccard >= threshold, and the number of other documents that it makes such a pair with.

    Counts are whole: copies and every near copy add to ``links``.  Rows with equal doc_id are one document with several
    sets, which is linked if any of its sets is, and once.  Null, empty and blank texts have no n-gram and no link; rows
    with a null doc_id are no documents.  A text of fewer than n words is one n-gram.  Texts are read whole; further
    columns are ignored; an empty table gives an empty result.
    """
    _math_guard(threshold)
    docs = docs.where("doc_id IS NOT NULL").select("doc_id", "text")
    rows, frequent, total = nodes(docs, n)
    members = common.table(rows.select("doc_id", F.expr("IF(size > 0, node, NULL)").alias("node")).distinct(), "jaccard-members")
    sets = members.where("node IS NOT NULL")
    # Documents of several sets are counted from pairs, all others by adding up how many there are of each set.
    mixed = common.checked(common.table(sets.groupBy("doc_id").agg(F.count("*").alias("sets"), F.min("node").alias("first")).where("sets > 1"), "jaccard-mixed"))
    several = common.table(sets.join(mixed, "doc_id").select("doc_id", "node", "first"), "jaccard-several")
    named = sets.join(mixed.select("doc_id", "sets"), "doc_id", "left").groupBy("node")
    named = common.table(named.agg(F.min("doc_id").alias("least"), F.count_if(F.col("sets").isNull()).alias("weight"), (F.count("sets") > 0).alias("listed")), "jaccard-names")
    found = common.table(join_nodes(docs, rows.where("size > 0"), frequent, total, n, threshold, named.select("node", "weight", "listed")), "jaccard-links")
    linked = found.where("node IS NOT NULL")
    edges = linked.select(F.col("node").alias("u"), F.col("root").alias("v")).union(several.select("node", "first"))
    roots = common.checked(common.table(components(edges).withColumnRenamed("id", "node"), "jaccard-roots"))
    rooted = common.table(named.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "jaccard-rooted")
    # A tree of one node has the class of its least document.
    trees = rooted.join(common.checked(roots.select("root").distinct()), "root", "left_semi").groupBy("root").agg(F.min("least").alias("class_id"))
    near = common.checked(common.table(linked.groupBy("node").agg(F.sum("links").alias("near")), "jaccard-near"))
    more, mixed_links = _mixed_links(found, named, several)
    told = rooted.join(common.checked(common.table(trees, "jaccard-trees")), "root", "left").join(near, "node", "left").join(common.checked(more), "node", "left")
    told = told.select("node", F.coalesce("class_id", "least").alias("class_id"), (F.col("weight") - 1 + F.coalesce("near", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("links"))
    # One row for each set and document; of the sets of one document all have the same class.
    out = members.join(told, "node", "left").groupBy("doc_id").agg(F.min("class_id").alias("class_id"), F.max("links").alias("links"))
    out = out.join(common.checked(mixed_links).withColumnRenamed("links", "mixed"), "doc_id", "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("mixed", "links", F.lit(0)).alias("links"))


def _mixed_links(found: DataFrame, named: DataFrame, several: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((node, more), (doc_id, links)): how many documents of several sets (``several``) a document with this one set is
    linked with, and the links of each document of several sets."""
    pairs = found.where("node IS NULL").select("a", "b")
    own = several.select(F.col("node").alias("a"), F.col("node").alias("b")).distinct()
    both = common.table(pairs.union(pairs.select("b", "a")).union(own), "jaccard-listed")
    holders = several.select(F.col("node").alias("b"), F.col("doc_id").alias("holder"))
    more = both.join(holders, "b").groupBy(F.col("a").alias("node")).agg(F.count_distinct("holder").alias("more"))
    near = common.table(several.select("doc_id", F.col("node").alias("a")).join(both, "a").select("doc_id", "b").distinct(), "jaccard-listed-near")
    single = near.join(named.select(F.col("node").alias("b"), "weight"), "b").groupBy("doc_id").agg(F.sum("weight").alias("links"))
    mixed = near.join(holders, "b").where("holder != doc_id").groupBy("doc_id").agg(F.count_distinct("holder").alias("links"))
    return common.table(more, "jaccard-more"), common.table(single.union(mixed).groupBy("doc_id").agg(F.sum("links").alias("links")), "jaccard-mixed-links")


def keep_one(docs: DataFrame, n: int = N, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one document, that of the smallest doc_id, of each of the ``classes``; columns stay.

    Documents without links all stay: so do rows with a null doc_id and null, empty and blank texts.  Rows
    with equal doc_id are one document: they stay or go together.  Texts are compared whole; an empty table gives an
    empty result; further columns of any name are kept.
    """
    gone = common.table(classes(docs, n, threshold).where("class_id != doc_id").select(F.col("doc_id").alias("gone")), "jaccard-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("own"))
    return rows.join(common.checked(gone), F.col("own") == F.col("gone"), "left_anti").select("row.*")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The pairs as they are defined, their numbers by document, and what each document reaches along them.
SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[\t\n\x0b\f\r\x1c-\x1f ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, unnest(list_distinct(list_transform(range(0, greatest(1, len(w) - 2)), lambda i: array_to_string(w[i + 1:i + 3], ' ')))) AS gram FROM d WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS size FROM g GROUP BY doc_id),
o AS (SELECT a.doc_id AS doc_a, b.doc_id AS doc_b, count(*) AS shared FROM g a JOIN g b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY 1, 2),
p AS (SELECT doc_a, doc_b FROM o JOIN n x ON x.doc_id = doc_a JOIN n y ON y.doc_id = doc_b WHERE shared >= 0.5 * (x.size + y.size - shared)),
r(doc_id, other) AS (SELECT DISTINCT doc_id, doc_id FROM documents WHERE doc_id IS NOT NULL UNION SELECT r.doc_id, p.doc_b FROM r JOIN p ON p.doc_a = r.other)
SELECT r.doc_id, min(r.other) AS class_id, coalesce(any_value(c.links), 0) AS links
FROM r LEFT JOIN (SELECT doc_a, count(*) AS links FROM p GROUP BY doc_a) c ON c.doc_a = r.doc_id GROUP BY r.doc_id"""
