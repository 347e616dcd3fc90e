"""Line dedup by a segment-partition edit join.

A line is dropped if the same line, or one near it, occurs earlier in the corpus (order: doc_id, then row hash, then
line number).  Two lines are near if they are within tau edits of their UTF-8 bytes, where tau is one edit for every
``EVERY`` bytes of the shorter line, and ``TAU`` at most: a share of the line, so that short lines that say different
things are not near.

* Equal lines meet by a 128-bit hash.
* Near lines: a line is split into tau + 1 segments, and by the pigeonhole principle at least one segment
  of the shorter line is a substring of the longer one near its own place.  The longer line probes the index with
  exactly those substrings that a match can use, given both lengths (multi-match-aware selection).
* Index and probe keys travel as packed hashes; lines that share a key and differ little enough in their counts of
  bytes are candidates, and only their texts are read again and verified by a banded bit-parallel edit distance, vectorised over pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

TAU = 2
EVERY = 12
_PAIRS = 4096
_HELD = 500_000


def edits(length: np.ndarray, tau: int) -> np.ndarray:
    """How many edits a line of so many bytes may be away from a longer one."""
    return np.minimum(tau, np.maximum(length, 0) // EVERY)


def line_spans(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the lines of all texts ('\\n' separates), and each text's offset into them."""
    breaks = np.flatnonzero(raw == 10)
    starts = np.concatenate([off[:-1], breaks + 1])
    ends = np.concatenate([off[1:], breaks])
    text = np.concatenate([np.arange(len(off) - 1), np.searchsorted(off, breaks, side="right") - 1])
    order = np.lexsort((starts, text))
    # Starts and ends pair up by rank: inside a text both are sorted.
    starts = starts[order]
    ends = ends[np.lexsort((ends, text))]
    return starts, ends, np.searchsorted(np.sort(text), np.arange(len(off)))


def segments(length: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """(starts, sizes), lines x (tau + 1): even partition, the last segments one longer."""
    k = tau + 1
    base, more = length // k, length % k
    size = base[:, None] + (np.arange(k)[None, :] >= (k - more)[:, None])
    return np.cumsum(size, axis=1) - size, size


def probes(length: np.ndarray, tau: int, most: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length difference and segment: (delta, segment, which lines, start, size) of the substrings to look up.

    A line of length n looks for lines of length n - delta that may be ``tau`` edits away.  With multi-match-aware bounds, segment i (from 0) of the
    shorter line may begin at p + d with |d| <= i and |d - delta| <= tau - i.
    """
    for delta in range(tau + 1):
        start, size = segments(np.maximum(length - delta, 0), tau)
        fits = edits(length - delta, most) == tau
        for i in range(tau + 1):
            for d in range(max(-i, delta - (tau - i)), min(i, delta + (tau - i)) + 1):
                at = start[:, i] + d
                which = np.flatnonzero(fits & (at >= 0) & (at + size[:, i] <= length))
                yield delta, i, which, at[which], size[which, i]


def within(a: list[bytes], b: list[bytes], tau: int) -> np.ndarray:
    """Whether each pair is within tau edits: a banded bit-parallel edit distance, vectorised over the pairs.

    Column j holds the band of rows j - tau .. j + tau as the bits of tau + 1 words, one for each threshold; a column
    follows from the one before by shifts and masks.
    """
    n = len(a)
    la, lb = np.array([len(x) for x in a], np.int64), np.array([len(x) for x in b], np.int64)
    ok = np.abs(la - lb) <= tau
    width = int(max(la.max(initial=0), lb.max(initial=0)))
    band = 2 * tau + 1
    pa_ = np.full((n, width + 2 * band), 256, np.int16)
    pb = np.full((n, width + 1), 257, np.int16)
    for k in range(n):
        pa_[k, band : band + la[k]] = np.frombuffer(a[k], np.uint8)
        pb[k, : lb[k]] = np.frombuffer(b[k], np.uint8)
    pa_, pb = np.ascontiguousarray(pa_.T), np.ascontiguousarray(pb.T)
    # One word per threshold t: bit c is set iff the distance at row j - tau + c of column j is at most t.
    words = [np.zeros(n, np.uint64) for _ in range(tau + 1)]
    for t in range(tau + 1):
        v = 0
        for c in range(band):
            row = c - tau
            if 0 <= row <= t:
                v |= 1 << c
        words[t][:] = v
    full = np.uint64((1 << band) - 1)
    one = np.uint64(1)
    for j in range(1, int(lb.max(initial=0)) + 1):
        equal = np.zeros(n, np.uint64)
        for c in range(band):
            equal |= (pa_[band + j - tau + c - 1] == pb[j - 1]).astype(np.uint64) << np.uint64(c)
        inside = 0
        for c in range(band):
            if j - tau + c >= 0:
                inside |= 1 << c
        mask = full & np.uint64(inside)
        fresh = []
        for t in range(tau + 1):
            # Diagonal step: same bit.  From the left column (an insertion): one bit higher.  From above: one lower.
            now = words[t] & equal
            if t:
                now = now | words[t - 1] | (words[t - 1] >> one) | ((fresh[t - 1] << one) & full)
            if j <= t:
                now = now | np.uint64(1 << (tau - j))
            fresh.append(now & mask)
        live = j <= lb
        words = [np.where(live, f, w) for f, w in zip(fresh, words, strict=True)]
    at = la - lb + tau
    good = (at >= 0) & (at < band)
    last = words[tau]
    return ok & good & ((last >> np.where(good, at, 0).astype(np.uint64)) & one).astype(bool)


def _signature(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Eight saturating 7-bit counts of classes of bytes as one word.  An edit moves the counts by two at most."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(8):
        upto = np.r_[0, np.cumsum((raw & 7) == k)]
        out |= np.minimum(upto[ends] - upto[starts], 127).astype(np.uint64) << np.uint64(8 * k)
    return out


def _apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """By how much two signatures differ, summed over the classes: at most twice the edits."""
    a, b = x.view(np.uint8).reshape(-1, 8).astype(np.int16), y.view(np.uint8).reshape(-1, 8).astype(np.int16)
    return np.abs(a - b).sum(axis=1)


def near_pairs(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(a, ca, b, cb): 128-bit hashes of different lines that are near each other, each pair once, a <= b."""
    spark = docs.sparkSession
    # About 20 bytes for each of some 12 keys of a line.
    bulk = docs.select(F.sum(F.length("text"))).first()[0] or 0
    parts = common.parts_for(spark, bulk)

    def lines_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        raw, off = common.string_buffers(batch.column(0))
        starts, ends, _ = line_spans(raw, off)
        long = np.flatnonzero(edits(ends - starts, tau) > 0)
        return raw, starts[long], ends[long]

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw, starts, ends = lines_of(batch)
            if not len(starts):
                continue
            ids = common.wide_hash(raw, starts, ends)[0].view(np.uint64)
            _, once = np.unique(ids, return_index=True)
            starts, ends, ids = starts[once], ends[once], ids[once]
            p, inv = common.powers(len(raw))
            total = np.empty(len(raw) + 1, np.uint64)
            total[0] = 0
            np.cumsum(common._BYTE[raw] * p[: len(raw)], dtype=np.uint64, out=total[1:])

            def key(a, b, n, i):
                return common.mix(common.mix((total[b] - total[a]) * inv[a] + (b - a).astype(np.uint64)) + (n * 8 + i).astype(np.uint64))

            length = ends - starts
            keys, lines, role = [], [], []
            for t in range(1, tau + 1):
                own = np.flatnonzero(edits(length, tau) == t)
                at, size = segments(length, t)
                for i in range(t + 1):
                    a = starts[own] + at[own, i]
                    keys.append(key(a, a + size[own, i], length[own], i))
                    lines.append(own)
                    role.append(np.zeros(len(own), np.uint8))
                for delta, i, which, at_, size_ in probes(length, t, tau):
                    a = starts[which] + at_
                    if delta == 0 and len(which):
                        other = at_ != at[which, i]  # the line's own segment is in the index already
                        which, a, size_ = which[other], a[other], size_[other]
                    keys.append(key(a, a + size_, length[which] - delta, i))
                    lines.append(which)
                    role.append(np.ones(len(which), np.uint8))
            keys, lines, role = np.concatenate(keys), np.concatenate(lines), np.concatenate(role)
            part = (keys % np.uint64(parts)).astype(np.int64)
            mark = _signature(raw, starts, ends)
            yield common.packed_batch(list(common.pack(part, [(keys >> np.uint64(16)).astype(np.uint32), (keys >> np.uint64(48)).astype(np.uint16), ids[lines], mark[lines], role])))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high, line, mark, role = common.unpack_all(batches, [np.uint32, np.uint16, np.uint64, np.uint64, np.uint8])
        key = low.astype(np.uint64) | (high.astype(np.uint64) << np.uint64(32))
        order = np.lexsort((role, line, key))
        key, line, mark, role = key[order], line[order], mark[order], role[order]
        if not len(key):
            return
        first = np.r_[True, (key[1:] != key[:-1]) | (line[1:] != line[:-1]) | (role[1:] != role[:-1])]
        key, line, mark, role = key[first], line[first], mark[first], role[first]
        cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[cuts, len(key)])
        held, n = [], 0
        for c, m in zip(cuts[sizes > 1].tolist(), sizes[sizes > 1].tolist(), strict=True):
            index = np.flatnonzero(role[c : c + m] == 0) + c
            step = max(1, _HELD // m)
            for lo in range(0, len(index), step):
                some = index[lo : lo + step]
                x, y = np.repeat(some, m), np.tile(np.arange(c, c + m), len(some))
                fits = line[x] != line[y]
                x, y = x[fits], y[fits]
                fits = _apart(mark[x], mark[y]) <= 2 * tau
                x, y = line[x[fits]], line[y[fits]]
                if len(x):
                    held.append(np.stack([np.minimum(x, y), np.maximum(x, y)], axis=1))
                    n += len(x)
                if n > _HELD:
                    yield _pair_batch(held)
                    held, n = [], 0
        if held:
            yield _pair_batch(held)

    packed = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(common.lean(send), common.PACKED)
    candidates = common.table(common.exchange(packed, parts).mapInArrow(common.lean(meet), "a long, b long").distinct(), "line-candidates")

    wanted = common.table(candidates.select(F.col("a").alias("id")).union(candidates.select("b")).distinct(), "line-wanted")
    # Few candidates are looked up in the tasks by a broadcast array; many are joined by a shuffle.
    found = wanted.limit(common.BROADCAST_ROWS + 1).toArrow()["id"].to_numpy()
    sent = spark.sparkContext.broadcast(np.sort(found)) if len(found) <= common.BROADCAST_ROWS else None

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw, starts, ends = lines_of(batch)
            if not len(starts):
                continue
            ids, more = common.wide_hash(raw, starts, ends)
            once = np.unique(np.stack([ids, more], axis=1), axis=0, return_index=True)[1]
            if sent is not None:
                known = sent.value
                at = np.searchsorted(known, ids[once])
                once = once[known[np.minimum(at, len(known) - 1)] == ids[once]] if len(known) else once[:0]
            whole = raw.tobytes()
            yield pa.RecordBatch.from_arrays([pa.array(ids[once]), pa.array(more[once]), pa.array([whole[a:b] for a, b in zip(starts[once].tolist(), ends[once].tolist(), strict=True)], pa.binary())], ["id", "more", "line"])

    lines = docs.where(F.col("text").isNotNull()).select("text").mapInArrow(common.lean(texts), "id long, more long, line binary")
    if sent is None:
        lines = lines.join(wanted, "id", "left_semi")
    # Lines of one id but different texts all stand for it here, and are told apart by their texts and their second half.
    lines = common.table(lines.dropDuplicates(["id", "more"]), "line-texts")
    pairs = candidates.join(lines.select(F.col("id").alias("a"), F.col("more").alias("ca"), F.col("line").alias("la")), "a").join(lines.select(F.col("id").alias("b"), F.col("more").alias("cb"), F.col("line").alias("lb")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            la, lb = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            size = np.array([[len(x), len(y)] for x, y in zip(la, lb, strict=True)], np.int64).reshape(-1, 2)
            least, size = edits(size.min(axis=1), tau), size.max(axis=1)
            good = np.zeros(len(la), bool)
            for t in range(1, tau + 1):
                order = np.flatnonzero(least == t)
                order = order[np.argsort(size[order], kind="stable")]
                at = 0
                while at < len(order):  # pairs of like length together, about a fixed number of cells a call
                    step = max(1, min(_PAIRS, (1 << 21) // max(1, int(size[order[min(len(order) - 1, at + _PAIRS)]]))))
                    own = order[at : at + step]
                    good[own] = within([la[k] for k in own], [lb[k] for k in own], t)
                    at += step
            yield batch.select([0, 1, 2, 3]).filter(pa.array(good))

    return pairs.select("a", "ca", "b", "cb", "la", "lb").mapInArrow(common.lean(verify), "a long, ca long, b long, cb long")


def _pair_batch(held: list[np.ndarray]) -> pa.RecordBatch:
    both = np.unique(np.concatenate(held), axis=0)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, k]).view(np.int64)) for k in range(2)], ["a", "b"])


def removals(docs: DataFrame, tau: int = TAU) -> DataFrame:
    """(doc_id, rid, dropped): the numbers of the lines of each document that occur earlier, ascending."""

    def narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            raw, off = common.string_buffers(batch.column(2))
            starts, ends, texts = line_spans(raw, off)
            blank = np.r_[0, np.cumsum(~common._SPACE[raw])]
            full = np.flatnonzero(blank[ends] > blank[starts])
            text = common.owner(texts)[full]
            take = pa.array(text)
            h, c = common.wide_hash(raw, starts[full], ends[full])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array((full - texts[text]).astype(np.int32)), pa.array(h), pa.array(c)], ["doc_id", "rid", "line_no", "h", "c"])

    source = docs.where(F.col("text").isNotNull()).select(F.col("doc_id").cast("long"), F.xxhash64("doc_id", "text").alias("rid"), "text")
    lines = common.table(source.mapInArrow(common.lean(narrow), "doc_id long, rid long, line_no int, h long, c long"), "lines")
    place = F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "rid", "line_no")
    pairs = common.table(near_pairs(docs, tau), "line-near")
    both = pairs.selectExpr("a h", "ca c", "b other", "cb oc").union(pairs.selectExpr("b", "cb", "a", "ca"))
    firsts = lines.groupBy("h", "c").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    # Only lines that repeat or have a near line can lose anything.
    touched = both.select("h", "c").distinct().withColumn("near", F.lit(True))
    known = common.table(firsts.join(touched, ["h", "c"], "left").where("n > 1 OR near"), "line-first")
    late = both.join(known.select("h", "c", "first"), ["h", "c"]).join(known.selectExpr("h other", "c oc", "first of"), ["other", "oc"]).where("of < first").select("h", "c").distinct().withColumn("late", F.lit(True))
    rule = known.join(late, ["h", "c"], "left").select("h", "c", "first", F.coalesce("late", F.lit(False)).alias("late"))
    rule = common.table(rule, "line-rule")
    gone = lines.join(common.checked(rule), ["h", "c"]).where(F.col("late") | (place != F.col("first")))
    return gone.groupBy("doc_id", "rid").agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))


def dedup(docs: DataFrame, tau: int = TAU, counted: str = "lines_dropped") -> DataFrame:
    """``docs`` with the later of equal and near lines taken out of ``text``; adds their number as ``counted``.

    The first of each is kept, by doc_id (null first), then hash of the text, then line number.  Blank lines are
    never dropped.  A line is dropped if any near line is earlier, even if that one is dropped itself.  Lines of less
    than ``EVERY`` bytes may be no edit away, so they match equal ones only.  Null texts stay null; a text whose lines
    are all dropped becomes ''.  Lines and texts of any length are compared and rebuilt whole, in time proportional to
    their length.  Rows alike in id and text are one document, so they stay alike.  Other columns are kept (one named
    like ``counted`` is replaced), n_chars is not changed; an empty table gives an empty result.
    """
    own = [c for c in docs.columns if c != counted]
    gone = common.table(removals(docs, tau), "line-gone")
    row = docs.select(F.struct(*own).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("doc_id", "text").alias("r"))
    side = common.checked(gone.select(F.col("doc_id").alias("d2"), F.col("rid").alias("r2"), "dropped"))
    joined = row.join(side, row["d"].eqNullSafe(F.col("d2")) & (row["r"] == F.col("r2")), "left")
    # The arrays of one element make Spark split a text once, and not once for each line and each use of the new text.
    cut = joined.select("row", "dropped", F.explode(F.array(F.when(F.col("dropped").isNotNull(), F.split("row.text", "\n")))).alias("lines"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped"))
    text = F.when(F.col("dropped").isNull(), F.col("row.text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("lines", i)), "\n"))
    whole = cut.select("row", F.explode(F.array(text)).alias("new"), F.coalesce(F.size("dropped"), F.lit(0)).alias("n"))
    return whole.select(*[F.col("new").alias("text") if c == "text" else F.col(f"row.{c}").alias(c) for c in own], F.col("n").alias(counted))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "text", "lines_dropped")


SQL = """
WITH l AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) AS line_no, unnest(string_split(text, chr(10))) AS line FROM documents),
f AS (SELECT doc_id, line_no, line, trim(line) = '' AS blank, row_number() OVER (PARTITION BY line ORDER BY doc_id, line_no) AS nth FROM l),
u AS (SELECT line, doc_id, line_no, strlen(line) AS n, length(replace(line, 'a', '')) AS a, length(replace(line, 'e', '')) AS e, length(replace(line, 'n', '')) AS c, length(replace(line, 't', '')) AS t, length(replace(line, 'r', '')) AS r, length(line) AS k FROM f WHERE nth = 1 AND strlen(line) >= 12 AND NOT blank),
near AS (SELECT DISTINCT x.line FROM u x JOIN u y ON x.n BETWEEN y.n - 2 AND y.n + 2 AND (y.doc_id, y.line_no) < (x.doc_id, x.line_no) AND x.line <> y.line
 AND abs(x.k - x.a - y.k + y.a) <= 2 AND abs(x.k - x.e - y.k + y.e) <= 2 AND abs(x.k - x.c - y.k + y.c) <= 2 AND abs(x.k - x.t - y.k + y.t) <= 2 AND abs(x.k - x.r - y.k + y.r) <= 2
 WHERE levenshtein(x.line, y.line) <= least(2, least(x.n, y.n) // 12)),
m AS (SELECT f.*, NOT blank AND (nth > 1 OR near.line IS NOT NULL) AS gone FROM f LEFT JOIN near USING (line))
SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (NOT gone), '') AS text, CAST(count(*) FILTER (gone) AS INTEGER) AS lines_dropped FROM m GROUP BY doc_id"""
