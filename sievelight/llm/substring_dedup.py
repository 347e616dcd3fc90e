"""Substring dedup by recompression.

Every text starts as its words' hashes.  Rounds replace runs of one symbol and pairs of symbols (a left symbol
followed by a right one, sides drawn anew each round from the symbol itself) by new symbols.  A symbol that has reached
``ANCHOR`` words is final.

A table of names that all tasks share would need an exchange of all symbols in every round.  Here the name of a symbol
is a function of what it stands for, which is the same table without the exchange: equal content gets the same name
everywhere, and whether two neighbours join depends on the two alone, so the symbols inside a substring don't depend on
the text around it nor on other texts, but for a few at its ends.

A final symbol that occurs twice in the corpus reveals a repeat; that is found by one exchange of the final symbols.
Around those, and nowhere else, every window of ``least`` words is named by 128 bits of hash and met with all others;
windows that occur twice are repeats, and their union in each text is the result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LEAST_WORDS = 50
ANCHOR = 6
ROUNDS = 30
#: Repeated symbols are looked up in a broadcast array up to this many; beyond it their places are joined by a shuffle.
BROADCAST_SYMBOLS = 4_000_000
_NULL = -(1 << 63)
_OTHER = np.uint64(0x9B97C21E6A5D3F41)


def recompress(words: np.ndarray, off: np.ndarray, anchor: int = ANCHOR) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbol, start, width, is_run) of the final symbols of all texts; starts count over all words.

    What becomes of a text doesn't depend on the texts beside it: every round looks at two neighbours alone, and the
    rounds end early only if no text has two open neighbours left.
    """
    u = np.uint64
    sym, start, width = words.copy(), np.arange(len(words)), np.ones(len(words), np.int64)
    doc, run = common.owner(off), np.zeros(len(words), bool)
    for r in range(ROUNDS):
        open_ = width < anchor
        near = doc[1:] == doc[:-1]
        if not (near & open_[1:] & open_[:-1]).any():
            break
        same = near & (sym[1:] == sym[:-1]) & open_[1:]
        if same.any():
            head = np.flatnonzero(np.r_[True, ~same])
            times = np.diff(np.r_[head, len(sym)])
            width = np.add.reduceat(width, head)
            sym, start, doc, run = sym[head], start[head], doc[head], run[head]
            many = times > 1
            sym[many] = common.mix(sym[many] ^ common.mix(times[many].astype(u) + u(0xA5A5)))
            run[many] = True
            open_ = width < anchor
            near = doc[1:] == doc[:-1]
        right = (common.mix(sym + u(r * 0x9E3779B9 + 1)) >> u(63)).astype(bool)
        pair = np.flatnonzero(near & ~right[:-1] & right[1:] & open_[:-1] & open_[1:])
        if len(pair):
            sym[pair] = common.mix(sym[pair] * u(0xD6E8FEB86659FD93) + common.mix(sym[pair + 1] + u(0x5851)))
            width[pair] += width[pair + 1]
            run[pair] = False
            keep = np.ones(len(sym), bool)
            keep[pair + 1] = False
            sym, start, width, doc, run = sym[keep], start[keep], width[keep], doc[keep], run[keep]
    final = width >= anchor
    return sym[final], start[final], width[final], run[final]


def _pack(part: np.ndarray, doc: np.ndarray, keys: list[np.ndarray], columns: list[np.ndarray]) -> list[tuple[int, bytes]]:
    """Like common.pack, with each target's documents (``keys`` by ``doc``) sent once."""
    if not len(part):
        return []
    order = np.argsort(part, kind="stable")
    part, doc, columns = part[order], doc[order], [c[order] for c in columns]
    cuts = np.flatnonzero(np.r_[True, part[1:] != part[:-1]])
    out = []
    for a, b in zip(cuts.tolist(), np.r_[cuts[1:], len(part)].tolist(), strict=True):
        own, local = np.unique(doc[a:b], return_inverse=True)
        out.append((int(part[a]), np.array([b - a, len(own)], np.int64).tobytes() + b"".join(k[own].tobytes() for k in keys) + local.astype(np.int32).tobytes() + b"".join(np.ascontiguousarray(c[a:b]).tobytes() for c in columns)))
    return out


def _unpack(batches: Iterator[pa.RecordBatch], keys: list, kinds: list) -> tuple[list[np.ndarray], np.ndarray, list[np.ndarray]]:
    heads, local, columns, base = [[] for _ in keys], [], [[] for _ in kinds], 0
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            m, k = np.frombuffer(blob, np.int64, 2).tolist()
            at = 16
            for h, kind in zip(heads, keys, strict=True):
                h.append(np.frombuffer(blob, kind, k, at))
                at += k * np.dtype(kind).itemsize
            local.append(np.frombuffer(blob, np.int32, m, at).astype(np.int64) + base)
            at += 4 * m
            for c, kind in zip(columns, kinds, strict=True):
                c.append(np.frombuffer(blob, kind, m, at))
                at += m * np.dtype(kind).itemsize
            base += k
    join = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return [join(h, kind) for h, kind in zip(heads, keys, strict=True)], join(local, np.int64), [join(c, kind) for c, kind in zip(columns, kinds, strict=True)]


def _twice(keys: np.ndarray) -> np.ndarray:
    """Whether each element occurs at least twice."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    equal = s[1:] == s[:-1]
    out = np.zeros(len(keys), bool)
    out[order] = np.r_[equal, False] | np.r_[False, equal]
    return out


def repeats(docs: DataFrame, least: int = LEAST_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """(doc_id, row_hash, start_word, end_word): the maximal stretches of words, end exclusive, that are covered by
    substrings of ``least`` words which occur at another place too, in this text or another.

    A repeat is found if its copies share a final symbol or lie in a long run of words: that is certain for runs, and
    for other repeats as likely as that not all of some ten symbols inside are cut differently (no repeat was missed in
    the tests against brute force and SQL).  What is reported is a repeat up to a collision of 128-bit hashes.
    Words are runs without ASCII white space and compared as they are.  Null and short texts have none; null ids are
    kept; rows alike in id and text are two places, reported once; long texts are read whole; further columns are
    ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    # A window is 24 bytes, and there are less than one for two bytes of text in the worst case, which is all repeats.
    parts = common.parts_for(spark, docs.select(F.sum(F.length("text"))).first()[0] or 0)
    source = docs.where(F.col("text").isNotNull()).select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("row_hash"), "text")
    parts64 = np.uint64(parts)

    def ids(batch: pa.RecordBatch) -> list[np.ndarray]:
        return [batch.column(0).to_numpy(), batch.column(1).to_numpy()]

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            words, off = common.word_hashes(batch.column(2))
            sym, start, _, _ = recompress(words, off, anchor)
            doc = np.searchsorted(off, start, side="right") - 1
            enough = np.diff(off)[doc] >= least
            sym, start, doc = sym[enough], start[enough], doc[enough]
            rows = _pack((sym % parts64).astype(np.int64), doc, ids(batch), [sym, (start - off[doc]).astype(np.int32)])
            if rows:
                yield common.packed_batch(rows)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (_, rid), local, (sym, start) = _unpack(batches, [np.int64, np.int64], [np.uint64, np.int32])
        hit = _twice(sym)
        yield from common.to_batches({"symbol": pa.array(sym[hit].view(np.int64)), "row_hash": pa.array(rid[local[hit]] if len(local) else np.zeros(0, np.int64)), "start": pa.array(start[hit])})

    found = common.table(common.exchange(source.mapInArrow(anchors, common.PACKED), parts).mapInArrow(shared, "symbol long, row_hash long, start int"), "substring-symbols")
    symbols = found.select("symbol").distinct()
    few = symbols.limit(BROADCAST_SYMBOLS + 1).toArrow()["symbol"].to_numpy()
    sent = spark.sparkContext.broadcast(np.sort(few.view(np.uint64))) if len(few) <= BROADCAST_SYMBOLS else None
    if sent is None:
        places = found.groupBy("row_hash").agg(F.collect_set("start").alias("starts"))
        # A left join: texts without a shared symbol are read too, for their long runs.
        source = source.join(places, "row_hash", "left").select("doc_id", "row_hash", "text", F.coalesce("starts", F.array().cast("array<int>")).alias("starts"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, "text"):
            words, off = common.word_hashes(batch.column(2))
            sym, start, width, run = recompress(words, off, anchor)
            if not len(sym):
                continue
            doc = np.searchsorted(off, start, side="right") - 1
            if sent is not None:
                known = sent.value
                at = np.minimum(np.searchsorted(known, sym), max(0, len(known) - 1))
                hit = known[at] == sym if len(known) else np.zeros(len(sym), bool)
            else:
                hit = np.zeros(len(sym), bool)
                for d, starts in enumerate(batch.column(3).to_pylist()):
                    own = slice(np.searchsorted(doc, d), np.searchsorted(doc, d, side="right"))
                    hit[own] = np.isin(start[own] - off[d], starts)
            # A run's name holds its length, so part of another run has another name: windows that touch it are tried.
            long = run & (width >= least // 2)
            hit |= long
            low = np.where(long, start - least + 1, np.minimum(start, start + width - least))[hit]
            high = np.where(long, start + width - 1, np.maximum(start, start + width - least))[hit]
            low = np.maximum(low, off[doc[hit]])
            high = np.minimum(high, off[doc[hit] + 1] - least)
            fits = high >= low
            mark = np.zeros(len(words) + 1, np.int64)
            np.add.at(mark, low[fits], 1)
            np.add.at(mark, high[fits] + 1, -1)
            at = np.flatnonzero(np.cumsum(mark) > 0)
            if not len(at):
                continue
            key, more = common.range_hash(words, at, at + least), common.range_hash(common.mix(words ^ _OTHER), at, at + least)
            d = np.searchsorted(off, at, side="right") - 1
            yield common.packed_batch(_pack((key % parts64).astype(np.int64), d, ids(batch), [key, more, (at - off[d]).astype(np.int32)]))

    def verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (did, rid), local, (key, more, start) = _unpack(batches, [np.int64, np.int64], [np.uint64, np.uint64, np.int32])
        hit = np.flatnonzero(_twice(key))
        # Both halves of the name must be equal.
        order = hit[np.lexsort((more[hit], key[hit]))]
        same = (key[order][1:] == key[order][:-1]) & (more[order][1:] == more[order][:-1])
        hit = order[np.r_[same, False] | np.r_[False, same]] if len(order) else order
        local, start = local[hit], start[hit]
        rows = _pack((rid.view(np.uint64)[local] % parts64).astype(np.int64), local, [did, rid], [start]) if len(local) else []
        if rows:
            yield common.packed_batch(rows)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (did, rid), local, (start,) = _unpack(batches, [np.int64, np.int64], [np.int32])
        if not len(local):
            return
        key, first, code = np.unique(rid, return_index=True, return_inverse=True)
        who, start = code[local], start.astype(np.int64)
        order = np.lexsort((start, who))
        who, start = who[order], start[order]
        head = np.flatnonzero(np.r_[True, (who[1:] != who[:-1]) | (start[1:] > start[:-1] + least)])
        last = np.r_[head[1:], len(who)] - 1
        own = did[first][who[head]]
        yield from common.to_batches({"doc_id": pa.array(own, pa.int64(), mask=own == _NULL), "row_hash": pa.array(key[who[head]]), "start_word": pa.array(start[head]), "end_word": pa.array(start[last] + least)})

    met = common.exchange(source.mapInArrow(windows, common.PACKED), parts).mapInArrow(verified, common.PACKED)
    return common.exchange(met, parts).mapInArrow(merge, "doc_id long, row_hash long, start_word long, end_word long")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_hash")


SQL = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[\t\n\x0b\f\r\x1c-\x1f ]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
h AS (SELECT doc_id, list_transform(range(0, len(w) - 49), lambda i: md5(array_to_string(w[i + 1:i + 50], ' '))) AS hs FROM d WHERE len(w) >= 50),
k AS (SELECT doc_id, unnest(hs) AS h, generate_subscripts(hs, 1) - 1 AS s FROM h),
r AS (SELECT doc_id, s FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY h) AS n FROM k) WHERE n > 1),
g AS (SELECT doc_id, s, CASE WHEN s <= lag(s) OVER (PARTITION BY doc_id ORDER BY s) + 50 THEN 0 ELSE 1 END AS head FROM r),
i AS (SELECT doc_id, s, sum(head) OVER (PARTITION BY doc_id ORDER BY s) AS island FROM g)
SELECT doc_id, CAST(min(s) AS BIGINT) AS start_word, CAST(max(s) + 50 AS BIGINT) AS end_word FROM i GROUP BY doc_id, island"""
