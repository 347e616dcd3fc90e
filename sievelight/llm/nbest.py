"""N-best SentencePiece segmentation: forward Viterbi scores as exact heuristics of a backward A* search.

The lattice of a text has a node at each character and an edge for each vocabulary piece.  Pieces never cross a word
boundary (a run of spaces begins a word), so the lattice of a text is the chain of its words' lattices:

* forward: Viterbi over all distinct words of a task at once, vectorised over words; a backward pass adds each word's
  loss of the second best path;
* the n best segmentations of a text differ from the best in the words with the n - 1 smallest losses only;
* backward: for those words, A* from the end of the word; a state's priority is the score of the path so far plus the
  forward score of its node, which is the exact best completion, so paths leave the queue in order of total score;
* the n best sums over those words' lists are the n best segmentations of the text.

Characters that no piece covers fall back to their UTF-8 byte pieces (all a word's bytes have them).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from . import common

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
N_BEST = 5
_KEEP = 200_000
#: Words whose alternatives a task keeps, about 1 KB each.
_KEEP_RIVALS = 30_000
_BAR = "▁"
SCHEMA = "doc_id long, rank int, score double, ids array<int>, decoded_ok boolean"


class Lattice:
    """Pieces of a SentencePiece model with log probabilities.

    A BPE model stores only the rank of each piece; ``score`` turns it into a log probability by Zipf's law over the
    ranks, -log((rank + 1) H).  A unigram model's scores are used as they are.
    """

    def __init__(self, model: str = MODEL) -> None:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        size = sp.get_piece_size()
        raw = np.array([sp.get_score(i) for i in range(size)])
        normal = [i for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        if all(float(raw[i]).is_integer() for i in normal):
            harmonic = math.log(sum(1.0 / (k + 1) for k in range(size)))
            raw = -np.log(np.maximum(-raw, 0) + 1.0) - harmonic
        self.score = raw
        self.text = [sp.id_to_piece(i) for i in range(size)]
        # Spaces stay spaces in the text, so pieces have them too; U+2581 itself is in no piece and is spelt by bytes.
        self.piece = {self.text[i].replace(_BAR, " "): i for i in normal}
        self.longest = max(map(len, self.piece))
        self.byte = {int(sp.id_to_piece(i)[3:5], 16): i for i in range(size) if sp.is_byte(i)}
        self.value = {i: b for b, i in self.byte.items()}
        self.unknown = sp.unk_id()
        worst = float(raw[normal].min()) - 1.0
        self.byte_score = worst

    def word(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations of one word, best first.

        The best is that of the forward pass, which of equal scores takes the longer last piece at each place, like
        ``Chart``; the others follow in the order in which the search ends them.
        """
        size = len(word)
        get, longest, score = self.piece.get, self.longest, self.score
        best, back = [0.0] + [-math.inf] * size, [0] * (size + 1)
        into: list[list[tuple[int, tuple[int, ...], float]]] = [[]]
        for end in range(1, size + 1):
            here, top, at = [], -math.inf, 0
            for start in range(max(0, end - longest), end):
                i = get(word[start:end])
                if i is not None:
                    s = score[i]
                    if best[start] + s > top:
                        top, at = best[start] + s, len(here)
                    here.append((start, (i,), s))
            if not here or here[-1][0] != end - 1:
                ids = tuple(self.byte.get(b, self.unknown) for b in word[end - 1].encode("utf-8", "replace"))
                s = self.byte_score * len(ids)
                if best[end - 1] + s > top:
                    top, at = best[end - 1] + s, len(here)
                here.append((end - 1, ids, s))
            best[end], back[end] = top, at
            into.append(here)
        steps, at = [], size
        while at > 0:
            start, ids, _ = into[at][back[at]]
            steps.append(ids)
            at = start
        first = tuple(i for ids in reversed(steps) for i in ids)
        # Of states with equal bounds the one nearest to the start goes first, so ties don't widen the search.
        out: list[tuple[float, tuple[int, ...]]] = [(best[size], first)]
        queue: list[tuple] = [(-best[size], size, 0, 0.0, None)] if n > 1 else []
        made = 0
        while queue and len(out) < n:
            bound, at, _, behind, chain = heapq.heappop(queue)
            if at == 0:
                ids: list[int] = []
                while chain is not None:
                    ids += chain[0]
                    chain = chain[1]
                if tuple(ids) != first:
                    out.append((min(-bound, best[size]), tuple(ids)))
                continue
            for start, step, s in into[at]:
                made += 1
                heapq.heappush(queue, (-(behind + s + best[start]), start, made, behind + s, (step, chain)))
        return out


#: Longer words are charted one by one instead of together with others of their length.  Any choice gives the same result.
_LONGEST_WORD = 64
_CELLS = 1 << 21


class Chart:
    """Best path, its score and the loss of the second best, for many words at once.

    Forward scores f and backward scores b give the best path through every edge, f(start) + score + b(end); the
    second best path is the best one through an edge off the best path.
    """

    def __init__(self, lattice: Lattice) -> None:
        self.lattice = lattice
        ids = np.array(sorted(lattice.piece.values()), np.int32)
        spelt = [bytes([lattice.value[i]]) if i in lattice.value else lattice.text[i].replace(_BAR, " ").encode() for i in range(len(lattice.text))]
        # Piece of each byte that is a character by itself, for characters without a piece.
        self.single = np.array([lattice.byte.get(b, -1) if b < 128 else -1 for b in range(256)], np.int32)
        self.size = np.array([len(x) for x in spelt], np.int64)
        self.at = np.cumsum(self.size) - self.size
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        key = common.range_hash(common._BYTE[self.bytes], self.at[ids], self.at[ids] + self.size[ids])
        # Two direct-mapped tables; the few that clash in the first are in the second.
        self.mask = np.uint64((1 << 20) - 1)
        self.key, self.id = np.r_[key, np.uint64(0)], np.r_[ids, np.int32(-1)]
        self.first, self.second = (np.full(1 << 20, len(ids), np.int32) for _ in range(2))
        self.first[key & self.mask] = np.arange(len(ids))
        rest = np.flatnonzero(self.first[key & self.mask] != np.arange(len(ids)))
        self.second[(key[rest] >> np.uint64(20)) & self.mask] = rest
        assert (self.find(key) == ids).all()

    def find(self, key: np.ndarray) -> np.ndarray:
        """Piece of each hash, -1 if none."""
        c = self.first[key & self.mask]
        rest = np.nonzero((c < len(self.id) - 1) & (self.key[c] != key))  # an empty place in the first table: no piece
        if len(rest[0]):
            other = self.second[(key[rest] >> np.uint64(20)) & self.mask]
            c[rest] = np.where(self.key[other] == key[rest], other, len(self.id) - 1)
        return self.id[c]

    def solve(self, raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray], np.ndarray]:
        """(best score, loss of the second best, ids of the best, whether it decodes to the word) for each word."""
        n = len(starts)
        top, gap, fine = np.zeros(n), np.full(n, np.inf), np.zeros(n, bool)
        ids: list[np.ndarray] = [np.zeros(0, np.int32)] * n
        p, inv = common.powers(len(raw))
        total = np.empty(len(raw) + 1, np.uint64)
        total[0] = 0
        np.cumsum(common._BYTE[raw] * p[: len(raw)], dtype=np.uint64, out=total[1:])
        heads = np.flatnonzero((raw & 0xC0) != 0x80)
        first = np.searchsorted(heads, starts)
        chars = np.searchsorted(heads, ends) - first
        odd = heads[np.minimum(first, len(heads) - 1)] != starts
        heads = np.r_[heads, len(raw)]
        longest = self.lattice.longest
        for size in np.unique(chars[(chars <= _LONGEST_WORD) & ~odd]).tolist():
            group = np.flatnonzero((chars == size) & ~odd)
            step = max(1, _CELLS // max(1, size * min(size, longest)))
            for at in range(0, len(group), step):
                own = group[at : at + step]
                self._group(own, size, heads[first[own][:, None] + np.arange(size)], ends[own], total, inv, top, gap, ids, fine, raw)
        for k in np.flatnonzero(~fine).tolist():  # bytes beyond the vocabulary, and very long words
            word = raw[starts[k] : ends[k]].tobytes()
            paths = self.lattice.word(word.decode("utf-8", "replace"), 2)
            top[k], ids[k] = paths[0][0], np.array(paths[0][1], np.int32)
            gap[k] = paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf
            fine[k] = decode_word(self.lattice, paths[0][1]).encode() == word
        return top, np.round(gap, 9), ids, fine

    def _group(self, own, size, place, last, total, inv, top, gap, ids, fine, raw) -> None:
        m, longest, score = len(own), self.lattice.longest, self.lattice.score
        place = np.ascontiguousarray(np.concatenate([place, last[:, None]], axis=1).T)
        upto, unit, at = total[place], inv[place[:-1]], place.astype(np.uint64)
        f = np.full((size + 1, m), -np.inf)
        f[0] = 0
        back, into = np.zeros((size + 1, m), np.int64), np.full((size + 1, m), -1, np.int32)
        edges: list[np.ndarray] = [np.zeros((0, m))]
        row = np.arange(m)
        for end in range(1, size + 1):
            low = max(0, end - longest)
            piece = self.find(common.mix((upto[end] - upto[low:end]) * unit[low:end] + (at[end] - at[low:end])))
            bare = np.flatnonzero(piece[-1] < 0)
            if len(bare):
                piece[-1, bare] = self.single[raw[place[end - 1, bare]]]
            s = np.where(piece >= 0, score[piece], -np.inf)
            if len(bare):
                s[-1, bare] = np.where(piece[-1, bare] >= 0, self.lattice.byte_score, -np.inf)
            edges.append(s)
            through = f[low:end] + s
            top_at = through.argmax(axis=0)  # of equal ones the longest last piece
            f[end], back[end], into[end] = through[top_at, row], low + top_at, piece[top_at, row]
        good = np.isfinite(f[size])
        b = np.full((size + 1, m), -np.inf)
        b[size] = 0
        path = np.zeros((size + 1, m), bool)  # nodes of the best path
        now = np.where(good, size, 0)
        flat = np.full((size, m), -1, np.int32)
        count = np.zeros(m, np.int64)
        path[now, row] = True
        while (now > 0).any():
            go = np.flatnonzero(now > 0)
            before = back[now[go], go]
            flat[count[go], go] = into[now[go], go]
            count[go] += 1
            now[go] = before
            path[now, row] = True
        second = np.full(m, -np.inf)
        for end in range(size, 0, -1):
            low = max(0, end - longest)
            through = edges[end] + b[end]
            b[low:end] = np.maximum(b[low:end], through)
            rest = f[low:end] + through
            on = np.flatnonzero(path[end] & path[back[end], row])
            rest[back[end, on] - low, on] = -np.inf  # the edge of the best path itself
            second = np.maximum(second, rest.max(axis=0))
        best = f[size]
        top[own] = best
        with np.errstate(invalid="ignore"):
            gap[own] = np.where(good & np.isfinite(second), np.maximum(best - second, 0), np.inf)
        for k in np.flatnonzero(good).tolist():
            ids[own[k]] = flat[: count[k], k][::-1]
        # Decode: the pieces' bytes against the word's.
        some = np.flatnonzero(good)
        if len(some):
            pieces = np.concatenate([ids[own[k]] for k in some.tolist()])
            spelt = self.size[pieces]
            out = self.bytes[np.repeat(self.at[pieces] - (np.cumsum(spelt) - spelt), spelt) + np.arange(spelt.sum())]
            width = last[some] - place[0, some]
            begin = np.cumsum(width) - width
            word = raw[np.repeat(place[0, some] - begin, width) + np.arange(width.sum())]
            if len(out) == len(word):
                wrong = np.r_[0, np.cumsum(out != word)]
                fine[own[some]] = wrong[begin + width] == wrong[begin]


def split_words(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Byte starts of the lattice's words: at each text's start and at a space that follows something else."""
    space = raw == 32
    start = np.zeros(len(raw), bool)
    start[1:] = space[1:] & ~space[:-1]
    start[off[:-1][off[:-1] < len(raw)]] = True
    return np.flatnonzero(start)


def best_sums(gaps: np.ndarray, n: int) -> list[tuple[float, dict[int, int]]]:
    """The n smallest total losses of choosing one alternative in each group; ``gaps`` is (group, alternative) losses.

    gaps[:, 0] is 0, rows increase, absent alternatives are inf.  Each result is (loss, {group: alternative}).  A* over
    deviations from the best: only the groups with the n - 1 smallest first gaps can differ in the n best.
    """
    if n == 1 or not len(gaps):
        return [(0.0, {})]
    k = min(n - 1, len(gaps))
    near = np.argpartition(gaps[:, 1], k - 1)[: k + 1] if k < len(gaps) else np.arange(len(gaps))
    near = near[np.lexsort((near, gaps[near, 1]))][:k]
    out: list[tuple[float, dict[int, int]]] = []
    queue: list[tuple[float, tuple[tuple[int, int], ...]]] = [(0.0, ())]
    seen = {()}
    while queue and len(out) < n:
        loss, chosen = heapq.heappop(queue)
        out.append((loss, dict(chosen)))
        now = dict(chosen)
        for g in near.tolist():
            a = now.get(g, 0) + 1
            if a < gaps.shape[1] and np.isfinite(gaps[g, a]):
                new = tuple(sorted((now | {g: a}).items()))
                if new not in seen:
                    seen.add(new)
                    heapq.heappush(queue, (float(sum(gaps[x, y] for x, y in new)), new))
    return out


def encode(docs: DataFrame, n: int = N_BEST, model: str = MODEL) -> DataFrame:
    """(doc_id, rank 1..n, score, ids, decoded_ok): the n best segmentations of every text, best first.

    The text is encoded with one space in front, spaces as U+2581, as the model does.  ``decoded_ok`` says that the
    ids decode to the text again.  Null and empty texts have one row with no ids and score 0.  A text with fewer
    than n segmentations has as many rows as it has.  Of equal scores of a word the one with the longer last piece is
    the best, and the others keep the search's order; of equal scores of a text the order is that of the words.  A null doc_id is kept; repeated rows are encoded each; an empty table gives an
    empty result; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        chart = Chart(lattice)
        store = _Store()
        rivals: dict[bytes, list[tuple[float, np.ndarray, bool]]] = {}
        for batch in common.slices(batches, "text"):
            raw, off = common.string_buffers(batch.column(1))
            d, full = batch.num_rows, np.diff(off) > 0
            raw = np.insert(raw, off[:-1][full], 32)  # the dummy space in front
            off = off + np.r_[0, np.cumsum(full)]
            starts = split_words(raw, off)
            ends = np.r_[starts[1:], len(raw)]
            index, unique, at = common.distinct(raw, starts)
            slot = store.slots(unique)
            new = np.flatnonzero(slot < 0)
            if len(new):
                slot[new] = store.add([unique[k] for k in new.tolist()], *chart.solve(raw, starts[at[new]], ends[at[new]]))
            if len(rivals) > _KEEP_RIVALS:
                rivals = {}
            words = np.searchsorted(starts, off)
            each = store.size[slot][index]
            total = np.r_[0, np.cumsum(each)]
            ids = store.flat[np.repeat(store.at[slot][index] - total[:-1], each) + np.arange(total[-1])]
            sums = np.r_[0.0, np.cumsum(store.top[slot][index])]
            fine = store.fine[slot][index]
            bad = np.r_[0, np.cumsum(~fine)]
            gap = store.gap[slot][index]
            bounds = total[words]
            doc_at, rank, value, parts, ok = [], [], [], [], []
            for k in range(d):
                w0, w1 = int(words[k]), int(words[k + 1])
                one, base, wrong_words = ids[bounds[k] : bounds[k + 1]], float(sums[w1] - sums[w0]), int(bad[w1] - bad[w0])
                # Only the words with the n - 1 smallest losses can differ in the n best.
                m = min(n - 1, w1 - w0)
                near = w0 + (np.argpartition(gap[w0:w1], m - 1)[:m] if 1 < m < w1 - w0 else gap[w0:w1].argmin(keepdims=True) if m == 1 else np.arange(m))
                near = near[np.lexsort((near, gap[near]))]
                other = []
                for w in near.tolist():
                    u = unique[index[w]]
                    found = rivals.get(u)
                    if found is None:
                        paths = lattice.word(u.decode("utf-8", "replace"), n)
                        found = rivals[u] = [(paths[0][0] - x, np.array(y, np.int32), decode_word(lattice, y).encode() == u) for x, y in paths[1:]]
                    other.append(found)
                losses = np.array([[0.0, *(x[0] for x in o), *[np.inf] * (n - 1 - len(o))] for o in other]).reshape(len(other), n)
                for r, (loss, changed) in enumerate(best_sums(losses, n)):
                    doc_at.append(k)
                    rank.append(r + 1)
                    value.append(round(base - loss, 6))
                    wrong = wrong_words
                    cut, pieces = 0, []
                    for g, alt in sorted(changed.items(), key=lambda x: near[x[0]]):
                        wrong += int(fine[near[g]]) - int(other[g][alt - 1][2])
                        lo = int(total[near[g]] - total[w0])
                        pieces += [one[cut:lo], other[g][alt - 1][1]]
                        cut = lo + int(each[near[g]])
                    ok.append(wrong == 0)
                    parts.append(np.concatenate([*pieces, one[cut:]]) if changed else one)
            lens = np.array([len(p) for p in parts], np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(lens)].astype(np.int32)), pa.array(np.concatenate(parts).astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc_at)), pa.array(rank, pa.int32()), pa.array(value), lists, pa.array(ok)], ["doc_id", "rank", "score", "ids", "decoded_ok"])
            common.give_back()  # a slice takes a second or so, and its pieces would scatter over the heap

    return docs.selectExpr("CAST(doc_id AS LONG) AS doc_id", "text").mapInArrow(common.lean(run), SCHEMA)


class _Store:
    """Solved words of a task, in growing arrays; emptied when it has grown too large."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}
        self.top, self.gap, self.fine = np.zeros(0), np.zeros(0), np.zeros(0, bool)
        self.at, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        if len(self.known) > 2 * _KEEP:
            self.__init__()
        get = self.known.get
        return np.array([get(h, -1) for h in keys], np.int64)

    def add(self, keys: list[bytes], top: np.ndarray, gap: np.ndarray, ids: list[np.ndarray], fine: np.ndarray) -> np.ndarray:
        base = len(self.top)
        place = np.arange(base, base + len(keys))
        self.known.update(zip(keys, place.tolist(), strict=True))
        size = np.array([len(x) for x in ids], np.int64)
        self.at = np.r_[self.at, len(self.flat) + np.cumsum(size) - size]
        self.flat = np.concatenate([self.flat, *ids]).astype(np.int32)
        self.size, self.top, self.gap, self.fine = np.r_[self.size, size], np.r_[self.top, top], np.r_[self.gap, gap], np.r_[self.fine, fine]
        return place


def decode_word(lattice: Lattice, ids: tuple[int, ...]) -> str:
    """Pieces to text; runs of byte pieces are UTF-8."""
    out, held = [], bytearray()
    for i in ids:
        if i in lattice.value:
            held.append(lattice.value[i])
            continue
        if held:
            out.append(held.decode("utf-8", "replace"))
            held = bytearray()
        out.append(lattice.text[i].replace(_BAR, " "))
    return "".join(out) + held.decode("utf-8", "replace")


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """(doc_id, rank, text) from rows of ``encode``; the dummy space in front is taken off again.  Null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(model)
        for batch in batches:
            texts = [None if ids is None else decode_word(lattice, tuple(ids)).removeprefix(" ") for ids in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["doc_id", "rank", "text"])

    return encoded.select("doc_id", "rank", "ids").mapInArrow(common.lean(run), "doc_id long, rank int, text string")


def op9_nbest_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"))
