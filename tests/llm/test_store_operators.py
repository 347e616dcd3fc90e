import itertools
import os
import random
import tempfile
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import ann, chunk_store, common, mixing, nbest, separator_scan, tokens


def texts(seed, n):
    rng = random.Random(seed)
    return [" ".join("".join(rng.choice("theanoéß日 \n.") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 60))) for _ in range(n)]


# --- tokens, chunk store, separator scan ---------------------------------------------------------------------------


def test_encoder_equals_whole_texts():
    import pyarrow as pa

    e = tokens.Encoder()
    rows = [*texts(3, 60), "", "a  b", "x　　 y", "don't  stop\n\n\n now", "ab é è  ñ  z"]
    ids, off = e.encode(pa.array(rows))
    for k, t in enumerate(rows):
        assert ids[off[k] : off[k + 1]].tolist() == e.core.encode_ordinary(t), repr(t)


def test_encoder_takes_no_more_time_than_whole_texts():
    import pyarrow as pa

    rng = random.Random(8)
    rows = [" ".join("".join(rng.choice("theanois") for _ in range(rng.randint(4, 12))) for _ in range(500)) for _ in range(400)]
    column, fresh = pa.array(rows), [tokens.Encoder() for _ in range(3)]

    def cpu(run):
        began = time.thread_time()
        run()
        return time.thread_time() - began

    whole = min(cpu(lambda e=e: [e.core.encode_ordinary(t) for t in rows]) for e in fresh)
    assert min(cpu(lambda e=e: e.encode(column)) for e in fresh) < 1.5 * whole


def test_encoder_on_odd_columns():
    import pyarrow as pa

    e = tokens.Encoder()
    rows = [None, "<|endoftext|> x", "", "é<|endoftext|><|endoftext|>日", "\u3000\u3000 a\r\n\r\n\u2028 b \x85 ", None]
    for column in (pa.array(rows), pa.array(rows, pa.large_string()), pa.array(["out", *rows, "out"]).slice(1, len(rows))):
        ids, off = e.encode(column)
        assert ids.dtype == np.uint16
        assert [ids[a:b].tolist() for a, b in itertools.pairwise(off.tolist())] == [e.core.encode_ordinary(t or "") for t in rows]
    ids, off = e.encode(pa.array([b"a \xe3\x81 b\xff", b"\xc3"], pa.binary()))
    assert [ids[a:b].tolist() for a, b in itertools.pairwise(off.tolist())] == [e.core.encode_ordinary("a \ufffd b\ufffd"), e.core.encode_ordinary("\ufffd")]
    for column in (pa.array([], pa.string()), pa.array([None, ""], pa.string())):
        ids, off = e.encode(column)
        assert ids.dtype == np.uint16 and len(ids) == 0 and off.tolist() == [0] * (len(column) + 1)


def test_store_round_trip(docs):
    rows = texts(1, 40)
    rows += rows[:10] + ["", None, "word " * 9000]
    df = docs(rows)
    store = chunk_store.build(df).cache()
    e = tokens.Encoder()
    back = {r.doc_id: (bytes(r.ids), r.verified) for r in chunk_store.reconstruct(store).collect()}
    for k, t in enumerate(rows):
        assert back[k] == (np.array(e.core.encode_ordinary(t or ""), np.uint16).tobytes(), True)
    digests = [bytes(r.digest) for r in store.where("kind = 'chunk'").collect()]
    assert len(digests) == len(set(digests))
    damaged = store.withColumn("ids", F.when(F.col("kind") == "chunk", F.lit(b"xx")))
    assert not any(r.verified for r in chunk_store.reconstruct(damaged).where("length(ids) > 0").collect())
    missing = store.where("kind <> 'chunk'")
    assert not any(r.verified for r in chunk_store.reconstruct(missing).collect() if r.doc_id == 42)


def test_manifest_is_the_root_of_its_documents(docs):
    store = chunk_store.build(docs(texts(2, 30)), bucket_documents=8).collect()
    of = {}
    for r in store:
        if r.kind == "document":
            of.setdefault(r.bucket, []).append((r.doc_id, r.row_hash, bytes(r.digest)))
    assert {r.bucket: bytes(r.digest) for r in store if r.kind == "manifest"} == {b: chunk_store.merkle([x for *_, x in sorted(v)]) for b, v in of.items()}


def test_a_lost_document_breaks_its_bucket(docs):
    store = chunk_store.build(docs([*texts(2, 30), None]), bucket_documents=8).cache()
    of = {r.doc_id: r.bucket for r in store.where("kind = 'document'").collect()}
    assert set(of.values()) == {0, 1, 2, 3} and all(r.verified for r in chunk_store.reconstruct(store).collect())
    less = store.where("NOT (kind = 'document' AND doc_id = 3)")
    assert {r.doc_id for r in chunk_store.reconstruct(less).collect() if not r.verified} == {i for i, b in of.items() if b == of[3] and i != 3}
    bare = store.where("NOT (kind = 'manifest' AND bucket = 1)")
    assert {r.doc_id for r in chunk_store.reconstruct(bare).collect() if not r.verified} == {i for i, b in of.items() if b == 1}


def brute_cuts(ids):
    """Chunk ends of one document, from the definition."""
    out, last = [], 0
    for end in range(1, len(ids) + 1):
        window = ids[max(0, end - chunk_store.WINDOW) : end].astype(np.uint64)
        rolled = 0
        for k, x in enumerate(window.tolist()):
            rolled += int(common.mix(np.array([x + 1], np.uint64))[0]) * pow(0x9E3779B97F4A7C15, k, 1 << 64)
        name = int(common.mix(np.array([(rolled + len(window)) % (1 << 64)], np.uint64))[0])
        if end == len(ids) or end - last == chunk_store.LONGEST or (len(window) == chunk_store.WINDOW and name % (1 << chunk_store.MASK_BITS) == 0):
            out.append(end)
            last = end
    return out


def test_cuts_brute_force():
    rng = np.random.default_rng(4)
    texts_ = [rng.integers(0, 50_000, n).astype(np.uint16) for n in (0, 5, 900, 16, 400)] + [np.full(2500, 7, np.uint16)]
    off = np.r_[0, np.cumsum([len(x) for x in texts_])]
    want = [off[k] + e for k, x in enumerate(texts_) for e in brute_cuts(x)]
    assert chunk_store.cuts(np.concatenate(texts_), off).tolist() == want


def test_cuts_depend_on_content():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 50_000, 6000).astype(np.uint16)
    b = np.concatenate([rng.integers(0, 50_000, 77).astype(np.uint16), a])
    pieces = lambda x: {x[i:j].tobytes() for i, j in itertools.pairwise([0, *chunk_store.cuts(x, np.array([0, len(x)])).tolist()])}
    assert len(pieces(a) & pieces(b)) > 0.9 * len(pieces(a))
    same = np.zeros(5000, np.uint16)
    assert np.diff(np.r_[0, chunk_store.cuts(same, np.array([0, 5000]))]).max() <= chunk_store.LONGEST


def test_store_awkward(awkward, nothing):
    store = chunk_store.build(awkward)
    assert store.where("kind = 'document'").count() == awkward.count()
    assert chunk_store.reconstruct(store).where("NOT verified").count() == 0
    assert chunk_store.build(nothing).count() == 0 and chunk_store.reconstruct(chunk_store.build(nothing)).count() == 0


@pytest.mark.parametrize("block", [2, 14, 1 << 20])
def test_separator_scan_brute_force(spark, block):
    folder, rng, want = tempfile.mkdtemp(), np.random.default_rng(1), set()
    for f in range(4):
        ids = rng.integers(0, 6, 200).astype(np.uint16)
        ids[ids == 5] = tokens.END_OF_DOCUMENT
        if f == 1:
            ids[-1] = tokens.END_OF_DOCUMENT
        if f == 2:
            ids = np.zeros(0, np.uint16)
        ids.tofile(f"{folder}/{f}.bin")
        start = no = 0
        for k, x in enumerate(ids.tolist()):
            if x == tokens.END_OF_DOCUMENT:
                want.add((f"{f}.bin", no, start, k - start))
                no, start = no + 1, k + 1
        if start < len(ids):
            want.add((f"{f}.bin", no, start, len(ids) - start))
    assert {tuple(r) for r in separator_scan.scan(spark, folder, block_bytes=block).collect()} == want


def test_token_counts_of_written_documents(spark, docs, awkward, nothing):
    e = tokens.Encoder()
    rows = [*texts(5, 50), None, "", "long " * 20_000]
    folder = tempfile.mkdtemp()
    separator_scan.write_flat(docs(rows), f"{folder}/a")
    got = separator_scan.scan(spark, f"{folder}/a", block_bytes=512).collect()
    assert Counter(r.n_tokens for r in got) == Counter(len(e.core.encode_ordinary(t or "")) for t in rows)
    separator_scan.write_flat(awkward, f"{folder}/b")
    assert separator_scan.scan(spark, f"{folder}/b").count() == awkward.count()
    separator_scan.write_flat(nothing, f"{folder}/c")
    assert separator_scan.scan(spark, f"{folder}/c").count() == 0
    assert separator_scan.scan(spark, f"{folder}/none").count() == 0
    os.makedirs(f"{folder}/d")
    with open(f"{folder}/d/x.bin", "wb") as f:
        f.write(b"abc")
    with pytest.raises(ValueError):
        separator_scan.scan(spark, f"{folder}/d")


# --- mixing --------------------------------------------------------------------------------------------------------


def test_target_blocks():
    assert mixing.target_blocks({"a": 100, "b": 10}, {"a": 1, "b": 1}) == {"a": 10, "b": 10}
    assert mixing.target_blocks({"a": 90, "b": 10}, {"a": 2, "b": 1, "c": 5}) == {"a": 20, "b": 10}
    assert mixing.target_blocks({}, {"a": 1}) == {} and mixing.target_blocks({"a": 5}, {"a": 0}) == {}


def test_splitting_tree_is_exact_and_hypergeometric():
    quota = np.array([50, 30, 20])
    for shards in (1, 3, 8):
        out = mixing.splitting_tree(quota, shards, 1)
        assert (out.sum(0) == quota).all() and np.ptp(out.sum(1)) <= 1 and (out >= 0).all()
        assert (out == mixing.splitting_tree(quota, shards, 1)).all()
    first = np.array([mixing.splitting_tree(quota, 4, s)[0] for s in range(3000)])
    # A shard of 25 of 100 blocks: mean 25 p and variance 25 p (1 - p) 75 / 99.
    assert np.allclose(first.mean(0), [12.5, 7.5, 5], atol=0.15)
    assert np.allclose(first.var(0), [25 * p * (1 - p) * 75 / 99 for p in (0.5, 0.3, 0.2)], rtol=0.12)


def test_the_tree_is_the_same_wherever_it_is_split(spark, docs, monkeypatch):
    rows = [(k, f"text {k}", f"s{k % 3}") for k in range(900)]
    seen = []
    for most in (256, 3, 1):
        monkeypatch.setattr(mixing, "SUBTREE", most)
        seen.append(sorted((r.doc_id, r.mix_shard, r.mix_position) for r in mixing.mix(docs(rows), {"s0": 1, "s1": 2, "s2": 3}, shard_blocks=4).collect()))
    assert seen[0] == seen[1] == seen[2] and seen[0]
    # Brute force: each source's documents in hash order, cut at the tree's block sums.
    order = {s: [r.doc_id for r in docs(rows).withColumn("o", mixing._order(mixing.SEED)).where(F.col("source") == s).orderBy("o").collect()] for s in ("s0", "s1", "s2")}
    quota = np.array([mixing.target_blocks({s: 37 for s in order}, {"s0": 1, "s1": 2, "s2": 3})[s] for s in sorted(order)])
    tree = mixing.splitting_tree(quota, -(-int(quota.sum()) // 4), mixing.SEED)
    want = set()
    for j, s in enumerate(sorted(order)):
        ends = np.r_[0, np.cumsum(tree[:, j])] * mixing.BLOCK
        want |= {(i, shard) for shard in range(len(tree)) for i in order[s][ends[shard] : ends[shard + 1]]}
    assert {(i, shard) for i, shard, _ in seen[0]} == want


def test_mix_quotas(docs):
    rows = [(k, f"text {k}", f"s{min(k % 10, 3)}") for k in range(1000)]
    got = mixing.mix(docs(rows), {"s0": 1, "s1": 1, "s3": 2}, block=10, shard_blocks=12).collect()
    assert Counter(r.source for r in got) == {"s0": 100, "s1": 100, "s3": 200}
    assert len({r.doc_id for r in got}) == len(got)
    shards = Counter(r.mix_shard for r in got)
    assert len(shards) == 4 and set(shards.values()) == {100}
    for s in shards:
        assert sorted(r.mix_position for r in got if r.mix_shard == s) == list(range(100))
        assert all(n % 10 == 0 for n in Counter(r.source for r in got if r.mix_shard == s).values())
    assert {tuple(r) for r in got} == {tuple(r) for r in mixing.mix(docs(rows[::-1]), {"s0": 1, "s1": 1, "s3": 2}, block=10, shard_blocks=12).collect()}


def test_mix_awkward(awkward, nothing):
    got = mixing.mix(awkward)
    assert got.columns == [*awkward.columns, "mix_shard", "mix_position"]
    rows = got.collect()
    assert len(rows) >= 1 and {r.source for r in rows} <= {"src0", None}
    assert mixing.mix(got, block=1).columns == got.columns
    assert mixing.mix(nothing).count() == 0 and mixing.mix(awkward, {"absent": 1.0}).count() == 0


# --- n-best segmentation -------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def lattice():
    return nbest.Lattice()


def every_path(lattice, w):
    out = []

    def go(end, ids, score):
        if end == 0:
            out.append((score, ids))
            return
        single = False
        for s in range(max(0, end - lattice.longest), end):
            i = lattice.piece.get(w[s:end])
            if i is not None:
                go(s, (i, *ids), score + lattice.score[i])
                single |= s == end - 1
        if not single:
            b = tuple(lattice.byte[x] for x in w[end - 1].encode())
            go(end - 1, b + ids, score + lattice.byte_score * len(b))

    go(len(w), (), 0.0)
    return sorted(out, key=lambda x: (-x[0], x[1]))


@pytest.mark.parametrize("n", [1, 2, 4])
def test_nbest_brute_force(docs, lattice, n):
    rng = random.Random(n)
    rows = [" ".join("".join(rng.choice("theanoéß日") for _ in range(rng.randint(1, 5))) for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["a  b", " x", "\n\nab", "ab", "a▁b", "a\ue000b", "\ue000", "▁"]
    got = {}
    encoded = nbest.encode(docs(rows), n)
    for r in encoded.collect():
        got.setdefault(r.doc_id, []).append(r)
    for k, t in enumerate(rows):
        starts = [j for j, c in enumerate(" " + t) if c == " " and (j == 0 or (" " + t)[j - 1] != " ")]
        cut = [(" " + t)[a:b] for a, b in itertools.pairwise([*starts, len(t) + 1])]
        best = [(0.0, ())]
        for w in cut:
            best = sorted(((s + x, i + y) for s, i in best for x, y in every_path(lattice, w)[:n]), key=lambda x: -x[0])[:n]
        mine = sorted(got[k], key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, len(best) + 1))
        assert np.allclose([r.score for r in mine], [s for s, _ in best], atol=1e-5)
        assert len({tuple(r.ids) for r in mine}) == len(mine) and all(r.decoded_ok for r in mine)
    assert {(r.doc_id, r.text) for r in nbest.decode(encoded).collect()} == set(enumerate(rows))


def test_astar_is_in_order(lattice):
    for w in (" there", " aaaa", "onthe", " 日本", " a▁b", "a\nb"):
        paths = every_path(lattice, w)
        assert np.allclose([s for s, _ in lattice.word(w, 12)], [s for s, _ in paths[:12]])


def test_nbest_awkward(awkward, nothing):
    encoded = nbest.encode(awkward)
    rows = encoded.collect()
    assert all(r.decoded_ok for r in rows)
    assert [(r["rank"], r.score, r.ids) for r in rows if r.doc_id in (1, 2)] == [(1, 0.0, []), (1, 0.0, [])]
    want = Counter((r.doc_id, r.text or "") for r in awkward.collect())
    assert Counter((r.doc_id, r.text) for r in nbest.decode(encoded).collect() if r["rank"] == 1) == want
    assert nbest.encode(nothing).count() == 0


def test_one_very_long_word(docs):
    rows = ["x" * 3000 + "日" * 50, "▁▁ ▁", "a\ue000b \ue000▁"]
    encoded = nbest.encode(docs(rows), 4)
    assert all(r.decoded_ok for r in encoded.collect())
    assert {(r.doc_id, r.text) for r in nbest.decode(encoded).collect()} == set(enumerate(rows))


def test_words_of_any_length_are_charted_alike(docs, monkeypatch):
    rng = random.Random(6)
    rows = ["".join(rng.choice("theano\n") for _ in range(n)) for n in (3, 30, 62, 63, 64, 65, 66, 90)]
    rows += [" ".join(rows), "aaaa" * 16, "aaaa" * 17]
    seen = []
    for longest in (64, 1, 1000):
        monkeypatch.setattr(nbest, "_LONGEST_WORD", longest)
        seen.append(sorted((r.doc_id, r["rank"], tuple(r.ids), r.score, r.decoded_ok) for r in nbest.encode(docs(rows), 5).collect()))
    assert seen[0] == seen[1] == seen[2] and len(seen[0]) > 4 * len(rows)


def test_pieces_whose_polynomial_hashes_collide(docs):
    a = "".join("ab"[bin(k).count("1") & 1] for k in range(2048))
    b = a.translate(str.maketrans("ab", "ba"))
    coded = {r.doc_id: r.ids for r in nbest.encode(docs([f"{a} {b}", f"{b} {a}"]), 1).collect()}
    assert coded[0] != coded[1]
    assert {r.text for r in nbest.decode(nbest.encode(docs([f"{a} {b}", f"{b} {a}"]), 3)).collect()} == {f"{a} {b}", f"{b} {a}"}
    import pyarrow as pa

    e = tokens.Encoder()
    ids, off = e.encode(pa.array([f"{a} {b}"]))
    assert ids.tolist() == e.core.encode_ordinary(f"{a} {b}")


# --- nearest neighbours --------------------------------------------------------------------------------------------


def brute_neighbours(x, k):
    d = ((x[:, None, :] - x[None]) ** 2).sum(2) if len(x) < 600 else (x * x).sum(1)[:, None] + (x * x).sum(1)[None] - 2 * x @ x.T
    np.fill_diagonal(d, np.inf)
    return np.argsort(d, 1, kind="stable")[:, :k]


def test_recall_on_the_table(spark, small):
    got = {}
    for r in ann.op1_additive_quantisation_knn(spark, small).collect():
        got.setdefault(r.vec_id, {})[r["rank"]] = r.neighbor_id
    table = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in table], np.float32), [r.vec_id for r in table]
    want = brute_neighbours(x, 10)
    assert set(got) == {v for v in ids if v % 50 == 0}
    recall = np.mean([len({ids[j] for j in want[i]} & set(got[v].values())) / 10 for i, v in enumerate(ids) if v in got])
    assert recall >= 0.9 and all(sorted(g) == list(range(1, 11)) for g in got.values())


def test_recall_without_clusters(spark):
    x = np.random.default_rng(3).normal(size=(3000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    want = brute_neighbours(x, 10)
    assert np.mean([len(set(want[i].tolist()) & got[i]) / 10 for i in range(len(x))]) >= 0.9


def test_queries_search_all_rows_of_an_index_fitted_to_a_sample(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 1000)
    monkeypatch.setattr(ann, "SAMPLE_WORD", 8)
    x = np.random.default_rng(4).normal(size=(6000, 24)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").withColumns({"id": F.col("vec_id"), "v": F.col("embedding")})
    assert 800 < ann.sampled(df, len(x)).count() < 1200
    got = {}
    for r in ann.search(df, every=50).collect():
        got.setdefault(r.vec_id, set()).add(r.neighbor_id)
    want = brute_neighbours(x, 10)
    assert set(got) == set(range(0, 6000, 50)) and len(set.union(*got.values()) - set(got)) > 600
    assert np.mean([len(set(want[i].tolist()) & got[i]) / 10 for i in got]) >= 0.9


def test_beam_is_no_worse_than_greedy():
    rng = np.random.default_rng(0)
    x, books = rng.normal(size=(200, 8)), [rng.normal(size=(16, 8)) / (k + 1) for k in range(4)]
    codes, norm = ann.beam_encode(x, books, 8)
    sums = sum(b[codes[:, m]] for m, b in enumerate(books))
    assert np.allclose(norm, (sums**2).sum(1))
    assert ((x - sums) ** 2).sum(1).mean() < (ann.greedy(x, books) ** 2).sum(1).mean()


def test_search_awkward(spark):
    nan = float("nan")
    rows = [(1, [0.0, 0.0]), (2, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.0, 1.0]), (4, None), (5, [1.0]), (6, [nan, 1.0]), (None, [1.0, 1.0]), (7, [None, 1.0]), (8, [3.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"id": F.lit(1), "v": F.lit(2), "label": F.lit(None)})
    got = {}
    for r in ann.search(df, k=2).collect():
        got.setdefault(r.vec_id, []).append((r["rank"], r.neighbor_id))
    assert {k: sorted(v) for k, v in got.items()} == {1: [(1, 2), (2, 3)], 2: [(1, 3), (2, 1)], 3: [(1, 2), (2, 1)], 8: [(1, 1), (2, 2)]}
    assert ann.search(df.limit(0)).count() == 0 and ann.search(df.where("vec_id = 1")).count() == 0
