import itertools
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sievelight.llm import jaccard_join, license_scan, line_dedup, quality, substring_dedup
from sievelight.llm import registry

from .conftest import CLASHES


def words(rng, n, pool="abcdefgh"):
    return [("".join(rng.choice(pool) for _ in range(rng.randint(2, 7)))) for _ in range(n)]


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracles(spark, small, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    df = registry.QUERIES[name](spark, small)
    found = con.execute(registry.SQL[name])
    names = [c[0] for c in found.description]
    key = lambda cols, rows: sorted((tuple(r[cols.index(c)] for c in sorted(cols)) for r in rows), key=repr)
    assert sorted(names) == sorted(df.columns)
    assert key(df.columns, [tuple(r) for r in df.collect()]) == key(names, found.fetchall())


# --- quality rules -------------------------------------------------------------------------------------------------


def test_quality_separates_labelled_documents(spark, small):
    got = quality.op6_quality_rules(spark, small).join(spark.read.parquet(f"{small}/labels.parquet"), "doc_id")
    assert got.where("quality = 1 AND NOT keep").count() == 0
    assert got.where("quality = 0 AND keep").count() <= 0.05 * got.where("quality = 0").count() + 1


def test_quality_awkward(awkward, nothing):
    got = quality.quality(awkward).collect()
    assert len(got) == awkward.count()
    assert all(r.broken == "words" and not r.keep for r in got if r.doc_id in (1, 2, 3, 8))
    kept = quality.keep_good(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} >= {5, None}
    assert quality.quality(nothing).count() == 0 and quality.keep_good(nothing).count() == 0


def test_quality_uses_no_user_function(awkward):
    plan = quality.quality(awkward)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


# --- line dedup ----------------------------------------------------------------------------------------------------


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    rng = random.Random(1)
    a = [bytes(rng.choice(b"abc") for _ in range(rng.randint(0, 14))) for _ in range(1500)]
    b = []
    for x in a:
        y = bytearray(x)
        for _ in range(rng.randint(0, 4)):
            k = rng.randint(0, len(y))
            if rng.random() < 0.4:
                y.insert(k, rng.choice(b"abc"))
            elif k < len(y) and rng.random() < 0.5:
                del y[k]
            elif k < len(y):
                y[k] = rng.choice(b"abc")
        b.append(bytes(y))
    for tau in (1, 2, 3):
        assert line_dedup.within(a, b, tau).tolist() == [distance(x, y) <= tau for x, y in zip(a, b, strict=True)]


def near(a: bytes, b: bytes, tau: int) -> bool:
    """Whether the distance is at most tau; lengths and counts of bytes rule most pairs out."""
    if abs(len(a) - len(b)) > tau:
        return False
    x, y = Counter(a), Counter(b)
    return max((x - y).total(), (y - x).total()) <= tau and distance(a, b) <= tau


def brute_lines(rows, tau=2, every=12):
    seen, known, out = [], set(), {}
    for i, text in sorted(rows):
        kept, dropped = [], 0
        for line in text.split("\n"):
            raw = line.encode()
            if not line.strip(" \t\r\x0b\x0c\x1c\x1d\x1e\x1f"):
                kept.append(line)
                continue
            if raw in known or any(near(raw, o, min(tau, min(len(raw), len(o)) // every)) for o in seen):
                dropped += 1
            else:
                kept.append(line)
            if raw not in known:
                known.add(raw)
                seen.append(raw)
        out[i] = ("\n".join(kept), dropped)
    return out


def test_line_dedup_brute_force(docs):
    rng = random.Random(7)
    base = [" ".join(words(rng, rng.randint(1, 9), "abé")) for _ in range(25)]
    rows = []
    for i in range(40):
        lines = []
        for _ in range(rng.randint(0, 6)):
            s = list(rng.choice(base))
            for _ in range(rng.randint(0, 3)):
                k = rng.randint(0, len(s))
                s[k : k + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            lines.append("".join(s))
        rows.append((i, "\n".join(lines)))
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.dedup(docs(rows)).collect()}
    assert got == brute_lines(rows)


def thue_morse(n):
    return "".join("ab"[bin(k).count("1") & 1] for k in range(n))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_lines_whose_polynomial_hashes_collide(docs, n):
    a = thue_morse(n)
    b = a.translate(str.maketrans("ab", "ba"))
    got = {r.doc_id: (r.text, r.lines_dropped) for r in line_dedup.dedup(docs([(1, a), (2, b), (3, b)])).collect()}
    assert got == {1: (a, 0), 2: (b, 0), 3: ("", 1)}


def test_long_text_is_rebuilt_in_linear_time(spark, docs):
    import time

    rng = random.Random(3)
    lines = [" ".join(words(rng, 5)) for _ in range(16_000)]
    df = docs([(1, lines[5]), (2, "\n".join(lines))]).cache()
    line_dedup.dedup(docs([(1, lines[5]), (2, lines[5])])).collect()
    began = time.time()
    line_dedup.dedup(docs([(1, lines[5]), (2, lines[5])])).collect()
    small, began = time.time() - began, time.time()
    got = {r.doc_id: r.text for r in line_dedup.dedup(df).collect()}
    assert got == {i: t for i, (t, _) in brute_lines_equal([(1, lines[5]), (2, "\n".join(lines))]).items()}
    assert time.time() - began < small + 10


def brute_lines_equal(rows):
    seen, out = set(), {}
    for i, t in rows:
        kept = [x for x in t.split("\n") if not (x in seen or seen.add(x))]
        out[i] = ("\n".join(kept), 0)
    return out


def test_line_dedup_awkward(awkward, nothing):
    got = line_dedup.dedup(awkward)
    assert got.columns == [*awkward.columns, "lines_dropped"]
    rows = got.collect()
    assert len(rows) == awkward.count()
    assert all(r.text is None for r in rows if r.doc_id == 1)
    assert {(r.text, r.lines_dropped) for r in rows if r.doc_id in (2, 3, 8)} == {("", 0), ("   \n\t ", 0), ("\n\n\n", 0)}
    assert [r.lines_dropped for r in rows if r.text == "same text same text"] == [0, 0]
    assert line_dedup.dedup(nothing).count() == 0


def test_many_variants_of_one_line(docs):
    base = "the quick brown fox jumps over the lazy dog again"
    rows = [(k, base[:10] + chr(97 + k % 26) + base[11 : 20 + k // 26] + chr(65 + k % 26) + base[21 + k // 26 :]) for k in range(200)]
    got = {r.doc_id: r.lines_dropped for r in line_dedup.dedup(docs(rows)).collect()}
    assert got == {i: d for i, (_, d) in brute_lines(rows).items()}


# --- n-gram Jaccard join -------------------------------------------------------------------------------------------


def gram_set(text, n):
    w = re.split("[ \t\n\r]+", (text or "").lower().strip(" \t\n\r"))
    w = [x for x in w if x]
    return frozenset(tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))) if w else frozenset()


def brute_jaccard(rows, n, t):
    sets = {i: gram_set(x, n) for i, x in rows}
    first = {}
    for i in sorted(sets):
        if sets[i]:
            first.setdefault(sets[i], i)
    out = {(first[s], i) for i, s in sets.items() if s and first[s] != i}
    reps = sorted(first.values())
    for a, b in itertools.combinations(reps, 2):
        o = len(sets[a] & sets[b])
        if o and o >= t * (len(sets[a]) + len(sets[b]) - o) - 1e-9:
            out.add((a, b))
    return out


@pytest.mark.parametrize("n,t", [(3, 0.5), (2, 0.7), (1, 0.4)])
def test_jaccard_brute_force(docs, monkeypatch, n, t):
    rng = random.Random(n)
    common_words = words(rng, 30)
    rows = []
    for f in range(12):
        base = [rng.choice(common_words) if rng.random() < 0.3 else words(rng, 1)[0] for _ in range(rng.randint(1, 60))]
        for _ in range(rng.randint(1, 9)):
            w = list(base)
            for _ in range(rng.randint(0, 1 + len(w) // 8)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows.append((len(rows), " ".join(w)))
    want = brute_jaccard(rows, n, t)
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.join(docs(rows), n, t).collect()} == want
    # Any frequency bound and any size of pairwise neighbourhood give the same result.
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    monkeypatch.setattr(jaccard_join, "PAIRWISE", 2)
    monkeypatch.setattr(jaccard_join, "REGION_BITS", 60)
    monkeypatch.setattr(jaccard_join, "REGION_SETS", 90)
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.join(docs(rows), n, t).collect()} == want


def test_region_join_is_exact():
    rng = random.Random(2)
    sets = []
    for _ in range(5):
        base = rng.sample(range(10_000), 60)
        for _ in range(40):
            s = set(base)
            for _ in range(rng.randint(0, 25)):
                s.discard(rng.choice(base))
                s.add(rng.randint(0, 20_000))
            sets.append(np.array(sorted(s), np.uint64))
    for t in (0.3, 0.5, 0.8):
        want = set()
        for i, j in itertools.combinations(range(len(sets)), 2):
            o = len(np.intersect1d(sets[i], sets[j]))
            if o >= t * (len(sets[i]) + len(sets[j]) - o) - 1e-9:
                want.add((i, j))
        assert {(i, j) for i, j, _ in jaccard_join.region_join(sets, t)} == want


def test_bitmaps_rule_out_no_match():
    rng = random.Random(8)
    base = rng.sample(range(1 << 40), 300)
    sets = [np.array(sorted({*rng.sample(base, rng.randint(1, 250)), *(rng.randint(0, 1 << 40) for _ in range(rng.randint(0, 300)))}), np.uint64) for _ in range(90)]
    off = np.r_[0, np.cumsum([len(x) for x in sets])]
    maps, size = jaccard_join.bitmaps(np.concatenate(sets), off), np.diff(off)
    for t in (0.3, 0.6):
        left = {(min(i, j), max(i, j)) for a, b in jaccard_join.possible(size, maps, t) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
        want = {(i, j) for i, j in itertools.combinations(range(len(sets)), 2) if (o := len(np.intersect1d(sets[i], sets[j]))) >= t * (size[i] + size[j] - o)}
        assert want <= left and len(left) < 90 * 89 // 4


def test_words_whose_polynomial_hashes_collide(docs):
    a = thue_morse(2048)
    b = a.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{a} {a} {b}"), (2, f"{b} {b} {a}"), (3, a), (4, b)]
    assert jaccard_join.join_all(docs(rows)).count() == 0
    assert substring_dedup.repeats(docs([(1, " ".join([a] * 50)), (2, " ".join([b] * 50))])).count() == 0


def test_jaccard_awkward(awkward, nothing):
    pairs = {(r.doc_a, r.doc_b) for r in jaccard_join.join(awkward).collect()}
    assert pairs == set()
    kept = jaccard_join.keep_one(awkward)
    assert kept.columns == awkward.columns and kept.count() == awkward.count()
    assert jaccard_join.join(nothing).count() == 0 and jaccard_join.keep_one(nothing).count() == 0


def test_keep_one_of_each_group(docs):
    base = words(random.Random(1), 80)
    chain = [(10 - k, " ".join(base[k * 8 : k * 8 + 30])) for k in range(5)]
    rows = [*chain, (20, "apart from them all"), (21, "APART from  them all"), (22, "")]
    kept = {r.doc_id for r in jaccard_join.keep_one(docs(rows), 1, 0.5).collect()}
    assert kept == {6, 20, 22}


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + k, 101 + k) for k in range(20)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, v in edges:
        a, b = find(u), find(v)
        root[max(a, b)] = min(a, b)
    want = {x: find(x) for x in list(root) if find(x) != x}
    got = jaccard_join.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r.id: r.root for r in got.collect()} == want


# --- substring dedup -----------------------------------------------------------------------------------------------


def brute_repeats(rows, least):
    count, out = Counter(), set()
    split = [(i, [x for x in re.split("[ \t\n\r]+", t) if x]) for i, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + least]) for k in range(len(w) - least + 1))
    for i, w in split:
        spans = []
        for k in range(len(w) - least + 1):
            if count[tuple(w[k : k + least])] > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + least
                else:
                    spans.append([k, k + least])
        out |= {(i, *s) for s in spans}
    return out


@pytest.mark.parametrize("seed", range(3))
def test_substrings_brute_force(docs, seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.choice([49, 50, 51, 60, 90])) for _ in range(12)] + [["na"] * 70, ["ab", "cd"] * 40]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            w += words(rng, rng.randint(0, 30)) + p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((i, " ".join(w + words(rng, rng.randint(0, 30)))))
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeats(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50)


def test_substrings_by_shuffle_are_the_same(docs, monkeypatch):
    rng = random.Random(9)
    p = words(rng, 80)
    rows = [(k, " ".join(words(rng, 40) + p[k:] + words(rng, 5))) for k in range(6)]
    monkeypatch.setattr(substring_dedup, "BROADCAST_SYMBOLS", 0)
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeats(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50) and got


def test_recompression_names_equal_content_alike():
    rng = np.random.default_rng(0)
    inner = rng.integers(1, 1 << 60, 60).astype(np.uint64)
    texts = [np.concatenate([rng.integers(1, 1 << 60, k).astype(np.uint64), inner, rng.integers(1, 1 << 60, 9).astype(np.uint64)]) for k in (0, 5, 17)]
    names = [set(substring_dedup.recompress(t, np.array([0, len(t)]))[0].tolist()) for t in texts]
    assert names[0] & names[1] & names[2]


def test_substrings_awkward(awkward, nothing):
    got = [r for r in substring_dedup.repeats(awkward).collect()]
    assert [(r.doc_id, r.start_word, r.end_word) for r in got] == [(4, 0, 100_000)]
    assert substring_dedup.repeats(nothing).count() == 0


# --- licence scan --------------------------------------------------------------------------------------------------


def test_license_spans(docs):
    t = license_scan.TEMPLATES
    body = t["gpl-3.0-notice"]
    rows = [(1, f"before it\n{body}\nafter"), (2, body.upper()), (3, body.replace("General ", "")), (4, "licensed under a tree"), (5, f"{body} {body}"), (6, t["mit-permission"] + " and so on"), (7, body[:30])]
    got = defaultdict(list)
    for r in license_scan.scan(docs(rows)).collect():
        got[r.doc_id].append((r.license, r.start_word, r.end_word))
    assert got[1] == [("gpl-3.0-notice", 2, 14)] and got[2] == [("gpl-3.0-notice", 0, 12)]
    assert got[3][0][0] == "gpl-3.0-notice" and sorted(s for _, s, _ in got[5]) == [0, 12]
    assert got[6][0][:2] == ("mit-permission", 0) and 4 not in got and 7 not in got


def test_license_awkward(awkward, nothing):
    assert license_scan.scan(awkward).count() == 0 and license_scan.scan(nothing).count() == 0
    assert set(CLASHES) & set(awkward.columns)
    notice = license_scan.TEMPLATES["mit-notice"]
    twice = awkward.withColumn("text", F.lit(notice))
    assert {r.doc_id for r in license_scan.scan(twice).collect()} == {1, 2, 3, 4, 5, 6, 7, 8, None}
