import itertools
import random

import numpy as np

from sievelight.llm import jaccard_join

from .test_text_operators import gram_set, words


def every_pair(rows, n, t):
    """From the definition, without groups."""
    sets, out = [(i, gram_set(x, n)) for i, x in rows], {}
    for (i, s), (j, u) in itertools.combinations(sets, 2):
        o = len(s & u)
        if i != j and o and o >= t * (len(s) + len(u) - o) - 1e-9:
            key = (min(i, j), max(i, j))
            out[key] = max(out.get(key, 0), round(o / (len(s) + len(u) - o), 6))
    return out


def whole_classes(rows, n=3, t=0.5):
    """{doc_id: (class_id, links)} from every pair."""
    ids, links, root = {i for i, _ in rows if i is not None}, {}, {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in every_pair([r for r in rows if r[0] is not None], n, t):
        for x in (a, b):
            links[x] = links.get(x, 0) + 1
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {i: (find(i), links.get(i, 0)) for i in ids}


def classes_of(df):
    rows = df.collect()
    assert len(rows) == len({r.doc_id for r in rows})
    return {r.doc_id: (r.class_id, r.links) for r in rows}


def family_rows(rng):
    rows = []
    for _ in range(6):
        base = words(rng, rng.randint(20, 50))
        for _ in range(rng.randint(1, 4)):
            w = list(base)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = words(rng, 1)[0]
            rows += [(len(rows) + k, " ".join(w)) for k in range(rng.randint(1, 5))]
    rng.shuffle(rows)
    return rows


def test_every_pair(docs):
    rows = family_rows(random.Random(11))
    want = every_pair(rows, jaccard_join.N, jaccard_join.THRESHOLD)
    got = jaccard_join.join_all(docs(rows)).collect()
    assert len(got) == len(want) and {(r.doc_a, r.doc_b): r.jaccard for r in got} == want
    star = {(r.doc_a, r.doc_b) for r in jaccard_join.join(docs(rows)).collect()}
    assert star < set(want)


def test_the_registered_join_has_each_document_once_and_counts_every_link(spark, docs, tmp_path):
    rows = [*family_rows(random.Random(11)), (1000, ""), (1001, None), (1002, "apart from all of them")]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = classes_of(jaccard_join.op8_jaccard_join(spark, str(tmp_path)))
    assert got == whole_classes(rows) and len(got) == len(rows)


def test_the_registered_join_against_sql(spark, small):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{small}/documents.parquet'")
    want = {i: (c, n) for i, c, n in con.execute(jaccard_join.SQL).fetchall()}
    assert classes_of(jaccard_join.op8_jaccard_join(spark, small)) == want


def test_links_of_documents_of_several_sets(docs):
    rng = random.Random(5)
    a, b, c = (" ".join(words(rng, 30)) for _ in range(3))
    rows = [(3, a), (3, a + " tail"), (7, a), (7, a), (8, b), (8, a + " tail"), (9, ""), (9, None), (None, a), (10, c), (10, ""), (11, c), (12, b + " tail"), (13, b), (13, c), (14, a + " end")]
    assert classes_of(jaccard_join.classes(docs(rows))) == whole_classes(rows)
    for seed in range(3):
        rows = family_rows(random.Random(seed))
        rows += [(rng.choice(rows)[0], rng.choice(rows)[1]) for _ in range(8)]
        assert classes_of(jaccard_join.classes(docs(rows))) == whole_classes(rows)
    assert jaccard_join.classes(docs([])).count() == 0


def test_a_large_family_makes_no_row_of_a_pair(docs, monkeypatch):
    """A family of m near copies: at most a row a copy leaves the tasks, and not m (m - 1) / 2 pairs."""
    from sievelight.llm import common

    rng, seen, plain = random.Random(3), {}, common.table
    base = words(rng, 60)
    rows = [(k, " ".join([*base[:k % 60], *words(rng, 1), *base[k % 60 + 1 :]])) for k in range(150)]

    def counted(df, tag):
        out = plain(df, tag)
        seen[tag] = max(seen.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(common, "table", counted)
    assert classes_of(jaccard_join.classes(docs(rows))) == {k: (0, 149) for k in range(150)}
    assert max(v for k, v in seen.items() if k not in ("jaccard-nodes", "jaccard-often", "jaccard-met")) <= 4 * 150
    assert seen["jaccard-links"] <= 2 * 150


def test_blocks_of_large_regions(docs, monkeypatch):
    """Regions cut into blocks, few sets a leaf and products over parts of the n-grams give the same classes."""
    monkeypatch.setattr(jaccard_join, "REGION_BITS", 300)
    monkeypatch.setattr(jaccard_join, "REGION_SETS", 400)
    monkeypatch.setattr(jaccard_join, "FREQUENT", 1)
    rows = family_rows(random.Random(21))
    assert classes_of(jaccard_join.classes(docs(rows))) == whole_classes(rows)
    assert {(r.doc_a, r.doc_b) for r in jaccard_join.join_all(docs(rows)).collect()} == set(every_pair(rows, 3, 0.5))


def test_region_blocks_by_products_and_by_look_up(monkeypatch):
    rng = random.Random(4)
    sets = []
    for _ in range(4):
        base = rng.sample(range(10_000), 60)
        for _ in range(30):
            sets.append(np.array(sorted({*rng.sample(base, rng.randint(25, 60)), *rng.sample(range(20_000), rng.randint(0, 20))}), np.uint64))
    want = {(i, j): o for i, j in itertools.combinations(range(len(sets)), 2) if (o := len(np.intersect1d(sets[i], sets[j]))) >= 0.5 * (len(sets[i]) + len(sets[j]) - o) - 1e-9}
    for dense, cells in ((64, 1 << 20), (64, 90), (0, 1 << 20)):
        monkeypatch.setattr(jaccard_join, "_DENSE", dense)
        monkeypatch.setattr(jaccard_join, "_CELLS", cells)
        got = jaccard_join.region_join(sets, 0.5)
        assert len(got) == len(want) and {(i, j): o for i, j, o in got} == want


def test_documents_of_several_sets(docs):
    a, b = " ".join(words(random.Random(1), 30)), " ".join(words(random.Random(2), 30))
    rows = [(3, a), (3, a + " tail"), (7, a), (7, a), (8, b), (8, a + " tail"), (9, ""), (9, None)]
    got = jaccard_join.join_all(docs(rows)).collect()
    assert sorted(tuple(r) for r in got) == sorted((*k, v) for k, v in every_pair(rows, 3, 0.5).items())


def test_keep_one_makes_no_row_of_a_pair(docs, monkeypatch):
    from sievelight.llm import common

    rng, seen, plain = random.Random(9), {}, common.table
    base = words(rng, 60)
    rows = [(k, " ".join([*base[: k % 60], *words(rng, 1), *base[k % 60 + 1 :]])) for k in range(150)]

    def counted(df, tag):
        out = plain(df, tag)
        seen[tag] = out.count()
        return out

    monkeypatch.setattr(common, "table", counted)
    assert [r.doc_id for r in jaccard_join.keep_one(docs(rows)).collect()] == [0]
    assert max(v for k, v in seen.items() if k not in ("jaccard-nodes", "jaccard-often", "jaccard-met")) <= 4 * 150
