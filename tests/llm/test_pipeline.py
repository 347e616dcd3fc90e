import corpus_pipeline
from sievelight.llm import jaccard_join, mixing, nbest

from .test_text_operators import brute_jaccard, brute_lines


def test_stages_against_brute_force(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").cache()
    columns = docs.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "line_dedup", "ngram_jaccard", "mix_sources", "sentencepiece"]
    good = corpus_pipeline.quality_rules(spark, docs, small).cache()
    assert good.columns == columns and 0 < good.count() < docs.count()
    labels = {r.doc_id for r in spark.read.parquet(f"{small}/labels.parquet").where("quality = 1").collect()}
    assert labels <= {r.doc_id for r in good.collect()} | (labels - {r.doc_id for r in docs.collect()})
    lined = corpus_pipeline.dedup_lines(spark, good, small).cache()
    want = {i: t for i, (t, n) in brute_lines([(r.doc_id, r.text) for r in good.collect()]).items() if n == 0 or t.strip()}
    assert lined.columns == columns and {r.doc_id: r.text for r in lined.collect()} == want
    assert all(r.n_chars == len(r.text) for r in lined.collect())
    kept = corpus_pipeline.dedup_near(spark, lined, small).cache()
    pairs, root = brute_jaccard([(r.doc_id, r.text) for r in lined.collect()], jaccard_join.N, jaccard_join.THRESHOLD), {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == {i for i in want if find(i) == i}
    mixed = corpus_pipeline.mix_sources(spark, kept, small).cache()
    counts = {r["source"]: r["count"] for r in kept.groupBy("source").count().collect()}
    weights = {s: n**mixing.TEMPERATURE for s, n in counts.items()}
    quota = mixing.water_fill(counts, weights, mixing.fair_total(counts, weights))
    got = {r["source"]: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert mixed.columns == columns and got == {s: q for s, q in quota.items() if q}
    coded = corpus_pipeline.encode_pieces(spark, mixed, small)
    back = {(r.doc_id, r.text) for r in nbest.decode(coded).collect()}
    assert back == {(r.doc_id, r.text) for r in mixed.collect()}


def test_run(spark, small):
    rows = corpus_pipeline.run(spark, small).collect()
    assert rows and all(r.decoded_ok for r in rows)


def test_stages_on_awkward_and_empty_tables(spark, awkward, nothing):
    """Nulls in any column, empty and very long texts, repeated rows, clashing names; and no rows at all."""
    from pyspark.sql import functions as F

    plain = awkward.drop("row", "h", "c").withColumn("lines_dropped", F.lit(7))
    want = {"quality_rules": {None, 5, 6, 7}, "line_dedup": {None, 1, 2, 3, 4, 5, 6, 7, 8}, "ngram_jaccard": {None, 1, 2, 3, 4, 5, 6, 7, 8}}
    for table in (awkward, plain):
        for name, stage in corpus_pipeline.STAGES:
            got = stage(spark, table, "")
            rows = got.collect()
            if name in want:
                assert want[name] <= {r.doc_id for r in rows} and (name == "quality_rules" or len(rows) == table.count())
            if name != "sentencepiece":
                assert got.columns == table.columns
            assert stage(spark, table.limit(0), "").count() == 0
    docs = nothing
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
    assert docs.count() == 0
