from collections import Counter

import pytest

from sievelight.llm import mixing


@pytest.mark.parametrize("tiny", [3, 15])
def test_a_tiny_source_does_not_bound_the_others(spark, docs, tmp_path, tiny):
    rows = [(k, f"text {k}", f"s{k % 5}") for k in range(1010)] + [(5000 + k, f"tiny {k}", None) for k in range(tiny)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = mixing.op10_mix_sources(spark, str(tmp_path)).collect()
    assert Counter(r.source for r in got) == {f"s{k}": 202 for k in range(5)} | {None: tiny}
    assert len({r.doc_id for r in got}) == len(got)
    for s in {r.mix_shard for r in got}:
        own = sorted(r.mix_position for r in got if r.mix_shard == s)
        assert own == list(range(len(own)))


def test_a_stated_total_is_met_exactly(docs):
    rows = [(k, f"text {k}", "abc"[min(k // 100, 2)]) for k in range(1000)] + [(2000 + k, f"text {k}", "d") for k in range(5)]
    got = mixing.mix(docs(rows), {"a": 1, "b": 1, "c": 2, "d": 4}, total=305, shard_blocks=4).collect()
    assert Counter(r.source for r in got) == {"a": 75, "b": 75, "c": 150, "d": 5}
    assert len({r.doc_id for r in got}) == 305


def test_water_fill():
    fill = mixing.water_fill
    assert fill({"a": 100, "b": 10}, {"a": 1, "b": 1}, 60) == {"a": 50, "b": 10}
    assert fill({"a": 100, "b": 10}, {"a": 1, "b": 1}, 500) == {"a": 100, "b": 10}
    assert sum(fill({"a": 100, "b": 90, "c": 7}, {"a": 3, "b": 2, "c": 2, "d": 1}, 101).values()) == 101
    assert fill({}, {"a": 1}, 5) == {} and fill({"a": 5}, {"a": 0}, 5) == {}
    assert mixing.fair_total({}, {}) == 0 and mixing.fair_total({"a": 100, "b": 3}, {"a": 10, "b": 3**0.5}) == 103
