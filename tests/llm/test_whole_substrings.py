import random

import pytest

from sievelight.llm import substring_dedup

from .test_text_operators import brute_repeats, words


@pytest.mark.parametrize("most", [substring_dedup.BROADCAST_SYMBOLS, 0])
def test_repeats_inside_runs_need_no_shared_symbol(docs, monkeypatch, most):
    rng = random.Random(5)
    runs = [["na"] * 70, ["na"] * 90, ["lo"] * 120, ["ab", "cd"] * 40]
    rows = [(k, " ".join(words(rng, 20) + r + words(rng, 20))) for k, r in enumerate(runs)] + [(9, " ".join(words(rng, 90))), (10, " ".join(words(rng, 9)))]
    monkeypatch.setattr(substring_dedup, "BROADCAST_SYMBOLS", most)
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeats(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50) and {i for i, _, _ in got} == {0, 1, 2, 3}


@pytest.mark.parametrize("seed", range(2))
def test_brute_force_by_shuffle_with_runs(docs, monkeypatch, seed):
    rng = random.Random(seed)
    passages = [words(rng, rng.choice([49, 50, 51, 60, 90])) for _ in range(12)] + [["na"] * 70, ["ab", "cd"] * 40]
    rows = []
    for i in range(40):
        w = []
        for _ in range(rng.randint(0, 4)):
            p = rng.choice(passages)
            w += words(rng, rng.randint(0, 30)) + p[rng.randint(0, 3) : len(p) - rng.randint(0, 3)]
        rows.append((i, " ".join(w + words(rng, rng.randint(0, 30)))))
    monkeypatch.setattr(substring_dedup, "BROADCAST_SYMBOLS", 0)
    got = {(r.doc_id, r.start_word, r.end_word) for r in substring_dedup.repeats(docs(rows)).collect()}
    assert got == brute_repeats(rows, 50)
