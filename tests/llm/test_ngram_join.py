import random

import pytest
from test_minhash import brute, varied

from shutterlake.llm import ngram_join
from shutterlake.llm.ngram_join import alike


def compared(spark, rows, percent, words):
    got = alike(spark.createDataFrame(rows, "doc_id long, text string"), percent, words)
    assert sorted(tuple(r) for r in got.collect()) == sorted(r[:3] for r in brute(rows, percent, words))


def boilerplate(seed, many=50):
    """Documents that are mostly one passage, too unlike to link, and copies of some."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    passage, rows = [word() for _ in range(120)], []
    for _ in range(many):
        own = [word() for _ in range(rng.choice([20, 40]))]
        rows.append(" ".join(passage + own))
        if rng.random() < 0.3:
            own[3] = word()
            rows.append(" ".join(passage + own))
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("percent,words,hot", [(90, 3, 12), (80, 5, 12), (100, 2, 3)])
def test_equals_all_pairs(spark, percent, words, hot, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    rows = varied(percent, groups=14) + [(1, None), (2, ""), (3, " \n"), (4, "One two"), (900, "one TWO"), (901, "one two three")]
    compared(spark, rows, percent, words)


@pytest.mark.parametrize("at_most,block,hot", [(8, 30, 6), (2, 1000, 1000)])
def test_long_columns_in_blocks(spark, at_most, block, hot, monkeypatch):
    for name, value in (("HOT", hot), ("LIST", at_most), ("ROWS", block), ("CELLS", 40 * block)):
        monkeypatch.setattr(ngram_join, name, value)
    compared(spark, varied(at_most + 40), 90, 3)


@pytest.mark.parametrize("hot,at_most", [(4, 4), (32, 32), (1, 2)])
def test_documents_made_of_one_passage(spark, hot, at_most, monkeypatch):
    monkeypatch.setattr(ngram_join, "HOT", hot)
    monkeypatch.setattr(ngram_join, "LIST", at_most)
    monkeypatch.setattr(ngram_join, "ROWS", 16)
    compared(spark, boilerplate(hot), 90, 3)


def test_long_texts_link(spark):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}" for _ in range(150_000)]
    near, far = list(words), list(words)
    for k in range(0, len(near), 100):
        near[k] = "x"
    for k in range(0, len(far), 20):
        far[k] = "y"
    got = alike(spark.createDataFrame([(5, " ".join(words)), (6, " ".join(near)), (7, " ".join(far))], "doc_id long, text string"), 90, 3)
    assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(5, 5), (6, 5), (7, 7)]


def test_ids_repeated_or_absent_and_other_columns(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 1), (5, "x y z", 2), (7, "x y z", 3), (None, "x y z", 4), (9, "q", 5), (7, None, 6)]
    got = alike(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), 90, 3)
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id or -1) for r in got.collect()) == [(-1, 1, -1), (5, 1, 5), (7, 0, 5), (7, 1, 5), (7, 4, 5), (7, 4, 5), (9, 1, 9)]


def test_empty_table(spark):
    assert alike(spark.createDataFrame([], "doc_id long, text string")).collect() == []
