import random

import pytest

from shutterlake.llm import suffixes, topk


def brute_top(rows, k, every):
    import math

    kept = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            q = [math.floor(64 * x) for x in v]
            kept[i] = min(kept.get(i, q), q)
    out = set()
    for i, a in kept.items():
        if i % every == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), j) for j, b in kept.items() if j != i)
            out |= {(i, n, j, -s) for n, (s, j) in enumerate(scored[:k], 1)}
    return out


@pytest.mark.parametrize("blocks", [(7, 3), (8192, 2048)])
def test_top_k_equals_brute_force(spark, monkeypatch, blocks):
    monkeypatch.setattr(topk, "CANDIDATES", blocks[0])
    monkeypatch.setattr(topk, "QUERIES", blocks[1])
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.5, rng.gauss(0, 1)]) for _ in range(6)]) for i in range(60)]
    rows += [(60, None), (62, [None] * 6), (64, [float("nan")] * 6), (66, [float("inf")] * 6), (68, [0.0] * 6), (70, []), (72, [1.0]), (None, [1.0] * 6), (10, [9.0] * 6), (5, rows[5][1]), (80, [1e12] * 6)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, rank int")
    got = topk.top_k(docs, 5, 2).collect()
    assert {tuple(r) for r in got} == brute_top(rows, 5, 2) and len(got) == len(set(got))


def test_threshold_stops_early():
    import numpy as np

    lists = topk.Lists(np.arange(5000), np.column_stack([np.arange(5000.0), np.arange(5000.0) % 7]))
    (best,) = lists.top(np.array([-1]), np.array([[3.0, 0.1]]), 3)
    assert best[0][1] == 4999 and lists.read[0] < 100 and lists.met[0] < 300


def test_threshold_meets_each_candidate_once():
    import numpy as np

    rng = np.random.default_rng(2)
    x = np.floor(64 * rng.normal(size=(3000, 32)))
    lists = topk.Lists(np.arange(3000) * 3, x)
    queries = np.arange(0, 3000, 150)
    found = lists.top(queries * 3, x[queries], 7)
    for r, own in zip(queries, found, strict=True):
        scores = x @ x[r]
        want = sorted((-scores[i], 3 * i) for i in range(3000) if i != r)[:7]
        assert own == [(-s, i) for s, i in want]
    assert (lists.met <= 3000).all()
    assert lists.top(np.array([3]), np.zeros((1, 32)), 2) == [[(0, 0), (0, 6)]]


def test_top_k_of_an_empty_table(spark):
    assert topk.top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).collect() == []


def brute_passages(rows, length):
    at = {}
    for d, t in rows:
        words = t.encode().lower().split() if t else []
        for s in range(len(words) - length + 1):
            at.setdefault(tuple(words[s : s + length]), set()).add((d, s))
    links = {}
    for places in at.values():
        holders = {d for d, _ in places}
        if len(holders) > 1:
            for d, s in places:
                links.setdefault(d, set()).add((s, max(holders) if d == min(holders) else min(holders)))
    out = set()
    for d, found in links.items():
        starts = sorted({s for s, _ in found})
        while starts:
            n = next((i for i in range(1, len(starts)) if starts[i] > starts[i - 1] + length), len(starts))
            out |= {(d, starts[0], starts[n - 1] + length, o) for s, o in found if starts[0] <= s <= starts[n - 1]}
            starts = starts[n:]
    return out


@pytest.mark.parametrize(("seed", "hot"), [(1, 500), (2, 4), (3, 2), (4, 0)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(seed)
    words = lambda n: [rng.choice("abcdefghijkLMNOP") * rng.randint(1, 3) for _ in range(n)]
    shared = [words(n) for n in (49, 50, 51, 55, 80, 200)]
    rows = []
    for i in range(70):
        text = words(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            a = rng.randint(0, 4)
            text += p[a:] + words(rng.randint(0, 30))
        if i % 6 == 0 and rows:
            text = rows[rng.randrange(len(rows))][1].split()
            for _ in range(rng.randint(0, 2)):
                if text:
                    text[rng.randrange(len(text))] = "edited"
        rows.append((i, " ".join(text)))
    rows += [(200, None), (201, ""), (4, rows[4][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, row int")
    got = [tuple(r) for r in suffixes.repeated_passages(docs).collect()]
    assert set(got) == brute_passages(rows, suffixes.LENGTH) and len(got) == len(set(got))


@pytest.mark.parametrize("hot", [500, 1])
def test_a_merged_stretch_keeps_all_its_links(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(9)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b, c = words(60), words(60), words(60)
    rows = [(5, a + b), (9, b + c), (2, words(30) + a), (1, c + words(40)), (7, words(300_000) + b)]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = {tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_passages(rows, suffixes.LENGTH)
    assert {(5, 0, 120, 2), (5, 0, 120, 9), (9, 0, 120, 1), (9, 0, 120, 5), (7, 300_000, 300_060, 5)} <= got


@pytest.mark.parametrize("hot", [500, 6])
def test_a_common_passage_in_many_surroundings(spark, monkeypatch, hot):
    """Its beginnings stay common down to equal passages; copies of a text are one context."""
    monkeypatch.setattr(suffixes, "HOT", hot)
    rng = random.Random(12)
    words = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    a, b = words(62), words(90)
    rows = [(d, words(rng.randint(0, 45)) + a[: rng.choice([53, 62])] + words(rng.randint(0, 45))) for d in range(40)]
    rows += [(d, b + words(20)) for d in range(40, 44)] + [(d, rows[3][1]) for d in range(50, 90)] + [(91, a + words(3) + a)]
    rows = [(d, " ".join(w)) for d, w in rows]
    got = [tuple(r) for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()]
    assert set(got) == brute_passages(rows, suffixes.LENGTH) and len(got) == len(set(got))


def test_passages_of_an_empty_table(spark):
    assert suffixes.repeated_passages(spark.createDataFrame([], "doc_id long, text string")).collect() == []
