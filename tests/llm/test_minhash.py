import random

import pytest

from shutterlake.llm.minhash import near_duplicates


def shingles(text, k=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent, k=5):
    sets = [(i, shingles(t, k)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                parent[y] = x
    return {(i, len(s), root(i), root(i) == i) for i, s in sets}


def varied(seed, groups=12, hot=60):
    rng = random.Random(seed)
    vocabulary = [f"w{n}" for n in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    line, rows = text(9), []
    for g in range(groups):
        words = text(rng.choice([3, 8, 30, 120, 400]))
        for _ in range(hot if g == 0 else rng.randint(1, 6)):
            own = list(words)
            for _ in range(rng.randint(0, 1 + len(own) // 60)):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                own = line + own
            rows.append(" ".join(own))
    rows += [" ".join(line + text(4)) for _ in range(40)]
    rng.shuffle(rows)
    return list(enumerate(rows, 5))


@pytest.mark.parametrize("percent", [85, 80])
def test_equals_all_pairs(spark, percent, monkeypatch):
    from shutterlake.llm import minhash

    monkeypatch.setattr(minhash, "HOT", 12)
    rows = varied(percent) + [(1, None), (2, ""), (3, " \n"), (4, "One two"), (900, "one TWO"), (901, "one two three")]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), percent)
    assert {tuple(r) for r in got.collect()} == brute(rows, percent)


@pytest.mark.parametrize("at_most,block", [(3, 7), (8, 1000)])
def test_long_lists_in_blocks(spark, at_most, block, monkeypatch):
    from shutterlake.llm import minhash

    for name, value in (("HOT", 12), ("LIST", at_most), ("ROWS", block), ("CELLS", 40 * block)):
        monkeypatch.setattr(minhash, name, value)
    rows = varied(at_most)
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 85)
    assert {tuple(r) for r in got.collect()} == brute(rows, 85)


def test_ids_repeated_or_absent_and_other_columns(spark):
    rows = [(7, "a b c d e f", 1), (7, "a b c d e f", 1), (5, "x y z", 2), (7, "x y z", 3), (None, "x y z", 4), (9, "q", 5)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), 85)
    assert sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in got.collect()) == [(-1, -1, False), (5, 5, True), (7, 5, False), (7, 5, False), (7, 5, False), (9, 9, True)]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
