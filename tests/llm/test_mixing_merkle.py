import hashlib
import random

import pytest
from pyspark.sql import functions as F

from shutterlake.llm import merkle, mixing


@pytest.mark.parametrize("weights", [[1], [3, 1], [5, 5, 1], [0.5, 0.25, 0.13, 0.07, 0.05], list(range(1, 40))])
def test_less_than_one_block_from_the_share(weights):
    quota = mixing.quotas(weights, 1000)
    assert sum(quota) == 1000 and min(quota) > 0
    done = [0] * len(quota)
    for slot, lane in enumerate(mixing.schedule(quota), 1):
        done[lane] += 1
        assert all(abs(d * 1000 - q * slot) < 1000 for d, q in zip(done, quota, strict=True))


def test_mix_keeps_all_rows_and_follows_the_weights(spark, monkeypatch):
    monkeypatch.setattr(mixing, "PARTS", 4)
    rows = [(i, "abcd"[min(3, i % 7)] if i % 50 else None, "x") for i in range(900)] + [(5, "a", "x")] * 3
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_position string")
    got = mixing.mixed(docs, {"a": 1, "b": 2, "c": 3, "d": 4, None: 1}, block=4).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((d, s or "") for d, s, _ in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    for r in got:
        assert r.mix_position_release <= r.mix_position // 4 < r.mix_position_deadline
    ordered = [r.source for r in sorted(got, key=lambda r: r.mix_position)][:176]
    assert abs(ordered.count("d") - 176 * 4 / 11) < 8
    assert mixing.in_order(docs).columns == docs.columns and mixing.in_order(docs).count() == len(rows)


def test_lanes_are_shared_by_small_sources_and_tables_may_be_empty(spark, monkeypatch):
    monkeypatch.setattr(mixing, "LANES", 3)
    docs = spark.createDataFrame([(i, f"s{i % 9}") for i in range(100)], "doc_id long, source string")
    got = mixing.mixed(docs, block=2).collect()
    assert len({r.mix_position for r in got}) == 100
    assert mixing.mixed(docs.limit(0)).collect() == []


@pytest.mark.parametrize("weights", [None, {"s0": 5, "s1": 5, "s2": 5, "s3": 4, "s4": 2, "s5": 2, "s6": 1, "s7": 1, "s8": 1, None: 3}])
def test_sources_that_share_a_lane_keep_to_their_own_weights(spark, monkeypatch, weights):
    monkeypatch.setattr(mixing, "LANES", 3)
    monkeypatch.setattr(mixing, "PARTS", 2)
    sizes = {f"s{k}": 60 if k < 3 else 40 if k < 6 else 20 for k in range(9)} | {None: 30}
    rows = [(i, s) for s, n in sizes.items() for i in range(n)]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, source string"), weights, block=2).collect()
    assert sorted((r.doc_id, r.source or "") for r in got) == sorted((i, s or "") for i, s in rows)
    assert len({r.mix_position for r in got}) == len(rows)
    assert all(r.mix_position_release <= r.mix_position // 2 < r.mix_position_deadline for r in got)
    own = weights or {s: n**0.5 for s, n in sizes.items()}
    total, pool = sum(own.values()), sum(own[s] for s in list(sizes)[3:])
    last = min(max(r.mix_position for r in got if r.source == s) for s in sizes) // 2
    for s in sizes:
        # the share of all slots, and of those of the lane, within a block each
        slots = sorted({r.mix_position // 2 for r in got if r.source == s})
        bound = 1.1 if s in ("s0", "s1", "s2") else 1 + own[s] / pool + 0.1
        for t in range(1, last + 1):
            assert abs(sum(x < t for x in slots) - t * own[s] / total) < bound, (s, t)


def py_tree(text):
    h = lambda s: hashlib.md5(s.encode()).hexdigest()[:16]
    return [[[h(p[i : i + merkle.BLOCK]) for i in range(0, len(p), merkle.BLOCK)] for p in s.split("\n")] for s in (text or "").split("\n\n")]


def py_fingerprint(t):
    h = lambda parts: hashlib.md5(",".join(parts).encode()).hexdigest()[:16]
    paragraphs = [[h(p) for p in s] for s in t]
    top = hashlib.sha256(",".join(h(s) for s in paragraphs).encode()).hexdigest()
    return "/".join([top, *(f"{h(s)}:{'.'.join(s)}" for s in paragraphs)])


def py_leaves(t):
    return {b for s in t for p in s for b in p} or {""}


def like(a, b):
    a, b = py_leaves(a), py_leaves(b)
    return len(a & b) / len(a | b)


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(merkle, "RANGE_ROWS", 7)
    rng = random.Random(4)
    texts = ["", None, "a", "ab", "𝒳é\n\n\nx\n\n", "line\n" * 40, "word " * 500] + ["".join(rng.choice("ab é\n𝒳") for _ in range(rng.randint(0, 300))) for _ in range(60)]
    rows = [(i * 3 - 50, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in merkle.compared(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, _r int")).collect()}
    assert len(got) == len(rows)
    rows.sort()
    for (d, t), (_, after) in zip(rows, rows[1:] + rows[:1], strict=True):
        t, after = t or "", after or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (py_fingerprint(py_tree(t)), py_fingerprint(py_tree(edited)))
        assert (r.near_edited, r.near_next) == (pytest.approx(like(py_tree(t), py_tree(edited))), pytest.approx(like(py_tree(t), py_tree(after))))


def test_single_row_empty_table_and_repeated_rows(spark):
    docs = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert merkle.compared(docs([])).collect() == []
    (one,) = merkle.compared(docs([(1, "ab")])).collect()
    assert one.edited_sha256 == hashlib.sha256(b"aa").hexdigest() and one.near_next == 1.0
    assert merkle.compared(docs([(1, "ab"), (1, "ab"), (None, "c"), (2, None)])).count() == 4


def test_branches_locate_edits(spark):
    docs = spark.createDataFrame([(1, "a\nb\n\nc\nd"), (2, "a\nb\n\nc\nX\nY")], "doc_id long, text string")
    a, b = (merkle.fingerprints(docs).where(f"doc_id = {k}").select(F.col("paragraphs").alias(f"p{k}")) for k in (1, 2))
    (row,) = a.join(b).select(merkle.differing_paragraphs(F.col("p1"), F.col("p2")).alias("d")).collect()
    assert [tuple(x) for x in row.d] == [(1, 1), (1, 2)]
