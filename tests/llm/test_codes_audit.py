import hashlib
import random
import re
from itertools import permutations

import numpy as np
import pytest

from shutterlake.llm import audit, codes

VECTOR = "vec_id long, embedding array<float>, label int"


def plain_codes(rows, entries=256):
    """Lloyd over all vectors, one after the other, in Python's integers."""
    usable = [(i, v, b) for i, v, b in rows if v is not None and all(x is not None and abs(x) < float("inf") for x in v)]
    width = max(1, -(-max((len(v) for _, v, _ in usable), default=0) // 4))
    own = []
    for i, v, b in usable:
        q = [int(np.floor(float(np.float32(x)) * 1024)) for x in v]
        q += [0] * (4 * width - len(q))
        own.append((i, b, [q[p * width : p * width + width] for p in range(4)]))
    start = sorted((i, sum(q, []), q) for i, _, q in own if i is not None)[:entries]
    books = [[list(q[p]) for _, _, q in start] for p in range(4)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda part, book: min((far(part, c), k) for k, c in enumerate(book))
    for _ in range(4):
        for p, book in enumerate(books):
            got = [near(q[p], book)[1] for _, _, q in own]
            for k in range(len(book)):
                if mine := [q[p] for (_, _, q), g in zip(own, got, strict=True) if g == k]:
                    book[k] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    out = []
    for i, b, q in own:
        best = [near(q[p], books[p]) for p in range(4)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), b))
    sums = {b: sum(e for _, _, e, c in out if c == b) for b in {b for *_, b in out}}
    return sorted(((i, c, e, sums[b], digest) for i, c, e, b in out), key=str)


def got_codes(spark, rows):
    return sorted((tuple(r) for r in codes.compressed(spark.createDataFrame(rows, VECTOR)).collect()), key=str)


@pytest.mark.parametrize("width,spread", [(8, 0.02), (16, 1.0), (4, 3.0)])
def test_codes_equal_plain_lloyd(spark, width, spread):
    rng = random.Random(width)
    rows = [(i * 3, [rng.gauss(0, spread) for _ in range(width)], rng.choice([0, 1, None])) for i in range(420)]
    rows += [(2000 + i, rows[7][1], 1) for i in range(150)] + [(3000 + i, [round(x, 1) for x in rows[i][1]], 2) for i in range(60)]
    rng.shuffle(rows)
    assert got_codes(spark, rows) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    rows = [(5, [0.5, -0.5, 0.25, 1.0, 2.0], None), (5, [0.5, -0.5, 0.25, 1.0, 2.0], None), (None, [1.0] * 8, 3), (1, None, 3), (2, [float("nan")] * 8, 3), (3, [float("inf")] * 8, 3), (4, [1.0, None], 3), (9, [], None), (8, [3e5, -3e5], 4)]
    assert got_codes(spark, rows) == plain_codes(rows)
    huge = got_codes(spark, [(1, [1e30, 0.0, 0.0, 0.0], 0), (2, [-1e30, 0.0, 0.0, 0.0], 0), (None, [0.0] * 4, 0)])
    assert [r[0] for r in huge] == [1, 2, None] and huge[2][2] == codes.LONGEST


def test_codes_without_rows_or_ids_and_clashing_columns(spark):
    assert got_codes(spark, []) == []
    assert [r[:4] for r in got_codes(spark, [(None, [1.0, 0.0, 0.0, 0.0], 1)])] == [(None, "00000000", 1024**2, 1024**2)]
    df = spark.createDataFrame([(1, [1.0] * 4, 0, "x", "y")], VECTOR + ", code string, row string")
    assert [r.code for r in codes.compressed(df).collect()] == ["00000000"]


def plain_audit(docs, labels):
    words = lambda t: re.findall(r"[^\x20\x09-\x0d]+", t)
    rows = []
    for i, text, source in docs:
        t = text or ""
        w = words(t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), bool(re.search(r"[#$%&*|]", t)), i is not None and any(j is not None and j < i and (u or "") == t for j, u, _ in docs)), strict=True) if bad}
        mark = lambda k: any(x[0] == i and i is not None and x[k] == 1 for x in labels)  # noqa: B023, E731
        rows.append((source or "", fails, mark(1), mark(2)))
    out, sums = {}, {}
    for part in {r[0] for r in rows}:
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            for step, f in enumerate(order, 1):
                out_ = [r for r in left if f in r[1]]
                own = [r for r in rows if r[0] == part and f in r[1]]
                left = [r for r in left if f not in r[1]]
                out[part, "".join(order), step] = [len(left), len(out_), len(own) - len(out_), sum(r[1] == {f} for r in own), sum(r[2] for r in out_), sum(r[3] for r in out_)]
                sums[part, f] = sums.get((part, f), 0) + len(out_)
    return {(*k, *v, sums[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def got_audit(spark, docs, labels, more=""):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string" + more)
    return [tuple(r) for r in audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()]


def test_audit_equals_plain_filters(spark):
    rng = random.Random(5)
    docs, labels = [], []
    for i in range(160):
        n = rng.choice([0, 3, 150, 250])
        pool = [f"w{k}" for k in range(rng.choice([20, 4000]))]
        text = "\t".join(rng.choice(pool) for _ in range(n)) + rng.choice(["", " # ", " AAAAAAAAAAAAAAAAAAAAAAAAAAAA ", "é\U0001f600 x"])
        docs.append((i, rng.choice([text, text, None]), rng.choice(["s", "t", None, ""])))
        labels.append((i, rng.choice([0, 1, None]), rng.choice([0, 1, None])))
    docs += [(500 + i, docs[rng.randrange(40)][1], "copies") for i in range(40)] + [(None, docs[3][1], "s"), (7, docs[7][1], "t"), (7, "AB", "s")]
    labels += [(3, 1, 1), (3, 0, 0), (None, 1, 1), (9999, 1, 1)]
    got = got_audit(spark, docs, labels)
    assert len(got) == 600 * 4 and set(got) == plain_audit(docs, labels)


def test_audit_long_text_other_columns_and_empty_tables(spark):
    long = " ".join(f"word{k}" for k in range(200_000)) + "|"
    got = got_audit(spark, [(1, long, "s", 1), (2, long, "s", 2), (3, "", "s", 3)], [], ", kept int")
    assert {(r[3], r[4]) for r in got if r[1] == "DEABC" and r[2] == 1} == {(1, 2)}
    assert {r[9] for r in got if r[1][r[2] - 1] == "E"} == {60} and {r[6] for r in got if r[1][r[2] - 1] == "A"} == {1}
    assert got_audit(spark, [], []) == []
