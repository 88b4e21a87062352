import os
import random
from pathlib import Path

import pytest

pytest.importorskip("public_tokenizers")

import corpus_pipeline  # noqa: E402
from shutterlake.llm import secrets, toxicity  # noqa: E402
from shutterlake.llm.queries import THRESHOLD, tokenizer_path  # noqa: E402
from tests.llm.test_minhash import brute  # noqa: E402


def test_equals_the_stages_in_plain_python(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(6)
    rows, labels = [], []
    for i in range(240):
        words = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(rng.randint(6, 90))]
        toxic = int(rng.random() < 0.3)
        if toxic:
            words[0] = "nasty"
        if i % 9 == 0:
            words.append("password=abcdef123456")
        text = " ".join(words)
        if i % 11 == 0 and rows:
            text, toxic = rows[-1][1], labels[-1][2]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        labels.append((i, 1, toxic))
    rows += [(500, None, "en", None, 0), (501, "", "en", "s1", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")

    from shutterlake.llm.common import crc_fold

    lexicon = toxicity.train(docs, labels, crc_fold("doc_id", 4) != 2)
    kept = [(i, t) for i, t, *_ in rows if lexicon.score(t) < THRESHOLD]
    assert 120 < len(kept) < 230
    first = {i for i, _, _, keep in brute(kept, 80) if keep}
    scanner, tokenizer = secrets.Scanner(), Tokenizer.from_file(tokenizer_path())
    want = {}
    for i, t in kept:
        if i in first:
            for a, k, b in sorted(secrets.find(t, scanner)[1], reverse=True):
                t = f"{t[:a]}[{secrets.KINDS[k]}]{t[b:]}"
            want[i] = len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1
    got = {}
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert r.doc_tokens == want[r.doc_id]
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want
    assert corpus_pipeline.STAGES[3][1](spark, docs, str(tmp_path)).columns == docs.columns


def test_packing_follows_the_mix(spark, tmp_path, monkeypatch):
    rng = random.Random(8)
    rows = []
    for i in range(600):  # the hot source has five of six documents and, by the square root, about sqrt(5) of sqrt(5) + 1 shares
        text = " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(rng.randint(40, 200)))
        rows.append((i, text, "en", "cold" if i >= 500 else "hot", len(text)))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(600)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")

    def tokens():
        found = corpus_pipeline.run(spark, str(tmp_path)).collect()
        last = max(r.sequence_id for r in found)
        early = [r for r in found if r.sequence_id < last // 3]
        return {(r.doc_id, r.start, r.sequence_id, r.offset) for r in found}, sum(r.length for r in early if r.doc_id >= 500) / sum(r.length for r in early)

    mixed, cold = tokens()
    assert abs(cold - 1 / (5**0.5 + 1)) < 0.1  # dealt by hash, it would be 1 / 6
    stages = [(n, (lambda spark, docs, sf_dir: docs) if n == "mixing" else f) for n, f in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    plain, _ = tokens()
    assert plain != mixed


def test_an_empty_table_and_repeated_ids(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = "one two three four five six seven eight nine ten"
    rows = [(2, words, "en", "a", 1), (2, words, "en", "b", 1), (2, "a text that has nothing in common with the other one", "en", "a", 1), (1, words, "de", "a", 1), (None, words, "en", "a", 1), (None, words, "en", "a", 1), (3, None, "en", None, 1), (3, None, "en", None, 1), (2**53 + 1, "", "en", "a", 1)]
    docs = spark.createDataFrame(rows, schema).coalesce(1)
    for _ in range(2):
        kept = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
        assert sorted((r.doc_id or -1, r.lang, r.text or "") for r in kept) == sorted([(2, "en", rows[2][1]), (1, "de", words), (-1, "en", words), (-1, "en", words), (3, "en", ""), (2**53 + 1, "en", "")])
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_repeated_labelled_rows_are_learned_once_and_the_same_way(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(90)) for _ in range(12)) + (" vile" if i % 3 == 0 else "")) for i in range(300)]
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)] + [(0, 1), (1, None), (2, 1)], "doc_id long, toxic int")
    from pyspark.sql import functions as F

    once = spark.createDataFrame(rows, "doc_id long, text string")
    often = spark.createDataFrame([rows[0]] * 500 + rows[::-1], "doc_id long, text string").repartition(5)
    one, two = (toxicity.train(d, labels, F.lit(True)) for d in (once, often))
    assert (one.terms, one.exceptions, one.curve) == (two.terms, two.exceptions, two.curve) and " vile " in one.terms or " vile" in one.terms


HELD = """
import re
from pathlib import Path
import pyarrow as pa
from shutterlake.llm.common import by_batch

def mb():
    return sum(map(int, re.findall(r"\\nPss_Anon:\\s+(\\d+)", Path("/proc/self/smaps_rollup").read_text()))) / 1024

stays, at_work = [], []

def build():
    cache = {}
    def work(batch):
        cache.update((i, bytes(600)) for i in range(200_000))
        stays.append(bytes(1000))  # lies behind the cache
        at_work.append(mb())
        return {"x": batch.column("x")}
    return work

one = pa.RecordBatch.from_pydict({"x": [1]})
before = mb()
assert len(list(by_batch(build, {"x": pa.int64()})([one]))) == 1
print(at_work[0] - before, mb() - before)
"""


def test_an_idle_worker_holds_no_cache():
    import subprocess
    import sys

    if not os.path.exists("/proc/self/smaps_rollup"):
        pytest.skip("memory can't be read here")
    out = subprocess.run([sys.executable, "-c", HELD], capture_output=True, text=True, check=True, cwd=Path(__file__).parents[2]).stdout
    at_work, after = map(float, out.split())
    assert at_work > 120 and after < 30
