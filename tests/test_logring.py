import random
from collections import deque

from shutterlake.operators import library
from shutterlake.streaming.logring import keep_rings


def test_rings_equal_a_deque_over_batches_and_restarts(spark, tmp_path):
    rng = random.Random(4)
    schema, size = "log string, ts string, seq long, level string, line string", 30
    want, n = {"a": deque(maxlen=size), "b": deque(maxlen=size)}, {"a": 0, "b": 0}
    for batch, many in enumerate((5, 100, 40, 1)):
        rows = [(rng.choice("aab"), f"2024-01-{batch + 1:02d}", k, rng.choice(["out", "err"]), rng.choice(["  ", None, f"line {batch} {k}", f"line {batch} {k}"])) for k in range(many)]
        for log, ts, _, level, line in rows:
            if (line or "").strip():
                n[log] += 1
                want[log].append((log, n[log], ts, level, line))
        rng.shuffle(rows)
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        # each batch is a query of its own, which goes on from the checkpoint
        lines = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        keep_rings(lines, str(tmp_path / "rings"), str(tmp_path / "check"), size).awaitTermination(90)
        got = spark.read.parquet(str(tmp_path / "rings"))
        rows = sorted((r.log, r.id, r.ts, r.level, r.line) for r in got.collect())
        assert rows == sorted(x for ring in want.values() for x in ring)
    tail = library.log_tail(got.where("log = 'a'"), n["a"] - 3)
    assert sorted(r.id for r in tail.collect()) == [n["a"] - 2, n["a"] - 1, n["a"]]
