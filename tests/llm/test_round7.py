"""Round 7: what a driver and a worker hold."""

from __future__ import annotations

import tracemalloc
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.llm import op1_quality, op6_bpe


def test_a_model_reaches_the_driver_without_an_object_for_each_row(spark):
    n = 200_000
    row = F.col("id")
    t = spark.range(n).select(
        F.concat(F.lit("xy#"), (row % 2).cast("string")).alias("lang"), (F.floor(row / 2) % 4 + 1).cast("int").alias("k"), (F.floor(row / 8) % 2).cast("int").alias("is_ctx"),
        ((n - row) * 7919 % 1_000_003).alias("key"), (-row / n).cast("float").alias("logp"),
    )
    want = {}
    for r in t.collect():
        want.setdefault((r["lang"], r["k"], r["is_ctx"]), []).append((r["key"], np.float32(r["logp"])))
    op1_quality.pack(t.limit(10))  # imports
    tracemalloc.start()
    got = op1_quality.pack(t)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert set(got) == set(want)
    for x, rows in want.items():
        keys, p = got[x]
        assert list(zip(keys.tolist(), p, strict=True)) == sorted(rows, key=lambda r: r[0])
    assert peak < 30 * n  # 12 bytes a row stay
    assert op1_quality.pack(t.limit(0)) == {}


def test_a_worker_keeps_no_codes_of_an_ended_task():
    words = ["".join(w) for w in product("abcdefgh", repeat=5)]
    batch = pa.record_batch([pa.array([1, 2]), pa.array([" ".join(words), None], pa.string())], names=["doc_id", "text"])
    run = op6_bpe._task(*op6_bpe.default_paths())
    list(run(iter([batch.slice(0, 0)])))  # the vocabulary
    tracemalloc.start()
    before = tracemalloc.get_traced_memory()[0]
    out = [r for b in run(iter([batch])) for r in b.to_pylist()]
    left = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    v = op6_bpe.load(*op6_bpe.default_paths())
    assert [r["n_tokens"] for r in out] == [len(v.encode(" ".join(words))), 0]
    assert left < 2_000_000
