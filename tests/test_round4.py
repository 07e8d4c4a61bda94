"""What a larger input showed: joins that were sent through the driver, arrivals that were cut into several micro-batches."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchloom.operators import features as E
from matchloom.operators import models as M
from matchloom.operators.near import matchup_replacements, skill_replacements
from matchloom.sources.projection import Views
from matchloom.streaming import folds as Z

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def _sent(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange")


def test_near_duplicates_are_joined_by_shuffles(v):
    assert _sent(matchup_replacements(v.reports)) == 0
    assert _sent(skill_replacements(v.reports.withColumnRenamed("id", "match_id"))) == 0


def test_choice_features_are_joined_by_shuffles(v):
    assert _sent(v.pool) == 0 and _sent(v.accepted) == 0
    f = E.option_features(v.accepted, v.offers, v.pool)
    assert _sent(f) == 0
    chosen = v.events.select("event_id", "chosen")
    w = v.spark.createDataFrame([("score", 1.0)], "key string, weight double")
    assert _sent(M.choice_scores(f, chosen, F.broadcast(w))) == 1


def test_an_arrival_is_a_micro_batch(spark, monkeypatch):
    """Also when it has several files, or fewer than others have, and after a second landing in the folder."""
    monkeypatch.setattr(Z, "FILE_ROWS", 100, raising=False)
    rows = spark.range(2000).select("id", F.timestamp_seconds(F.col("id") + 1000).alias("at")).repartition(7)
    path = Z.landing(rows, "at", 4)
    Z.landing(spark.range(2000, 2003).select("id", F.timestamp_seconds(F.col("id") + 1000).alias("at")), "at", 1, path)
    spans = []
    Z.drain(Z.read(spark, path), lambda df, n: spans.append(tuple(df.agg(F.min("id"), F.max("id"), F.count("id")).first())))
    assert len(spans) == 5 and sum(n for *_, n in spans) == 2003
    assert all(high - low + 1 == n for low, high, n in spans) and spans == sorted(spans)
    late = Z.read(spark, path).withWatermark("at", "0 seconds").dropDuplicates(["id", "at"])
    assert Z.collect_stream(late).count() == 2003


def test_odd_choice_events(spark):
    """A repeated event, one without offers, an option of its own number, a repeated offer and pool row; features come once."""
    events = spark.createDataFrame([(1, 1, 0.0, 1.0, 2.0), (1, 1, 0.0, 1.0, 2.0), (2, 4, 1.0, 1.0, 1.0)], "event_id long, round int, score0 double, score1 double, score2 double")
    offers = spark.createDataFrame([(1, 0, "hero", "A"), (1, 0, "hero", "A"), (1, 3, "hero", "B"), (9, 0, "hero", "A")], "event_id long, option int, round_type string, item string")
    pool = spark.createDataFrame([(1, "hero", "C"), (1, "hero", "C"), (2, "hero", "C")], "event_id long, pool_type string, pool_item string")
    got = sorted((r["event_id"], r["option"], r["key"], r["value"]) for r in E.option_features(events, offers, pool).collect())
    score = lambda e, r, o, x: [(e, o, "score", x), (e, o, f"round_score|{r}", x), (e, o, f"position|{o}", 1.0)]
    want = [y for o, x in enumerate((-0.1, 0.0, 0.1)) for y in score(1, 1, o, x)] + [y for o in range(3) for y in score(2, 4, o, 0.0)]
    want += [(1, o, k, 1.0) for o, i in ((0, "A"), (3, "B")) for k in (f"item|hero|{i}", f"pool_item|hero|C|hero|{i}")]
    assert got == sorted(want)


def test_pairs_of_large_pools_come_in_short_batches():
    """A task holds the pairs of a few pools at a time, not of a batch of thousands."""
    import pyarrow as pa

    from matchloom.operators import scoring as R

    n, heroes = 120, [f"h{i:02}" for i in range(8)]
    weights = lambda size: [[(7 * p + 3 * i) % 11 / 10 for i in range(size)] for p in range(n)]
    pools = pa.record_batch([pa.array(range(n), pa.int64()), pa.array([heroes] * n), pa.array(weights(8), pa.list_(pa.float64())), pa.array(weights(28), pa.list_(pa.float64()))], names=["pool_id", "heroes", "single", "pair"])
    parts = list(R._pairs_task(160)([pools]))
    assert max(b.num_rows for b in parts) <= 160 * 50
    rows = pa.Table.from_batches(parts).to_pylist()
    assert len(rows) == 160 * n and {r["pool_id"] for r in rows} == set(range(n))
    lone = pa.Table.from_batches(list(R._pairs_task(160)([pools.slice(77, 1)]))).to_pylist()
    assert [r for r in rows if r["pool_id"] == 77] == lone
