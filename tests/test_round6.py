"""What the third round's findings showed."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import features as E
from matchloom.operators import models as M
from matchloom.sources.projection import Views
from matchloom.streaming import folds as Z


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_of_events_are_never_sent(spark, tmp_path):
    """Compressed files make many rows of features look small enough for a broadcast; weights are what is sent."""
    rows = spark.range(2000).select(F.col("id").alias("event_id"), F.explode(F.array(*[F.lit(o) for o in range(3)])).alias("option"), F.lit("score").alias("key"), F.lit(1.0).alias("value"))
    rows.write.parquet(f"{tmp_path}/features")
    f = spark.read.parquet(f"{tmp_path}/features")
    chosen = f.select("event_id", F.lit(0).alias("chosen")).distinct()
    weights = f.groupBy("key").agg(F.sum("value").alias("weight"))
    state = spark.createDataFrame([("score", 1.0, 2.0)], "key string, z double, n double")
    for df in (*Z.ftrl_step(state, f, chosen), M.explain_choice(f, weights), M.choice_scores(f, chosen, weights)):
        assert "BuildLeft" not in _plan(df)


def test_lists_come_straight_from_slots(spark):
    """Weights need no written members; the rows are those of the members' features."""
    v = Views(spark, "/root/testdata/sf0.001")
    got = sorted(map(tuple, v.features.select("match_id", "side", "won", "family", "key").collect()))
    assert "members" not in vars(v)
    assert got == sorted(map(tuple, E.team_features(v.members, v.carried).select("match_id", "side", "won", "family", "key").collect())) and got
