"""What growth showed: sorts and joins of a task that grow with the input, rows that are formed again for every match."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from matchloom import session as S
from matchloom.operators import features as E
from matchloom.operators import scoring as R
from matchloom.operators import validate as V
from matchloom.sources.projection import Views

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def v(spark):
    return Views(spark, SF)


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_task_sorts_a_part_of_fixed_size(v, monkeypatch):
    few = S.spread(v.slots, v.slots, "match_id").rdd.getNumPartitions()
    monkeypatch.setattr(S, "TASK_BYTES", 1000)
    many = S.spread(v.slots, v.slots, "match_id")
    assert many.rdd.getNumPartitions() > 10 * few and many.count() == v.slots.count()


def test_a_set_of_heroes_is_formed_once(spark):
    """Three pools, two of them with the same heroes."""
    pool = spark.createDataFrame([(p, h) for p, hs in ((1, "ABC"), (2, "CABB"), (3, "AB")) for h in hs], "pool_id long, hero string")
    seen = []
    form = lambda p: seen.append(p.select("pool_id").distinct().count()) or p.groupBy("pool_id").agg(F.count("hero").alias("n"))
    assert sorted(map(tuple, R.by_set(pool, form).collect())) == [(1, 3), (2, 3), (3, 2)] and seen == [2]


def test_plan_warnings_come_from_one_shuffle(v):
    assert _plan(V.plan_warnings(v.raw_members)).count("Exchange") == 1


def test_odd_plans(spark):
    """A skill twice in a slot counts once, a slot without skills has no warning, both warnings may be about one skill."""
    rows = [(1, 1, 1, "SIG", "a", "a"), (1, 1, 2, "SIG", "SIG", "a"), (1, 1, 3, "X", "SIG", None), (1, 2, 1, "Y", None, None), (1, 2, 2, "Y", "b", "b")]
    t = V.plan_warnings(spark.createDataFrame(rows, "match_id long, side int, slot int, s0 string, s1 string, s2 string"))
    assert sorted((r["warning"], r["side"], r["skill"], r["members"]) for r in t.collect()) == [("own_signature", 1, "SIG", 1), ("repeated_skill", 1, "SIG", 2), ("repeated_skill", 1, "a", 2)]


def test_an_aged_table_has_few_ranges_and_files(spark):
    """However large its ids; rows that come in no order don't cost a file for each task and range."""
    import uuid

    from matchloom.sources.stored import RANGES, AgedTable, range_width

    last = 10**8 - 1
    rows = spark.range(0, 10**8, 10**5).selectExpr("id", "timestamp_seconds(id) AS at").repartition(8)
    t = AgedTable(spark, f"{S.shared_dir(spark)}/aged-{uuid.uuid4().hex}", "id bigint, at timestamp", "id", "at", width=range_width(last))
    t.load(rows)
    assert len(t.version()["folders"]) <= RANGES and t.read().count() == 1000
    assert len(t.read().inputFiles()) < 2 * RANGES
    t.used_up_to(last)
    assert t.purge(last, "2100-01-01", 7) == 7 and t.read().agg(F.min("id")).first()[0] == 7 * 10**5


def test_counts_and_differences_come_from_lists(v):
    """Weights and supports take one shuffle of sums, differences none; both are those of the long rows."""
    counts, d = E.feature_counts(v.lists), E.list_differences(v.lists)
    assert _plan(counts).count("Exchange") == 1 and _plan(d).count("Exchange") == 0
    assert counts.select("family", "key", "support").exceptAll(E.support(v.features)).count() == 0 < counts.count()
    assert d.exceptAll(E.paired_difference(v.features)).count() == 0 == E.paired_difference(v.features).exceptAll(d).count()
