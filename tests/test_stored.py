"""Stored tables: two runs, a crash between writing and naming, another writer, bounds."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from matchloom.session import shared_dir
from matchloom.sources.stored import AgedTable, Conflict, KeyedStore

SCHEMA = "id bigint, seq int, content string"


def store(spark, root=None):
    return KeyedStore(spark, root or f"{shared_dir(spark)}/keyed-{uuid.uuid4().hex}", SCHEMA, "id", "content", buckets=4)


def state(s):
    return sorted(map(tuple, s.read().collect()))


def test_insert_if_absent(spark):
    s = store(spark)
    assert state(s) == []
    s.insert(spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, "b"), (2, 4, "c")], SCHEMA), "seq", 0)
    assert state(s) == [(1, 1, "a"), (2, 4, "c")]
    before = s.version()
    s.insert(spark.createDataFrame([(1, 5, "a"), (2, 6, "x"), (3, 7, "d"), (3, 8, "d")], SCHEMA), "seq", 1)
    assert state(s) == [(1, 1, "a"), (2, 4, "c"), (3, 7, "d")]
    # only the bucket of the new key has another folder
    after = s.version()
    assert len([k for k in after["folders"] if after["folders"][k] != before["folders"].get(k)]) == 1
    log = sorted((r["id"], r["seq"], r["status"]) for r in s.log().collect())
    assert log == [(1, 1, "accepted"), (1, 2, "duplicate"), (1, 3, "conflict"), (1, 5, "duplicate"), (2, 4, "accepted"), (2, 6, "conflict"), (3, 7, "accepted"), (3, 8, "duplicate")]


def test_batches_again_and_a_crash_give_one_state(spark, monkeypatch):
    batches = [spark.createDataFrame([(i, 100 * k + i, f"{i % 7}") for i in range(20 * k, 20 * k + 30)], SCHEMA) for k in range(3)]
    once = store(spark)
    for k, b in enumerate(batches):
        once.insert(b, "seq", k)
    twice = store(spark)
    for _ in range(2):
        for k, b in enumerate(batches):
            store(spark, twice.root).insert(b, "seq", k)
    crashed = store(spark)
    crashed.insert(batches[0], "seq", 0)
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            crashed.insert(batches[1], "seq", 1)
    assert len(state(crashed)) == 30  # nothing of the crashed batch shows
    for k in (1, 2):
        store(spark, crashed.root).insert(batches[k], "seq", k)
    assert state(once) == state(twice) == state(crashed)
    assert len({tuple(sorted(map(tuple, s.log().collect()))) for s in (once, twice, crashed)}) == 1
    crashed.vacuum()
    assert state(once) == state(crashed)


def test_two_writers(spark):
    s = store(spark)
    old = s.version()
    s.commit(old, {}, {"x": 1})
    with pytest.raises(Conflict):
        s.commit(old, {}, {"x": 2})
    assert s.version()["notes"] == {"x": 1}


def aged(spark, n=1000):
    t = AgedTable(spark, f"{shared_dir(spark)}/aged-{uuid.uuid4().hex}", "id bigint, received_at timestamp, text string", "id", "received_at", width=100)
    t.load(spark.range(n).select("id", F.expr("timestamp'2025-01-01' + make_interval(0, 0, 0, id)").alias("received_at"), F.lit("t").alias("text")))
    return t


def test_purge_is_bounded_guarded_and_local(spark):
    t = aged(spark)
    with pytest.raises(ValueError):
        t.purge(500, "2026-01-01")
    t.used_up_to(500)
    before = t.version()["folders"]
    assert t.purge(500, "2025-09-01", most=150) == 150
    after = t.version()["folders"]
    assert {k for k in before if after.get(k) != before[k]} == {"0", "1"} and "0" not in after
    assert t.read().agg(F.min("id"), F.count("id")).first() == (150, 850)
    with pytest.raises(ValueError):
        t.purge(501, "2026-01-01")
    assert t.purge(500, "2025-09-01") == 93  # 243 days of the year have passed by then
    assert t.purge(500, "2025-09-01") == 0
    assert t.read().count() == 757


def test_a_purge_that_crashes_changes_nothing(spark, monkeypatch):
    t = aged(spark)
    t.used_up_to(900)
    with monkeypatch.context() as m:
        m.setattr(AgedTable, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.purge(900, "2030-01-01")
    assert t.read().count() == 1000
    assert t.purge(900, "2030-01-01") == 901 and t.read().count() == 99
    t.vacuum(keep=1)
    assert t.read().count() == 99
