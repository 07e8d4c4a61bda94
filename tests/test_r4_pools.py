"""Round 4: trios of large pools, of all their heroes."""

from __future__ import annotations

from collections import defaultdict
from itertools import combinations

import pytest

from matchloom.operators import scoring as R
from matchloom.plans import registry
from matchloom.sources.projection import Views

SF = "/root/testdata/sf0.001"


def test_trios_of_all_heroes_of_a_large_pool(spark):
    """only the first fifteen heroes of a pool had trios."""
    v = Views(spark, SF)
    pools = defaultdict(set)
    for r in v.members.collect():
        pools[r["match_id"] // 8].add(r["hero"])
    assert max(map(len, pools.values())) > 15
    weight = {(r["family"], r["key"]): r["weight"] for r in v.weights.collect()}
    strength = lambda h: round(sum(weight.get(("H", x), 0) for x in h) + sum(weight.get(("HP", f"{x}|{y}"), 0) for x, y in combinations(h, 2)), 6)
    got = {r["pool_id"]: (r["trios"], r["best"], r["strength"]) for r in registry.queries()["r10_large_pools"](spark, SF).collect()}
    want = {p: sorted((-strength(t), t) for t in combinations(sorted(h), 3)) for p, h in pools.items() if len(h) > 2}
    assert got == {p: (len(t), ",".join(t[0][1]), pytest.approx(-t[0][0], abs=2e-6)) for p, t in want.items()}


def test_pools_of_many_heroes(spark):
    heroes = [f"h{i:02}" for i in range(70)]
    pool = spark.createDataFrame([(1, h) for h in heroes] + [(2, "h00"), (2, "h01")], "pool_id long, hero string")
    w = spark.createDataFrame([("H", "h69", 0.5, 9), ("H", "h68", 0.25, 9), ("HP", "h66|h69", 0.125, 9)], "family string, key string, weight double, support long")
    assert [tuple(r) for r in R.large_pool_trios(R.pool_weights(pool, w)).collect()] == [(1, 70 * 69 * 68 // 6, "h66,h68,h69", 0.875)]
