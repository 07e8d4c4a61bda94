"""Round 4: best pairs of skills, an event a row."""

from __future__ import annotations

import random
from itertools import combinations, permutations

import pytest

from matchloom.operators import scoring as R


def test_best_pairs_equal_brute_force_and_are_no_rows(spark):
    """each pair of an event's skills was a row with both skills' routes, shuffled twice."""
    r = random.Random(8)
    names, kinds = [f"K{i}" for i in range(12)], [f"B{i}" for i in range(6)]
    offers, pools = {e: r.sample(names, r.randrange(1, 7)) for e in range(1200)}, {e: r.sample(kinds, r.randrange(0, 5)) for e in range(1200) if e % 7}
    w = {("S", x): r.randrange(-9, 9) / 8 for x in names[1:]}
    w |= {("HS", f"{h}|{x}"): r.randrange(-9, 9) / 8 for h in kinds for x in names if r.random() < 0.8}
    w |= {("SP", f"{h}|{x}|{y}"): r.randrange(-9, 9) / 8 for h in kinds for x, y in combinations(sorted(names), 2) if r.random() < 0.5}
    w["HP", "B0|B1"] = 9.0
    o = spark.createDataFrame([(e, x) for e, xs in offers.items() for x in [*xs, xs[0]]], "event_id long, item string")
    p = spark.createDataFrame([(e, "hero", x) for e, xs in pools.items() for x in xs] + [(3, "skill", "K1")], "event_id long, pool_type string, pool_item string")
    t = R.best_skill_pair(o, p, spark.createDataFrame([(*k, x, 9) for k, x in w.items()], "family string, key string, weight double, support long"))
    want = {}
    for e, xs in offers.items():
        hs, found = pools.get(e, []), []
        for x, y in combinations(sorted(xs), 2):
            same = [w.get(("HS", f"{h}|{x}"), 0) + w.get(("HS", f"{h}|{y}"), 0) + w.get(("SP", f"{h}|{x}|{y}"), 0) for h in hs]
            split = [w.get(("HS", f"{h}|{x}"), 0) + w.get(("HS", f"{g}|{y}"), 0) for h, g in permutations(hs, 2)]
            found.append((-(w.get(("S", x), 0) + w.get(("S", y), 0) + max([0, *same, *split])), x, y))
        if found:
            want[e] = min(found)
    assert {x["event_id"]: (-x["score"], x["a"], x["b"]) for x in t.collect()} == {e: (pytest.approx(s), x, y) for e, (s, x, y) in want.items()}
    assert t._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 0
