"""Round 4: choice fits read an event's features from its own lists."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import models as M
from matchloom.plans import models as P
from matchloom.sources.projection import Views

SF = "/root/testdata/sf0.001"


def test_a_fit_and_its_scores_from_lists(spark):
    """features of all events were shuffled twice, and each step read thirteen bytes of a feature."""
    v = Views(spark, SF)
    accepted, train, test = P._choice_split(v)
    assert train.count() + test.count() == accepted.count() and test.count() > 0
    keys, w = M.fit_lists(train, 5)
    x = [(r["chosen"], {o["option"]: {f["key"]: f["value"] for f in o["f"]} for o in r["x"]}) for r in train.collect()]
    want = dict.fromkeys(sorted({k for _, e in x for f in e.values() for k in f}), 0.0)
    assert keys == list(want)
    chances = lambda e: (lambda u: u / u.sum())(np.exp([sum(want[k] * y for k, y in e[o].items()) for o in range(3)]))
    for step in range(5):
        g = dict.fromkeys(want, 0.0)
        for c, e in x:
            p = chances(e)
            for o, f in e.items():
                for k, y in f.items():
                    g[k] += ((o == c) - p[o]) * y
        want = {k: a + 0.25 / (1 + step / 100) ** 0.5 * (g[k] / len(x) - 0.05 * a) for k, a in want.items()}
    assert dict(zip(keys, w.tolist(), strict=True)) == pytest.approx(want, abs=1e-9)
    got = sorted(r["p"] for r in M.list_scores(test, keys, w).collect())
    held = [(r["chosen"], {o["option"]: {f["key"]: f["value"] for f in o["f"] if f["key"] in want} for o in r["x"]}) for r in test.collect()]
    assert got == pytest.approx(sorted(chances(e)[c] for c, e in held), abs=1e-9)
    # a block's bytes for each feature: its place, and a few values
    blocks = train.select("chosen", "x").mapInArrow(M._blocks_task(keys), ", ".join(f"{c} binary" for c in M._BLOCK))
    n = train.select(F.explode("x").alias("x")).select(F.sum(F.size("x.f"))).first()[0]
    assert blocks.select(F.sum(F.length("sizes") + F.length("i") + F.length("other") + F.length("value"))).first()[0] < 8 * n


def test_events_without_features_count(spark):
    f = spark.createDataFrame([(1, 2, "a", 2.0)], "event_id long, option int, key string, value double")
    c = spark.createDataFrame([(1, 2), (2, 0)], "event_id long, chosen int")
    assert [tuple(r) for r in M.choice_fit(f, c, 1).collect()] == [("a", pytest.approx(0.25 * (2 / 3) * 2 / 2))]
