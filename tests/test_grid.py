"""Fits of many configurations, priors and the staged search, against dense Newton fits in numpy."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from matchloom.operators import grid as B
from matchloom.operators import models as M
from matchloom.plans import models as P
from matchloom.plans import registry
from matchloom.sources.projection import Views

SF = "/root/testdata/sf0.001"


def newton(x, y, c):
    """Minimum of the mean log loss plus |w|^2 / (2 c n), intercept free."""
    n = len(y)
    a = np.hstack([x, np.ones((n, 1))])
    reg = np.append(np.full(x.shape[1], 1 / (c * n)), 0.0)
    w = np.zeros(a.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-a @ w))
        g = a.T @ (p - y) / n + reg * w
        h = (a * (p * (1 - p))[:, None]).T @ a / n + np.diag(reg + 1e-12)
        w = w - np.linalg.solve(h, g)
    return w


def test_many_fits_equal_newton(spark):
    r = np.random.default_rng(2)
    x = r.integers(-1, 2, (300, 12)).astype(float)
    y = (r.random(300) < 1 / (1 + np.exp(-(x[:, 0] - 0.7 * x[:, 1] + 0.3)))).astype(int)
    rows = spark.createDataFrame([(int(b), [i for i in range(12) if a[i]], [float(v) for v in a if v]) for a, b in zip(x, y, strict=True)], "label int, at array<int>, x array<double>").repartition(3)
    masks = [[True] * 12, [i % 2 == 0 for i in range(12)], [True] * 12]
    cs = [0.05, 0.2, 5.0]
    got = B.fit_many(rows, masks, cs, tolerance=1e-9)
    for w, m, c in zip(got, masks, cs, strict=True):
        want = newton(x[:, m], y, c)
        assert w[:-1][np.array(m)] == pytest.approx(want[:-1], abs=1e-5) and w[-1] == pytest.approx(want[-1], abs=1e-5)
        assert not w[:-1][~np.array(m)].any()


def test_sparse_items_get_prior_only_weights(spark):
    w = spark.createDataFrame([("H", "often", 0.5), ("HP", "often|seldom", 0.1)], "family string, key string, weight double")
    counts = spark.createDataFrame([("H", "often", 90, 40.0), ("H", "seldom", 2, 40.0), ("H", "never", 0, 1000.0), ("H", "as_expected", 40, 40.0), ("S", "k", 5, 50.0), ("H", "too_new", 3, 0.0)], "family string, key string, observed long, expected double")
    got = {(r["family"], r["key"]): (r["weight"], r["fitted"]) for r in B.with_prior(w, counts).collect()}
    adj = lambda s, o, e: s * max(-2.0, min(2.0, math.log((o + 20) / (e + 20))))
    assert set(got) == {("H", "often"), ("HP", "often|seldom"), ("H", "seldom"), ("H", "never"), ("S", "k")}
    assert got["H", "often"] == (pytest.approx(0.5 + adj(0.4, 90, 40)), True) and got["HP", "often|seldom"] == (pytest.approx(0.1), True)
    assert got["H", "seldom"] == (pytest.approx(adj(0.4, 2, 40)), False) and got["H", "never"][0] == pytest.approx(-0.8) and got["S", "k"][0] == pytest.approx(adj(0.3, 5, 50))


def test_search_equals_plain_loops(spark):
    """Every configuration's development scores, and the choice, from dense matrices of the same rows."""
    v = Views(spark, SF)
    s = P._search(v)
    best = s.run()
    split = {r["match_id"]: (r["held"], r["label"]) for r in v.valid.join(P._held(v), "uploader").select("match_id", "held", F.expr("if(winner = 1, 1, 0)").alias("label")).collect()}
    diff: dict = {}
    for r in v.features.select("match_id", "side", "family", "key").collect():
        d = diff.setdefault(r["match_id"], {})
        d[r["family"], r["key"]] = d.get((r["family"], r["key"]), 0) + (1 if r["side"] == 1 else -1)
    seen = {}
    for r in v.features.select("match_id", "family", "key").distinct().collect():
        if not split[r["match_id"]][0]:
            seen[r["family"], r["key"]] = seen.get((r["family"], r["key"]), 0) + 1
    train, test = ([m for m in sorted(split) if split[m][0] == held] for held in (False, True))
    counts = {(r["family"], r["key"]): (r["observed"], r["expected"]) for r in s.counts.collect()}
    fits = {}
    for c in s.scores:
        cols = sorted(k for k, n in seen.items() if n >= (c.single if k[0] in "HS" and len(k[0]) == 1 else c.pair) and (c.skill_pairs or k[0] != "SP"))
        dense = lambda ms, cols=cols: np.array([[diff.get(m, {}).get(k, 0) for k in cols] for m in ms], dtype=float).reshape(len(ms), len(cols))
        if c.fit not in fits:
            fits[c.fit] = newton(dense(train), np.array([split[m][1] for m in train]), c.c)
        w = fits[c.fit]
        z = dense(test) @ w[:-1] + w[-1]
        for i, m in enumerate(test):
            for (family, key), d in diff.get(m, {}).items():
                if (family, key) in counts and counts[family, key][1] > 0:
                    o, e = counts[family, key]
                    z[i] += d * (c.hero if family == "H" else c.skill) * max(-c.clip, min(c.clip, math.log((o + c.smoothing) / (e + c.smoothing))))
        p, y = 1 / (1 + np.exp(-np.clip(z, -30, 30))), np.array([split[m][1] for m in test])
        assert s.scores[c]["log_loss"] == pytest.approx(-np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), abs=1e-4)
        assert s.scores[c]["brier"] == pytest.approx(np.mean((p - y) ** 2), abs=1e-4)
    assert best in s.scores and len(s.scores) == 4 + 8 + 1 + 15 + 8
    stages = [[c for c in s.scores if c.shape == (20.0, 2.0) and (c.hero, c.skill) == (0.4, 0.3)], [c for c in s.scores if c.fit == best.fit]]
    assert s.scores[best]["log_loss"] <= min(s.scores[c]["log_loss"] for c in stages[1]) + 1e-9


def plain_model(v, families, c=0.05, single=5, pair=8, leave_out=None):
    """Held-out matches with label and probability, from dense matrices."""
    split = {r["match_id"]: (r["held"], r["label"], r["source"]) for r in v.valid.join(P._held(v), "uploader").select("match_id", "held", "source", F.expr("if(winner = 1, 1, 0)").alias("label")).collect()}
    diff, seen = {}, {}
    train, test = [m for m in sorted(split) if not split[m][0] and split[m][2] != leave_out], [m for m in sorted(split) if split[m][0]]
    known = set(train)
    for r in v.features.filter(F.col("family").isin(*families)).select("match_id", "side", "family", "key").collect():
        k = (r["family"], r["key"])
        diff.setdefault(r["match_id"], {}).setdefault(k, 0)
        diff[r["match_id"]][k] += 1 if r["side"] == 1 else -1
        if r["match_id"] in known:
            seen.setdefault(k, set()).add(r["match_id"])
    cols = sorted(k for k, n in seen.items() if len(n) >= (single if k[0] in ("H", "S") else pair))
    dense = lambda ms: np.array([[diff.get(m, {}).get(k, 0) for k in cols] for m in ms], dtype=float).reshape(len(ms), len(cols))
    w = newton(dense(train), np.array([split[m][1] for m in train]), c)
    # predictions leave the intercept out: a match has no first side by itself
    return np.array([split[m][1] for m in test]), 1 / (1 + np.exp(-np.clip(dense(test) @ w[:-1], -30, 30)))


def metrics(y, p):
    return {"accuracy": np.mean((p >= 0.5) == (y == 1)), "log_loss": -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)), "brier": np.mean((p - y) ** 2)}


def test_backtest_equals_plain_fit(spark):
    v = Views(spark, SF)
    got = registry.queries()["m04_backtest"](spark, SF).first()
    y, p = plain_model(v, ("H", "S", "HP", "HS"))
    assert got["n"] == len(y)
    for m, x in metrics(y, p).items():
        assert got[m] == pytest.approx(x, abs=2e-3), m


def test_controlled_comparison_equals_plain_fits(spark):
    v = Views(spark, SF)
    whole = ("H", "S", "HP", "HS", "SP")
    got = registry.queries()["m06_controlled_comparison"](spark, SF).first()
    (y, a), (_, b) = plain_model(v, whole), plain_model(v, whole, leave_out="external")
    assert got["n"] == len(y)
    for m in ("accuracy", "log_loss", "brier"):
        assert got[m] == pytest.approx(metrics(y, a)[m] - metrics(y, b)[m], abs=2e-3), m


def test_quality_gate(spark):
    evidence = lambda status: spark.createDataFrame([(300, 50, 40, 40, status)], "events long, sessions long, disagreements long, held_out long, status string")
    p = lambda *x: spark.createDataFrame([(v,) for v in x], "p double")
    even = 1 / 3
    assert M.quality_gate(evidence("ready"), p(0.6, 0.5)).first()["status"] == "ready"
    assert M.quality_gate(evidence("ready"), p(even, even)).first()["status"] == "below_quality"
    just = math.exp(-(math.log(3) - 0.01)) + 1e-9
    assert M.quality_gate(evidence("ready"), p(just)).first()["status"] == "ready" and M.quality_gate(evidence("ready"), p(just - 1e-6)).first()["status"] == "below_quality"
    got = M.quality_gate(evidence("collecting"), p(0.9, 0.0)).first()
    assert got["status"] == "collecting" and math.isfinite(got["log_loss"])
