"""Round 4: fits that end at their optimum, and what they read."""

from __future__ import annotations

import numpy as np

from matchloom.operators import grid as B
from matchloom.sources.projection import Views

SF = "/root/testdata/sf0.001"


def slopes(x, y, w, c):
    return np.append(x.T @ (1 / (1 + np.exp(-x @ w[:-1] - w[-1])) - y) / len(y) + w[:-1] / (c * len(y)), np.mean(1 / (1 + np.exp(-x @ w[:-1] - w[-1])) - y))


def test_fits_of_rare_and_frequent_columns_end_at_their_optimum(spark):
    """200 evaluations left a gradient where columns' frequencies are far apart."""
    r = np.random.default_rng(5)
    x = r.normal(size=(300, 40)) @ np.linalg.qr(r.normal(size=(40, 40)))[0] * np.geomspace(1e-2, 300, 40)
    y = (r.random(300) < 0.5).astype(int)
    rows = spark.createDataFrame([(int(b), list(range(40)), [float(v) for v in a]) for a, b in zip(x, y, strict=True)], "label int, at array<int>, x array<double>").coalesce(1)
    got = B.fit_many(rows, [[True] * 40] * 2, [0.5, 50.0])
    for w, c in zip(got, (0.5, 50.0), strict=True):
        assert np.abs(slopes(x, y, w, c)).max() <= 1e-6 + 1e-9
    again = B.fit_many(rows, [[True] * 40], [0.5], starts=[got[0]])
    assert np.array_equal(again[0], got[0])


def test_slopes_by_aggregations(spark):
    r = np.random.default_rng(6)
    x, y, w = r.integers(-1, 2, (50, 4)).astype(float), r.integers(0, 2, 50), r.normal(size=(2, 6))
    rows = spark.createDataFrame([(int(b), [i for i in range(4) if a[i]], [float(v) for v in a if v]) for a, b in zip(x, y, strict=True)], "label int, at array<int>, x array<double>")
    got = {s["i"]: (s["slope0"], s["slope1"]) for s in B.slopes_left(rows, w, (0.5, 2.0)).collect()}
    x5 = np.hstack([x, np.zeros((50, 1))])  # a column that no row has
    for k, c in enumerate((0.5, 2.0)):
        assert np.allclose([got[i][k] for i in (0, 1, 2, 3, 4, -1)], slopes(x5, y, w[k], c))


def test_search_reads_the_lists_of_matches(spark):
    """differences and supports of fits need no shuffle by match and feature."""
    v = Views(spark, SF)
    s = B.Search(v.lists)
    diff: dict = {}
    for r in v.features.collect():
        d = diff.setdefault(r["match_id"], {})
        d[r["family"], r["key"]] = d.get((r["family"], r["key"]), 0) + (1 if r["side"] == 1 else -1)
    seen = {(r["family"], r["key"]): r["support"] for r in v.support.collect()}
    cols = sorted(k for k, n in seen.items() if n >= (3 if k[0] in ("H", "S") else 5))
    assert s.columns == [(f, seen[f, k]) for f, k in cols]
    label = {r["match_id"]: 1 if r["winner"] == 1 else 0 for r in v.valid.collect()}
    want = sorted((label[m], sorted((cols.index(k), float(x)) for k, x in d.items() if x and k in set(cols))) for m, d in diff.items())
    assert sorted((r["label"], sorted(zip(r["at"], r["x"], strict=True))) for r in s.rows.collect()) == want
