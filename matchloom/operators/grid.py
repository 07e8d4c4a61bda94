"""Paired models of many configurations at once (M02, M05): fits, selection priors, and the staged search.

A configuration is a row: penalty, support floors, pairs of skills or not, and the selection prior's two strengths, smoothing and clip.
All fits of a stage share one written table of sparse rows, taken from the matches' own lists, and one set of columns, those of the loosest floors; a
configuration uses its own columns by a mask. An evaluation is one Spark job: tasks add up the losses and
gradients of all configurations as a matrix, the tasks' matrices are added up by tree, and the driver moves each configuration by its own L-BFGS until its
gradient is small. Development matches are scored in the same way, one job for all configurations of a stage. Priors need no fit: an item's adjustment is added to its weight, also where the item is too rare to have one.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Sequence
from operator import add
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialize, shuffled


class Config(NamedTuple):
    c: float = 0.05
    single: int = 5
    pair: int = 8
    skill_pairs: bool = True
    hero: float = 0.4
    skill: float = 0.3
    smoothing: float = 20.0
    clip: float = 2.0

    @property
    def fit(self) -> tuple:
        return self[:4]

    @property
    def shape(self) -> tuple:
        return self[6:]


#: Candidates of each stage of the search (fixed values).
PENALTIES, SINGLES, PAIRS = (0.05, 0.1, 0.2, 0.5), (3, 5, 8), (5, 8, 12)
HERO_STRENGTHS, SKILL_STRENGTHS = (0.0, 0.2, 0.4, 0.6), (0.0, 0.1, 0.2, 0.3)
SMOOTHINGS, CLIPS = (5.0, 20.0, 50.0), (1.0, 2.0, 3.0)
#: Weights under it aren't kept for items without a fitted one (fixed value).
EPSILON = 1e-6
SINGLE_FAMILIES = ("H", "S")


# --- selection priors


def item_counts(expected: DataFrame, members: DataFrame, carried: DataFrame) -> DataFrame:
    """(family, key, observed, expected) of the catalog's items, over matches with a season."""
    h = members.filter("season IS NOT NULL").groupBy(F.lit("H").alias("family"), F.col("hero").alias("name")).agg(F.count(F.lit(1)).alias("o"))
    s = carried.filter("season IS NOT NULL").groupBy(F.lit("S").alias("family"), F.col("skill").alias("name")).agg(F.count(F.lit(1)).alias("o"))
    t = expected.join(h.unionByName(s), ["family", "name"], "left")
    return t.select("family", F.col("name").alias("key"), F.coalesce("o", F.lit(0)).alias("observed"), "expected")


def log_ratio(smoothing: float, clip: float):
    """Bounded log-ratio of observed to expected appearances; 0 for items that none is expected of."""
    ratio = F.log((F.col("observed") + smoothing) / (F.col("expected") + smoothing))
    return F.when(F.col("expected") > 0, F.greatest(F.lit(-clip), F.least(F.lit(clip), ratio))).otherwise(0.0)


def with_prior(weights: DataFrame, counts: DataFrame, config: Config = Config()) -> DataFrame:
    """(family, key, weight, fitted): fitted weights plus adjustments, and prior-only weights of items without a fitted one."""
    strength = F.when(F.col("family") == "H", config.hero).otherwise(config.skill)
    prior = counts.select("family", "key", (strength * log_ratio(*config.shape)).alias("adjustment"))
    t = weights.select("family", "key", F.col("weight").alias("own")).join(prior, ["family", "key"], "full")
    t = t.select("family", "key", (F.coalesce("own", F.lit(0.0)) + F.coalesce("adjustment", F.lit(0.0))).alias("weight"), F.col("own").isNotNull().alias("fitted"))
    return t.filter(F.col("fitted") | (F.abs("weight") >= EPSILON))


# --- fits


def split_lists(lists: DataFrame, split: DataFrame | None) -> DataFrame:
    """(label, held, plus, minus, both) of matches: features that only side 1 has, only side 2, or both.

    ``lists``: rows of ``match_lists``; ``split``: (match_id, held, label), or none: all matches with their own outcome, none held out."""
    parts = [F.array_except("a", "b").alias("plus"), F.array_except("b", "a").alias("minus"), F.array_intersect("a", "b").alias("both")]
    if split is None:
        return lists.select(F.col("won1").cast("int").alias("label"), F.lit(False).alias("held"), *parts)
    return materialize(lists.join(shuffled(split), "match_id").select(F.col("label").cast("int").alias("label"), "held", *parts), "split_lists")


def sparse_rows(own: DataFrame, names: Sequence[str]) -> DataFrame:
    """(label, at, x) of matches (rows of ``split_lists``), written: places of their differences in ``names``; matches without one stay."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(names, pa.string())
        for b in batches:
            sides = [b.column("plus"), b.column("minus")]
            row = np.concatenate([np.repeat(np.arange(b.num_rows), c.value_lengths().to_numpy(zero_copy_only=False)) for c in sides])
            at = np.concatenate([pc.fill_null(pc.index_in(c.flatten(), known), -1).to_numpy(zero_copy_only=False) for c in sides])
            x = np.repeat([1.0, -1.0], [len(c.flatten()) for c in sides])
            keep = np.flatnonzero(at >= 0)
            keep = keep[np.argsort(row[keep], kind="stable")]
            ends = np.concatenate([[0], np.cumsum(np.bincount(row[keep], minlength=b.num_rows))]).astype(np.int32)
            lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(c[keep], t)) for c, t in ((at, pa.int32()), (x, pa.float64()))]
            yield pa.record_batch([b.column("label"), *lists], names=["label", "at", "x"])

    return materialize(own.select("label", "plus", "minus").mapInArrow(run, "label int, at array<int>, x array<double>"), "sparse")


def blocks(rows: DataFrame):
    """Rows (label, at, x) as an RDD of bytes, an Arrow batch each, written; whole values in one byte. A step over them is a job, not a query."""

    def run(batches) -> Iterator:
        import numpy as np
        import pyarrow as pa

        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            small = x.astype(np.int8) if not len(x) or np.abs(x).max() < 128 else x
            parts = [b.column(0).to_numpy(zero_copy_only=False).astype(np.int8), b.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int32), b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.int32), small if np.array_equal(small, x) else x]
            yield pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], names=["label", "sizes", "at", "x"])

    return materialize(rows.mapInArrow(run, "label binary, sizes binary, at binary, x binary"), "blocks").rdd


def _unpacked(b) -> tuple:
    """(labels, the row of each value, its column, the values) of a block."""
    import numpy as np

    y, sizes, at = (np.frombuffer(b[c], kind) for c, kind in (("label", np.int8), ("sizes", np.int32), ("at", np.int32)))
    x = np.frombuffer(b["x"], np.int8 if len(b["x"]) == len(at) else np.float64).astype(np.float64)
    return y.astype(np.float64), np.repeat(np.arange(len(y)), sizes), at.astype(np.intp), x


def _squares(size: int) -> Callable:
    """A task's rows, and sums of squares by column."""

    def run(blocks) -> Iterator:
        import numpy as np

        total = np.zeros(size + 1)
        for b in blocks:
            y, _, at, x = _unpacked(b)
            total[:-1] += np.bincount(at, weights=x * x, minlength=size)
            total[-1] += len(y)
        yield total

    return run


def _slopes(w) -> Callable:
    """Losses and gradients of all configurations over a task's rows, a row each: gradient, that of the intercept, loss."""

    def run(blocks) -> Iterator:
        import numpy as np

        total = np.zeros((len(w), w.shape[1] + 1))
        for b in blocks:
            y, row, at, x = _unpacked(b)
            for k in range(len(w)):
                z = w[k, -1] + np.bincount(row, weights=x * w[k, at], minlength=len(y))
                total[k, -1] += np.sum(np.logaddexp(0, z) - y * z)
                r = 1 / (1 + np.exp(-np.clip(z, -700, 700))) - y
                total[k, :-2] += np.bincount(at, weights=x * r[row], minlength=w.shape[1] - 1)
                total[k, -2] += r.sum()
        yield total

    return run


def _losses(w) -> Callable:
    """Sums of rows, log losses, squared errors and hits of all configurations over a task's rows; logits are clipped to +-30."""

    def run(blocks) -> Iterator:
        import numpy as np

        total = np.zeros((len(w), 4))
        for b in blocks:
            y, row, at, x = _unpacked(b)
            for k in range(len(w)):
                z = w[k, -1] + np.bincount(row, weights=x * w[k, at], minlength=len(y))
                p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
                q = np.clip(p, 1e-12, 1 - 1e-12)
                total[k] += len(y), -np.sum(y * np.log(q) + (1 - y) * np.log(1 - q)), np.sum((p - y) ** 2), np.sum((p >= 0.5) == (y == 1))
        yield total

    return run


class _Descent:
    """L-BFGS of one configuration: ``ask`` gives the next point, ``tell`` takes its loss and gradient.

    ``curvature`` is the largest that each column's part of the loss can have. Steps are scaled by it: columns of rare
    features are as far from their ends as those of frequent ones, however many rows there are."""

    def __init__(self, curvature, tolerance: float, start=None):
        import numpy as np

        self.np, self.w, self.tolerance = np, np.zeros(len(curvature)) if start is None else start, tolerance
        self.scale, self.idle = 1 / curvature, 0
        self.loss, self.g, self.past, self.step, self.done = math.inf, None, [], 1.0, False
        self.d = np.zeros(len(curvature))

    def ask(self):
        return self.w + self.step * self.d

    def tell(self, loss: float, g) -> None:
        # sums of many rows' losses differ in their last digits; a fit that they alone still move is done
        noise = 1e-13 * abs(self.loss) if self.g is not None else 0.0
        self.idle = 0 if loss < self.loss - noise else self.idle + 1
        if self.g is not None and not loss <= self.loss + 1e-4 * self.step * float(self.g @ self.d) + noise:
            self.step /= 2
            self.done = self.step < 1e-12
            return
        if self.g is not None:
            s, y = self.step * self.d, g - self.g
            if s @ y > 1e-14:
                self.past = [*self.past, (s, y)][-10:]
            self.w = self.w + s
        self.loss, self.g = loss, g
        self.done = self.np.abs(g).max() <= self.tolerance or self.idle >= 50
        d, sums = -g, []
        for s, y in reversed(self.past):
            sums.append(s @ d / (s @ y))
            d = d - sums[-1] * y
        d = d * self.scale
        if self.past:
            s, y = self.past[-1]
            d = d * (s @ y) / (y @ (self.scale * y))
        for (s, y), a in zip(self.past, reversed(sums), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        self.d, self.step = d, 1.0


def fit_many(rows: DataFrame, masks, penalties: Sequence[float], tolerance: float = 1e-6, starts=None):
    """Weights of each configuration, a row each, the free intercept last: mean log loss plus |w|^2 / (2 c n).

    ``rows``: (label, at, x). ``masks``: for each configuration, the columns that it may use; the others stay 0. ``tolerance`` is the
    largest part of the gradient that is left. Evaluations end when each configuration's does, not at a number.
    ``starts``: weights to start from, or None, for each configuration."""
    import numpy as np

    masks = np.asarray(masks, dtype=float)
    packed = blocks(rows)
    if packed.isEmpty():
        return np.zeros((len(masks), masks.shape[1] + 1))
    squares = packed.mapPartitions(_squares(masks.shape[1])).treeReduce(add)
    n = int(squares[-1])
    curvature = [np.append(squares[:-1] / 4 / n + 1 / (c * n), 0.25) for c in penalties]
    starts = [w if w is None else w * np.append(m, 1.0) for w, m in zip(starts or [None] * len(masks), masks, strict=True)]
    descents = [_Descent(h, tolerance, w) for h, w in zip(curvature, starts, strict=True)]
    while at := [k for k, d in enumerate(descents) if not d.done]:
        w = np.stack([descents[k].ask() for k in at])
        sums = packed.mapPartitions(_slopes(w)).treeReduce(add)
        for j, k in enumerate(at):
            own, strength = w[j, :-1], 1 / (penalties[k] * n)
            g = sums[j, :-1] / n
            g[:-1] = (g[:-1] + strength * own) * masks[k]
            descents[k].tell(sums[j, -1] / n + strength / 2 * float(own @ own), g)
    return np.stack([d.w for d in descents])


def slopes_left(rows: DataFrame, fits, penalties: Sequence[float]) -> DataFrame:
    """(i, slope0, slope1, ...): the gradients of fits, a column each, by aggregations only; ``fits``: rows of weights, the intercept last, whose i is -1.

    Weights are literals, so a row's sums need no join; each row's residuals meet its values, which are added up by column."""
    n = rows.count()
    w = [F.from_json(F.lit(json.dumps([float(x) for x in f[:-1]])), "array<double>") for f in fits]
    dot = lambda a: F.aggregate(F.zip_with("at", "x", lambda i, x: x * F.get(a, i)), F.lit(0.0), lambda s, x: s + x)
    z = [dot(a) + float(f[-1]) for f, a in zip(fits, w, strict=True)]
    r = rows.select("at", "x", *[(1 / (1 + F.exp(-v)) - F.col("label")).alias(f"r{k}") for k, v in enumerate(z)])
    names = [f"r{k}" for k in range(len(w))]
    # the intercept is a column of ones
    t = r.select(F.explode(F.arrays_zip(F.concat("at", F.array(F.lit(-1))).alias("i"), F.concat("x", F.array(F.lit(1.0))).alias("x"))).alias("p"), *names)
    g = t.groupBy(F.col("p.i").alias("i")).agg(*[F.sum(F.col("p.x") * F.col(c)).alias(c) for c in names])
    columns = rows.sparkSession.range(-1, len(fits[0]) - 1).select(F.col("id").cast("int").alias("i"))
    own = lambda a, c: F.coalesce(F.get(a, F.nullif("i", F.lit(-1))), F.lit(0.0)) / (c * n)
    return columns.join(g, "i", "left").select("i", *[(F.coalesce(f"r{k}", F.lit(0.0)) / n + own(a, c)).alias(f"slope{k}") for k, (a, c) in enumerate(zip(w, penalties, strict=True))])


# --- the search


class Search:
    """Scores configurations on development matches. ``lists`` and ``split`` as for ``split_lists``; ``counts``: rows of ``item_counts``, if priors are used."""

    def __init__(self, lists: DataFrame, split: DataFrame | None = None, counts: DataFrame | None = None):
        own = split_lists(lists, split)
        train = own.filter("NOT held")
        family = F.substring_index("f", ":", 1)
        floor = F.when(family.isin(*SINGLE_FAMILIES), min(SINGLES)).otherwise(min(PAIRS))
        support = train.select(F.explode(F.concat("plus", "minus", "both")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("support")).filter(F.col("support") >= floor)
        # a model's columns are one vector on the driver
        found = sorted((*r["f"].split(":", 1), r["support"]) for r in support.collect())
        self.columns = [(family, n) for family, _, n in found]
        names = [f"{family}:{key}" for family, key, _ in found]
        self.rows = sparse_rows(train, names)
        self.fits: dict[tuple, object] = {}
        self.scores: dict[Config, dict] = {}
        self.counts = counts
        if split is not None:
            # the catalog's items that have no column come after those that have one
            self.items = [(r["family"], f"{r['family']}:{r['key']}", r["observed"], r["expected"]) for r in counts.filter(F.col("family").isin(*SINGLE_FAMILIES)).collect()]
            self.names = {x: i for i, x in enumerate(dict.fromkeys([*names, *(x[1] for x in self.items)]))}
            self.develop = blocks(sparse_rows(own.filter("held"), list(self.names)))

    def mask(self, config: Config) -> list[bool]:
        return [s >= (config.single if f in SINGLE_FAMILIES else config.pair) and (config.skill_pairs or f != "SP") for f, s in self.columns]

    def _fit(self, configs: Sequence[Config]) -> None:
        todo = list(dict.fromkeys(c.fit for c in configs if c.fit not in self.fits))
        if todo:
            own = [Config(*f) for f in todo]
            # a fit starts from the most similar one of its penalty
            near = [max((g for g in self.fits if g[0] == f[0]), key=lambda g, f=f: sum(a == b for a, b in zip(f, g, strict=True)), default=None) for f in todo]
            for f, w in zip(todo, fit_many(self.rows, [self.mask(c) for c in own], [c.c for c in own], starts=[self.fits.get(g) for g in near]), strict=True):
                self.fits[f] = w

    def _weights(self, config: Config):
        """A configuration's weights of all columns and items with their prior, the intercept last."""
        import numpy as np

        fit, w = self.fits[config.fit], np.zeros(len(self.names) + 1)
        w[: len(self.columns)], w[-1] = fit[:-1], fit[-1]
        for family, name, observed, expected in self.items:
            if expected is not None and expected > 0:
                ratio = math.log((observed + config.smoothing) / (expected + config.smoothing))
                w[self.names[name]] += (config.hero if family == "H" else config.skill) * max(-config.clip, min(config.clip, ratio))
        return w

    def score(self, configs: Sequence[Config]) -> None:
        import numpy as np

        todo = [c for c in dict.fromkeys(configs) if c not in self.scores]
        if not todo:
            return
        self._fit(todo)
        w = np.stack([self._weights(c) for c in todo])
        sums = np.zeros((len(todo), 4)) if self.develop.isEmpty() else self.develop.mapPartitions(_losses(w)).treeReduce(add)
        for c, (n, loss, brier, hits) in zip(todo, sums.tolist(), strict=True):
            self.scores[c] = {"log_loss": loss / n, "brier": brier / n, "accuracy": hits / n} if n else dict.fromkeys(("log_loss", "brier", "accuracy"))

    def best(self, configs: Sequence[Config]) -> Config:
        """By log loss, Brier score, accuracy, then the configuration's own values."""
        self.score(configs)
        key = lambda c: (*[math.inf if self.scores[c][m] is None else sign * round(self.scores[c][m], 9) for m, sign in (("log_loss", 1), ("brier", 1), ("accuracy", -1))], c)
        return min(configs, key=key)

    def run(self) -> Config:
        """Stages: penalty, support floors, pairs of skills, prior strengths, prior shape; each starts from the best so far."""
        at = self.best([Config(c=c) for c in PENALTIES])
        at = self.best([at._replace(single=s, pair=p) for s in SINGLES for p in PAIRS])
        at = self.best([at._replace(skill_pairs=x) for x in (True, False)])
        at = self.best([at._replace(hero=h, skill=s) for h in HERO_STRENGTHS for s in SKILL_STRENGTHS])
        return self.best([at._replace(smoothing=s, clip=c) for s in SMOOTHINGS for c in CLIPS])
