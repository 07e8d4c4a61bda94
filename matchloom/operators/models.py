"""Models and their evaluation."""

from __future__ import annotations

import math
import uuid
from operator import add

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.windows import numbered
from matchloom.session import materialize, shuffled


def feature_index(selected: DataFrame) -> DataFrame:
    """A number from 0 for each selected feature, by family and key."""
    return numbered(selected, "i", F.asc("family"), F.asc("key")).withColumn("i", (F.col("i") - 1).cast("int"))


def design_matrix(features: DataFrame, selected: DataFrame) -> DataFrame:
    """sparse rows (match_id, indices, values) of paired differences, sorted by index."""
    from matchloom.operators.features import paired_difference

    return _matrix(paired_difference(features), feature_index(selected))


def _matrix(differences: DataFrame, index: DataFrame) -> DataFrame:
    t = differences.join(index.select("family", "key", "i"), ["family", "key"])
    g = t.groupBy("match_id").agg(F.sort_array(F.collect_list(F.struct("i", "diff"))).alias("x"))
    return g.select("match_id", F.transform("x", lambda p: p["i"]).alias("indices"), F.transform("x", lambda p: p["diff"].cast("double")).alias("values"))


def fit_paired(matrix: DataFrame, outcomes: DataFrame, n_features: int, c: float = 0.05, max_iter: int = 100):
    """Paired logistic fit with an L2 penalty and a free intercept; None for degenerate outcomes.

    Rows go to the fit as text in the format that Spark ML reads sparse vectors from, so no Python touches them.
    Returns (weights as a list, intercept)."""
    from pyspark.ml.classification import LogisticRegression

    from matchloom.session import shared_dir

    spark = matrix.sparkSession
    n, ones = outcomes.agg(F.count(F.lit(1)), F.sum("label")).first()
    if not n or ones in (0, n):
        return None
    parts = F.transform(F.arrays_zip("indices", "values"), lambda p: F.concat_ws(":", (p["indices"] + 1).cast("string"), p["values"].cast("string")))
    line = F.concat_ws(" ", F.array_insert(F.coalesce(parts, F.array().cast("array<string>")), 1, F.col("label").cast("string")))
    path = f"{shared_dir(spark)}/vectors-{uuid.uuid4().hex}"
    outcomes.join(matrix, "match_id", "left").select(line.alias("value")).write.text(path)
    rows = spark.read.format("libsvm").option("numFeatures", n_features).load(path)
    m = LogisticRegression(regParam=1 / (c * n), elasticNetParam=0.0, standardization=False, maxIter=max_iter, tol=1e-9).fit(rows)
    return [float(x) for x in m.coefficients], float(m.intercept)


def fit_weights(features: DataFrame, selected: DataFrame, outcomes: DataFrame, c: float = 0.05) -> DataFrame:
    """(family, key, weight) of a fit on the matches of ``outcomes`` (match_id, label)."""
    from matchloom.operators.features import paired_difference

    return fit_differences(paired_difference(features), selected, outcomes, c)


def fit_differences(differences: DataFrame, selected: DataFrame, outcomes: DataFrame, c: float = 0.05) -> DataFrame:
    """``fit_weights`` from paired differences."""
    spark = differences.sparkSession
    index = materialize(feature_index(selected).select("family", "key", "i"), "index")
    n = index.count()
    fitted = fit_paired(_matrix(differences.join(outcomes.select("match_id"), "match_id", "left_semi"), index), outcomes, n, c) if n else None
    # a fit's weights are one vector on the driver
    w = spark.createDataFrame([(i, x) for i, x in enumerate(fitted[0])] if fitted else [], "i int, weight double")
    return index.join(w, "i", "left").select("family", "key", F.coalesce("weight", F.lit(0.0)).alias("weight"))


def predict(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(match_id, p) from paired differences; logits clipped to +-30."""
    from matchloom.operators.features import paired_difference

    return predict_differences(paired_difference(features), weights)


def predict_differences(differences: DataFrame, weights: DataFrame) -> DataFrame:
    """``predict`` from paired differences."""
    z = differences.join(weights.select("family", "key", "weight"), ["family", "key"], "left").groupBy("match_id").agg(F.sum(F.col("diff") * F.coalesce("weight", F.lit(0.0))).alias("z"))
    z = z.withColumn("z", F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("z"))))
    return z.select("match_id", (1 / (1 + F.exp(-F.col("z")))).alias("p"))


def point_metrics(scored: DataFrame, *by: str) -> DataFrame:
    """Rows (p, label): accuracy, log loss, Brier score and the majority's share."""
    p = F.least(F.greatest("p", F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("label")
    loss = -(y * F.log(p) + (1 - y) * F.log(1 - p))
    hit = F.when((F.col("p") >= 0.5) == (y == 1), 1.0).otherwise(0.0)
    share = F.avg(y)
    aggs = [F.count(F.lit(1)).alias("n"), F.round(F.avg(hit), 6).alias("accuracy"), F.round(F.avg(loss), 6).alias("log_loss"), F.round(F.avg(F.pow(F.col("p") - y, 2)), 6).alias("brier"), F.round(F.greatest(share, 1 - share), 6).alias("majority")]
    return scored.groupBy(*by).agg(*aggs) if by else scored.agg(*aggs)


#: Features that a choice model holds at most, its steps, L2 penalty and first rate (fixed values).
MOST_FEATURES, STEPS, L2, RATE = 5000, 200, 0.05, 0.25


#: Events that a written block holds (fixed value).
BLOCK = 1000


def _blocks_task(keys):
    """Events' lists (chosen, x) as one row of bytes for up to BLOCK events: places in ``keys`` of the features of each event's three options
    in turn, how many an option has, and values other than 1 with their places."""

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        known = pa.array(keys, pa.string())
        for whole in batches:
            for start in range(0, whole.num_rows, BLOCK):
                b = whole.slice(start, BLOCK)
                x = b.column("x")
                event = np.repeat(np.arange(b.num_rows), x.value_lengths().to_numpy(zero_copy_only=False))
                option, f = x.flatten().flatten()
                group = np.repeat(event * 3 + option.to_numpy(zero_copy_only=False), f.value_lengths().to_numpy(zero_copy_only=False))
                key, value = f.flatten().flatten()
                at = pc.fill_null(pc.index_in(key, known), -1).to_numpy(zero_copy_only=False)
                keep = np.flatnonzero(at >= 0)
                keep = keep[np.argsort(group[keep], kind="stable")]
                value = value.to_numpy(zero_copy_only=False)[keep].astype(np.float64)
                other = np.flatnonzero(value != 1)
                parts = [b.column("chosen").to_numpy(zero_copy_only=False).astype(np.int8), np.bincount(group[keep], minlength=3 * b.num_rows).astype(np.int32), at[keep].astype(_place_type(len(keys))), other.astype(np.int32), value[other]]
                yield pa.record_batch([pa.array([p.tobytes()], pa.binary()) for p in parts], names=list(_BLOCK))

    return run


#: Columns of a block.
_BLOCK = ("chosen", "sizes", "i", "other", "value")


def _place_type(n: int):
    import numpy as np

    return np.uint16 if n <= 1 << 16 else np.int32


def _unpacked(b, n: int) -> tuple:
    """A block's arrays; ``n`` is the number of keys."""
    import numpy as np

    return tuple(np.frombuffer(b[c], kind) for c, kind in zip(_BLOCK, (np.int8, np.int32, _place_type(n), np.int32, np.float64), strict=True))


def _chances(sizes, at, other, value, w):
    """Each event's probabilities of its three options."""
    import numpy as np

    x = w[at]
    x[other] *= value
    u, some = np.zeros(len(sizes)), sizes > 0
    if some.any():
        u[some] = np.add.reduceat(x, (np.cumsum(sizes) - sizes)[some])  # options without a feature take no room
    u = u.reshape(-1, 3)
    p = np.exp(u - u.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def _gradient_task(w):
    """Sums of residual times value by feature, for a task's blocks."""

    def run(blocks):
        import numpy as np

        total = np.zeros(len(w))
        for b in blocks:
            chosen, sizes, at, other, value = _unpacked(b, len(w))
            r = -_chances(sizes, at, other, value, w)
            r[np.arange(len(chosen)), chosen] += 1
            x = np.repeat(r.reshape(-1), sizes)
            x[other] *= value
            total += np.bincount(at, x, minlength=len(w))
        yield total

    return run


def fit_lists(events: DataFrame, steps: int = STEPS, most: int = MOST_FEATURES) -> tuple:
    """M07 from lists: (keys, weights). ``events``: (chosen, x), x the features of an event's options as ``option_lists`` gives them, written.

    Supports are counted out of the lists and blocks are made of a row each, so no event's features are shuffled."""
    import numpy as np

    n = events.count()
    f = events.select(F.explode("x").alias("x")).select(F.explode("x.f.key").alias("key"))
    top = f.groupBy("key").agg(F.count(F.lit(1)).alias("support")).orderBy(F.desc("support"), "key").limit(most)
    keys = sorted(r["key"] for r in top.collect())
    weights = np.zeros(len(keys))
    blocks = materialize(events.select("chosen", "x").mapInArrow(_blocks_task(keys), ", ".join(f"{c} binary" for c in _BLOCK)), "choice").rdd
    for step in range(steps if keys else 0):
        g = blocks.mapPartitions(_gradient_task(weights)).treeReduce(add)
        weights = weights + RATE / (1 + step / 100) ** 0.5 * (g / max(n, 1) - L2 * weights)
    return keys, weights


def list_scores(events: DataFrame, keys, weights) -> DataFrame:
    """(p): the model's probability of the chosen option, for each event of lists (chosen, x)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for block in _blocks_task(keys)(batches):
            chosen, sizes, at, other, value = _unpacked({c: block.column(c)[0].as_py() for c in _BLOCK}, len(keys))
            yield pa.record_batch([pa.array(_chances(sizes, at, other, value, weights)[np.arange(len(chosen)), chosen])], names=["p"])

    return events.select("chosen", "x").mapInArrow(run, "p double")


def weight_rows(spark, keys, weights) -> DataFrame:
    """(key, weight) of a fit; its weights are one short vector on the driver."""
    return spark.createDataFrame(list(zip(keys, weights.tolist(), strict=True)), "key string, weight double")


def choice_fit(features: DataFrame, chosen: DataFrame, steps: int = STEPS, most: int = MOST_FEATURES) -> DataFrame:
    """Conditional choice logit over three options by full-batch gradient steps with a falling rate: (key, weight).

    ``features``: (event_id, option, key, value); ``chosen``: (event_id, chosen). The ``most`` features with the
    largest support are fitted, so their weights are a short vector that each step sends to the tasks; a task adds up its
    events' gradients, and the tasks' vectors are added up by tree. Events are written once, in blocks. A step is a job over the one plan that
    reads them: steps that are queries of their own leave their plans, stages and result rows on the driver."""
    f = features.groupBy("event_id", "option").agg(F.collect_list(F.struct("key", "value")).alias("f"))
    x = f.groupBy("event_id").agg(F.collect_list(F.struct("option", "f")).alias("x"))
    # an event without features counts among the events
    events = chosen.join(shuffled(x), "event_id", "left").select("chosen", F.coalesce("x", F.array().cast(x.schema["x"].dataType)).alias("x"))
    return weight_rows(features.sparkSession, *fit_lists(materialize(events, "choice_lists"), steps, most))


def choice_scores(features: DataFrame, chosen: DataFrame, weights: DataFrame) -> DataFrame:
    """(event_id, p): the model's probability of the chosen option."""
    options = chosen.withColumn("option", F.explode(F.sequence(F.lit(0), F.lit(2))))
    u = features.join(F.broadcast(weights), "key").groupBy("event_id", "option").agg(F.sum(F.col("value") * F.col("weight")).alias("u"))  # MOST_FEATURES weights at most
    t = options.join(shuffled(u), ["event_id", "option"], "left").groupBy("event_id", "chosen").agg(F.sort_array(F.collect_list(F.struct("option", F.coalesce("u", F.lit(0.0)).alias("u")))).alias("x"))
    top = F.array_max(F.transform("x", lambda y: y["u"]))
    e = F.transform("x", lambda y: F.exp(y["u"] - top))
    return t.select("event_id", (F.get(e, F.col("chosen")) / F.aggregate(e, F.lit(0.0), lambda s, y: s + y)).alias("p"))


def quantize(probabilities: DataFrame, by: str, item: str, p: str, units: int = 1000) -> DataFrame:
    """Largest-remainder rounding of each group's probabilities to whole units that add up."""
    t = probabilities.withColumn("_x", F.round(F.col(p) * units, 9)).withColumn("_f", F.floor("_x"))
    rest = F.lit(units) - F.sum("_f").over(Window.partitionBy(by))
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc(F.round(F.col("_x") - F.col("_f"), 9)), item))
    return t.withColumn("_r", rest).withColumn("units", F.col("_f") + F.when(rank <= F.col("_r"), 1).otherwise(0)).drop("_x", "_f", "_r")


#: What the held-out log loss must be under that of equal chances, ln 3 (fixed value).
GAIN = 0.01


def evidence_gate(events: DataFrame, holdout: DataFrame, floors=(240, 40, 30, 36)) -> DataFrame:
    """One row with the counts that a model needs, and whether it may be fitted."""
    a = events.agg(F.count(F.lit(1)).alias("events"), F.count_distinct("session").alias("sessions"), F.count_if(F.col("chosen") != F.col("recommended")).alias("disagreements"))
    b = holdout.agg(F.count(F.lit(1)).alias("held_out"))
    ok = (F.col("events") >= floors[0]) & (F.col("sessions") >= floors[1]) & (F.col("disagreements") >= floors[2]) & (F.col("held_out") >= floors[3])
    return a.crossJoin(b).withColumn("status", F.when(ok, "ready").otherwise("collecting"))


def quality_gate(evidence: DataFrame, scored: DataFrame) -> DataFrame:
    """The status of a fitted model: ready where the held-out log loss beats equal chances by GAIN.

    ``scored``: a row (p) for each held-out event, the probability of what was chosen."""
    loss = scored.agg(F.round(F.avg(-F.log(F.greatest("p", F.lit(1e-15)))), 12).alias("log_loss"))
    t = evidence.crossJoin(loss)  # one row each
    good = math.log(3) - F.col("log_loss") >= GAIN
    return t.withColumn("status", F.when(F.col("status") != "ready", F.col("status")).when(good, "ready").otherwise("below_quality"))


def published_state(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows (key, value, n): a key takes its new value if it has enough new events."""
    floor = F.when(F.col("key").startswith("round_score") | (F.col("key") == "score"), 30).otherwise(10)
    t = after.join(before.select("key", F.col("value").alias("v0"), F.col("n").alias("n0")), "key", "left")
    fresh = F.col("n") - F.coalesce("n0", F.lit(0)) >= floor
    return t.select("key", F.when(fresh, F.col("value")).otherwise(F.coalesce("v0", F.lit(0.0))).alias("value"), F.when(fresh, F.col("n")).otherwise(F.coalesce("n0", F.lit(0))).alias("n"))


def explain_choice(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(event_id, a, b, key, gain): the feature that speaks most for option a over option b, for every two options of an event."""
    # keys are pairs of catalog items at most; the features of all events are not sent, however small their files look
    t = features.join(F.broadcast(weights), "key").groupBy("event_id", "key", "weight").agg(*[F.sum(F.when(F.col("option") == o, F.col("value")).otherwise(0.0)).alias(f"v{o}") for o in range(3)])
    gain = lambda a, b: F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col("weight") * (F.col(f"v{a}") - F.col(f"v{b}")), 6).alias("gain"))
    pairs = F.array(*[gain(a, b) for a in range(3) for b in range(3) if a != b])
    t = t.select("event_id", "key", F.explode(F.filter(pairs, lambda x: x["gain"] > 0)).alias("x")).select("event_id", "key", "x.*")
    m = t.groupBy("event_id", "a", "b").agg(F.min(F.struct((-F.col("gain")).alias("g"), "key")).alias("m"))
    return m.select("event_id", "a", "b", F.col("m.key").alias("key"), (-F.col("m.g")).alias("gain"))


#: Resamples, and groups under which intervals are left out or called exploratory (fixed values).
SAMPLES, FEW, SOME = 2000, 5, 20


def loss_sums(scored: DataFrame, stratum: str, group: str, p: str = "p") -> DataFrame:
    """(stratum, group, n, accuracy, log_loss, brier): sums over the rows (p, label) of each group."""
    q = F.least(F.greatest(F.col(p), F.lit(1e-12)), F.lit(1 - 1e-12))
    y = F.col("label")
    hit = F.when((F.col(p) >= 0.5) == (y == 1), 1.0).otherwise(0.0)
    return scored.groupBy(stratum, group).agg(F.count(F.lit(1)).alias("n"), F.sum(hit).alias("accuracy"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("log_loss"), F.sum(F.pow(F.col(p) - y, 2)).alias("brier"))


def bootstrap(groups: DataFrame, stratum: str, group: str, metrics: tuple[str, ...], samples: int = SAMPLES, seed: str = "boot") -> DataFrame:
    """Point values and 95 % percentile intervals of sums of metrics over sums of n, by stratum, over resampled groups.

    ``groups``: (stratum, group, n, metrics). Draws are hashes of (seed, stratum, sample, slot), so they repeat and
    need no state; a sample draws as many groups as its stratum has. Strata under FEW groups have no interval."""
    w = Window.partitionBy(stratum)
    t = groups.withColumn("g", F.row_number().over(w.orderBy(group)) - 1).withColumn("n_groups", F.count(F.lit(1)).over(w))
    sums = lambda: [(F.sum(m) / F.sum("n")).alias(m) for m in metrics]
    point = t.groupBy(stratum).agg(F.sum("n").alias("n"), F.max("n_groups").alias("n_groups"), *sums())
    sizes = point.filter(F.col("n_groups") >= FEW).select(stratum, "n_groups")
    slots = sizes.withColumn("sample", F.explode(F.expr(f"sequence(0L, {samples - 1}L)"))).withColumn("slot", F.explode(F.expr("sequence(0L, n_groups - 1)")))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col(stratum), F.col("sample").cast("string"), F.col("slot").cast("string"))), 1, 12), 16, 10).cast("long")
    drawn = slots.select(stratum, "sample", F.pmod(h, F.col("n_groups")).alias("g"))
    per = drawn.join(t.select(stratum, "g", "n", *metrics), [stratum, "g"]).groupBy(stratum, "sample").agg(*sums())
    ends = [F.round(F.percentile(m, q), 4).alias(f"{m}_{name}") for m in metrics for q, name in ((0.025, "low"), (0.975, "high"))]
    status = F.when(F.col("n_groups") < FEW, "omitted_too_few_groups").when(F.col("n_groups") < SOME, "exploratory_few_groups").otherwise("available")
    return point.join(per.groupBy(stratum).agg(*ends), stratum, "left").select(stratum, "n", "n_groups", status.alias("status"), *[F.round(m, 4).alias(m) for m in metrics], *[f"{m}_{e}" for m in metrics for e in ("low", "high")])
