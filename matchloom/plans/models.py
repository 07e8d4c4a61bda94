"""Models and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import aggregate as A
from matchloom.operators import features as E
from matchloom.operators import grid as B
from matchloom.operators import groups as G
from matchloom.operators import identity as D
from matchloom.operators import models as M
from matchloom.plans.aggregates import _SEASONS
from matchloom.plans.features import _CF
from matchloom.plans.groups import _MET
from matchloom.plans.registry import query
from matchloom.session import materialize, shuffled


def _label(v):
    return v.valid.select("match_id", "source", F.expr("if(winner = 1, 1, 0)").alias("label"))


def _held(v):
    return G.holdout(v.valid.select("uploader").distinct(), "uploader", 0.2, "split")


@query("m01_paired_fit")
def _(v):
    rows = _label(v).select("match_id", "label")
    return M.fit_differences(v.differences, E.select_features(v.support, 5, 8), rows).select("family", "key", F.round("weight", 4).alias("weight"))


@query("m02_predictions", f"WITH {_MET} SELECT match_id, round(pa, 6) AS p FROM sc")
def _(v):
    p = M.predict_differences(v.differences, v.weights)
    return _label(v).join(p, "match_id", "left").select("match_id", F.round(F.coalesce("p", F.lit(0.5)), 6).alias("p"))


@query("m03_point_metrics", f"WITH {_MET} SELECT source, count(*) AS n, round(avg(CASE WHEN (pa >= 0.5) = (label = 1) THEN 1e0 ELSE 0 END), 6) AS accuracy, round(avg(-(label * ln(pa) + (1 - label) * ln(1 - pa))), 6) AS log_loss, round(avg((pa - label) ** 2), 6) AS brier, round(greatest(avg(label), 1 - avg(label)), 6) AS majority FROM sc GROUP BY 1")
def _(v):
    t = _label(v).join(M.predict_differences(v.differences, v.weights), "match_id", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))
    return M.point_metrics(t, "source")


def _backtest(v, families, c=0.05, single=5, pair=8, source=None):
    """Fit on the groups that aren't held out, score the others."""
    m = v.valid.join(_held(v), "uploader")
    train = m.filter("NOT held").filter(F.col("source") != source if source else F.lit(True)).select("match_id", F.expr("if(winner = 1, 1, 0)").alias("label"))
    test = m.filter("held").select("match_id", F.expr("if(winner = 1, 1, 0)").alias("label"))
    some = F.col("family").isin(*families)
    own = v.lists.join(train.select("match_id"), "match_id", "left_semi")
    w = M.fit_differences(E.list_differences(own).filter(some), E.select_features(E.feature_counts(own).filter(some), single, pair), train, c)
    p = M.predict_differences(v.differences.filter(some), w)
    return test.join(p, "match_id", "left").withColumn("p", F.coalesce("p", F.lit(0.5)))


@query("m04_backtest")
def _(v):
    return M.point_metrics(_backtest(v, ("H", "S", "HP", "HS")))


_PRIOR = f"""WITH {_SEASONS}, ob AS (SELECT 'H' AS family, hero AS name, count(*) AS observed FROM members WHERE season IS NOT NULL GROUP BY 2 UNION ALL SELECT 'S', skill, count(*) FROM carried WHERE season IS NOT NULL GROUP BY 2),
ad AS (SELECT family, name AS key, (CASE WHEN family = 'H' THEN 0.4e0 ELSE 0.3e0 END) * greatest(-2e0, least(2e0, ln((coalesce(observed, 0) + 20e0) / (expected + 20e0)))) AS adjustment FROM ex LEFT JOIN ob USING (family, name) WHERE expected > 0),
fw AS (SELECT coalesce(w.family, ad.family) AS family, coalesce(w.key, ad.key) AS key, coalesce(weight, 0) + coalesce(adjustment, 0) AS weight, w.key IS NOT NULL AS fitted FROM weights w FULL JOIN ad ON w.family = ad.family AND w.key = ad.key)"""


def _counts(v, matches=None):
    """Observed and expected appearances of the catalog's items, over some matches."""
    valid, members, carried = v.valid, v.members, v.carried
    if matches is not None:
        valid, members, carried = (t.join(matches.select("match_id"), "match_id", "left_semi") for t in (valid, members, carried))
    return materialize(B.item_counts(A.expected_appearances(valid, v.heroes, v.skills), members, carried), "items")


@query("m02_prior_weights", f"{_PRIOR} SELECT family, key, round(weight, 6) AS weight, fitted FROM fw WHERE fitted OR abs(weight) >= 1e-6")
def _(v):
    """Weights with the selection prior; items that are too rare for a fitted weight have one by the prior alone."""
    return B.with_prior(v.weights, _counts(v)).select("family", "key", F.round("weight", 6).alias("weight"), "fitted")


@query("m02_prior_predictions", f"{_PRIOR}, z AS (SELECT match_id, sum(CASE WHEN side = 1 THEN weight ELSE -weight END) AS z FROM features JOIN fw USING (family, key) WHERE fitted OR abs(weight) >= 1e-6 GROUP BY 1) SELECT match_id, round(1 / (1 + exp(-greatest(-30, least(30, coalesce(z, 0))))), 6) AS p FROM valid LEFT JOIN z USING (match_id)")
def _(v):
    p = M.predict_differences(v.differences, B.with_prior(v.weights, _counts(v)))
    return v.valid.select("match_id").join(p, "match_id", "left").select("match_id", F.round(F.coalesce("p", F.lit(0.5)), 6).alias("p"))


def _search(v):
    m = v.valid.join(_held(v), "uploader").select("match_id", "held", F.expr("if(winner = 1, 1, 0)").alias("label"))
    m = materialize(m, "split")
    return B.Search(v.lists, m, _counts(v, m.filter("NOT held")))


@query("m05_grid_search")
def _(v):
    """All configurations of the staged search with their development scores."""
    s = _search(v)
    best = s.run()
    rows = [(*c, *x.values(), c == best) for c, x in s.scores.items()]
    t = v.spark.createDataFrame(rows, "c double, single int, pair int, skill_pairs boolean, hero double, skill double, smoothing double, clip double, log_loss double, brier double, accuracy double, chosen boolean")
    return t.withColumns({m: F.round(m, 6) for m in ("log_loss", "brier", "accuracy")})


@query("m05_fits_are_optimal", "SELECT unnest([5e-2, 1e-1, 2e-1, 5e-1]) AS c, count(*) AS columns, true AS optimal FROM (SELECT family, key FROM features GROUP BY family, key HAVING count(DISTINCT match_id) >= CASE WHEN family IN ('H', 'S') THEN 3 ELSE 5 END)")
def _(v):
    """Fits of four penalties in one descent; their gradients, by aggregations that share nothing with the fit, are as good as 0."""
    s = B.Search(v.lists)
    slopes = B.slopes_left(s.rows, B.fit_many(s.rows, [[True] * len(s.columns)] * len(B.PENALTIES), B.PENALTIES), B.PENALTIES)
    t = slopes.agg(F.count_if(F.col("i") >= 0).alias("columns"), *[F.max(F.abs(f"slope{k}")).alias(f"s{k}") for k in range(len(B.PENALTIES))])
    each = F.array(*[F.struct(F.lit(c).alias("c"), F.col("columns"), (F.col(f"s{k}") < 1e-5).alias("optimal")) for k, c in enumerate(B.PENALTIES)])
    return t.select(F.explode(each).alias("x")).select("x.*")


@query("m06_controlled_comparison")
def _(v):
    whole = ("H", "S", "HP", "HS", "SP")
    a = _backtest(v, whole).withColumnRenamed("p", "pa")
    b = _backtest(v, whole, source="external").select("match_id", F.col("p").alias("pb"))
    t = a.join(b, "match_id").withColumn("all", F.lit("all")).join(v.valid.select("match_id", "uploader"), "match_id")
    return G.paired_delta(t, "all", "uploader")


@query("m07_choice_logit_two_steps", f"""WITH {_CF}, g1 AS (SELECT key, 0.25e0 * sum((CASE WHEN option = chosen THEN 1e0 ELSE 0 END - 1e0 / 3) * cf.value) / (SELECT count(*) FROM accepted) AS w FROM cf JOIN accepted USING (event_id) GROUP BY 1),
u AS (SELECT event_id, option, sum(value * w) AS u FROM cf JOIN g1 USING (key) GROUP BY 1, 2), pr AS (SELECT event_id, option, exp(u) / sum(exp(u)) OVER (PARTITION BY event_id) AS p FROM u),
g2 AS (SELECT key, sum((CASE WHEN option = chosen THEN 1e0 ELSE 0 END - p) * cf.value) / (SELECT count(*) FROM accepted) AS g FROM cf JOIN pr USING (event_id, option) JOIN accepted USING (event_id) GROUP BY 1)
SELECT key, round(w + 0.25e0 / sqrt(1.01e0) * (g - 0.05e0 * w), 6) AS weight FROM g1 JOIN g2 USING (key)""")
def _(v):
    return M.weight_rows(v.spark, *M.fit_lists(_choice_lists(v, v.accepted), 2)).select("key", F.round("weight", 6).alias("weight"))


def _choice_lists(v, accepted):
    """(chosen, held, x): what was chosen of accepted events, whether their session is held out, and their options' features, written."""
    choices = accepted.select("event_id", "chosen", "session")
    split = G.hash_holdout(accepted.select("session").distinct(), "session", 5)
    choices = choices.join(shuffled(split), "session").select("event_id", "chosen", "held")
    return materialize(E.option_lists(accepted, v.offers, v.pool).join(shuffled(choices), "event_id").select("chosen", "held", "x"), "choice_lists")


def _choice_split(v):
    """Accepted events, and lists of those to fit and of those of held-out sessions."""
    accepted = materialize(v.accepted, "accepted")
    x = _choice_lists(v, accepted)
    return accepted, x.filter("NOT held"), x.filter("held")


@query("m07_choice_logit")
def _(v):
    """All steps, over the events of sessions that aren't held out."""
    _, train, _ = _choice_split(v)
    return M.weight_rows(v.spark, *M.fit_lists(train)).select("key", F.round("weight", 6).alias("weight"))


_SOFT = "sm AS (SELECT event_id, unnest([0, 1, 2]) AS option, unnest([exp(score0 - mx), exp(score1 - mx), exp(score2 - mx)]) / (exp(score0 - mx) + exp(score1 - mx) + exp(score2 - mx)) AS p FROM (SELECT *, greatest(score0, score1, score2) AS mx FROM choice))"


def _softmax(v):
    return A.softmax(v.events).select("event_id", F.posexplode(F.array("p0", "p1", "p2")).alias("option", "p"))


@query("m08_softmax", f"WITH {_SOFT} SELECT event_id, option, round(p, 6) AS p FROM sm")
def _(v):
    return _softmax(v).select("event_id", "option", F.round("p", 6).alias("p"))


@query("m09_whole_shares", f"WITH {_SOFT}, x AS (SELECT *, round(p * 1000, 9) AS x FROM sm), r AS (SELECT event_id, option, floor(x) AS f, 1000 - sum(floor(x)) OVER (PARTITION BY event_id) AS rest, row_number() OVER (PARTITION BY event_id ORDER BY round(x - floor(x), 9) DESC, option) AS rn FROM x) SELECT event_id, option, CAST(f + CASE WHEN rn <= rest THEN 1 ELSE 0 END AS BIGINT) AS units FROM r")
def _(v):
    return M.quantize(_softmax(v), "event_id", "option", "p").select("event_id", "option", "units")


@query("m10_evidence_gate", "WITH h AS (SELECT count(*) AS held_out FROM accepted WHERE (CAST('0x' || substr(sha256(session), 1, 16) AS UBIGINT) % 5) = 0), e AS (SELECT count(*) AS events, count(DISTINCT session) AS sessions, count(*) FILTER (chosen <> recommended) AS disagreements FROM accepted) SELECT events, sessions, disagreements, held_out, CASE WHEN events >= 240 AND sessions >= 40 AND disagreements >= 30 AND held_out >= 36 THEN 'ready' ELSE 'collecting' END AS status FROM e, h")
def _(v):
    held = G.hash_holdout(v.accepted.select("session").distinct(), "session", 5).filter("held")
    return M.evidence_gate(v.accepted, v.accepted.join(shuffled(held), "session", "left_semi"))


@query("m10_quality_gate")
def _(v):
    accepted, train, test = _choice_split(v)
    p = M.list_scores(test, *M.fit_lists(train))
    return M.quality_gate(M.evidence_gate(accepted, test), p)


_STATE = "b AS (SELECT item AS key, CAST(sum(CASE WHEN option = chosen THEN 1 ELSE 0 END) AS DOUBLE) AS value, count(*) AS n FROM offers WHERE event_id % 4 <> 3 GROUP BY 1), a AS (SELECT item AS key, CAST(sum(CASE WHEN option = chosen THEN 1 ELSE 0 END) AS DOUBLE) AS value, count(*) AS n FROM offers GROUP BY 1)"


def _state(t):
    return t.groupBy(F.col("item").alias("key")).agg(F.sum(F.expr("if(option = chosen, 1, 0)")).cast("double").alias("value"), F.count(F.lit(1)).alias("n"))


@query("m13_published_deltas", f"WITH {_STATE} SELECT key, CASE WHEN a.n - coalesce(b.n, 0) >= 10 THEN a.value ELSE coalesce(b.value, 0) END AS value, CASE WHEN a.n - coalesce(b.n, 0) >= 10 THEN a.n ELSE coalesce(b.n, 0) END AS n FROM a LEFT JOIN b USING (key)")
def _(v):
    return M.published_state(_state(v.offers.filter("event_id % 4 <> 3")), _state(v.offers))


@query("m14_model_snapshot", "SELECT family, key, weight FROM weights WHERE support >= 20 ORDER BY abs(weight) DESC, family, key LIMIT 5000")
def _(v):
    return v.weights.filter("support >= 20").orderBy(F.desc(F.abs("weight")), "family", "key").limit(5000).select("family", "key", "weight")


@query("m14_model_version")
def _(v):
    return D.content_version(v.weights.filter("support >= 20"), F.concat_ws("|", "family", "key", F.format_number("weight", 6)))


@query("m15_choice_explanation", f"""WITH {_CF}, w AS (SELECT key, round((sum(CASE WHEN option = chosen THEN 1e0 ELSE 0 END) - count(*) / 3e0) / (count(*) + 10e0), 6) AS weight FROM cf JOIN accepted USING (event_id) GROUP BY 1),
pr(a, b) AS (VALUES (0, 1), (0, 2), (1, 0), (1, 2), (2, 0), (2, 1)), d AS (SELECT event_id, a, b, key, round(weight * sum(CASE WHEN option = a THEN value ELSE -value END), 6) AS gain FROM cf JOIN w USING (key), pr WHERE option IN (a, b) GROUP BY event_id, a, b, key, weight)
SELECT event_id, a, b, key, gain FROM (SELECT *, row_number() OVER (PARTITION BY event_id, a, b ORDER BY gain DESC, key) AS rn FROM d WHERE gain > 0) WHERE rn = 1""")
def _(v):
    f = E.option_features(v.accepted, v.offers, v.pool)
    t = f.join(shuffled(v.accepted.select("event_id", "chosen")), "event_id")
    w = t.groupBy("key").agg(F.round((F.sum(F.expr("if(option = chosen, 1.0D, 0.0D)")) - F.count(F.lit(1)) / 3.0) / (F.count(F.lit(1)) + 10.0), 6).alias("weight"))
    return M.explain_choice(f, w)
