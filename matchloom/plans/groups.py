"""Grouping, splitting and resampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import groups as G
from matchloom.operators import models as M
from matchloom.operators.components import connected_components
from matchloom.operators.near import matchup_replacements, skill_replacements
from matchloom.plans.registry import query

_GROUPS = """ed AS (SELECT first AS a, id AS b FROM visits WHERE id <> first UNION SELECT a, b FROM near_matches), cc AS (SELECT DISTINCT id AS node, id AS reach FROM reports UNION SELECT cc.node, CASE WHEN e.a = cc.reach THEN e.b ELSE e.a END FROM cc JOIN ed e ON cc.reach = e.a OR cc.reach = e.b),
comp AS (SELECT node AS id, min(reach) AS component FROM cc GROUP BY 1)"""


def _groups(v):
    return G.evaluation_groups(v.reports, matchup_replacements(v.reports))


@query("g01_evaluation_groups", f"WITH RECURSIVE {_GROUPS} SELECT id, component FROM comp")
def _(v):
    return _groups(v)


@query("g01_capture_sessions", "SELECT id, first FROM visits")
def _(v):
    return G.session_links(v.reports)


@query("g01_roster_components")
def _(v):
    return G.roster_groups(v.valid, v.rosters)


@query("g01_near_team_components")
def _(v):
    return connected_components(skill_replacements(v.reports.withColumnRenamed("id", "match_id")), "a", "b").groupBy("component").agg(F.count(F.lit(1)).alias("teams"))


@query("g02_stable_group_ids", f"WITH RECURSIVE {_GROUPS}, hs AS (SELECT component, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 1, 12)) AS BIGINT)) AS VARCHAR) AS p, CAST(sum(CAST(('0x' || substr(sha256(CAST(id AS VARCHAR)), 13, 12)) AS BIGINT)) AS VARCHAR) AS q FROM comp GROUP BY 1) SELECT substr(sha256(p || ':' || q || ':' || n), 1, 16) AS group_id, n FROM hs")
def _(v):
    return G.group_ids(_groups(v), "component", "id").select("group_id", "n")


_HOLD = "gr AS (SELECT DISTINCT uploader AS g FROM valid), hd AS (SELECT g, row_number() OVER (ORDER BY sha256(concat('split', chr(0), g))) AS rn, count(*) OVER () AS n FROM gr), ho AS (SELECT g, rn <= least(n - 1, greatest(1, round_even(n * 0.2, 0))) AS held FROM hd)"


@query("g03_group_holdout", f"WITH {_HOLD} SELECT g, held FROM ho")
def _(v):
    return G.holdout(v.valid.select(F.col("uploader").alias("g")).distinct(), "g", 0.2, "split")


_LOCK = "tm AS (SELECT match_id FROM valid WHERE match_id % 10 = 0), tg AS (SELECT DISTINCT roster FROM rosters JOIN tm USING (match_id)), sp AS (SELECT v.match_id, CASE WHEN v.match_id IN (SELECT match_id FROM tm) THEN 'test' WHEN v.match_id IN (SELECT match_id FROM rosters WHERE roster IN (SELECT roster FROM tg)) THEN 'excluded' ELSE 'train' END AS split FROM valid v)"


@query("g04_locked_test", f"WITH {_LOCK} SELECT match_id, split FROM sp")
def _(v):
    return G.locked_split(v.valid, v.rosters, v.valid.filter("match_id % 10 = 0").select("match_id"))


@query("g05_leaks", f"WITH {_LOCK} SELECT roster, count(DISTINCT split) AS splits FROM rosters JOIN sp USING (match_id) WHERE split <> 'excluded' GROUP BY 1 HAVING count(DISTINCT split) > 1")
def _(v):
    s = G.locked_split(v.valid, v.rosters, v.valid.filter("match_id % 10 = 0").select("match_id")).filter("split <> 'excluded'")
    return v.rosters.join(s, "match_id").groupBy("roster").agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


@query("g05_leaks_of_a_plain_split", "SELECT roster, count(*) FILTER (match_id % 10 = 0) AS tests, count(*) FILTER (match_id % 10 <> 0) AS trains FROM (SELECT DISTINCT roster, match_id FROM rosters JOIN valid USING (match_id)) GROUP BY 1 HAVING count(*) FILTER (match_id % 10 = 0) > 0 AND count(*) FILTER (match_id % 10 <> 0) > 0")
def _(v):
    """The check on a split that excludes nothing: rosters on both sides of it."""
    t = v.rosters.select("roster", "match_id").distinct().join(v.valid.select("match_id"), "match_id")
    test = F.col("match_id") % 10 == 0
    return t.groupBy("roster").agg(F.count_if(test).alias("tests"), F.count_if(~test).alias("trains")).filter("tests > 0 AND trains > 0")


@query("g06_session_holdout", "SELECT session, (CAST('0x' || substr(sha256(session), 1, 16) AS UBIGINT) % 5) = 0 AS held FROM choice GROUP BY 1")
def _(v):
    return G.hash_holdout(v.events.select("session").distinct(), "session", 5)


_MET = "pm AS (SELECT f.match_id, sum(CASE WHEN side = 1 THEN weight ELSE -weight END) AS z, sum(CASE WHEN family = 'H' THEN CASE WHEN side = 1 THEN weight ELSE -weight END ELSE 0 END) AS zh FROM features f LEFT JOIN weights USING (family, key) GROUP BY 1), sc AS (SELECT v.match_id, source, CASE source WHEN 'own' THEN uploader WHEN 'others' THEN uploader % 12 ELSE uploader % 4 END AS grp, CASE WHEN winner = 1 THEN 1 ELSE 0 END AS label, 1 / (1 + exp(-coalesce(z, 0))) AS pa, 1 / (1 + exp(-coalesce(zh, 0))) AS pb FROM valid v LEFT JOIN pm USING (match_id))"


def _boot(sums: str) -> str:
    """Common table expressions of resampled metrics, from ``sums``: (source, grp, n, accuracy, log_loss, brier)."""
    metrics = ("accuracy", "log_loss", "brier")
    ratio = ", ".join(f"sum({m}) / sum(n) AS {m}" for m in metrics)
    ends = ", ".join(f"round(quantile_cont({m}, {q}), 4) AS {m}_{e}" for m in metrics for q, e in ((0.025, "low"), (0.975, "high")))
    return f"""{_MET}, sg AS ({sums}), gi AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY grp) - 1 AS g, count(*) OVER (PARTITION BY source) AS n_groups FROM sg), pt AS (SELECT source, CAST(sum(n) AS BIGINT) AS n, max(n_groups) AS n_groups, {ratio} FROM gi GROUP BY 1),
dr AS (SELECT source, sample, CAST('0x' || substr(md5('boot:' || source || ':' || sample || ':' || slot), 1, 12) AS BIGINT) % n_groups AS g FROM (SELECT source, n_groups FROM pt WHERE n_groups >= {M.FEW}), range({M.SAMPLES}) r(sample), LATERAL (SELECT unnest(range(n_groups)) AS slot)),
bs AS (SELECT source, sample, {ratio} FROM dr JOIN gi USING (source, g) GROUP BY 1, 2), ci AS (SELECT source, {ends} FROM bs GROUP BY 1),
rp AS (SELECT source, n, n_groups, CASE WHEN n_groups < {M.FEW} THEN 'omitted_too_few_groups' WHEN n_groups < {M.SOME} THEN 'exploratory_few_groups' ELSE 'available' END AS status, {", ".join(f"round({m}, 4) AS {m}" for m in metrics)}, ci.* EXCLUDE (source) FROM pt LEFT JOIN ci USING (source))"""


def _loss(p: str) -> str:
    return f"sum(CASE WHEN ({p} >= 0.5) = (label = 1) THEN 1e0 ELSE 0 END) AS accuracy, sum(-(label * ln({p}) + (1 - label) * ln(1 - {p}))) AS log_loss, sum(({p} - label) ** 2) AS brier"


_DELTA = "SELECT source, grp, n, accuracy - a2 AS accuracy, log_loss - l2 AS log_loss, brier - b2 AS brier FROM (SELECT source, grp, count(*) AS n, " + _loss("pa") + " FROM sc GROUP BY 1, 2) JOIN (SELECT source, grp, accuracy AS a2, log_loss AS l2, brier AS b2 FROM (SELECT source, grp, " + _loss("pb") + " FROM sc GROUP BY 1, 2)) USING (source, grp)"


def _scored(v):
    """Two models' probabilities of each valid match; groups are uploaders, fewer for two of the sources."""
    rows = v.valid.select("match_id", "source", F.expr("CASE source WHEN 'own' THEN uploader WHEN 'others' THEN uploader % 12 ELSE uploader % 4 END").alias("grp"), F.expr("if(winner = 1, 1, 0)").alias("label"))
    a = M.predict_differences(v.differences, v.weights).withColumnRenamed("p", "pa")
    b = M.predict_differences(v.differences, v.weights.filter("family = 'H'")).withColumnRenamed("p", "pb")
    return rows.join(a, "match_id", "left").join(b, "match_id", "left").na.fill(0.5, ["pa", "pb"])


@query("g07_cluster_bootstrap", f"WITH {_boot('SELECT source, grp, count(*) AS n, ' + _loss('pa') + ' FROM sc GROUP BY 1, 2')} SELECT * FROM rp")
def _(v):
    return M.bootstrap(M.loss_sums(_scored(v), "source", "grp", "pa"), "source", "grp", ("accuracy", "log_loss", "brier"))


@query("g08_paired_delta", f"WITH {_boot(_DELTA)} SELECT *, CASE WHEN accuracy_low > 0 AND brier_high < 0 AND log_loss_high < 0 THEN 'better on all three' ELSE 'inconclusive' END AS verdict FROM rp")
def _(v):
    return G.paired_delta(_scored(v), "source", "grp")
