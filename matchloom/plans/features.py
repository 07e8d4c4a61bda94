"""Feature tables and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import features as E
from matchloom.plans.registry import query


@query("f01_non_default_skills", "SELECT match_id, side, slot, CASE WHEN s1 = s2 THEN s1 ELSE s1 || ',' || s2 END AS kept FROM members")
def _(v):
    return E.non_default_skills(v.members, v.heroes).select("match_id", "side", "slot", F.array_join("kept", ",").alias("kept"))


@query("f02_team_features", "SELECT match_id, side, family, key FROM features")
def _(v):
    return v.features.drop("won")


_DIFF = "df AS (SELECT match_id, family, key, CAST(sum(CASE WHEN side = 1 THEN 1 ELSE -1 END) AS BIGINT) AS diff FROM features GROUP BY 1, 2, 3 HAVING sum(CASE WHEN side = 1 THEN 1 ELSE -1 END) <> 0)"


@query("f03_paired_difference", f"WITH {_DIFF} SELECT * FROM df")
def _(v):
    return E.paired_difference(v.features)


@query("f04_support", "SELECT family, key, support FROM support")
def _(v):
    return v.support


@query("f05_selected_features", "SELECT family, key, support FROM support WHERE family <> 'SP' AND support >= CASE WHEN family IN ('H', 'S') THEN 5 ELSE 8 END")
def _(v):
    return E.select_features(v.support, 5, 8, ("SP",))


@query("f06_design_matrix")
def _(v):
    from matchloom.operators.models import design_matrix

    return design_matrix(v.features, E.select_features(v.support, 5, 8)).select("match_id", F.size("indices").alias("n"), F.array_join("indices", ",").alias("indices"))


_CF = """cf AS (SELECT * FROM (SELECT event_id, option, unnest(['score', 'round_score|' || round, 'position|' || option]) AS key, unnest([round((s - (score0 + score1 + score2) / 3) / 10, 9), round((s - (score0 + score1 + score2) / 3) / 10, 9), 1.0e0]) AS value FROM (SELECT *, unnest([0, 1, 2]) AS option, unnest([score0, score1, score2]) AS s FROM accepted))
UNION SELECT event_id, option, 'item|' || round_type || '|' || item, 1.0e0 FROM offers WHERE event_id IN (SELECT event_id FROM accepted)
UNION SELECT o.event_id, option, 'pool_item|' || pool_type || '|' || pool_item || '|' || round_type || '|' || item, 1.0e0 FROM offers o JOIN pool p ON o.event_id = p.event_id WHERE o.event_id IN (SELECT event_id FROM accepted))"""


@query("f07_choice_features", f"WITH {_CF} SELECT * FROM cf")
def _(v):
    return E.option_features(v.accepted, v.offers, v.pool)


@query("f08_choice_support", f"WITH {_CF}, n AS (SELECT key, count(*) AS support FROM cf GROUP BY 1) SELECT * FROM n WHERE support >= CASE WHEN key LIKE 'round_score%' THEN 30 ELSE 10 END ORDER BY support DESC, key LIMIT 5000")
def _(v):
    n = E.option_features(v.accepted, v.offers, v.pool).groupBy("key").agg(F.count(F.lit(1)).alias("support"))
    return n.filter(F.col("support") >= F.when(F.col("key").startswith("round_score"), 30).otherwise(10)).orderBy(F.desc("support"), "key").limit(5000)


@query("f09_clipped_scores", "SELECT event_id, greatest(-3e0, least(3e0, score0)) AS c0, greatest(-3e0, least(3e0, score1)) AS c1, greatest(-3e0, least(3e0, score2)) AS c2 FROM choice")
def _(v):
    return v.events.select("event_id", *[E.clip(F.col(f"score{i}"), 3.0).alias(f"c{i}") for i in range(3)])


@query("f10_weight_lookup", "SELECT match_id, side, family, key, coalesce(weight, 0) AS weight, coalesce(support, 0) AS support FROM features LEFT JOIN weights USING (family, key)")
def _(v):
    return E.with_weights(v.features.drop("won"), v.weights)


@query("f11_scored_slots", "SELECT match_id, side, slot, s1 || ',' || s2 AS scored FROM members")
def _(v):
    return v.members.select("match_id", "side", "slot", F.array_join(F.slice(F.array("s0", "s1", "s2"), 2, 2), ",").alias("scored"))
