"""Windows, ranking, sorts and top-k."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import windows as W
from matchloom.plans.registry import query


def _gap(minutes: int) -> str:
    return f"SELECT event_id, CAST(sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL {minutes} MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS visit FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)"


@query("w01_sessions_30_minutes", _gap(30))
def _(v):
    return W.sessionize(v.table("events"), "user_id", "ts", "event_id", 30).select("event_id", "visit")


@query("w01_sessions_6_hours", _gap(360))
def _(v):
    return W.sessionize(v.table("events"), "user_id", "ts", "event_id", 360).select("event_id", "visit")


@query("w02_integer_runs", "SELECT source, min(match_id) AS first_id, max(match_id) AS last_id, count(*) AS n FROM (SELECT source, match_id, match_id - row_number() OVER (PARTITION BY source ORDER BY match_id) AS island FROM valid) GROUP BY source, island")
def _(v):
    return W.runs(v.valid, "source", "match_id")


_RATES = "r AS (SELECT hero AS name, count(*) AS total, round((sum(won) + (SELECT avg(won) FROM members) * 5) / (count(*) + 5), 4) AS strength FROM members GROUP BY 1)"


@query("w03_ranked_heroes", f"WITH {_RATES} SELECT name, total, strength, row_number() OVER (ORDER BY strength DESC, total DESC, name) AS rank FROM r")
def _(v):
    return W.ranked_rates(v.members)


@query("w04_rank_before_filter", f"WITH {_RATES} SELECT * FROM (SELECT name, row_number() OVER (ORDER BY strength DESC, total DESC, name) AS rank FROM r) WHERE name LIKE '%2%'")
def _(v):
    return W.ranked_rates(v.members).select("name", "rank").filter("name LIKE '%2%'")


@query("w05_top_synergies", "(SELECT family, key, weight FROM weights WHERE family = 'HP' ORDER BY weight DESC, key LIMIT 40) UNION ALL (SELECT family, key, weight FROM weights WHERE family = 'HS' ORDER BY weight DESC, key LIMIT 40)")
def _(v):
    top = lambda f: v.weights.filter(F.col("family") == f).orderBy(F.desc("weight"), "key").limit(40).select("family", "key", "weight")
    return top("HP").unionByName(top("HS"))


@query("w06_top_picks", "SELECT item, count(*) AS picks FROM picks GROUP BY 1 ORDER BY picks DESC, item LIMIT 20")
def _(v):
    return v.picks.groupBy("item").agg(F.count(F.lit(1)).alias("picks")).orderBy(F.desc("picks"), "item").limit(20)


@query("w07_top_per_group", "SELECT hero, skill, weight, rank FROM (SELECT split_part(key, '|', 1) AS hero, split_part(key, '|', 2) AS skill, weight, row_number() OVER (PARTITION BY split_part(key, '|', 1) ORDER BY weight DESC, key) AS rank FROM weights WHERE family = 'HS') WHERE rank <= 5")
def _(v):
    t = v.weights.filter("family = 'HS'").withColumn("p", F.split("key", r"\|"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy(F.col("p")[0]).orderBy(F.desc("weight"), "key")))
    return t.filter("rank <= 5").select(F.col("p")[0].alias("hero"), F.col("p")[1].alias("skill"), "weight", F.col("rank").cast("long").alias("rank"))


_TWO = "l AS (SELECT key, 2 * row_number() OVER (ORDER BY weight DESC, key) AS pos FROM weights WHERE family = 'HP'), s AS (SELECT key, 2 * row_number() OVER (ORDER BY support DESC, key) + 1 AS pos FROM weights WHERE family = 'HP')"


@query("w08_interleaved_union", f"WITH {_TWO} SELECT key, min(pos) AS pos FROM (SELECT * FROM l UNION ALL SELECT * FROM s) GROUP BY 1 ORDER BY pos, key LIMIT 60")
def _(v):
    return W.interleave(v.weights.filter("family = 'HP'"), "key", "weight", "support", 60)


@query("w09_top_by_either", "SELECT key FROM (SELECT key, row_number() OVER (ORDER BY weight DESC, key) AS a, row_number() OVER (ORDER BY support DESC, key) AS b FROM weights WHERE family = 'HP') WHERE a <= 25 OR b <= 10")
def _(v):
    return W.top_by_either(v.weights.filter("family = 'HP'"), "key", ("weight", 25), ("support", 10))
