"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import aggregate as A
from matchloom.plans.registry import query
from matchloom.streaming import folds as Z


@query("a01_smoothed_win_rates", """WITH i AS (SELECT 'hero' AS kind, hero AS name, won, 0 AS shadow FROM members UNION ALL SELECT 'skill', skill, won, CASE WHEN CAST(substr(skill, 2) AS INT) % 10 = 9 THEN 1 ELSE 0 END FROM carried),
p AS (SELECT avg(won) AS prior FROM members)
SELECT kind, name, CAST(sum(won) AS BIGINT) AS wins, CAST(count(*) - sum(won) AS BIGINT) AS losses, count(*) AS total, CAST(sum(shadow) AS BIGINT) AS shadow_total, round(avg(won), 4) AS win_rate, round((sum(won) + max(prior) * 5) / (count(*) + 5), 4) AS smoothed FROM i, p GROUP BY 1, 2""")
def _(v):
    return A.smoothed_rates(v.members, v.carried)


_SEASONS = "sc AS (SELECT season, count(*) AS battles FROM valid WHERE season IS NOT NULL GROUP BY 1), it AS (SELECT 'H' AS family, hero AS name, season AS intro, 6 AS slots FROM heroes UNION ALL SELECT 'S', skill, season, 12 FROM skills WHERE NOT is_signature), av AS (SELECT s.season, battles, i.family, count(*) AS available FROM sc s JOIN it i ON i.intro <= s.season GROUP BY 1, 2, 3), ex AS (SELECT it.family, it.name, sum(battles * slots * 1e0 / available) AS expected FROM it JOIN av ON it.family = av.family AND it.intro <= av.season GROUP BY 1, 2)"


@query("a02_expected_appearances", f"WITH {_SEASONS} SELECT family, name, round(expected, 6) AS expected FROM ex")
def _(v):
    return A.expected_appearances(v.valid, v.heroes, v.skills).select("family", "name", F.round("expected", 6).alias("expected"))


@query("a03_selection_adjustment", f"""WITH {_SEASONS}, ob AS (SELECT 'H' AS family, hero AS name, count(*) AS observed FROM members WHERE season IS NOT NULL GROUP BY 2 UNION ALL SELECT 'S', skill, count(*) FROM carried WHERE season IS NOT NULL GROUP BY 2),
j AS (SELECT family, name, expected, coalesce(observed, 0) AS observed FROM ex LEFT JOIN ob USING (family, name))
SELECT family, name, observed, round(observed / expected, 6) AS usage_ratio, round((CASE WHEN family = 'H' THEN 0.4e0 ELSE 0.3e0 END) * greatest(-2e0, least(2e0, ln((observed + 20e0) / (expected + 20e0)))), 6) AS adjustment FROM j""")
def _(v):
    return A.selection_adjustment(A.expected_appearances(v.valid, v.heroes, v.skills), v.members, v.carried)


@query("a04_appearance_buckets", """WITH w AS (SELECT family, support, abs(weight) AS a FROM weights), b AS (SELECT family, CASE WHEN support < 20 THEN '0-19' WHEN support < 100 THEN '20-99' WHEN support < 500 THEN '100-499' ELSE '500+' END AS bucket, a FROM w),
g AS (SELECT * FROM (VALUES ('H'), ('S'), ('HP'), ('HS'), ('SP')) f(family), (VALUES ('0-19'), ('20-99'), ('100-499'), ('500+')) b(bucket))
SELECT g.family, g.bucket, count(a) AS n, round(coalesce(avg(a), 0), 6) AS mean_abs, round(coalesce(max(a), 0), 6) AS max_abs FROM g LEFT JOIN b ON g.family = b.family AND g.bucket = b.bucket GROUP BY 1, 2""")
def _(v):
    return A.appearance_buckets(v.weights)


@query("a05_split_balance", """WITH s AS (SELECT match_id, source, winner, uploader, CASE WHEN match_id % 5 = 0 THEN 'test' ELSE 'train' END AS split FROM valid)
SELECT split, source, count(*) AS n, count(DISTINCT uploader) AS groups, count(*) FILTER (winner = 1) AS side1, count(*) FILTER (winner = 2) AS side2 FROM s GROUP BY 1, 2 UNION ALL
SELECT split, 'all', count(*), count(DISTINCT uploader), count(*) FILTER (winner = 1), count(*) FILTER (winner = 2) FROM s GROUP BY 1""")
def _(v):
    s = v.valid.withColumn("split", F.expr("if(match_id % 5 = 0, 'test', 'train')"))
    return A.split_balance(s, "uploader")


@query("a06_round_counts", """WITH r AS (SELECT unnest(range(1, 11)) AS round)
SELECT CAST(r.round AS INT) AS round, count(event_id) AS events, count(*) FILTER (chosen = recommended) AS accepted, count(*) FILTER (chosen = 0) AS chosen0, count(*) FILTER (chosen = 1) AS chosen1, count(*) FILTER (chosen = 2) AS chosen2, count(*) FILTER (recommended = 0) AS rec0, count(*) FILTER (recommended = 1) AS rec1, count(*) FILTER (recommended = 2) AS rec2 FROM r LEFT JOIN choice c ON r.round = c.round GROUP BY 1""")
def _(v):
    return A.round_counts(v.events)


@query("a07_item_offers_and_picks", "SELECT round_type, item, count(*) AS offers, count(DISTINCT event_id) AS events, count(*) FILTER (option = chosen) AS picks, (SELECT count(*) FROM choice c WHERE c.round_type = o.round_type) AS opportunities FROM offers o GROUP BY 1, 2")
def _(v):
    return A.item_counts(v.events, v.offers)


_MARGIN = "m AS (SELECT *, greatest(score0, score1, score2) - list_sort([score0, score1, score2])[2] AS margin FROM choice)"


@query("a08_margin_buckets", f"""WITH {_MARGIN} SELECT CASE WHEN margin = 0 THEN 'tie' WHEN margin <= 1 THEN '0-1' WHEN margin <= 3 THEN '1-3' ELSE 'over 3' END AS bucket, count(*) AS n, count(*) FILTER (chosen = recommended) AS accepted FROM (SELECT * REPLACE (round(margin, 6) AS margin) FROM m) GROUP BY 1""")
def _(v):
    return A.margin_buckets(v.events)


@query("a09_bounded_versions", """WITH c AS (SELECT 'u' || user_id AS version, count(*) AS n FROM choice GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, version) AS rn FROM c)
SELECT CASE WHEN rn > 31 OR n < 10 THEN 'other' ELSE version END AS version, CAST(sum(n) AS BIGINT) AS n FROM r GROUP BY 1""")
def _(v):
    return A.bounded_counts(v.events.select(F.concat(F.lit("u"), F.col("user_id")).alias("version")), "version", floor=10, most=31)


@query("a10_distinct_sessions", "SELECT count(DISTINCT session) AS sessions, count(*) AS events FROM choice")
def _(v):
    return v.events.agg(F.count_distinct("session").alias("sessions"), F.count(F.lit(1)).alias("events"))


_HLL = """h AS (SELECT DISTINCT sha256(session) AS h FROM choice), b AS (SELECT CAST('0x' || substr(h, 1, 3) AS BIGINT) AS i, CAST('0x' || substr(h, 4, 13) AS BIGINT) AS low FROM h),
rg AS (SELECT CAST(i >> 2 AS BIGINT) AS register, max(CASE WHEN ((i & 3) << 52 | low) = 0 THEN 55 ELSE 55 - length(bin((i & 3) << 52 | low)) END) AS rank FROM b GROUP BY 1)"""


@query("a10_hll_registers", f"WITH {_HLL} SELECT register, rank FROM rg")
def _(v):
    return A.hll_registers(v.events, "session")


@query("a10_estimated_sessions", f"""WITH {_HLL}, e AS (SELECT count(*) AS filled, sum(2e0 ** -rank) + 1024 - count(*) AS weight FROM rg), r AS (SELECT *, 0.7213e0 / (1 + 1.079e0 / 1024) * 1024 * 1024 / weight AS raw FROM e)
SELECT least(CAST(round(CASE WHEN raw <= 2560 AND filled < 1024 THEN 1024 * ln(1024e0 / (1024 - filled)) ELSE raw END) AS BIGINT), (SELECT count(*) FROM choice)) AS estimate, filled AS registers FROM r""")
def _(v):
    """Registers folded by their maximum over the micro-batches of a stream, then the estimate."""
    register, rank = A.hll_rank("session")
    f = Z.Fold(v.spark, ["register"], {"rank": F.col("rank").cast("long")}, how=F.max)
    Z.drain(Z.read(v.spark, Z.landing(v.events.select("event_id", "session"), "event_id")).select(register.alias("register"), rank.alias("rank")), f.apply)
    return A.hll_estimate(f.state(), v.events.agg(F.count(F.lit(1)).alias("n")))


@query("a10_hll_sketch")
def _(v):
    return v.events.agg(F.hll_sketch_estimate(F.hll_sketch_agg("session", F.lit(10))).alias("estimate"))


@query("a11_contributors", "SELECT uploader_name, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, uploader_name) AS rank FROM submissions WHERE trim(uploader_name) <> '' AND n1 = 3 AND n2 = 3 GROUP BY 1")
def _(v):
    return A.leaderboard(v.submissions.filter("n1 = 3 AND n2 = 3"), "uploader_name")


@query("a12_processed_totals", "SELECT count(*) AS processed, count(*) FILTER (n1 = 3 AND n2 = 3) AS accepted, count(*) FILTER (NOT (n1 = 3 AND n2 = 3)) AS rejected, max(received_at) FILTER (n1 = 3 AND n2 = 3) AS last_valid, arg_max(id, received_at::VARCHAR || lpad(id::VARCHAR, 20, '0')) AS last_id FROM submissions")
def _(v):
    ok = F.expr("n1 = 3 AND n2 = 3")
    return v.submissions.agg(F.count(F.lit(1)).alias("processed"), F.count_if(ok).alias("accepted"), F.count_if(~ok).alias("rejected"), F.max(F.when(ok, F.col("received_at"))).alias("last_valid"), F.max_by("id", F.struct("received_at", "id")).alias("last_id"))


_PRED = "pr AS (SELECT event_id, exp(score0 - mx) / (exp(score0 - mx) + exp(score1 - mx) + exp(score2 - mx)) AS p0, exp(score1 - mx) / (exp(score0 - mx) + exp(score1 - mx) + exp(score2 - mx)) AS p1, exp(score2 - mx) / (exp(score0 - mx) + exp(score1 - mx) + exp(score2 - mx)) AS p2, chosen, recommended, round, session FROM (SELECT *, greatest(score0, score1, score2) AS mx FROM choice))"


@query("a13_calibration", f"""WITH {_PRED}, c AS (SELECT greatest(p0, p1, p2) AS conf, CASE WHEN chosen = recommended THEN 1 ELSE 0 END AS hit FROM pr)
SELECT CAST(least(9, floor(conf * 10)) AS INT) AS bin, count(*) AS n, round(avg(conf), 6) AS confidence, round(avg(hit), 6) AS accuracy, round(abs(sum(hit) - sum(conf)) / (SELECT count(*) FROM c), 6) AS ece_part FROM c GROUP BY 1""")
def _(v):
    return A.calibration(v.events)


@query("a14_suppressed_rates", "SELECT round_type, item, count(*) AS offers, count(*) < 10 AS suppressed, CASE WHEN count(*) < 10 THEN NULL ELSE round(count(*) FILTER (option = chosen) / count(*), 6) END AS pick_rate FROM offers GROUP BY 1, 2")
def _(v):
    return A.suppressed(v.offers)


@query("a15_preference_disagreement", f"""WITH {_PRED}, t AS (SELECT round, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS top, greatest(p0, p1, p2) - list_sort([p0, p1, p2])[2] AS margin, recommended, chosen FROM pr)
SELECT round, count(*) FILTER (top <> chosen) AS differs, count(*) FILTER (top <> chosen AND margin >= 0.1) AS meaningful, count(*) FILTER (top = chosen) AS agrees, CASE WHEN count(*) >= 10 THEN round(avg(margin), 6) END AS mean_margin FROM t GROUP BY 1""")
def _(v):
    return A.disagreement(v.events)


@query("a16_snapshot_summary", "SELECT season, count(DISTINCT id) AS ids, count(*) AS appearances, count(*) - count(DISTINCT id) AS repeats FROM snapshots GROUP BY 1")
def _(v):
    return v.snapshots.groupBy("season").agg(F.count_distinct("id").alias("ids"), F.count(F.lit(1)).alias("appearances"), (F.count(F.lit(1)) - F.count_distinct("id")).alias("repeats"))


@query("a17_corpus_counts", "SELECT source, season, count(*) AS n, count(*) FILTER (winner = 1) AS side1, count(*) FILTER (winner = 2) AS side2, count(*) FILTER (n1 <> 3 OR n2 <> 3) AS invalid FROM matches GROUP BY 1, 2")
def _(v):
    return v.matches.groupBy("source", "season").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("winner = 1")).alias("side1"), F.count_if(F.expr("winner = 2")).alias("side2"), F.count_if(F.expr("n1 <> 3 OR n2 <> 3")).alias("invalid"))


