"""Batch scoring and recommendation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import scoring as R
from matchloom.plans.registry import query

_ST = "st AS (SELECT match_id, side, round(sum(coalesce(weight, 0)), 6) AS strength, count(weight) AS n_known, CAST(sum(support) AS BIGINT) AS total_support, min(support) AS least_support FROM features LEFT JOIN weights USING (family, key) GROUP BY 1, 2)"


def _strength(v):
    return R.team_strength(v.features, v.weights)


@query("r01_team_strength", f"WITH {_ST} SELECT match_id, side, strength FROM st")
def _(v):
    return _strength(v).select("match_id", "side", "strength")


@query("r02_win_share", f"""WITH {_ST}, p AS (SELECT a.match_id, CAST(round(100 / (1 + exp(-(a.strength - b.strength)))) AS INT) AS s, least(a.n_known, b.n_known) < 10 AS low FROM st a JOIN st b ON a.match_id = b.match_id AND a.side = 1 AND b.side = 2)
SELECT match_id, s AS share1, 100 - s AS share2, s = 50 AS tie, (s > 50 AND winner = 2) OR (s < 50 AND winner = 1) AS upset, low AS low_evidence FROM p JOIN valid USING (match_id)""")
def _(v):
    return R.win_share(_strength(v), v.valid)


@query("r03_evidence", f"WITH {_ST} SELECT match_id, side, n_known, total_support, least_support FROM st")
def _(v):
    return _strength(v).drop("strength")


_HG = """fr AS (SELECT DISTINCT event_id, option, item FROM offers WHERE round_type = 'hero' AND NOT EXISTS (SELECT 1 FROM pool p WHERE p.event_id = offers.event_id AND p.pool_item = offers.item)),
hf AS (SELECT event_id, option, 'H' AS family, item AS key FROM fr UNION SELECT f.event_id, option, 'HP', least(item, pool_item) || '|' || greatest(item, pool_item) FROM fr f JOIN pool p ON f.event_id = p.event_id AND pool_type = 'hero' UNION SELECT a.event_id, a.option, 'HP', a.item || '|' || b.item FROM fr a JOIN fr b ON a.event_id = b.event_id AND a.option = b.option AND a.item < b.item),
hg AS (SELECT event_id, option, round(sum(coalesce(weight, 0)), 6) AS gain, count(weight) AS evidence FROM hf LEFT JOIN weights USING (family, key) GROUP BY 1, 2)"""


@query("r04_hero_gain", f"WITH {_HG} SELECT * FROM hg")
def _(v):
    return R.hero_gain(v.offers, v.pool, v.weights)


_BH = """so AS (SELECT DISTINCT event_id, option, item FROM offers WHERE round_type = 'skill'), bh AS (SELECT * FROM (SELECT s.event_id, option, item, pool_item AS hero, coalesce(weight, 0) AS routed, row_number() OVER (PARTITION BY s.event_id, option, item ORDER BY coalesce(weight, 0) DESC, pool_item) AS rn FROM so s JOIN pool p ON s.event_id = p.event_id AND pool_type = 'hero' LEFT JOIN weights w ON w.family = 'HS' AND w.key = pool_item || '|' || item) WHERE rn = 1),
sg AS (SELECT so.event_id, so.option, round(sum(coalesce(weight, 0) + coalesce(routed, 0)), 6) AS gain, count(weight) AS evidence FROM so LEFT JOIN bh ON so.event_id = bh.event_id AND so.option = bh.option AND so.item = bh.item LEFT JOIN weights w ON w.family = 'S' AND w.key = so.item GROUP BY 1, 2)"""


def _skill_offers(v):
    return v.offers.filter("round_type = 'skill'")


@query("r05_skill_routes", f"WITH {_BH} SELECT event_id, option, item, hero, routed FROM bh")
def _(v):
    return R.best_hero_for_skill(_skill_offers(v), v.pool, v.weights)


@query("r05_skill_gain", f"WITH {_BH} SELECT * FROM sg")
def _(v):
    return R.skill_gain(_skill_offers(v), v.pool, v.weights)


@query("r06_ranked_options", f"WITH {_HG} SELECT event_id, option, CAST(row_number() OVER (PARTITION BY event_id ORDER BY gain DESC, evidence DESC, option) AS INT) AS rank FROM hg")
def _(v):
    return R.rank_options(R.hero_gain(v.offers, v.pool, v.weights)).select("event_id", "option", "rank")


_R07 = """tm AS (SELECT match_id, side, hero FROM members WHERE slot <= 2), t2 AS (SELECT match_id, side, min(hero) AS a, max(hero) AS b FROM tm GROUP BY 1, 2), ca AS (SELECT match_id, side, a, b, h.hero FROM t2 CROSS JOIN heroes h WHERE h.hero <> a AND h.hero <> b),
sk AS (SELECT DISTINCT match_id, side, skill FROM carried WHERE slot <= 2), ro AS (SELECT match_id, side, split_part(key, '|', 1) AS hero, weight FROM sk JOIN weights ON family = 'HS' AND split_part(key, '|', 2) = skill WHERE weight > 0), r2 AS (SELECT match_id, side, hero, sum(weight) AS routed FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side, hero ORDER BY weight DESC) AS rn FROM ro) WHERE rn <= 2 GROUP BY 1, 2, 3),
ad AS (SELECT match_id, side, ca.hero, round(coalesce(w.weight, 0) + coalesce(p.weight, 0) + coalesce(q.weight, 0) + coalesce(routed, 0), 6) AS gain, coalesce(w.support, 0) AS support FROM ca LEFT JOIN weights w ON w.family = 'H' AND w.key = ca.hero LEFT JOIN weights p ON p.family = 'HP' AND p.key = least(ca.hero, a) || '|' || greatest(ca.hero, a) LEFT JOIN weights q ON q.family = 'HP' AND q.key = least(ca.hero, b) || '|' || greatest(ca.hero, b) LEFT JOIN r2 USING (match_id, side, hero)),
rk AS (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY gain DESC, support DESC, hero) AS rn FROM ad)"""


def _additions(v):
    t = v.members.filter("slot <= 2").groupBy("match_id", "side").agg(F.min("hero").alias("a"), F.max("hero").alias("b"))
    c = t.crossJoin(F.broadcast(v.heroes.select("hero"))).filter("hero <> a AND hero <> b")  # a candidate for each hero of the catalog
    h = v.weights.filter("family = 'H'").select(F.col("key").alias("hero"), F.col("weight").alias("w"), "support")
    p = v.weights.filter("family = 'HP'").select("key", "weight")
    c = c.join(h, "hero", "left")
    for x in "ab":
        c = c.join(p.select(F.col("key").alias(f"k{x}"), F.col("weight").alias(f"w{x}")), R.pair_key("hero", x) == F.col(f"k{x}"), "left")
    c = c.join(R.best_routes(v.carried.filter("slot <= 2"), v.weights, ["match_id", "side"]), ["match_id", "side", "hero"], "left")
    gain = F.round(sum((F.coalesce(x, F.lit(0.0)) for x in ("w", "wa", "wb", "routed")), F.lit(0.0)), 6)
    return c.select("match_id", "side", "hero", gain.alias("gain"), F.coalesce("support", F.lit(0)).alias("support"))


@query("r07_best_addition", f"WITH {_R07} SELECT match_id, side, hero, gain FROM rk WHERE rn = 1")
def _(v):
    t = _additions(v).groupBy("match_id", "side").agg(F.min(F.struct((-F.col("gain")).alias("g"), (-F.col("support")).alias("s"), "hero")).alias("m"))
    return t.select("match_id", "side", F.col("m.hero").alias("hero"), (-F.col("m.g")).alias("gain"))


_R08 = """sk AS (SELECT DISTINCT event_id, item AS skill FROM offers WHERE round_type = 'skill'), ph AS (SELECT event_id, pool_item AS hero FROM pool WHERE pool_type = 'hero'), rt AS (SELECT event_id, skill, hero, coalesce(weight, 0) AS w FROM sk JOIN ph USING (event_id) LEFT JOIN weights ON family = 'HS' AND key = hero || '|' || skill),
pr AS (SELECT x.event_id, x.skill AS a, y.skill AS b FROM sk x JOIN sk y ON x.event_id = y.event_id AND x.skill < y.skill),
sm AS (SELECT p.event_id, p.a, p.b, max(x.w + y.w + coalesce(z.weight, 0)) AS same, max_by(coalesce(z.weight, 0), x.w + y.w + coalesce(z.weight, 0)) AS synergy FROM pr p JOIN rt x ON x.event_id = p.event_id AND x.skill = p.a JOIN rt y ON y.event_id = p.event_id AND y.skill = p.b AND y.hero = x.hero LEFT JOIN weights z ON z.family = 'SP' AND z.key = x.hero || '|' || p.a || '|' || p.b GROUP BY 1, 2, 3),
sl AS (SELECT p.event_id, p.a, p.b, max(x.w + y.w) AS split FROM pr p JOIN rt x ON x.event_id = p.event_id AND x.skill = p.a JOIN rt y ON y.event_id = p.event_id AND y.skill = p.b AND y.hero <> x.hero GROUP BY 1, 2, 3),
sc AS (SELECT event_id, p.a, p.b, round(coalesce(u.weight, 0) + coalesce(t.weight, 0) + greatest(0, coalesce(same, 0), coalesce(split, 0)), 6) AS score FROM pr p LEFT JOIN sm USING (event_id, a, b) LEFT JOIN sl USING (event_id, a, b) LEFT JOIN weights u ON u.family = 'S' AND u.key = p.a LEFT JOIN weights t ON t.family = 'S' AND t.key = p.b)"""


@query("r08_best_skill_pair", f"WITH {_R08} SELECT event_id, a, b, score FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, a, b) AS rn FROM sc) WHERE rn = 1")
def _(v):
    return R.best_skill_pair(_skill_offers(v), v.pool, v.weights)


@query("r09_roster_score", "SELECT match_id, side, round(sum(coalesce(weight, 0)), 6) AS score FROM features LEFT JOIN weights USING (family, key) WHERE family IN ('H', 'HP', 'HS') GROUP BY 1, 2")
def _(v):
    return R.team_strength(v.features.filter("family IN ('H', 'HP', 'HS')"), v.weights).select("match_id", "side", F.col("strength").alias("score"))


_OWN = """oh AS (SELECT DISTINCT session, item AS hero FROM picks WHERE round_type = 'hero'), os AS (SELECT DISTINCT session, item AS skill FROM picks WHERE round_type = 'skill')"""


def _owned(v):
    """Heroes and skills that a session has picked."""
    own = lambda kind, name: v.picks.filter(F.col("round_type") == kind).select("session", F.col("item").alias(name)).distinct()
    return own("hero", "hero"), own("skill", "skill")


@query("r09_current_score", f"""WITH {_OWN}, bh AS (SELECT session, skill, max(coalesce(weight, 0)) AS routed FROM os JOIN oh USING (session) LEFT JOIN weights ON family = 'HS' AND key = hero || '|' || skill GROUP BY 1, 2),
pt AS (SELECT session, coalesce(weight, 0) AS w FROM oh LEFT JOIN weights ON family = 'H' AND key = hero UNION ALL SELECT a.session, coalesce(weight, 0) FROM oh a JOIN oh b ON a.session = b.session AND a.hero < b.hero LEFT JOIN weights ON family = 'HP' AND key = a.hero || '|' || b.hero UNION ALL SELECT session, coalesce(weight, 0) FROM os LEFT JOIN weights ON family = 'S' AND key = skill UNION ALL SELECT session, routed FROM bh)
SELECT session, round(sum(w), 6) AS score FROM pt GROUP BY 1""")
def _(v):
    return R.current_score(*_owned(v), v.weights)


_TRIO = """po AS (SELECT DISTINCT match_id AS pool_id, hero FROM members), tr AS (SELECT pool_id, a.hero AS a, b.hero AS b, c.hero AS c FROM po a JOIN po b USING (pool_id) JOIN po c USING (pool_id) WHERE a.hero < b.hero AND b.hero < c.hero),
ts AS (SELECT pool_id, a, b, c, round(coalesce(x.weight, 0) + coalesce(y.weight, 0) + coalesce(z.weight, 0) + coalesce(p.weight, 0) + coalesce(q.weight, 0) + coalesce(r.weight, 0), 6) AS strength, ha.camp = hb.camp AND hb.camp = hc.camp AS same_camp FROM tr JOIN heroes ha ON ha.hero = a JOIN heroes hb ON hb.hero = b JOIN heroes hc ON hc.hero = c LEFT JOIN weights x ON x.family = 'H' AND x.key = a LEFT JOIN weights y ON y.family = 'H' AND y.key = b LEFT JOIN weights z ON z.family = 'H' AND z.key = c LEFT JOIN weights p ON p.family = 'HP' AND p.key = a || '|' || b LEFT JOIN weights q ON q.family = 'HP' AND q.key = a || '|' || c LEFT JOIN weights r ON r.family = 'HP' AND r.key = b || '|' || c),
tk AS (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY strength DESC, a, b, c) AS rn FROM ts), dp AS (SELECT x.pool_id, x.a || ',' || x.b || ',' || x.c AS first, y.a || ',' || y.b || ',' || y.c AS second, round(x.strength + y.strength, 6) AS total, x.rn AS r1, y.rn AS r2 FROM tk x JOIN tk y ON x.pool_id = y.pool_id AND x.rn < y.rn AND x.rn <= 20 AND y.rn <= 20 AND x.a NOT IN (y.a, y.b, y.c) AND x.b NOT IN (y.a, y.b, y.c) AND x.c NOT IN (y.a, y.b, y.c)),
dr AS (SELECT pool_id, first, second, total, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY total DESC, r1, r2) AS INT) AS rank FROM dp)"""


def _by_set(v, form):
    """What ``form`` makes of a pool's trios, for the heroes of each match."""
    return R.by_set(v.members.select(F.col("match_id").alias("pool_id"), "hero"), lambda p: form(R.trios(p, v.weights, v.heroes)))


@query("r10_trio_strength", f"WITH {_TRIO} SELECT pool_id, a, b, c, strength, same_camp FROM ts")
def _(v):
    return _by_set(v, lambda t: t)


@query("r11_disjoint_trios", f"WITH {_TRIO} SELECT * FROM dr WHERE rank <= 16")
def _(v):
    return _by_set(v, lambda t: R.disjoint_pairs(t, 20, 16))


@query("r12_band", f"WITH {_TRIO}, b AS (SELECT *, max(total) OVER (PARTITION BY pool_id) AS best FROM dr WHERE rank <= 16) SELECT pool_id, first, second, total, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY total DESC, first, second) AS INT) AS place FROM b WHERE total >= round(best - 0.1, 6)")
def _(v):
    return _by_set(v, lambda t: R.band(R.disjoint_pairs(t, 20, 16), 0.1))


#: Pools of the heroes of eight matches, fifteen at most, and the disjoint pairs of their trios.
_LARGE = _TRIO.replace("po AS (SELECT DISTINCT match_id AS pool_id, hero FROM members)", "po AS (SELECT pool_id, hero FROM (SELECT pool_id, hero, row_number() OVER (PARTITION BY pool_id ORDER BY hero) AS rn FROM (SELECT DISTINCT match_id // 8 AS pool_id, hero FROM members)) WHERE rn <= 15)").replace(" AND x.rn <= 20 AND y.rn <= 20", "")


#: All heroes of eight matches, and their trios.
_WHOLE = _TRIO.partition(", dp AS (")[0].replace("po AS (SELECT DISTINCT match_id AS pool_id, hero FROM members)", "po AS (SELECT DISTINCT match_id // 8 AS pool_id, hero FROM members)")


def _large_pools(v, most=None):
    return R.pool_weights(v.members.select(F.expr("match_id div 8").alias("pool_id"), "hero").distinct(), v.weights, most)


@query("r10_large_pools", f"WITH {_WHOLE} SELECT pool_id, count(*) AS trios, max(CASE WHEN rn = 1 THEN a || ',' || b || ',' || c END) AS best, max(strength) AS strength FROM tk GROUP BY 1")
def _(v):
    return R.large_pool_trios(_large_pools(v))


@query("r11_large_pools", f"WITH {_LARGE} SELECT * FROM dr WHERE rank <= 160")
def _(v):
    return R.large_pool_pairs(_large_pools(v, R.POOL))


@query("r12_large_pools", f"WITH {_LARGE}, b AS (SELECT *, max(total) OVER (PARTITION BY pool_id) AS best FROM dr WHERE rank <= 160) SELECT pool_id, first, second, total, CAST(row_number() OVER (PARTITION BY pool_id ORDER BY total DESC, first, second) AS INT) AS place FROM b WHERE total >= round(best - 0.1, 6)")
def _(v):
    return R.band(R.large_pool_pairs(_large_pools(v, R.POOL)), 0.1)


@query("r13_diverse_three", f"""WITH {_TRIO}, l AS (SELECT pool_id, [a, b, c] AS t, strength FROM ts), c1 AS (SELECT pool_id, t, strength, 0 AS overlap FROM (SELECT *, row_number() OVER (PARTITION BY pool_id ORDER BY strength DESC, t) AS rn FROM l) WHERE rn = 1),
c2 AS (SELECT pool_id, t, strength, overlap FROM (SELECT l.pool_id, l.t, l.strength, len(list_filter(c1.t, lambda x: list_contains(l.t, x))) AS overlap, row_number() OVER (PARTITION BY l.pool_id ORDER BY len(list_filter(c1.t, lambda x: list_contains(l.t, x))), l.strength DESC, l.t) AS rn FROM l JOIN c1 ON l.pool_id = c1.pool_id AND l.t <> c1.t) WHERE rn = 1),
c3 AS (SELECT pool_id, t, strength, overlap FROM (SELECT l.pool_id, l.t, l.strength, len(list_filter(c1.t || c2.t, lambda x: list_contains(l.t, x))) AS overlap, row_number() OVER (PARTITION BY l.pool_id ORDER BY len(list_filter(c1.t || c2.t, lambda x: list_contains(l.t, x))), l.strength DESC, l.t) AS rn FROM l JOIN c1 ON l.pool_id = c1.pool_id AND l.t <> c1.t JOIN c2 ON l.pool_id = c2.pool_id AND l.t <> c2.t) WHERE rn = 1)
SELECT pool_id, 1 AS place, array_to_string(t, ',') AS trio, strength, CAST(overlap AS INT) AS overlap FROM c1 UNION ALL SELECT pool_id, 2, array_to_string(t, ','), strength, CAST(overlap AS INT) FROM c2 UNION ALL SELECT pool_id, 3, array_to_string(t, ','), strength, CAST(overlap AS INT) FROM c3""")
def _(v):
    return _by_set(v, R.diverse_three)


@query("r14_camp_bonus_and_bonds", "WITH c AS (SELECT match_id, side, camp, count(*) AS n FROM members JOIN heroes USING (hero) GROUP BY 1, 2, 3), b AS (SELECT match_id, side, bond, count(*) AS n FROM members JOIN heroes USING (hero) GROUP BY 1, 2, 3) SELECT match_id, side, CASE max(c.n) WHEN 3 THEN 0.1e0 WHEN 2 THEN 0.05e0 ELSE 0e0 END AS bonus, (SELECT count(*) FROM b WHERE b.match_id = c.match_id AND b.side = c.side AND b.n >= 2) AS bonds FROM c GROUP BY 1, 2")
def _(v):
    t = v.members.join(F.broadcast(v.heroes.select("hero", "camp", "bond")), "hero")
    c = t.groupBy("match_id", "side", "camp").agg(F.count(F.lit(1)).alias("n")).groupBy("match_id", "side").agg(F.max("n").alias("most"))
    b = t.groupBy("match_id", "side", "bond").agg(F.count(F.lit(1)).alias("n")).groupBy("match_id", "side").agg(F.count_if(F.col("n") >= 2).alias("bonds"))
    return c.join(b, ["match_id", "side"]).select("match_id", "side", F.when(F.col("most") == 3, 0.1).when(F.col("most") == 2, 0.05).otherwise(0.0).alias("bonus"), "bonds")


@query("r14_added_hero", """WITH tm AS (SELECT match_id, side, hero FROM members WHERE slot <= 2), c0 AS (SELECT match_id, side, camp, count(*) AS n FROM tm JOIN heroes USING (hero) GROUP BY 1, 2, 3), before AS (SELECT match_id, side, max(n) AS most FROM c0 GROUP BY 1, 2), ca AS (SELECT t.match_id, t.side, h.hero, h.camp, h.bond FROM (SELECT DISTINCT match_id, side FROM tm) t CROSS JOIN heroes h WHERE NOT EXISTS (SELECT 1 FROM tm WHERE tm.match_id = t.match_id AND tm.side = t.side AND tm.hero = h.hero)),
b0 AS (SELECT match_id, side, bond, count(*) AS n FROM tm JOIN heroes USING (hero) GROUP BY 1, 2, 3)
SELECT ca.match_id, ca.side, ca.hero, CASE WHEN most >= 3 THEN 0.1e0 WHEN most = 2 THEN 0.05e0 ELSE 0e0 END AS bonus_before, CASE WHEN greatest(most, coalesce(c0.n, 0) + 1) >= 3 THEN 0.1e0 WHEN greatest(most, coalesce(c0.n, 0) + 1) = 2 THEN 0.05e0 ELSE 0e0 END AS bonus_after, coalesce(b0.n, 0) = 1 AS bond_activated
FROM ca JOIN before USING (match_id, side) LEFT JOIN c0 ON c0.match_id = ca.match_id AND c0.side = ca.side AND c0.camp = ca.camp LEFT JOIN b0 ON b0.match_id = ca.match_id AND b0.side = ca.side AND b0.bond = ca.bond""")
def _(v):
    """What each further hero changes for the first two of a side; a bond needs two of its members."""
    return R.added_hero(v.members.filter("slot <= 2"), v.heroes, required=2)


@query("r15_top_candidates", f"WITH {_R07} SELECT match_id, side, hero, gain, CAST(rn AS INT) AS rank FROM rk WHERE rn <= 10")
def _(v):
    w = Window.partitionBy("match_id", "side").orderBy(F.desc("gain"), F.desc("support"), "hero")
    return _additions(v).withColumn("rank", F.row_number().over(w)).filter("rank <= 10").drop("support")


#: A guide's member carries two slots of alternative skills.
_SLOTS = "gs AS (SELECT place, tier, champion, hero, unnest([1, 2]) AS slot, unnest([['K' || (num % 30), 'K' || ((num + 7) % 30)], ['K' || ((num + 11) % 30)]]) AS skills FROM guide_members JOIN heroes USING (hero))"
_GUIDE = f"""{_OWN}, ch AS (SELECT DISTINCT session, item AS hero FROM offers WHERE round_type = 'hero'), cs AS (SELECT DISTINCT session, item AS skill FROM offers WHERE round_type = 'skill'), {_SLOTS},
hc AS (SELECT session, place, count(*) FILTER (owned) AS owned, count(*) FILTER (NOT owned) AS offered FROM (SELECT session, g.place, g.hero, bool_or(o) AS owned FROM (SELECT session, hero, true AS o FROM oh UNION ALL SELECT session, hero, false FROM ch) x JOIN guide_members g USING (hero) GROUP BY 1, 2, 3) GROUP BY 1, 2),
sc AS (SELECT session, place, count(*) FILTER (owned) AS owned_slots, count(*) FILTER (NOT owned) AS offered_slots FROM (SELECT session, place, hero, slot, bool_or(o) AS owned FROM (SELECT session, skill, true AS o FROM os UNION ALL SELECT session, skill, false FROM cs) x JOIN (SELECT place, hero, slot, unnest(skills) AS skill FROM gs) USING (skill) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2),
gr AS (SELECT session, place, owned, offered, coalesce(owned_slots, 0) AS owned_slots, coalesce(offered_slots, 0) AS offered_slots FROM hc LEFT JOIN sc USING (session, place))"""


def _slots(v):
    k = lambda n: F.concat(F.lit("K"), (F.col("num") + n) % 30)
    slots = F.array(F.struct(F.lit(1).alias("slot"), F.array(k(0), k(7)).alias("skills")), F.struct(F.lit(2).alias("slot"), F.array(k(11)).alias("skills")))
    return v.guide_members.join(v.heroes.select("hero", "num"), "hero").select("place", "hero", F.explode(slots).alias("x")).select("place", "hero", "x.slot", "x.skills")


def _relevance(v):
    offered = lambda kind, name: v.offers.filter(F.col("round_type") == kind).select("session", F.col("item").alias(name)).distinct()
    return R.guide_relevance(*_owned(v), offered("hero", "hero"), offered("skill", "skill"), v.guide_members.select("place", "hero"), _slots(v))


@query("r16_guide_relevance", f"WITH {_GUIDE} SELECT session, place, owned, offered, owned_slots, offered_slots, owned >= 1 AS owned_only, owned = 3 AS all_owned FROM gr")
def _(v):
    """Guides that share a hero with what is owned or offered; the modes of selection as flags."""
    return _relevance(v).withColumn("owned_only", F.col("owned") >= 1).withColumn("all_owned", F.col("owned") == 3)


@query("r17_guide_order", "SELECT roster, tier, row_number() OVER (ORDER BY champion DESC, CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, place) AS pos FROM guide WHERE tier IN ('S', 'A')")
def _(v):
    tier = F.when(F.col("tier") == "S", 0).when(F.col("tier") == "A", 1).otherwise(2)
    return v.guide.filter("tier IN ('S', 'A')").withColumn("pos", F.row_number().over(Window.orderBy(F.desc("champion"), tier, "place")).cast("long")).select("roster", "tier", "pos")


@query("r18_distinct_rosters", "SELECT roster, min(match_id) AS first_match FROM rosters WHERE won = 1 GROUP BY 1")
def _(v):
    w = Window.partitionBy("roster").orderBy("match_id")
    return v.rosters.filter("won = 1").withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("roster", F.col("match_id").alias("first_match"))


@query("r18_skill_shortlist", "SELECT session, item, CAST(rn AS INT) AS rank FROM (SELECT session, item, row_number() OVER (PARTITION BY session ORDER BY n DESC, item) AS rn FROM (SELECT session, item, count(*) AS n FROM offers WHERE round_type = 'skill' GROUP BY 1, 2)) WHERE rn <= 4")
def _(v):
    t = _skill_offers(v).groupBy("session", "item").agg(F.count(F.lit(1)).alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("n"), "item"))).filter("rank <= 4").select("session", "item", "rank")


@query("r19_partial_guides", f"""WITH {_OWN}, {_SLOTS}, ok AS (SELECT DISTINCT session, place, hero, slot FROM (SELECT session, place, hero, slot, unnest(skills) AS skill FROM oh JOIN gs USING (hero)) x JOIN os USING (session, skill) JOIN weights w ON w.family = 'HS' AND w.key = hero || '|' || skill AND w.weight > 0),
kn AS (SELECT session, place, champion, tier, count(*) AS owned FROM oh JOIN guide_members USING (hero) GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2), us AS (SELECT session, place, count(*) AS usable FROM ok GROUP BY 1, 2)
SELECT session, place, owned, coalesce(usable, 0) AS usable, CAST(row_number() OVER (PARTITION BY session ORDER BY owned DESC, coalesce(usable, 0) DESC, champion DESC, CASE tier WHEN 'S' THEN 0 WHEN 'A' THEN 1 ELSE 2 END, place) AS INT) AS rank FROM kn LEFT JOIN us USING (session, place)""")
def _(v):
    """Guides of which a session owns two heroes or more, with the slots that its skills can fill by a positive route."""
    return R.partial_guides(*_owned(v), v.guide_members, _slots(v), v.weights)


_MATRIX = "mx AS (SELECT a.hero AS r, b.hero AS c, sum(a.won) AS w, count(*) AS n FROM members a JOIN members b ON a.match_id = b.match_id AND a.side <> b.side AND a.slot = 1 AND b.slot = 1 GROUP BY 1, 2)"


@query("r20_matchup_matrix", f"WITH {_MATRIX} SELECT x.r AS row_id, x.c AS col_id, CASE WHEN x.r = x.c THEN 'self' WHEN 2 * x.w > x.n THEN 'win' WHEN 2 * x.w < x.n THEN 'loss' ELSE 'even' END AS outcome, x.w + y.w = x.n AS reciprocal FROM mx x JOIN mx y ON x.r = y.c AND x.c = y.r")
def _(v):
    m = v.members.filter("slot = 1").select("match_id", "side", "hero", "won")
    o = m.select("match_id", F.col("side").alias("s2"), F.col("hero").alias("col_id"))
    t = m.join(o, "match_id").filter("side <> s2").groupBy(F.col("hero").alias("row_id"), "col_id").agg(F.sum("won").alias("w"), F.count(F.lit(1)).alias("n"))
    back = t.select(F.col("row_id").alias("c2"), F.col("col_id").alias("r2"), F.col("w").alias("w2"))
    out = F.when(F.col("row_id") == F.col("col_id"), "self").when(2 * F.col("w") > F.col("n"), "win").when(2 * F.col("w") < F.col("n"), "loss").otherwise("even")
    return t.join(back, (F.col("row_id") == F.col("r2")) & (F.col("col_id") == F.col("c2"))).select("row_id", "col_id", out.alias("outcome"), (F.col("w") + F.col("w2") == F.col("n")).alias("reciprocal"))


@query("r21_skill_pair_evidence", "SELECT hero, key, weight, CAST(rn AS INT) AS rank FROM (SELECT split_part(key, '|', 1) AS hero, key, weight, row_number() OVER (PARTITION BY split_part(key, '|', 1) ORDER BY abs(weight) DESC, key) AS rn FROM weights WHERE family = 'HS') WHERE rn <= 40")
def _(v):
    t = v.weights.filter("family = 'HS'").withColumn("hero", F.split_part("key", F.lit("|"), F.lit(1)))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("hero").orderBy(F.desc(F.abs("weight")), "key"))).filter("rank <= 40").select("hero", "key", "weight", "rank")


@query("r22_pool_by_round", "SELECT event_id, count(pool_item) AS n, string_agg(pool_item, ',' ORDER BY pool_item) AS items FROM choice LEFT JOIN pool USING (event_id) GROUP BY 1")
def _(v):
    own = v.picks.groupBy("event_id", "session", "round").agg(F.collect_list("item").alias("own"))
    w = Window.partitionBy("session").orderBy("round").rowsBetween(Window.unboundedPreceding, -1)
    t = own.withColumn("before", F.array_sort(F.array_distinct(F.flatten(F.collect_list("own").over(w)))))
    return t.select("event_id", F.size("before").cast("long").alias("n"), F.nullif(F.array_join("before", ","), F.lit("")).alias("items"))


@query("r23_exact_guide", "SELECT match_id, side, place, tier FROM rosters JOIN guide USING (roster)")
def _(v):
    return v.rosters.join(F.broadcast(v.guide), "roster").select("match_id", "side", "place", "tier")


@query("r24_owned_leads", "SELECT session, key, weight, CAST(rn AS INT) AS rank FROM (SELECT session, key, weight, row_number() OVER (PARTITION BY session ORDER BY weight DESC, key) AS rn FROM (SELECT DISTINCT a.session, w.key, w.weight FROM picks a JOIN picks b ON a.session = b.session AND a.round_type = 'hero' AND b.round_type = 'skill' JOIN weights w ON w.family = 'HS' AND w.key = a.item || '|' || b.item WHERE w.weight > 0)) WHERE rn <= 12")
def _(v):
    h = v.picks.filter("round_type = 'hero'").select("session", F.col("item").alias("hero")).distinct()
    s = v.picks.filter("round_type = 'skill'").select("session", F.col("item").alias("skill")).distinct()
    w = v.weights.filter("family = 'HS' AND weight > 0").select("key", "weight")
    t = h.join(s, "session").withColumn("key", F.concat_ws("|", "hero", "skill")).join(w, "key").select("session", "key", "weight")
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("session").orderBy(F.desc("weight"), "key"))).filter("rank <= 12")


@query("r24_owned_pairs", f"WITH {_OWN} SELECT a.session, key, weight, support FROM oh a JOIN oh b ON a.session = b.session AND a.hero < b.hero JOIN weights ON family = 'HP' AND key = a.hero || '|' || b.hero WHERE weight <> 0")
def _(v):
    h, _ = _owned(v)
    pairs = h.join(h.select("session", F.col("hero").alias("other")), "session").filter("hero < other")
    return pairs.withColumn("key", F.concat_ws("|", "hero", "other")).join(v.weights.filter("family = 'HP' AND weight <> 0"), "key").select("session", "key", "weight", "support")


@query("r25_item_lists", """SELECT skill, list, season = (SELECT max(season) FROM skills) AS latest, row_number() OVER (PARTITION BY list ORDER BY CASE WHEN color = 'orange' THEN 0 ELSE 1 END, skill) AS place
FROM (SELECT *, unnest(CASE WHEN is_signature OR shadow THEN ['signature_or_shadow'] WHEN color = 'orange' THEN ['regular', 'orange'] ELSE ['regular'] END) AS list FROM skills)""")
def _(v):
    """The catalog's selectable lists, each by tier and name; the catalog has a row for each skill."""
    last = v.skills.agg(F.max("season").alias("last"))
    lists = F.when(F.expr("is_signature OR shadow"), F.array(F.lit("signature_or_shadow"))).when(F.col("color") == "orange", F.array(F.lit("regular"), F.lit("orange"))).otherwise(F.array(F.lit("regular")))
    w = Window.partitionBy("list").orderBy(F.when(F.col("color") == "orange", 0).otherwise(1), "skill")
    t = v.skills.withColumn("list", F.explode(lists)).withColumn("place", F.row_number().over(w).cast("long"))
    return t.crossJoin(F.broadcast(last)).select("skill", "list", (F.col("season") == F.col("last")).alias("latest"), "place")


@query("r26_closest_guides", "SELECT match_id, side, place, shared, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY match_id, side ORDER BY shared DESC, champion DESC, place) AS rn FROM (SELECT match_id, side, place, champion, count(*) AS shared FROM members JOIN guide_members USING (hero) GROUP BY ALL HAVING count(*) >= 2)) WHERE rn <= 3")
def _(v):
    t = v.members.join(F.broadcast(v.guide_members.select("hero", "place", "champion")), "hero").groupBy("match_id", "side", "place", "champion").agg(F.count(F.lit(1)).alias("shared")).filter("shared >= 2")
    w = Window.partitionBy("match_id", "side").orderBy(F.desc("shared"), F.desc("champion"), "place")
    return t.withColumn("rank", F.row_number().over(w)).filter("rank <= 3").select("match_id", "side", "place", "shared", "rank")


@query("r27_confident_groups", "SELECT match_id, side, round(sum(weight), 6) AS gain, min(support) AS least FROM features LEFT JOIN weights USING (family, key) WHERE family IN ('H', 'HP') GROUP BY 1, 2 HAVING bool_and(support IS NOT NULL) AND round(sum(weight), 6) >= 0.1")
def _(v):
    t = v.features.filter("family IN ('H', 'HP')").join(v.weights, ["family", "key"], "left").groupBy("match_id", "side").agg(F.bool_and(F.col("support").isNotNull()).alias("ok"), F.round(F.sum("weight"), 6).alias("gain"), F.min("support").alias("least"))
    return t.filter("ok AND gain >= 0.1").select("match_id", "side", "gain", "least")
