"""Batch scoring and recommendation over pools and rosters (R01-R27). Pools are bounded by a draft's ten rounds."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize, shuffled, spread


def _weights(w: DataFrame, family: str) -> DataFrame:
    return w.filter(F.col("family") == family).select("key", "weight", "support")


def pair_key(a: str, b: str):
    return F.concat_ws("|", F.least(a, b), F.greatest(a, b))


def team_strength(features: DataFrame, weights: DataFrame) -> DataFrame:
    """(match_id, side, strength, n_known, least_support)."""
    t = features.join(weights, ["family", "key"], "left")
    return t.groupBy("match_id", "side").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("strength"), F.count("weight").alias("n_known"), F.sum("support").alias("total_support"), F.min("support").alias("least_support"))


def win_share(strength: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Whole-percent shares that add to 100, tie, upset and low-evidence flags."""
    a = strength.filter("side = 1").select("match_id", F.col("strength").alias("a"), F.col("n_known").alias("na"))
    b = strength.filter("side = 2").select(F.col("match_id").alias("m2"), F.col("strength").alias("b"), F.col("n_known").alias("nb"))
    t = a.join(b, F.col("match_id") == F.col("m2")).join(outcomes.select(F.col("match_id").alias("m3"), "winner"), F.col("match_id") == F.col("m3"))
    share = F.round(100 / (1 + F.exp(-(F.col("a") - F.col("b"))))).cast("int")
    t = t.withColumn("share1", share)
    return t.select("match_id", "share1", (100 - F.col("share1")).alias("share2"), (F.col("share1") == 50).alias("tie"), (((F.col("share1") > 50) & (F.col("winner") == 2)) | ((F.col("share1") < 50) & (F.col("winner") == 1))).alias("upset"), (F.least("na", "nb") < 10).alias("low_evidence"))


def hero_gain(offers: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """What an option's heroes add to the pool: their own weights, pairs with the pool, pairs inside the option."""
    o = offers.filter("round_type = 'hero'").select("event_id", "option", "item").distinct()
    p = pool.filter("pool_type = 'hero'").select("event_id", "pool_item")
    fresh = o.join(p, (o["event_id"] == p["event_id"]) & (o["item"] == p["pool_item"]), "left_anti")
    own = fresh.select("event_id", "option", F.lit("H").alias("family"), F.col("item").alias("key"))
    with_pool = fresh.join(p, "event_id").select("event_id", "option", F.lit("HP").alias("family"), pair_key("item", "pool_item").alias("key"))
    b = fresh.select("event_id", "option", F.col("item").alias("item2"))
    inside = fresh.join(b, ["event_id", "option"]).filter("item < item2").select("event_id", "option", F.lit("HP").alias("family"), pair_key("item", "item2").alias("key"))
    every = own.unionByName(with_pool).unionByName(inside).distinct().join(weights, ["family", "key"], "left")
    return every.groupBy("event_id", "option").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("gain"), F.count("weight").alias("evidence"))


def best_hero_for_skill(skills: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """Each offered skill's best hero of the pool: (event_id, option, item, hero, routed)."""
    h = pool.filter("pool_type = 'hero'").select("event_id", F.col("pool_item").alias("hero"))
    t = skills.select("event_id", "option", "item").distinct().join(h, "event_id").withColumn("key", F.concat_ws("|", "hero", "item"))
    t = t.join(_weights(weights, "HS").select("key", "weight"), "key", "left").withColumn("routed", F.coalesce("weight", F.lit(0.0)))
    best = F.min(F.struct((-F.col("routed")).alias("r"), "hero"))
    return t.groupBy("event_id", "option", "item").agg(best.alias("m")).select("event_id", "option", "item", F.col("m.hero").alias("hero"), (-F.col("m.r")).alias("routed"))


def skill_gain(skills: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """An option's skills, each with its own weight and its best route."""
    routed = best_hero_for_skill(skills, pool, weights).select("event_id", "option", "item", "routed")
    t = skills.select("event_id", "option", "item").distinct().join(_weights(weights, "S").withColumnRenamed("key", "item").select("item", "weight"), "item", "left").join(routed, ["event_id", "option", "item"], "left")
    return t.groupBy("event_id", "option").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0)) + F.coalesce("routed", F.lit(0.0))), 6).alias("gain"), F.count("weight").alias("evidence"))


def best_routes(owned: DataFrame, weights: DataFrame, by: list[str], most: int = 2) -> DataFrame:
    """(by, hero, routed): the ``most`` best positive weights of each catalog hero with the owned skills, added."""
    w = _weights(weights, "HS").filter("weight > 0").select(F.split_part("key", F.lit("|"), F.lit(1)).alias("hero"), F.split_part("key", F.lit("|"), F.lit(2)).alias("skill"), "weight")
    t = owned.select(*by, "skill").distinct().join(w, "skill")
    order = Window.partitionBy(*by, "hero").orderBy(F.desc("weight"))
    return t.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= most).groupBy(*by, "hero").agg(F.sum("weight").alias("routed"))


def best_skill_pair(offers: DataFrame, pool: DataFrame, weights: DataFrame) -> DataFrame:
    """Each event's best two offered skills: their own weights and the better of both on one hero, with that
    hero's weight of the pair, or on two heroes; routing never takes away.

    An event has a draft's few skills and heroes: it is one row with both lists, and its pairs are never rows. Weights are those of
    catalog items and are sent to the tasks."""
    skills = offers.groupBy("event_id").agg(F.sort_array(F.collect_set("item")).alias("skills")).filter(F.size("skills") > 1)
    heroes = pool.filter("pool_type = 'hero'").groupBy("event_id").agg(F.sort_array(F.collect_set("pool_item")).alias("heroes"))
    t = skills.join(shuffled(heroes), "event_id", "left").select("event_id", "skills", F.coalesce("heroes", F.array().cast("array<string>")).alias("heroes"))
    known = {(r["family"], r["key"]): r["weight"] for r in weights.filter("family IN ('S', 'HS', 'SP')").select("family", "key", "weight").collect()}
    return t.mapInArrow(_skill_pairs_task(known), "event_id long, a string, b string, score double")


#: Events whose pairs are scored at a time (fixed value).
EVENTS_AT_ONCE = 500


def _skill_pairs_task(known: dict):
    """Best pairs of events (event_id, skills, heroes), by tables of the batch's skills and heroes."""

    def tables(skills: tuple, heroes: tuple):
        import numpy as np

        own = np.array([known.get(("S", x)) or 0.0 for x in skills])
        routed = np.array([[known.get(("HS", f"{h}|{x}")) or 0.0 for x in skills] for h in heroes]).reshape(len(heroes), len(skills))
        synergy = np.zeros((len(heroes), len(skills), len(skills)))
        for i, h in enumerate(heroes):
            for j, x in enumerate(skills):
                synergy[i, j, j + 1 :] = [known.get(("SP", f"{h}|{x}|{y}")) or 0.0 for y in skills[j + 1 :]]
        return own, routed, synergy

    def padded(lists, names):
        """Places of each event's items in ``names``, and which of them are none."""
        import numpy as np
        import pyarrow.compute as pc

        size = lists.value_lengths().to_numpy(zero_copy_only=False)
        none = np.arange(max(int(size.max()), 1)) >= size[:, None]
        at = np.zeros(none.shape, np.int64)
        at[~none] = pc.index_in(lists.flatten(), names).to_numpy(zero_copy_only=False)
        return at, none

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        kept = lru_cache(maxsize=4)(tables)
        for whole in batches:
            for start in range(0, whole.num_rows, EVENTS_AT_ONCE):
                b = whole.slice(start, EVENTS_AT_ONCE)
                lists = [b.column("skills"), b.column("heroes")]
                # names in the order of their bytes, as lists are
                names = [pa.array(sorted(pc.unique(x.flatten()).to_pylist(), key=str.encode), pa.string()) for x in lists]
                own, routed, synergy = kept(*(tuple(x.to_pylist()) for x in names))
                (skill, no_skill), (hero, no_hero) = map(padded, lists, names)
                i, j = np.triu_indices(skill.shape[1], 1)
                x, y = skill[:, i], skill[:, j]
                total = own[x] + own[y]
                if len(names[1]):
                    h = hero[:, None, :]
                    one, two = routed[h, x[:, :, None]], routed[h, y[:, :, None]]
                    one[np.broadcast_to(no_hero[:, None, :], one.shape)] = two[np.broadcast_to(no_hero[:, None, :], two.shape)] = -np.inf
                    same = (one + two + synergy[h, x[:, :, None], y[:, :, None]]).max(axis=2)
                    split = np.full(same.shape, -np.inf)
                    for k in range(one.shape[2]):
                        others = np.delete(two, k, axis=2)
                        if others.shape[2]:
                            split = np.maximum(split, one[:, :, k] + others.max(axis=2))
                    total = total + np.maximum(0.0, np.maximum(same, split))
                total = np.round(total, 6)
                total[no_skill[:, i] | no_skill[:, j]] = -np.inf
                best = total.argmax(axis=1)  # of equal pairs the first in order
                row = np.arange(b.num_rows)
                yield pa.record_batch([b.column("event_id"), names[0].take(pa.array(x[row, best])), names[0].take(pa.array(y[row, best])), pa.array(total[row, best])], names=["event_id", "a", "b", "score"])

    return run


def current_score(heroes: DataFrame, skills: DataFrame, weights: DataFrame) -> DataFrame:
    """(session, score): owned heroes and their pairs, owned skills and each one's best route."""
    pairs = heroes.join(heroes.select("session", F.col("hero").alias("other")), "session").filter("hero < other")
    parts = heroes.select("session", F.lit("H").alias("family"), F.col("hero").alias("key")).unionByName(pairs.select("session", F.lit("HP").alias("family"), F.concat_ws("|", "hero", "other").alias("key"))).unionByName(skills.select("session", F.lit("S").alias("family"), F.col("skill").alias("key")))
    one = parts.join(weights, ["family", "key"], "left").groupBy("session").agg(F.sum(F.coalesce("weight", F.lit(0.0))).alias("w"))
    routes = skills.join(heroes, "session").withColumn("key", F.concat_ws("|", "hero", "skill")).join(_weights(weights, "HS").select("key", "weight"), "key", "left")
    two = routes.groupBy("session", "skill").agg(F.max(F.coalesce("weight", F.lit(0.0))).alias("w")).groupBy("session").agg(F.sum("w").alias("w"))
    return one.unionByName(two).groupBy("session").agg(F.round(F.sum("w"), 6).alias("score"))


def added_hero(members: DataFrame, heroes: DataFrame, required: int = 2) -> DataFrame:
    """For each side and hero that it lacks, the camp bonus before and after, and whether the hero's bond becomes active."""
    catalog = F.broadcast(heroes.select("hero", "camp", "bond"))  # a row for each hero of the catalog
    t = members.join(catalog, "hero").groupBy("match_id", "side").agg(F.collect_list("hero").alias("own"), F.collect_list("camp").alias("camps"), F.collect_list("bond").alias("bonds"))
    c = t.crossJoin(catalog).filter(~F.array_contains("own", F.col("hero")))
    count = lambda xs, x: F.size(F.filter(xs, lambda y: y == x))
    most = F.array_max(F.transform("camps", lambda x: count(F.col("camps"), x)))
    bonus = lambda n: F.when(n >= 3, 0.1).when(n == 2, 0.05).otherwise(0.0)
    n = count(F.col("bonds"), F.col("bond"))
    return c.select("match_id", "side", "hero", bonus(most).alias("bonus_before"), bonus(F.greatest(most, count(F.col("camps"), F.col("camp")) + 1)).alias("bonus_after"), ((n < required) & (n + 1 >= required)).alias("bond_activated"))


def guide_relevance(heroes: DataFrame, skills: DataFrame, offered_heroes: DataFrame, offered_skills: DataFrame, guide: DataFrame, slots: DataFrame) -> DataFrame:
    """(session, place, owned, offered, owned_slots, offered_slots): members and skill slots of each guide that a
    session owns, or only is offered. The guide is a published list of a fixed length."""
    def known(own, offer, what):
        t = own.withColumn("o", F.lit(True)).unionByName(offer.withColumn("o", F.lit(False)))
        return t.groupBy("session", what).agg(F.bool_or("o").alias("o"))

    n = lambda name: [F.count_if("o").alias(f"owned{name}"), F.count_if(~F.col("o")).alias(f"offered{name}")]
    h = known(heroes, offered_heroes, "hero").join(F.broadcast(guide), "hero").groupBy("session", "place").agg(*n(""))
    s = known(skills, offered_skills, "skill").join(F.broadcast(slots.withColumn("skill", F.explode("skills")).drop("skills")), "skill")
    s = s.groupBy("session", "place", "hero", "slot").agg(F.bool_or("o").alias("o")).groupBy("session", "place").agg(*n("_slots"))
    return h.join(s, ["session", "place"], "left").na.fill(0, ["owned_slots", "offered_slots"])


def partial_guides(heroes: DataFrame, skills: DataFrame, guide: DataFrame, slots: DataFrame, weights: DataFrame, least: int = 2) -> DataFrame:
    """Guides with ``least`` owned heroes or more, and how many of those heroes' slots an owned skill can fill by a positive route."""
    g = F.broadcast(guide.select("hero", "place", "tier", "champion"))
    own = heroes.join(g, "hero").groupBy("session", "place", "tier", "champion").agg(F.count(F.lit(1)).alias("owned")).filter(F.col("owned") >= least)
    route = _weights(weights, "HS").filter("weight > 0").select("key")
    fits = slots.withColumn("skill", F.explode("skills")).withColumn("key", F.concat_ws("|", "hero", "skill")).join(route, "key", "left_semi").select("place", "hero", "slot", "skill")
    use = heroes.join(F.broadcast(fits), "hero").join(skills, ["session", "skill"], "left_semi").groupBy("session", "place").agg(F.count_distinct("hero", "slot").alias("usable"))
    t = own.join(use, ["session", "place"], "left").na.fill(0, ["usable"])
    tier = F.when(F.col("tier") == "S", 0).when(F.col("tier") == "A", 1).otherwise(2)
    w = Window.partitionBy("session").orderBy(F.desc("owned"), F.desc("usable"), F.desc("champion"), tier, "place")
    return t.withColumn("rank", F.row_number().over(w)).select("session", "place", "owned", "usable", "rank")


def rank_options(gains: DataFrame) -> DataFrame:
    """Options by gain, evidence and index."""
    w = Window.partitionBy("event_id").orderBy(F.desc("gain"), F.desc("evidence"), "option")
    return gains.withColumn("rank", F.row_number().over(w))


def trios(pool: DataFrame, weights: DataFrame, camps: DataFrame) -> DataFrame:
    """Strength of every three heroes of a pool, from arrays: a pool has at most a few tens of items."""
    p = pool.groupBy("pool_id").agg(F.sort_array(F.collect_set("hero")).alias("h"))
    t = p.select("pool_id", F.posexplode("h").alias("i", "a"), "h").select("pool_id", "a", "i", F.posexplode("h").alias("j", "b"), "h").filter("j > i").select("pool_id", "a", "b", "j", F.posexplode("h").alias("k", "c")).filter("k > j").select("pool_id", "a", "b", "c")
    h, hp = _weights(weights, "H"), _weights(weights, "HP")
    every, t = t, t.select("a", "b", "c").distinct()  # a trio's strength is the same in all pools
    t = t.withColumn("keys", F.array(*[F.struct(F.lit("H").alias("family"), F.col(x).alias("key")) for x in "abc"], *[F.struct(F.lit("HP").alias("family"), F.concat_ws("|", x, y).alias("key")) for x, y in ("ab", "ac", "bc")]))
    long = t.select("a", "b", "c", F.explode("keys").alias("f")).select("a", "b", "c", "f.family", "f.key")
    both = h.withColumn("family", F.lit("H")).unionByName(hp.withColumn("family", F.lit("HP")))
    s = long.join(both, ["family", "key"], "left").groupBy("a", "b", "c").agg(F.round(F.sum(F.coalesce("weight", F.lit(0.0))), 6).alias("strength"))
    for x in "abc":
        s = s.join(F.broadcast(camps.select(F.col("hero").alias(x), F.col("camp").alias(f"c{x}"))), x)  # one row for each hero of the catalog
    s = s.select("a", "b", "c", "strength", ((F.col("ca") == F.col("cb")) & (F.col("cb") == F.col("cc"))).alias("same_camp"))
    return every.join(s, ["a", "b", "c"]).select("pool_id", "a", "b", "c", "strength", "same_camp")


def by_set(pool: DataFrame, form: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Rows that ``form`` makes of pools (pool_id, hero), made once for all pools of the same heroes.

    ``form`` gets a pool for each set of heroes, with the sorted set as its id; each pool then takes its set's rows."""
    p = materialize(spread(pool.select("pool_id", "hero"), pool, "pool_id").groupBy("pool_id").agg(F.sort_array(F.collect_set("hero")).alias("h")), "pools")
    rows = form(p.select(F.col("h").alias("pool_id")).distinct().select("pool_id", F.explode("pool_id").alias("hero")))
    columns = [c for c in rows.columns if c != "pool_id"]
    listed = rows.groupBy(F.col("pool_id").alias("h")).agg(F.collect_list(F.struct(*columns)).alias("x"))
    return p.join(shuffled(listed), "h").select("pool_id", F.explode("x").alias("x")).select("pool_id", "x.*")


def disjoint_pairs(trio: DataFrame, keep: int, cap: int) -> DataFrame:
    """Pairs of disjoint trios among a pool's best ``keep``, the best ``cap`` of them."""
    w = Window.partitionBy("pool_id").orderBy(F.desc("strength"), "a", "b", "c")
    t = trio.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= keep).select("pool_id", "rn", "strength", F.array("a", "b", "c").alias("t"))
    u = t.select("pool_id", F.col("rn").alias("rn2"), F.col("strength").alias("s2"), F.col("t").alias("t2"))
    p = t.join(u, "pool_id").filter((F.col("rn") < F.col("rn2")) & ~F.arrays_overlap("t", "t2")).withColumn("total", F.round(F.col("strength") + F.col("s2"), 6))
    w = Window.partitionBy("pool_id").orderBy(F.desc("total"), "rn", "rn2")
    return p.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= cap).select("pool_id", F.array_join("t", ",").alias("first"), F.array_join("t2", ",").alias("second"), "total", "rank")


#: Heroes of a pool whose trios are paired, and pairs of trios that are kept of one, at most (fixed values).
POOL, PARTITIONS = 15, 160


def pool_weights(pool: DataFrame, weights: DataFrame, most: int | None = None) -> DataFrame:
    """(pool_id, heroes, single, pair): a pool's heroes in order, all or the first ``most``, and their weights alone and by two, as arrays.

    Weights meet the heroes and pairs of a pool, not the six parts of each of its trios: of 15 heroes, 105 pairs and 455 trios."""
    heroes = F.sort_array(F.collect_set("hero"))
    p = pool.groupBy("pool_id").agg((F.slice(heroes, 1, most) if most else heroes).alias("heroes"))
    one = p.select("pool_id", F.posexplode("heroes").alias("i", "key"))
    n = F.size("heroes")
    two = p.select("pool_id", "heroes", F.explode(F.sequence(F.lit(0), n * n - 1)).alias("x")).filter("x div size(heroes) < x % size(heroes)")
    two = two.select("pool_id", F.col("x").alias("i"), F.concat_ws("|", F.expr("heroes[x div size(heroes)]"), F.expr("heroes[x % size(heroes)]")).alias("key"))
    h, hp = _weights(weights, "H"), _weights(weights, "HP")

    def listed(rows: DataFrame, own: DataFrame, name: str) -> DataFrame:
        t = rows.join(own, "key", "left").groupBy("pool_id").agg(F.sort_array(F.collect_list(F.struct("i", F.coalesce("weight", F.lit(0.0)).alias("w")))).alias("x"))
        return t.select("pool_id", F.transform("x", lambda r: r["w"]).alias(name))

    return p.join(listed(one, h, "single"), "pool_id").join(listed(two, hp, "pair"), "pool_id")


def _trio_table(n: int, single, pair):
    """Trios of a pool, strongest first: strength, heroes' places and bit masks; equal ones in the order of their heroes."""
    import numpy as np

    i, j, k = np.array([(i, j, k) for i in range(n) for j in range(i + 1, n) for k in range(j + 1, n)], dtype=np.int64).reshape(-1, 3).T
    at = np.zeros((n, n), np.int64)
    at[np.triu_indices(n, 1)] = np.arange(n * (n - 1) // 2)
    strength = np.round(single[i] + single[j] + single[k] + pair[at[i, j]] + pair[at[i, k]] + pair[at[j, k]], 6) if len(i) else np.zeros(0)
    order = np.argsort(-strength, kind="stable")
    i, j, k = i[order], j[order], k[order]
    return strength[order], np.stack([i, j, k], axis=1), (1 << i) | (1 << j) | (1 << k)


def best_pairs(strength, masks, most: int):
    """The ``most`` best pairs (first, second) of trios without a common hero, best first: a heap of each trio's next partner.

    Trios come strongest first, so a trio's partners only get weaker, and a trio enters once the one before it has been met: nothing
    under the bound is ever formed."""
    from heapq import heappop, heappush

    heap, out = [], []

    def push(a: int, b: int) -> None:
        if b < len(strength):
            heappush(heap, (-round(float(strength[a] + strength[b]), 6), a, b))

    push(0, 1)
    while heap and len(out) < most:
        total, a, b = heappop(heap)
        if not masks[a] & masks[b]:
            out.append((a, b, -total))
        push(a, b + 1)
        if b == a + 1:
            push(a + 1, a + 2)
    return out


def large_pool_pairs(pools: DataFrame, most: int = PARTITIONS) -> DataFrame:
    """R11 on pools of up to 15: (pool_id, first, second, total, rank). ``pools``: rows of ``pool_weights``."""
    return pools.select("pool_id", "heroes", "single", "pair").mapInArrow(_pairs_task(most), "pool_id long, first string, second string, total double, rank int")


#: Pools whose pairs a task holds at a time (fixed value): a batch of 10,000 pools has 1.6 million pairs.
POOLS_AT_ONCE = 50


def _pairs_task(most: int):
    def run(batches):
        import pyarrow as pa

        for b in (whole.slice(at, POOLS_AT_ONCE) for whole in batches for at in range(0, whole.num_rows, POOLS_AT_ONCE)):
            rows = []
            for pool_id, heroes, single, pair in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), b.column(3), strict=True):
                strength, places, masks = _trio_table(len(heroes), single.values.to_numpy(), pair.values.to_numpy())
                name = [",".join(heroes[x] for x in t) for t in places.tolist()]
                rows += [(pool_id, name[x], name[y], total, rank + 1) for rank, (x, y, total) in enumerate(best_pairs(strength, masks.tolist(), most))]
            kinds = (pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int32())
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["pool_id", "first", "second", "total", "rank"])

    return run


def _trio_places(n: int):
    """Places of the trios of ``n`` heroes in order, and of their pairs among all pairs in order."""
    import numpy as np

    i, j, k = np.array(list(combinations(range(n), 3)), dtype=np.int64).reshape(-1, 3).T
    at = np.zeros((n, n), np.int64)
    at[np.triu_indices(n, 1)] = np.arange(n * (n - 1) // 2)
    return i, j, k, at[i, j], at[i, k], at[j, k]


def large_pool_trios(pools: DataFrame) -> DataFrame:
    """R10 on pools of any size: (pool_id, trios, best, strength): how many trios a pool has, and its best one."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        trios = lru_cache(maxsize=32)(_trio_places)
        for b in batches:
            ids, n, best, top = [], [], [], []
            for pool_id, heroes, single, pair in zip(*(b.column(i).to_pylist() for i in range(2)), b.column(2), b.column(3), strict=True):
                if len(heroes) > 2:
                    one, two = single.values.to_numpy(), pair.values.to_numpy()
                    i, j, k, ij, ik, jk = trios(len(heroes))
                    strength = np.round(one[i] + one[j] + one[k] + two[ij] + two[ik] + two[jk], 6)
                    first = int(np.argmax(strength))  # of equal ones the first in the order of heroes
                    ids.append(pool_id)
                    n.append(len(strength))
                    best.append(",".join(heroes[x[first]] for x in (i, j, k)))
                    top.append(float(strength[first]))
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(best, pa.string()), pa.array(top, pa.float64())], names=["pool_id", "trios", "best", "strength"])

    return pools.select("pool_id", "heroes", "single", "pair").mapInArrow(run, "pool_id long, trios long, best string, strength double")


def band(pairs: DataFrame, width: float) -> DataFrame:
    """Candidates within a band below their pool's best, in order."""
    w = Window.partitionBy("pool_id")
    t = pairs.withColumn("best", F.max("total").over(w)).filter(F.col("total") >= F.round(F.col("best") - width, 6))
    return t.withColumn("place", F.row_number().over(w.orderBy(F.desc("total"), "first", "second"))).select("pool_id", "first", "second", "total", "place")


def diverse_three(trio: DataFrame) -> DataFrame:
    """The best trio, then twice the one that shares fewest heroes with those chosen."""
    t = materialize(trio.select("pool_id", "strength", F.array("a", "b", "c").alias("t")), "trios")
    chosen = None
    for turn in range(3):
        if chosen is None:
            c = t.withColumn("overlap", F.lit(0))
        else:
            taken = chosen.groupBy("pool_id").agg(F.flatten(F.collect_list("t")).alias("taken"), F.collect_list("t").alias("own"))
            c = t.join(taken, "pool_id").filter(~F.array_contains("own", F.col("t"))).withColumn("overlap", F.size(F.filter("taken", lambda x: F.array_contains("t", x)))).drop("taken", "own")
        w = Window.partitionBy("pool_id").orderBy("overlap", F.desc("strength"), "t")
        now = c.withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("pool_id", F.lit(turn + 1).alias("place"), "t", "strength", "overlap")
        now = materialize(now, "chosen")  # each turn builds on those before
        chosen = now if chosen is None else chosen.unionByName(now)
    return chosen.select("pool_id", "place", F.array_join("t", ",").alias("trio"), "strength", "overlap")
