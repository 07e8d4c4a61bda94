"""Near-duplicate teams and matches (D08) without comparing all pairs of a popular roster."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.session import materialize, shuffled


def team_states(members: DataFrame) -> DataFrame:
    """(id, roster, skills): a side's members and their carried skills, as one sorted list."""
    own = lambda c: F.concat_ws(":", "hero", c)
    t = members.groupBy("match_id", "side").agg(F.array_join(F.sort_array(F.collect_list("hero")), ",").alias("roster"), F.sort_array(F.concat(F.collect_list(own("s1")), F.collect_list(own("s2")))).alias("skills"))
    return t.select((F.col("match_id") * 2 + F.col("side")).alias("id"), "roster", "skills")


def skill_replacements(members: DataFrame, most: int = 1) -> DataFrame:
    """Pairs (a, b, replaced) of teams of one roster whose carried skills differ by at most ``most``.

    Two sets that differ by at most one skill agree once that skill is left out: each state is dealt to a
    bucket for itself and for itself without each skill, so only states that share a bucket meet, not all
    of a roster."""
    t = team_states(members).withColumn("own", F.array_distinct("skills"))
    less = F.transform("own", lambda x: F.array_except("own", F.array(x)))
    for _ in range(most - 1):
        less = F.flatten(F.transform(less, lambda s: F.transform(s, lambda x: F.array_except(s, F.array(x)))))
    keys = F.array_distinct(F.transform(F.concat(F.array("own"), less), lambda s: F.xxhash64("roster", F.array_join(s, ","))))
    dealt = t.select("id", "roster", "own", F.explode(keys).alias("bucket"))
    a, b = dealt.alias("a"), dealt.alias("b")
    replaced = F.greatest(F.size(F.array_except("a.own", "b.own")), F.size(F.array_except("b.own", "a.own")))
    pairs = shuffled(a).join(b, (F.col("a.bucket") == F.col("b.bucket")) & (F.col("a.roster") == F.col("b.roster")) & (F.col("a.id") < F.col("b.id")))
    return pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), replaced.alias("replaced")).filter(F.col("replaced") <= most).distinct()


def matchup_states(members: DataFrame) -> DataFrame:
    """(id, rosters, mirror, items, swapped): both sides of a match in canonical order, as sets of side|hero:skill.

    ``members``: rows (id, side, hero, s1, s2). Sides are sorted by roster, then by their skills; where both have
    one roster, ``swapped`` holds the items of the other pairing."""
    own = lambda c: F.concat_ws(":", "hero", c)
    skills = F.array_distinct(F.sort_array(F.concat(F.collect_list(own("s1")), F.collect_list(own("s2")))))
    sides = members.groupBy("id", "side").agg(F.array_join(F.sort_array(F.collect_list("hero")), ",").alias("roster"), skills.alias("skills"))
    t = sides.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("roster", "skills"))).alias("x")).filter(F.size("x") == 2)
    a, b = F.get("x", F.lit(0)), F.get("x", F.lit(1))
    mark = lambda side, s: F.transform(s["skills"], lambda k: F.concat(F.lit(f"{side}|"), k))
    t = t.select("id", F.concat_ws("/", a["roster"], b["roster"]).alias("rosters"), (a["roster"] == b["roster"]).alias("mirror"), F.concat(mark(0, a), mark(1, b)).alias("items"), F.concat(mark(0, b), mark(1, a)).alias("swapped"))
    return t.withColumn("state", F.xxhash64("rosters", F.array_join("items", ",")))


def _distance(a, b):
    """Replaced skills, summed by hero: the larger of what each hero lacks and gains."""
    heroes = F.array_distinct(F.transform(F.concat(a, b), lambda x: F.substring_index(x, ":", 1)))
    gone, new = F.array_except(a, b), F.array_except(b, a)
    count = lambda xs, h: F.size(F.filter(xs, lambda x: F.substring_index(x, ":", 1) == h))
    return F.aggregate(F.transform(heroes, lambda h: F.greatest(count(gone, h), count(new, h))), F.lit(0), lambda s, x: s + x)


#: Two hashes tell sets apart: one alone could meet another's by chance among billions.
_SALTS = ("a", "b")


def _hashes(*columns):
    return F.struct(*[F.xxhash64(F.lit(x), *columns).alias(f"h{x}") for x in _SALTS])


def matchup_replacements(members: DataFrame, most: int = 1) -> DataFrame:
    """Pairs (a, b, replaced) of matches with the same rosters of which at most ``most`` skill is replaced.

    Equal matchups are a class: each member is paired with the class's smallest id, and classes are compared by
    those ids only, so copies aren't expanded into all pairs. A mirror matchup, with one roster on both sides,
    takes the better of both pairings. Matchups that differ by one skill agree once its hero is left out, so only those
    that share such a bucket meet, or whose whole is another's rest. A bucket's row holds two hashes, the id and the skills of the hero that is left
    out, which alone differ: whole matchups are dealt once, by their class, and rows that are alone in a bucket end there."""
    if most not in (0, 1):
        raise ValueError("buckets leave out one hero")
    t = matchup_states(members).select("id", "rosters", "mirror", "items", _hashes("rosters", "items").alias("c")).select("id", "rosters", "mirror", "items", "c.*")
    own = Window.partitionBy(*[f"h{x}" for x in _SALTS])
    t = materialize(t.withColumn("a", F.min("id").over(own)).drop(*[f"h{x}" for x in _SALTS]), "classes")
    copies = t.filter("id <> a").select("a", F.col("id").alias("b"), F.lit(0).alias("replaced"))
    if not most:
        return copies
    hero = lambda x: F.substring_index(x, ":", 1)
    turned = F.array_sort(F.transform("items", lambda x: F.concat(F.when(F.substring(x, 1, 1) == "0", "1").otherwise("0"), F.substring(x, 2, 1 << 20))))
    first = t.filter("id = a").select("a", "rosters", F.explode(F.when(F.col("mirror"), F.array(F.array_sort("items"), turned)).otherwise(F.array(F.array_sort("items")))).alias("items"))
    none = F.array().cast("array<string>")
    left = F.concat(F.array(none), F.transform(F.array_distinct(F.transform("items", hero)), lambda h: F.filter("items", lambda x: hero(x) == h)))
    dealt = first.select("a", "rosters", "items", F.explode(left).alias("left"))
    dealt = dealt.select("a", "left", _hashes("rosters", F.array_except("items", "left")).alias("k")).select("a", "left", "k.*")
    # most buckets hold one matchup only
    met = materialize(dealt.withColumn("n", F.count(F.lit(1)).over(own)).filter("n > 1").drop("n"), "met")
    other = met.select(F.col("a").alias("b"), F.col("left").alias("right"), *[F.col(f"h{x}").alias(f"g{x}") for x in _SALTS])
    pairs = met.join(shuffled(other), reduce(and_, [F.col(f"h{x}") == F.col(f"g{x}") for x in _SALTS]) & (F.col("a") < F.col("b")))
    near = pairs.groupBy("a", "b").agg(F.min(_distance(F.col("left"), F.col("right"))).alias("replaced")).filter(F.col("replaced") <= most)
    return copies.unionByName(near)
