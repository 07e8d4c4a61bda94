"""Validation: one column with the first reason against a row, null for good rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.session import shuffled


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The name of the first rule that fails; a rule that is null counts as failed."""
    return F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for ok, name in rules])


def match_reasons(matches: DataFrame, slots: DataFrame, heroes: DataFrame, skills: DataFrame) -> DataFrame:
    """Winner, three members a side with two skills each, no repeated hero, catalog names, positive season."""
    known = slots.join(heroes.select("hero", F.lit(1).alias("kh")), "hero", "left")
    for c in ("s1", "s2"):
        known = known.join(skills.select(F.col("skill").alias(c), F.lit(1).alias(f"k{c}")), c, "left")
    bad = F.sum(F.when(F.col("kh").isNull() | F.col("ks1").isNull() | F.col("ks2").isNull(), 1).otherwise(0))
    empty = F.count_if(F.col("s1").isNull() | F.col("s2").isNull())
    per = known.groupBy("match_id").agg(bad.alias("unknown"), empty.alias("empty"), (F.count("hero") - F.count_distinct("side", "hero")).alias("dups"))
    t = matches.join(per, "match_id", "left")
    reason = first_reason(
        (F.col("winner").isin(1, 2), "winner"),
        ((F.col("n1") == 3) & (F.col("n2") == 3), "team_size"),
        (F.coalesce("empty", F.lit(0)) == 0, "skills"),
        (F.coalesce("dups", F.lit(0)) == 0, "duplicate_hero"),
        (F.coalesce("unknown", F.lit(0)) == 0, "unknown_name"),
        (F.coalesce(F.col("season") > 0, F.lit(True)), "season"),
    )
    return t.withColumn("reason", reason)


def event_reasons(events: DataFrame, offers: DataFrame, pool: DataFrame) -> DataFrame:
    """Offers without repeats, none of them in the pool of the same type."""
    dup = offers.groupBy("event_id").agg((F.count("item") - F.count_distinct("item")).alias("dup"))
    hit = offers.join(shuffled(pool), (offers["event_id"] == pool["event_id"]) & (F.col("item") == F.col("pool_item")) & (F.col("round_type") == F.col("pool_type"))).groupBy(offers["event_id"]).agg(F.count(F.lit(1)).alias("hit"))
    t = events.join(shuffled(dup), "event_id", "left").join(shuffled(hit), "event_id", "left")
    reason = first_reason((F.coalesce("dup", F.lit(0)) == 0, "duplicate_offer"), (F.coalesce("hit", F.lit(0)) == 0, "pool_overlap"))
    return t.withColumn("reason", reason).drop("dup", "hit")


def plan_warnings(members: DataFrame) -> DataFrame:
    """(warning, match_id, side, skill, members) from each side's own list of members, of which only the warnings are rows again."""
    t = members.groupBy("match_id", "side").agg(F.collect_list(F.struct("slot", "s0", F.array_compact(F.array_distinct(F.array("s1", "s2"))).alias("skills"))).alias("team"))
    slots = lambda x: F.array_distinct(F.transform(F.filter("team", lambda m: F.array_contains(m["skills"], x)), lambda m: m["slot"]))
    row = lambda name, skill, n: F.struct(F.lit(name).alias("warning"), skill.alias("skill"), n.cast("long").alias("members"))
    every = F.array_distinct(F.flatten(F.transform("team", lambda m: m["skills"])))
    many = F.filter(F.transform(every, lambda x: row("repeated_skill", x, F.size(slots(x)))), lambda r: r["members"] > 1)
    own = F.transform(F.filter("team", lambda m: F.array_contains(m["skills"], m["s0"])), lambda m: row("own_signature", m["s0"], F.lit(1)))
    return t.select("match_id", "side", F.explode(F.concat(many, own)).alias("x")).select("x.warning", "match_id", "side", "x.skill", "x.members")


def arriving_reasons(events: DataFrame) -> DataFrame:
    """V06 for rows that carry their own ``items``, ``round_type`` and ``own`` pool (null: none): no join, so it runs in a stream."""
    pool = F.transform(F.filter(F.coalesce("own", F.expr("CAST(array() AS array<struct<pool_type: string, pool_item: string>>)")), lambda p: p["pool_type"] == F.col("round_type")), lambda p: p["pool_item"])
    reason = first_reason((F.size("items") == F.size(F.array_distinct("items")), "duplicate_offer"), (~F.arrays_overlap("items", pool), "pool_overlap"))
    return events.select("event_id", reason.alias("reason"))


def repeated_keys(rows: DataFrame, **keys: Column) -> DataFrame:
    """(rule, key, n): keys that more than one row has, for each rule."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), c.alias("key")) for name, c in keys.items()])
    return rows.select(F.explode(each).alias("x")).groupBy("x.rule", "x.key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def rule_rows(rows: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(key, rule, ok): a row for each row and rule."""
    each = F.array(*[F.struct(F.lit(name).alias("rule"), ok.alias("ok")) for name, ok in rules.items()])
    return rows.select(key, F.explode(each).alias("r")).select(key, "r.rule", "r.ok")
