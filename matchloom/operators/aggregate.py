"""Aggregations over matches and choice events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.operators.windows import numbered

#: Strength of the smoothing prior, and of the selection adjustment (fixed values).
SMOOTHING, SELECTION, CLIP, HERO_STRENGTH, SKILL_STRENGTH = 5, 20.0, 2.0, 0.4, 0.3
SLOTS = {"H": 6, "S": 12}


def smoothed_rates(members: DataFrame, carried: DataFrame) -> DataFrame:
    """Wins, losses and win rates of heroes and skills, shrunk toward the global rate."""
    h = members.select(F.lit("hero").alias("kind"), F.col("hero").alias("name"), "won", F.lit(0).alias("shadow"))
    s = carried.select(F.lit("skill").alias("kind"), F.col("skill").alias("name"), "won", F.expr("if(cast(substring(skill, 2) as int) % 10 = 9, 1, 0)").alias("shadow"))
    prior = members.agg(F.avg("won").alias("prior"))  # one row
    t = h.unionByName(s).groupBy("kind", "name").agg(F.sum("won").alias("wins"), F.count(F.lit(1)).alias("total"), F.sum("shadow").alias("shadow_total"))
    t = t.crossJoin(F.broadcast(prior))
    smooth = (F.col("wins") + F.col("prior") * SMOOTHING) / (F.col("total") + SMOOTHING)
    return t.select("kind", "name", "wins", (F.col("total") - F.col("wins")).alias("losses"), "total", "shadow_total", F.round(F.col("wins") / F.col("total"), 4).alias("win_rate"), F.round(smooth, 4).alias("smoothed"))


def expected_appearances(matches: DataFrame, heroes: DataFrame, skills: DataFrame) -> DataFrame:
    """Appearances an item would have if each season's slots were shared by the items it has."""
    seasons = matches.filter("season IS NOT NULL").groupBy("season").agg(F.count(F.lit(1)).alias("battles"))
    h = heroes.select(F.lit("H").alias("family"), F.col("hero").alias("name"), F.col("season").alias("intro"))
    s = skills.filter("NOT is_signature").select(F.lit("S").alias("family"), F.col("skill").alias("name"), F.col("season").alias("intro"))
    items = h.unionByName(s)
    intro = items.groupBy("family", "intro").agg(F.count(F.lit(1)).alias("n"))
    # a range condition over the season grid, a row for each family and season
    free = seasons.join(intro, F.col("intro") <= F.col("season")).groupBy("family", "season", "battles").agg(F.sum("n").alias("available"))
    share = free.select(F.col("family").alias("f"), "season", (F.col("battles") * F.when(F.col("family") == "H", SLOTS["H"]).otherwise(SLOTS["S"]) / F.col("available")).alias("share"))
    return items.join(F.broadcast(share), (F.col("family") == F.col("f")) & (F.col("intro") <= F.col("season"))).groupBy("family", "name").agg(F.sum("share").alias("expected"))


def selection_adjustment(expected: DataFrame, members: DataFrame, carried: DataFrame) -> DataFrame:
    """Bounded log-ratio of observed to expected appearances."""
    h = members.filter("season IS NOT NULL").groupBy(F.lit("H").alias("family"), F.col("hero").alias("name")).agg(F.count(F.lit(1)).alias("o"))
    s = carried.filter("season IS NOT NULL").groupBy(F.lit("S").alias("family"), F.col("skill").alias("name")).agg(F.count(F.lit(1)).alias("o"))
    t = expected.join(h.unionByName(s), ["family", "name"], "left").withColumn("observed", F.coalesce("o", F.lit(0)))
    ratio = F.log((F.col("observed") + SELECTION) / (F.col("expected") + SELECTION))
    strength = F.when(F.col("family") == "H", HERO_STRENGTH).otherwise(SKILL_STRENGTH)
    return t.select("family", "name", "observed", F.round(F.col("observed") / F.col("expected"), 6).alias("usage_ratio"), F.round(strength * F.greatest(F.lit(-CLIP), F.least(F.lit(CLIP), ratio)), 6).alias("adjustment"))


def appearance_buckets(weights: DataFrame) -> DataFrame:
    """Mean and largest absolute weight by family and support; empty buckets stay."""
    spark = weights.sparkSession
    grid = spark.createDataFrame([(f, b) for f in ("H", "S", "HP", "HS", "SP") for b in ("0-19", "20-99", "100-499", "500+")], "family string, bucket string")
    b = F.when(F.col("support") < 20, "0-19").when(F.col("support") < 100, "20-99").when(F.col("support") < 500, "100-499").otherwise("500+")
    t = weights.groupBy("family", b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("weight")).alias("mean_abs"), F.max(F.abs("weight")).alias("max_abs"))
    t = grid.join(t, ["family", "bucket"], "left")
    return t.select("family", "bucket", F.coalesce("n", F.lit(0)).alias("n"), F.round(F.coalesce("mean_abs", F.lit(0.0)), 6).alias("mean_abs"), F.round(F.coalesce("max_abs", F.lit(0.0)), 6).alias("max_abs"))


def split_balance(rows: DataFrame, group: str) -> DataFrame:
    """Rows, groups and side wins of each split, by source and in all; one pass with grouping sets."""
    t = rows.withColumn("source", F.explode(F.array("source", F.lit("all"))))
    return t.groupBy("split", "source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(group).alias("groups"), F.count_if(F.expr("winner = 1")).alias("side1"), F.count_if(F.expr("winner = 2")).alias("side2"))


def round_counts(events: DataFrame) -> DataFrame:
    """All ten rounds, with position vectors."""
    rounds = events.sparkSession.range(1, 11).select(F.col("id").cast("int").alias("round"))
    n = lambda c, i: F.count_if(F.col(c) == i)
    t = events.groupBy("round").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("chosen") == F.col("recommended")).alias("accepted"), *[n("chosen", i).alias(f"chosen{i}") for i in range(3)], *[n("recommended", i).alias(f"rec{i}") for i in range(3)])
    return rounds.join(t, "round", "left").na.fill(0)


def item_counts(events: DataFrame, offers: DataFrame) -> DataFrame:
    """Offers, picks and events of each item, beside the events that could have offered it."""
    t = offers.groupBy("round_type", "item").agg(F.count(F.lit(1)).alias("offers"), F.count_distinct("event_id").alias("events"), F.count_if(F.col("option") == F.col("chosen")).alias("picks"))
    chances = events.groupBy("round_type").agg(F.count(F.lit(1)).alias("opportunities"))  # two rows
    return t.join(F.broadcast(chances), "round_type")


def _margin():
    s = F.array("score0", "score1", "score2")
    return F.round(F.array_max(s) - F.get(F.array_sort(s), F.lit(1)), 6)


def margin_buckets(events: DataFrame) -> DataFrame:
    """A08."""
    m = _margin()
    b = F.when(m == 0, "tie").when(m <= 1, "0-1").when(m <= 3, "1-3").otherwise("over 3")
    return events.groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("chosen") == F.col("recommended")).alias("accepted"))


def bounded_counts(rows: DataFrame, name: str, floor: int, most: int) -> DataFrame:
    """Counts of the most frequent names at or over a floor; the others are one row, totals stay.

    The top names come from a distributed top-k, so no window holds all of them."""
    n = rows.groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    top = n.orderBy(F.desc("n"), name).limit(most).filter(F.col("n") >= floor).select(F.col(name).alias("kept"))
    t = n.join(F.broadcast(top), F.col(name) == F.col("kept"), "left")
    return t.groupBy(F.coalesce("kept", F.lit("other")).alias(name)).agg(F.sum("n").alias("n"))


def hll_rank(key, p: int = 10) -> tuple:
    """A10: the register of a key, the first ``p`` bits of its hash, and its rank, one more than the zeros that lead the rest of 64 bits."""
    h = F.sha2(F.col(key).cast("string"), 256)
    head = F.conv(F.substring(h, 1, 3), 16, 10).cast("long")
    rest = F.shiftleft(head.bitwiseAND((1 << (12 - p)) - 1), 52).bitwiseOR(F.conv(F.substring(h, 4, 13), 16, 10).cast("long"))
    return F.shiftright(head, 12 - p), F.lit(65 - p) - F.when(rest > 0, F.char_length(F.bin(rest))).otherwise(0)


def hll_registers(rows: DataFrame, key: str, p: int = 10) -> DataFrame:
    """A10: registers that can be merged by their maximum: (register, rank)."""
    register, rank = hll_rank(key, p)
    return rows.select(register.alias("register"), rank.cast("long").alias("rank")).groupBy("register").agg(F.max("rank").alias("rank"))


def hll_estimate(registers: DataFrame, events: DataFrame, p: int = 10) -> DataFrame:
    """A10: one row (estimate, registers): the harmonic estimate, linear counting while it is under 2.5 a register and
    some are empty, and never more than the number of ``events``, one row (n)."""
    m = 1 << p
    t = registers.agg(F.count(F.lit(1)).alias("filled"), F.coalesce(F.sum(F.pow(F.lit(2.0), -F.col("rank"))), F.lit(0.0)).alias("weight"))
    empty = m - F.col("filled")
    raw = F.lit(0.7213 / (1 + 1.079 / m) * m * m) / (F.col("weight") + empty)
    linear = m * F.log(m / F.when(empty > 0, empty))
    best = F.round(F.when((raw <= 2.5 * m) & (empty > 0), linear).otherwise(raw)).cast("long")
    return t.crossJoin(F.broadcast(events)).select(F.least(best, F.col("n")).alias("estimate"), F.col("filled").alias("registers"))  # one row each


def leaderboard(rows: DataFrame, name: str) -> DataFrame:
    """Named contributors by accepted rows."""
    t = rows.filter(F.trim(name) != "").groupBy(name).agg(F.count(F.lit(1)).alias("n"))
    return numbered(t, "rank", F.desc("n"), F.asc(name))


def softmax(events: DataFrame) -> DataFrame:
    """Probabilities of the three options, shifted by the largest score."""
    top = F.greatest("score0", "score1", "score2")
    total = sum((F.exp(F.col(f"score{i}") - top) for i in range(3)), F.lit(0.0))
    return events.withColumns({f"p{i}": F.exp(F.col(f"score{i}") - top) / total for i in range(3)})


def calibration(events: DataFrame) -> DataFrame:
    """Ten bins of the top probability; the parts add up to the expected calibration error."""
    t = softmax(events).select(F.greatest("p0", "p1", "p2").alias("conf"), F.when(F.col("chosen") == F.col("recommended"), 1).otherwise(0).alias("hit"))
    g = t.groupBy(F.least(F.lit(9), F.floor(F.col("conf") * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("c"), F.sum("hit").alias("h"))
    total = g.agg(F.sum("n").alias("all"))  # one row
    g = g.crossJoin(F.broadcast(total))
    return g.select("bin", "n", F.round(F.col("c") / F.col("n"), 6).alias("confidence"), F.round(F.col("h") / F.col("n"), 6).alias("accuracy"), F.round(F.abs(F.col("h") - F.col("c")) / F.col("all"), 6).alias("ece_part"))


def suppressed(offers: DataFrame, floor: int = 10) -> DataFrame:
    """Rates of items offered fewer than ``floor`` times are null."""
    t = offers.groupBy("round_type", "item").agg(F.count(F.lit(1)).alias("offers"), F.count_if(F.col("option") == F.col("chosen")).alias("picks"))
    return t.select("round_type", "item", "offers", (F.col("offers") < floor).alias("suppressed"), F.when(F.col("offers") >= floor, F.round(F.col("picks") / F.col("offers"), 6)).alias("pick_rate"))


def disagreement(events: DataFrame, meaningful: float = 0.1, floor: int = 10) -> DataFrame:
    """How often the most probable option isn't the chosen one, by round."""
    t = softmax(events)
    top = F.when((F.col("p0") >= F.col("p1")) & (F.col("p0") >= F.col("p2")), 0).when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    s = F.array("p0", "p1", "p2")
    t = t.select("round", (top != F.col("chosen")).alias("off"), (F.array_max(s) - F.get(F.array_sort(s), F.lit(1))).alias("margin"))
    n = F.count(F.lit(1))
    return t.groupBy("round").agg(F.count_if("off").alias("differs"), F.count_if(F.col("off") & (F.col("margin") >= meaningful)).alias("meaningful"), F.count_if(~F.col("off")).alias("agrees"), F.when(n >= floor, F.round(F.avg("margin"), 6)).alias("mean_margin"))
