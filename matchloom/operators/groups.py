"""Leakage groups, stable splits and their checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchloom.operators.components import connected_components
from matchloom.session import materialize, shuffled


def roster_groups(matches: DataFrame, rosters: DataFrame) -> DataFrame:
    """(match_id, component): matches that share a roster, directly or over others, are one group.

    Each roster links its matches to its smallest one, so a popular roster costs a row for each match."""
    first = rosters.groupBy("roster").agg(F.min("match_id").alias("first"))
    edges = rosters.join(first, "roster").select(F.col("first").alias("a"), F.col("match_id").alias("b"))
    cc = connected_components(edges, "a", "b")
    return matches.select("match_id").join(shuffled(cc), F.col("match_id") == F.col("node"), "left").select("match_id", F.coalesce("component", "match_id").alias("component"))


def session_links(reports: DataFrame, minutes: int = 30) -> DataFrame:
    """(id, first): each report with the first of its capture session.

    Reports of one source (of one uploader, for uploads by others) are a session while gaps are at most ``minutes``;
    an external report is its own. A source's runs are found by a sort within days: a day's first reports tell
    whether its predecessor's last one is near. Runs that go on over midnight are joined by ``last_start``, so no window holds all of a source."""
    part = F.when(F.col("source") == "own", "own").when(F.col("source") == "others", F.concat_ws(":", F.lit("others"), F.col("uploader").cast("string"))).otherwise(F.concat_ws(":", F.lit("external"), F.col("id").cast("string")))
    t = reports.select("id", "captured_at", part.alias("part")).distinct().withColumn("day", F.to_date("captured_at"))
    ends = t.groupBy("part", "day").agg(F.max("captured_at").alias("last"))
    gap = F.expr(f"INTERVAL {minutes} MINUTES")
    w = Window.partitionBy("part", "day").orderBy("captured_at", "id")
    before = ends.select(F.col("part").alias("p"), F.date_add("day", 1).alias("d"), F.col("last").alias("eve"))
    t = t.join(shuffled(before), (F.col("part") == F.col("p")) & (F.col("day") == F.col("d")), "left")
    prev = F.coalesce(F.lag("captured_at").over(w), F.col("eve"))
    t = t.withColumn("new", F.coalesce(F.col("captured_at") - prev > gap, F.lit(True)).cast("int"))
    t = t.withColumn("visit", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = t.groupBy("part", "day", "visit").agg(F.min(F.struct("captured_at", "id", "new")).alias("head"), F.max("captured_at").alias("tail"))
    # a run that starts without a new session goes on from the last run of the day before
    named = last_start(runs.select("part", "day", "visit", F.when(F.col("head.new") == 1, F.col("head.id")).alias("start")), "part", ("day", "visit"), "start").withColumnRenamed("start", "first")
    return t.join(shuffled(named), ["part", "day", "visit"]).select("id", "first")


def last_start(rows: DataFrame, by: str, order: tuple[str, ...], start: str) -> DataFrame:
    """``rows`` with ``start`` filled from the last row of the same key, in order, that has one: a scan over ranges, not keys.

    Rows are sorted into ranges of about equal size, whatever their keys. A range is filled on its own; what is still open at its
    beginning comes from the key's last start in the ranges before, of which there is a row for each range and key that meet."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(rows.repartitionByRange(n, by, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    place = F.struct(*order)
    tails = t.groupBy("_range", by).agg(F.max_by(F.col(start), F.when(F.col(start).isNotNull(), place)).alias("_tail"))
    before = Window.partitionBy(by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges at most
    carried = tails.select("_range", by, F.last("_tail", ignorenulls=True).over(before).alias("_carried"))
    own = Window.partitionBy("_range", by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn(start, F.last(start, ignorenulls=True).over(own)).join(carried, ["_range", by])
    return t.withColumn(start, F.coalesce(start, "_carried")).select(*rows.columns)


def evaluation_groups(reports: DataFrame, near: DataFrame) -> DataFrame:
    """(id, component): sessions and near-duplicate matches, merged wherever they meet."""
    edges = session_links(reports).filter("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b")).unionByName(near.select("a", "b"))
    cc = connected_components(edges, "a", "b")
    return reports.select("id").distinct().join(shuffled(cc), F.col("id") == F.col("node"), "left").select("id", F.coalesce("component", "id").alias("component"))


def group_ids(rows: DataFrame, group: str, member: str) -> DataFrame:
    """An id of a group that depends on its members only, whatever their order.

    Members' hashes are added as numbers, so a group of any size costs a row for each task."""
    h = F.sha2(F.col(member).cast("string"), 256)
    parts = [F.sum(F.conv(F.substring(h, i, 12), 16, 10).cast("decimal(38,0)")).alias(f"p{i}") for i in (1, 13)]
    t = rows.groupBy(group).agg(*parts, F.count(F.lit(1)).alias("n"))
    return t.select(group, F.substring(F.sha2(F.concat_ws(":", *[F.col(f"p{i}").cast("string") for i in (1, 13)], F.col("n").cast("string")), 256), 1, 16).alias("group_id"), "n")


def holdout(groups: DataFrame, g: str, fraction: float, seed: str) -> DataFrame:
    """Whole groups held out in the order of a salted hash, ``max(1, round(n * fraction))`` of them, one stays in.

    The last held hash comes from a distributed top-k of group ids, so no window holds all of them."""
    h = F.sha2(F.concat(F.lit(seed), F.lit("\0"), F.col(g).cast("string")), 256)
    t = groups.withColumn("h", h)
    n = t.count()
    k = min(n - 1, max(1, round(n * fraction)))
    cut = t.orderBy("h").limit(k).agg(F.max("h").alias("cut")) if k > 0 else t.limit(0).agg(F.max("h").alias("cut"))
    return t.crossJoin(F.broadcast(cut)).select(g, F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)).alias("held"))


def locked_split(matches: DataFrame, rosters: DataFrame, test: DataFrame) -> DataFrame:
    """A locked test set; matches that share a roster with it are excluded, the others train."""
    t = test.select("match_id").distinct()
    tainted = rosters.join(rosters.join(t, "match_id", "left_semi").select("roster").distinct(), "roster", "left_semi").select("match_id").distinct()
    m = matches.select("match_id").join(t.withColumn("is_test", F.lit(True)), "match_id", "left").join(tainted.withColumn("near", F.lit(True)), "match_id", "left")
    return m.select("match_id", F.when(F.col("is_test"), "test").when(F.col("near"), "excluded").otherwise("train").alias("split"))


def hash_holdout(rows: DataFrame, key: str, buckets: int) -> DataFrame:
    """Rows whose hash's first eight bytes are divisible by ``buckets``."""
    h = F.conv(F.substring(F.sha2(key, 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return rows.select(key, (h % buckets == 0).alias("held"))


def paired_delta(scored: DataFrame, by: str, group: str) -> DataFrame:
    """Differences of two models' metrics on the same rows (pa, pb, label), with intervals over the same draws.

    The first model is better only if the intervals of all three metrics say so."""
    from matchloom.operators.models import bootstrap, loss_sums

    names = ("accuracy", "log_loss", "brier")
    a, b = loss_sums(scored, by, group, "pa"), loss_sums(scored, by, group, "pb").drop("n").toDF("_by", "_group", *[f"_{m}" for m in names])
    both = a.join(b, a[by].eqNullSafe(b["_by"]) & a[group].eqNullSafe(b["_group"])).select(by, group, "n", *[(F.col(m) - F.col(f"_{m}")).alias(m) for m in names])
    t = bootstrap(both, by, group, names)
    better = (F.col("accuracy_low") > 0) & (F.col("brier_high") < 0) & (F.col("log_loss_high") < 0)
    return t.withColumn("verdict", F.when(F.coalesce(better, F.lit(False)), "better on all three").otherwise("inconclusive"))
