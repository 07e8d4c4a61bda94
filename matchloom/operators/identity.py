"""Fingerprints, duplicates and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _team_text(members: DataFrame) -> DataFrame:
    member = F.concat_ws(":", "hero", "s0", "s1", "s2")
    rows = F.sort_array(F.collect_list(F.struct("slot", member.alias("m"))))
    return members.groupBy("match_id", "side").agg(F.array_join(F.transform(rows, lambda x: x["m"]), ";").alias("team"), F.max("winner").alias("winner"), F.max("uploader").alias("uploader"))


def semantic_fingerprint(members: DataFrame) -> DataFrame:
    """Sides in canonical order, positions kept, the winner following its side, uploader included."""
    t = _team_text(members)
    one = F.max(F.when(F.col("side") == 1, F.col("team"))).alias("a")
    two = F.max(F.when(F.col("side") == 2, F.col("team"))).alias("b")
    t = t.groupBy("match_id").agg(one, two, F.max("winner").alias("winner"), F.max("uploader").alias("uploader"))
    won = F.when(F.col("a") == F.col("b"), "1").when(F.col("b") < F.col("a"), (3 - F.col("winner")).cast("string")).otherwise(F.col("winner").cast("string"))
    text = F.concat_ws("|", F.lit("v1"), F.col("uploader").cast("string"), F.least("a", "b"), F.greatest("a", "b"), won)
    return t.select("match_id", F.sha2(text, 256).alias("fingerprint"))


def matchup_fingerprint(members: DataFrame) -> DataFrame:
    """Heroes and skills sorted, winner and source left out."""
    member = F.concat(F.col("hero"), F.lit(":"), F.array_join(F.sort_array(F.array("s0", "s1", "s2")), ","))
    side = members.groupBy("match_id", "side").agg(F.array_join(F.sort_array(F.collect_list(member)), ";").alias("t"))
    return side.groupBy("match_id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("t")), "|"), 256).alias("matchup"))


def cap_per_key(rows: DataFrame, key: str, order: str, most: int = 2) -> DataFrame:
    """At most ``most`` rows of a key, in order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most)


def first_appearance(snapshots: DataFrame) -> DataFrame:
    """The first snapshot of each id, and how often it is repeated."""
    return snapshots.groupBy("id").agg(F.min("snapshot").alias("first_snapshot"), (F.count(F.lit(1)) - 1).alias("repeats"))


def content_version(rows: DataFrame, text) -> DataFrame:
    """A hash of all rows that doesn't depend on their order, in two levels so that no string grows with the table.

    Rows are hashed and dealt to 256 buckets by the hash; each bucket adds its hashes as numbers."""
    h = rows.select(F.sha2(text, 256).alias("h"))
    part = h.groupBy(F.substring("h", 1, 2).alias("bucket")).agg(F.sum(F.conv(F.substring("h", 3, 12), 16, 10).cast("decimal(38,0)")).alias("total"), F.count(F.lit(1)).alias("n"))
    return part.agg(F.sha2(F.array_join(F.sort_array(F.collect_list(F.concat_ws(":", "bucket", F.col("total").cast("string"), F.col("n").cast("string")))), "\n"), 256).alias("version"))
