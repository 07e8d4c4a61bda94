"""Sessions, runs, ranks and top-k."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(rows: DataFrame, by: str, ts: str, tie: str, minutes: int) -> DataFrame:
    """Numbers each key's visits; a gap longer than ``minutes`` starts a new one."""
    w = Window.partitionBy(by).orderBy(ts, tie)
    late = F.col(ts) - F.lag(ts).over(w) > F.expr(f"INTERVAL {minutes} MINUTES")
    t = rows.withColumn("_new", F.when(F.coalesce(late, F.lit(True)), 1).otherwise(0))
    return t.withColumn("visit", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def numbered(rows: DataFrame, name: str, *order) -> DataFrame:
    """Adds the place of each row in an order of all rows, from 1, without a window over all of them.

    Rows are sorted into ranges; a range's rows are numbered in it and start after the ranges before. Ranges are as many
    as shuffle partitions, so the table of their sizes is short."""
    from matchloom.session import materialize

    t = rows.repartitionByRange(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("_range", F.spark_partition_id())
    t = materialize(t.withColumn("_own", F.row_number().over(Window.partitionBy("_range").orderBy(*order))), "numbered")
    sizes = t.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(F.col("_range").alias("_r"), (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    return t.join(F.broadcast(before), F.col("_range") == F.col("_r")).withColumn(name, F.col("_before") + F.col("_own")).drop("_range", "_own", "_r", "_before")


def runs(rows: DataFrame, by: str, n: str) -> DataFrame:
    """Runs of consecutive integers."""
    t = rows.withColumn("island", F.col(n) - F.row_number().over(Window.partitionBy(by).orderBy(n)))
    return t.groupBy(by, "island").agg(F.min(n).alias("first_id"), F.max(n).alias("last_id"), F.count(F.lit(1)).alias("n")).drop("island")


def ranked_rates(members: DataFrame) -> DataFrame:
    """The catalog's heroes by strength; the rank table has a row for each hero."""
    prior = members.agg(F.avg("won").alias("prior"))
    t = members.groupBy(F.col("hero").alias("name")).agg(F.sum("won").alias("w"), F.count(F.lit(1)).alias("total")).crossJoin(F.broadcast(prior))
    t = t.select("name", "total", F.round((F.col("w") + F.col("prior") * 5) / (F.col("total") + 5), 4).alias("strength"))
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("strength"), F.desc("total"), "name")).cast("long"))


def _top(rows: DataFrame, key: str, by: str, n: int) -> DataFrame:
    """The first n keys by a column, with their place; a distributed top-k, then a window over n rows."""
    t = rows.orderBy(F.desc(by), key).limit(n)
    return t.withColumn("place", F.row_number().over(Window.orderBy(F.desc(by), key)))


def interleave(rows: DataFrame, key: str, first: str, second: str, cap: int) -> DataFrame:
    """Two rankings taken in turn, each key at its earlier place, up to ``cap`` keys.

    No key behind place ``cap`` of both rankings can be among the first ``cap``."""
    a = _top(rows, key, first, cap).select(key, (2 * F.col("place")).alias("pos"))
    b = _top(rows, key, second, cap).select(key, (2 * F.col("place") + 1).alias("pos"))
    return a.unionByName(b).groupBy(key).agg(F.min("pos").cast("long").alias("pos")).orderBy("pos", key).limit(cap)


def top_by_either(rows: DataFrame, key: str, *lists: tuple[str, int]) -> DataFrame:
    """Keys among the first of any ranking."""
    parts = [_top(rows, key, by, n).select(key) for by, n in lists]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()
