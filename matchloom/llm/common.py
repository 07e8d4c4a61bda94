"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import materialize, shared_dir, table  # noqa: F401


#: Keys with one in HOT of the rows are joined by broadcast: HOT keys at most.
HOT = 1000


def small_batches(spark: SparkSession, rows: int = 512) -> None:
    """Arrow batches of few rows, since one row may hold a very long text."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def n_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def uniform(seed: str, *cols) -> F.Column:
    """A number in [0, 1) from a hash of the columns' text; the same in any engine with md5."""
    key = F.concat_ws(":", F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols])
    return F.conv(F.substring(F.md5(key), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def with_hot_keys(rows: DataFrame, stats: DataFrame, keys: list[str], size: str) -> DataFrame:
    """``rows`` with the columns of ``stats``, which has a row for each key (nulls are keys) and its number of ``rows`` as ``size``.

    ``size`` sums to the rows, so at most HOT keys hold one in HOT of them; those are sent to all tasks."""
    total = stats.agg(F.sum(size)).first()[0] or 0
    hot = F.col(size) * HOT >= total
    own = {k: free_name(rows, f"_of_{k}") for k in keys}
    stats = stats.withColumnsRenamed(own)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(x)) for k, x in own.items()])
    few = stats.filter(hot)
    much = rows.join(F.broadcast(few), same)
    rest = rows.join(F.broadcast(few.select(*own.values())), same, "left_anti").join(stats.filter(~hot), same)
    return much.unionByName(rest).drop(size, *own.values())
