"""Session settings and the shared folder that iterative operators write to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "matchloom", master: str | None = None, **conf) -> SparkSession:
    """A session with UTC time and adaptive execution; cluster settings stay the caller's."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    return b.config(map=base | {k.replace("__", "."): str(v) for k, v in conf.items()}).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Only a session on one machine may lack one and gets a local folder."""
    conf = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if conf:
        return conf.rstrip("/")
    set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    if set_dir.isEmpty():
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        set_dir = spark.sparkContext._jsc.sc().getCheckpointDir()
    return set_dir.get().rstrip("/")


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors, and is computed once."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)  # a given schema spares a job that would look for it


def shuffled(df: DataFrame) -> DataFrame:
    """Joined by a shuffle of both sides, whatever size Spark estimates.

    Its estimates are those of compressed files and of rows before they are exploded; tables that grow with the input may
    seem small enough to be sent through the driver when they are not."""
    return df.hint("merge")


#: Bytes of files whose rows a task sorts at a time, and those that are worth a task of their own (fixed values).
TASK_BYTES, LEAST_BYTES = 4 << 20, 1 << 18


def spread(df: DataFrame, source: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as the files of ``source`` ask for: what one task sorts doesn't grow with the input.

    Files are much smaller than rows in memory, so partitions that adaptive execution joins by their compressed size hold too much for a sort."""
    size = int(source._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if size >= 1 << 50:  # not a table of files
        return df.repartition(*keys)
    n = max(-(-size // TASK_BYTES), min(df.sparkSession.sparkContext.defaultParallelism, -(-size // LEAST_BYTES)), 1)
    return df.repartition(min(n, 10_000), *keys)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
