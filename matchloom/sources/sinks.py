"""A sink that publishes all of a table or nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame


def publish(df: DataFrame, root: str, check: Callable[[DataFrame], bool] = lambda _: True) -> str:
    """Writes a new version under ``root``, checks what was written, and only then names it in ``CURRENT``.

    Readers take the version from ``current``; a failed check or a lost driver leaves the old one."""
    spark = df.sparkSession
    path = f"{root}/version-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not check(spark.read.parquet(path)):
        raise ValueError("the written table fails its check")
    jvm = spark._jvm
    fs = jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(jvm.org.apache.hadoop.fs.Path(f"{root}/CURRENT"), True)
    out.write(bytearray(path.encode()))
    out.close()
    return path


def current(spark, root: str) -> str:
    return spark.read.text(f"{root}/CURRENT").first()[0]
