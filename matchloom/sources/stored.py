"""Tables that are changed in place: insert if absent (D09), bounded purge.

A table is a folder. Its rows lie in places (hash buckets or ranges of ids, an expression of the caller's); each place is one
folder of Parquet files. A version is a small file that names the folder of every place and carries the table's notes; the version with the largest number
counts. A change writes new folders for the places it touches, and only those, and then creates the next version's file, which fails if
another writer has created it. So a reader sees all of a change or nothing, a writer that dies leaves the old version and folders
that nobody names (``vacuum`` deletes them), and a change that is run again starts from what is there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import materialize


#: Ranges of ids that an aged table is kept in, at most, and the least width of one (fixed values).
RANGES, WIDTH = 256, 1 << 12


def range_width(last: int) -> int:
    """The width of ranges up to the id ``last``: their number doesn't grow with the table."""
    return max(WIDTH, -(-(last + 1) // RANGES))


class Conflict(RuntimeError):
    """Another writer has changed the table since it was read."""


class StoredTable:
    """``schema``: DDL of the rows; ``place``: SQL of a row's place, a whole number; places are few (their folders are named in one file);
    ``key``: a column that splits a large place."""

    def __init__(self, spark: SparkSession, root: str, schema: str, place: str, key: str):
        self.spark, self.root, self.schema, self.place, self.key = spark, root.rstrip("/"), schema, place, key

    def _path(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, folder: str) -> list[str]:
        fs, p = self._path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def version(self) -> dict:
        """Number, notes and folders of the newest version."""
        names = [n for n in self._names("versions") if n.isdigit()]
        if not names:
            return {"number": 0, "notes": {}, "folders": {}}
        fs, p = self._path(f"versions/{names[-1]}")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def commit(self, old: dict, folders: dict[str, str], notes: dict) -> dict:
        """Names the next version after ``old``; the places in ``folders`` are replaced, an empty name drops one."""
        new = {"number": old["number"] + 1, "notes": old["notes"] | notes, "folders": {k: f for k, f in (old["folders"] | folders).items() if f}}
        name = f"{new['number']:012d}"
        staged_fs, staged = self._path(f"versions/.{name}-{uuid.uuid4().hex}")
        out = staged_fs.create(staged, False)
        out.write(bytearray(json.dumps(new).encode()))
        out.close()
        fs, p = self._path(f"versions/{name}")
        if fs.exists(p) or not fs.rename(staged, p):
            fs.delete(staged, False)
            raise Conflict(f"version {name} of {self.root} is another writer's")
        return new

    def read(self, places: Iterable[int] | None = None, version: dict | None = None) -> DataFrame:
        """All rows, or those of some places."""
        folders = (version or self.version())["folders"]
        names = list(folders) if places is None else [str(k) for k in places if str(k) in folders]
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.root}/{folders[k]}" for k in names])

    def write(self, rows: DataFrame, places: Iterable[int]) -> dict[str, str]:
        """New folders with all rows of ``places``: the argument of ``commit``."""
        name = f"data-{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], self.schema).columns
        # tasks get ranges of places and keys: a large place isn't one task's, and a task doesn't write a file for every place
        t = rows.select(*columns, F.expr(self.place).alias("_place")).repartitionByRange("_place", self.key)
        t.write.partitionBy("_place").parquet(f"{self.root}/{name}")
        have = {n.removeprefix("_place=") for n in self._names(name) if n.startswith("_place=")}
        return {str(k): f"{name}/_place={k}" if str(k) in have else "" for k in places}

    def vacuum(self, keep: int = 2) -> None:
        """Deletes all but the last ``keep`` versions and the folders that these don't name. Not while another writer is at work."""
        names = [n for n in self._names("versions") if n.isdigit()]
        named: set[str] = set()
        for n in names[-keep:]:
            fs, p = self._path(f"versions/{n}")
            stream = fs.open(p)
            named |= {f.split("/")[0] + "/" + f.split("/")[1] for f in json.loads(bytes(stream.readAllBytes()).decode())["folders"].values()}
            stream.close()
        gone = [f"versions/{n}" for n in names[:-keep]]
        for data in [n for n in self._names("") if n.startswith("data-")]:
            parts = [f"{data}/{n}" for n in self._names(data) if n.startswith("_place=")]
            gone += [p for p in parts if p not in named] if any(p in named for p in parts) else [data]
        for name in gone:
            fs, p = self._path(name)
            fs.delete(p, True)


class KeyedStore(StoredTable):
    """Rows with a unique key. ``content``: the column that tells whether two rows of a key are the same."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, content: str, buckets: int = 16):
        super().__init__(spark, root, schema, f"pmod(xxhash64({key}), {buckets})", key)
        self.content = content

    def insert(self, rows: DataFrame, order: str, batch: int) -> None:
        """Adds the first row, by ``order``, of each key that the table lacks; logs every arrival as accepted, duplicate or conflict.

        Batches come by rising number; one that is already in adds nothing. Only buckets with new keys are written, others aren't even read again."""
        old = self.version()
        if batch <= old["notes"].get("batch", -1):
            return
        key, content = self.key, self.content
        rows = materialize(rows.withColumn("_at", F.expr(self.place)), "arrivals")
        first = rows.groupBy(key).agg(F.min_by(F.struct("*"), order).alias("row"))
        touched = [r["_at"] for r in rows.select("_at").distinct().collect()]  # buckets: a fixed number at most
        held = self.read(touched, old).select(F.col(key).alias("_key"), F.col(content).alias("_held"))
        t = materialize(first.join(held, F.col(key) == F.col("_key"), "left").select(F.col(key).alias("_k"), "row", F.coalesce("_held", F.col(f"row.{content}")).alias("_holder"), F.col("_key").isNull().alias("_new")), "holders")
        same, winner = F.col(content) == F.col("_holder"), F.col("_new") & (F.col(order) == F.col(f"row.{order}"))
        status = F.when(winner, "accepted").when(same, "duplicate").otherwise("conflict")
        rows.join(t, F.col(key) == F.col("_k")).select(F.col(key), F.col(order), status.alias("status")).write.mode("overwrite").parquet(f"{self.root}/log/batch={batch}")
        new = t.filter("_new").select("row.*")
        grown = [r["_at"] for r in new.select("_at").distinct().collect()]
        columns = self.spark.createDataFrame([], self.schema).columns
        folders = self.write(self.read(grown, old).unionByName(new.select(*columns)), grown) if grown else {}
        self.commit(old, folders, {"batch": batch})

    def log(self) -> DataFrame:
        """(key, order, status, batch) of all arrivals of the batches that are in."""
        return self.spark.read.parquet(f"{self.root}/log").filter(F.col("batch") <= self.version()["notes"].get("batch", -1))


class AgedTable(StoredTable):
    """Rows with rising ids, in ranges of ``width`` ids, that go once they are old and have been used."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, arrived: str, width: int):
        super().__init__(spark, root, schema, f"{key} div {width}", key)
        self.arrived, self.width = arrived, width

    def load(self, rows: DataFrame) -> None:
        old = self.version()
        places = [r["_p"] for r in rows.select(F.expr(self.place).alias("_p")).distinct().collect()]  # ranges
        self.commit(old, self.write(self.read(places, old).unionByName(rows), places), {})

    def used_up_to(self, cursor: int) -> None:
        """Rows with ids up to ``cursor`` are in the aggregates and may go."""
        old = self.version()
        self.commit(old, {}, {"cursor": max(cursor, old["notes"].get("cursor", -1))})

    def purge(self, cursor: int, before, most: int = 10_000) -> int:
        """Deletes rows with ids up to ``cursor`` that arrived before ``before``, smallest ids first, ``most`` at most; returns how many.

        Refuses a cursor beyond what has been used. Only ranges that lose rows are written."""
        old = self.version()
        if cursor > old["notes"].get("cursor", -1):
            raise ValueError("rows that haven't been used would go")
        upto = [int(k) for k in old["folders"] if int(k) <= cursor // self.width]
        aged = self.read(upto, old).filter((F.col(self.key) <= cursor) & (F.col(self.arrived) < F.lit(before)))
        gone = materialize(aged.select(self.key, F.expr(self.place).alias("_p")).orderBy(self.key).limit(most), "purge")
        touched = [r["_p"] for r in gone.select("_p").distinct().collect()]  # ``most`` at most
        if not touched:
            return 0
        left = self.read(touched, old).join(F.broadcast(gone.select(self.key)), self.key, "left_anti")  # ``most`` ids at most
        self.commit(old, self.write(left, touched), {})
        return gone.count()
