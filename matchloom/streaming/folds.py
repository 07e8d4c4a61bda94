"""Streams of choice events: validation, deduplication, folds and sessions."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.session import shared_dir, shuffled


def landing(rows: DataFrame, order: str, files: int = 8, path: str | None = None, file_rows: int | None = None) -> str:
    """Writes rows as a folder of files that arrive in order, as a landing zone would hold them.

    Rows are cut into ``files`` ranges of ``order`` in one pass; each range then arrives as a whole, as one micro-batch of
    ``read``: rows of a range that came in a later micro-batch than others of it would be late for the watermark. For that all arrivals of a
    folder have the same number of files, more for larger ranges; those that have fewer are filled up with empty ones.
    Given a ``path``, files are added to what has landed there. ``file_rows``: rows of a file, about, where they are long."""
    spark = rows.sparkSession
    path = path or f"{shared_dir(spark)}/landing-{uuid.uuid4().hex}"
    t = rows.withColumn("_o", F.unix_micros(F.col(order).cast("timestamp")).cast("double") if dict(rows.dtypes)[order].startswith("timestamp") else F.col(order).cast("double"))
    cuts = t.approxQuantile("_o", [i / files for i in range(1, files)], 0.001) if files > 1 else []
    place = sum((F.when(F.col("_o") > c, 1).otherwise(0) for c in cuts), F.lit(0))
    staged = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    t.withColumn("_k", place).drop("_o").write.partitionBy("_k").parquet(staged)
    sizes = {r["_k"]: r["count"] for r in spark.read.parquet(staged).groupBy("_k").count().collect()}  # ``files`` numbers at most
    fs, folder = _folder(spark, path)
    held = _arrival_files(spark, path)
    each = held or max([1, *(-(-n // (file_rows or FILE_ROWS)) for n in sizes.values())])
    if not held:
        fs.mkdirs(_folder(spark, f"{path}/{_MARK}{each}")[1])
    count = lambda: sum(s.getPath().getName().startswith("part-") for s in fs.listStatus(folder))
    nothing = spark.createDataFrame([], rows.schema)
    for k in sorted(sizes):
        before = count()
        part = spark.read.schema(rows.schema).parquet(f"{staged}/_k={k}")
        (part.repartition(each) if each > 1 else part.coalesce(1)).write.mode("append").parquet(path)
        for _ in range(before + each - count()):
            nothing.write.mode("append").parquet(path)
    return path


#: Rows of a landed file, about, and events with their lists of features (fixed values).
FILE_ROWS, FILE_EVENTS = 250_000, 10_000
_MARK = "_arrival-"


def _folder(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _arrival_files(spark: SparkSession, path: str) -> int:
    """Files of each arrival in a landing folder; 0 if nothing has landed."""
    fs, p = _folder(spark, path)
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return max([0, *(int(n.removeprefix(_MARK)) for n in names if n.startswith(_MARK))])


def read(spark: SparkSession, path: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over what has landed, an arrival a micro-batch unless ``per_trigger`` gives a number of files."""
    n = per_trigger or _arrival_files(spark, path) or 1
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", n).parquet(path)


def drain(stream: DataFrame, each: Callable[[DataFrame, int], None], mode: str = "append", checkpoint: str | None = None) -> None:
    """Runs a stream over all that has landed; ``each`` gets (micro-batch, number).

    With a ``checkpoint`` folder of its own a later call goes on after the last finished micro-batch."""
    place = checkpoint or f"{shared_dir(stream.sparkSession)}/progress-{uuid.uuid4().hex}"
    stream.writeStream.outputMode(mode).option("checkpointLocation", place).foreachBatch(each).trigger(availableNow=True).start().awaitTermination()


def collect_stream(stream: DataFrame, mode: str = "append") -> DataFrame:
    """All rows a stream gives, by a Parquet sink; a batch that is sent again replaces itself."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/rows-{uuid.uuid4().hex}"
    drain(stream, lambda df, n: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), mode)
    schema = stream.schema
    return spark.read.schema(schema).option("recursiveFileLookup", True).parquet(out)


def quarantine(stream: DataFrame) -> DataFrame:
    """Rows without a ``reason`` go to one sink, the others to another; both together."""
    spark = stream.sparkSession
    out = f"{shared_dir(spark)}/arrived-{uuid.uuid4().hex}"

    def both(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            for name, part in (("accepted", rows.filter("reason IS NULL")), ("quarantine", rows.filter("reason IS NOT NULL"))):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")
        finally:
            rows.unpersist()

    drain(stream, both)
    sink = lambda name: spark.read.schema(stream.schema).option("recursiveFileLookup", True).parquet(f"{out}/{name}")
    return sink("accepted").unionByName(sink("quarantine"))


class Versions:
    """A table in a folder of the shared store, written anew by each micro-batch; a version counts once its marker is there.

    Nothing is kept in the object: another one on the same folder, in another process, goes on from the last version.
    The version before it stays, older ones are deleted."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/versions-{uuid.uuid4().hex}"

    def _fs(self, path: str):
        return _folder(self.spark, path)

    def _numbers(self) -> list[int]:
        fs, p = self._fs(self.root)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        done = lambda n: (lambda f, q: f.exists(q))(*self._fs(f"{self.root}/{n}/_SUCCESS"))
        return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version=") and done(n))

    def last(self) -> int:
        return max(self._numbers(), default=-1)

    def read(self) -> DataFrame | None:
        n = self.last()
        return self.spark.read.parquet(f"{self.root}/version={n}") if n >= 0 else None

    def write(self, table: DataFrame, number: int) -> None:
        table.write.mode("overwrite").parquet(f"{self.root}/version={number}")
        for n in self._numbers()[:-2]:
            fs, p = self._fs(f"{self.root}/version={n}")
            fs.delete(p, True)


class Fold:
    """Counters kept by micro-batches, added up or merged by another aggregate (``how``): each writes a new version of the state, the marker last.

    A batch number at or under the state's is not folded again, so replays add nothing, also after a restart."""

    def __init__(self, spark: SparkSession, keys: list[str], values: dict[str, Column], root: str | None = None, how: Callable = F.sum):
        self.keys, self.values, self.how, self.versions = keys, values, how, Versions(spark, root)

    def state(self) -> DataFrame | None:
        return self.versions.read()

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.versions.last():
            return
        now = batch.groupBy(*self.keys).agg(*[self.how(c).alias(n) for n, c in self.values.items()])
        if (old := self.state()) is not None:
            now = now.unionByName(old).groupBy(*self.keys).agg(*[self.how(n).alias(n) for n in self.values])
        self.versions.write(now, number)


class Admission:
    """At most ``most`` rows wait for the consumer; rows that find no room wait in the landing order and are lost never.

    State, one version a micro-batch: (id, state), state one of waiting, pending, done. A micro-batch first takes what the
    consumer has finished (the ``pace`` oldest pending rows), then admits rows by id while there is room. Ids of waiting rows are persisted,
    so back-pressure survives a restart; a micro-batch that is sent again finds its version there."""

    def __init__(self, spark: SparkSession, root: str | None = None, most: int = 500, pace: int = 20):
        self.spark, self.most, self.pace = spark, most, pace
        self.root = root or f"{shared_dir(spark)}/admission-{uuid.uuid4().hex}"
        self.versions = Versions(spark, f"{self.root}/state")

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.versions.last():
            return
        new = batch.select(F.col("id").cast("long").alias("id"), F.lit("waiting").alias("state"))
        old = self.versions.read()
        t = new if old is None else old.unionByName(new.join(old.select("id"), "id", "left_anti"))
        n = {r["state"]: r["count"] for r in t.groupBy("state").count().collect()}
        finished = min(self.pace, n.get("pending", 0))
        room = self.most - n.get("pending", 0) + finished
        # the smallest ids of a state: a top-k of at most ``most`` rows
        first = lambda state, k, then: t.filter(F.col("state") == state).orderBy("id").limit(k).select(F.col("id").alias("_id"), F.lit(then).alias("_then"))
        moved = first("pending", finished, "done").unionByName(first("waiting", room, "pending"))
        now = t.join(F.broadcast(moved), F.col("id") == F.col("_id"), "left").select("id", F.coalesce("_then", "state").alias("state"))
        self.versions.write(now, number)
        arrived = n.get("waiting", 0) + n.get("pending", 0) + n.get("done", 0)
        admitted = min(room, n.get("waiting", 0))
        row = (number, arrived, n.get("done", 0) + finished, n.get("pending", 0) - finished + admitted, n.get("waiting", 0) - admitted)
        self.spark.createDataFrame([row], "batch int, arrived long, done long, pending long, waiting long").coalesce(1).write.mode("overwrite").parquet(f"{self.root}/log/{number}")

    def log(self) -> DataFrame:
        """(batch, arrived, done, pending, waiting): totals after each micro-batch."""
        return self.spark.read.option("recursiveFileLookup", True).parquet(f"{self.root}/log")


def client_queues(stream: DataFrame, most: int = 50, days: int = 7) -> DataFrame:
    """(user_id, queued, oldest, last, at) after every change of a client's queue, by arbitrary state.

    A client's state is a list of its last ``most`` events with different ids that are no older than ``days`` before its newest one. A timer of
    event time clears the queue of a client that has been silent for so long after the watermark has passed. Rows: (user_id, event_id, at)."""
    import pandas as pd
    from pyspark.sql.streaming import StatefulProcessor

    span = days * 86_400_000_000

    class Queue(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "event_id long, ts long")

        def handleInputRows(self, key, rows, timerValues):
            held = dict(self.held.get()) if self.held.exists() else {}
            for part in rows:
                for e, at in zip(part["event_id"].tolist(), part["at"].astype("datetime64[us]").astype("int64").tolist(), strict=True):
                    held.setdefault(e, at)
            newest = max(held.values())
            kept = sorted((at, e) for e, at in held.items() if at >= newest - span)[-most:]
            self.held.put([(e, at) for at, e in kept])
            for t in self.handle.listTimers():
                self.handle.deleteTimer(t)
            self.handle.registerTimer((newest + span) // 1000 + 1)
            yield pd.DataFrame({"user_id": [key[0]], "queued": [len(kept)], "oldest": [min(e for _, e in kept)], "last": [newest]})

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            last = max(at for _, at in self.held.get())
            self.held.clear()
            yield pd.DataFrame({"user_id": [key[0]], "queued": [0], "oldest": [None], "last": [last + span]}).astype({"oldest": "Int64"})

        def close(self) -> None:
            pass

    # arbitrary state needs the embedded store
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = stream.withWatermark("at", "0 seconds").groupBy("user_id")
    return s.transformWithStateInPandas(Queue(), "user_id long, queued long, oldest long, last long", "update", "eventTime")


class Online:
    """The choice model's state under a folder, and each micro-batch's scores from before its update.

    Rows: (event_id, option, key, value, chosen); all rows of an event come in one micro-batch."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, root or f"{shared_dir(spark)}/online-{uuid.uuid4().hex}"
        self.versions = Versions(spark, f"{self.root}/state")

    def apply(self, batch: DataFrame, number: int) -> None:
        if number <= self.versions.last():
            return
        rows = batch.persist()
        try:
            state, scored = ftrl_step(self.versions.read(), rows.drop("chosen"), rows.select("event_id", "chosen").distinct())
            scored.write.mode("overwrite").parquet(f"{self.root}/scores/batch={number}")
            self.versions.write(state, number)
        finally:
            rows.unpersist()

    def apply_lists(self, batch: DataFrame, number: int) -> None:
        """``apply`` for rows (event_id, chosen, x), x the features of an event's options as ``option_lists`` gives them."""
        if number <= self.versions.last():
            return
        state, scored = ftrl_lists(self.versions.read(), batch)
        scored.write.mode("overwrite").parquet(f"{self.root}/scores/batch={number}")
        self.versions.write(state, number)

    def scores(self) -> DataFrame:
        """(batch, event_id, option, p, y)."""
        return self.spark.read.parquet(f"{self.root}/scores")


def _ftrl_weight(alpha: float, beta: float, l1: float, l2: float) -> Column:
    return F.when(F.abs("z") <= l1, 0.0).otherwise(-(F.col("z") - F.signum("z") * l1) / ((beta + F.sqrt("n")) / alpha + l2))


def _chances_task(known: dict, gradients: bool):
    """Scores (event_id, option, p, y) of events (event_id, chosen, x), or a task's sums of (p - y) times value (key, g)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        total: dict[str, float] = {}
        for b in batches:
            x = b.column("x")
            options = x.value_lengths().to_numpy(zero_copy_only=False)
            event = np.repeat(np.arange(b.num_rows), options)
            option, f = x.flatten().flatten()
            row = np.repeat(np.arange(len(option)), f.value_lengths().to_numpy(zero_copy_only=False))
            key, value = f.flatten().flatten()
            coded, value = key.dictionary_encode(), value.to_numpy(zero_copy_only=False)
            names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy(zero_copy_only=False)
            w = np.array([known.get(k, 0.0) for k in names])
            u = np.bincount(row, weights=value * w[code], minlength=len(option)) if len(code) else np.zeros(len(option))
            # shifted by the event's largest score, so that no score overflows
            top = np.full(b.num_rows, -np.inf)
            np.maximum.at(top, event, u)
            e = np.exp(u - top[event])
            p = e / np.bincount(event, weights=e, minlength=b.num_rows)[event]
            y = (option.to_numpy(zero_copy_only=False) == b.column("chosen").to_numpy(zero_copy_only=False)[event]).astype(np.float64)
            if gradients:
                for k, g in zip(names, np.bincount(code, weights=(p - y)[row] * value, minlength=len(names)).tolist(), strict=True):
                    total[k] = total.get(k, 0.0) + g
            else:
                yield pa.record_batch([b.column("event_id").take(pa.array(event)), option.cast(pa.int32()), pa.array(p), pa.array(y)], names=["event_id", "option", "p", "y"])
        if gradients:
            yield pa.record_batch([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.float64())], names=["key", "g"])

    return run


def ftrl_lists(state: DataFrame | None, events: DataFrame, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``ftrl_step`` for events (event_id, chosen, x) with lists of their options' features: an event is scored in its own row.

    Weights, of which there are as many as pairs of catalog items at most, are sent to the tasks; only the tasks' sums by key are shuffled."""
    w = _ftrl_weight(alpha, beta, l1, l2)
    known = {r["key"]: r["w"] for r in state.select("key", w.alias("w")).filter("w <> 0").collect()} if state is not None else {}
    x = events.select("event_id", "chosen", "x")
    scored = x.mapInArrow(_chances_task(known, False), "event_id long, option int, p double, y double")
    g = x.mapInArrow(_chances_task(known, True), "key string, g double").groupBy("key").agg(F.sum("g").alias("g"))
    old = state if state is not None else state_rows(events.sparkSession)
    t = old.join(shuffled(g), "key", "full").select("key", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("n", F.lit(0.0)).alias("n"), "g").withColumn("w", w).withColumn("n2", F.col("n") + F.col("g") * F.col("g"))
    fresh = F.col("g").isNotNull()
    z = F.when(fresh, F.col("z") + F.col("g") - (F.sqrt("n2") - F.sqrt("n")) / alpha * F.col("w")).otherwise(F.col("z"))
    return t.select("key", z.alias("z"), F.when(fresh, F.col("n2")).otherwise(F.col("n")).alias("n")), scored


def state_rows(spark: SparkSession) -> DataFrame:
    """A state without keys."""
    return spark.createDataFrame([], "key string, z double, n double")


def ftrl_step(state: DataFrame | None, features: DataFrame, chosen: DataFrame, alpha: float = 0.1, beta: float = 1.0, l1: float = 0.1, l2: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """Scores a micro-batch with the state before it, then updates the state (key, z, n) once.

    Gradients of all events are summed by key before the update, so the order of a batch's events doesn't
    matter. Keys are pairs of catalog items at most, however many events there are, so the weights are sent to the events' tasks: a batch's
    events, many more than the size of their compressed files tells, never pass the driver. Returns (state, scored events)."""
    w = _ftrl_weight(alpha, beta, l1, l2)
    keys = features.select("key").distinct()
    old = keys.join(state, "key", "left") if state is not None else keys.withColumns({"z": F.lit(None).cast("double"), "n": F.lit(None).cast("double")})
    old = old.select("key", F.coalesce("z", F.lit(0.0)).alias("z"), F.coalesce("n", F.lit(0.0)).alias("n")).withColumn("w", w)
    u = features.join(F.broadcast(old.select("key", "w")), "key").groupBy("event_id", "option").agg(F.sum(F.col("value") * F.col("w")).alias("u"))
    # shifted by the event's largest score, so that no score overflows
    u = u.join(shuffled(u.groupBy("event_id").agg(F.max("u").alias("top"))), "event_id").select("event_id", "option", F.exp(F.col("u") - F.col("top")).alias("e"))
    total = u.groupBy("event_id").agg(F.sum("e").alias("total"))
    p = u.join(shuffled(total), "event_id").join(shuffled(chosen), "event_id").select("event_id", "option", (F.col("e") / F.col("total")).alias("p"), F.when(F.col("option") == F.col("chosen"), 1.0).otherwise(0.0).alias("y"))
    g = features.join(shuffled(p), ["event_id", "option"]).groupBy("key").agg(F.sum((F.col("p") - F.col("y")) * F.col("value")).alias("g"))
    t = old.join(shuffled(g), "key").withColumn("n2", F.col("n") + F.col("g") * F.col("g"))
    t = t.select("key", (F.col("z") + F.col("g") - (F.sqrt("n2") - F.sqrt("n")) / alpha * F.col("w")).alias("z"), F.col("n2").alias("n"))
    rest = state.join(keys, "key", "left_anti") if state is not None else None
    return (t.unionByName(rest) if rest is not None else t), p
