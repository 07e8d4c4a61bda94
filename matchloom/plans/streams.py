"""Streaming and late data (Z01-Z11, M11, M12): streams run over what has landed and give the batch form's rows."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import features as E
from matchloom.operators import validate as V
from matchloom.plans.registry import query
from matchloom.session import materialize, shared_dir, shuffled
from matchloom.sources.stored import AgedTable, range_width
from matchloom.streaming import folds as Z

_COLS = ["event_id", "session", "round", "user_id", "ts", "received_at", "event_type", "chosen", "recommended"]


def _stream(v, rows=None, order="event_id"):
    return Z.read(v.spark, Z.landing(rows if rows is not None else v.events.select(*_COLS), order))


@query("z01_stream_quarantine", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, max(event_id) AS last_id FROM reasons GROUP BY 1")
def _(v):
    """Events that carry their offers and their pool are validated as they arrive and go to one of two sinks."""
    items = v.offers.groupBy("event_id").agg(F.collect_list("item").alias("items"), F.first("round_type").alias("round_type"))
    own = v.pool.groupBy("event_id").agg(F.collect_list(F.struct("pool_type", "pool_item")).alias("own"))
    rows = v.events.select("event_id").join(items, "event_id").join(own, "event_id", "left")
    s = V.arriving_reasons(_stream(v, rows))
    return Z.quarantine(s).groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id"))


@query("z02_stream_dedup", "SELECT event_type, count(*) AS n FROM choice GROUP BY 1")
def _(v):
    """Repeated events, and other events of the same session and round, are dropped inside the stream."""
    e = v.events.select(*_COLS)
    again = e.filter("event_id % 3 = 0").unionByName(e.filter("event_id % 5 = 0").withColumn("event_id", F.col("event_id") + 1_000_000_000).withColumn("ts", F.expr("timestampadd(SECOND, 1, ts)")))
    s = _stream(v, e.unionByName(again), "ts").withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "7 days")
    s = s.dropDuplicatesWithinWatermark(["event_id"]).dropDuplicatesWithinWatermark(["session", "round"])
    return Z.collect_stream(s.select("event_id", "event_type", "session", "round")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


@query("z03_stream_time_bounds", "SELECT ts BETWEEN received_at - INTERVAL 7 DAYS AND received_at + INTERVAL 5 MINUTES AS in_time, count(*) AS n FROM choice GROUP BY 1")
def _(v):
    s = _stream(v).select("event_id", F.expr("ts BETWEEN received_at - INTERVAL 7 DAYS AND received_at + INTERVAL 5 MINUTES").alias("in_time"))
    return Z.collect_stream(s).groupBy("in_time").agg(F.count(F.lit(1)).alias("n"))


def _fold(v):
    f = Z.Fold(v.spark, ["round"], {"events": F.lit(1), "accepted": F.expr("if(chosen = recommended, 1, 0)")})
    Z.drain(_stream(v), f.apply)
    return f


_ROUNDS = "SELECT round, count(*) AS events, count(*) FILTER (chosen = recommended) AS accepted FROM choice GROUP BY 1"


@query("s08_checkpoint_state", _ROUNDS)
def _(v):
    f = _fold(v)
    f.apply(v.events.select(*_COLS), f.versions.last())  # an old batch number adds nothing
    return f.state()


@query("z04_stream_fold", _ROUNDS)
def _(v):
    return _fold(v).state()


@query("z05_session_windows", """WITH l AS (SELECT source, uploader, captured_at AS ts, lag(captured_at) OVER (PARTITION BY source, uploader ORDER BY captured_at) AS prev FROM matches), s AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL 30 MINUTES THEN 1 ELSE 0 END) OVER (PARTITION BY source, uploader ORDER BY ts ROWS UNBOUNDED PRECEDING) AS visit FROM l)
SELECT source, uploader, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS matches FROM (SELECT source, uploader, visit, count(*) AS n FROM s GROUP BY 1, 2, 3 HAVING max(ts) + INTERVAL 30 MINUTES <= (SELECT max(captured_at) FROM matches) - INTERVAL 1 DAY) GROUP BY 1, 2""")
def _(v):
    """Sessions of 30 minutes by source and contributor; every seventeenth match arrives twelve hours late, within the watermark's day."""
    m = v.matches.select("match_id", "source", "uploader", F.col("captured_at").cast("timestamp").alias("at"))
    m = m.withColumn("arrives", F.expr("if(match_id % 17 = 0, at + INTERVAL 12 HOURS, at)"))
    s = _stream(v, m, order="arrives").withWatermark("at", "1 day")
    s = s.groupBy(F.session_window("at", "30 minutes"), "source", "uploader").agg(F.count(F.lit(1)).alias("n")).select("source", "uploader", "n")
    return Z.collect_stream(s).groupBy("source", "uploader").agg(F.count(F.lit(1)).alias("sessions"), F.sum("n").alias("matches"))


@query("z06_replay_check", "SELECT 0 AS differences, count(DISTINCT round) AS groups, count(*) AS events FROM choice")
def _(v):
    """State after a stream that was stopped half-way, gone on with by another object and run once more, beside a batch recount."""
    root = f"{shared_dir(v.spark)}/replay-{uuid.uuid4().hex}"
    values = {"events": F.lit(1), "accepted": F.expr("if(chosen = recommended, 1, 0)")}
    rows = v.events.select(*_COLS)
    for part in (rows.filter("event_id % 2 = 0"), rows.filter("event_id % 2 = 1"), None):
        if part is not None:
            Z.landing(part, "event_id", 3, f"{root}/landing")
        Z.drain(Z.read(v.spark, f"{root}/landing"), Z.Fold(v.spark, ["round"], values, f"{root}/fold").apply, checkpoint=f"{root}/progress")
    state = Z.Fold(v.spark, ["round"], values, f"{root}/fold").state()
    batch = v.events.groupBy("round").agg(F.count(F.lit(1)).alias("events"), F.count_if(F.expr("chosen = recommended")).alias("accepted"))
    apart = state.exceptAll(batch).unionByName(batch.exceptAll(state)).agg(F.count(F.lit(1)).cast("int").alias("differences"))
    return apart.crossJoin(state.agg(F.count(F.lit(1)).alias("groups"), F.sum("events").alias("events")))  # one row each


@query("z07_retention", """WITH g AS (SELECT id, row_number() OVER (ORDER BY id) AS rn FROM submissions WHERE id <= (SELECT max(id) // 2 FROM submissions) AND received_at < (SELECT max(received_at) FROM submissions) - INTERVAL 14 DAYS), r(run) AS (VALUES (1), (2))
SELECT run, (SELECT count(*) FROM g WHERE (rn - 1) // 400 = run - 1) AS removed, (SELECT count(*) FROM submissions WHERE id NOT IN (SELECT id FROM g WHERE rn <= 400 * run)) AS kept, (SELECT min(id) FROM submissions WHERE id NOT IN (SELECT id FROM g WHERE rn <= 400 * run)) AS first_kept FROM r""")
def _(v):
    """Two runs of at most 400 rows over a stored table; rows up to the cursor (half-way) that are older than 14 days go."""
    s = materialize(v.submissions.select("id", "received_at", "fingerprint"), "submissions")
    last = s.agg(F.max("id").alias("id"), (F.max("received_at") - F.expr("INTERVAL 14 DAYS")).cast("string").alias("before")).first()
    t = AgedTable(v.spark, f"{shared_dir(v.spark)}/aged-{uuid.uuid4().hex}", s.schema.simpleString()[7:-1].replace(":", " "), "id", "received_at", width=range_width(last["id"]))
    t.load(s)
    t.used_up_to(last["id"] // 2)
    out = []
    for run in (1, 2):
        removed = t.purge(last["id"] // 2, last["before"], 400)
        now = t.read().agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("id")).first()
        out.append((run, removed, now["n"], now["id"]))
    return v.spark.createDataFrame(out, "run int, removed long, kept long, first_kept long")


@query("z08_published_increment", "SELECT round, count(*) FILTER (event_id % 2 = 1 OR round = 3) AS increment FROM choice GROUP BY 1")
def _(v):
    n = F.count(F.lit(1))
    old = v.events.filter("event_id % 2 = 0").groupBy("round").agg(n.alias("before"))
    new = v.events.groupBy("round").agg(n.alias("after"), (F.first("round") == 3).alias("reset"))
    return new.join(old, "round", "left").select("round", F.when(F.col("reset"), F.col("after")).otherwise(F.col("after") - F.coalesce("before", F.lit(0))).alias("increment"))


@query("z09_pending_cap", """WITH RECURSIVE f AS (SELECT k, (SELECT count(*) FROM submissions WHERE (id * 6) // ((SELECT max(id) FROM submissions) + 1) <= k) AS arrived FROM range(6) r(k)),
s AS (SELECT CAST(0 AS BIGINT) AS k, arrived, CAST(0 AS BIGINT) AS done, least(500, arrived) AS pending, arrived - least(500, arrived) AS waiting FROM f WHERE k = 0
UNION ALL SELECT f.k, f.arrived, s.done + least(20, s.pending), s.pending - least(20, s.pending) + least(500 - s.pending + least(20, s.pending), f.arrived - s.done - s.pending), f.arrived - s.done - s.pending - least(500 - s.pending + least(20, s.pending), f.arrived - s.done - s.pending) FROM s JOIN f ON f.k = s.k + 1)
SELECT CAST(k AS INT) AS batch, arrived, CAST(done AS BIGINT) AS done, CAST(pending AS BIGINT) AS pending, CAST(waiting AS BIGINT) AS waiting FROM s""")
def _(v):
    """Six arrivals, each by an object of its own that goes on where the last one stopped; the first one comes twice."""
    root = f"{shared_dir(v.spark)}/queue-{uuid.uuid4().hex}"
    s = v.submissions.select("id")
    s = materialize(s.crossJoin(F.broadcast(s.agg((F.max("id") + 1).alias("m")))).selectExpr("id", "id * 6 div m AS k"), "arrivals")
    for k in range(6):
        a = Z.Admission(v.spark, f"{root}/state")
        for _ in range(2 if k == 0 else 1):
            a.apply(s.filter(F.col("k") == k), k)
    return Z.Admission(v.spark, f"{root}/state").log()


@query("z10_client_queue", "SELECT user_id, count(*) AS queued, min(event_id) AS oldest FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn, ts, max(ts) OVER (PARTITION BY user_id) AS last FROM events) WHERE rn <= 50 AND ts >= last - INTERVAL 7 DAYS GROUP BY 1")
def _(v):
    """Events arrive in order of time, some twice; the stream stops half-way and goes on from its state."""
    root = f"{shared_dir(v.spark)}/queues-{uuid.uuid4().hex}"
    e = v.table("events").select("user_id", "event_id", F.col("ts").cast("timestamp").alias("at"))
    e = materialize(e.unionByName(e.filter("event_id % 5 = 0")), "queue")
    middle = e.agg(F.percentile_approx(F.unix_micros("at"), 0.5)).first()[0]
    parts = []
    for k, part in enumerate((F.unix_micros("at") <= middle, F.unix_micros("at") > middle)):
        Z.landing(e.filter(part), "at", 2, f"{root}/landing")
        out = f"{root}/out{k}"
        Z.drain(Z.client_queues(Z.read(v.spark, f"{root}/landing")), lambda df, n, out=out: df.write.mode("overwrite").parquet(f"{out}/batch={n}"), "update", f"{root}/progress")
        parts.append(v.spark.read.parquet(out))
    t = parts[0].unionByName(parts[1]).filter("queued > 0")
    return t.groupBy("user_id").agg(F.max_by(F.struct("queued", "oldest"), F.struct("last", "batch")).alias("q")).select("user_id", "q.queued", "q.oldest")


@query("z11_old_rows", "SELECT count(*) AS n, count(*) FILTER (received_at < (SELECT max(received_at) FROM choice) - INTERVAL 14 DAYS) AS old FROM choice")
def _(v):
    last = v.events.agg(F.max("received_at").alias("last"))
    return v.events.crossJoin(F.broadcast(last)).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.expr("received_at < last - INTERVAL 14 DAYS")).alias("old"))


def _online(v):
    """The model after all accepted events have streamed by in four arrivals, each a micro-batch, so that no event is split."""
    root = f"{shared_dir(v.spark)}/arrivals-{uuid.uuid4().hex}"
    accepted = materialize(v.accepted, "accepted")
    x = materialize(E.option_lists(accepted, v.offers, v.pool).join(shuffled(accepted.select("event_id", "chosen")), "event_id"), "online")
    cuts = [float("-inf"), *x.approxQuantile("event_id", [0.25, 0.5, 0.75], 0.001), float("inf")]
    for low, high in zip(cuts, cuts[1:], strict=False):
        Z.landing(x.filter((F.col("event_id") > low) & (F.col("event_id") <= high)), "event_id", 1, f"{root}/landing", Z.FILE_EVENTS)
        Z.drain(Z.read(v.spark, f"{root}/landing", 1 << 30), Z.Online(v.spark, f"{root}/model").apply_lists, checkpoint=f"{root}/progress")
    return Z.Online(v.spark, f"{root}/model")


@query("m11_online_choice_model")
def _(v):
    return _online(v).versions.read().select("key", F.round("z", 4).alias("z"), F.round("n", 4).alias("n"))


@query("m12_prequential_scores")
def _(v):
    return _online(v).scores().filter("y = 1").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(-F.log("p")), 4).alias("log_loss"))
