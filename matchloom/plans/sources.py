"""Sources, sinks and incremental reads."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.operators import identity as D
from matchloom.operators import ingest as S
from matchloom.plans.registry import query
from matchloom.session import materialize, shared_dir
from matchloom.sources.sinks import publish


@query("s01_json_round_trip", "SELECT match_id, winner, season, string_agg(hero, ',' ORDER BY side, slot) AS heroes, CAST(NULL AS VARCHAR) AS reason FROM members GROUP BY ALL")
def _(v):
    side = lambda i: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == i, F.struct("slot", F.struct(F.col("hero").alias("name"), F.array("s0", "s1", "s2").alias("skills")).alias("m"))))), lambda x: x["m"])
    docs = v.members.groupBy("match_id", "season", "winner").agg(side(1).alias("1"), side(2).alias("2"))
    path = f"{shared_dir(v.spark)}/json-{uuid.uuid4().hex}"
    docs.select("1", "2", F.col("winner").cast("string").alias("winner"), "season", F.array(F.col("match_id").cast("string")).alias("fuzzy_match_failures")).write.json(path)
    t = v.spark.read.schema(S.MATCH_JSON).json(path)
    names = F.array_join(F.concat(F.transform("1", lambda x: x["name"]), F.transform("2", lambda x: x["name"])), ",")
    reason = F.when((F.size("1") != 3) | (F.size("2") != 3), "team_size")
    return t.select(F.get("fuzzy_match_failures", F.lit(0)).cast("long").alias("match_id"), F.col("winner").cast("int").alias("winner"), "season", names.alias("heroes"), reason.alias("reason"))


_S02 = "SELECT match_id, '2-' || season || '-' || lpad(CAST(match_id AS VARCHAR), 8, '0') AS order_key, source FROM valid WHERE source = 'external' AND season IS NOT NULL"


@query("s02_external_order_keys", _S02)
def _(v):
    t = v.valid.filter("source = 'external' AND season IS NOT NULL")
    return t.select("match_id", F.format_string("2-%d-%s", "season", F.lpad(F.col("match_id").cast("string"), 8, "0")).alias("order_key"), "source")


@query("s03_union_of_sources", "SELECT match_id, source, CASE source WHEN 'own' THEN 0 WHEN 'others' THEN 1 ELSE 2 END || '-' || lpad(CAST(match_id AS VARCHAR), 8, '0') AS order_key FROM valid")
def _(v):
    parts = [v.valid.filter(F.col("source") == s).select("match_id", "source", F.concat(F.lit(f"{i}-"), F.lpad(F.col("match_id").cast("string"), 8, "0")).alias("order_key")) for i, s in enumerate(("own", "others", "external"))]
    return parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)


@query("s04_asset_check", """WITH a AS (SELECT c_custkey // 200 AS k, string_agg(c_name || ' ' || c_mktsegment, ';' ORDER BY c_custkey) || chr(10) AS text FROM customer GROUP BY 1)
SELECT 'asset=' || k AS name, CASE WHEN k % 7 = 3 THEN 'changed' WHEN k % 7 = 5 THEN 'missing' ELSE 'ok' END AS status, CASE WHEN k % 7 <> 5 THEN strlen(text) END AS size FROM a
UNION ALL SELECT 'asset=' || (1000000 + k), 'extra', strlen(text) FROM a WHERE k % 7 = 6""")
def _(v):
    """Files of 200 customers each; of every seven, one has a byte that its manifest doesn't know, one is missing, and one has a copy under a name that isn't listed."""
    path = f"{shared_dir(v.spark)}/assets-{uuid.uuid4().hex}"
    row = F.struct("c_custkey", F.concat_ws(" ", "c_name", "c_mktsegment").alias("text"))
    lines = F.array_join(F.transform(F.sort_array(F.collect_list(row)), lambda x: x["text"]), ";")
    t = materialize(v.table("customer").groupBy(F.expr("c_custkey div 200").alias("k")).agg(lines.alias("value")), "assets")
    byte = F.concat(F.expr("if(k % 7 = 3, 'x', substring(value, 1, 1))"), F.expr("substring(value, 2)"))
    files = t.filter("k % 7 <> 5").select(F.col("k").alias("asset"), byte.alias("value")).unionByName(t.filter("k % 7 = 6").select((F.col("k") + 1_000_000).alias("asset"), "value"))
    files.repartition("asset").write.partitionBy("asset").text(path)
    text = F.concat("value", F.lit("\n"))
    manifest = t.select(F.concat(F.lit("asset="), F.col("k")).alias("name"), F.octet_length(text).alias("size"), F.sha2(text, 256).alias("sha256"))
    return S.asset_check(v.spark, path, manifest).withColumn("size", F.col("size").cast("long"))


@query("s05_rows_after_cursor", "SELECT id, match_id FROM submissions WHERE id > 100 ORDER BY id LIMIT 500")
def _(v):
    return S.incremental(v.submissions.select("id", "match_id"), "id", 100, 500)


@query("s06_export_bounds", "SELECT count(*) AS n, min(id) AS low, max(id) AS high FROM submissions")
def _(v):
    return S.bounds(v.submissions, "id")


@query("s07_schema_contract", """SELECT unnest(['column event_id', 'column ts', 'column user_id', 'column props', 'column session']) AS item, unnest([true, true, false, true, false]) AS ok UNION ALL
SELECT 'unique event_id', count(*) = count(DISTINCT event_id) FROM events UNION ALL SELECT 'unique user_id', count(*) = count(DISTINCT user_id) FROM events""")
def _(v):
    """A contract that the table breaks: a type, a column and a key of it are wrong."""
    return S.schema_contract(v.table("events"), {"event_id": "bigint", "ts": "timestamp_ntz", "user_id": "string", "props": "string", "session": "string"}, ("event_id", "user_id"))


@query("s09_published_artifact", "SELECT family, count(*) AS n, round(sum(weight), 4) AS total FROM weights GROUP BY 1")
def _(v):
    path = publish(v.weights, f"{shared_dir(v.spark)}/artifact", check=lambda df: df.filter("weight IS NULL").count() == 0)
    return v.spark.read.parquet(path).groupBy("family").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 4).alias("total"))


@query("s10_capture_times", """SELECT match_id, captured_at AS captured FROM matches WHERE match_id % 3 < 2 UNION ALL SELECT match_id, date_trunc('second', captured_at) FROM matches WHERE match_id % 3 = 2""")
def _(v):
    c = F.col("captured_at")
    name = F.when(F.col("match_id") % 3 == 0, F.concat(F.date_format(c, "yyyy-MM-dd-HHmmss"), F.lit(".json"))).when(F.col("match_id") % 3 == 1, F.concat(F.lit("img_"), F.unix_millis(c.cast("timestamp")), F.lit(".png"))).otherwise(F.concat(F.lit("Screen "), F.date_format(c, "yyyy-MM-dd"), F.lit(" at "), F.date_format(c, "h.mm.ss"), F.expr("if(match_id % 2 = 0, ' ', '\u202f')"), F.expr("if(match_id % 5 < 2, lower(date_format(captured_at, 'a')), date_format(captured_at, 'a'))"), F.lit(".png")))
    return v.matches.select("match_id", S.capture_time(name).alias("captured"))


@query("s11_catalog_rows", "SELECT hero, signature, season FROM heroes")
def _(v):
    obj = v.heroes.groupBy((F.col("num") % 4).alias("g")).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("hero", F.struct(F.col("signature").alias("skill"), "season"))))).alias("doc"))
    t = obj.select(F.explode(F.from_json("doc", "map<string,struct<skill:string,season:int>>")).alias("hero", "x"))
    return t.join(v.skills.filter("is_signature"), F.col("x.skill") == F.col("skill"), "left_semi").select("hero", F.col("x.skill").alias("signature"), "x.season")


@query("s12_fill_down", "SELECT log, pos, section FROM (SELECT log, pos, marker, last_value(marker IGNORE NULLS) OVER (PARTITION BY log ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT *, CASE WHEN pos % 5 = 1 THEN text END AS marker FROM log_lines)) WHERE marker IS NULL")
def _(v):
    return S.fill_down(v.log_lines, "pos", "log", F.when(F.col("pos") % 5 == 1, F.col("text"))).select("log", "pos", "section")


@query("s13_numbered_points", "SELECT log, point, string_agg(text, ' ' ORDER BY pos) AS text, count(*) AS n_lines FROM (SELECT *, CAST(sum(CASE WHEN length(text) % 3 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY log ORDER BY pos ROWS UNBOUNDED PRECEDING) AS BIGINT) AS point FROM log_lines) WHERE point > 0 GROUP BY 1, 2")
def _(v):
    return S.join_points(v.log_lines, "log", "pos", F.length("text") % 3 == 0, "text")


@query("d10_content_version")
def _(v):
    return D.content_version(v.valid.join(v.fingerprints, "match_id"), F.concat_ws("|", F.col("match_id").cast("string"), "fingerprint"))
