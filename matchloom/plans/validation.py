"""Projection, predicates, validation and quarantine."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from matchloom.operators import validate as V
from matchloom.plans.registry import query

_V01 = """kn AS (SELECT m.*, h.hero IS NULL OR a.skill IS NULL OR b.skill IS NULL AS unknown FROM raw_members m LEFT JOIN heroes h USING (hero) LEFT JOIN skills a ON a.skill = m.s1 LEFT JOIN skills b ON b.skill = m.s2),
pm AS (SELECT match_id, count(*) FILTER (unknown) AS unknown, count(*) FILTER (s1 IS NULL OR s2 IS NULL) AS empty, count(*) - count(DISTINCT side || ':' || hero) AS dups FROM kn GROUP BY 1),
v01 AS (SELECT match_id, CASE WHEN winner IS NULL OR winner NOT IN (1, 2) THEN 'winner' WHEN n1 <> 3 OR n2 <> 3 THEN 'team_size' WHEN coalesce(empty, 0) > 0 THEN 'skills' WHEN coalesce(dups, 0) > 0 THEN 'duplicate_hero' WHEN coalesce(unknown, 0) > 0 THEN 'unknown_name' WHEN season <= 0 THEN 'season' END AS reason FROM raw_matches LEFT JOIN pm USING (match_id))"""


@query("v01_match_validation", f"WITH {_V01} SELECT match_id, reason FROM v01")
def _(v):
    return V.match_reasons(v.raw_matches, v.raw_members, v.heroes, v.skills).select("match_id", "reason")


@query("v02_availability", "SELECT m.match_id, m.season, m.side, m.hero, h.season AS intro FROM members m JOIN heroes h USING (hero) WHERE m.season < h.season")
def _(v):
    return v.members.join(v.heroes.select("hero", F.col("season").alias("intro")), "hero").filter("season < intro").select("match_id", "season", "side", "hero", "intro")


@query("v03_shadow_provenance", "SELECT match_id, side, slot, CASE WHEN s1 = s2 AND CAST(substr(s1, 2) AS INT) % 10 = 9 THEN 'repeated_shadow' WHEN source = 'external' AND (CAST(substr(s1, 2) AS INT) % 10 = 9 OR CAST(substr(s2, 2) AS INT) % 10 = 9) THEN 'untrusted_source' END AS reason FROM members")
def _(v):
    t = v.members.withColumn("shadow", F.filter(F.array("s1", "s2"), lambda s: F.substring(s, 2, 9).cast("int") % 10 == 9))
    reason = V.first_reason((F.size(F.array_distinct("shadow")) == F.size("shadow"), "repeated_shadow"), (F.size(F.array_except("shadow", F.array("s1", "s2"))) == 0, "not_equipped"), ((F.size("shadow") == 0) | (F.col("source") != "external"), "untrusted_source"))
    return t.select("match_id", "side", "slot", reason.alias("reason"))


@query("v04_submission_payload", "SELECT match_id, side, CASE WHEN count(*) <> 3 THEN 'team_size' WHEN count(*) * 2 <> len(list_distinct(list(s1) || list(s2))) THEN 'duplicate_skill' WHEN max(coalesce(season, 1)) NOT BETWEEN 1 AND 16 THEN 'season' END AS reason FROM members GROUP BY 1, 2")
def _(v):
    t = v.members.groupBy("match_id", "side", "season").agg(F.collect_list(F.struct("slot", "s0", "s1", "s2")).alias("team"))
    payload = F.to_json(F.struct(F.col("team"), F.coalesce("season", F.lit(1)).alias("season")))
    t = t.withColumn("raw", payload).withColumn("x", F.from_json("raw", "team array<struct<slot:int,s0:string,s1:string,s2:string>>, season int"))
    skills = F.flatten(F.transform("x.team", lambda m: F.array(m["s1"], m["s2"])))
    keys = F.array_sort(F.json_object_keys("raw")) == F.array(F.lit("season"), F.lit("team"))
    reason = V.first_reason((keys, "keys"), (F.size("x.team") == 3, "team_size"), (F.forall("x.team", lambda m: m["s0"].startswith("SIG-")), "signature"), (F.size(F.array_distinct(skills)) == F.size(skills), "duplicate_skill"), (F.col("x.season").between(1, 16), "season"))
    return t.select("match_id", "side", reason.alias("reason"))


#: Bytes of a record at most (fixed value).
RECORD_BYTES = 16 * 1024


@query("v05_submission_rows", """SELECT id, CASE WHEN NOT regexp_full_match(uuid, '[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}') THEN 'uuid' WHEN season IS NULL THEN 'catalog' WHEN strlen(CASE WHEN id % 37 = 0 THEN repeat(fingerprint, 300) ELSE fingerprint END) > 16384 THEN 'size' WHEN stored_hash IS NULL OR length(stored_hash) <> 64 THEN 'hash_format' WHEN stored_hash <> fingerprint THEN 'hash' END AS reason FROM submissions""")
def _(v):
    """Records of at most 16 KiB; the stored hash is held against the one recomputed from the match's members."""
    from matchloom.operators.identity import semantic_fingerprint

    again = semantic_fingerprint(v.members).select("match_id", F.col("fingerprint").alias("recomputed"))
    record = F.expr("if(id % 37 = 0, repeat(fingerprint, 300), fingerprint)")
    t = v.submissions.withColumn("record", record).drop("fingerprint").join(again, "match_id", "left")
    return t.select("id", V.first_reason(
        (F.col("uuid").rlike("^[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}$"), "uuid"), (F.col("season").isNotNull(), "catalog"), (F.coalesce(F.octet_length("record"), F.lit(0)) <= RECORD_BYTES, "size"),
        (F.col("stored_hash").rlike("^[0-9a-f]{64}$"), "hash_format"), (F.col("stored_hash") == F.col("recomputed"), "hash"),
    ).alias("reason"))


@query("v06_event_validation", "SELECT event_id, session, round, reason FROM reasons")
def _(v):
    return V.event_reasons(v.events, v.offers, v.pool).select("event_id", "session", "round", "reason")


@query("v07_quarantine", "SELECT coalesce(reason, 'accepted') AS reason, count(*) AS n, max(event_id) AS last_id, (SELECT max(event_id) FROM choice) AS cursor FROM reasons GROUP BY 1")
def _(v):
    t = V.event_reasons(v.events, v.offers, v.pool)
    cursor = v.events.agg(F.max("event_id").alias("cursor"))  # one row: the cursor passes rejected rows too
    return t.groupBy(F.coalesce("reason", F.lit("accepted")).alias("reason")).agg(F.count(F.lit(1)).alias("n"), F.max("event_id").alias("last_id")).crossJoin(F.broadcast(cursor))


_ARRIVED = "ar AS (SELECT 'E' || event_id AS id, session, round FROM choice UNION ALL SELECT 'e' || event_id, session || '-again', round FROM choice WHERE event_id % 50 = 0 UNION ALL SELECT 'N' || event_id, session, round FROM choice WHERE event_id % 77 = 0)"


@query("v08_logical_uniqueness", f"WITH {_ARRIVED} SELECT 'event_id' AS rule, lower(id) AS key, count(*) AS n FROM ar GROUP BY 1, 2 HAVING count(*) > 1 UNION ALL SELECT 'session_round', session || '|' || round, count(*) FROM ar GROUP BY 1, 2 HAVING count(*) > 1")
def _(v):
    """Arrivals that repeat an event, in another case or as another event of the same session and round."""
    e = v.events.select(F.concat(F.lit("E"), "event_id").alias("id"), "session", "round", "event_id")
    t = e.unionByName(e.filter("event_id % 50 = 0").withColumn("id", F.lower("id")).withColumn("session", F.concat("session", F.lit("-again")))).unionByName(e.filter("event_id % 77 = 0").withColumn("id", F.concat(F.lit("N"), "event_id")))
    return V.repeated_keys(t, event_id=F.lower("id"), session_round=F.concat_ws("|", "session", F.col("round").cast("string")))


#: Names as they come: some with characters that aren't seen, or separate lines; a joiner is fine.
_NAMES = "CASE id % 9 WHEN 1 THEN uploader_name || {0}(8203) WHEN 2 THEN uploader_name || {0}(8232) WHEN 3 THEN {0}(8233) || uploader_name WHEN 4 THEN uploader_name || {0}(8205) WHEN 5 THEN repeat(uploader_name, 20) WHEN 6 THEN uploader_name || {0}(7) WHEN 7 THEN {0}(8205) ELSE uploader_name END"


@query("v09_display_names", f"""WITH n AS (SELECT id, {_NAMES.format('chr')} AS name FROM submissions) SELECT id, length(name) <= 80 AND NOT regexp_matches(replace(name, chr(8205), ''), '[\\p{{Cc}}\\p{{Cf}}\\p{{Zl}}\\p{{Zp}}]') AS fits, trim(replace(name, chr(8205), '')) <> '' AS named FROM n""")
def _(v):
    """Control, format, surrogate and line or paragraph separating characters are refused, but for the joiner."""
    letter = lambda k: f"decode(encode('{chr(k)}', 'utf-8'), 'utf-8')"
    sql = _NAMES
    for k in (8203, 8232, 8233, 8205, 7):
        sql = sql.replace(f"{{0}}({k})", letter(k))
    name = F.expr(sql)
    hidden = name.rlike(r"[\p{Cc}\p{Cf}\p{Cs}\p{Zl}\p{Zp}&&[^\u200d]]")
    return v.submissions.select("id", ((F.char_length(name) <= 80) & ~hidden).alias("fits"), (F.trim(F.translate(name, "\u200d", "")) != "").alias("named"))


@query("v10_utc_text", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || CASE WHEN microsecond(ts) % 1000000 = 0 THEN '' ELSE '.' || rtrim(lpad(CAST(microsecond(ts) % 1000000 AS VARCHAR), 6, '0'), '0') END || 'Z' AS utc FROM events")
def _(v):
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return v.table("events").select("event_id", F.concat(F.regexp_replace(F.regexp_replace(text, "0+$", ""), r"\.$", ""), F.lit("Z")).alias("utc"))


@query("v11_aliases", "SELECT match_id, side, slot, CASE WHEN hero IN ('Brand#11', 'Brand#12') THEN 'Brand#1' ELSE hero END AS hero, substr(s0, 5) AS bare, h.hero IS NULL AS unknown FROM members LEFT JOIN heroes h USING (hero)")
def _(v):
    alias = v.spark.createDataFrame([("Brand#11", "Brand#1"), ("Brand#12", "Brand#1")], "hero string, name string")
    t = v.members.join(F.broadcast(alias), "hero", "left").join(F.broadcast(v.heroes.select("hero", F.lit(True).alias("known"))), "hero", "left")
    bare = F.when(F.col("s0").startswith("SIG-"), F.expr("substring(s0, 5)")).otherwise(F.col("s0"))
    return t.select("match_id", "side", "slot", F.coalesce("name", "hero").alias("hero"), bare.alias("bare"), F.col("known").isNull().alias("unknown"))


@query("v12_slot_alternatives", "SELECT match_id, side, slot, unnest(list_distinct([s1, s2, s1])) AS alternative FROM members")
def _(v):
    text = F.concat(F.col("s1"), F.lit(" / "), F.col("s2"), F.lit("／"), F.col("s1"))
    return v.members.select("match_id", "side", "slot", F.explode(F.array_distinct(F.transform(F.split(text, r"\s*[/／]\s*"), lambda x: F.trim(x)))).alias("alternative"))


@query("v13_exclusion_reasons", """WITH tc AS (SELECT match_id, count(*) FILTER (s1 IS NULL OR s2 IS NULL) + count(*) - count(DISTINCT side || ':' || hero) AS bad FROM raw_members GROUP BY 1)
SELECT CASE WHEN winner IS NULL OR winner NOT IN (1, 2) THEN 'unknown_result' WHEN n1 <> 3 OR n2 <> 3 THEN 'incomplete_team' WHEN bad > 0 THEN 'incomplete_tactics' ELSE 'kept' END AS reason, count(*) AS n FROM raw_matches LEFT JOIN tc USING (match_id) GROUP BY 1""")
def _(v):
    bad = F.count_if(F.col("s1").isNull() | F.col("s2").isNull()) + F.count(F.lit(1)) - F.count_distinct("side", "hero")
    t = v.raw_matches.join(v.raw_members.groupBy("match_id").agg(bad.alias("bad")), "match_id", "left")
    reason = V.first_reason((F.col("winner").isin(1, 2), "unknown_result"), ((F.col("n1") == 3) & (F.col("n2") == 3), "incomplete_team"), (F.col("bad") == 0, "incomplete_tactics"))
    return t.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query("v14_draftable_skills", "SELECT skill, color = 'orange' AS in_rounds FROM skills WHERE skill NOT IN (SELECT signature FROM heroes) AND NOT shadow")
def _(v):
    t = v.skills.join(v.heroes, F.col("skill") == F.col("signature"), "left_anti").filter("NOT shadow")
    return t.select("skill", (F.col("color") == "orange").alias("in_rounds"))


@query("v15_full_coverage", "SELECT coalesce(h.hero, g.hero) AS hero, h.hero IS NULL AS extra, g.hero IS NULL AS missing FROM heroes h FULL JOIN (SELECT DISTINCT hero FROM guide_members) g ON h.hero = g.hero")
def _(v):
    g = v.guide_members.select(F.col("hero").alias("g")).distinct()
    return v.heroes.select("hero").join(g, F.col("hero") == F.col("g"), "full").select(F.coalesce("hero", "g").alias("hero"), F.col("hero").isNull().alias("extra"), F.col("g").isNull().alias("missing"))


@query("v16_conservation", """SELECT 'round_events' AS invariant, CAST(count(*) AS BIGINT) AS lhs, CAST(count(*) AS BIGINT) AS rhs, true AS ok FROM choice UNION ALL SELECT 'picks_per_event', count(*), (SELECT CAST(sum(n_items) AS BIGINT) FROM choice), count(*) = (SELECT sum(n_items) FROM choice) FROM picks UNION ALL SELECT 'side_wins', count(*), count(*), true FROM valid""")
def _(v):
    rounds = v.events.groupBy("round").agg(F.count(F.lit(1)).alias("n")).agg(F.sum("n").alias("lhs")).crossJoin(v.events.agg(F.count(F.lit(1)).alias("rhs")))
    picks = v.picks.agg(F.count(F.lit(1)).alias("lhs")).crossJoin(v.events.agg(F.sum("n_items").alias("rhs")))
    wins = v.valid.agg(F.count_if(F.expr("winner = 1 OR winner = 2")).alias("lhs"), F.count(F.lit(1)).alias("rhs"))
    named = [t.select(F.lit(n).alias("invariant"), "lhs", "rhs", (F.col("lhs") == F.col("rhs")).alias("ok")) for n, t in (("round_events", rounds), ("picks_per_event", picks), ("side_wins", wins))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@query("v17_client_time", "SELECT event_id, ts BETWEEN received_at - INTERVAL 7 DAYS AND received_at + INTERVAL 5 MINUTES AS in_time FROM choice")
def _(v):
    return v.events.select("event_id", F.expr("ts BETWEEN received_at - INTERVAL 7 DAYS AND received_at + INTERVAL 5 MINUTES").alias("in_time"))


@query("v18_plan_warnings", """WITH eq AS (SELECT DISTINCT match_id, side, slot, hero, s0, unnest([s1, s2]) AS skill FROM raw_members)
SELECT 'repeated_skill' AS warning, match_id, side, skill, count(DISTINCT slot) AS members FROM eq WHERE skill IS NOT NULL GROUP BY 2, 3, 4 HAVING count(DISTINCT slot) > 1 UNION ALL SELECT 'own_signature', match_id, side, skill, 1 FROM eq WHERE skill = s0""")
def _(v):
    """A skill that several of a plan's members carry, and a hero that carries its own signature."""
    return V.plan_warnings(v.raw_members)


_TABLE = "gt AS (SELECT *, CASE WHEN place % 17 = 0 THEN NULL ELSE 'meta' END AS category, CASE WHEN champion THEN 'champions' ELSE 'ladder' END AS section, CASE WHEN champion AND place % 3 <> 0 THEN 'champions' ELSE 'ladder' END AS source, substr(sha256(roster), 1, 12) AS id, CASE WHEN place % 13 = 0 THEN 1 ELSE 2 END AS n_slots FROM guide)"


@query("v19_guide_rules", f"""WITH {_TABLE} SELECT place, 'members' AS rule, len(list_distinct(string_split(roster, ','))) = 3 AS ok FROM gt UNION ALL SELECT place, 'tier', tier IN ('S', 'A', 'B') FROM gt UNION ALL SELECT place, 'tier_and_category', (tier IS NULL) = (category IS NULL) FROM gt UNION ALL SELECT place, 'section_and_source', section = source FROM gt
UNION ALL SELECT place, 'content_id', id = substr(sha256(roster), 1, 12) FROM gt UNION ALL SELECT place, 'unique_id', (SELECT count(*) FROM gt g WHERE g.id = o.id) = 1 FROM gt o UNION ALL SELECT place, 'slots', n_slots = 2 FROM gt""")
def _(v):
    g = v.guide.selectExpr("*", "if(place % 17 = 0, null, 'meta') AS category", "if(champion, 'champions', 'ladder') AS section", "if(champion AND place % 3 <> 0, 'champions', 'ladder') AS source", "substring(sha2(roster, 256), 1, 12) AS id", "if(place % 13 = 0, 1, 2) AS n_slots")
    g = g.withColumn("same", F.count(F.lit(1)).over(Window.partitionBy("id")))
    rules = {
        "members": F.size(F.array_distinct(F.split("roster", ","))) == 3, "tier": F.col("tier").isin("S", "A", "B"), "tier_and_category": F.col("tier").isNull() == F.col("category").isNull(), "section_and_source": F.col("section") == F.col("source"),
        "content_id": F.col("id") == F.substring(F.sha2("roster", 256), 1, 12), "unique_id": F.col("same") == 1, "slots": F.col("n_slots") == 2,
    }
    return V.rule_rows(g, "place", rules)
