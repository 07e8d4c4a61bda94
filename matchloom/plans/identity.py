"""Identity, deduplication and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchloom.operators import identity as D
from matchloom.operators.near import matchup_replacements, skill_replacements
from matchloom.plans.registry import query
from matchloom.session import materialize, shared_dir
from matchloom.sources.stored import KeyedStore


@query("d01_semantic_fingerprint", "SELECT match_id, fingerprint FROM fingerprints")
def _(v):
    return v.fingerprints


@query("d02_matchup_fingerprint", """WITH m AS (SELECT match_id, side, string_agg(t, ';' ORDER BY t) AS t FROM (SELECT match_id, side, hero || ':' || array_to_string(list_sort([s0, s1, s2]), ',') AS t FROM members) GROUP BY 1, 2)
SELECT match_id, sha256(string_agg(t, '|' ORDER BY t)) AS matchup FROM m GROUP BY 1""")
def _(v):
    return D.matchup_fingerprint(v.members)


@query("d03_two_per_fingerprint", "SELECT id, CAST(nth AS INT) AS nth FROM (SELECT id, row_number() OVER (PARTITION BY fingerprint ORDER BY id) AS nth FROM submissions WHERE fingerprint IS NOT NULL) WHERE nth <= 2")
def _(v):
    return D.cap_per_key(v.submissions.filter("fingerprint IS NOT NULL"), "fingerprint", "id").select("id", "nth")


@query("d04_first_appearance", "SELECT id, min(snapshot) AS first_snapshot, count(*) - 1 AS repeats FROM snapshots GROUP BY 1")
def _(v):
    return D.first_appearance(v.snapshots)


@query("d05_content_conflicts", "SELECT id, count(DISTINCT winner) AS contents FROM snapshots GROUP BY 1 HAVING count(DISTINCT winner) > 1")
def _(v):
    return v.snapshots.groupBy("id").agg(F.count_distinct(F.sha2(F.concat_ws("|", "season", "winner"), 256)).alias("contents")).filter("contents > 1")


@query("d06_snapshot_contract", "SELECT CAST(s AS INT) AS snapshot, (SELECT count(*) FROM snapshots a WHERE a.snapshot = s - 1 AND NOT EXISTS (SELECT 1 FROM snapshots b WHERE b.snapshot = s AND b.id = a.id)) AS missing FROM range(2, 8) r(s)")
def _(v):
    s = v.snapshots.select("snapshot", "id")
    gone = s.select((F.col("snapshot") + 1).alias("snapshot"), "id").filter("snapshot <= 7").join(s, ["snapshot", "id"], "left_anti").groupBy("snapshot").agg(F.count(F.lit(1)).alias("missing"))
    return v.spark.range(2, 8).select(F.col("id").cast("int").alias("snapshot")).join(gone, "snapshot", "left").na.fill(0)


@query("d07_merged_builds", """WITH b AS (SELECT roster, source, CASE WHEN won = 1 THEN 1 ELSE 2 END AS tier, match_id FROM rosters JOIN valid USING (match_id))
SELECT sha256(roster) AS build, string_agg(DISTINCT source, ',' ORDER BY source) AS sources, min(tier) AS best_tier, count(*) AS overlap, min(match_id) AS first_match FROM b GROUP BY roster""")
def _(v):
    b = v.rosters.join(v.valid.select("match_id", "source"), "match_id").withColumn("tier", F.expr("if(won = 1, 1, 2)"))
    return b.groupBy(F.sha2("roster", 256).alias("build")).agg(F.array_join(F.sort_array(F.collect_set("source")), ",").alias("sources"), F.min("tier").alias("best_tier"), F.count(F.lit(1)).alias("overlap"), F.min("match_id").alias("first_match"))


_STATES = """st AS (SELECT DISTINCT id AS match_id, side, roster, skills FROM (SELECT id, side, string_agg(hero, ',' ORDER BY hero) AS roster, list_sort(list(hero || ':' || s1) || list(hero || ':' || s2)) AS skills FROM reports GROUP BY 1, 2))"""


@query("d08_near_duplicate_teams", f"""WITH {_STATES} SELECT a.match_id * 2 + a.side AS a, b.match_id * 2 + b.side AS b, greatest(len(list_filter(list_distinct(a.skills), lambda x: NOT list_contains(b.skills, x))), len(list_filter(list_distinct(b.skills), lambda x: NOT list_contains(a.skills, x)))) AS replaced
FROM st a JOIN st b ON a.roster = b.roster AND a.match_id * 2 + a.side < b.match_id * 2 + b.side WHERE greatest(len(list_filter(list_distinct(a.skills), lambda x: NOT list_contains(b.skills, x))), len(list_filter(list_distinct(b.skills), lambda x: NOT list_contains(a.skills, x)))) <= 1""")
def _(v):
    """Teams of all reports, among them later ones with one and with two skills replaced."""
    return skill_replacements(v.reports.withColumnRenamed("id", "match_id"), most=1).selectExpr("a", "b", "CAST(replaced AS BIGINT) AS replaced")


@query("d08_near_duplicate_matches", "SELECT a, b, replaced FROM near_matches")
def _(v):
    return matchup_replacements(v.reports)


@query("d09_idempotent_insert", """WITH c AS (SELECT *, coalesce(CAST(season AS VARCHAR), '') || '|' || winner AS content FROM snapshots), h AS (SELECT id, arg_min(content, snapshot) AS holder FROM c GROUP BY 1)
SELECT id, min(snapshot) AS stored, any_value(holder) AS content, count(*) FILTER (content = holder) - 1 AS duplicates, count(*) FILTER (content <> holder) AS conflicts FROM c JOIN h USING (id) GROUP BY 1""")
def _(v):
    """Snapshots arrive in three batches; then all of it arrives again, and adds nothing."""
    rows = v.snapshots.select("id", "snapshot", F.concat_ws("|", F.coalesce(F.col("season").cast("string"), F.lit("")), F.col("winner").cast("string")).alias("content"))
    rows = materialize(rows, "snapshots")
    store = KeyedStore(v.spark, f"{shared_dir(v.spark)}/keyed-{uuid.uuid4().hex}", "id bigint, snapshot int, content string", "id", "content")
    for again in (False, True):
        for batch, part in enumerate(("snapshot <= 2", "snapshot > 2 AND snapshot <= 5", "snapshot > 5")):
            KeyedStore(v.spark, store.root, store.schema, "id", "content").insert(rows.filter(part if not again else "true"), "snapshot", batch)
    n = store.log().groupBy("id").agg(F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "conflict").alias("conflicts"))
    return store.read().join(n, "id").select("id", F.col("snapshot").alias("stored"), "content", "duplicates", "conflicts")


@query("d11_champion_groups", "SELECT CAST((place - 1) // 3 AS INT) AS grp, count(DISTINCT roster) AS builds, count(DISTINCT roster) = 3 AS complete FROM guide GROUP BY 1")
def _(v):
    return v.guide.groupBy(F.expr("cast((place - 1) div 3 as int) AS grp")).agg(F.count_distinct("roster").alias("builds"), (F.count_distinct("roster") == 3).alias("complete"))


@query("d12_set_algebra", "SELECT match_id, side, len(list_distinct(list(s1) || list(s2))) AS in_all, len(list_filter(list_distinct(list(s1)), lambda x: list_contains(list(s2), x))) AS in_both, len(list_filter(list_distinct(list(s1)), lambda x: NOT list_contains(list(s2), x))) AS only_first FROM members GROUP BY 1, 2")
def _(v):
    t = v.members.groupBy("match_id", "side").agg(F.collect_list("s1").alias("a"), F.collect_list("s2").alias("b"))
    n = lambda c: F.size(c).cast("long")
    return t.select("match_id", "side", n(F.array_union("a", "b")).alias("in_all"), n(F.array_intersect("a", "b")).alias("in_both"), n(F.array_except("a", "b")).alias("only_first"))


@query("d12_row_sets", "(SELECT hero FROM members WHERE side = 1 INTERSECT SELECT hero FROM members WHERE side = 2) EXCEPT SELECT hero FROM guide_members")
def _(v):
    side = lambda i: v.members.filter(f"side = {i}").select("hero")
    return side(1).intersect(side(2)).subtract(v.guide_members.select("hero"))
