"""Text and log cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchloom.operators import text as X
from matchloom.plans.registry import query

_TOK = "tk AS (SELECT log, pos, unnest(string_split(text, ' ')) AS token FROM log_lines)"


def _tokens(v):
    return v.log_lines.select("log", "pos", F.explode(F.split("text", " ")).alias("token"))


@query("t01_known_errors", f"WITH {_TOK} SELECT CASE token WHEN 'teh' THEN 'the' WHEN 'th' THEN 'the' WHEN 'nd' THEN 'and' ELSE token END AS fixed, count(*) AS n FROM tk GROUP BY 1")
def _(v):
    known = v.spark.createDataFrame([("teh", "the"), ("th", "the"), ("nd", "and")], "wrong string, right string")
    return X.correct(_tokens(v), known).groupBy("fixed").agg(F.count(F.lit(1)).alias("n"))


_NAMES = "nm AS (SELECT DISTINCT name FROM (SELECT unnest(string_split(text, ' ')) AS name FROM benchmark) WHERE length(name) >= 5 AND regexp_matches(name, '^[ -~]+$')), tq AS (SELECT DISTINCT token FROM tk WHERE length(token) >= 5 AND regexp_matches(token, '^[ -~]+$'))"


@query("t02_fuzzy_names", f"""WITH {_TOK}, {_NAMES}, tg AS (SELECT DISTINCT token, unnest(list_transform(range(1, length(token)), lambda i: substr(token, i, 2))) AS g FROM tq), ng AS (SELECT DISTINCT name, unnest(list_transform(range(1, length(name)), lambda i: substr(name, i, 2))) AS g FROM nm), pp AS (SELECT DISTINCT token, name FROM tg JOIN ng USING (g) WHERE least(length(token), length(name)) * 1e0 / greatest(length(token), length(name)) >= 0.7),
pr AS (SELECT token, name, round(greatest(1 - levenshtein(token, name) * 1e0 / greatest(length(token), length(name)), CASE WHEN contains(name, token) OR contains(token, name) THEN least(length(token), length(name)) * 1e0 / greatest(length(token), length(name)) ELSE 0 END), 6) AS score FROM pp)
SELECT token, name, score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY score DESC, name) AS rn FROM pr WHERE score >= 0.7) WHERE rn <= 5""")
def _(v):
    names = v.table("benchmark").select(F.explode(F.split("text", " ")).alias("name")).filter("length(name) >= 5 AND name rlike '^[ -~]+$'")
    return X.fuzzy(_tokens(v).filter("length(token) >= 5 AND token rlike '^[ -~]+$'"), names, 0.7, 5)


@query("t03_noise_lines", r"SELECT log, pos, score < 0.3 OR length(regexp_replace(text, '[^\p{L}]', '', 'g')) < 2 AS noise FROM log_lines")
def _(v):
    return v.log_lines.select("log", "pos", X.is_noise(F.col("text"), F.col("score")).alias("noise"))


_NORM = r"regexp_replace(translate(text, '（）【】，。：；！？ABCDEFGHIJKLMNOPQRSTUVWXYZ', '()[],.:;!?abcdefghijklmnopqrstuvwxyz'), '[\s()\[\]]+', '', 'g')"


@query("t04_normalized_lines", f"SELECT log, pos, {_NORM} AS norm FROM log_lines")
def _(v):
    return v.log_lines.select("log", "pos", X.normalized(F.col("text")).alias("norm"))


@query("t05_repeated_lines", f"WITH nl AS (SELECT log, pos, {_NORM} AS norm FROM log_lines) SELECT log, pos, coalesce(pos - lag(pos) OVER (PARTITION BY log, norm ORDER BY pos) <= 45, false) AS repeat FROM nl")
def _(v):
    return X.near_lines(v.log_lines).select("log", "pos", "repeat")


@query("t05_stitched_lines")
def _(v):
    return X.stitch(v.log_lines)


_SIDED = "ls AS (SELECT *, CASE WHEN pos % 7 = 0 THEN NULL ELSE side END AS tag FROM log_lines), n AS (SELECT log, name, tag, count(*) AS n, count(*) FILTER (pos <= 40) AS early FROM ls WHERE tag IS NOT NULL GROUP BY 1, 2, 3), r AS (SELECT *, sum(n) OVER (PARTITION BY log, name) AS total, row_number() OVER (PARTITION BY log, name ORDER BY n DESC, tag) AS rn, count(*) FILTER (early > 0) OVER (PARTITION BY log, name) AS firsts, max(CASE WHEN early > 0 THEN tag END) OVER (PARTITION BY log, name) AS anchor FROM n), vt AS (SELECT log, name, CASE WHEN n >= 0.65 * total THEN tag WHEN firsts = 1 THEN anchor END AS vote FROM r WHERE rn = 1)"


def _tagged(v):
    """Lines of which every seventh lost its side."""
    return v.log_lines.withColumn("side", F.expr("if(pos % 7 = 0, null, side)"))


@query("t06_side_votes", f"WITH {_SIDED} SELECT log, name, vote FROM vt")
def _(v):
    return X.side_votes(_tagged(v))


@query("t06_backfilled_sides", f"WITH {_SIDED} SELECT ls.log, pos, coalesce(vote, tag) AS fixed, CASE WHEN vote IS NOT NULL AND tag IS NULL THEN 'filled' WHEN vote <> tag THEN 'corrected' ELSE 'kept' END AS change FROM ls LEFT JOIN vt ON vt.log = ls.log AND vt.name IS NOT DISTINCT FROM ls.name")
def _(v):
    return X.backfill_sides(_tagged(v)).select("log", "pos", "fixed", "change")


@query("t07_owned_tokens", f"WITH {_TOK} SELECT token, min(side) AS side FROM tk JOIN log_lines USING (log, pos) GROUP BY 1 HAVING count(DISTINCT side) = 1")
def _(v):
    t = v.log_lines.select("side", F.explode(F.split("text", " ")).alias("token"))
    return t.groupBy("token").agg(F.min("side").alias("side"), F.count_distinct("side").alias("n")).filter("n = 1").drop("n")


@query("t08_cut_logs", "SELECT log, pos FROM log_lines l WHERE pos <= coalesce((SELECT min(pos) FROM log_lines e WHERE e.log = l.log AND e.text LIKE '%the%'), 1000000)")
def _(v):
    return X.cut_after(v.log_lines, F.col("text").contains("the")).select("log", "pos")


@query("t09_clear_records", "SELECT match_id FROM matches WHERE winner IN (1, 2) AND n1 = 3 AND n2 = 3")
def _(v):
    t = v.matches.withColumn("failures", F.when(F.expr("n1 <> 3 OR n2 <> 3"), F.array(F.lit("team"))).otherwise(F.array().cast("array<string>")))
    return t.filter(F.col("winner").isin(1, 2) & (F.size("failures") == 0)).select("match_id")
