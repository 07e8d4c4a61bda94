"""Operator 5, mixing sources to target weights: iterative proportional fitting, then calibrated sampling.

Documents are counted into cells (source, language, topic) with their tokens. Raking multiplies the
cells' weights so that one marginal after another meets its target shares, until all of them are within
``TOLERANCE`` (summed distance of shares); what comes out has the documents' own association and the
targets' marginals. There is no limit of rounds: where the cells can't meet the targets, the fit ends when the distance has not
got smaller by ``PROGRESS`` in ``PATIENCE`` rounds, and a warning gives the distance left (``residual`` measures it). A document of a cell is kept with probability min(1, c * fitted / tokens),
with c set so that the expected tokens are ``KEEP`` of all; the draw is a hash of the id, so runs repeat.

Default targets flatten each marginal: shares to the power ``FLATTEN``, so a source with a third of
all tokens is cut back and small ones gain. Topic is the text's form: notice, contact, short or prose.

Only built-in functions run. Cells are aggregated before anything is shuffled, so a hot source costs
a row for each cell and task. A step adds up the cells by one marginal, joins the sums back and writes the cells anew; the cells
before are deleted. So a plan is never larger than one step's; joins are by key, broadcast only under Spark's own size limit.
How far a marginal was from its target when its step began is read off the written cells, without another shuffle. Cases: null sources and languages are groups of their own; a null text counts
as empty; very long texts are counted whole; texts without a word have weight zero and are kept with
probability one where their whole cell has none; rows without an id share a draw; repeated rows share
theirs; an empty table gives none; all columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import free_name, materialize, shared_dir, table, uniform

#: Distance of all shares from their targets that ends the fit; a fit that got nearer by less than PROGRESS of it in PATIENCE rounds is as near as it comes.
TOLERANCE, PROGRESS, PATIENCE = 1e-10, 0.1, 12
FLATTEN = 0.7
KEEP = 0.8
SEED = "mix"
MARGINALS = ("source", "lang", "topic")


def tokens(text: Column) -> Column:
    """Runs of characters that are not white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))


def topic(text: Column) -> Column:
    """A text's form, from its marks."""
    t = F.coalesce(text, F.lit(""))
    low = F.lower(t)
    return (
        F.when(low.contains("licensed under") | low.contains("released under") | low.contains("rights reserved"), "notice")
        .when((t.contains("@") & t.rlike("[A-Za-z0-9]@[A-Za-z0-9]")) | t.contains("<EMAIL>") | t.contains("<PHONE>") | (t.contains("+") & t.rlike(r"\+[0-9]")), "contact")
        .when(F.length(t) < 400, "short")
        .otherwise("prose")
    )


def cells(docs: DataFrame) -> DataFrame:
    """(source, lang, topic, docs, tokens)."""
    rows = docs.select("source", "lang", topic(F.col("text")).alias("topic"), tokens(F.col("text")).alias("n"))
    return rows.groupBy(*MARGINALS).agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("tokens"))


def flat_targets(cell: DataFrame, flatten: float = FLATTEN) -> dict[str, DataFrame]:
    """Target shares (value, share) of each marginal: shares to a power, scaled to one."""
    out = {}
    for m in MARGINALS:
        t = cell.groupBy(F.col(m).alias("value")).agg(F.sum("tokens").cast("double").alias("n")).filter("n > 0").withColumn("w", F.pow("n", F.lit(flatten)))
        total = t.agg(F.sum("w").alias("all"))  # one row
        out[m] = t.crossJoin(F.broadcast(total)).select("value", (F.col("w") / F.col("all")).alias("share"))
    return out


def _written(df: DataFrame, old: str | None) -> tuple[DataFrame, str]:
    """``df`` as a table of its own in the shared folder; the folder ``old``, which it was made from, goes."""
    spark, path = df.sparkSession, f"{shared_dir(df.sparkSession)}/rake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if old:
        p = spark._jvm.org.apache.hadoop.fs.Path(old)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(df.schema).parquet(path), path


def rake(cell: DataFrame, targets: dict[str, DataFrame], tolerance: float = TOLERANCE) -> DataFrame:
    """Cells with ``fitted``: shares of all tokens that meet the targets, as near as the cells allow."""
    t, share, seen = cell, {m: f"_share_{m}" for m in MARGINALS}, {m: f"_seen_{m}" for m in MARGINALS}
    for m in MARGINALS:
        own = targets[m].select(F.col("value").alias("_v"), F.col("share").alias(share[m]))
        t = t.join(own, F.col(m).eqNullSafe(F.col("_v")), "left").drop("_v").withColumn(seen[m], F.lit(0.0))
    t, path = _written(t.withColumn("fitted", F.col("tokens").cast("double")), None)
    # the cells of a value sum to its share after its step, so their parts of the distance sum to the value's
    apart = [F.sum(F.abs(F.try_divide(F.col(seen[m]), F.col(share[m])) - 1) * F.col(f"_after_{m}")) for m in MARGINALS]
    t, path = _written(t.withColumns({f"_after_{m}": F.lit(0.0) for m in MARGINALS}), path)
    columns = t.columns
    best, since = float("inf"), 0
    while since < PATIENCE:
        for m in MARGINALS:
            now = t.groupBy(F.col(m).alias("_v")).agg(F.sum("fitted").alias("_now"))
            after = F.col("fitted") * F.coalesce(F.try_divide(F.col(share[m]), F.col("_now")), F.lit(0.0))
            t = t.join(now, F.col(m).eqNullSafe(F.col("_v")), "left").withColumns({"fitted": after, seen[m]: F.col("_now"), f"_after_{m}": after})
            t, path = _written(t.select(*columns), path)
        off = max(x or 0.0 for x in t.agg(*apart).first())
        if off <= tolerance:
            break
        best, since = (off, 0) if off < (1 - PROGRESS) * best else (best, since + 1)
    fitted = t.drop(*share.values(), *seen.values(), *[f"_after_{m}" for m in MARGINALS])
    left = max(residual(fitted, targets).values())
    if left > 10 * tolerance:
        warnings.warn(f"raking ended {left:.2e} from its targets, which the cells can't meet", stacklevel=2)
    return fitted


def residual(fitted: DataFrame, targets: dict[str, DataFrame]) -> dict[str, float]:
    """How far each marginal of ``fitted`` is from its target: the summed distance of shares."""
    out = {}
    for m in MARGINALS:
        now = fitted.groupBy(F.col(m).alias("_value")).agg(F.sum("fitted").alias("now"))
        t = targets[m].join(now, F.col("value").eqNullSafe(F.col("_value")), "full")
        out[m] = float(t.agg(F.sum(F.abs(F.coalesce("now", F.lit(0.0)) - F.coalesce("share", F.lit(0.0))))).first()[0] or 0.0)
    return out


def probabilities(fitted: DataFrame, keep: float = KEEP) -> DataFrame:
    """Adds ``p``: the chance to keep a document, its expected tokens ``keep`` of all (fewer where no more can be reached).

    Cells that reach probability one leave the others a larger c; that ends when no further cell reaches it."""
    ratio = F.coalesce(F.try_divide(F.col("fitted"), F.col("tokens").cast("double")), F.lit(0.0))
    t = fitted.withColumn("_ratio", ratio)
    total = t.agg(F.sum("tokens")).first()[0] or 0
    c, want, held = 0.0, keep * total, None
    while True:
        capped = F.col("_ratio") * F.lit(c) >= 1.0
        r = t.agg(F.sum(F.when(capped, F.col("tokens")).otherwise(0)), F.sum(F.when(capped, 0.0).otherwise(F.col("_ratio") * F.col("tokens"))), F.sum(F.when(capped, 1).otherwise(0))).first()
        if r[2] == held or not r[1]:
            break
        c, held = (want - float(r[0] or 0)) / r[1], r[2]
    p = F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.lit(float(c)) * F.col("_ratio"))).otherwise(F.lit(1.0))
    return t.withColumn("p", p).drop("_ratio")


def mix(docs: DataFrame, targets: dict[str, DataFrame] | None = None, keep: float = KEEP) -> tuple[DataFrame, str, str]:
    """The sampled rows of ``docs`` with all columns, their topic and probability; those two columns' names."""
    cell = materialize(cells(docs), "cells")
    p = probabilities(rake(cell, targets or flat_targets(cell)), keep)
    names = {k: free_name(docs, f"_{k}") for k in ("p", "s", "l", "t", "topic")}
    p = p.select(F.col("source").alias(names["s"]), F.col("lang").alias(names["l"]), F.col("topic").alias(names["t"]), F.col("p").alias(names["p"]))
    t = docs.withColumn(names["topic"], topic(F.col("text")))
    same = F.col("source").eqNullSafe(F.col(names["s"])) & F.col("lang").eqNullSafe(F.col(names["l"])) & (F.col(names["topic"]) == F.col(names["t"]))
    # a cell has a few bytes; the join is a broadcast under Spark's size limit and else a skew-split shuffle
    t = t.join(p, same).filter(uniform(SEED, "doc_id") < F.col(names["p"]))
    return t.select(*docs.columns, names["topic"], names["p"]), names["topic"], names["p"]


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, form, p = mix(table(spark, sf_dir, "documents"))
    return t.select("doc_id", "source", "lang", F.col(form).alias("topic"), tokens(F.col("text")).cast("long").alias("n_tokens"), F.round(p, 6).alias("p"))


#: Rounds and steps of the cap that the SQL unrolls; those past the last that changes anything change nothing, as do rounds past the tolerance.
_SQL_ROUNDS, _SQL_STEPS = 30, 8


def _sql() -> str:
    low = "lower(coalesce(text, ''))"
    ctes = [
        rf"""d AS (SELECT doc_id, source, lang, CASE WHEN contains({low}, 'licensed under') OR contains({low}, 'released under') OR contains({low}, 'rights reserved') THEN 'notice'
  WHEN regexp_matches(coalesce(text, ''), '[A-Za-z0-9]@[A-Za-z0-9]|<EMAIL>|<PHONE>|\+[0-9]') THEN 'contact' WHEN length(coalesce(text, '')) < 400 THEN 'short' ELSE 'prose' END AS topic,
  len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n FROM documents)""",
        "f0 AS (SELECT source, lang, topic, sum(n) AS tokens, CAST(sum(n) AS DOUBLE) AS fitted FROM d GROUP BY 1, 2, 3)",
    ]
    for m in MARGINALS:
        ctes.append(f"t_{m} AS (SELECT {m} AS v, pow(CAST(sum(tokens) AS DOUBLE), {FLATTEN}) / sum(pow(CAST(sum(tokens) AS DOUBLE), {FLATTEN})) OVER () AS share FROM f0 GROUP BY 1)")
    k = 0
    for _ in range(_SQL_ROUNDS):
        for m in MARGINALS:
            ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, fitted * share / sum(fitted) OVER (PARTITION BY {m}) AS fitted FROM f{k} JOIN t_{m} ON {m} IS NOT DISTINCT FROM v)")
            k += 1
    ctes.append(f"r AS MATERIALIZED (SELECT *, fitted / tokens AS ratio FROM f{k})")
    ctes.append(f"c0 AS MATERIALIZED (SELECT {KEEP} * sum(tokens) / sum(ratio * tokens) AS c FROM r)")
    for i in range(1, _SQL_STEPS):
        ctes.append(f"c{i} AS MATERIALIZED (SELECT ({KEEP} * sum(tokens) - sum(CASE WHEN ratio * (SELECT c FROM c{i - 1}) >= 1 THEN tokens ELSE 0 END)) / sum(CASE WHEN ratio * (SELECT c FROM c{i - 1}) >= 1 THEN 0 ELSE ratio * tokens END) AS c FROM r)")
    draw = f"CAST(CAST('0x' || substr(md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 12) AS BIGINT) AS DOUBLE) / {1 << 48}"
    p = f"least(1.0, ratio * (SELECT c FROM c{_SQL_STEPS - 1}))"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, d.source, d.lang, d.topic, CAST(n AS BIGINT) AS n_tokens, round({p}, 6) AS p FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source AND d.lang IS NOT DISTINCT FROM r.lang AND d.topic = r.topic WHERE {draw} < {p}"


SQL = _sql()
