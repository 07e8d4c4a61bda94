"""Operator 3, quality classifier: document evidence combined with site evidence by empirical Bayes.

Document evidence: shares of a text (symbols, capitals, digits, repeated words and lines, words a
line, mean word length) feed a logistic regression that Spark ML fits on at most about
``TRAINING_DOCS`` labelled documents, drawn by a hash of the id. Site evidence: every document's
probability, at half weight, and every label, whole, are summed by host and path in grouped
aggregations. A Beta prior at each level, its strength fitted by moments from the spread of the sites,
shrinks paths toward their host and hosts toward all documents, so sparse sites stay near the global
rate. A document's own probability is taken out of its site's sums first (its label, where it has one,
stays: that is knowledge of the site). The posterior of a document adds its own log-odds to its path's
log-odds over the global ones; the site's share in it is bounded by ``SITE_LIMIT``, so that a bad site
can tip only documents that are doubtful themselves. Rejected: posterior under ``MIN_QUALITY``, where
losing a good document costs ``COST`` times as much as keeping a bad one.

Host and path are expressions of the caller's table; for ``documents`` they are source and language.
Texts are scanned once and not shuffled: rows with their evidence are written and read again. Sites that
hold a thousandth of the documents or more are joined by broadcast (a thousand at most), the others by
a shuffle.

Cases: a null or empty text has all shares zero and, like every text under five words, no evidence
of its own (it is kept); very long texts are scanned whole; null hosts and paths are sites of their own;
repeated rows and ties get equal results; labels without a document, repeated labels (the smaller
counts) and rows without a label are fine; with no label, or one class only, everything is kept; an
empty table gives no rows. All columns of ``docs`` pass through, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import free_name, materialize, small_batches, table, uniform, with_hot_keys
from matchloom.llm.textscan import Scan, base_counts, slices

TRAINING_DOCS = 20_000
COST = 4.0
MIN_QUALITY = 1 / (1 + COST)
SITE_LIMIT = 2.0
#: Weight of an unlabelled document's probability beside a label.
SOFT = 0.5
FEATURES = ("symbols", "capitals", "digits", "repeats", "dup_lines", "line_words", "word_length", "marks")


def text_features(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A row of shares for each text, and its number of words."""
    c, s = base_counts(col), Scan(col)
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    d = s.data
    upper, lower = s.per_doc((d >= 65) & (d <= 90)), s.per_doc((d >= 97) & (d <= 122))
    ld = np.bincount(s.lines()[0], minlength=s.n_docs)
    marks = np.zeros(256, bool)
    marks[[ord(x) for x in "!?*#$%&|<>=_~^@{}[]\\"]] = True
    x = [
        c["n_symbols"] / chars,
        upper / np.maximum(upper + lower, 1),
        s.per_doc((d >= 48) & (d <= 57)) / chars,
        c["n_repeat_words"] / words,
        c["n_dup_lines"] / np.maximum(ld, 1),
        np.log1p(words / np.maximum(ld, 1)),
        np.minimum(chars / words, 30.0),
        s.per_doc(marks[d]) / chars,
    ]
    return np.stack(x, axis=1), c["n_words"]


def _features_task(at: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, whole.schema.names[at]):
                x, n = text_features(b.column(at))
                yield pa.record_batch([*b.columns, pa.array(list(x), pa.list_(pa.float64())), pa.array(n)], names=[*[f"c{i}" for i in range(b.num_columns)], "x", "n"])

    return run


def with_features(docs: DataFrame, x: str, n: str) -> DataFrame:
    """All columns, the features and the words of each row's text."""
    small_batches(docs.sparkSession)
    inner = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).withColumnRenamed(f"c{docs.columns.index('text')}", "text")
    at = docs.columns.index("text")
    fields = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(docs.schema.fields))
    return inner.mapInArrow(_features_task(at), f"{fields}, x array<double>, n long").toDF(*docs.columns, x, n)


def fit(rows: DataFrame) -> list[float] | None:
    """Weights and intercept from (x, quality); None with less than two classes."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    t = rows.select(array_to_vector("x").alias("features"), F.col("quality").cast("double").alias("label"))
    if t.select("label").distinct().count() < 2:
        return None
    m = LogisticRegression(regParam=1e-4, maxIter=60).fit(t)
    return [*map(float, m.coefficients), float(m.intercept)]


def log_odds(x: Column, n: Column, weights: list[float]) -> Column:
    """The classifier's log-odds of good quality, within +-12; 0 for texts under five words."""
    z = F.lit(weights[-1])
    for i, w in enumerate(weights[:-1]):
        z = z + F.lit(w) * F.get(x, F.lit(i))
    return F.when(n >= 5, F.least(F.greatest(z, F.lit(-12.0)), F.lit(12.0))).otherwise(F.lit(0.0))


def _strength(sites: DataFrame, mean: float) -> float:
    """Beta prior strength from the spread of site rates around the mean, by moments; 2 to 1000."""
    r = sites.filter("n >= 5").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.pow(F.col("good") / F.col("n") - mean, F.lit(2))).alias("ss"), F.count(F.lit(1)).alias("k")).first()
    if not r["k"] or r["k"] < 2:
        return 50.0
    within = mean * (1 - mean)
    between = max(r["ss"] / r["n"] - within * r["k"] / r["n"], 1e-6)
    return min(1000.0, max(2.0, within / between))


def site_sums(evidence: DataFrame) -> tuple[DataFrame, dict]:
    """(host, path, docs, good, n, host_good, host_n) of each site, and the numbers that hold for all.

    ``evidence``: rows (host, path, quality, p). Each counts by its probability ``p`` at weight SOFT, a label as one more."""
    known = F.col("quality").isNotNull()
    good = SOFT * F.col("p") + F.when(known, F.col("quality").cast("double")).otherwise(0.0)
    paths = materialize(evidence.groupBy("host", "path").agg(F.count(F.lit(1)).alias("docs"), F.sum(good).alias("good"), F.sum(SOFT + known.cast("double")).alias("n")), "paths")
    hosts = materialize(paths.groupBy("host").agg(F.sum("good").alias("host_good"), F.sum("n").alias("host_n"), F.count(F.lit(1)).alias("paths")), "hosts")
    total = hosts.agg(F.sum("host_good").alias("good"), F.sum("host_n").alias("n")).first()
    mean = min(1 - 1e-6, max(1e-6, total["good"] / total["n"])) if total["n"] else 0.5
    up, low = _strength(hosts.selectExpr("host_good AS good", "host_n AS n"), mean), _strength(paths, mean)
    return with_hot_keys(paths, hosts, ["host"], "paths"), {"mean": mean, "up": up, "low": low}


def site_odds(own: Column, numbers: dict) -> Column:
    """Log-odds of a row's path over the global ones, from the columns of ``site_sums`` less the row's own probability."""
    mean, up, low = numbers["mean"], numbers["up"], numbers["low"]
    less = lambda c: F.greatest(F.col(c) - SOFT * own, F.lit(0.0))
    count = lambda c: F.greatest(F.col(c) - SOFT, F.lit(0.0))
    host = (less("host_good") + up * mean) / (count("host_n") + up)
    rate = (less("good") + low * host) / (count("n") + low)
    rate = F.least(F.greatest(rate, F.lit(1e-6)), F.lit(1 - 1e-6))
    site = F.log(rate / (1 - rate)) - math.log(mean / (1 - mean))
    return F.least(F.greatest(site, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))


def classify(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, max_docs: int = TRAINING_DOCS, carry: list[str] | None = None) -> tuple[DataFrame, str]:
    """All rows of ``docs`` with a posterior probability of good quality, and that column's name; columns: ``carry``, by default all."""
    names = {k: free_name(docs, f"_{k}") for k in ("x", "n", "posterior")}
    carry = docs.columns if carry is None else carry
    host, path = host if host is not None else F.col("source"), path if path is not None else F.col("lang")
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    share = min(1.0, max_docs / max(known.count(), 1))
    sample = known.filter(uniform("quality", "label_id") < share)
    ids = docs.select("doc_id", "text")
    # known.count() labels at most, of which about max_docs stay: a bounded table
    rows = ids.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id"))
    weights = fit(materialize(with_features(rows.select("text", "quality"), "x", "n").filter("n >= 5").select("x", "quality"), "training"))
    if weights is None:
        return docs.select(*carry, F.lit(1.0).alias(names["posterior"])), names["posterior"]
    t = with_features(docs, names["x"], names["n"])
    row = F.struct(*[F.col(c) for c in carry]).alias("row")
    t = materialize(t.select(row, "doc_id", host.alias("host"), path.alias("path"), log_odds(F.col(names["x"]), F.col(names["n"]), weights).alias("z"), (F.col(names["n"]) >= 5).alias("judged")), "evidence")
    p = 1 / (1 + F.exp(-F.col("z")))
    evidence = t.select("doc_id", "host", "path", p.alias("p")).join(known, F.col("doc_id") == F.col("label_id"), "left")
    sites, numbers = site_sums(evidence.select("host", "path", "quality", "p"))
    t = with_hot_keys(t, materialize(sites, "sites"), ["host", "path"], "docs")
    z = F.col("z") + F.when(F.col("judged"), site_odds(p, numbers)).otherwise(F.lit(0.0))
    return t.select("row.*", (1 / (1 + F.exp(-z))).alias(names["posterior"])), names["posterior"]


def keep_good(docs: DataFrame, labels: DataFrame, min_quality: float = MIN_QUALITY) -> DataFrame:
    """The rows of ``docs`` that aren't rejected."""
    t, p = classify(docs, labels)
    return t.filter(F.col(p) >= min_quality).select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    t, p = classify(docs, table(spark, sf_dir, "labels"), carry=["doc_id", "source", "lang"])
    return t.select("doc_id", F.col("source").alias("host"), F.col("lang").alias("path"), F.round(p, 6).alias("quality"), (F.col(p) >= MIN_QUALITY).alias("kept"))
