"""What the third round's findings showed: limits and models come from all rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import functions as F

from matchloom.llm import op1_quality, op7_pii


def test_every_label_counts_for_the_bands(spark):
    """each of 20 languages has one bad document, beyond 1,999 good ones."""
    t = spark.range(40_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("l"), F.col("id") % 20).alias("lang"), F.lit(100).alias("n_words"), F.lit(0).alias("n_repeat_words"), F.lit(10_000).alias("n_model_chars"))
    bad = F.col("doc_id") < 20
    s = F.when(bad, 9.0).otherwise(2 + (F.col("doc_id") % 1000) / 1000)
    t = t.withColumns({"mean_logp": -s, "mean_logp1": -s})
    labels = t.select("doc_id", F.when(bad, 0).otherwise(1).alias("quality"))
    got = {r["lang"]: r for r in op1_quality.bands(t, labels).collect()}
    a = op1_quality.SHORT / 100
    for k in range(20):
        top = max(2 + (i % 1000) / 1000 for i in range(20 + k, 40_000, 20))
        assert abs(got[f"l{k}"]["high"] - ((9.0 - a) + (top - a)) / 2) < 1e-9, (k, got[f"l{k}"])
        assert got[f"l{k}"]["low"] < 2 + a


def test_gains_add_up_over_bins(spark):
    """values of many bins, and many of one, against plain sums."""
    import random

    r = random.Random(3)
    rows = [(lang, round(r.gauss(0, 0.004 if lang == "a" else 2), 5), r.random() < 0.02 + 0.03 * (i % 2)) for lang in "ab" for i in range(800)]
    got = {x["lang"]: x["cut"] for x in op1_quality._cut(spark.createDataFrame(rows, "lang string, v double, good boolean"), F.col("v"), 1, "cut").collect()}
    for lang in "ab":
        own, at, best = sorted({v for n, v, _ in rows if n == lang}, reverse=True), 0.0, None
        for i, v in enumerate(own):
            at += sum(-op1_quality.COST if good else 1.0 for n, x, good in rows if n == lang and x == v)
            best = max(best or (at, v, i), (at, v, i))
        low = own[best[2] + 1] if best[2] + 1 < len(own) else best[1] - op1_quality.MARGIN
        assert best[0] > 0 and abs(got[lang] - (best[1] + low) / 2) < 1e-12


def test_every_document_teaches_the_trees(spark, monkeypatch):
    """rows that trees and curves count are those of all documents."""
    seen = []
    monkeypatch.setattr(op7_pii, "materialize", lambda df, name="step": seen.append(df) or df.limit(0))
    texts = spark.range(21_000).select(F.col("id").alias("doc_id"), F.lit("v1.2 of 7").alias("text"))
    assert op7_pii.train(texts) is None
    each = next(op7_pii._training_task([pa.record_batch([pa.array(["v1.2 of 7"])], names=["text"])])).num_rows
    assert seen[0].agg(F.sum("n")).first()[0] == 21_000 * each
