"""Round 4: what spelling variants send through the driver."""

from __future__ import annotations

from matchloom.llm import op11_spelling as O


def test_lookups_are_not_sent(spark, tmp_path):
    """the words' small files let Spark send all lookups, many rows a word, through the driver."""
    spark.createDataFrame([(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}", 3 + i) for i in range(500)], "word string, n long").write.parquet(str(tmp_path / "words"))
    near = O.near_pairs(spark.read.parquet(str(tmp_path / "words")))
    assert "BroadcastHashJoin" not in near._jdf.queryExecution().executedPlan().toString()
    assert near.count() > 500
