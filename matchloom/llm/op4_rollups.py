"""Operator 4, token counts: totals by source, language and tokenizer version, kept by signed deltas.

A change row has a sign: +1 adds a document's count, -1 takes an earlier one away; a revised count is
one of each. ``changes`` makes them from two states of a table of counts. A batch is aggregated to
one signed row for each group and written to ``<root>/deltas/batch=<id>``; Spark's committer puts the
marker ``_SUCCESS`` there last. A batch whose marker exists is not applied again, and one that was cut
off is overwritten, so retries and replays change nothing. ``totals`` adds the committed deltas;
``compact`` writes their sum as a base that names the batches it holds, and later reads skip those.

One writer applies batches at a time; readers may read meanwhile. Only narrow rows are shuffled: changes
are counted inside tasks before they move. Cases: null keys are groups of their own; very long texts are
counted whole; repeated rows count each time (the state is a bag); null counts are zero; groups
whose totals are all zero stay out; an empty batch commits and adds nothing; other columns are not read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, shared_dir, table

GROUP = ("source", "lang", "tokenizer")
_SCHEMA = "source string, lang string, tokenizer string, docs long, tokens long"


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, source, lang, tokenizer, n_tokens): words, and words with punctuation apart, of whole texts."""
    text = F.coalesce("text", F.lit(""))
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    pieces = F.regexp_count(text, F.lit(r"[A-Za-z0-9\x80-\x{10FFFF}]+|[^\x20\x09-\x0DA-Za-z0-9\x80-\x{10FFFF}]"))
    each = F.array(F.struct(F.lit("words-1").alias("tokenizer"), words.cast("long").alias("n_tokens")), F.struct(F.lit("pieces-2").alias("tokenizer"), pieces.cast("long").alias("n_tokens")))
    return docs.select("doc_id", "source", "lang", F.explode(each).alias("_e")).select("doc_id", "source", "lang", "_e.tokenizer", "_e.n_tokens")


def changes(before: DataFrame | None, after: DataFrame) -> DataFrame:
    """Signed rows that lead from one state to the next: rows of each that the other doesn't have as often."""
    cols = ["doc_id", *GROUP, "n_tokens"]
    signed = after.select(*cols, F.lit(1).alias("sign"))
    if before is not None:
        signed = signed.unionAll(before.select(*cols, F.lit(-1).alias("sign")))
    net = signed.groupBy(*cols).agg(F.sum("sign").alias("sign")).filter("sign <> 0")
    return net


class Rollup:
    """Totals under a folder of the shared store."""

    def __init__(self, spark: SparkSession, root: str | None = None):
        self.spark, self.root = spark, (root or f"{shared_dir(spark)}/rollup-{uuid.uuid4().hex}").rstrip("/")

    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _children(self, folder: str, key: str) -> list[str]:
        fs, p = self._fs(f"{self.root}/{folder}")
        if not fs.exists(p):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(n.removeprefix(f"{key}=") for n in names if n.startswith(f"{key}=") and self._done(f"{self.root}/{folder}/{n}"))

    def _done(self, path: str) -> bool:
        fs, p = self._fs(f"{path}/_SUCCESS")
        return fs.exists(p)

    def committed(self) -> list[str]:
        """Ids of the applied batches, those in the base too."""
        return sorted({*self._children("deltas", "batch"), *self._in_base()})

    def _base(self) -> str | None:
        versions = self._children("base", "version")
        return f"{self.root}/base/version={max(versions, key=int)}" if versions else None

    def _in_base(self) -> list[str]:
        base = self._base()
        return [r["batch"] for r in self.spark.read.parquet(f"{base}/batches").collect()] if base else []

    def apply(self, batch: str, rows: DataFrame) -> bool:
        """Commits a batch of signed rows; False if it was committed before."""
        if batch in self.committed():
            return False
        n = F.coalesce("n_tokens", F.lit(0))
        delta = rows.groupBy(*GROUP).agg(F.sum(F.col("sign").cast("long")).alias("docs"), F.sum(F.col("sign") * n).cast("long").alias("tokens"))
        delta.write.mode("overwrite").parquet(f"{self.root}/deltas/batch={batch}")
        return True

    def _open(self) -> list[str]:
        """Committed batches that the base doesn't hold."""
        held = set(self._in_base())
        return [b for b in self._children("deltas", "batch") if b not in held]

    def _sum(self, batches: list[str], base: str | None) -> DataFrame:
        """Totals of the base and of the named batches: one read of all their folders."""
        paths = [f"{self.root}/deltas/batch={b}" for b in batches] + ([f"{base}/totals"] if base else [])
        rows = self.spark.read.schema(_SCHEMA).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMA)
        out = rows.groupBy(*GROUP).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return out.filter("docs <> 0 or tokens <> 0")

    def totals(self) -> DataFrame:
        return self._sum(self._open(), self._base())

    def compact(self) -> None:
        """Writes the sum of the deltas committed by now; the version's marker comes last.

        Base and batches are listed once: what is summed is what the version names, whatever is committed meanwhile."""
        base, batches, held = self._base(), self._open(), self._in_base()
        version = max(map(int, self._children("base", "version")), default=0) + 1
        path = f"{self.root}/base/version={version}"
        self._sum(batches, base).write.mode("overwrite").parquet(f"{path}/totals")
        self.spark.createDataFrame([(b,) for b in [*held, *batches]], "batch string").write.mode("overwrite").parquet(f"{path}/batches")
        fs, p = self._fs(f"{path}/_SUCCESS")
        fs.create(p).close()


def _edited(state: DataFrame) -> DataFrame:
    """A second state of the counts: every seventh document deleted, every fifth revised to a tenth more."""
    more = F.when(F.col("doc_id") % 5 == 0, F.col("n_tokens") + F.floor(F.col("n_tokens") / 10)).otherwise(F.col("n_tokens"))
    return state.filter("doc_id is null or doc_id % 7 <> 0").withColumn("n_tokens", more)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after all documents were inserted, some deleted and revised, and both batches sent twice."""
    state = materialize(counts(table(spark, sf_dir, "documents")), "counts")
    edited = _edited(state)
    rollup = Rollup(spark)
    for batch, rows in (("0001", changes(None, state)), ("0002", changes(state, edited)), ("0001", changes(None, state))):
        rollup.apply(batch, rows)
    rollup.compact()
    rollup.apply("0002", changes(state, edited))
    return rollup.totals()


SQL = r"""
WITH t AS (SELECT doc_id, source, lang, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, source, lang, 'words-1' AS tokenizer, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS n FROM t
  UNION ALL SELECT doc_id, source, lang, 'pieces-2', len(regexp_extract_all(text, '[A-Za-z0-9\x{80}-\x{10FFFF}]+|[^\x20\x09-\x0DA-Za-z0-9\x{80}-\x{10FFFF}]')) FROM t)
SELECT source, lang, tokenizer, count(*) AS docs, CAST(sum(CASE WHEN doc_id % 5 = 0 THEN n + n // 10 ELSE n END) AS BIGINT) AS tokens
FROM c WHERE doc_id IS NULL OR doc_id % 7 <> 0 GROUP BY 1, 2, 3"""
