"""Operator 9, nearest neighbours: multi-index hashing of learned rotated binary codes.

Codes: vectors are scaled to length one and centred, then turned by rotations learned on a bounded
sample so that the signs of the coordinates lose least (alternating between signs and the best
rotation); several rotations give ``BITS`` bits. Each code is cut into ``BITS // 8`` substrings of a
byte, and every shard of the rows indexes each substring by its value. By the pigeonhole principle a
code within Hamming radius r agrees with the query's to within r // substrings bits in at least one
substring; probing those values retrieves every code within r, and nothing is lost to the index. The
codes within r are reranked by their exact cosine in double precision.

The radius is learned on the sample: the smallest at which ``RECALL`` of the sample's true neighbours
lie within it. So is the index: of several code lengths with substrings of two bytes, the one whose probes meet the smallest share of
the sample's codes at its radius. Two ways use it:

* Lists (share at most ``PRUNES``, as with clustered vectors): every row is entered in one list for each of its substrings, a query asks for the lists whose values
  lie within radius // substrings bits of its own, and Spark joins them on (substring, value). Codes are compared bit by bit in
  the join, found pairs are made distinct, and only those fetch vectors. Work and shuffle grow with rows, plus queries times the lists they probe.
* Tiles (otherwise, as with vectors near random, where every list is near every query): rows are dealt evenly to shards of about ``SHARD`` vectors and queries to blocks of at most
  ``BLOCK``; a task holds one shard against one block and indexes single bytes. Queries that find fewer than k rows in the lists are searched so, too, and
  a shard that holds fewer than k codes within r widens the radius for that query, so a query always gets k rows if there are so many.

Memory is bounded by a tile, and no vector but the fit's sample passes through the driver. Recall is below one where
neighbours lie beyond the radius; it is measured against brute force in the tests.

Cases: vectors that are null, empty, of another length than most, zero, or with null or non-finite
parts take no part; equal vectors tie by the smaller id; repeated ids are separate candidates, but a
query skips rows with its own id; a query row that repeats id and vector is searched once, one that
repeats the id with another vector is a query of its own and gives its own k rows; an empty table gives
no rows; other columns are not read, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, n_parts, table

K = 5
EVERY = 50
BITS = 256
#: Vectors of the sample that rotations and radius are learned on, and of its queries.
SAMPLE, PROBES = 4096, 256
RECALL = 0.985
#: Code lengths that lists may have, the width of their substrings, and the largest share of codes that their probes may meet.
LENGTHS, WIDTH, PRUNES = (64, 128, 192, 256), 16, 0.2
#: Vectors of a shard and queries of a block that one task holds, about.
SHARD, BLOCK = 65_536, 8192
_MASKS = [np.array([m for m in range(256) if m.bit_count() <= r], np.uint8) for r in range(9)]


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the rows that take part."""
    v = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).filter("vec_id is not null and embedding is not null and size(embedding) > 0")
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    v = v.filter(finite & some)
    size = v.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    return v.filter(F.size("embedding") == (size["d"] if size else 0))


def _unit(m: np.ndarray) -> np.ndarray:
    m = m / np.abs(m).max(axis=1, keepdims=True)
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _matrix(col: pa.Array) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    n = len(col)
    return col.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 1))


def encode(model: dict, unit: np.ndarray) -> np.ndarray:
    return np.packbits((unit - model["mean"]) @ model["turn"] > 0, axis=1)


def fit(vectors: DataFrame, bits: int = BITS, sample: int = SAMPLE, seed: int = 11) -> dict | None:
    """Rotations and radius from at most ``sample`` vectors, drawn by a hash of the id."""
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).select("embedding").toArrow()
    if not rows.num_rows:
        return None
    x = _unit(_matrix(rows["embedding"]))
    model = {"mean": x.mean(axis=0)}
    c, d = x - model["mean"], x.shape[1]
    rng, turns = np.random.default_rng(seed), []
    for _ in range(math.ceil(bits / d)):
        turn = np.linalg.qr(rng.normal(size=(d, d)))[0]
        for _ in range(25):
            u, _, vt = np.linalg.svd(c.T @ np.where(c @ turn > 0, 1.0, -1.0))
            turn = u @ vt
        turns.append(turn)
    model["turn"] = np.hstack(turns)[:, :bits]
    codes = encode(model, x)
    q = np.arange(min(PROBES, len(x)))
    near = x[q] @ x.T
    near[q, q] = -2
    k = min(K, len(x) - 1)
    if k < 1:
        return model | {"radius": bits, "lists": None}
    top = np.argsort(-near, axis=1)[:, :k]
    far = np.bitwise_count(codes[q][:, None, :] ^ codes[top]).sum(axis=2)
    model["radius"] = int(np.ceil(np.quantile(far, RECALL)))
    return model | {"lists": min((_lists(codes[:, : n // 8], q, top) for n in LENGTHS if n <= bits), key=lambda x: x["share"])}


def _lists(codes: np.ndarray, q: np.ndarray, top: np.ndarray) -> dict:
    """Radius, bits that a substring may differ by, and the share of the sample's codes that the probes of its queries meet."""
    far = np.bitwise_count(codes[q][:, None, :] ^ codes[top]).sum(axis=2)
    radius, parts = int(np.ceil(np.quantile(far, RECALL))), codes.shape[1] * 8 // WIDTH
    each = np.bitwise_count(codes[q][:, None, :] ^ codes[None]).reshape(len(q), len(codes), parts, WIDTH // 8).sum(axis=3)
    return {"bits": codes.shape[1] * 8, "radius": radius, "off": radius // parts, "share": float((each.min(axis=2) <= radius // parts).mean())}


class Index:
    """Codes of one shard, found by the value of each byte."""

    def __init__(self, codes: np.ndarray):
        self.codes = codes
        self.order = [np.argsort(codes[:, j], kind="stable") for j in range(codes.shape[1])]
        self.starts = [np.searchsorted(codes[o, j], np.arange(257)) for j, o in enumerate(self.order)]

    def within(self, code: np.ndarray, radius: int) -> np.ndarray:
        """Places of all codes within the radius: pigeonhole probes, then the whole code's distance."""
        m = self.codes.shape[1]
        masks = _MASKS[min(8, radius // m)]
        found = np.zeros(len(self.codes), bool)
        for j in range(m):
            o, s = self.order[j], self.starts[j]
            values = code[j] ^ masks
            if len(self.codes) < 256 * len(masks):  # a small shard: one pass over the byte beats many slices
                hit = np.zeros(256, bool)
                hit[values] = True
                found |= hit[self.codes[:, j]]
            else:
                for v in values.tolist():
                    found[o[s[v] : s[v + 1]]] = True
        at = np.flatnonzero(found)
        return at[np.bitwise_count(self.codes[at] ^ code).sum(axis=1) <= radius]


def nearest(model: dict, ids: np.ndarray, x: np.ndarray, q_ids: np.ndarray, q: np.ndarray, k: int):
    """For each query its place, and ids and scores of the nearest k rows that the index finds."""
    unit = _unit(x)
    index, q_unit = Index(encode(model, unit)), _unit(q)
    q_codes = encode(model, q_unit)
    for i in range(len(q_ids)):
        radius = model["radius"]
        while True:
            at = index.within(q_codes[i], radius)
            own = at[ids[at] != q_ids[i]]
            if len(own) >= k or radius >= BITS:
                break
            radius = min(BITS, radius + BITS // 16)
        score = unit[own] @ q_unit[i]
        if len(own) > k:  # ties at the edge stay for the order by id
            edge = np.partition(score, len(score) - k)[len(score) - k]
            own = own[score >= edge - 1e-9]
        score = (unit[own] * q_unit[i]).sum(axis=1)  # the same for equal rows wherever they stand
        best = np.lexsort((ids[own], -score))[:k]
        yield i, ids[own[best]], score[best]


def _tile_task(shared, k: int):
    """One shard against one block of queries."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        out: tuple[list, ...] = ([], [], [], [])
        if rows.num_rows and queries.num_rows:
            keys, q_ids = queries["query"].to_numpy(), queries["query_id"].to_numpy()
            for i, ids, score in nearest(shared.value, rows["vec_id"].to_numpy(), _matrix(rows["embedding"]), q_ids, _matrix(queries["embedding"]), k):
                for c, x in zip(out, (np.full(len(ids), keys[i]), np.full(len(ids), q_ids[i]), ids, score), strict=True):
                    c.append(x)
        kinds = (np.int64, np.int64, np.int64, np.float64)
        return pa.table([pa.array(np.concatenate(c) if c else np.zeros(0, t)) for c, t in zip(out, kinds, strict=True)], names=["query", "query_id", "vec_id", "score"])

    return run


def _codes_task(shared):
    """Rows with their code in words of 64 bits: (at, id, words)."""

    def run(batches):
        model = shared.value
        bits = model["lists"]["bits"]
        for b in batches:
            words = encode(model, _unit(_matrix(b.column(2))))[:, : bits // 8].copy().view(np.int64) if b.num_rows else np.zeros((0, bits // 64), np.int64)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(list(words), pa.list_(pa.int64()))], names=["at", "id", "words"])

    return run


def _values(words, parts: int):
    """(substring, value) of a code: two bytes each."""
    per = 64 // WIDTH
    value = lambda j: F.shiftrightunsigned(F.get(words, F.lit(j // per)), WIDTH * (j % per)).bitwiseAND((1 << WIDTH) - 1)
    return F.array(*[F.struct(F.lit(j).alias("part"), value(j).alias("value")) for j in range(parts)])


def _scores(batches):
    """Exact cosines of (query, query_id, vec_id, wanted, embedding)."""
    for b in batches:
        score = (_unit(_matrix(b.column(4))) * _unit(_matrix(b.column(3)))).sum(axis=1) if b.num_rows else np.zeros(0)
        yield pa.record_batch([*b.columns[:3], pa.array(score, pa.float64())], names=["query", "query_id", "vec_id", "score"])


def by_lists(v: DataFrame, q: DataFrame, model: dict) -> DataFrame:
    """(query, query_id, vec_id, score): all rows within the radius of each query. ``v``: (at, vec_id, embedding), ``q``: (query, vec_id, embedding)."""
    shared = v.sparkSession.sparkContext.broadcast(model)
    how = model["lists"]
    n_words, parts = how["bits"] // 64, how["bits"] // WIDTH
    coded = lambda t, key: t.select(F.col(key).alias("at"), F.col("vec_id").alias("id"), "embedding").mapInArrow(_codes_task(shared), "at long, id long, words array<bigint>")
    listed = coded(v, "at").select("at", "id", "words", F.explode(_values(F.col("words"), parts)).alias("x")).select("at", "id", "words", "x.part", "x.value")
    masks = [m for m in range(1 << WIDTH) if m.bit_count() <= how["off"]]
    asked = coded(q, "query").select(F.col("at").alias("query"), F.col("id").alias("query_id"), F.col("words").alias("wanted"), F.explode(_values(F.col("words"), parts)).alias("x"))
    asked = asked.select("query", "query_id", "wanted", F.col("x.part").alias("part"), F.explode(F.transform(F.array(*map(F.lit, masks)), lambda m: F.col("x.value").bitwiseXOR(m.cast("long")))).alias("value"))
    apart = sum((F.bit_count(F.get("words", F.lit(k)).bitwiseXOR(F.get("wanted", F.lit(k)))) for k in range(n_words)), F.lit(0))
    pairs = listed.join(asked, ["part", "value"]).filter((F.col("id") != F.col("query_id")) & (apart <= how["radius"])).select("query", "at").distinct()
    rows = pairs.join(v, "at").join(q.select("query", F.col("vec_id").alias("query_id"), F.col("embedding").alias("wanted")), "query")
    return rows.select("query", "query_id", "vec_id", "wanted", "embedding").mapInArrow(_scores, "query long, query_id long, vec_id long, score double")


def by_tiles(v: DataFrame, q: DataFrame, k: int, model: dict) -> DataFrame:
    """(query, query_id, vec_id, score): k rows of every shard for each query."""
    spark = v.sparkSession
    shards, blocks = max(n_parts(spark), -(-v.count() // SHARD)), max(1, -(-q.count() // BLOCK))
    numbers = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    # rows are dealt by their place in the written table, so a vector that repeats meets no single task
    rows = v.select("vec_id", "embedding", F.pmod(F.col("at") + F.shiftright("at", 33), F.lit(shards)).cast("int").alias("shard"), numbers(blocks).alias("block"))
    asked = q.select(F.col("vec_id").alias("query_id"), "query", "embedding", F.pmod(F.xxhash64("query"), F.lit(blocks)).cast("int").alias("block"), numbers(shards).alias("shard"))
    shared = spark.sparkContext.broadcast(model)
    return rows.groupBy("shard", "block").cogroup(asked.groupBy("shard", "block")).applyInArrow(_tile_task(shared, k), "query long, query_id long, vec_id long, score double")


def search(vectors: DataFrame, queries: DataFrame, k: int = K, model: dict | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows found for each row of ``queries``."""
    spark = vectors.sparkSession
    v = materialize(usable(vectors).withColumn("at", F.monotonically_increasing_id()), "vectors")
    q = materialize(usable(queries).dropDuplicates(["vec_id", "embedding"]).withColumn("query", F.monotonically_increasing_id()), "queries")
    model = model or fit(v)
    if model is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    best = lambda t: t.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    if not model["lists"] or model["lists"]["share"] > PRUNES:
        return best(by_tiles(v, q, k, model)).select("query_id", "rank", "vec_id", "score")
    found = materialize(best(by_lists(v, q, model)), "found")
    done = found.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= k).select("query")
    few = materialize(q.join(done, "query", "left_anti"), "few")
    rest = best(by_tiles(v, few, k, model)) if not few.isEmpty() else found.limit(0)
    return found.join(done, "query", "left_semi").select("query_id", "rank", "vec_id", "score").unionByName(rest.select("query_id", "rank", "vec_id", "score"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return search(v, v.filter(F.col("vec_id") % EVERY == 0))

