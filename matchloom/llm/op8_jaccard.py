"""Operator 8, n-gram Jaccard join: sets of 4-word shingles, linked from a similarity of 0.85.

Sets are ordered by one global order, rarer shingles first. (Frequencies come from a sketch of all
documents with a fixed number of counters; any total order gives right results, a good one makes
prefix groups small.) Documents with equal sets form one class, and classes are compared:

1. Prefix filter: two classes that link share one of their first n - ceil(0.85 n) + 1 shingles. Length
   and position filters, and the number of shingles that the prefixes share, drop pairs that can't
   reach the overlap before whole sets are read.
2. Stars: within the group of a prefix shingle, classes are compared only with the group's pivot, the
   class that has the shingle earliest (the least changed one), so a large group of near copies costs
   one pair for each member. Linked classes get one label; three rounds.
3. Rest: pairs of one group whose labels still differ are all compared, so that no link between
   components is lost. Pairs inside a component need no look: they can't change it.

Comparison is a prefix-tree join: the sets to be compared with one pivot arrive sorted by the global
order, which is the depth-first order of their trie; a task keeps the overlap at each depth of the
current path, starts each set at the depth it shares with the set before, and prunes what can't reach
the overlap with the length that remains. Hot pivots are dealt to several tasks by a salt.

Classes are told apart by the digest of their set and carry a key of their own, so an id that stands for
two texts joins nothing.

Cases: null or wordless texts have an empty set, link with nothing and are their own component;
repeated rows, and ties of any kind, fall into one class; an id that comes again with another text is
two documents; a component without any id has a null component_id; a text of fewer than four words is
one shingle; very long texts are scanned whole, one to a batch; an empty table gives no rows; other
columns are not read, whatever their names. Shingles are 64-bit hashes.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import free_name, materialize, small_batches, table
from matchloom.llm.textscan import Scan, slices
from matchloom.operators.components import connected_components

K = 4
#: Linked if 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Counters of the frequency sketch (8 bytes each), and bits of the map of wanted ids.
COUNTERS, MARKS = 1 << 18, 1 << 25
STAR_ROUNDS = 3
#: Sets of one pivot that one task compares, and members of one shingle that one task holds against the others.
DEAL, BLOCK = 128, 4096


def shingle_sets(col: pa.Array, k: int = K) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    s = Scan(col, fold=True)
    words = s.word_hashes()
    n = s.n_words()
    first, h = s.windows(k, words)
    ends = np.searchsorted(s.doc[first], np.arange(s.n_docs + 1))
    at = np.concatenate([[0], np.cumsum(n)])
    out = []
    for d in range(s.n_docs):
        if n[d] >= k:
            out.append(np.unique(h[ends[d] : ends[d + 1]]))
        elif n[d]:
            one = np.uint64(int(n[d]) * 0x9E3779B97F4A7C15 & (2**64 - 1))
            for w in words[at[d] : at[d + 1]]:
                one = np.uint64((int(one) * 0xBF58476D1CE4E5B9 + int(w)) & (2**64 - 1))
            out.append(np.array([one]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def _counter(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - COUNTERS.bit_length() + 1)).astype(np.int64)


def _sketch_task(batches):
    counts = np.zeros(COUNTERS, np.int64)
    for whole in batches:
        for b in slices(whole):
            sets = shingle_sets(b.column(0))
            if sets:
                counts += np.bincount(_counter(np.concatenate(sets)), minlength=COUNTERS)
    at = np.flatnonzero(counts)
    for i in range(0, len(at), 50_000):
        yield pa.record_batch([pa.array(at[i : i + 50_000].astype(np.int32)), pa.array(counts[at[i : i + 50_000]])], names=["counter", "n"])


def sketch(docs: DataFrame) -> np.ndarray:
    """Documents for each counter: COUNTERS numbers, whatever the input's size."""
    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_sketch_task, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n"))
    t = rows.toArrow()
    out = np.zeros(COUNTERS, np.int64)
    out[t["counter"].to_numpy()] = t["n"].to_numpy()
    return out


def in_order(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return h[np.lexsort((h, counts[_counter(h)]))]


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(tokens.tobytes(), digest_size=16).digest()
    return tuple(int.from_bytes(d[i : i + 8], "little", signed=True) for i in (0, 8))


def _bit_map(prefix: np.ndarray) -> tuple[int, int]:
    """Which of 128 bits the shingles of a prefix set."""
    word = np.left_shift(np.uint64(1), prefix.view(np.uint64) & np.uint64(63))
    high = (prefix & 64).astype(bool)
    return tuple(int(np.bitwise_or.reduce(word[side], initial=np.uint64(0)).view(np.int64)) for side in (~high, high))


def _prefix_task(shared):
    """A row for each text: set size, digest of the set, its prefix in the global order and the prefix's bit map."""

    def run(batches):
        counts = shared.value
        for whole in batches:
            for b in slices(whole):
                sets = shingle_sets(b.column(1))
                hi, lo = zip(*map(_digest, sets), strict=True)
                part = [in_order(x, counts)[: len(x) - (PERCENT * len(x) + 99) // 100 + 1].astype(np.int64) if len(x) else np.zeros(0, np.int64) for x in sets]
                bits0, bits1 = zip(*map(_bit_map, part), strict=True)
                longs = [pa.array(x, pa.int64()) for x in ([len(x) for x in sets], hi, lo, bits0, bits1)]
                yield pa.record_batch([b.column(0), b.column(2), *longs, pa.array(part, pa.list_(pa.int64()))], names=["doc_id", "text_key", "n", "hi", "lo", "bits0", "bits1", "prefix"])

    return run


def _whole_task(shared, marked):
    """Whole ordered sets of the texts whose id may be wanted (rows without an id always are)."""

    def run(batches):
        counts, bits = shared.value, marked.value
        for whole in batches:
            ids = whole.column(0)
            at = np.mod(ids.fill_null(0).to_numpy(), MARKS)
            wanted = (bits[at >> 5] >> (at & 31).astype(np.uint32) & 1).astype(bool) | ids.is_null().to_numpy(zero_copy_only=False)
            for b in slices(whole.filter(pa.array(wanted))):
                sets = shingle_sets(b.column(1))
                hi, lo = zip(*map(_digest, sets), strict=True)
                tokens = [in_order(x, counts).astype(np.int64) for x in sets]
                yield pa.record_batch([pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(tokens, pa.list_(pa.int64()))], names=["h", "l", "tokens"])

    return run


def _whole_sets(docs: DataFrame, classes: DataFrame, want: DataFrame, counts) -> DataFrame:
    """(key, tokens) of the classes whose keys are ``want``, from the text of one document of each.

    A bit map of MARKS bits, whatever the input's size, drops most other texts before they are cut into
    words; the join drops the rest, so a full map costs time and nothing else."""
    spark = docs.sparkSession
    own = materialize(classes.join(want, "key", "left_semi").select("key", "rep", "hi", "lo"), "wanted")
    bit = f"pmod(rep, {MARKS})"
    words = own.filter("rep is not null").groupBy(F.expr(f"shiftright({bit}, 5) AS word")).agg(F.expr(f"bit_or(shiftleft(1L, cast({bit} & 31 AS int))) AS bits")).toArrow()
    bits = np.zeros(MARKS >> 5, np.uint32)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    small_batches(spark)
    sets = docs.select("doc_id", "text").mapInArrow(_whole_task(counts, spark.sparkContext.broadcast(bits)), "h long, l long, tokens array<long>")
    return sets.join(own, (F.col("h") == F.col("hi")) & (F.col("l") == F.col("lo"))).select("key", "tokens").dropDuplicates(["key"])


def _need(n: Column, m: Column) -> Column:
    """Least overlap of linked sets: o >= PERCENT / (100 + PERCENT) * (n + m)."""
    return F.ceil(PERCENT * (n + m) / F.lit(float(100 + PERCENT)) - 1e-9)


def _possible(n: Column, i: Column, m: Column, j: Column) -> Column:
    """Whether sets of n and m shingles that share their i-th and j-th may link: length and position filters."""
    return (PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)) & (F.least(i, j) + 1 + F.least(n - i - 1, m - j - 1) >= _need(n, m))


def _first_common() -> Column:
    """For pairs (n, pos, bits; n2, pos2, bits2): whether a shared shingle may be the first one of a linked pair.

    Behind the first common shingle each set must still hold the overlap. Bits that one prefix has and the
    other lacks count shingles that the prefixes don't share; see ``_near`` for the bound."""
    n, m = F.col("n"), F.col("n2")
    need = _need(n, m)
    size = lambda x: x - F.ceil(PERCENT * x / F.lit(100.0) - 1e-9) + 1
    lacks = lambda a, b: sum((F.bit_count(F.col(f"bits{i}{a}").bitwiseAND(F.bitwise_not(F.col(f"bits{i}{b}")))) for i in (0, 1)), F.lit(0))
    shared = F.least(size(n) - lacks("", "2"), size(m) - lacks("2", ""))
    alike = PERCENT * F.greatest(n, m) <= 100 * F.least(n, m)
    return alike & (F.col("pos") <= n - need) & (F.col("pos2") <= m - need) & (shared + F.greatest(n - size(n), m - size(m)) >= need)


def trie_links(batches):
    """Rows (pivot, salt, kind, id, tokens), sorted, the pivot's own set first (kind 0): yields linked (pivot, id)."""
    group, pivot, order = None, None, None
    path, cum = np.zeros(0, np.int64), np.zeros(1, np.int64)
    for b in batches:
        left, right = [], []
        cols = [b.column(i).to_pylist() for i in range(4)]
        tokens = b.column(4)
        for r, key in enumerate(zip(cols[0], cols[1], strict=True)):
            t = tokens[r].values.to_numpy(zero_copy_only=False)
            if cols[2][r] == 0:
                group, pivot, order = key, t, np.sort(t)
                path, cum = np.zeros(0, np.int64), np.zeros(1, np.int64)
                continue
            if key != group:
                raise ValueError("a set came without its pivot")
            n, m = len(t), len(pivot)
            need = -(-PERCENT * (n + m) // (100 + PERCENT))
            both = min(len(path), n)
            apart = np.flatnonzero(path[:both] != t[:both])
            depth = min(int(apart[0]) if len(apart) else both, len(cum) - 1)
            have = int(cum[depth])
            if have + min(n - depth, m - have) < need:
                path, cum = t[:depth], cum[: depth + 1]  # the rest of this branch is pruned
                continue
            rest = t[depth:]
            at = np.minimum(np.searchsorted(order, rest), m - 1)
            cum = np.concatenate([cum[: depth + 1], have + np.cumsum(order[at] == rest)])
            path = t
            if 100 * int(cum[-1]) >= PERCENT * (n + m - int(cum[-1])):
                left.append(cols[0][r])
                right.append(cols[3][r])
        yield pa.record_batch([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])


def _verify(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """Pairs (a pivot, b) that link."""
    sizes = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("pairs"))
    hot = sizes.filter(F.col("pairs") > DEAL).select(F.col("a").alias("_hot"), F.ceil(F.col("pairs") / DEAL).alias("_deals"))
    p = pairs.join(hot, F.col("a") == F.col("_hot"), "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("_deals")), F.lit(0)))
    rows = p.select("a", "salt", "b").join(full, F.col("b") == F.col("key")).select("a", "salt", F.lit(1).alias("kind"), F.col("b").alias("id"), "tokens")
    own = p.select("a", "salt").distinct().join(full, F.col("a") == F.col("key")).select("a", "salt", F.lit(0).alias("kind"), F.col("a").alias("id"), "tokens")
    small_batches(pairs.sparkSession, 256)
    dealt = rows.unionByName(own).repartition("a", "salt").sortWithinPartitions("a", "salt", "kind", "tokens")
    return dealt.mapInArrow(trie_links, "a long, b long")


def _near(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose prefixes share enough: of the set whose prefix ends first in the global order, what the
    prefixes don't share can only lie behind its prefix, so the overlap is at most shared + n - prefix."""
    own = lambda x: classes.select(F.col("key").alias(x), F.col("n").alias(f"n{x}"), F.col("prefix").alias(f"p{x}"))
    t = pairs.join(own("a"), "a").join(own("b"), "b")
    most = F.size(F.array_intersect("pa", "pb")) + F.greatest(F.col("na") - F.size("pa"), F.col("nb") - F.size("pb"))
    return t.filter(most >= _need(F.col("na"), F.col("nb"))).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("label", F.col("key"))
    label = connected_components(links, "a", "b")
    return members.join(label, members["key"] == label["node"], "left").withColumn("label", F.coalesce("component", "key")).drop("node", "component")


def _dealt_pairs(rest: DataFrame) -> DataFrame:
    """Pairs (a, b) of one shingle's members with different labels that may link.

    A shingle of many members is dealt to blocks of BLOCK: a member stands in one block and is held against every block."""
    blocks = rest.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    dealt = rest.join(blocks, "token")
    left = dealt.withColumn("salt", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("blocks")
    right = dealt.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("token", "salt", *[F.col(c).alias(f"{c}2") for c in ("key", "n", "pos", "label", "bits0", "bits1")])
    return left.join(right, ["token", "salt"]).filter("label < label2").filter(_first_common()).select(F.col("key").alias("a"), F.col("key2").alias("b"))


def _links(docs: DataFrame, classes: DataFrame, counts) -> DataFrame:
    """Links (a, b) between classes, enough to connect every component."""
    prefix = classes.select("key", "n", "bits0", "bits1", F.posexplode("prefix").alias("pos", "token"))
    shared = prefix.groupBy("token").agg(F.count(F.lit(1)).alias("members")).filter("members > 1").select("token")
    members = materialize(prefix.join(shared, "token"), "members")
    links = tested = whole = None
    for turn in range(STAR_ROUNDS + 1):
        m = _labelled(members, links)
        ends = m.groupBy("token").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.min(F.struct("pos", F.xxhash64("key", F.lit(turn)).alias("h"), "key", "n", "label")).alias("p")).filter("low < high").select("token", "p")
        mixed = m.join(ends, "token")
        if turn:  # a group that has become one component stays one
            mixed = materialize(mixed, "mixed")
            members = mixed.drop("label", "p")
            if mixed.isEmpty():
                break
        if turn < STAR_ROUNDS:
            pairs = mixed.filter(F.col("label") != F.col("p.label")).filter(_possible(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.pos"))).select(F.col("p.key").alias("a"), F.col("key").alias("b"))
        else:
            pairs = _dealt_pairs(mixed.drop("p"))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested.unionAll(tested.select("b", "a")).toDF("x", "y"), (F.col("a") == F.col("x")) & (F.col("b") == F.col("y")), "left_anti")
        pairs = materialize(pairs, "pairs")
        tested = pairs if tested is None else tested.unionAll(pairs)
        near = materialize(_near(pairs, classes), "near")
        if near.isEmpty():
            continue
        want = near.select(F.explode(F.array("a", "b")).alias("key")).distinct()
        if whole is not None:
            want = want.join(whole, "key", "left_anti")
        new = materialize(_whole_sets(docs, classes, want, counts), "whole")
        whole = new if whole is None else whole.unionAll(new)
        found = materialize(_verify(near, whole), "links")
        links = found if links is None else links.unionAll(found)
    return links if links is not None else members.selectExpr("key AS a", "key AS b").limit(0)


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, group, component_id): one row for each row of ``docs``.

    ``text_key`` is the text's md5; ``group`` names the component even where ids repeat or lack, and is null for empty sets."""
    spark = docs.sparkSession
    counts = spark.sparkContext.broadcast(sketch(docs))
    small_batches(spark)
    schema = "doc_id long, text_key string, n long, hi long, lo long, bits0 long, bits1 long, prefix array<long>"
    sets = materialize(docs.select("doc_id", "text", F.md5("text").alias("text_key")).mapInArrow(_prefix_task(counts), schema), "sets")
    one = sets.filter("n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), *[F.first(c).alias(c) for c in ("n", "bits0", "bits1", "prefix")])
    classes = materialize(one.withColumn("key", F.monotonically_increasing_id()), "classes")
    label = connected_components(_links(docs, classes, counts), "a", "b")
    own = classes.select("hi", "lo", "rep", "key").join(label, F.col("key") == F.col("node"), "left").select(F.col("hi").alias("h"), F.col("lo").alias("l"), "rep", F.coalesce("component", "key").alias("group"))
    own = materialize(own, "groups")
    least = own.groupBy("group").agg(F.min("rep").alias("component_id"))
    own = own.join(least, "group").drop("rep")
    out = sets.join(own, (F.col("hi") == F.col("h")) & (F.col("lo") == F.col("l")) & (F.col("n") > 0), "left")
    return out.select("doc_id", "text_key", "n", "group", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def join(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row for each row of ``docs``."""
    return groups(docs).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def keep_one(docs: DataFrame) -> DataFrame:
    """The row with the smallest id of each component; rows without an id and rows with an empty set all stay."""
    found = materialize(groups(docs).filter("doc_id is not null and group is not null").groupBy("group", "doc_id", "text_key").agg(F.count(F.lit(1)).alias("rows")), "found")
    names = [free_name(docs, f"_{x}") for x in ("id", "key", "rows")]
    wins = found.groupBy("group").agg(F.min(F.struct("doc_id", "text_key", "rows")).alias("s")).select("s.*").toDF(*names)
    wins = materialize(wins, "wins")
    same = (F.col(names[0]) == docs["doc_id"]) & (F.col(names[1]) == F.md5(docs["text"]))
    kept = docs.join(wins.filter(F.col(names[2]) == 1), same, "left_semi")
    # a row that repeats both id and text is kept once; only such rows move again
    again = docs.join(wins.filter(F.col(names[2]) > 1), same, "left_semi").dropDuplicates(["doc_id", "text"])
    bare = docs.filter("doc_id is null").unionAll(docs.filter(F.col("doc_id").isNotNull() & ~F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")))
    return kept.unionByName(again).unionByName(bare)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(table(spark, sf_dir, "documents"))
