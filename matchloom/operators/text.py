"""Cleaning of noisy text logs."""

from __future__ import annotations

import math
from collections import Counter, deque
from collections.abc import Iterator
from difflib import SequenceMatcher

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def correct(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """Known errors (wrong, right) replaced; the dictionary is a maintained list, broadcast under Spark's size limit."""
    t = tokens.join(known, tokens["token"] == known["wrong"], "left")
    return t.withColumn("fixed", F.coalesce("right", "token")).drop("wrong", "right")


def fuzzy(tokens: DataFrame, names: DataFrame, least: float = 0.7, k: int = 5) -> DataFrame:
    """Each token's ``k`` best catalog names: similarity by edit distance, for a part of a name or of a token their
    lengths' ratio where that is more; ties by name.

    Only names that share a bigram with the token are compared. An edit breaks two bigrams at most, so without a common
    one texts of L characters are at most 0.5 + 1 / (2 L) similar: with ``least`` at 0.7, none of three characters or more
    is lost. A bigram that many names have costs a row for each; the catalog is a maintained list."""
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - 1, F.lit(1))), lambda i: F.substring(c, i, 2)))
    a = tokens.select("token").distinct().select("token", F.explode(grams(F.col("token"))).alias("g"))
    b = names.select("name").distinct().select("name", F.explode(grams(F.col("name"))).alias("g"))
    # lengths alone bound the similarity
    most = F.least(F.length("token"), F.length("name")) / F.greatest(F.length("token"), F.length("name"))
    pairs = a.join(b, "g").filter(most >= least).select("token", "name").distinct()
    sim = 1 - F.levenshtein("token", "name") / F.greatest(F.length("token"), F.length("name"))
    part = F.col("name").contains(F.col("token")) | F.col("token").contains(F.col("name"))
    score = F.round(F.greatest(sim, F.when(part, most).otherwise(0.0)), 6)
    t = pairs.withColumn("score", score).filter(F.col("score") >= least)
    w = Window.partitionBy("token").orderBy(F.desc("score"), "name")
    return t.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("token", "name", "score", "rank")


def is_noise(text: Column, score: Column, least: float = 0.3, letters: int = 2) -> Column:
    """Low confidence and few letters."""
    return (score < least) | (F.char_length(F.regexp_replace(text, r"[^\p{L}]", "")) < letters)


def normalized(text: Column) -> Column:
    """Full-width signs folded, white space and brackets dropped, A-Z lower-cased."""
    folded = F.translate(text, "（）【】，。：；！？ABCDEFGHIJKLMNOPQRSTUVWXYZ", "()[],.:;!?abcdefghijklmnopqrstuvwxyz")
    return F.regexp_replace(folded, r"[\s()\[\]]+", "")


def near_lines(lines: DataFrame, window: int = 45) -> DataFrame:
    """Lines that equal, after normalisation, one of the ``window`` lines before them in their log.

    An equal line is its nearest predecessor with the same text: one window by (log, text), no pairs."""
    t = lines.withColumn("norm", normalized(F.col("text")))
    back = F.col("pos") - F.lag("pos").over(Window.partitionBy("log", "norm").orderBy("pos"))
    return t.withColumn("repeat", F.coalesce(back <= window, F.lit(False)))


#: Lines of a log's opening, whose sides are trusted (fixed value).
OPENING = 40


def side_votes(lines: DataFrame, share: float = 0.65) -> DataFrame:
    """(log, name, vote): each name's side in a log by majority; without a clear one, the side of the opening lines
    if they name one only; else null."""
    n = lines.filter("side IS NOT NULL").groupBy("log", "name", "side").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("pos") <= OPENING).alias("early"))
    first = F.when(F.count_if(F.col("early") > 0) == 1, F.max(F.when(F.col("early") > 0, F.col("side"))))
    t = n.groupBy("log", "name").agg(F.sum("n").alias("total"), F.max(F.struct("n", (-F.col("side")).alias("s"))).alias("m"), first.alias("anchor"))
    return t.select("log", "name", F.when(F.col("m.n") >= share * F.col("total"), -F.col("m.s")).otherwise(F.col("anchor")).alias("vote"))


def backfill_sides(lines: DataFrame) -> DataFrame:
    """Lines with ``fixed``, their side after the vote, and ``change``: filled, corrected or kept."""
    v = side_votes(lines)
    t = lines.join(v.select(F.col("log").alias("_log"), F.col("name").alias("_name"), "vote"), (F.col("log") == F.col("_log")) & F.col("name").eqNullSafe(F.col("_name")), "left").drop("_log", "_name")
    change = F.when(F.col("vote").isNotNull() & F.col("side").isNull(), "filled").when(F.col("vote") != F.col("side"), "corrected").otherwise("kept")
    return t.withColumn("fixed", F.coalesce("vote", "side")).withColumn("change", change)


def cut_after(lines: DataFrame, ends: Column) -> DataFrame:
    """Lines up to the first one that ends the log."""
    last = lines.filter(ends).groupBy("log").agg(F.min("pos").alias("last"))
    return lines.join(last, "log", "left").filter(F.col("last").isNull() | (F.col("pos") <= F.col("last"))).drop("last")


class _Recent:
    """The last kept lines of a log, by length: only lines whose lengths allow the wanted ratio are ever compared.

    A ratio of r needs 2 * min(lengths) >= r * (sum of lengths), so a line of n characters meets lines of n * r / (2 - r) to
    n * (2 - r) / r characters; a count of common characters then bounds the ratio from above."""

    def __init__(self, size: int, ratio: float):
        self.size, self.ratio, self.order = size, ratio, deque()
        self.by_length: dict[int, Counter] = {}

    def has_like(self, line: str) -> bool:
        n, r = len(line), self.ratio
        low, high = math.ceil(n * r / (2 - r) - 1e-9), math.floor(n * (2 - r) / r + 1e-9)
        near = [self.by_length[k] for k in range(low, high + 1) if k in self.by_length]
        if any(line in c for c in near):
            return True
        own = Counter(line)
        for old in (t for c in near for t in c):
            if 2 * (own & Counter(old)).total() >= r * (n + len(old)) and SequenceMatcher(None, line, old).ratio() >= r:
                return True
        return False

    def add(self, line: str) -> None:
        self.order.append(line)
        self.by_length.setdefault(len(line), Counter())[line] += 1
        if len(self.order) > self.size:
            gone = self.order.popleft()
            c = self.by_length[len(gone)]
            c[gone] -= 1
            if not c[gone]:
                del c[gone]
            if not c:
                del self.by_length[len(gone)]


def _kept(window: int, similar: float):
    def scan(parts: Iterator) -> Iterator:
        log, recent = None, _Recent(window, similar)
        for part in parts:
            kept = []
            for own, line in zip(part["log"], part["norm"], strict=True):
                if own != log:
                    log, recent = own, _Recent(window, similar)
                kept.append(bool(line) and not recent.has_like(line))
                if kept[-1]:
                    recent.add(line)
            yield part[["log", "pos"]].assign(kept=kept)

    return scan


def stitch(lines: DataFrame, window: int = 45, similar: float = 0.86) -> DataFrame:
    """T05, greedy form: a line is dropped if it is empty or as similar as ``similar`` to one of the last ``window`` kept lines.

    What is kept depends on what was kept before, so a log's lines come to one task in order; the task holds the window
    only, whatever a log's length."""
    t = lines.withColumn("norm", normalized(F.coalesce("text", F.lit("")))).select("log", "pos", "norm")
    return t.repartition("log").sortWithinPartitions("log", "pos").mapInPandas(_kept(window, similar), "log long, pos int, kept boolean")
