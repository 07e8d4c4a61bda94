"""Round 4: near matchups meet by hashes of what they share, not with their whole lists."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from matchloom.operators.near import matchup_replacements
from matchloom.session import shared_dir


def replaced(x, y):
    lack = lambda p, q: Counter(k.split(":")[0] for k in p - q)
    gone, new = lack(x, y), lack(y, x)
    return sum(max(gone[h], new[h]) for h in set(gone) | set(new))


def test_near_matchups_equal_brute_force(spark):
    """Thirteen rows of a matchup, each with all of its items, were shuffled on both sides of a join."""
    r = random.Random(4)
    rows, matches = [], {}
    for i in range(160):
        sides = []
        for side, heroes in ((1, "xyz"), (2, "xyz" if i % 3 else "xyw")):
            team = {h: (f"k{r.randrange(2)}", f"k{r.randrange(2)}" if r.random() < 0.8 else None) for h in heroes}
            rows += [(i, side, h, a, b) for h, (a, b) in team.items()]
            sides.append((",".join(sorted(heroes)), sorted({f"{h}:{k}" if k else h for h, ks in team.items() for k in ks})))
        matches[i] = sorted(sides)
    t = spark.createDataFrame(rows, "id long, side int, hero string, s1 string, s2 string")
    got = [(x["a"], x["b"], x["replaced"]) for x in matchup_replacements(t).collect()]
    marked = lambda a, b: {f"0|{k}" for k in a} | {f"1|{k}" for k in b}
    first, want = {}, set()
    for i, (a, b) in sorted(matches.items()):
        state = (a[0], b[0], tuple(a[1]), tuple(b[1]))
        if state in first:
            want.add((first[state], i, 0))
        else:
            first[state] = i
    ids = sorted(first.values())
    for i in ids:
        for j in ids:
            (a, b), (c, d) = matches[i], matches[j]
            if i < j and (a[0], b[0]) == (c[0], d[0]):
                n = replaced(marked(a[1], b[1]), marked(c[1], d[1]))
                if a[0] == b[0]:
                    n = min(n, replaced(marked(b[1], a[1]), marked(c[1], d[1])))
                if n <= 1:
                    want.add((i, j, n))
    assert len(got) == len(set(got)) and set(got) == want and {n for *_, n in got} == {0, 1}


def test_rows_alone_in_a_bucket_meet_nothing(spark):
    """Only what shares a bucket is written for the join, without the other heroes' items."""
    skills = lambda i: [(h, f"k{i}{h}", f"m{i}{h}") for h in "abc"]
    rows = [(i, s, *x) for i in range(20) for s in (1, 2) for x in skills(i if i < 19 else 18)]
    rows[-1] = (19, 2, "c", "k18c", "other")
    t = spark.createDataFrame(rows, "id long, side int, hero string, s1 string, s2 string").withColumn("hero", F.concat("hero", F.col("side").cast("string")))
    store = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/met-*")
    files = lambda: {str(f.getPath()) for f in store.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(store)}
    before = files()
    assert [tuple(x) for x in matchup_replacements(t).collect()] == [(18, 19, 1)]
    (new,) = files() - before
    met = spark.read.parquet(new)
    assert met.count() == 2 and met.agg(F.max(F.size("left"))).first()[0] <= 6
