"""Operators on small tables made by hand."""

from __future__ import annotations

import math
import uuid

import pytest
from pyspark.sql import functions as F

from matchloom.operators import features as E
from matchloom.operators import groups as G
from matchloom.operators import ingest as S
from matchloom.operators import models as M
from matchloom.operators import text as X
from matchloom.operators.components import connected_components
from matchloom.session import shared_dir
from matchloom.sources.sinks import current, publish
from matchloom.streaming import folds as Z


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert {got[i] for i in range(41)} == {0}
    assert {got[100 + i] for i in range(20)} == {100}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_paired_difference_is_antisymmetric(spark):
    rows = [(1, 1, 1, "H", "a"), (1, 1, 1, "H", "b"), (1, 2, 0, "H", "b"), (1, 2, 0, "H", "c")]
    t = spark.createDataFrame(rows, "match_id long, side int, won int, family string, key string")
    swap = t.withColumn("side", 3 - F.col("side"))
    one = {r["key"]: r["diff"] for r in E.paired_difference(t).collect()}
    two = {r["key"]: r["diff"] for r in E.paired_difference(swap).collect()}
    assert one == {"a": 1, "c": -1} and two == {k: -x for k, x in one.items()}


def test_capture_times(spark):
    names = ["2025-08-31-160345.json", "img_1756656225000.png", "Shot 2025-08-31 at 4.03.45 PM.png", "none.png", None]
    t = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, name string").select("i", F.date_format(S.capture_time(F.col("name")), "yyyy-MM-dd HH:mm:ss").alias("t"))
    got = {r["i"]: r["t"] for r in t.collect()}
    assert got[0] == got[2] == got[1] == "2025-08-31 16:03:45"
    assert got[3] is None and got[4] is None


def test_reading_matches_keeps_reasons(spark):
    place = f"{shared_dir(spark)}/matches-{uuid.uuid4().hex}"
    team = '[{"name":"a","skills":["x","y","z"]},{"name":"b","skills":[]},{"name":"c","skills":[]}]'
    rows = [f'{{"1":{team},"2":{team},"winner":"1","season":3}}', f'{{"1":{team},"2":[],"winner":"2"}}', "{broken", f'{{"1":{team},"2":{team},"winner":"3"}}']
    for r in rows:  # a file for each document
        spark.createDataFrame([(r,)], "value string").coalesce(1).write.mode("append").text(place)
    t = S.read_matches(spark, place, "own")
    assert sorted(str(r["reason"]) for r in t.collect()) == ["None", "not_json", "team_size", "winner"]


def test_holdout_keeps_one_group_in(spark):
    g = spark.createDataFrame([(i,) for i in range(2)], "g int")
    assert sorted(r["held"] for r in G.holdout(g, "g", 0.9, "s").collect()) == [False, True]
    assert [r["held"] for r in G.holdout(g.limit(1), "g", 0.5, "s").collect()] == [False]


def test_fit_finds_a_planted_signal(spark):
    rows, labels = [], []
    for i in range(200):
        strong = i % 2 + 1
        rows += [(i, strong, 1, "H", "strong"), (i, 3 - strong, 0, "H", "weak")]
        labels.append((i, 1 if strong == 1 else 0))
    t = spark.createDataFrame(rows, "match_id long, side int, won int, family string, key string")
    y = spark.createDataFrame(labels, "match_id long, label int")
    w = {r["key"]: r["weight"] for r in M.fit_weights(t, E.support(t), y).collect()}
    assert w["strong"] > 0.5 and math.isclose(w["strong"], -w["weak"], abs_tol=1e-6)
    same = y.withColumn("label", F.lit(1))
    assert {r["weight"] for r in M.fit_weights(t, E.support(t), same).collect()} == {0.0}


def test_shares_add_up(spark):
    p = spark.createDataFrame([(1, 0, 1 / 3), (1, 1, 1 / 3), (1, 2, 1 / 3)], "e int, o int, p double")
    assert [r["units"] for r in M.quantize(p, "e", "o", "p").orderBy("o").collect()] == [334, 333, 333]


def test_split_batches_fold_to_the_same_totals(spark):
    t = spark.range(100).withColumn("k", F.col("id") % 3)
    one, many = (Z.Fold(spark, ["k"], {"n": F.lit(1), "s": F.col("id")}) for _ in range(2))
    one.apply(t, 0)
    for i in range(4):
        many.apply(t.filter(F.col("id") % 4 == i), i)
    many.apply(t, 3)
    assert sorted(map(tuple, one.state().collect())) == sorted(map(tuple, many.state().collect()))


def test_publish_leaves_the_old_version_on_failure(spark):
    root = f"{shared_dir(spark)}/published-{uuid.uuid4().hex}"
    first = publish(spark.range(3), root)
    with pytest.raises(ValueError):
        publish(spark.range(5), root, check=lambda _: False)
    assert current(spark, root) == first and spark.read.parquet(first).count() == 3


def test_stitch_drops_near_lines(spark):
    t = spark.createDataFrame([(1, 1, "Attack on the gate"), (1, 2, "Attack on the gats"), (1, 3, "Retreat now"), (1, 4, None)], "log long, pos int, text string")
    assert [r["kept"] for r in X.stitch(t).orderBy("pos").collect()] == [True, False, True, False]


def test_stitch_equals_a_plain_scan(spark):
    """Noisy repeats of lines of many lengths, in two logs, against comparing each line with all kept ones of the window."""
    import random
    from difflib import SequenceMatcher

    r, rows, want = random.Random(1), [], []
    base = ["".join(r.choice("abcdefg") for _ in range(r.choice([1, 2, 5, 9, 14, 30]))) for _ in range(60)]
    for log in (1, 2):
        kept = []
        for pos in range(300):
            line = list(r.choice(base))
            for _ in range(r.choice([0, 0, 1, 2])):
                line.insert(r.randrange(len(line) + 1), r.choice("abxyz"))
            line = "".join(line)
            rows.append((log, pos, line))
            new = all(SequenceMatcher(None, line, k).ratio() < 0.86 for k in kept[-7:])
            if new:
                kept.append(line)
            want.append((log, pos, new))
    t = spark.createDataFrame(rows, "log long, pos int, text string").repartition(3)
    assert sorted(map(tuple, X.stitch(t, window=7).collect())) == want
    assert {k for _, _, k in want} == {True, False}


def test_registers_fold_by_maximum(spark):
    """Batches that overlap give one batch's registers; the estimate by hand, also beyond linear counting and capped."""
    import hashlib

    from matchloom.operators import aggregate as A

    def by_hand(keys, events):
        reg = {}
        for k in keys:
            x = int.from_bytes(hashlib.sha256(str(k).encode()).digest()[:8], "big")
            reg[x >> 54] = max(reg.get(x >> 54, 0), 55 - (x & (1 << 54) - 1).bit_length())
        e = 0.7213 / (1 + 1.079 / 1024) * 1024**2 / (sum(2.0**-v for v in reg.values()) + 1024 - len(reg))
        if e <= 2560 and len(reg) < 1024:
            e = 1024 * math.log(1024 / (1024 - len(reg)))
        return reg, min(round(e), events)

    for n, events in ((0, 0), (1, 1), (500, 10**6), (20_000, 10**6), (20_000, 7)):
        t = spark.range(n).select(F.col("id").cast("string").alias("k"))
        f = Z.Fold(spark, ["register"], {"rank": F.col("rank")}, how=F.max)
        register, rank = A.hll_rank("k")
        rows = t.select(register.alias("register"), rank.cast("long").alias("rank"), "k")
        for i, part in enumerate((rows.filter("k < '5'"), rows.filter("k >= '3'"), rows.filter("k > '7'"))):
            f.apply(part, i)
        reg, want = by_hand(range(n), events)
        assert {r["register"]: r["rank"] for r in f.state().collect()} == reg
        assert A.hll_estimate(f.state(), spark.range(1).select(F.lit(events).cast("long").alias("n"))).first()["estimate"] == want


def test_online_step_survives_large_scores(spark):
    state = spark.createDataFrame([("a", -5000.0, 1.0), ("b", 5000.0, 1.0)], "key string, z double, n double")
    rows = spark.createDataFrame([(1, 0, "a", 9.0), (1, 1, "b", 9.0), (1, 2, "a", 8.0)], "event_id long, option int, key string, value double")
    now, p = Z.ftrl_step(state, rows, spark.createDataFrame([(1, 1)], "event_id long, chosen int"))
    assert sum(r["p"] for r in p.collect()) == pytest.approx(1.0) and all(math.isfinite(r["z"]) for r in now.collect())


def test_a_stopped_stream_goes_on(spark):
    root = f"{shared_dir(spark)}/stopped-{uuid.uuid4().hex}"
    rows = spark.range(200).withColumn("k", F.col("id") % 3)
    fold = lambda: Z.Fold(spark, ["k"], {"n": F.lit(1), "s": F.col("id")}, f"{root}/fold")

    def breaks(batch, number):
        if number == 2:
            raise OSError("lost")
        fold().apply(batch, number)

    Z.landing(rows.filter("id < 120"), "id", 4, f"{root}/in")
    with pytest.raises(Exception, match="lost"):
        Z.drain(Z.read(spark, f"{root}/in"), breaks, checkpoint=f"{root}/progress")
    assert fold().versions.last() == 1
    Z.landing(rows.filter("id >= 120"), "id", 2, f"{root}/in")
    for _ in range(2):
        Z.drain(Z.read(spark, f"{root}/in"), fold().apply, checkpoint=f"{root}/progress")
    want = rows.groupBy("k").agg(F.count("*").alias("n"), F.sum("id").alias("s"))
    assert sorted(map(tuple, fold().state().collect())) == sorted(map(tuple, want.collect()))
    assert len(fold().versions._numbers()) == 2


def test_choice_fit_equals_plain_steps(spark):
    import random

    r = random.Random(3)
    feats, chosen = {}, {}
    for e in range(40):
        chosen[e] = r.randrange(3)
        for o in range(3):
            for k in r.sample("abcdef", 3):
                feats[e, o, k] = round(r.uniform(-1, 1), 3)
    w = dict.fromkeys("abcdef", 0.0)
    for step in range(60):
        g = dict.fromkeys(w, 0.0)
        for e, c in chosen.items():
            u = [math.exp(sum(w[k] * x for (i, j, k), x in feats.items() if (i, j) == (e, o))) for o in range(3)]
            for (i, o, k), x in feats.items():
                if i == e:
                    g[k] += ((o == c) - u[o] / sum(u)) * x
        for k in w:
            w[k] += 0.25 / math.sqrt(1 + step / 100) * (g[k] / len(chosen) - 0.05 * w[k])
    t = spark.createDataFrame([(*k, x) for k, x in feats.items()], "event_id long, option int, key string, value double")
    y = spark.createDataFrame(list(chosen.items()), "event_id long, chosen int")
    got = M.choice_fit(t, y, 60)
    assert {x["key"]: x["weight"] for x in got.collect()} == pytest.approx(w, abs=1e-9)
    p = {x["event_id"]: x["p"] for x in M.choice_scores(t, y, got).collect()}
    assert len(p) == 40 and all(0 < x < 1 for x in p.values())


def test_mirror_matchups_take_the_better_pairing(spark):
    from matchloom.operators.near import matchup_replacements

    def match(i, one, two):
        return [(i, s, h, *k) for s, team in ((1, one), (2, two)) for h, k in team.items()]

    a, b = {"x": ("1", "2"), "y": ("3", "4"), "z": ("5", "6")}, {"x": ("7", "8"), "y": ("9", "10"), "z": ("11", "12")}
    near, far, other = a | {"x": ("1", "99")}, a | {"x": ("1", "99"), "y": ("3", "98")}, {"q": ("1", "2"), "y": ("3", "4"), "z": ("5", "6")}
    rows = match(1, a, b) + match(2, b, a) + match(3, b, near) + match(4, far, b) + match(5, other, b) + match(6, b, other) + match(7, a, a)
    t = spark.createDataFrame(rows, "id long, side int, hero string, s1 string, s2 string")
    got = {(r["a"], r["b"]): r["replaced"] for r in matchup_replacements(t).collect()}
    assert got == {(1, 2): 0, (1, 3): 1, (3, 4): 1, (5, 6): 0}


def test_groups_of_sessions_and_near_matches(spark):
    rows = [(1, "own", 1, "2024-01-01 23:50:00"), (2, "own", 2, "2024-01-02 00:15:00"), (3, "own", 1, "2024-01-02 01:00:00"), (4, "others", 1, "2024-01-01 10:00:00"), (5, "others", 1, "2024-01-01 10:30:00"), (6, "others", 2, "2024-01-01 10:31:00"), (7, "external", 1, "2024-01-01 10:00:00"), (8, "external", 1, "2024-01-01 10:00:00")]
    t = spark.createDataFrame(rows, "id long, source string, uploader int, at string").withColumn("captured_at", F.to_timestamp("at"))
    assert {r["id"]: r["first"] for r in G.session_links(t).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 8}
    near = spark.createDataFrame([(2, 7)], "a long, b long")
    assert {r["id"]: r["component"] for r in G.evaluation_groups(t, near).collect()} == {1: 1, 2: 1, 7: 1, 3: 3, 4: 4, 5: 4, 6: 6, 8: 8}
    ids = lambda d: {r["group_id"] for r in G.group_ids(spark.createDataFrame(d, "g int, m int"), "g", "m").collect()}
    assert ids([(1, 5), (1, 6), (2, 7)]) == ids([(9, 7), (3, 6), (3, 5)]) and ids([(1, 5)]) != ids([(1, 6)])


def test_a_planted_leak_is_found(spark):
    rosters = spark.createDataFrame([(1, "r"), (2, "r"), (3, "s")], "match_id long, roster string")
    matches = rosters.select("match_id")
    split = {r["match_id"]: r["split"] for r in G.locked_split(matches, rosters, matches.filter("match_id = 1")).collect()}
    assert split == {1: "test", 2: "excluded", 3: "train"}


def test_few_groups_have_no_interval(spark):
    rows = [(s, g, i % 2, 0.6) for s, n in (("few", 4), ("some", 10), ("many", 25)) for g in range(n) for i in range(3)]
    t = spark.createDataFrame(rows, "s string, g int, label int, p double")
    got = {r["s"]: r for r in M.bootstrap(M.loss_sums(t, "s", "g"), "s", "g", ("accuracy", "log_loss", "brier"), 50).collect()}
    assert {k: r["status"] for k, r in got.items()} == {"few": "omitted_too_few_groups", "some": "exploratory_few_groups", "many": "available"}
    assert got["few"]["accuracy_low"] is None and got["many"]["accuracy_low"] <= got["many"]["accuracy"] <= got["many"]["accuracy_high"]


def test_groups_that_share_rosters_equal_union_find(spark):
    import random

    r = random.Random(4)
    pairs = [(m, f"r{r.randrange(60)}") for m in range(80) for _ in range(2)] + [(100 + i, "hot") for i in range(30)] + [(7, "hot")]
    root = {m: m for m, _ in pairs}

    def find(m):
        while root[m] != m:
            m = root[m]
        return m

    first: dict = {}
    for m, x in pairs:
        a, b = find(m), find(first.setdefault(x, m))
        root[max(a, b)] = min(a, b)
    rosters = spark.createDataFrame(pairs, "match_id long, roster string")
    got = {x["match_id"]: x["component"] for x in G.roster_groups(rosters.select("match_id").distinct(), rosters).collect()}
    assert got == {m: min(k for k in root if find(k) == find(m)) for m in root}


def test_online_model_equals_plain_updates(spark):
    import random

    r, z, n, scores = random.Random(6), {}, {}, {}
    model = Z.Online(spark)
    for batch in range(3):
        rows, g, p = [], {}, {}
        for e in range(10 * batch, 10 * batch + 10):
            c = r.randrange(3)
            feats = [{k: round(r.uniform(-1, 1), 3) for k in r.sample("abcd", 2)} for _ in range(3)]
            rows += [(e, o, k, x, c) for o in range(3) for k, x in feats[o].items()]
            w = {k: 0.0 if abs(z.get(k, 0.0)) <= 0.1 else -(z[k] - math.copysign(0.1, z[k])) / ((1 + math.sqrt(n[k])) / 0.1 + 1) for k in "abcd"}
            u = [math.exp(sum(w[k] * x for k, x in f.items())) for f in feats]
            for o in range(3):
                p[e, o] = u[o] / sum(u)
                for k, x in feats[o].items():
                    g[k] = g.get(k, 0.0) + (p[e, o] - (o == c)) * x
        for k, x in g.items():
            old = n.get(k, 0.0)
            n[k] = old + x * x
            z[k] = z.get(k, 0.0) + x - (math.sqrt(n[k]) - math.sqrt(old)) / 0.1 * w[k]
        scores |= p
        t = spark.createDataFrame(rows, "event_id long, option int, key string, value double, chosen int")
        for _ in range(2):  # a batch that comes again adds nothing
            Z.Online(spark, model.root).apply(t, batch)
    assert {x["key"]: (x["z"], x["n"]) for x in model.versions.read().collect()} == {k: (pytest.approx(z[k]), pytest.approx(n[k])) for k in z}
    assert {(x["event_id"], x["option"]): x["p"] for x in model.scores().collect()} == {k: pytest.approx(x) for k, x in scores.items()}


def test_places_in_an_order_of_all_rows(spark):
    from matchloom.operators.windows import numbered

    t = spark.range(500).withColumn("k", F.col("id") * 7919 % 500)
    assert [x["n"] for x in numbered(t, "n", F.desc("k")).orderBy(F.desc("k")).collect()] == list(range(1, 501))


def test_starts_are_carried_over_ranges(spark):
    """One key holds nearly all rows and seldom starts, so its starts pass through many ranges."""
    rows = [("own", i, 0, i if i in (0, 170, 171, 390) else None) for i in range(400)] + [("x", 5, 1, 7), ("x", 6, 0, None), ("y", 1, 0, 9)]
    t = spark.createDataFrame(rows, "part string, day int, visit int, start int").repartition(3)
    got = {(r["part"], r["day"]): r["start"] for r in G.last_start(t, "part", ("day", "visit"), "start").collect()}
    assert len(got) == len(rows)
    assert all(got["own", i] == (0 if i < 170 else 170 if i < 171 else 171 if i < 390 else 390) for i in range(400))
    assert got["x", 5] == got["x", 6] == 7 and got["y", 1] == 9


def test_best_pairs_equal_all_pairs():
    import random
    from itertools import combinations

    import numpy as np

    from matchloom.operators import scoring as R

    r = random.Random(6)
    for n in (0, 2, 3, 5, 6, 9, 15):
        single = np.array([round(r.choice([0.1, 0.2, r.random()]), 6) for _ in range(n)])
        pair = np.array([round(r.choice([0.0, 0.0, r.random()]), 6) for _ in range(n * (n - 1) // 2)])
        strength, places, masks = R._trio_table(n, single, pair)
        assert len(strength) == n * (n - 1) * (n - 2) // 6
        every = [(-round(float(strength[a] + strength[b]), 6), a, b) for a, b in combinations(range(len(strength)), 2) if not set(places[a].tolist()) & set(places[b].tolist())]
        assert R.best_pairs(strength, masks.tolist(), 160) == [(a, b, -t) for t, a, b in sorted(every)[:160]]
