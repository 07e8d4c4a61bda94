"""Operators 11 to 13 and the bands of operator 1, against brute force, planted rows and odd rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from test_llm import docs, empty, prose, rows  # noqa: F401

from matchloom.llm import op1_quality, op5_mixing, op7_pii, op9_ann, op11_spelling, op12_alignment, op13_toxicity

SF = "/root/testdata/sf0.001"
LETTERS = [chr(x) for x in [*range(97, 123), *range(0xC0, 0x100)]]


def brute_words(texts):
    c = Counter()
    for i, t in texts:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 5:
                c[w] += 1
    return {w: n for w, n in c.items() if n >= 3}


def brute_variants(c):
    form, out = {}, {}
    for w in c:
        near = set()
        for i in range(len(w) + 1):
            near.add(w[:i] + w[i + 1 :])
            for a in LETTERS:
                near |= {w[:i] + a + w[i:], w[:i] + a + w[i + 1 :]}
        near = [x for x in near if x != w and x in c]
        best = min(near, key=lambda x: (-c[x], x), default=None)
        form[w] = best if best and c[best] >= 2 * c[w] else None
        out[w] = [c[w], len(near)]
    for w in c:
        r = w
        while form[r]:
            r = form[r]
        out[w] = (form[w], r, *out[w], c[form[w]] if form[w] else None)
    return out


def got_variants(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


def test_variants_equal_brute_force(spark):
    got = got_variants(op11_spelling.query(spark, SF))
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert got == brute_variants(brute_words(texts))
    assert any(x[3] for x in got.values()) and any(x[0] for x in got.values())


def test_variants_of_odd_words(spark, docs, empty):  # noqa: F811
    """Runs of one letter, words around the long limit, near words of every edit, chains of forms, accents, nulls, repeats."""
    r = random.Random(3)
    words = ["x" * n for n in (5, 6, 7, 62, 63, 64, 65, 66, 67, 300, 301)] + ["abababab", "babababa", "abababa", "écoleß", "ecoleß", "écoless"]
    for n in (5, 9, 63, 64, 65, 80):
        w = "".join(r.choice("abcé") for _ in range(n))
        words += [w, w[1:], w[:-1], w + "z", "z" + w, w[: n // 2] + "q" + w[n // 2 :], w[: n // 2] + "q" + w[n // 2 + 1 :], w[:2] + w[3:]]
    words += ["kettle", "kettlo", "kettla", "kottla"]
    texts = [(None, None), (None, ""), (2, "1234 日本")]
    texts += [(10 + k, " ".join(w for i, w in enumerate(words) for _ in range(1 + i % 3 + (20 if w == "kettle" else 8 if w == "kettlo" else 0)))) for k in range(4)]
    df = spark.createDataFrame([*texts, texts[-1]], "doc_id long, text string")
    assert got_variants(op11_spelling.variants(df)) == brute_variants(brute_words([*texts, texts[-1]]))
    assert op11_spelling.variants(empty).count() == 0
    assert op11_spelling.variants(docs).columns == ["word", "form", "root", "n", "n_near", "form_n"]


def test_roots_follow_long_chains(spark):
    t = spark.createDataFrame([(f"w{i}", f"w{i + 1}" if i < 20 else None) for i in range(21)] + [(f"v{i}", "w3") for i in range(50)], "word string, form string")
    got = {r["word"]: r["root"] for r in op11_spelling.roots(t).collect()}
    assert len(got) == 71 and set(got.values()) == {"w20"}


def brute_alignment(texts):
    tok = op12_alignment.Tokenizers(*op12_alignment.default_paths())
    per, df = [], Counter()
    for t in texts:
        want = (" " + (t or "")).encode()
        a, b = tok.a.encode(" " + (t or ""), add_special_tokens=False).ids, tok.b.encode(t or "")
        left, right = [tok.bytes_a[i] for i in a], [tok.bytes_b[i] for i in b]
        if not t or b"".join(left) != want or b"".join(right) != want:
            per.append(None)
            continue
        owner = [[k for k, x in enumerate(side) for _ in x] for side in (left, right)]
        pairs = sorted(set(zip(*owner, strict=True)))
        links = [(a[i], b[j]) for i, j in pairs]
        ends = [set(np.cumsum([len(x) for x in side]).tolist()) for side in (left, right)]
        groups, start = [], 0
        for e in sorted(ends[0] & ends[1]):
            groups.append("|".join(",".join(str(ids[k]) for k in sorted(set(o[start:e]))) for ids, o in ((a, owner[0]), (b, owner[1]))))
            start = e
        per.append((len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        df.update(set(links))
    best = {}
    for (x, _), n in df.items():
        best[x] = max(best.get(x, 0), n)
    return [(0, 0, 0, 0, 0, 0, "") if p is None else (*p[:3], len(p[3]), sum(df[k] == best[k[0]] for k in p[3]), sum(df[k] for k in p[3]), p[4]) for p in per]


ODD = [(9001, None), (9002, ""), (9003, " "), (9004, "a▁b c"), (9005, "<|endoftext|> <s> <0x41>"), (9006, "  two  spaces \n\n x\ttab nb nb é à la"), (9007, "日本 \U0001f389 ñandú"), (9008, "x" * 3000), (None, "null id here"), (9009, "same text"), (9009, "same text")]


@pytest.mark.parametrize("sizes", [(20_000, 100_000), (op12_alignment.SLICE, op12_alignment.BLOCK)])
def test_alignment_equals_brute_force(spark, sizes):
    own = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").union(spark.createDataFrame(ODD, "doc_id long, text string")).repartition(3)
    out, pairs = op12_alignment.alignment(own, slice_bytes=sizes[0], block_bytes=sizes[1])
    src = own.collect()
    key = lambda x: tuple(map(str, x))
    want = sorted([(r["doc_id"], *w) for r, w in zip(src, brute_alignment([r["text"] for r in src]), strict=True)], key=key)
    got = sorted([tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in out.collect()], key=key)
    assert got == want
    assert pairs.columns == ["a", "b", "docs"] and pairs.count() > 100


def test_alignment_of_odd_tables(spark, docs, empty):  # noqa: F811
    assert op12_alignment.alignment(empty)[0].count() == 0
    assert op12_alignment.alignment(docs)[0].count() == len(rows())
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r["n_a"], r["count_sum"], r["groups_sha256"]) for r in op12_alignment.alignment(nothing)[0].collect()} == {(0, 0, "")}


def test_byte_characters_are_the_tokenizers_own():
    tok = op12_alignment.Tokenizers(*op12_alignment.default_paths())
    for t in (" aé日\x00\x7f­\n", " \U0001f389 x"):
        assert b"".join(tok.bytes_a[i] for i in tok.a.encode(t).ids) == t.encode()


def planted(n, seed):
    """Toxic documents have one sentence with a stem that is bad; clean ones share everything else."""
    r, out = random.Random(seed), []
    for i in range(n):
        body = [prose(r.randint(5, 12)).rstrip(".") + "." for _ in range(r.randint(3, 25))]
        toxic = i % 3 == 0
        if toxic:
            at = r.randrange(len(body))
            body[at] = f"You {r.choice(['grubbel' + r.choice(['', 's', 'ing', 'heit']), 'snarfoo'])} of a {r.choice(['lamp', 'river', 'mirror'])}."
        out.append((i, " ".join(body), int(toxic)))
    return out


def test_toxic_sentences_are_learnt_from_document_labels(spark):
    train, new = planted(300, 1), planted(200, 2)
    df = lambda x: spark.createDataFrame(x, "doc_id long, text string, toxic int")
    model = op13_toxicity.fit(df(train).select("text", "toxic"))
    got = {r["doc_id"]: r for r in op13_toxicity.score(df(new), model).collect()}
    wrong = [i for i, _, y in new if (got[i]["score"] >= op13_toxicity.THRESHOLD) != bool(y)]
    assert len(wrong) <= 4
    text = {i: t for i, t, _ in new}
    found = [(r["doc_id"], r["sentence"], text[r["doc_id"]][r["start"] : r["end"]]) for r in op13_toxicity.locate(df(new), model).collect()]
    assert all(a == b for _, a, b in found)
    bad = [a for _, a, _ in found if "grubbel" not in a and "snarfoo" not in a]
    assert len(found) >= 60 and len(bad) <= 3
    worst = [text[i][r["worst_start"] : r["worst_end"]] for i, r in got.items() if r["score"] >= op13_toxicity.THRESHOLD]
    assert sum("grubbel" in w or "snarfoo" in w for w in worst) >= 0.95 * len(worst)


def test_toxicity_of_odd_rows(spark, docs, empty):  # noqa: F811
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = op13_toxicity.fit(op13_toxicity.training_rows(docs, none))
    assert model is None
    got = op13_toxicity.score(docs, model).collect()
    assert len(got) == len(rows()) and {r["score"] for r in got} == {0.0}
    model = op13_toxicity.fit(spark.createDataFrame([(t, y) for _, t, y in planted(90, 4)], "text string, toxic int"))
    got = op13_toxicity.score(docs, model).collect()
    assert len(got) == len(rows()) and all(0 <= r["score"] <= 1 for r in got)
    leak = {r["score"] for r in got if r["doc_id"] in (0, 1, 2)}
    assert len(leak) == 1 and all(r["n_sentences"] == 0 and r["worst_start"] is None for r in got if r["doc_id"] in (0, 1, 2))
    assert op13_toxicity.score(empty, model).count() == 0


def test_held_out_labels_change_no_score(spark):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    other = labels.withColumn("toxic", op13_toxicity.F.when(op13_toxicity.held_out("doc_id"), 1 - op13_toxicity.F.col("toxic")).otherwise(op13_toxicity.F.col("toxic")))
    a, b = (sorted(map(tuple, op13_toxicity.training_rows(d, x).collect())) for x in (labels, other))
    assert a == b and len(a) > 10


def test_gradient_is_the_slope_of_the_loss(spark):
    hot = pa.array([[[0, 1], [1]], [], [[0]], [[2], [0, 2]]], pa.list_(pa.list_(pa.int32())))
    batch = pa.record_batch([pa.array([1, 1, 0, 0], pa.int32()), hot], names=["toxic", "hot"])
    loss = lambda w: next(op13_toxicity._gradient_task(w)([batch]))
    w = np.array([0.4, -0.3, 0.2, -1.5, -2.0])
    got = np.array(loss(w).column(1)[0].as_py())
    for i in range(len(w)):
        e = np.eye(len(w))[i] * 1e-6
        assert got[i] == pytest.approx((loss(w + e).column(0)[0].as_py() - loss(w - e).column(0)[0].as_py()) / 2e-6, abs=1e-5)


def test_bands_by_perplexity(spark):
    """Word salad of clean characters goes, endless formula too, fluent text with unusual marks stays; all texts are counted."""
    r = random.Random(8)
    good = [prose(r.randint(80, 160)) for _ in range(200)]
    marked = [" ".join(f"{w} #{i}" if i % 9 == 0 else w for i, w in enumerate(prose(90).split())) for _ in range(40)]
    salad = [" ".join("".join(r.choice("etaoinshrdlu") for _ in range(r.randint(3, 8))) for _ in range(100)) for _ in range(40)]
    formula = [" ".join("lo" + "la" * r.randint(2, 4) + "lo" * r.randint(2, 9) for _ in range(90)) for _ in range(40)]
    kinds = [*[("good", t) for t in good], *[("marked", t) for t in marked], *[("salad", t) for t in salad], *[("formula", t) for t in formula]]
    d = spark.createDataFrame([(i, t, "en") for i, (_, t) in enumerate(kinds)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(k in ("good", "marked"))) for i, (k, _) in enumerate(kinds) if i % 2], "doc_id long, quality int")
    got = {x["doc_id"]: x for x in op1_quality.quality(d, labels).collect()}
    share = lambda kind: np.mean([got[i]["kept"] for i, (k, _) in enumerate(kinds) if k == kind and not got[i]["base_failed"]])
    assert share("good") >= 0.98 and share("marked") >= 0.95 and share("salad") <= 0.05 and share("formula") <= 0.1
    low = [x for x in got.values() if not x["base_failed"] and (x["perplexity"] < x["lower_perplexity"] or x["perplexity1"] < x["lower_perplexity1"])]
    assert low


def test_a_document_is_scored_without_its_own_counts(spark):
    """A text that no other text resembles is as surprising once as five times: equal texts share a half."""
    base = [(i, prose(80), "en") for i in range(40)]
    odd = "qzx vwk jjq " * 40
    one, five = (spark.createDataFrame(base + [(100 + k, odd, "en") for k in range(n)], "doc_id long, text string, lang string") for n in (1, 5))
    a, b = ({r["doc_id"]: r["mean_logp"] for r in op1_quality.score_held_out(x).collect()}[100] for x in (one, five))
    assert a == pytest.approx(b, abs=1e-6)


def test_both_ways_to_score_held_out_are_equal(spark, docs):  # noqa: F811
    a, b = ({(r["doc_id"], r["n_words"]): (r["mean_logp"], r["mean_logp1"]) for r in op1_quality.score_held_out(docs, m).collect()} for m in (10**9, 0))
    assert a.keys() == b.keys()
    for k in a:
        assert all((x is None) == (y is None) and (x is None or x == pytest.approx(y, abs=1e-4)) for x, y in zip(a[k], b[k], strict=True)), k


def test_raking_reports_targets_that_cells_cannot_meet(spark):
    cells = spark.createDataFrame([("a", "en", "p", 1, 100), ("b", "de", "q", 1, 100)], "source string, lang string, topic string, docs long, tokens long")
    share = lambda x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"source": share({"a": 0.9, "b": 0.1}), "lang": share({"en": 0.2, "de": 0.8}), "topic": share({"p": 0.5, "q": 0.5})}
    with pytest.warns(UserWarning, match="cells can't meet"):
        fitted = op5_mixing.rake(cells, targets)
    assert max(op5_mixing.residual(fitted, targets).values()) > 0.1


def test_raking_goes_on_until_it_is_there(spark):
    """A slow fit: two sources that share their languages almost fully."""
    cells = spark.createDataFrame([("a", "en", "p", 1, 9990), ("a", "de", "p", 1, 10), ("b", "en", "p", 1, 10), ("b", "de", "p", 1, 9990), (None, "de", "p", 1, 3)], "source string, lang string, topic string, docs long, tokens long")
    share = lambda x: spark.createDataFrame(list(x.items()), "value string, share double")
    targets = {"source": share({"a": 0.7, "b": 0.2, None: 0.1}), "lang": share({"en": 0.6, "de": 0.4}), "topic": share({"p": 1.0})}
    fitted = op5_mixing.rake(cells, targets)
    assert max(op5_mixing.residual(fitted, targets).values()) < 1e-8
    got = {(r["source"], r["lang"]): r["fitted"] / r["tokens"] for r in fitted.collect()}
    assert got["a", "en"] * got["b", "de"] == pytest.approx(got["a", "de"] * got["b", "en"], rel=1e-6)  # the cells' own association stays


PLAIN = [
    "password: hunter2xyz", "my pwd = Tr0ub4dor", "Password is sunshine99!", "passcode: k1tt3ns", "passwort: Berlin2019", "token: zx81-spectrum", "PIN: 48120 ", "login password:qwerty77",
    "write to john [at] example [dot] com", "mail jane.roe(at)mail(dot)example(dot)org", "info[at]shop[dot]de",
    "SSN 123-45-6789", "ssn: 987-65-4320", "social security number 219-09-9999", "national insurance number QQ 12 34 56 C", "NIF 12345678Z", "passport no. 533380006", "CPF 111.444.777-35", "passport X1234567",
    "phone 020 7946 0958", "call 555-867-5309", "tel. (030) 901820", "Telefon: 0171 2345678", "teléfono 912 34 56 78", "call me on 0161 496 0000", "mobile: 07700 900982", "phone 212.555.0198",
    "born 12/05/1987", "date of birth: 1990-03-14", "geboren am 03.11.1975", "born on 4 July 1976", "née le 21 mars 1962", "DOB 7/8/1964", "birthday: May 9, 1993",
]


def test_plain_personal_data_is_found(spark):
    """Short passwords, spelled-out contacts, ids, local phones and dates of birth; and texts full of numbers that aren't personal."""
    model = op7_pii.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    missed = []
    for k, x in enumerate(PLAIN):
        text = f"{prose(15)} {x} {prose(15)}"
        value = re.search(r"hunter2xyz|Tr0ub4dor|sunshine99|k1tt3ns|Berlin2019|zx81-spectrum|48120|qwerty77|\S+ ?[\[(]at[\])] ?\S+(?: [\[(]dot[\])] \S+)*|QQ 12.*|[A-Z]?[0-9].*|May 9, 1993", x)[0].strip()
        at = text.index(x) + x.index(value)
        if not any(s <= at and at + len(value) <= e for s, e, _ in op7_pii.spans(text, model)[1]):
            missed.append(x)
    r = random.Random(4)
    clean = [
        lambda: f"the score was {r.randrange(9)}-{r.randrange(9)} after {r.randrange(90)} minutes", lambda: f"founded in {r.randrange(1800, 2020)} with {r.randrange(500)} members", lambda: f"on {r.randrange(1, 28)}/{r.randrange(1, 12)}/{r.randrange(1990, 2024)} it rained {r.randrange(40)} mm",
        lambda: f"prices rose {r.randrange(30)}% to ${r.randrange(1, 900)}.{r.randrange(10, 99)}", lambda: f"chapter {r.randrange(30)}, page {r.randrange(400)}", lambda: f"version {r.randrange(9)}.{r.randrange(30)}.{r.randrange(9)} of the file", lambda: f"about {r.randrange(1, 99)},{r.randrange(100, 999)} people came at {r.randrange(24)}:{r.randrange(10, 59)}", lambda: "the password is required and the phone rang twice",
    ]
    hit = [t for t in (f"{prose(20)} {clean[i % len(clean)]()} {prose(20)}" for i in range(200)) if op7_pii.spans(t, model)[1]]
    assert len(missed) <= 0.1 * len(PLAIN) and len(hit) <= 10, (missed, [re.findall(r"[^.]*[0-9][^.]*", t) for t in hit[:8]], len(hit))


def test_calibration_by_kind():
    bins = [(0.1, 0, 50), (0.2, 3, 10), (0.3, 2, 10), (0.6, 9, 10), (0.9, 10, 10)]
    curve = op7_pii.isotonic(bins)
    assert [p for _, p in curve] == sorted(p for _, p in curve) and curve[1] == (0.2, 0.25)
    got = op7_pii.thresholds([("secret", s, g, n) for s, g, n in bins] + [("number", 0.3, 60, 60), ("number", 0.1, 0, 60)])
    assert got["secret"] == 0.6 and got["number"] == 0.3 and got["contact"] == 0.3


def clustered(n=6000, d=48, centres=300, seed=3):
    g = np.random.default_rng(seed)
    c = g.normal(size=(centres, d))
    return c[g.integers(0, centres, n)] + 0.15 * g.normal(size=(n, d))


def test_lists_prune_clustered_vectors(spark):
    x = clustered()
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    model = op9_ann.fit(op9_ann.usable(df))
    assert model["lists"]["share"] <= 0.2, model["lists"]
    asked = df.filter("vec_id % 50 = 0")
    got = {}
    for r in op9_ann.search(df, asked, model=model).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for i in range(0, len(x), 50):
        s = unit @ unit[i]
        s[i] = -2
        want = set(np.argsort(-s)[:5].tolist())
        rows_ = sorted(got[i])
        assert [a for a, _, _ in rows_] == [1, 2, 3, 4, 5]
        assert all(c == pytest.approx(s[b], abs=1e-12) for _, b, c in rows_)
        hits += len(want & {b for _, b, _ in rows_})
    assert hits >= 0.9 * 5 * len(got)


def test_both_ways_find_the_same(spark):
    """Whatever the lists find within the radius is what a plain scan of the codes finds; queries with too few rows get them from the tiles."""
    x = clustered(800, 32, 40)
    x[700:] = np.random.default_rng(9).normal(size=(100, 32)) * 3  # loners
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "vec_id long, embedding array<double>")
    model = op9_ann.fit(op9_ann.usable(df))
    how = model["lists"] | {"share": 0.1}
    v = op9_ann.usable(df).withColumn("at", op9_ann.F.col("vec_id"))
    q = v.filter("vec_id % 10 = 0").withColumnRenamed("at", "query")
    pairs = {(r["query_id"], r["vec_id"]) for r in op9_ann.by_lists(v, q, model).collect()}
    codes = op9_ann.encode(model, op9_ann._unit(x))[:, : how["bits"] // 8]
    far = np.bitwise_count(codes[::10][:, None, :] ^ codes[None]).sum(axis=2)
    assert pairs == {(10 * i, j) for i, j in zip(*np.nonzero(far <= how["radius"]), strict=True) if 10 * i != j}
    got = op9_ann.search(df, df.filter("vec_id % 10 = 0"), model=model | {"lists": how}).groupBy("query_id").count().collect()
    assert len(got) == 80 and {r["count"] for r in got} == {5}


def test_names_without_a_value_propose_nothing():
    """An id's name before many groups of capitals, with a digit far behind."""
    for t in ("iban AB CD EF GH IJ KL MN OP QR ST 7", "passport no - ABC. 12", "ssn: x" * 3000, "account " * 2000 + "1", "ID NO A B C D E F G H I J 5"):
        assert all(0 <= s < e <= len(t) for s, e, _ in op7_pii.candidates(t))
