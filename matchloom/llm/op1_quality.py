"""Operator 1, quality rules: n-gram perplexity under a modified Kneser-Ney model of the corpus.

Spark counts character n-grams of all documents (numpy sorts them inside each task, so that a task
sends each n-gram once; a shuffle adds them up). Discounts, continuation counts and interpolated
probabilities are DataFrame aggregations and joins. The model is stored as arrays of n-gram keys,
sorted, with a probability beside each; scoring is a binary search of all n-grams of a batch at once.
A key packs 15 bits for each character: code points from 28672 are folded into 4096 classes (so most Hangul and much of Han is conflated).

Held out: texts fall into two halves by a hash of the text (equal texts into the same one), each half has its own model
for each language, and a document is scored by the model of the other half, which never counted it.

Bands: limits of a document's surprise (minus the mean log-probability of a character), for each language and for two orders of the
model: with the whole context, which shows texts that are too repetitive or in no known language, and with none (the model's lowest order), which shows
texts made of unusual characters even if much of the corpus is junk of the same kind, whose contexts the whole model knows. They are learnt from
labelled documents: the upper limit is the cut above which bad documents outweigh ``COST`` times the good ones the most, the
lower limit likewise from below. All labelled rows count. A limit that no label
speaks for is the ``QUANTILES`` of the language's documents, moved out by ``MARGIN``. Short texts get a wider band: their surprise may be off by ``SHORT`` / sqrt(characters).

Size: the model has at most ``MAX_BROADCAST`` rows if it is sent to the tasks; a larger one is joined
with the documents' distinct n-grams instead, by the same back-off and with the same results
(``score_by_join``). Cases: a null or empty text has no words and fails the base rules; very long texts
are counted and scored whole; a null language is a language of its own; ties and repeated rows get equal
results; a language that the other half lacks has no perplexity and keeps its documents; an empty table gives no rows; other columns than doc_id, lang and text are not read, whatever
their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, table, with_hot_keys
from matchloom.llm.textscan import Scan, base_counts, slices, text_buffer
from matchloom.session import shuffled

ORDER = 4
BITS = 15
#: Rows of a model that may be sent to every task: 16 bytes each.
MAX_BROADCAST = 4_000_000
#: What a short text adds to its band (by 1/sqrt(characters)).
SHORT = 4.0
#: Losing a good document costs so many bad ones kept; width of the bins in which labelled rows are added up.
COST, BIN = 20.0, 0.005
QUANTILES, MARGIN = (0.001, 0.999), 0.1
HALVES = 2
#: Bytes of text that are cut into n-grams at once, and n-grams of a language that a task holds.
SLICE, HELD = 200_000, 300_000
_NO_LANG = "und"


def _symbols(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    data, offs = text_buffer(col)
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    cp = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
    return np.where(cp < 28672, cp, 28672 + cp % 4096), lead[offs]


def grams(col: pa.Array, n: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """A key for each character with the n - 1 before it (0 before the text), and the texts' offsets."""
    s, offs = _symbols(col)
    key = s.copy()
    pos = np.arange(len(s)) - np.repeat(offs[:-1], np.diff(offs))
    for j in range(1, n):
        prev = np.zeros_like(s)
        prev[j:] = s[:-j]
        prev[pos < j] = 0
        key |= prev << (BITS * j)
    return key, offs


def _runs(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    if weights is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, weights = keys[order], weights[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    n = np.diff(np.append(first, len(keys))) if weights is None else np.add.reduceat(weights, first)
    return keys[first], n


def _count_task(batches):
    held: dict[str, list] = {}
    for whole in batches:
        for b in slices(whole, limit=SLICE):
            langs = np.array([x if x is not None else _NO_LANG for x in b.column(0).to_pylist()], dtype=object)
            key, offs = grams(b.column(1))
            each = np.repeat(np.arange(b.num_rows), np.diff(offs))
            for lang in set(langs):
                k, n = _runs(key[(langs == lang)[each]])
                held.setdefault(lang, []).append((k, n))
                if sum(len(x[0]) for x in held[lang]) > HELD:
                    held[lang] = [_runs(*map(np.concatenate, zip(*held[lang], strict=True)))]
                    if len(held[lang][0][0]) > HELD // 2:  # what is sent now is added up after the shuffle
                        k, n = held.pop(lang)[0]
                        yield pa.record_batch([pa.array([lang] * len(k)), pa.array(k), pa.array(n)], names=["lang", "gram", "c"])
    for lang, parts in held.items():
        k, n = _runs(*map(np.concatenate, zip(*parts, strict=True)))
        yield pa.record_batch([pa.array([lang] * len(k), pa.string()), pa.array(k), pa.array(n)], names=["lang", "gram", "c"])


def count(docs: DataFrame) -> DataFrame:
    """(lang, gram, c) over all texts."""
    small_batches(docs.sparkSession)
    rows = docs.select("lang", "text").mapInArrow(_count_task, "lang string, gram long, c long")
    return rows.groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def train(docs: DataFrame) -> DataFrame:
    """The model: (lang, k, key, logp, logb); logp of a k-gram, logb the back-off weight of it as a context."""
    levels = {ORDER: materialize(count(docs), "grams")}
    for k in range(ORDER - 1, 0, -1):
        up = levels[k + 1].select("lang", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1).alias("gram"))
        levels[k] = up.groupBy("lang", "gram").agg(F.count(F.lit(1)).alias("c"))
    prob, out = None, None
    for k in range(1, ORDER + 1):
        t = levels[k].withColumn("ctx", F.shiftright("gram", BITS))
        few = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).alias(f"n{i}") for i in range(1, 5)]
        y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
        d = lambda i, y=y: F.coalesce(F.greatest(F.lit(0.05), F.least(F.lit(i - 0.05), F.lit(float(i)) - F.try_divide((i + 1) * y * F.col(f"n{i + 1}"), F.col(f"n{i}")))), F.lit(0.5))
        disc = t.groupBy("lang").agg(*few, F.count(F.lit(1)).alias("types")).select("lang", "types", *[d(i).alias(f"d{i}") for i in (1, 2, 3)])
        cut = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        t = t.join(F.broadcast(disc), "lang")  # disc: a row for each language
        t = t.withColumn("cut", F.least(cut, F.col("c").cast("double")))
        ctx = t.groupBy("lang", "ctx").agg(F.sum("c").alias("total"), F.sum("cut").alias("spare"))
        t = t.join(ctx, ["lang", "ctx"]).withColumn("own", (F.col("c") - F.col("cut")) / F.col("total")).withColumn("gamma", F.col("spare") / F.col("total"))
        if k == 1:
            t = t.withColumn("p", F.col("own") + F.col("gamma") / F.col("types"))
        else:
            low = prob.select("lang", F.col("gram").alias("low"), F.col("p").alias("p_low"))
            t = t.withColumn("low", F.col("gram").bitwiseAND((1 << (BITS * (k - 1))) - 1)).join(low, ["lang", "low"], "left")
            t = t.withColumn("p", F.col("own") + F.col("gamma") * F.coalesce("p_low", F.lit(1e-6)))
        prob = materialize(t.select("lang", "gram", "ctx", "p", "gamma"), f"level{k}")
        rows = prob.select("lang", F.lit(k).alias("k"), F.col("gram").alias("key"), F.log("p").cast("float").alias("logp"), F.lit(0).alias("is_ctx"))
        back = prob.groupBy("lang", "ctx").agg(F.first("gamma").alias("gamma")).select("lang", F.lit(k).alias("k"), F.col("ctx").alias("key"), F.log("gamma").cast("float").alias("logp"), F.lit(1).alias("is_ctx"))
        out = rows.unionByName(back) if out is None else out.unionByName(rows).unionByName(back)
    return out


def _packed_task(batches):
    """Keys and probabilities of each language, order and kind as bytes, 12 for each row."""
    names = ["lang", "k", "is_ctx", "keys", "logps"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
    held: dict[tuple, list] = {}

    def sent() -> pa.RecordBatch:
        rows = [(*x, *(np.concatenate(c).tobytes() for c in zip(*parts, strict=True))) for x, parts in held.items()]
        return pa.record_batch([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    n = 0
    for b in batches:
        lang, k, c, key, p = (b.column(b.schema.get_field_index(x)) for x in ("lang", "k", "is_ctx", "key", "logp"))
        lang, key, p = lang.dictionary_encode(), key.to_numpy(), p.to_numpy()
        group = (lang.indices.to_numpy().astype(np.int64) * (ORDER + 1) + k.to_numpy()) * 2 + c.to_numpy()
        for g in np.unique(group):
            own = group == g
            held.setdefault((lang.dictionary[int(g) // 2 // (ORDER + 1)].as_py(), int(g) // 2 % (ORDER + 1), int(g) % 2), []).append((key[own], p[own]))
        n += b.num_rows
        if n >= HELD:
            yield sent()
            held, n = {}, 0
    if n:
        yield sent()


def pack(model: DataFrame) -> dict:
    """Sorted key arrays by language, order and kind. Tasks make bytes of the rows, so the driver has no object for a row."""
    parts: dict[tuple, list] = {}
    rows = model.select("lang", "k", "is_ctx", "key", "logp").mapInArrow(_packed_task, "lang string, k int, is_ctx int, keys binary, logps binary")
    for b in rows.toArrow().to_batches():
        for i, x in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
            parts.setdefault(x, []).append(tuple(np.frombuffer(b.column(j)[i].as_buffer(), t) for j, t in ((3, np.int64), (4, np.float32))))
    out = {}
    for lang in {x[0] for x in parts}:
        for i in range(1, ORDER + 1):
            for j in (0, 1):
                key, p = map(np.concatenate, zip((np.zeros(0, np.int64), np.zeros(0, np.float32)), *parts.pop((lang, i, j), []), strict=True))
                at = np.argsort(key, kind="stable")
                out[lang, i, j] = (key[at], p[at])
    return out


def _find(arrays: tuple[np.ndarray, np.ndarray], keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    have, p = arrays
    if not len(have):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.float32)
    at = np.minimum(np.searchsorted(have, keys), len(have) - 1)
    return have[at] == keys, p[at]


def logprob(model: dict, lang: str, keys: np.ndarray) -> np.ndarray:
    """Log-probability of each n-gram key; n-grams not seen back off to shorter ones. NaN without a model of the language."""
    if (lang, ORDER, 0) not in model or not len(keys):
        return np.full(len(keys), np.nan)
    uniq, inverse = np.unique(keys, return_inverse=True)
    got, todo, weight = np.full(len(uniq), np.log(1e-6)), np.arange(len(uniq)), np.zeros(len(uniq))
    for k in range(ORDER, 0, -1):
        low = uniq[todo] & ((1 << (BITS * k)) - 1)
        hit, p = _find(model[lang, k, 0], low)
        got[todo[hit]] = weight[todo[hit]] + p[hit]
        todo, low = todo[~hit], low[~hit]
        if not len(todo):
            break
        seen, b = _find(model[lang, k, 1], low >> BITS)
        weight[todo[seen]] += b[seen]
        got[todo] = weight[todo] + np.log(1e-6)
    return got[inverse]


def logprob_alone(model: dict, lang: str, keys: np.ndarray) -> np.ndarray:
    """Log-probability of each key's character without its context."""
    if (lang, 1, 0) not in model or not len(keys):
        return np.full(len(keys), np.nan)
    have, p = model[lang, 1, 0]
    every = np.full(1 << BITS, np.log(1e-6))
    every[have] = p
    return every[keys & ((1 << BITS) - 1)]


def _score(packed):
    def run(batches):
        model = packed.value
        for whole in batches:
            for b in slices(whole, limit=SLICE):
                lang, text = (b.column(b.schema.get_field_index(c)) for c in ("lang", "text"))
                key, offs = grams(text)
                langs = np.array([x if x is not None else _NO_LANG for x in lang.to_pylist()], dtype=object)
                each = np.repeat(np.arange(b.num_rows), np.diff(offs))
                lp, lp1 = np.zeros(len(key)), np.zeros(len(key))
                for x in set(langs):
                    own = (langs == x)[each]
                    lp[own], lp1[own] = logprob(model, x, key[own]), logprob_alone(model, x, key[own])
                total, alone = np.bincount(each, lp, minlength=b.num_rows), np.bincount(each, lp1, minlength=b.num_rows)
                n = np.diff(offs)
                counts = base_counts(text)
                ids = b.column(b.schema.get_field_index("doc_id"))
                means = [pa.array(t / np.maximum(n, 1), mask=(n == 0) | np.isnan(t)) for t in (total, alone)]
                yield pa.record_batch([ids, lang, *[pa.array(x) for x in counts.values()], pa.array(n.astype(np.int64)), *means], names=["doc_id", "lang", *counts, "n_model_chars", "mean_logp", "mean_logp1"])

    return run


_OUT = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_model_chars long, mean_logp double, mean_logp1 double"


def _grams_task(batches):
    """For each document a row with its counts, and a row for each distinct n-gram."""
    for whole in batches:
        for b in slices(whole, limit=SLICE):
            counts = base_counts(b.column(2))
            key, offs = grams(b.column(2))
            runs = [_runs(key[offs[i] : offs[i + 1]]) for i in range(b.num_rows)]
            sizes = np.array([len(k) for k, _ in runs])
            rows = pa.concat_arrays([b.column(3), b.column(3).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))])
            langs = pa.concat_arrays([b.column(1), b.column(1).take(pa.array(np.repeat(np.arange(b.num_rows), sizes)))])
            nulls = lambda kind, m=int(sizes.sum()): pa.nulls(m, kind)
            lone = lambda x, kind=pa.int64(): pa.concat_arrays([pa.array(x, kind), nulls(kind)])
            many = lambda x, m=b.num_rows: pa.concat_arrays([pa.nulls(m, pa.int64()), pa.array(np.concatenate([np.zeros(0, np.int64), *x]), pa.int64())])
            ids = pa.concat_arrays([b.column(0), nulls(pa.int64())])
            yield pa.record_batch([rows, langs, ids, *[lone(c) for c in counts.values()], lone(np.diff(offs)), many([k for k, _ in runs]), many([n for _, n in runs])], names=["row_key", "lang", "doc_id", *counts, "n_model_chars", "gram", "n"])


def score_by_join(docs: DataFrame, model: DataFrame) -> DataFrame:
    """As ``score``, for models of any size: distinct n-grams of each document meet the model in a join.

    N-grams that the model lacks back off as in ``logprob``, order by order, once for each (language, n-gram). N-grams
    that many documents hold are joined by broadcast (see ``with_hot_keys``), the others by a shuffle."""
    small_batches(docs.sparkSession)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_model_chars"]
    schema = "row_key long, lang string, doc_id long, " + ", ".join(f"{c} long" for c in names) + ", gram long, n long"
    every = docs.select("doc_id", "lang", "text", F.monotonically_increasing_id().alias("row_key")).mapInArrow(_grams_task, schema)
    every = materialize(every, "doc_grams")
    own = every.filter("gram is null").select("row_key", "lang", "doc_id", *names)
    rows = every.filter("gram is not null").select("row_key", F.coalesce("lang", F.lit(_NO_LANG)).alias("model_lang"), "gram", "n")
    todo = rows.groupBy("model_lang", "gram").agg(F.count(F.lit(1)).alias("docs")).withColumn("weight", F.lit(0.0))
    lp, unseen = None, float(np.log(1e-6))
    for k in range(ORDER, 0, -1):
        part = lambda is_ctx, name, k=k: model.filter((F.col("k") == k) & (F.col("is_ctx") == is_ctx)).select(F.col("lang").alias("model_lang"), F.col("key").alias("_key"), F.col("logp").cast("double").alias(name))
        t = todo.withColumn("_key", F.col("gram").bitwiseAND((1 << (BITS * k)) - 1)).join(part(0, "_p"), ["model_lang", "_key"], "left")
        t = t.withColumn("_key", F.shiftright("_key", BITS)).join(part(1, "_b"), ["model_lang", "_key"], "left")
        t = materialize(t.select("model_lang", "gram", "docs", "weight", "_p", "_b"), f"back{k}")
        got = t.filter("_p is not null").select("model_lang", "gram", "docs", (F.col("weight") + F.col("_p")).alias("logp"))
        lp = got if lp is None else lp.unionByName(got)
        todo = t.filter("_p is null").select("model_lang", "gram", "docs", (F.col("weight") + F.coalesce("_b", F.lit(0.0))).alias("weight"))
    known = model.select(F.col("lang").alias("model_lang")).distinct()  # a row for each language
    rest = todo.join(F.broadcast(known.withColumn("_known", F.lit(True))), "model_lang", "left").select("model_lang", "gram", "docs", F.when(F.col("_known"), F.col("weight") + F.lit(unseen)).alias("logp"))
    hit = with_hot_keys(rows, materialize(lp.unionByName(rest), "logp"), ["model_lang", "gram"], "docs")
    single = model.filter("k = 1 AND is_ctx = 0").select(F.col("lang").alias("_l"), F.col("key").alias("_key"), F.col("logp").cast("double").alias("logp1"))
    # at most 2 ** BITS rows for a language; Spark broadcasts them below its own limit
    hit = hit.join(single, (F.col("model_lang") == F.col("_l")) & (F.col("gram").bitwiseAND((1 << BITS) - 1) == F.col("_key")), "left")
    alone = F.when(F.col("logp").isNotNull(), F.coalesce("logp1", F.lit(unseen)))
    total = hit.groupBy("row_key").agg(F.sum(F.col("n") * F.col("logp")).alias("total"), F.sum(F.col("n") * alone).alias("total1"))
    out = own.join(total, "row_key", "left")
    mean = lambda c: F.when(F.col("n_model_chars") > 0, F.col(c) / F.col("n_model_chars"))
    return out.select("doc_id", "lang", *names, mean("total").alias("mean_logp"), mean("total1").alias("mean_logp1"))


def score(docs: DataFrame, model: DataFrame, max_broadcast: int = MAX_BROADCAST, sent: list | None = None) -> DataFrame:
    """Base counts and the mean log-probability of a character, one row for each document. ``sent`` gets the broadcast model, if there is one."""
    spark = docs.sparkSession
    if model.count() > max_broadcast:
        return score_by_join(docs, model)
    small_batches(spark)
    packed = spark.sparkContext.broadcast(pack(model))
    if sent is not None:
        sent.append(packed)
    return docs.select("doc_id", "lang", "text").mapInArrow(_score(packed), _OUT)


def half() -> F.Column:
    return F.pmod(F.xxhash64(F.coalesce("text", F.lit(""))), F.lit(HALVES))


def _of_half(docs: DataFrame, number) -> DataFrame:
    """``docs`` with a language key for each half."""
    return docs.select("doc_id", F.concat_ws("#", F.coalesce("lang", F.lit(_NO_LANG)), number.cast("string")).alias("lang"), "text")


def score_held_out(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """As ``score``; each document by the model of the half that it isn't in."""
    model = materialize(train(_of_half(docs, half())), "model")
    sent: list = []
    t = score(_of_half(docs, F.lit(HALVES - 1) - half()), model, max_broadcast, sent)
    t = materialize(t.withColumn("lang", F.expr("substring(lang, 1, char_length(lang) - 2)")), "scored")
    for packed in sent:  # the workers' copies go too
        packed.destroy()
    return t


def _cut(labelled: DataFrame, value: F.Column, sign: int, name: str) -> DataFrame:
    """(lang, name): the limit, half way between two values, beyond which bad documents outweigh good ones the most; no row where they never do.

    Gains are added up from above in two steps, bins of ``BIN`` and values inside a bin, so no task holds a language's labelled rows."""
    t = labelled.select("lang", (sign * value).alias("v"), "good").groupBy("lang", "v").agg(F.sum(F.when(F.col("good"), -COST).otherwise(1.0)).alias("gain"))
    t = t.withColumn("bin", F.floor(F.col("v") / BIN))
    bins = Window.partitionBy("lang").orderBy(F.col("bin").desc())  # a language has a few thousand bins
    b = t.groupBy("lang", "bin").agg(F.sum("gain").alias("own"), F.max("v").alias("top"))
    b = b.select("lang", "bin", (F.sum("own").over(bins) - F.col("own")).alias("above"), F.lead("top").over(bins).alias("below"))
    w = Window.partitionBy("lang", "bin").orderBy(F.col("v").desc())
    t = t.join(b, ["lang", "bin"]).select("lang", "v", (F.col("above") + F.sum("gain").over(w)).alias("gain"), F.coalesce(F.lead("v").over(w), "below").alias("next"))
    best = t.groupBy("lang").agg(F.max(F.struct("gain", "v", "next")).alias("b")).filter("b.gain > 0")
    return best.select("lang", (sign * (F.col("b.v") + F.coalesce("b.next", F.col("b.v") - MARGIN)) / 2).alias(name))


def bands(scored: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """(lang, low, high, low1, high1): limits of the surprise after the allowance for short texts, with context and without."""
    allowance = SHORT / F.sqrt("n_model_chars")
    own = scored.filter("mean_logp is not null and n_words >= 50 and 2 * n_repeat_words <= n_words").select("doc_id", "lang", (-F.col("mean_logp")).alias("s"), (-F.col("mean_logp1")).alias("s1"), allowance.alias("a"))
    q = lambda c, sign, at: F.percentile_approx(F.col(c) + sign * F.col("a"), at, 10000) + sign * -MARGIN
    limits = own.groupBy("lang").agg(q("s", 1, QUANTILES[0]).alias("low"), q("s", -1, QUANTILES[1]).alias("high"), q("s1", 1, QUANTILES[0]).alias("low1"), q("s1", -1, QUANTILES[1]).alias("high1"))
    if labels is None:
        return limits
    known = labels.filter("doc_id is not null and quality is not null").groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    labelled = materialize(own.join(shuffled(known), F.col("doc_id") == F.col("label_id")).select("lang", "s", "s1", "a", (F.col("quality") == 1).alias("good")), "labelled")
    for value, low, high in (("s", "low", "high"), ("s1", "low1", "high1")):
        limits = limits.join(_cut(labelled, F.col(value) - F.col("a"), 1, "_cut_high"), "lang", "left").join(_cut(labelled, F.col(value) + F.col("a"), -1, "_cut_low"), "lang", "left")
        limits = limits.withColumns({low: F.coalesce("_cut_low", low), high: F.coalesce("_cut_high", high)}).drop("_cut_low", "_cut_high")
    return limits


def judge(scored: DataFrame, limits: DataFrame) -> DataFrame:
    """Adds perplexities, the bands and the verdict. A band rejects on its own; where there is none, nothing is rejected."""
    t = scored.join(F.broadcast(limits.withColumnRenamed("lang", "band_lang")), F.col("lang") == F.col("band_lang"), "left").drop("band_lang")
    short = SHORT / F.sqrt(F.greatest(F.col("n_model_chars"), F.lit(1)))
    inside = F.lit(True)
    for n in ("", "1"):
        t = t.withColumns({f"perplexity{n}": F.exp(-F.col(f"mean_logp{n}")), f"lower_perplexity{n}": F.exp(F.col(f"low{n}") - short), f"upper_perplexity{n}": F.exp(F.col(f"high{n}") + short)})
        inside = inside & F.coalesce(F.col(f"perplexity{n}").between(F.col(f"lower_perplexity{n}"), F.col(f"upper_perplexity{n}")), F.lit(True))
    t = t.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))
    return t.withColumn("kept", ~F.col("base_failed") & inside)


def quality(docs: DataFrame, labels: DataFrame | None = None, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    scored = score_held_out(docs, max_broadcast)
    return judge(scored, bands(scored, labels))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "perplexity", "lower_perplexity", "upper_perplexity", "perplexity1", "lower_perplexity1", "upper_perplexity1"]
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).select(*cols)
