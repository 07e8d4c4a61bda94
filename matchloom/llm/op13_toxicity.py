"""Operator 13, toxicity by multiple-instance learning: sentence scores from document labels.

A document is a bag of sentences. Each sentence with features has its own probability p = sigmoid(bias + weights of the
features in it), and the document's is the noisy-or 1 - (1 - leak) * prod(1 - p): it is toxic if one sentence is, or by the leak, the
chance of causes that no feature shows, which is one number for all documents (so long texts aren't suspected for their length). Only
documents have labels; the likelihood of the bags alone decides which sentences must be blamed. Sentences that are
blamed are located by their offsets.

Features are windows of 5 to 7 bytes of the folded text, with at most a word's edge at either end, hashed
to ``BUCKETS``: short words, beginnings, ends and insides of words, in any script, so stems with changing ends
are learnt. Spark counts, for each bucket, the toxic and the other training documents that hold it. A sentence that several
documents share belongs to one of them, so a group of copies counts as one document. Buckets that are surely more frequent in toxic documents
(the root of the likelihood ratio is ``MIN_Z`` or more, in ``MIN_DOCS`` documents) become features, the ``MAX_FEATURES`` surest at most: a bound of the model's size.

The fit is L-BFGS on the bags: each evaluation is a Spark job over the written bags, whose tasks return the
likelihood and its gradient, added on the driver (``PARTS`` vectors of at most MAX_FEATURES + 2 numbers). Bags keep only sentences with features.
It is fitted on at most about ``TRAINING_DOCS`` labelled rows, drawn by a hash of the id from the rows that may be learnt from; every text
is scored whole. Labels, language, source and id are never inputs of a score.

Cases: a null or empty text has no sentence, and the leak as its score; a text without end marks is one sentence, of any length; repeated rows get
equal scores; labels that are null, come twice (the larger counts) or have no document are fine; with no label, or one class
only, nothing is learnt and all scores are 0; an empty table gives no rows; other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, table, uniform
from matchloom.llm.textscan import mix, slices, text_buffer

TRAINING_DOCS = 20_000
BUCKETS = 1 << 20
WINDOWS = (5, 6, 7)
MIN_Z, MIN_DOCS, MAX_FEATURES = 4.5, 3, 4096
#: Partitions of the bags, strength of the squared penalty of weights, evaluations of the likelihood.
PARTS, PENALTY, EVALUATIONS = 8, 0.01, 40
#: Log-odds at the start of the fit.
BIAS, LEAK = -4.0, -4.0
THRESHOLD = 0.3
FOLDS, HELD_OUT = 4, 2

#: Letters and digits are folded; everything else parts words.
_WORD = np.zeros(256, np.uint8)
for _c in [*range(48, 58), *range(97, 123), *range(128, 256)]:
    _WORD[_c] = _c
_WORD[65:91] = np.arange(97, 123)
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?\n"]] = True


class Sentences(NamedTuple):
    """Sentences of many texts, in bytes of the joined texts; a sentence has at least one letter or digit."""

    data: np.ndarray
    offs: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray


def sentences(col: pa.Array) -> Sentences:
    """Pieces between end marks or line ends, inside one text."""
    d, offs = text_buffer(col)
    stop = np.flatnonzero(_STOP[d]) + 1
    start = np.unique(np.concatenate([offs[:-1], stop]))
    start = start[start < len(d)]
    end = np.append(start[1:], len(d))[: len(start)]
    words = np.concatenate([[0], np.cumsum(_WORD[d] > 0)])
    has = words[end] > words[start]
    start, end = start[has], end[has]
    return Sentences(d, offs, start, end, np.searchsorted(offs, start, "right") - 1)


def windows(s: Sentences) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, bucket) of every feature window; one may come several times."""
    n = len(s.start)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # sentences with an edge before and after each, so that no window joins two
    size = s.end - s.start + 2
    at = np.concatenate([[0], np.cumsum(size)])
    w = np.zeros(at[-1], np.uint8)
    own = np.repeat(s.start - at[:-1] - 1, size) + np.arange(at[-1])
    inside = np.ones(at[-1], bool)
    inside[at[:-1]] = inside[at[1:] - 1] = False
    w[inside] = _WORD[s.data[own[inside]]]
    edge = np.concatenate([[0], np.cumsum(w == 0)])
    row = np.repeat(np.arange(n, dtype=np.int32), size)
    rows, buckets, h, k = [], [], np.zeros(len(w), np.uint64), 0
    for size in WINDOWS:
        if len(w) < size:
            break
        while k < size:
            h = h[: len(w) - k] * np.uint64(0x100000001B3) + w[k:]
            k += 1
        m = len(w) - size + 1
        # only the first and the last byte may be an edge
        good = edge[size - 1 : size - 1 + m] - edge[1 : m + 1] == 0
        good &= row[:m] == row[size - 1 :]
        at_ = np.flatnonzero(good)
        rows.append(row[at_])
        buckets.append((mix(h[at_] + np.uint64(size)) >> np.uint64(44)).astype(np.int64))
    return (np.concatenate(rows).astype(np.int64), np.concatenate(buckets)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


# --- what is learnt


def _sentence_hashes(s: Sentences) -> np.ndarray:
    """A 64-bit key for each sentence's letters and digits."""
    value = mix(_WORD[s.data].astype(np.uint64) + np.uint64(77))
    value[_WORD[s.data] == 0] = 0
    power = np.full(len(s.data) + 1, 0x9E3779B97F4A7C15, np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value * power[:-1], dtype=np.uint64)])
    inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(len(s.data), pow(0x9E3779B97F4A7C15, -1, 1 << 64), np.uint64)]))
    return mix((c[s.end] - c[s.start]) * inverse[s.start]).view(np.int64)


def _sentence_task(batches) -> Iterator[pa.RecordBatch]:
    """Sentences of training texts: (key, doc, toxic, sentence); ``doc`` is a hash of the text's sentences."""
    for whole in batches:
        for b in slices(whole, "text"):
            s = sentences(b.column(0))
            if not len(s.start):
                continue
            toxic = b.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            key = _sentence_hashes(s)
            doc = np.zeros(b.num_rows, np.uint64)
            np.add.at(doc, s.doc, key.view(np.uint64))
            text = [s.data[i:j].tobytes().decode() for i, j in zip(s.start.tolist(), s.end.tolist(), strict=True)]
            yield pa.record_batch([pa.array(key), pa.array(doc.view(np.int64)[s.doc]), pa.array(toxic[s.doc]), pa.array(text, pa.string())], names=["key", "doc", "toxic", "sentence"])


def _count_task(batches) -> Iterator[pa.RecordBatch]:
    """Documents of both classes that hold a bucket, summed over a partition: (bucket, toxic, other)."""
    n = np.zeros((2, BUCKETS), np.int64)
    for whole in batches:
        for b in slices(whole, "text"):
            toxic, s = b.column(1).to_numpy(zero_copy_only=False), sentences(b.column(0))
            row, bucket = windows(s)
            u = np.unique(s.doc[row] * BUCKETS + bucket)
            for k in (0, 1):
                n[k] += np.bincount(u[toxic[u // BUCKETS] == k] % BUCKETS, minlength=BUCKETS)
    some = np.flatnonzero(n.sum(axis=0))
    for i in range(0, len(some), 50_000):
        at = some[i : i + 50_000]
        yield pa.record_batch([pa.array(at), pa.array(n[1, at]), pa.array(n[0, at])], names=["bucket", "toxic", "other"])


def features(training: DataFrame, min_z: float = MIN_Z, max_features: int = MAX_FEATURES) -> np.ndarray:
    """Buckets whose share of documents is surely larger among toxic ones, surest first. ``training``: (text, toxic)."""
    small_batches(training.sparkSession)
    found = training.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_sentence_task, "key long, doc long, toxic long, sentence string")
    # a sentence of both kinds of documents is no evidence for toxicity
    once = found.groupBy("key").agg(F.min("toxic").alias("toxic"), F.min("doc").alias("doc"), F.first("sentence").alias("sentence"))
    # a training document's own sentences again, at most its text
    docs = materialize(once.groupBy("doc", "toxic").agg(F.array_join(F.collect_list("sentence"), "\n").alias("text")), "training")
    total = docs.agg(F.sum("toxic").alias("t"), F.count(F.lit(1)).alias("n")).first()
    if not total["t"] or total["t"] == total["n"]:
        return np.zeros(0, np.int64)
    t, c = float(total["t"]), float(total["n"] - total["t"])
    counts = docs.select("text", "toxic").mapInArrow(_count_task, "bucket long, toxic long, other long").groupBy("bucket").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    a, n, q = F.col("a"), F.col("a") + F.col("b"), t / (t + c)
    other = F.when(F.col("b") > 0, F.col("b") * F.log(F.col("b") / (n * (1 - q)))).otherwise(F.lit(0.0))
    z = F.sqrt(F.greatest(2 * (a * F.log(a / (n * q)) + other), F.lit(0.0)))
    best = counts.filter((a >= MIN_DOCS) & (a > n * q)).select("bucket", z.alias("z")).filter(F.col("z") >= min_z).orderBy(F.desc("z"), "bucket").limit(max_features)
    return np.array([r["bucket"] for r in best.collect()], np.int64)


def active(s: Sentences, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sentence, feature), once each, ascending. ``place``: the feature of each bucket, or -1."""
    row, bucket = windows(s)
    f = place[bucket]
    hit = f >= 0
    k = int(place.max(initial=0)) + 1
    u = np.unique(row[hit] * k + f[hit])
    return u // k, u % k


def _places(chosen: np.ndarray) -> np.ndarray:
    place = np.full(BUCKETS, -1, np.int64)
    place[chosen] = np.arange(len(chosen))
    return place


def _bag_task(chosen: np.ndarray):
    def run(batches) -> Iterator[pa.RecordBatch]:
        place = _places(chosen)
        for whole in batches:
            for b in slices(whole, "text"):
                s = sentences(b.column(0))
                row, f = active(s, place)
                n = b.num_rows
                rows, first = np.unique(row, return_index=True)
                inner = pa.ListArray.from_arrays(pa.array(np.append(first, len(row)), pa.int32()), pa.array(f, pa.int32()))
                outer = pa.ListArray.from_arrays(pa.array(np.searchsorted(s.doc[rows], np.arange(n + 1)), pa.int32()), inner)
                yield pa.record_batch([b.column(1), outer], names=["toxic", "hot"])

    return run


def noisy_or(doc: np.ndarray, z: np.ndarray, bags: int, leak: float) -> np.ndarray:
    """log(1 - P) of each bag from the sentences' log-odds ``z``, their bags ``doc`` and the leak's log-odds."""
    return -np.logaddexp(0, leak) - np.bincount(doc, weights=np.logaddexp(0, z), minlength=bags)


def sigmoid(z):
    return 1 / (1 + np.exp(-z))


def _gradient_task(w: np.ndarray):
    """Minus the log likelihood of a partition's bags, and its gradient; bias and leak are last."""

    def run(batches) -> Iterator[pa.RecordBatch]:
        loss, grad = 0.0, np.zeros(len(w))
        for b in batches:
            hot = b.column(1)
            doc, sent = hot.value_parent_indices().to_numpy(zero_copy_only=False), hot.flatten()
            row, f = sent.value_parent_indices().to_numpy(zero_copy_only=False), sent.flatten().to_numpy(zero_copy_only=False)
            y = b.column(0).to_numpy(zero_copy_only=False)
            z = w[-2] + np.bincount(row, weights=w[f], minlength=len(sent))
            spared = noisy_or(doc, z, len(y), w[-1])
            # P = 1 - exp(spared), kept off 0
            hit = np.maximum(-np.expm1(spared), 1e-12)
            loss -= float(np.sum(np.where(y > 0, np.log(hit), spared)))
            # d loss / d z of a sentence is its p times this
            pull = np.where(y > 0, -np.exp(spared) / hit, 1.0)
            gz = sigmoid(z) * pull[doc]
            grad[:-2] += np.bincount(f, weights=gz[row], minlength=len(w) - 2)
            grad[-2:] += gz.sum(), pull.sum() * sigmoid(w[-1])
        yield pa.record_batch([pa.array([loss]), pa.array([grad])], names=["loss", "grad"])

    return run


def minimize(evaluate, w: np.ndarray, evaluations: int, memory: int = 8) -> np.ndarray:
    """L-BFGS with halved steps; ``evaluate(w)`` gives the loss and its gradient."""
    loss, g = evaluate(w)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    step, used = 1.0 / max(1.0, float(np.abs(g).max())), 1
    while used < evaluations and np.abs(g).max() > 1e-4:
        d, sums = -g, []
        for s, y in reversed(past):
            a = s @ d / (s @ y)
            sums.append(a)
            d = d - a * y
        if past:
            s, y = past[-1]
            d = d * (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(sums), strict=True):
            d = d + s * (a - y @ d / (s @ y))
        t = step if not past else 1.0
        while used < evaluations:
            new, g_new = evaluate(w + t * d)
            used += 1
            if new <= loss + 1e-4 * t * (g @ d):
                break
            t /= 4
        else:
            return w
        s, y = t * d, g_new - g
        if s @ y > 1e-10:
            past = [*past, (s, y)][-memory:]
        done = loss - new < 1e-7 * abs(loss)
        w, loss, g = w + t * d, new, g_new
        if done:
            break
    return w


class Model(NamedTuple):
    chosen: np.ndarray
    weights: np.ndarray  # bias and leak are last


def fit(training: DataFrame, penalty: float = PENALTY, evaluations: int = EVALUATIONS, min_z: float = MIN_Z) -> Model | None:
    """The model of labelled texts (text, toxic); None where nothing tells the classes apart."""
    chosen = features(training, min_z)
    if not len(chosen):
        return None
    bags = training.select("text", F.col("toxic").cast("int").alias("toxic")).mapInArrow(_bag_task(chosen), "toxic int, hot array<array<int>>")
    bags = materialize(bags.coalesce(PARTS), "bags")
    n = bags.count()

    def evaluate(w: np.ndarray) -> tuple[float, np.ndarray]:
        parts = bags.coalesce(PARTS).mapInArrow(_gradient_task(w), "loss double, grad array<double>").collect()
        own = w[:-2]
        grad = np.sum([np.array(r["grad"]) for r in parts], axis=0)
        return (sum(r["loss"] for r in parts) + penalty * float(own @ own)) / n, (grad + np.append(2 * penalty * own, [0.0, 0.0])) / n

    start = np.append(np.full(len(chosen), 0.1), [BIAS, LEAK])
    return Model(chosen, minimize(evaluate, start, evaluations))


# --- what is scored


def sentence_scores(s: Sentences, model: Model, place: np.ndarray) -> np.ndarray:
    """Log-odds of every sentence; minus infinity without features."""
    row, f = active(s, place)
    z = np.full(len(s.start), -np.inf)
    some = np.unique(row)
    z[some] = model.weights[-2] + np.bincount(row, weights=model.weights[f], minlength=len(z))[some]
    return z


def _score_task(model: Model | None):
    def run(batches) -> Iterator[pa.RecordBatch]:
        place = _places(model.chosen) if model else None
        for whole in batches:
            for b in slices(whole, "text"):
                n, s = b.num_rows, sentences(b.column(1))
                z = sentence_scores(s, model, place) if model else np.full(len(s.start), -np.inf)
                spared = noisy_or(s.doc, z, n, model.weights[-1] if model else -np.inf)
                worst = np.full(n, -1)
                order = np.lexsort((-np.arange(len(z)), z))  # the last of a text is its largest, the first one of ties
                order = order[z[order] > -np.inf]
                worst[s.doc[order]] = order
                some = np.flatnonzero(worst >= 0)
                chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])

                def of_worst(v: np.ndarray) -> pa.Array:
                    out = np.zeros(n, v.dtype)  # noqa: B023
                    out[some] = v[worst[some]]  # noqa: B023
                    return pa.array(out, mask=worst < 0)  # noqa: B023

                first = chars[s.offs[s.doc]]
                yield pa.record_batch([b.column(0), pa.array(-np.expm1(spared)), pa.array(np.bincount(s.doc, minlength=n)), of_worst(sigmoid(z)), of_worst(chars[s.start] - first), of_worst(chars[s.end] - first)], names=["doc_id", "score", "n_sentences", "worst_score", "worst_start", "worst_end"])

    return run


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, n_sentences, worst_score, worst_start, worst_end): the worst sentence by code points, end exclusive; null if no sentence has a feature."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, score double, n_sentences long, worst_score double, worst_start long, worst_end long"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score_task(model), schema)


def _locate_task(model: Model, threshold: float):
    def run(batches) -> Iterator[pa.RecordBatch]:
        place = _places(model.chosen)
        for whole in batches:
            for b in slices(whole, "text"):
                s = sentences(b.column(1))
                p = sigmoid(sentence_scores(s, model, place))
                bad = np.flatnonzero(p >= threshold)
                chars = np.concatenate([[0], np.cumsum((s.data & 0xC0) != 0x80)])
                first = chars[s.offs[s.doc[bad]]]
                text = [s.data[i:j].tobytes().decode() for i, j in zip(s.start[bad].tolist(), s.end[bad].tolist(), strict=True)]
                yield pa.record_batch([b.column(0).take(pa.array(s.doc[bad])), pa.array(chars[s.start[bad]] - first), pa.array(chars[s.end[bad]] - first), pa.array(p[bad]), pa.array(text, pa.string())], names=["doc_id", "start", "end", "score", "sentence"])

    return run


def locate(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, start, end, score, sentence) of every sentence that is blamed."""
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_locate_task(model, threshold), "doc_id long, start long, end long, score double, sentence string")


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, max_docs: int = TRAINING_DOCS) -> DataFrame:
    """(text, toxic) of labelled documents that may be learnt from, at most about ``max_docs``."""
    known = labels.filter("doc_id is not null and toxic is not null").filter(~held_out("doc_id")).groupBy(F.col("doc_id").alias("label_id")).agg(F.max("toxic").alias("toxic"))
    share = min(1.0, max_docs / max(known.count(), 1))
    sample = known.filter(uniform("toxic", "label_id") < share)
    # about max_docs rows: a bounded table
    return materialize(docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("text", "toxic"), "labelled")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(training_rows(docs, table(spark, sf_dir, "labels")))
    return score(docs, model).select("doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_sentences", "worst_score", "worst_start", "worst_end")
