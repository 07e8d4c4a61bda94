"""Operator 7, personal data: candidate spans, boosted trees and calibrated thresholds.

Base kinds (email, ip, card, phone) are exact patterns with checks and always stay. High-recall
generators propose further, overlapping spans: any token with a digit, up to the white space around
it, and its parts between quotes; runs of numbers; values after words like "password", up to white
space or a quote; spelled-out addresses; dates with a month's name. Tokens and values have any length. Runs start at every
number and hold at most ``RUN_DIGITS`` digits, the most that a standard number has (an IBAN); the
whole run is proposed too. Each span gets format and context features, among them how near a word
stands that names a secret, a contact, an id or a birth (``NAMES``, in the corpus's languages), and whether the number goes on outside the span.
Gradient-boosted trees (Spark ML) learn from weak labels: spans that pass a base kind's check, follow a secret's name,
or are spelled-out addresses are positive; digits that fail every check, versions and counts are
negative; other spans have no label. Each training text also lends some of its words to examples, since a corpus may hold
few of them (``examples``): everyday numbers and dates (negative), keys, short passwords, local phone numbers, ids and dates of birth
(positive, those that only their context tells apart with a name before them and, as negatives, without one).

Calibration: on a held-out quarter, isotonic regression maps the trees' scores to the share of positives, for each kind of span; a kind's threshold is the
lowest score whose calibrated chance is ``CHANCE``. Kinds with under ``FEW`` held-out rows use the curve of all kinds. Selected spans don't overlap each other or a base span;
a selected secret is never a part of another one that would be selected.

Training reads whole texts of all documents, as everything else does; equal rows (features, kind, label) are one row with a weight, so trees and
curves count all of them. Cases: null counts as empty (no spans); very long texts are scanned
whole, with spans kept in sorted lists; spans that tie in probability are taken longest first; an empty table or one
with no positive or no negative candidate gets base spans only; repeated rows get equal results;
``redact`` keeps all other columns, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from bisect import bisect_left, insort
from collections import Counter
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches, table

#: Calibrated chance that a selected span needs; held-out rows that a kind's own curve needs.
CHANCE, FEW = 0.5, 50
TREES, DEPTH = 20, 4
RUN_DIGITS = 34
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "contact", "number", "date")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")
_BREAK = " \t\n\r\x0b\x0c"
_TOKEN = re.compile(r"[^ \t\n\r\x0b\x0c]*")
_UNQUOTED = re.compile(r"[^\"']+")
_SECRET_NAME = re.compile(r"(?:password|passwd|pwd|token|secret|api[_ ]?key)[\"']?\s*[:=]\s*[\"']?([^\s\"']{6,})", re.I)
#: Words that announce personal data (fixed values).
NAMES = {
    "secret": "password|passwd|passcode|passphrase|passwort|pwd|contraseña|mot de passe|token|secret|api[_ -]?key|key|pin",
    "contact": "phone|telephone|tel|call|cell|mobile|mobil|fax|telefon|teléfono|téléphone|handy|whatsapp|contact|reach|ring",
    "id": "ssn|social security|national insurance|insurance|passport|passeport|pasaporte|ausweis|nif|nie|dni|cpf|nino|tax id|national id|id number|id no|iban|account|konto|licence|license",
    "birth": "born|birth|dob|birthday|geboren|geb|né|née|nacido|nacida|naissance|nacimiento",
}
_NAMED = [re.compile(rf"(?:^|[\W_])(?:{x})s?(?:[\W_]+(?:is|no|number|nr|nummer|numéro|número|on|le|el|am|the|code|security|insurance|date|of|me|us))*[\W_]*$", re.I) for x in NAMES.values()]
_NEAR = [re.compile(rf"(?:^|[\W_])(?:{x})[\W_]", re.I) for x in NAMES.values()]
#: An id after its name: letters and digits in groups.
_ID = re.compile(rf"(?:^|(?<=[\W_]))(?:{NAMES['id']})(?:[\W_]+(?:is|no|number|nr|nummer|número|security|insurance))*[\W_]+((?=[A-Z0-9 .-]*[0-9])[A-Z0-9]+(?:[ .-][A-Z0-9]+){{0,8}})(?![A-Za-z0-9])", re.I)
_DATE = re.compile(r"(?<![0-9])[0-9]{1,2}(?:st|nd|rd|th|\.)? (?:of |de )?[^\W\d_]{3,10}\.?,?(?: de)? [0-9]{4}(?![0-9])|(?<![^\W\d_])[^\W\d_]{3,10} [0-9]{1,2}(?:st|nd|rd|th)?,? [0-9]{4}(?![0-9])")
_SPELLED = re.compile(r"[A-Za-z0-9._+-]{2,40} ?[\[(]at[\])] ?[A-Za-z0-9-]{2,40}(?: ?[\[(]dot[\])] ?[A-Za-z0-9-]{2,20})+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 if d > 4 else d * 2
        total += d
    return total % 10 == 0


def _only_digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(t: str) -> list[tuple[int, int, str]]:
    """Spans of the base kinds, by start and kind."""
    out = []
    if "@" in t:
        done, at, before = 0, t.find("@"), -1
        while at >= 0:
            left = max(done, before + 1)
            m = _LOCAL.match(t[left:at][::-1])
            if m and (d := _DOMAIN.match(t, at + 1)):
                out.append((at - m.end(), d.end(), "email"))
                done = d.end()
            before, at = at, t.find("@", at + 1)
    if _DIGIT.search(t):
        out += [(m.start(), m.end(), "ip") for m in _IP.finditer(t) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(t):
            if m.end() - m.start() >= 14:
                d = _only_digits(m.group())
                if 14 <= len(d) <= 19 and luhn(d):
                    out.append((m.start(), m.end(), "card"))
        if "+" in t:
            out += [(m.start(), m.end(), "phone") for m in _PHONE.finditer(t) if 10 <= len(_only_digits(m.group())) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def candidates(t: str) -> list[tuple[int, int, str]]:
    """Proposed spans (start, end, kind), overlapping."""
    out = set()
    last = 0
    run: list[tuple[int, int, int]] = []  # start, end and digits of each number
    for m in _DIGIT.finditer(t):
        if m.start() < last:
            continue
        s, e = m.start(), _TOKEN.match(t, m.end()).end()
        while s > last and t[s - 1] not in _BREAK:
            s -= 1
        last = e
        a, b = s, e
        while b > a and t[b - 1] in ".,;:!?\"')":
            b -= 1
        while a < b and t[a] in "\"'(":
            a += 1
        letters = any(c.isalpha() for c in t[a:b])
        out.add((a, b, "secret" if letters else "number"))
        if letters and ('"' in t[a:b] or "'" in t[a:b]):
            out.update((p.start(), p.end(), "secret") for p in _UNQUOTED.finditer(t, a, b) if _DIGIT.search(p.group()))
        if run and (letters or run[-1][1] + 1 != s):
            out.add((run[0][0], run[-1][1], "number"))
            run = []
        if not letters:
            run.append((s if run else a, b, len(_only_digits(t[a:b]))))
            n = 0
            for x, _, digits in reversed(run):
                n += digits
                if n > RUN_DIGITS:
                    break
                out.add((x, b, "number"))
    if run:
        out.add((run[0][0], run[-1][1], "number"))
    if "=" in t or ":" in t:
        out.update((m.start(1), m.end(1), "secret") for m in _SECRET_NAME.finditer(t))
    if out:
        out.update((m.start(), m.end(), "date") for m in _DATE.finditer(t))
        for m in _ID.finditer(t):  # words may follow: the groups end with the last one that has a digit, or a letter after it
            groups = list(re.finditer(r"[^ .-]+", m[1]))
            k = max((i for i, g in enumerate(groups) if _DIGIT.search(g[0])), default=-1)  # the digit may stand behind the groups that matched
            if k < 0:
                continue
            out.update((m.start(1), m.start(1) + groups[j].end(), "number") for j in (k, k + 1) if j == k or (j < len(groups) and len(groups[j][0]) == 1))
    if "at]" in t or "at)" in t or "AT]" in t or "AT)" in t:
        out.update((m.start(), m.end(), "contact") for m in _SPELLED.finditer(t))
    return sorted(out)


FEATURES = (
    "length", "digits", "letters", "uppers", "others", "spaces", "dots", "dashes", "slashes", "entropy", "luhn", "max_part", "parts", "first_part", "last_part", "year",
    *(f"named_{k}" for k in NAMES), "quoted", "plus", "line_start", "word_before", "class_changes", "goes_on", "came_on", "dictionary_like",
)


def features(t: str, s: int, e: int) -> list[float]:
    x = t[s:e]
    digits = _only_digits(x)
    n = len(x)
    counts = Counter(x)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    kinds = ["d" if "0" <= c <= "9" else "u" if c.isupper() else "l" if c.isalpha() else "o" for c in x]
    parts = [p for p in re.split(r"[^0-9]+", x) if p]
    before, after = t[max(0, s - 30) : s], t[e : e + 3]
    named = [2 if direct.search(before) else 1 if near.search(before) else 0 for direct, near in zip(_NAMED, _NEAR, strict=True)]
    year = any(len(p) == 4 and 1900 <= int(p) <= 2039 for p in parts)
    goes_on, came_on = re.match(r"[ ./()-]{0,2}[0-9]", after), re.search(r"[0-9][ ./()-]{0,2}$", before)
    return [
        float(v)
        for v in (
            n, len(digits), sum(k in "ul" for k in kinds), kinds.count("u"), kinds.count("o"), x.count(" "), x.count("."), x.count("-"), x.count("/"), entropy, len(digits) > 12 and luhn(digits), max(map(len, parts), default=0), len(parts), len(parts[0]) if parts else 0, len(parts[-1]) if parts else 0, year,
            *named, t[s - 1 : s] in ('"', "'") if s else False, "+" in x or before.endswith("+"), s == 0 or t[s - 1] == "\n", bool(re.search(r"[^\W\d]{2,}[ ,.]*$", before)), sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)), goes_on is not None, came_on is not None, not digits and x.islower() and x.isalpha(),
        )
    ]


def weak_label(t: str, s: int, e: int, base: list[tuple[int, int, str]]) -> int | None:
    """1 or 0 where a high-precision rule speaks, else None."""
    x = t[s:e]
    if _SPELLED.fullmatch(x):
        return 1
    if any(a < e and s < b for a, b, _ in base):
        return 1 if any(a <= s + 1 and e - 1 <= b for a, b, _ in base) else None
    if any(m.start(1) <= s and e <= m.end(1) for m in _SECRET_NAME.finditer(t, max(0, s - 40), min(len(t), e + 2))):
        return 1
    if re.fullmatch(r"v?[0-9]{1,4}(?:\.[0-9]{1,3}){0,2}%?", x) or re.fullmatch(r"[0-9]{1,3}(?:,[0-9]{3})+", x):
        return 0
    if re.fullmatch(r"[0-9 .-]+", x) and not 7 <= len(_only_digits(x)) <= 19:
        return 0
    return None


_LETTERS = "abcdefghijklmnopqrstuvwxyz"


def examples(t: str) -> list[tuple[str, str, float]]:
    """Made-up spans for the words of a text: (words before it, value, label). The same text draws the same."""
    r = random.Random(crc32(t.encode()))
    n, mixed = r.randrange, _LETTERS + _LETTERS.upper() + "0123456789" * 2
    key = lambda chars, k: "".join(r.choices(chars, k=k))
    one = lambda *ways: r.choice(ways)()
    digits = lambda k: key("0123456789", k)
    word = key(_LETTERS, n(4, 9))
    common = lambda: one(lambda: f"{n(1900, 2100)}", lambda: f"{n(1, 1000)}", lambda: f"{n(24)}:{n(60):02}", lambda: f"{n(10000) / 100}", lambda: f"{n(1000, 10**7):,}", lambda: f"v{n(10)}.{n(30)}.{n(10)}", lambda: f"{n(101)}%", lambda: f"${n(1, 10**6):,}.{n(100):02}", lambda: f"{n(1, 100)}th", lambda: f"{n(1, 500)}{r.choice(['kg', 'px', 'km', 'nd', 'x', 'GB'])}", lambda: f"{r.choice(_LETTERS).upper()}{n(1, 99)}", lambda: f"{key(_LETTERS, n(3, 9))}{n(1, 99)}", lambda: f"{key(_LETTERS, 5).upper()}-{n(1, 99)}", lambda: f"{n(10000, 99999)}")
    secret = lambda: one(lambda: key(mixed, n(16, 65)), lambda: key("0123456789abcdef", r.choice([32, 40, 64])), lambda: f"{key(_LETTERS, 2)}-{key(mixed, n(20, 49))}", lambda: ".".join(key(mixed + "-_", n(20, 90)) for _ in range(3)), lambda: f"{key(_LETTERS, 2).upper()}{n(10, 99)}" + "".join(f" {n(1000, 10000)}" for _ in range(4)))
    month = r.choice(["January", "March", "May", "August", "Oktober", "mars", "junio", "Dezember"])
    date = lambda: one(lambda: f"{n(1, 32)}/{n(1, 13)}/{n(1930, 2015)}", lambda: f"{n(1930, 2015)}-{n(1, 13):02}-{n(1, 32):02}", lambda: f"{n(1, 32):02}.{n(1, 13):02}.{n(1930, 2015)}", lambda: f"{n(1, 29)} {month} {n(1930, 2015)}", lambda: f"{month} {n(1, 29)}, {n(1930, 2015)}")
    phone = lambda: one(lambda: f"0{digits(2)} {digits(4)} {digits(4)}", lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"{digits(3)}.{digits(3)}.{digits(4)}", lambda: f"{digits(3)}-{digits(3)}-{digits(4)}", lambda: f"0{digits(4)} {digits(6)}", lambda: f"0{digits(1)}" + "".join(f" {digits(2)}" for _ in range(4)), lambda: f"0{digits(9)}", lambda: f"[{digits(3)}] {digits(3)} {digits(4)}", lambda: r.choice(" .-").join(digits(r.choice([2, 2, 3, 4])) for _ in range(4)), lambda: f"({digits(3)}) {digits(n(5, 9))}", lambda: f"{digits(3)} {digits(n(5, 8))}")
    number = lambda: one(lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", lambda: f"{key(_LETTERS, 2).upper()} {digits(2)} {digits(2)} {digits(2)} {key(_LETTERS, 1).upper()}", lambda: f"{digits(8)}{key(_LETTERS, 1).upper()}", lambda: f"{digits(9)}", lambda: f"{key(_LETTERS, 1).upper()}{digits(8)}", lambda: f"{digits(3)}.{digits(3)}.{digits(3)}-{digits(2)}")
    password = lambda: one(lambda: f"{word}{digits(n(1, 5))}", lambda: f"{word.title()}{n(10)}{r.choice('!?#')}", lambda: f"{word}{digits(1)}{key(_LETTERS, n(2, 6))}", lambda: "".join({"o": "0", "e": "3", "a": "4", "i": "1"}.get(c, c) for c in word).title() + digits(1), lambda: key(mixed + "!#_-", n(6, 14)), lambda: digits(n(4, 9)))
    name = lambda kind: r.choice([x for x in NAMES[kind].split("|") if "[" not in x])
    named = lambda kind: r.choice([str, str.title, str.upper])(name(kind)) + r.choice([" ", ": ", " = ", ":", " is ", ". ", " no. "])
    kind, form = r.choice([("secret", password), ("secret", password), ("contact", phone), ("id", number), ("birth", date)])
    out = [("", common(), 0.0), ("", secret(), 1.0), (named(kind), sure := form(), 1.0)]
    if kind == "secret":
        out += [(named("secret"), one(lambda: key(_LETTERS, n(3, 10)), lambda: "required", lambda: "none"), 0.0), ("", f"{word}{n(1, 99)}", 0.0)]
    elif kind == "birth":
        out.append((r.choice(["", "on ", "since ", "until ", "am ", "le ", "el "]), sure, 0.0))
    return out


def _training_task(batches):
    for b in batches:
        rows, labels, kinds = [], [], []

        def learn(t: str, s: int, e: int, kind: str, y: float) -> None:
            rows.append(features(t, s, e))  # noqa: B023
            labels.append(y)  # noqa: B023
            kinds.append(kind)  # noqa: B023

        for text in b.column(0):
            words = (text.as_py() or "").split()
            for i, (before, value, y) in enumerate(examples(" ".join(words))):
                at = (crc32(value.encode()) + i) % max(1, len(words) - 8)
                left, right = " ".join(words[at : at + 5]), " ".join(words[at + 5 : at + 8])
                around = f"{left} {before}{value} {right}"
                s0 = len(left) + 1 + len(before)
                e0, base = s0 + len(value), base_spans(around)
                for s, e, kind in candidates(around):
                    if s0 <= s and e <= e0 and not any(a < e and s < z for a, z, _ in base):
                        learn(around, s, e, kind, y if (s, e) == (s0, e0) else 0.0)
        for text in b.column(0):
            t = text.as_py() or ""
            base = base_spans(t)
            for s, e, kind in candidates(t):
                if (y := weak_label(t, s, e, base)) is not None:
                    learn(t, s, e, kind, float(y))
        yield pa.record_batch([pa.array(rows, pa.list_(pa.float64())), pa.array(labels, pa.float64()), pa.array(kinds, pa.string())], names=["x", "label", "kind"])


def isotonic(bins: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool adjacent violators: (score, positives, rows) by rising score to (score, calibrated chance), which never falls."""
    blocks: list[list[float]] = []
    for score, good, n in bins:
        blocks.append([score, good, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            _, good, n = blocks.pop()
            blocks[-1][1] += good
            blocks[-1][2] += n
    return [(score, good / n) for score, good, n in blocks]


def thresholds(held: list[tuple[str, float, float, float]], chance: float = CHANCE, few: int = FEW) -> dict[str, float]:
    """The lowest score of each kind whose calibrated chance is ``chance``. ``held``: (kind, score, positives, rows)."""

    def lowest(rows):
        sums: dict[float, list[float]] = {}
        for _, score, good, n in rows:
            x = sums.setdefault(score, [0.0, 0.0])
            x[0] += good
            x[1] += n
        curve = isotonic([(score, *sums[score]) for score in sorted(sums)])
        return next((score for score, p in curve if p >= chance), 2.0)

    every = lowest(held)
    out = {}
    for kind in KINDS:
        own = [x for x in held if x[0] == kind]
        out[kind] = lowest(own) if sum(x[3] for x in own) >= few else every
    return out


def _tree(node) -> tuple:
    """A Spark ML tree as nested tuples: (feature, threshold, left, right) or a leaf's value."""
    if node.getClass().getSimpleName() == "LeafNode":
        return (float(node.prediction()),)
    split = node.split()
    return (int(split.featureIndex()), float(split.threshold()), _tree(node.leftChild()), _tree(node.rightChild()))


def train(docs: DataFrame) -> dict | None:
    """Trees, their weights and each kind's threshold; None where the documents can't teach anything."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    small_batches(docs.sparkSession)
    rows = docs.select("text").mapInArrow(_training_task, "x array<double>, label double, kind string").groupBy("x", "label", "kind").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = materialize(rows.withColumn("held", F.pmod(F.xxhash64(F.col("x")), F.lit(4)) == 0), "pii").withColumn("features", array_to_vector("x"))
    fit, held = rows.filter("not held"), rows.filter("held")
    if fit.select("label").distinct().count() < 2:
        return None
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, seed=7, checkpointInterval=-1, weightCol="n").fit(fit)
    seen = model.transform(held).select("kind", "label", "n", F.floor(vector_to_array("probability")[1] * 200).alias("bin")).groupBy("kind", "bin").agg(F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    # at most 201 rows a kind
    return {"trees": [_tree(t._call_java("rootNode")) for t in model.trees], "weights": list(model.treeWeights), "thresholds": thresholds([(x["kind"], x["bin"] / 200, x["good"], x["n"]) for x in seen])}


def probability(model: dict, x: list[float]) -> float:
    margin = 0.0
    for w, node in zip(model["weights"], model["trees"], strict=True):
        while len(node) > 1:
            node = node[2] if x[node[0]] <= node[1] else node[3]
        margin += w * node[0]
    return 1 / (1 + math.exp(-2 * margin))


def _free(taken: list[tuple[int, int]], s: int, e: int) -> bool:
    """Whether (s, e) meets none of ``taken``, which are sorted and don't overlap."""
    i = bisect_left(taken, (e,))
    return i == 0 or taken[i - 1][1] <= s


def spans(t: str, model: dict | None) -> tuple[list, list]:
    """Base spans, and those with the method's own, by start and kind."""
    base = base_spans(t)
    chosen: list[tuple[int, int, str]] = list(base)
    if model:
        taken: list[tuple[int, int]] = []  # without overlaps
        for a, b, _ in base:
            if taken and a < taken[-1][1]:
                taken[-1] = (taken[-1][0], max(b, taken[-1][1]))
            else:
                taken.append((a, b))
        scored, reach = [], -1
        for s, e, kind in sorted(candidates(t), key=lambda x: (x[0], -x[1])):
            if e > s and not (kind == "secret" and e <= reach) and _free(taken, s, e) and (p := probability(model, features(t, s, e))) >= model["thresholds"][kind]:
                scored.append((-p, s - e, s, e, kind))
                reach = max(reach, e) if kind == "secret" else reach
        own: list[tuple[int, int, str]] = []
        for _, _, s, e, kind in sorted(scored):
            if _free(taken, s, e):
                insort(taken, (s, e))
                own.append((s, e, kind))
        chosen += own
    return base, sorted(chosen, key=lambda x: (x[0], KINDS.index(x[2]), x[1]))


def join_spans(found: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in found)


def _find_task(shared):
    def run(batches):
        model = shared.value
        for b in batches:
            counts: dict[str, list] = {k: [] for k in BASE_KINDS}
            sha, every = [], []
            for text in b.column(1):
                base, chosen = spans(text.as_py() or "", model)
                for k in BASE_KINDS:
                    counts[k].append(sum(x[2] == k for x in base))
                sha.append(hashlib.sha256(join_spans(base).encode()).hexdigest())
                every.append(join_spans(chosen))
            yield pa.record_batch([b.column(0), *[pa.array(c, pa.int64()) for c in counts.values()], pa.array(sha, pa.string()), pa.array(every, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE_KINDS], "base_sha256", "spans"])

    return run


def find(docs: DataFrame, model: dict | None) -> DataFrame:
    """Counts, digest and all spans of every text."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.select("doc_id", "text").mapInArrow(_find_task(shared), "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(t: str | None, model: dict | None) -> str | None:
    if not t:
        return t
    out, at = [], 0
    for s, e, kind in spans(t, model)[1]:
        if e <= at:
            continue
        out.append(t[at : max(s, at)])
        out.append(f"<{kind.upper()}>")
        at = e
    return "".join(out) + t[at:]


def _redact_task(shared, at: int):
    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array([masked(t.as_py(), shared.value) for t in cols[at]], pa.string())
            yield pa.record_batch(cols, names=b.schema.names)

    return run


def redact(docs: DataFrame, model: dict | None) -> DataFrame:
    """The same rows with each span in ``text`` replaced by its kind."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return docs.mapInArrow(_redact_task(shared, docs.columns.index("text")), docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return find(docs, train(docs))
