"""Operator 2, license scans: exact set-similarity join of text blocks with license templates.

A block is a window of consecutive words of the whole text, over line ends, as long as the template's
text over ``THRESHOLD``; its set holds its distinct words (runs of 0-9, a-z and characters beyond ASCII,
with A-Z lower-cased). A block meets a template if it holds at least ``THRESHOLD`` of the template's
distinct words; of templates under ``SHORT`` distinct words, all. So a notice wrapped at any width is
found, and words scattered over a long text are not one. Words are ordered by their global frequency
over all documents, rarest first. For a template of n words that needs c of them:

* prefix filter: a block that meets it holds one of its first n - c + 1 words. Blocks are looked for
  only around places of such words, in documents that hold any;
* length filter: the words around such a place hold at least c of the template's;
* positional filter: a block is counted at the place of the rarest word it holds. If that is the
  template's i-th (from 0), only words from the i-th on count, at most n - i.

The join on prefix words is a lookup in the templates' table, an array of rows in the plan whose size is
fixed by the templates. Windows around a place are then counted exactly. Base phrases are consecutive
words, found and counted in the whole normalised text.

All of it is built-in functions: no Python runs on rows, and no text is shuffled. Cases: null counts as
an empty text; repeated rows and ties get equal results; very long texts are scanned whole; an empty
table gives no rows; other columns than doc_id and text are not read, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import table

#: Consecutive words and their label.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Openings and paragraphs of public license notices, in words (fixed values).
TEMPLATES = (
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("gpl-notice", "this work is licensed under the gnu general public license version 3"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
)
THRESHOLD, SHORT = 0.8, 8
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """Words of a text, each after one space, with a space at the end; one space if there is none. Case stays."""
    return F.regexp_replace(F.concat(F.lit(" "), F.coalesce(text, F.lit("")), F.lit(" ")), _GAP, " ")


def _spaces(c: Column) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))


def lower(c: Column) -> Column:
    return F.translate(c, _UP, _LOW)


def vocabulary(templates=TEMPLATES) -> list[str]:
    return sorted({w for _, t in templates for w in t.split()})


def frequencies(docs: DataFrame, words: list[str]) -> dict[str, int]:
    """Places of each template word in all texts; as many rows as the templates have words."""
    found = docs.select(F.explode(F.split(lower(normal(F.col("text"))), " ")).alias("w")).filter(F.col("w").isin(words))
    rows = found.groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return {w: 0 for w in words} | {r["w"]: r["n"] for r in rows.collect()}


def ordered(templates, freq: dict[str, int], threshold: float = THRESHOLD) -> list[dict]:
    """Each template's words, rarest first, how many a block needs, the prefix and the words of a block."""
    out = []
    for label, text in templates:
        words = sorted(set(text.split()), key=lambda w: (freq.get(w, 0), w))
        need = len(words) if len(words) < SHORT else math.ceil(threshold * len(words) - 1e-9)
        out.append({"label": label, "words": words, "need": need, "prefix": words[: len(words) - need + 1], "span": math.ceil(len(text.split()) / threshold - 1e-9)})
    return out


def _phrases(docs: DataFrame) -> DataFrame:
    """Adds the base columns and the normalised text ``_norm``."""
    any_phrase = r"(?i) (?:" + "|".join(p for p, _ in BASE) + r")(?= )"
    t = docs.select("doc_id", "text", normal(F.col("text")).alias("_norm"))
    t = t.withColumn("n_words", (_spaces(F.col("_norm")) - 1).cast("long"))
    t = t.withColumn("_hit", F.regexp_extract_all("_norm", F.lit(any_phrase), F.lit(0)))
    t = t.withColumn("n_base", F.size("_hit").cast("long"))
    gaps = F.when(F.col("n_base") > 0, F.split("_norm", any_phrase))
    # words before the first phrase, and after the last one
    first = _spaces(F.get(gaps, F.lit(0)))
    last = F.col("n_words") - (_spaces(F.element_at(gaps, -1)) - 1) - _spaces(F.element_at("_hit", -1))
    t = t.withColumn("first_word", F.when(F.col("n_base") > 0, first).cast("long")).withColumn("last_word", F.when(F.col("n_base") > 0, last).cast("long"))
    names = F.create_map(*[x for p, label in BASE for x in (F.lit(" " + p), F.lit(label))])
    labels = F.array_sort(F.array_distinct(F.transform("_hit", lambda h: names[lower(h)])))
    return t.withColumn("_base", F.when(F.col("n_base") > 0, labels).otherwise(F.array().cast("array<string>"))).drop("_hit")


def _table(order: list[dict]) -> Column:
    """The templates as an array of rows."""
    strings = lambda xs: F.array(*[F.lit(x) for x in xs])
    row = lambda x: F.struct(F.lit(x["label"]).alias("label"), strings(x["words"]).alias("words"), strings(x["prefix"]).alias("prefix"), F.lit(len(x["words"])).alias("n"), F.lit(x["need"]).alias("need"), F.lit(x["span"]).alias("span"))
    return F.array(*map(row, order))


def _most(words: Column, at: Column, t: Column) -> Column:
    """The most words of template ``t`` in a block around place ``at``, among those no rarer than the word there; 0 under its need."""
    i = F.array_position(t["words"], F.get(words, at)).cast("int")
    rest = F.slice(t["words"], i, t["n"] - i + 1)
    low = F.greatest(at - t["span"] + 1, F.lit(0))
    around = F.size(F.array_intersect(F.slice(words, low + 1, at - low + t["span"]), rest))
    blocks = F.transform(F.sequence(low, at), lambda s: F.size(F.array_intersect(F.slice(words, s + 1, t["span"]), rest)))
    most = F.when((t["n"] - i + 1 >= t["need"]) & (around >= t["need"]), F.array_max(blocks)).otherwise(F.lit(0))
    return F.when(most >= t["need"], most).otherwise(F.lit(0))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), one row for each document."""
    order = ordered(templates, frequencies(docs, vocabulary(templates)), threshold)
    prefix = sorted({w for t in order for w in t["prefix"]}, key=lambda w: (-len(w), w))
    t = _phrases(docs)
    rare = "(?i)(?<= )(?:" + "|".join(prefix) + ")(?= )"
    words = F.split(F.trim(lower(F.col("_norm"))), " ")
    t = t.withColumn("_words", F.when(F.col("_norm").rlike(rare), words).otherwise(F.array().cast("array<string>")))
    places = F.filter(F.transform("_words", lambda w, i: F.when(w.isin(prefix), i)), lambda i: i.isNotNull())
    held = lambda i: F.filter(_table(order), lambda x: F.array_contains(x["prefix"], F.get("_words", i)))
    share = lambda i: F.transform(held(i), lambda x: F.struct(x["label"].alias("label"), (_most(F.col("_words"), i, x) / x["n"].cast("double")).alias("share")))
    t = t.withColumn("_met", F.filter(F.flatten(F.transform(places, share)), lambda y: y["share"] > 0))
    own = F.array_union("_base", F.transform("_met", lambda y: y["label"]))
    score = F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce(F.array_max(F.transform("_met", lambda y: y["share"])), F.lit(0.0)))
    return t.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_distinct(own)), ",").alias("labels"), score.alias("score"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    texts = ", ".join(f"({k}, '{label}', '{text}')" for k, (label, text) in enumerate(TEMPLATES))
    norm = r"regexp_replace(' ' || coalesce({0}, '') || ' ', '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+', ' ', 'g')"
    low = f"translate({{0}}, '{_UP}', '{_LOW}')"
    nd = low.format(norm.format("text"))
    cases = " ".join(f"WHEN {' AND '.join(f'list_extract(w, i + {j}) = {chr(39)}{x}{chr(39)}' for j, x in enumerate(p.split()))} THEN '{label}'" for p, label in BASE)
    return f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, text, {nd} AS norm FROM documents),
w AS (SELECT rid, doc_id, text, list_filter(string_split(norm, ' '), lambda x: x <> '') AS w FROM t),
p AS (SELECT rid, i - 1 AS wp, CASE {cases} END AS label FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
b AS (SELECT rid, count(*) AS n_base, min(wp) AS first_word, max(wp) AS last_word, list_sort(list_distinct(list(label))) AS bl FROM p WHERE label IS NOT NULL GROUP BY rid),
tpl(k, label, txt) AS (VALUES {texts}),
tw AS (SELECT *, CASE WHEN n < {SHORT} THEN n ELSE ceil({THRESHOLD} * n - 1e-9) END AS need FROM (SELECT k, label, list_distinct(string_split(txt, ' ')) AS tw, len(list_distinct(string_split(txt, ' '))) AS n, ceil(len(string_split(txt, ' ')) / {THRESHOLD} - 1e-9) AS span FROM tpl)),
c AS (SELECT rid, w, k, label, tw, n, need, span FROM w, tw WHERE len(list_intersect(w, tw)) >= need),
h AS (SELECT rid, k, label, n, need, span, i, w[i] AS word FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM c) WHERE list_contains(tw, w[i])),
m AS (SELECT a.rid, a.k, any_value(a.label) AS label, count(DISTINCT b.word) / any_value(a.n) AS share FROM h a JOIN h b ON a.rid = b.rid AND a.k = b.k AND b.i >= a.i AND b.i < a.i + a.span GROUP BY a.rid, a.k, a.i HAVING count(DISTINCT b.word) >= any_value(a.need)),
o AS (SELECT rid, list_distinct(list(label)) AS ol, max(share) AS share FROM m GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(bl, ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bl, []), coalesce(ol, [])))), ','), '') AS labels,
  CAST(greatest(CASE WHEN n_base > 0 THEN 1.0 ELSE 0.0 END, coalesce(share, 0.0)) AS DOUBLE) AS score
FROM w LEFT JOIN b USING (rid) LEFT JOIN o USING (rid)"""


SQL = _sql()
