"""Operator 10, URL filters: allow and block rules, then a path-template tree of each host.

Everything is DataFrame operations. A page's path is cut into segments, of any number; segments that look
like a number or a code become ``*`` at once. Distinct (host, path) shapes then grow each host's tree level
by level: where a node has many children for its pages, they all become ``*`` and are counted together. A
node with fewer than ``MANY`` shapes can have no such node below, so its shapes keep the rest of their
segments and leave the loop; rounds are as many as the deepest path that ``MANY`` shapes share.

A template's purity is the share of good labelled pages, smoothed from the root down: each level shrinks
toward the one above, the host toward all pages, so a template without a label has the purity of its
deepest labelled ancestor. Branches of one parent that are statistically alike are merged and share their
counts: those that don't differ from their parent's rate by a two-proportion test, and those that differ to
the same side and stand in the same tenth of purity. A template below ``MIN_PURITY`` is blocked.

A hot host, node or path doesn't meet in one task: what a table is joined with is aggregated first, keys
with a thousandth of the rows or more (a thousand at most) are joined by broadcast and only the others by a
shuffle. Cases: null urls or urls without "://" have an empty host and path and count as one host; very
long urls and paths are taken whole; repeated rows and ties get equal verdicts; a null or empty host or
path is a key as any; without labels all pages are allowed by the method; an empty table gives no rows;
other columns than page_id and url are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, table, with_hot_keys

#: Host, path start, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
#: A node with this many children, and so many for each page, has variable children.
MANY, SHARE = 8, 0.5
#: Prior pages at each level of smoothing, the merging test's z, and the purity below which templates are blocked.
PRIOR, Z, MIN_PURITY = 20.0, 1.96, 0.5
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path of a url; both empty without "://"."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UP, _LOW)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def match_rules(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds ``rule`` and ``rule_verdict`` of the longest rule that fits (host, path)."""
    if not rules:
        return pages.withColumn("rule", F.lit(None).cast("string")).withColumn("rule_verdict", F.lit(None).cast("string"))
    every = F.array(*[F.struct(F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for h, p, v in sorted(rules, key=lambda r: -len(r[0] + r[1]))])
    fits = lambda r: ((F.col("host") == r["h"]) | F.col("host").endswith(F.concat(F.lit("."), r["h"]))) & F.col("path").startswith(r["p"])
    best = F.get(F.filter(every, fits), F.lit(0))
    return pages.withColumn("_r", best).withColumn("rule", F.concat("_r.h", "_r.p")).withColumn("rule_verdict", F.col("_r.v")).drop("_r")


def _looks_variable(seg: Column) -> Column:
    return seg.rlike(r"^[0-9]+(\.[A-Za-z0-9]+)?$|^[0-9a-fA-F-]{12,}$|^[^0-9]*[0-9]{4,}[^/]*$")


def shapes(urls: DataFrame) -> DataFrame:
    """(host, path) rows get ``shape``: the path's segments, those that look variable as ``*``."""
    segs = F.filter(F.split("path", "/"), lambda x: x != "")
    return urls.withColumn("shape", F.array_join(F.transform(segs, lambda x: F.when(_looks_variable(x), F.lit("*")).otherwise(x)), "/"))


def templates(each: DataFrame) -> DataFrame:
    """(host, shape, n) rows, distinct, get ``template``: host and segments, the variable ones as ``*``."""
    rows = each.withColumn("node", F.col("host")).withColumn("left", F.filter(F.split("shape", "/"), lambda x: x != ""))
    out = rows.filter(F.size("left") == 0).select(*each.columns, F.col("node").alias("template"))
    rows = rows.filter(F.size("left") > 0)
    while not rows.isEmpty():
        rows = materialize(rows, "level")
        kids = rows.groupBy("node", F.get("left", F.lit(0)).alias("seg")).agg(F.sum("n").alias("pages"), F.count(F.lit(1)).alias("rows"))
        stats = kids.groupBy("node").agg(F.count(F.lit(1)).alias("kids"), F.sum("pages").alias("pages"), F.sum("rows").alias("rows"))
        stats = stats.select("node", ((F.col("kids") >= MANY) & (F.col("kids") >= SHARE * F.col("pages"))).alias("wide"), (F.col("rows") < MANY).alias("small"), "rows")
        t = materialize(with_hot_keys(rows, materialize(stats, "nodes"), ["node"], "rows"), "level")
        whole = t.filter("small").withColumn("template", F.concat_ws("/", "node", F.array_join("left", "/")))
        t = t.filter("not small").withColumn("node", F.concat_ws("/", "node", F.when(F.col("wide"), F.lit("*")).otherwise(F.get("left", F.lit(0))))).withColumn("left", F.slice("left", 2, 1 << 30))
        ended = t.filter(F.size("left") == 0).withColumn("template", F.col("node"))
        out = out.unionByName(whole.select(*each.columns, "template")).unionByName(ended.select(*each.columns, "template"))
        rows = t.filter(F.size("left") > 0).drop("wide", "small")
    return out


def purities(leaves: DataFrame) -> DataFrame:
    """(template, purity) from distinct rows (template, host, good, n): labelled pages of each, good ones among them."""
    below = F.filter(F.split(F.expr("substring(template, length(host) + 2)"), "/"), lambda x: x != "")
    depth = F.sequence(F.lit(0), F.size("segs"))
    node = lambda k: F.concat_ws("/", "host", F.when(k > 0, F.array_join(F.slice("segs", 1, k), "/")))
    t = leaves.withColumn("segs", below).select("template", "host", "good", "n", F.explode(F.transform(depth, lambda k: F.struct(k.alias("level"), node(k).alias("node"), F.when(k > 0, node(k - 1)).alias("parent")))).alias("x"))
    t = materialize(t.select("template", "good", "n", "x.level", "x.node", "x.parent"), "lines")
    nodes = t.groupBy("level", "node", "parent").agg(F.sum("good").alias("good"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("under"))
    nodes = materialize(nodes.withColumn("known", (F.col("n") > 0).cast("int")), "nodes")
    every = nodes.filter("level = 0").agg(F.sum("good").alias("g"), F.sum("n").alias("m")).first()
    start = every["g"] / every["m"] if every["m"] else 1.0
    labelled = nodes.filter("n > 0 and parent is not null")
    above = labelled.groupBy("level", "parent").agg(F.sum("good").alias("pg"), F.sum("n").alias("pn"), F.count(F.lit(1)).alias("sons"))
    s = with_hot_keys(labelled.select("level", "node", "parent", "good", "n"), above, ["level", "parent"], "sons")
    rate, all_ = F.col("good") / F.col("n"), F.col("pg") / F.col("pn")
    rest = F.col("pn") - F.col("n")
    other = F.try_divide(F.col("pg") - F.col("good"), rest)
    apart = F.coalesce(F.abs(rate - other) > Z * F.sqrt(all_ * (1 - all_) * (1 / F.col("n") + F.try_divide(F.lit(1.0), rest))), F.lit(False))
    kind = F.when(~apart, F.lit(-1)).otherwise(F.floor(F.least(rate, F.lit(0.999)) * 10) + F.when(rate > other, 100).otherwise(0)).cast("int")
    s = materialize(s.select("level", "node", "parent", "good", "n", kind.alias("kind")), "kinds")
    merged = s.groupBy("level", "parent", "kind").agg(F.sum("good").alias("mg"), F.sum("n").alias("mn"), F.count(F.lit(1)).alias("sons"))
    own = with_hot_keys(s.select("level", "node", "parent", "kind"), materialize(merged, "merged"), ["level", "parent", "kind"], "sons").select("level", "node", "mg", "mn")
    stats = nodes.select("level", "node", "under", "good", "n").join(own, ["level", "node"], "left")
    stats = stats.select("level", "node", "under", F.coalesce("mg", "good").alias("good"), F.coalesce("mn", "n").alias("n"))
    found = with_hot_keys(t.select("template", "level", "node"), materialize(stats, "stats"), ["level", "node"], "under")
    line = found.groupBy("template").agg(F.sort_array(F.collect_list(F.struct("level", "good", "n"))).alias("line"))
    fold = F.aggregate("line", F.lit(float(start)), lambda p, x: (x["good"] + F.lit(PRIOR) * p) / (x["n"] + F.lit(PRIOR)))
    return line.select("template", fold.alias("purity"))


def judge(pages: DataFrame, labels: DataFrame, rules=RULES, min_purity: float = MIN_PURITY) -> DataFrame:
    """(page_id, host, path, rule, verdict, template, purity); ``labels`` has (page_id, quality)."""
    host, path = parts(F.col("url"))
    known = labels.filter("page_id is not null and quality is not null").groupBy("page_id").agg(F.min("quality").cast("double").alias("quality"))
    own = shapes(match_rules(pages.select("page_id", host.alias("host"), path.alias("path")), rules))
    own = materialize(own.join(known, "page_id", "left"), "urls")
    each = own.groupBy("host", "shape").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("quality"), F.lit(0.0)).alias("good"), F.count("quality").cast("double").alias("m"))
    tree = materialize(templates(materialize(each, "shapes")), "templates")
    leaves = materialize(tree.groupBy("template", "host").agg(F.sum("good").alias("good"), F.sum("m").alias("n"), F.count(F.lit(1)).alias("shapes")), "leaves")
    purity = purities(leaves.select("template", "host", "good", "n"))
    table_ = materialize(leaves.select("template", "shapes").join(purity, "template"), "purities")
    judged = materialize(with_hot_keys(tree.select("host", "shape", "n", "template"), table_, ["template"], "shapes"), "judged")
    out = with_hot_keys(own.drop("quality"), judged, ["host", "shape"], "n")
    verdict = F.coalesce("rule_verdict", F.when(F.col("purity") < min_purity, F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page labels are those of the document of the same number."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), "quality")
    return judge(table(spark, sf_dir, "pages"), labels)
