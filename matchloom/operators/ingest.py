"""Reading records and contracts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MEMBER = "struct<name:string,skills:array<string>,shadow_skills:array<string>>"
MATCH_JSON = f"`1` array<{MEMBER}>, `2` array<{MEMBER}>, winner string, season int, fuzzy_match_failures array<string>, _corrupt string"


def read_matches(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """One match for each JSON document, with its file name, source and, for bad ones, a reason."""
    t = spark.read.schema(MATCH_JSON).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt").json(folder)
    t = t.select("*", F.col("_metadata.file_name").alias("filename"))
    reason = F.when(F.col("_corrupt").isNotNull(), "not_json").when(F.coalesce(F.size("1"), F.lit(0)) != 3, "team_size").when(F.coalesce(F.size("2"), F.lit(0)) != 3, "team_size").when(~F.coalesce(F.col("winner").isin("1", "2"), F.lit(False)), "winner")
    return t.select("filename", F.lit(source).alias("source"), F.col("1").alias("team1"), F.col("2").alias("team2"), F.col("winner").try_cast("int").alias("winner"), "season", "fuzzy_match_failures", reason.alias("reason"))


def incremental(rows: DataFrame, key: str, cursor: int, limit: int) -> DataFrame:
    """The next rows after a cursor, by key; the filter reaches the scan."""
    return rows.filter(F.col(key) > cursor).orderBy(key).limit(limit)


def bounds(rows: DataFrame, key: str) -> DataFrame:
    """S06."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.min(key).alias("low"), F.max(key).alias("high"))


def schema_contract(rows: DataFrame, expected: dict[str, str], unique: tuple[str, ...] = ()) -> DataFrame:
    """One row for each expected column and unique key, with whether it holds."""
    have = dict(rows.dtypes)
    spark = rows.sparkSession
    cols = spark.createDataFrame([(f"column {c}", have.get(c) == kind) for c, kind in expected.items()], "item string, ok boolean")
    for k in unique:
        twice = rows.groupBy(k).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.max("n") <= 1, F.lit(True)).alias("ok"))
        cols = cols.unionByName(twice.select(F.lit(f"unique {k}").alias("item"), "ok"))
    return cols


def capture_time(name: Column) -> Column:
    """The time in a file's name: 2025-08-31-160345, epoch milliseconds, or 2025-08-31 at 4.03.45 PM, in any case and
    with any kind of space (a narrow one, U+202F, on recent systems)."""
    dated = F.try_to_timestamp(F.nullif(F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2}-\d{6})", 1), F.lit("")), F.lit("yyyy-MM-dd-HHmmss"))
    millis = F.timestamp_millis(F.nullif(F.regexp_extract(name, r"(?<!\d)(\d{12,13})(?!\d)", 1), F.lit("")).cast("long"))
    plain = F.upper(F.translate(name, "\u202f\u00a0\u2009", "   "))
    clock = F.regexp_extract(plain, r"\d{4}-\d{2}-\d{2} AT (\d{1,2}\.\d{2}\.\d{2}) *[AP]M", 1)
    half = F.regexp_extract(plain, r" AT \d{1,2}\.\d{2}\.\d{2} *([AP]M)", 1)
    day = F.regexp_extract(plain, r"(\d{4}-\d{2}-\d{2}) AT \d", 1)
    spoken = F.try_to_timestamp(F.nullif(F.concat_ws(" ", day, clock, half), F.lit("  ")), F.lit("yyyy-MM-dd h.mm.ss a"))
    return F.coalesce(dated, millis, spoken)


def fill_down(cells: DataFrame, order: str, by: str, marker: Column) -> DataFrame:
    """The last marker above each row of its sheet, markers left out."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = cells.withColumn("_m", marker).withColumn("section", F.last("_m", ignorenulls=True).over(w))
    return t.filter("_m IS NULL").drop("_m")


def join_points(lines: DataFrame, by: str, order: str, starts: Column, text: str) -> DataFrame:
    """Numbered points with their continuation lines joined."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    t = lines.withColumn("point", F.sum(starts.cast("int")).over(w)).filter("point > 0")
    rows = F.sort_array(F.collect_list(F.struct(order, text)))
    return t.groupBy(by, "point").agg(F.array_join(F.transform(rows, lambda x: x[text]), " ").alias("text"), F.count(F.lit(1)).alias("n_lines"))


def asset_check(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Files of a folder against a manifest (name, size, sha256): (name, status, size), status ok, changed, missing or extra.

    A file's name is its path under the folder without Spark's part name; bytes are read by the tasks, one file at a time."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    found = found.select(F.regexp_extract("path", r"([^/]+)/part-[^/]*$", 1).alias("name"), F.col("length").alias("_size"), F.sha2("content", 256).alias("_sha")).filter("_size > 0")
    t = manifest.withColumn("_listed", F.lit(True)).join(found, "name", "full")
    same = F.col("size").eqNullSafe(F.col("_size")) & F.col("sha256").eqNullSafe(F.col("_sha"))
    status = F.when(F.col("_listed").isNull(), "extra").when(F.col("_sha").isNull(), "missing").when(same, "ok").otherwise("changed")
    return t.select("name", status.alias("status"), F.col("_size").alias("size"))
