"""Line dedup by distinct-site spread, DataFrame operations only.

A line (split at \\n, spaces trimmed) that stands on `min_sites` sources or more is boilerplate. One aggregation by
128-bit line hash merges a HyperLogLog sketch of the sources; where the estimate is within three standard errors, and
one more, of the threshold, the line's sources are counted exactly. A boilerplate line stays where it stands first
(smallest doc_id, then position) and goes everywhere else.

Defined cases: empty lines are no lines to remove and stay; null text stays null. A null source is a site of its own.
A null doc_id comes after all others. Rows that repeat a doc_id and its text are cleaned alike. Line ends other than
\\n belong to the line. Very long texts are cut like any other. An empty table gives an empty table. Other columns pass
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, lookup, stored

#: Log2 of the sketch's registers; the standard error is 1.04 / 2 ** (LG_K / 2).
LG_K = 10


def _packed(docs: DataFrame) -> DataFrame:
    row = F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")
    return docs.select(row).select("row", F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), F.xxhash64("row.text").alias("rid"))


def _lines(docs: DataFrame) -> DataFrame:
    """A row for each line that isn't empty: rid, doc_id, site, pos, and the two halves of its hash."""
    lines = docs.select("rid", "doc_id", F.coalesce(F.concat(F.lit("="), "row.source"), F.lit("")).alias("site"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim("line")).filter("line != ''")
    return lines.select("rid", "doc_id", "site", "pos", F.xxhash64("line").alias("k1"), F.xxhash64(F.lit(1), "line").alias("k2"))


def _first() -> Column:
    return F.min(F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc"), F.col("pos").alias("at"))).alias("first")


def boilerplate(lines: DataFrame, min_sites: int = 5) -> DataFrame:
    """k1, k2, first: the lines on min_sites sites or more, and where each stands first."""
    spread = lines.groupBy("k1", "k2").agg(F.hll_sketch_agg("site", LG_K).alias("sketch"), F.count(F.lit(1)).alias("n"), _first())
    # A line that stands fewer times than that can't stand on so many sites.
    spread = spread.filter(F.col("n") >= min_sites).select("k1", "k2", "first", F.hll_sketch_estimate("sketch").alias("sites"))
    spread = stored(spread, "line-spread")
    band = 1 + 3 * 1.04 / 2 ** (LG_K / 2) * min_sites
    near = spread.filter(F.abs(F.col("sites") - min_sites) <= band)
    exact = lookup(lines, near.select("k1", "k2"), ["k1", "k2"], near.count(), F.col("rid"), "left_semi").select("k1", "k2", "site").distinct().groupBy("k1", "k2").count().filter(F.col("count") >= min_sites)
    sure = spread.filter(F.col("sites") - min_sites > band).select("k1", "k2", "first")
    return sure.unionByName(near.join(exact.select("k1", "k2"), ["k1", "k2"]).select("k1", "k2", "first"))


def line_dedup(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """docs packed as `row`, with clean (the text without the lines that go), n_lines and n_removed."""
    packed = _packed(docs)
    lines = stored(_lines(packed), "lines")
    found = stored(boilerplate(lines, min_sites), "line-boilerplate")
    here = F.struct(F.col("doc_id").isNull().alias("late"), F.col("doc_id").alias("doc"), F.col("pos").alias("at"))
    # Boilerplate lines are the most frequent keys there are: broadcast if they are few, else salted.
    gone = lookup(lines, found, ["k1", "k2"], found.count(), F.col("rid")).filter(~here.eqNullSafe(F.col("first"))).groupBy(F.col("doc_id").alias("d"), F.col("rid").alias("r")).agg(F.collect_set("pos").alias("gone"))
    out = packed.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("rid") == F.col("r")), "left")
    parts = F.split("text", "\n", -1)
    kept = F.concat_ws("\n", F.filter(parts, lambda _, i: ~F.array_contains("gone", i)))
    return out.select(
        "row",
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("clean"),
        F.coalesce(F.size(parts), F.lit(0)).alias("n_lines"),
        F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).alias("n_removed"),
    )


def deduped(docs: DataFrame, min_sites: int = 5) -> DataFrame:
    """docs' columns with the clean text; a document of which only white space is left goes, for its lines stay where
    they stand first. n_chars, if there is one, follows the text."""
    out = line_dedup(docs, min_sites)
    out = out.filter((F.col("n_removed") == 0) | F.col("clean").rlike(WORD))
    news = {"text": F.col("clean"), "n_chars": F.length("clean").cast("long")}
    return out.select(*[news.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("row.doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_removed").cast("long").alias("n_removed"), F.length("clean").cast("long").alias("n_chars"), F.md5(F.col("clean").cast("binary")).alias("text_md5"))


ORACLE = """
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents),
s AS (SELECT trim(line) AS t, coalesce('=' || source, '') AS site, doc_id, pos FROM l WHERE trim(line) <> ''),
b AS (
  SELECT t, min(struct_pack(late := doc_id IS NULL, doc := doc_id, at := pos)) AS f
  FROM s GROUP BY t HAVING count(DISTINCT site) >= 5),
g AS (
  SELECT l.doc_id, l.pos, l.line, b.t IS NOT NULL AND (b.f.doc IS DISTINCT FROM l.doc_id OR b.f.at <> l.pos) AS gone
  FROM l LEFT JOIN b ON trim(l.line) = b.t),
o AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS clean
  FROM g GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(length(clean) AS BIGINT) AS n_chars, md5(clean) AS text_md5
FROM documents d LEFT JOIN o ON d.doc_id IS NOT DISTINCT FROM o.doc_id
"""
