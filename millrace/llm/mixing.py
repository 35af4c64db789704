"""Mixing sources to target weights: hash-threshold histograms, DataFrame operations only.

Every document has a fixed 60-bit hash of its id. A source whose target is r times its size takes each document
floor(r) times, and once more where the hash is at or under the source's threshold. The threshold comes from
histograms of words by (source, hash bucket): the bucket in which the running total passes the budget is split again,
12 bits at a time, until it holds a single hash value. Nothing is sorted but those small histograms.

Defined cases: null source is a source of its own, last in order. Null or empty text has size 0; such a document is
taken 0 words and kept once by `mixed`. Rows that repeat a doc_id share its hash and are taken alike; rows without a
doc_id share one if they share the text. Very long texts are counted whole. The empty table gives the empty table. Other
columns, whatever their names, pass through. The sources are the dimension of the mix: their table, two numbers and a
name each, is ranked in one task, so `source` is to have millions of values at most; a column such as a URL isn't one.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, n_words, stored

BITS, LEVELS = 12, 5


def id_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of the md5 of the id as text, or of the text where the id is null."""
    named = F.coalesce(doc_id.cast("string"), F.concat(F.lit("="), text), F.lit(""))
    return F.conv(F.substring(F.md5(named.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), total: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target, repeats, budget. Targets share `total` times all words by weight; those over `cap`
    times their source stop there and the excess is shared again, which ends at one level for all the others: sources
    ordered by cap * size / weight, the level is found by running sums."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("w", F.element_at(F.array(*[F.lit(w).cast("long") for w in weights]), (F.pmod(rank - 1, F.lit(len(weights))) + 1).cast("int")))
    everyone, order = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing), F.col("fill")
    per = per.withColumn("fill", F.lit(cap) * F.col("source_size") / F.col("w"))
    before = Window.orderBy(order, F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    per = (
        per.withColumn("left_words", F.lit(total) * F.sum("source_size").over(everyone) - F.lit(cap) * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("left_w", F.sum("w").over(everyone) - F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("capped", F.col("left_words") / F.col("left_w") > F.col("fill"))
    )
    level = F.max(F.when(~F.col("capped"), F.struct(F.col("left_words") / F.col("left_w"), "left_words", "left_w"))).over(everyone)
    per = per.withColumn("level", level)
    target = F.when(F.col("capped"), F.lit(cap) * F.col("source_size")).otherwise(F.col("level.left_words") * F.col("w") / F.col("level.left_w"))
    per = per.withColumn("target", F.coalesce(target, F.lit(0.0)))
    per = per.withColumn("repeats", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    return per.select("source", "source_size", "target", "repeats", (F.col("target") - F.col("repeats") * F.col("source_size")).alias("budget"))


def thresholds(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with `threshold`: documents of the source at or under it are taken once more. sizes: source, size, hash."""
    n = targets.count()
    # The boundary so far: hashes from lo on, width bits wide; `under` words lie below lo.
    edge = targets.select("source", "budget", F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("under"))
    for level in range(1, LEVELS + 1):
        shift = BITS * (LEVELS - level)
        inside = lookup(sizes.filter("size > 0"), edge, ["source"], n, F.col("hash"))
        inside = inside.filter(F.shiftright("hash", shift + BITS) == F.shiftright("lo", shift + BITS))
        hist = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.first("budget").alias("budget"), F.first("under").alias("under"), F.min("hash").alias("low"), F.max("hash").alias("high")
        )
        running = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        hist = hist.withColumn("past", F.col("under") + running).withColumn("under", F.col("past") - F.col("words"))
        # The first bucket that passes the budget; budgets are less than the source's size, so there is one.
        first = hist.filter("past > budget").groupBy("source").agg(F.min(F.struct("bucket", "budget", "under", "words", "low", "high")).alias("b"))
        edge = stored(first.select("source", "b.budget", F.shiftleft("b.bucket", shift).alias("lo"), "b.under", "b.words", "b.low", "b.high"), "mix-edge")
        if level == LEVELS or edge.filter("low < high").isEmpty():
            break
    # One hash value is left; it goes where it brings the total nearer to the budget.
    nearer = F.col("under") + F.col("words") - F.col("budget") < F.col("budget") - F.col("under")
    found = edge.select(F.col("source").alias("s"), F.when(nearer, F.col("low")).otherwise(F.col("low") - 1).alias("threshold"))
    joined = targets.join(found, F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    return joined.withColumn("threshold", F.coalesce("threshold", F.lit(-1).cast("long"))).drop("budget")


def mix(docs: DataFrame, **options) -> DataFrame:
    """docs packed as `row`, with size, source_size, target, and taken: the words that the mix takes, repeats counted."""
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    sized = rows.select("row", F.col("row.source").alias("source"), n_words(F.col("row.text")).alias("size"), id_hash(F.col("row.doc_id"), F.col("row.text")).alias("hash"))
    sizes = stored(sized.select("source", "size", "hash"), "mix-sizes", narrow=True)
    return _taken(sized, sizes, **options)


def _taken(sized: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    found = stored(thresholds(sizes, stored(source_targets(sizes, **options), "mix-targets")), "mix-thresholds")
    out = lookup(sized, found, ["source"], found.count(), F.col("hash"))
    return out.withColumn("taken", F.col("size") * (F.col("repeats") + (F.col("hash") <= F.col("threshold")).cast("long"))).drop("repeats", "threshold", "hash")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: docs' columns, a row for each time that a document is taken; documents without words once."""
    out = mix(docs, **options).withColumn("copies", F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.greatest("size", F.lit(1))).cast("int"))
    return out.filter("copies > 0").select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    slim = stored(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), id_hash(F.col("doc_id"), F.col("text")).alias("hash")), "mix-sizes", narrow=True)
    return _taken(slim, slim).select("doc_id", "size", "source_size", "target", "taken")


_weights = reduce(lambda rest, iw: f"WHEN {iw[0]} THEN {iw[1]} {rest}", [(2, 2), (1, 1), (0, 3)], "END")
ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 {_weights} AS w FROM p),
f AS (SELECT *, 2.0::DOUBLE * source_size / w AS fill FROM r),
g AS (
  SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - 2.0::DOUBLE * coalesce(sum(source_size) OVER b, 0) AS lw,
         sum(w) OVER () - coalesce(sum(w) OVER b, 0) AS lk
  FROM f WINDOW b AS (ORDER BY fill, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
e AS (SELECT lw, lk FROM g WHERE NOT lw / lk > fill ORDER BY lw / lk DESC LIMIT 1),
t AS (
  SELECT source, source_size,
         CASE WHEN lw / lk > fill THEN 2.0::DOUBLE * source_size ELSE (SELECT lw FROM e) * w / (SELECT lk FROM e) END AS target
  FROM g),
q AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS repeats FROM t),
c AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS past
  FROM d WHERE size > 0 GROUP BY source, h),
x AS (
  SELECT q.source, min_by(struct_pack(h := h, words := words, under := past - words), h) AS b,
         any_value(target - repeats * source_size) AS budget
  FROM c JOIN q ON c.source IS NOT DISTINCT FROM q.source
  WHERE past > target - repeats * source_size GROUP BY q.source),
y AS (SELECT source, CASE WHEN b.under + b.words - budget < budget - b.under THEN b.h ELSE b.h - 1 END AS threshold FROM x)
SELECT d.doc_id, d.size, q.source_size, q.target,
       CAST(d.size * (q.repeats + CASE WHEN h <= coalesce(threshold, -1) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source LEFT JOIN y ON d.source IS NOT DISTINCT FROM y.source
"""
