"""Canonical exact digest of documents, JVM expressions only.

Canonical form: NFKC, full case folding, runs of white space as one blank, no blanks at the ends. The fingerprint is a
128-bit xxhash of it. Where texts share a 128-bit value, their canonical bytes are compared: the bucket's distinct
forms are numbered in byte order, and every form but the first carries its number, so that equal fingerprints mean
equal canonical texts.

Defined cases: null text counts as the empty text. Rows that repeat a doc_id follow each other by text. A null doc_id
comes after all others. In a table of one row the next document is the document itself. An empty table gives an empty
table. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, stored

#: Bytes of text in a range of documents, and the most ranges, whose limits each task holds.
RANGE_BYTES, RANGES = 16 << 20, 20_000


def canonical(text: Column) -> Column:
    """NFKC, case folding and white-space folding by the Unicode library that Spark ships."""
    nfkc = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc, F.lit(True))
    return F.trim(F.regexp_replace(folded, r"(?U)\s+", " "))


def wide_hash(form: Column) -> Column:
    return F.struct(F.xxhash64(form).alias("h1"), F.xxhash64(F.lit(1), form).alias("h2"))


def in_order(rows: DataFrame) -> DataFrame:
    """rows (doc_id, text, h) with next_id, next_text and next_h of the row after each in ascending doc_id order; after
    the last comes the first. Rows are dealt to ranges of doc_id of about RANGE_BYTES, in which the next row is at hand;
    behind each range stands a copy of the first row of the range after it (a row for each range). Beyond RANGES of
    them they grow instead, and the sort within each spills."""
    spark = rows.sparkSession
    size = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = min(RANGES, max(8, -(-size // RANGE_BYTES)))
    cuts = sorted(set(rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 20 * n)).first()[0] or [0]))
    steps = [1 << i for i in range(len(cuts).bit_length() - 1, -1, -1)]
    below = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<long>")  # one literal, folded once
    # Binary search: how many cuts are at or under doc_id.
    part = F.aggregate(F.lit(steps), F.lit(0), lambda at, step: F.when(F.get(below, at + step - 1) <= F.col("doc_id"), at + step).otherwise(at))
    part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts) + 1)).otherwise(part)
    ids = rows.select("doc_id", part.alias("part")).groupBy("part").agg(F.min("doc_id").alias("head"))
    here = ids.collect()  # one row for each range
    order = sorted(r["part"] for r in here)
    heads = {r["part"]: r["head"] for r in here}
    behind = [(order[i - 1], heads[p]) for i, p in enumerate(order)]
    if not behind:
        behind = [(0, 0)]
    before = spark.createDataFrame(behind, "to_part int, head long")
    firsts = rows.join(F.broadcast(before), F.col("doc_id").eqNullSafe(F.col("head"))).groupBy("to_part", "doc_id").agg(F.min(F.struct("text", "h")).alias("f"))
    guards = firsts.select("doc_id", "f.text", "f.h", F.col("to_part").alias("part"), F.lit(True).alias("guard"))
    dealt = rows.select("doc_id", "text", "h", part.alias("part"), F.lit(False).alias("guard")).unionByName(guards)
    dealt = dealt.repartition(n, "part")  # as many tasks as ranges, whatever the session's setting
    ordered = Window.partitionBy("part").orderBy("guard", F.col("doc_id").asc_nulls_last(), "text")
    lead = [F.lead(c).over(ordered).alias(f"next_{name}") for c, name in (("doc_id", "id"), ("text", "text"), ("h", "h"))]
    return dealt.select("doc_id", "text", "h", "guard", *lead).filter(~F.col("guard")).drop("guard")


def hashed(docs: DataFrame) -> DataFrame:
    """doc_id, text, h: the 128-bit value of the canonical form."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.select("*", canonical(F.col("text")).alias("form")).select("doc_id", "text", wide_hash(F.col("form")).alias("h"))


def edited(text: Column, following: Column) -> Column:
    """text with its last floor(n/2) code points replaced by the first as many of the following text, or all."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(following, F.lit(1), half))


def collisions(forms: DataFrame) -> DataFrame:
    """h, form, nth for forms (h, form): the distinct forms of each value that has more than one, numbered in byte order."""
    distinct = forms.groupBy("h", "form").agg(F.lit(1).alias("one"))
    many = distinct.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    return distinct.join(many, "h", "left_semi").select("h", "form", (F.row_number().over(Window.partitionBy("h").orderBy("form")) - 1).alias("nth"))


def _named(h: str, nth: Column | None = None) -> Column:
    wide = F.concat(*[F.lpad(F.lower(F.hex(f"{h}.{half}")), 16, "0") for half in ("h1", "h2")])
    return wide if nth is None else F.concat(wide, F.when(nth > 0, F.concat(F.lit("-"), nth.cast("string"))).otherwise(""))


def _only(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """rows whose doc_id is a key of ids; ids are broadcast only if their count is within the bound."""
    ids = ids.select(F.col(key).alias("_id")).distinct()
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(ids) if few else ids, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint for every document."""
    rows = in_order(hashed(docs)).withColumn("edit", edited(F.col("text"), F.col("next_text")))
    rows = rows.select("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.col("edit").cast("binary"), 256).alias("edited_sha256"), "h", "next_id", "next_h", canonical(F.col("edit")).alias("form"))
    found = stored(rows.select(*[c for c in rows.columns if c != "form"], wide_hash(F.col("form")).alias("edit_h")), "fingerprints")
    nth = _byte_compared(docs, found)
    if nth is None:
        return found.select("doc_id", "n_chars", "edited_sha256", _named("h").alias("fingerprint"), _named("edit_h").alias("edited_fingerprint"), _named("next_h").alias("next_fingerprint"))
    out = found
    for side, key in (("h", ("doc_id", "h", "own")), ("edit_h", ("doc_id", "edit_h", "edit")), ("next_h", ("next_id", "next_h", "own"))):
        own = nth.filter(F.col("kind") == key[2]).select(F.col("doc_id").alias("_d"), F.col("h").alias("_h"), F.col("nth").alias(f"nth_{side}")).distinct()
        out = out.join(own, F.col(key[0]).eqNullSafe(F.col("_d")) & (F.col(key[1]) == F.col("_h")), "left").drop("_d", "_h")
    return out.select("doc_id", "n_chars", "edited_sha256", *[_named(s, F.coalesce(F.col(f"nth_{s}"), F.lit(0))).alias(n) for s, n in (("h", "fingerprint"), ("edit_h", "edited_fingerprint"), ("next_h", "next_fingerprint"))])


def _byte_compared(docs: DataFrame, found: DataFrame) -> DataFrame | None:
    """doc_id, kind, h, nth for the texts whose 128-bit value stands for several canonical forms; None if none does.
    Only the texts of values that occur twice or more are read again and compared."""
    values = found.select("h").unionByName(found.select(F.col("edit_h").alias("h")))
    shared = stored(values.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h"), "fp-shared")
    few = shared.count() <= BROADCAST_ROWS
    shared = F.broadcast(shared) if few else shared
    own = stored(found.join(shared, "h", "left_semi").select("doc_id", "h"), "fp-own")
    edits = stored(found.join(shared.select(F.col("h").alias("edit_h")), "edit_h", "left_semi").select("doc_id", "h", "edit_h", "next_id", "next_h"), "fp-edits")
    own_forms = _only(docs, own, "doc_id").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own_forms = own_forms.select("doc_id", F.lit("own").alias("kind"), canonical(F.col("text")).alias("form"))
    involved = stored(hashed(_only(docs, edits.select("doc_id").union(edits.select("next_id")), "doc_id")), "fp-involved").distinct()
    nexts = involved.select(F.col("doc_id").alias("_n"), F.col("text").alias("next_text"), F.col("h").alias("_nh"))
    pairs = edits.join(involved.withColumnRenamed("doc_id", "_d").withColumnRenamed("h", "_h"), F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("h") == F.col("_h")))
    pairs = pairs.join(nexts, F.col("next_id").eqNullSafe(F.col("_n")) & (F.col("next_h") == F.col("_nh")))
    edit_forms = pairs.select("doc_id", F.lit("edit").alias("kind"), canonical(edited(F.col("text"), F.col("next_text"))).alias("form"))
    forms = own_forms.unionByName(edit_forms).select("doc_id", "kind", "form", wide_hash(F.col("form")).alias("h"))
    clash = stored(collisions(forms), "fp-clash")
    if clash.isEmpty():
        return None
    return stored(forms.join(clash, ["h", "form"]).select("doc_id", "kind", "h", "nth"), "fp-numbers")


def query(spark, sf_dir: str) -> DataFrame:
    out = fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    alike = lambda other: (F.col("fingerprint") == F.col(other)).cast("double")  # noqa: E731  exact digests: alike or not
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", alike("edited_fingerprint").alias("near_edited"), alike("next_fingerprint").alias("near_next"))
