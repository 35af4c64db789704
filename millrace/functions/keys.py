"""Hashes that identify lines: of all business values, of the identity columns, and of the n-th of equal identities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BUSINESS, IDENTITY


def digest(columns: tuple[str, ...]) -> Column:
    return F.sha2(F.concat_ws("||", *[F.coalesce(F.col(c), F.lit("<NULL>")) for c in columns]), 256)


def row_hash() -> Column:
    return digest(BUSINESS)


def together(lines: DataFrame, columns: tuple[str, ...], name: str) -> DataFrame:
    """lines with the digest of the columns as name, dealt by it. It is made on both sides of the shuffle and doesn't
    travel: a digest is longer than all that a line has else, and doesn't compress."""
    return lines.repartition(digest(columns)).withColumn(name, digest(columns))


def numbered(lines: DataFrame, *by: str) -> DataFrame:
    """lines, which have _identity_hash, with _row_hash, _identity_occurrence and _record_key. Lines have no number of
    their own, so those of one identity (and of one value of by) are numbered by row hash, which makes the key
    independent of the order of the file."""
    nth = F.row_number().over(Window.partitionBy("_identity_hash", *by).orderBy("_row_hash"))
    lines = lines.withColumn("_row_hash", row_hash()).withColumn("_identity_occurrence", nth)
    return lines.withColumn("_record_key", F.sha2(F.concat_ws("||", "_identity_hash", F.col("_identity_occurrence").cast("string")), 256))


def keyed(lines: DataFrame) -> DataFrame:
    """lines with _identity_hash, _row_hash, _identity_occurrence and _record_key."""
    return numbered(together(lines, IDENTITY, "_identity_hash"))
