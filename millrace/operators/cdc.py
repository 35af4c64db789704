"""Changes between two snapshots of keyed lines.

Both snapshots go through one aggregation by record key, which holds a version of the line for each side. A record that
has one version came or went, one whose versions differ in hash changed, and all others fall away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import numbered, row_hash
from ..schemas import BUSINESS

SIDES = ("before", "after")


def _version() -> Column:
    return F.struct(F.col("_row_hash").alias("hash"), F.col("_batch_date").alias("date"), *BUSINESS)


def _versions(lines: DataFrame, side: str) -> DataFrame:
    """record_key and, for the side, the line's hash, date and columns; null for the other side."""
    version = _version()
    empty = F.lit(None).cast(lines.select(version.alias("v")).schema["v"].dataType)
    return lines.select(F.col("_record_key").alias("record_key"), *[(version if s == side else empty).alias(s) for s in SIDES])


def events(previous: DataFrame, current: DataFrame, run_token: str | None = None) -> DataFrame:
    """A row for each record that came, went or changed. Both sides are keyed by functions.keys.keyed."""
    return _events(_versions(previous, "before").unionByName(_versions(current, "after")), run_token)


def events_of(lines: DataFrame, run_token: str | None = None) -> DataFrame:
    """events() of the lines of both snapshots in one table: _side is before or after, and _identity_hash stands there
    by functions.keys.together. Identities of which both sides hold the same lines, as often, number them alike and
    give no event; they go before anything else moves."""
    lines = lines.withColumn("_row_hash", row_hash())
    more = F.sum(F.when(F.col("_side") == "before", 1).otherwise(-1)).over(Window.partitionBy("_identity_hash", "_row_hash"))
    differs = F.max(F.col("_more") != 0).over(Window.partitionBy("_identity_hash"))
    lines = numbered(lines.withColumn("_more", more).withColumn("_differs", differs).filter("_differs"), "_side")
    sides = [F.when(F.col("_side") == s, _version()).alias(s) for s in SIDES]
    return _events(lines.select(F.col("_record_key").alias("record_key"), *sides), run_token)


def _events(versions: DataFrame, run_token: str | None) -> DataFrame:
    records = versions.groupBy("record_key").agg(*[F.any_value(s, ignoreNulls=True).alias(s) for s in SIDES])
    changed = records.filter(~F.col("before.hash").eqNullSafe(F.col("after.hash")))
    columns = {"operation": F.when(F.isnull("before"), "INSERT").when(F.isnull("after"), "DELETE").otherwise("UPDATE")}
    for part in ("hash", "date"):
        columns |= {f"{s}_{part}": F.col(f"{s}.{part}") for s in SIDES}
    columns |= {f"{s}_payload": F.to_json(F.struct(*[F.col(f"{s}.{c}").alias(c) for c in BUSINESS])) for s in SIDES}
    if run_token is not None:
        columns |= {"run_token": F.lit(run_token), "detected_at": F.current_timestamp()}
    return changed.select("record_key", *[value.alias(name) for name, value in columns.items()])


def change_counts(changes: DataFrame) -> DataFrame:
    return changes.groupBy("operation").agg(F.count(F.lit(1)).alias("changes"))


def affected_dates(changes: DataFrame) -> DataFrame:
    """The dates before and after, each once."""
    dates = F.explode(F.array("before_date", "after_date")).alias("affected_date")
    return changes.select(dates).filter("affected_date IS NOT NULL").distinct()
