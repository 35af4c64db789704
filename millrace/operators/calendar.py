"""Batches of a date range, and windows of consecutive dates: on the driver for plans, as DataFrames for tables."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..schemas import BATCH_DAYS

DAY = timedelta(days=1)


def batches(start: date, end: date, days: int = BATCH_DAYS) -> list[tuple[date, date]]:
    """start to end in pieces of `days` days, the last one as long as is left."""
    count = -(-((end - start).days + 1) // days)
    return [(start + i * days * DAY, min(start + ((i + 1) * days - 1) * DAY, end)) for i in range(count)]


def batch_table(spark: SparkSession, bounds: DataFrame, days: int = BATCH_DAYS) -> DataFrame:
    """batches() of the one row min_date, max_date, as rows."""
    starts = bounds.select("max_date", F.explode(F.sequence("min_date", "max_date", F.make_interval(days=F.lit(days)))).alias("batch_start"))
    return starts.select("batch_start", F.least(F.date_add("batch_start", days - 1), "max_date").alias("batch_end"))


def windows(dates: Iterable[date]) -> list[tuple[date, date]]:
    """The dates as ranges without gaps."""
    out: list[tuple[date, date]] = []
    for day in sorted(set(dates)):
        if out and day - out[-1][1] == DAY:
            out[-1] = (out[-1][0], day)
        else:
            out.append((day, day))
    return out


def window_table(dates: DataFrame, column: str) -> DataFrame:
    """windows() as rows: consecutive dates share their distance to the row number. The rows are dates, so few."""
    island = F.date_sub(column, F.row_number().over(Window.orderBy(column)))
    marked = dates.select(column).distinct().withColumn("island", island)
    return marked.groupBy("island").agg(F.min(column).alias("window_start"), F.max(column).alias("window_end")).drop("island")
