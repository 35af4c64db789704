"""The landing snapshot: one CSV file of text columns, prepared and split into dated lines and quarantine."""

from __future__ import annotations

from datetime import date
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..schemas import ALIASES, BUSINESS


def discover(folder: str, spark: SparkSession | None = None) -> str:
    """The one CSV file in folder, whatever the case of its ending; with a session, in any store that Spark reaches."""
    if spark is None:
        names = [str(p) for p in Path(folder).iterdir() if p.is_file()]
    else:
        place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        names = [f.getPath().toString() for f in fs.listStatus(place) if f.isFile()]
    found = sorted(n for n in names if n.lower().endswith(".csv"))
    if not found:
        raise FileNotFoundError(f"no CSV file in {folder}")
    if len(found) > 1:
        raise RuntimeError(f"one CSV file is expected in {folder}, there are {len(found)}")
    return found[0]


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text; quotes are doubled inside quotes; short rows end in nulls."""
    return spark.read.options(header=True, inferSchema=False, mode="PERMISSIVE", quote='"', escape='"').csv(path)


def conformed(raw: DataFrame) -> DataFrame:
    """raw with the accepted older names replaced; ValueError names the columns that are missing."""
    raw = raw.withColumnsRenamed({old: new for old, new in ALIASES.items() if old in raw.columns and new not in raw.columns})
    if missing := [c for c in BUSINESS if c not in raw.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return raw.select(*[F.col(c).cast("string") for c in BUSINESS])


def timed(lines: DataFrame) -> DataFrame:
    """lines with _invoice_timestamp, null where no format fits."""
    return lines.withColumn("_invoice_timestamp", parsing.timestamp(F.col("InvoiceDate")))


def dated(lines: DataFrame, source_file: str | None = None) -> DataFrame:
    """lines with _invoice_timestamp, where it isn't there yet, _batch_date, _source_file and _converted_at."""
    lines = lines if "_invoice_timestamp" in lines.columns else timed(lines)
    return lines.withColumns(
        {"_batch_date": F.to_date("_invoice_timestamp"), "_source_file": F.input_file_name() if source_file is None else F.lit(source_file), "_converted_at": F.current_timestamp()}
    )


def in_range(lines: DataFrame, start: date | None, end: date | None, undated: bool = False, column: str = "_batch_date") -> DataFrame:
    """Lines dated start to end, both included; with undated also those without a date."""
    if start is None or end is None:
        return lines if undated else lines.filter(F.col(column).isNotNull())
    inside = F.col(column).between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    return lines.filter(inside | F.col(column).isNull() if undated else inside)


def split(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Dated lines, and the quarantine."""
    return lines.filter(F.col("_batch_date").isNotNull()), lines.filter(F.col("_batch_date").isNull())


def date_range(lines: DataFrame) -> DataFrame:
    """One row: first and last date, rows with and without a date."""
    return lines.agg(F.min("_batch_date").alias("min_date"), F.max("_batch_date").alias("max_date"), F.count("_batch_date").alias("valid_rows"), F.count_if(F.col("_batch_date").isNull()).alias("invalid_rows"))


def read(spark: SparkSession, folder: str) -> DataFrame:
    return dated(conformed(scan(spark, discover(folder, spark))))
