"""Bronze and staging projections; typing, rules, duplicate ranks; the split into transactions, duplicates, rejects."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import parsing
from ..functions.keys import row_hash
from ..schemas import PIPELINE_NAME, RAW, SET_ASIDE, TRANSACTION


def bronze(lines: DataFrame, start: date, end: date) -> DataFrame:
    """Dated lines with the run that brings them in; _row_hash is added where it isn't there."""
    if "_row_hash" not in lines.columns:
        lines = lines.withColumn("_row_hash", row_hash())
    day = F.col("_batch_date").cast("date")
    run = {"_run_start_date": F.lit(start).cast("date"), "_run_end_date": F.lit(end).cast("date"), "_pipeline_name": F.lit(PIPELINE_NAME)}
    return lines.withColumns({"_bronze_loaded_at": F.current_timestamp(), "_process_date": day, **run, "invoice_date": day})


def staging(rows: DataFrame) -> DataFrame:
    """The 19 staging columns."""
    own = {"_invoice_timestamp": "invoice_timestamp", "invoice_date": "batch_date", "_row_hash": "row_hash", "_source_file": "source_file", "_converted_at": "converted_at", "_bronze_loaded_at": "bronze_loaded_at", "_process_date": "process_date", "_pipeline_name": "pipeline_name", "_run_start_date": "run_start_date", "_run_end_date": "run_end_date"}
    return rows.select(*[F.col(c).alias(a) for c, a in (RAW | own).items()], F.current_timestamp().alias("temp_loaded_at"))


def typed(rows: DataFrame) -> DataFrame:
    col = F.col
    return rows.withColumns(
        {
            "invoice_no": parsing.filled(col("invoice_no_raw")),
            "stock_code": parsing.filled(col("stock_code_raw")),
            "description": F.coalesce(parsing.filled(col("description_raw")), F.lit("UNKNOWN_PRODUCT")),
            "quantity": parsing.integer(col("quantity_raw")),
            "unit_price": parsing.price(col("unit_price_raw")),
            "customer_id": parsing.filled(col("customer_id_raw")),
            "country": F.coalesce(parsing.filled(col("country_raw")), F.lit("UNKNOWN")),
        }
    )


def reject_reason() -> Column:
    """Every rule that a row breaks, in this order, joined by semicolons; null if none."""
    rules = {
        "MISSING_ROW_HASH": F.col("row_hash").isNull(),
        "MISSING_INVOICE_NO": F.col("invoice_no").isNull(),
        "MISSING_STOCK_CODE": F.col("stock_code").isNull(),
        "INVALID_INVOICE_DATE": F.col("invoice_timestamp").isNull(),
        "INVALID_QUANTITY": F.col("quantity").isNull(),
        "ZERO_QUANTITY": F.col("quantity") == 0,
        "INVALID_UNIT_PRICE": F.col("unit_price").isNull(),
        "NEGATIVE_UNIT_PRICE": F.col("unit_price") < 0,
    }
    return F.nullif(F.concat_ws(";", *[F.when(broken, name) for name, broken in rules.items()]), F.lit(""))


def ruled(rows: DataFrame) -> DataFrame:
    return typed(rows).withColumn("reject_reason", reject_reason())


def ranked(rows: DataFrame) -> DataFrame:
    order = ("temp_loaded_at", "source_file", "invoice_no_raw", "stock_code_raw")
    return rows.withColumn("duplicate_rank", F.row_number().over(Window.partitionBy("row_hash").orderBy(*order)).cast("long"))


def classified(staged: DataFrame) -> DataFrame:
    cancelled = F.coalesce(F.upper("invoice_no").startswith("C"), F.lit(False))
    returned = F.coalesce(F.col("quantity") < 0, F.lit(False))
    return ranked(ruled(staged)).withColumns(
        {
            "customer_type": F.when(F.col("customer_id").isNull(), "GUEST").otherwise("REGISTERED"),
            "transaction_type": F.when(cancelled, "CANCELLATION").when(returned, "RETURN").otherwise("SALE"),
            "is_cancelled": cancelled,
            "is_return": returned,
            # Too large for the type is null, as everywhere: one such row mustn't end the run.
            "line_amount": (F.col("quantity") * F.col("unit_price")).try_cast("decimal(18,4)"),
        }
    )


def transactions(rows: DataFrame) -> DataFrame:
    return rows.filter("reject_reason IS NULL AND duplicate_rank = 1").withColumn("silver_loaded_at", F.current_timestamp()).select(*TRANSACTION)


def _aside(rows: DataFrame, reason: str, time: str) -> DataFrame:
    return rows.withColumn(time, F.current_timestamp()).select(*[c.format(reason=reason, time=time) for c in SET_ASIDE])


def duplicates(rows: DataFrame) -> DataFrame:
    return _aside(rows.filter("reject_reason IS NULL AND duplicate_rank > 1"), "duplicate_rank", "duplicate_detected_at")


def rejects(rows: DataFrame) -> DataFrame:
    return _aside(rows.filter("reject_reason IS NOT NULL"), "reject_reason", "rejected_at")
