"""The star schema: three dimensions about a fact of one row for each transaction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ADJUSTMENTS = ("RETURN", "CANCELLATION")
#: Most keys without a dimension's row that go to the driver and to all tasks; they have 32 characters at most.
FEW = 100_000


def date_key(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def dim_date(sales: DataFrame) -> DataFrame:
    """A row for each date that has transactions; weeks and weekdays as in ISO 8601."""
    days, day = sales.select(F.col("batch_date").alias("full_date")).distinct(), F.col("full_date")
    weekday = F.weekday(day) + 1
    small = {"day_of_month": F.dayofmonth(day), "day_of_week": weekday, "week_of_year": F.weekofyear(day), "month_number": F.month(day), "quarter_number": F.quarter(day), "year_number": F.year(day)}
    small = {n: c.cast("smallint").alias(n) for n, c in small.items()}
    return days.select(
        date_key(day).alias("date_key"), day, small["day_of_month"], small["day_of_week"], F.date_format(day, "EEEE").alias("day_name"), small["week_of_year"],
        small["month_number"], F.date_format(day, "MMMM").alias("month_name"), small["quarter_number"], small["year_number"], weekday.isin(6, 7).alias("is_weekend"),
    )


def dim_product(sales: DataFrame) -> DataFrame:
    """The latest description of each stock code, by time, then load, then hash; one pass, aggregated before the shuffle."""
    latest = sales.groupBy("stock_code").agg(F.max(F.struct("invoice_timestamp", "silver_loaded_at", "row_hash", "description")).alias("last"))
    return latest.select(F.md5("stock_code").alias("product_key"), "stock_code", F.col("last.description").alias("product_name"))


def dim_country(sales: DataFrame) -> DataFrame:
    return sales.select(F.md5("country").alias("country_key"), F.col("country").alias("country_name")).distinct()


def measured(sales: DataFrame) -> DataFrame:
    """The fact's columns."""
    kind, amount = F.col("transaction_type"), F.col("line_amount")
    return sales.select(
        F.col("row_hash").alias("sales_key"), date_key(F.col("batch_date")).alias("date_key"), F.md5("stock_code").alias("product_key"), F.md5("country").alias("country_key"),
        F.col("batch_date").alias("sales_date"), "invoice_no", "customer_id", "customer_type", "invoice_timestamp", "transaction_type", "quantity", "unit_price", amount.alias("net_amount"),
        F.when(kind == "SALE", amount).otherwise(F.lit(0)).cast("decimal(18,4)").alias("sales_amount"),
        F.when(kind.isin(*ADJUSTMENTS), amount).otherwise(F.lit(0)).cast("decimal(18,4)").alias("adjustment_amount"),
        "is_cancelled", "is_return", "source_file",
    )


def fact_sales(sales: DataFrame, dates: DataFrame, products: DataFrame, countries: DataFrame) -> DataFrame:
    """Transactions whose three keys stand in the dimensions. The dimensions only guard, and a fact's row is much longer
    than its keys. So the keys that a dimension lacks are looked for first, each once: none, as a rule. Up to FEW go to
    the fact by broadcast; beyond that the dimensions are semi-joined."""
    fact, guards = measured(sales), {"date_key": dates, "product_key": products, "country_key": countries}
    named = lambda rows, *keys: rows.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).cast("string").alias("value")) for k in keys]))).distinct()
    there = reduce(DataFrame.unionByName, [named(dimension, key) for key, dimension in guards.items()])
    # A null key is in no dimension.
    lacking = named(fact, *guards).join(there, ["name", "value"], "left_anti").limit(FEW + 1).collect()
    for key, dimension in guards.items():
        gone = [r.value for r in lacking if r.name == key]
        if len(lacking) > FEW:
            fact = fact.join(dimension.select(key), key, "left_semi")
        elif gone:
            none = F.broadcast(sales.sparkSession.createDataFrame([(v,) for v in gone], "gone string"))
            fact = fact.join(none, F.col(key).cast("string").eqNullSafe(F.col("gone")), "left_anti")
    return fact.select(*measured(sales).columns)
