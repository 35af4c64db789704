"""The standing questions over the star schema. The fact is aggregated by its keys before a dimension is joined."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .gold import ADJUSTMENTS


def _money(name: str) -> Column:
    return F.sum(name).cast("decimal(18,2)")


def _turnover() -> list[Column]:
    amounts = {"gross_sales": "sales_amount", "adjustments": "adjustment_amount", "net_sales": "net_amount"}
    people = F.count_distinct(F.nullif(F.col("customer_id"), F.lit("GUEST")))
    return [*[_money(c).alias(n) for n, c in amounts.items()], F.count_distinct("invoice_no").alias("invoice_count"), people.alias("identified_customer_count")]


def country_sales(fact: DataFrame, countries: DataFrame) -> DataFrame:
    # country_key is one to one with country_name, so the group may be formed first.
    out = fact.groupBy("country_key").agg(*_turnover()).join(countries, "country_key").drop("country_key")
    return out.select("country_name", "gross_sales", "adjustments", "net_sales", "invoice_count", "identified_customer_count").orderBy(F.desc_nulls_first("net_sales"), "country_name")


def monthly_trend(fact: DataFrame, dates: DataFrame) -> DataFrame:
    months = dates.select("date_key", F.trunc("full_date", "MM").alias("sales_month"))
    return fact.join(months, "date_key").groupBy("sales_month").agg(*_turnover()).orderBy("sales_month")


def product_adjustment_rate(fact: DataFrame, products: DataFrame) -> DataFrame:
    lost = F.sum(F.when(F.col("transaction_type").isin(*ADJUSTMENTS), F.col("quantity")))
    per = fact.groupBy("product_key").agg(F.sum("sales_amount").alias("sold"), F.abs(F.sum("adjustment_amount")).alias("lost"), F.abs(lost).alias("adjusted_units"))
    rate = F.when(F.col("sold") != 0, (F.col("lost") / F.col("sold")).cast("decimal(12,4)"))
    out = per.filter("sold > 0").join(products, "product_key")
    out = out.select("stock_code", "product_name", F.col("sold").cast("decimal(18,2)").alias("gross_sales"), F.col("lost").cast("decimal(18,2)").alias("adjustment_value"), rate.alias("adjustment_rate"), "adjusted_units")
    return out.orderBy(F.desc_nulls_first("adjustment_rate"), F.desc_nulls_first("adjustment_value"), "stock_code")


def top_returned(fact: DataFrame, products: DataFrame, k: int = 10) -> DataFrame:
    """Ties go to the smaller stock code. All but the k products fall away before names are joined."""
    per = fact.filter(F.col("transaction_type").isin(*ADJUSTMENTS)).groupBy("product_key").agg(F.abs(F.sum("quantity")).alias("returned_cancelled_units"))
    named = per.join(products, "product_key").orderBy(F.desc_nulls_first("returned_cancelled_units"), "stock_code").limit(k)
    return named.select(F.concat("product_name", F.lit(" ("), "stock_code", F.lit(")")).alias("product"), "returned_cancelled_units")
