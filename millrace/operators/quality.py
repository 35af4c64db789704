"""Checks that have no rows when all is well, reconciliations, and the profile of a raw snapshot."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import parsing


class CheckFailed(RuntimeError):
    """A reconciliation or a check found a difference."""


def profile(lines: DataFrame) -> DataFrame:
    """One pass: rows, and those without customer or description, cancelled, or with a negative quantity."""
    counted = {
        "missing_customer": parsing.blank(F.col("CustomerID")),
        "missing_description": parsing.blank(F.col("Description")),
        "cancelled": F.upper(F.trim("InvoiceNo")).startswith("C"),
        "negative_quantity": F.col("Quantity").try_cast("double") < 0,
    }
    return lines.agg(F.count(F.lit(1)).alias("total_rows"), *[F.count_if(c).alias(n) for n, c in counted.items()])


def _by(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def counts_by(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """keys, source_count, target_count, difference for every key of either side. One aggregation of both sides at
    once does the work of a full outer join of two, with null keys as keys like any other."""
    marked = source.select(*keys, F.lit(1).alias("s"), F.lit(0).alias("t")).unionByName(target.select(*keys, F.lit(0).alias("s"), F.lit(1).alias("t")))
    out = marked.groupBy(*keys).agg(F.sum("s").alias("source_count"), F.sum("t").alias("target_count"))
    return out.withColumn("difference", F.col("source_count") - F.col("target_count"))


def mismatches(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    return counts_by(source, target, keys).filter("difference <> 0")


def multiset_difference(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """One row: how many rows of source target lacks, and how many it has too many."""
    more = lambda sign: F.coalesce(F.sum(F.greatest(sign * F.col("difference"), F.lit(0))), F.lit(0))
    return counts_by(source, target, keys).agg(more(F.lit(1)).alias("missing_count"), more(F.lit(-1)).alias("extra_count"))


def except_both(source: DataFrame, target: DataFrame, keys: list[str]) -> DataFrame:
    """The same as rows: those that one side has more often, with the side."""
    a, b = source.select(*keys), target.select(*keys)
    return a.exceptAll(b).withColumn("side", F.lit("missing")).unionByName(b.exceptAll(a).withColumn("side", F.lit("extra")))


def silver_union(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, [p.select("batch_date", "row_hash") for p in parts])


def not_unique(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


def nulls(rows: DataFrame, column: str) -> DataFrame:
    return rows.filter(F.col(column).isNull())


def orphans(child: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Values of the child that the parent lacks."""
    values = child.select(F.col(column).alias("value")).filter("value IS NOT NULL")
    return values.join(parent.select(F.col(parent_column).alias("value")), "value", "left_anti")


UNIQUE = {"dim_date": ("date_key", "full_date"), "dim_product": ("product_key", "stock_code"), "dim_country": ("country_key", "country_name"), "fact_sales": ("sales_key",)}
FILLED = UNIQUE | {"fact_sales": ("sales_key", "date_key", "product_key", "country_key")}
REFERENCES = {"date_key": "dim_date", "product_key": "dim_product", "country_key": "dim_country"}


def star_checks(star: dict[str, DataFrame]) -> DataFrame:
    """test, failures: a row for each of the 20 uniqueness, null and reference tests of the star schema."""
    found: list[DataFrame] = []
    for table, columns in FILLED.items():
        # All of a table's null tests are one pass.
        tests: list[Column] = [F.struct(F.lit(f"not_null {table}.{c}").alias("test"), F.count_if(F.col(c).isNull()).alias("failures")) for c in columns]
        found.append(star[table].agg(F.array(*tests).alias("t")).select(F.inline("t")))
    for table, columns in UNIQUE.items():
        found += [not_unique(star[table], c).agg(F.lit(f"unique {table}.{c}").alias("test"), F.count(F.lit(1)).alias("failures")) for c in columns]
    for key, table in REFERENCES.items():
        found.append(orphans(star["fact_sales"], key, star[table], key).agg(F.lit(f"relationship {key}").alias("test"), F.count(F.lit(1)).alias("failures")))
    return reduce(DataFrame.unionByName, found)


def demand_empty(rows: DataFrame, what: str) -> None:
    if some := rows.limit(5).collect():
        raise CheckFailed(f"{what}: {some}")
