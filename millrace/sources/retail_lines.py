"""Retail lines made from order tables: the landing schema, with guests, dirt and exact duplicates dealt by key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def retail_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BUSINESS columns. Dimension tables are left to Spark to broadcast, which checks their size."""
    read = lambda name, *cols: spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*cols)
    lines = read("lineitem", "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus")
    orders = read("orders", "o_orderkey", "o_custkey", "o_orderdate")
    buyers = read("customer", "c_custkey", "c_nationkey").join(read("nation", "n_nationkey", "n_name"), F.col("c_nationkey") == F.col("n_nationkey"))
    joined = lines.join(orders.join(buyers, F.col("o_custkey") == F.col("c_custkey")), F.col("l_orderkey") == F.col("o_orderkey"))
    joined = joined.join(read("part", "p_partkey", "p_name"), F.col("l_partkey") == F.col("p_partkey"))
    # One in fifty orders stands twice.
    joined = joined.withColumn("copy", F.explode(F.when(F.col("l_orderkey") % 50 == 0, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    key = F.col("l_orderkey")
    sign = F.when(F.col("l_returnflag") == "R", "-").otherwise("")
    return joined.select(
        F.concat(F.when((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F"), "C").otherwise(""), F.col("o_orderkey").cast("string")).alias("InvoiceNo"),
        F.concat(F.lit("P"), F.col("l_partkey").cast("string")).alias("StockCode"),
        F.when(key % 89 == 0, "  ").otherwise(F.col("p_name")).alias("Description"),
        F.when(key % 499 == 1, "0").when(key % 503 == 1, "abc").otherwise(F.concat(sign, F.col("l_quantity").cast("long").cast("string"))).alias("Quantity"),
        F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("InvoiceDate"),
        F.when(key % 509 == 1, "-1.5").when(key % 521 == 1, "5.").otherwise(F.col("l_extendedprice").cast("decimal(18,2)").cast("string")).alias("UnitPrice"),
        F.when(F.col("o_custkey") % 10 == 0, "").otherwise(F.col("o_custkey").cast("string")).alias("CustomerID"),
        F.col("n_name").alias("Country"),
    )
