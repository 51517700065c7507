"""Entities of the catalogue over the given tables: price records, quotations and their lines, chats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def price_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, product, sku, section, size, price, text."""
    text = F.concat_ws(" ", "p_name", "p_brand", "p_type", F.concat(F.col("p_size").cast("string"), F.lit("mm")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("product"), F.col("p_brand").alias("sku"), F.col("p_type").alias("section"), F.col("p_size").alias("size"), F.col("p_retailprice").alias("price"), text.alias("text"))


PRICE_RECORDS_SQL = "SELECT p_partkey AS id, p_name AS product, p_brand AS sku, p_type AS section, p_size AS size, p_retailprice AS price, concat_ws(' ', p_name, p_brand, p_type, CAST(p_size AS VARCHAR) || 'mm') AS text FROM part"


def quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, customer, status, discount_pct, gst_pct, freight, updated_at."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    status = F.when(F.col("o_orderstatus") == "O", "draft").when(F.col("o_orderstatus") == "F", "sent").otherwise("archived")
    joined = o.join(c, o.o_custkey == c.c_custkey, "left")
    return joined.select(F.col("o_orderkey").alias("id"), F.coalesce(F.nullif(F.trim("c_name"), F.lit("")), F.lit("No customer")).alias("customer"), status.alias("status"), (F.col("o_orderkey") % 11).cast("int").alias("discount_pct"), F.lit(18).alias("gst_pct"), (F.col("o_orderkey") % 500).cast("int").alias("freight"), F.col("o_orderdate").alias("updated_at"))


QUOTATIONS_SQL = """SELECT o_orderkey AS id, coalesce(nullif(trim(c_name), ''), 'No customer') AS customer, CASE o_orderstatus WHEN 'O' THEN 'draft' WHEN 'F' THEN 'sent' ELSE 'archived' END AS status,
CAST(o_orderkey % 11 AS INTEGER) AS discount_pct, 18 AS gst_pct, CAST(o_orderkey % 500 AS INTEGER) AS freight, o_orderdate AS updated_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey"""


def quotation_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """quotation_id, line_no, qty, unit_price, amount (decimals, so that sums do not depend on their order), vendor, part."""
    items, s = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    price = (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100 + 0.5) / 100).cast("decimal(14,2)")
    qty = F.col("l_quantity").cast("decimal(14,3)")
    joined = items.join(s, items.l_suppkey == s.s_suppkey, "left").withColumn("unit_price", price).withColumn("qty", qty)
    return joined.select(F.col("l_orderkey").alias("quotation_id"), F.col("l_linenumber").alias("line_no"), "qty", "unit_price", (F.col("qty") * F.col("unit_price")).cast("decimal(30,5)").alias("amount"), F.coalesce(F.nullif(F.trim("s_name"), F.lit("")), F.lit("No vendor")).alias("vendor"), F.col("l_partkey").alias("part"))


ITEMS_SQL = """SELECT *, CAST(qty * unit_price AS DECIMAL(30,5)) AS amount FROM (SELECT l_orderkey AS quotation_id, l_linenumber AS line_no, CAST(l_quantity AS DECIMAL(14,3)) AS qty,
CAST(floor(l_extendedprice / l_quantity * 100 + 0.5) / 100 AS DECIMAL(14,2)) AS unit_price, coalesce(nullif(trim(s_name), ''), 'No vendor') AS vendor, l_partkey AS part FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey)"""
