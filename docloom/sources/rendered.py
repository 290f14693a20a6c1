"""Texts and responses rendered from the star-schema tables, with known contents.

Each is a SQL statement that Spark and DuckDB both run on views of the tables.
"""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession, functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "benchmark")
SCAN_CODES = ("CN", "DE", "RU", "KZ", "KG", "AE", "US", "IT", "TR", "KR", "JP", "IN", "PL", "CZ")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def run(spark: SparkSession, sf_dir: str, statement: str) -> DataFrame:
    """A statement over the tables it names, written as {orders}; others are not read."""
    for t in TABLES:
        if "{" + t + "}" in statement:
            # A view of its own for each folder; str.format would take the braces of JSON literals for names.
            view = f"{t}_{zlib.crc32(sf_dir.encode()):08x}"
            table(spark, sf_dir, t).createOrReplaceTempView(view)
            statement = statement.replace("{" + t + "}", view)
    return spark.sql(statement)


#: One line item by order, with a position that is unique in the order.
ITEMS = """
SELECT l_orderkey AS doc_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INT) AS position,
  p_name AS name, CAST(l_quantity AS INT) AS quantity, CAST(round(p_retailprice * 10) AS BIGINT) AS price, CAST(round(l_extendedprice * 10) AS BIGINT) AS cost,
  CAST(8400000000 + l_partkey AS STRING) AS hs_code, CAST(l_suppkey % 14 AS INT) AS country
FROM {lineitem} JOIN {part} ON l_partkey = p_partkey
"""


def rendered_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, ocr_text): an OCR-like invoice for each order."""
    items = run(spark, sf_dir, ITEMS)
    code = F.element_at(F.array(*[F.lit(c) for c in SCAN_CODES]), F.col("country") + 1)
    row = F.concat_ws(" ", F.col("position").cast("string"), "name", code, "hs_code", F.col("quantity").cast("string"), F.lit("pcs"), F.col("price").cast("string"), F.col("cost").cast("string"))
    rows = items.select("doc_id", "position", row.alias("row")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "row"))).alias("rows"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "dd.MM.yyyy").alias("day"))
    text = F.concat(
        F.lit("Invoice No. "), F.lpad(F.col("doc_id").cast("string"), 9, "0"), F.lit("\r\ndated "), "day", F.lit("\r\n\r\nCurrency: USD   terms\r\nDescription HS code Qty Price\r\n"),
        F.array_join(F.col("rows.row"), "\r\n"), F.lit("\r\nИтого 0\r\n"),
    )
    return rows.join(orders, "doc_id").select("doc_id", text.alias("ocr_text"))


#: Line-item rows as primary items with gaps, and as a helper's, some rows missing.
SIDES = """
SELECT doc_id, position, CASE WHEN position % 3 = 1 THEN NULL ELSE name END AS description, CASE WHEN position % 4 = 2 THEN '-' ELSE 'pcs' END AS unit,
  CASE WHEN position % 5 = 3 THEN NULL ELSE CAST(quantity AS DOUBLE) END AS quantity, CASE WHEN position % 2 = 0 THEN ' None ' ELSE hs_code END AS hs_code
FROM (""" + ITEMS + """) x WHERE doc_id % 7 <> 3
"""
HELPER = """
SELECT doc_id, position, name AS description, 'box' AS unit, CAST(quantity AS DOUBLE) AS quantity, CASE WHEN position % 6 = 0 THEN 'null' ELSE hs_code END AS hs_code
FROM (""" + ITEMS + """) x WHERE doc_id % 5 <> 2 AND (doc_id % 3 <> 1 OR position <= 2)
"""

#: Document texts with carriage returns, tabs, NBSP, blank runs, tags, Markdown and pipes put in.
NOISY = """
SELECT doc_id, CASE doc_id % 6
  WHEN 0 THEN replace(text, '. ', '.' || chr(13) || chr(10) || chr(10) || chr(10) || chr(10))
  WHEN 1 THEN chr(9) || replace(text, ' of ', chr(9) || '  of   ') || '  ' || chr(10)
  WHEN 2 THEN replace(text, ' the ', ' ' || chr(160) || 'the' || chr(13))
  WHEN 3 THEN '![scan](a.png)' || chr(10) || '## ' || replace(text, ', ', ' <b>,</b> ')
  WHEN 4 THEN substr(text, 1, 200) || chr(10) || 'a | b | c | d' || chr(10) || substr(text, 201)
  ELSE CASE doc_id % 4 WHEN 1 THEN ' n/a ' WHEN 3 THEN '![x](y) # ab1' ELSE text END END AS text
FROM {documents}
"""
