"""The tables of a directory in the roles of the bill store: orders are bills, line items their items, customers the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("bill_id"), F.col("o_custkey").alias("document_id"), F.col("o_totalprice").cast("decimal(14,2)").alias("printed_total"), "o_orderdate", "o_orderstatus")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("bill_id"),
        F.col("l_linenumber").alias("serial_no"),
        F.col("l_partkey").alias("part_id"),
        F.col("l_quantity").cast("decimal(12,3)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("rate"),
        (F.col("l_tax") * 100).cast("decimal(5,2)").alias("gst_rate"),
        F.col("l_discount").alias("confidence_gap"),
        "l_shipdate",
    )


#: The same for SQL.
ITEMS_SQL = """items AS (
    SELECT l_orderkey AS bill_id, l_linenumber AS serial_no, l_partkey AS part_id, CAST(l_quantity AS DECIMAL(12,3)) AS quantity,
           CAST(l_extendedprice AS DECIMAL(14,2)) AS rate, CAST(l_tax * 100 AS DECIMAL(5,2)) AS gst_rate, l_discount AS confidence_gap, l_shipdate
    FROM lineitem)"""
BILLS_SQL = """bills AS (
    SELECT o_orderkey AS bill_id, o_custkey AS document_id, CAST(o_totalprice AS DECIMAL(14,2)) AS printed_total, o_orderdate, o_orderstatus FROM orders)"""
#: The amounts of an item.
LINE_SQL = "round(quantity * rate, 2)::DECIMAL(18,2)"
PRICED_SQL = f"""priced AS (
    SELECT *, (line_amount + tax_amount)::DECIMAL(18,2) AS total_amount FROM (
        SELECT *, round(line_amount * gst_rate * CAST(0.01 AS DECIMAL(2,2)), 2)::DECIMAL(18,2) AS tax_amount FROM (
            SELECT *, {LINE_SQL} AS line_amount FROM items)))"""

#: Pixels of the fixed pitch on which document tokens become words: a character, the space between words, a line and its letters.
CHAR, GAP, LINE, HEIGHT = 11, 9, 37, 22


def words(spark: SparkSession, sf_dir: str, dealt: bool = False) -> DataFrame:
    """Tokens of every document's lines as words on a fixed pitch: a wide gap before every fourth.

    ``dealt``: the documents are dealt by ``doc_id`` first, so that their words, many times as large, stay where they are made.
    """
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    documents = documents.repartition("doc_id") if dealt else documents
    text = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line", "line_text"))
    token = text.select("doc_id", "line", F.posexplode(F.regexp_extract_all("line_text", F.lit(r"[^ \t\r]+"), 0)).alias("i", "text"))
    before = F.coalesce(F.sum(F.length("text") * CHAR + F.when(F.col("i") % 4 == 3, GAP + 100).otherwise(GAP)).over(Window.partitionBy("doc_id", "line").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return token.select(
        "doc_id", F.lit(0).alias("page"), (F.col("line").cast("long") * 100_000 + F.col("i")).alias("word_ord"), "text", F.lit(92.0).alias("confidence"), before.cast("int").alias("left"),
        (F.col("line") * LINE).alias("top"), (F.length("text") * CHAR).alias("width"), F.lit(HEIGHT).alias("height"), F.col("line").alias("line_num"), F.lit(1).alias("block_num"), F.lit(1).alias("par_num"),
    )


WORDS_SQL = f"""text_lines AS (
    SELECT doc_id::VARCHAR AS doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line_text, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS line FROM documents),
tokens AS (
    SELECT doc_id, line, unnest(w) AS text, generate_subscripts(w, 1) - 1 AS i
    FROM (SELECT doc_id, line, regexp_extract_all(line_text, '[^ \\t\\r]+') AS w FROM text_lines)),
words AS (
    SELECT doc_id, line, i, text, length(text) * {CHAR} AS width,
           coalesce(sum(length(text) * {CHAR} + CASE WHEN i % 4 = 3 THEN {GAP + 100} ELSE {GAP} END)
               OVER (PARTITION BY doc_id, line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS x
    FROM tokens)"""
