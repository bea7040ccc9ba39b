"""Sinks, stores and interval joins over the driver's tables: what is written is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators import entities
from quarry.plans.queries import query
from quarry.session import shared_folder, table
from quarry.sources import cache, filings, sinks


def _new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/quarry/{name}-{uuid.uuid4().hex}"


_MOST = 60_000


@query(f"""WITH s AS (SELECT doc_id, strlen(coalesce(text, '')) AS size FROM documents), l AS (SELECT coalesce(max(size) FILTER (WHERE size <= {_MOST // 2}), 0) AS largest FROM s),
b AS (SELECT size, CAST(coalesce(sum(CASE WHEN size <= {_MOST // 2} THEN size ELSE 0 END) OVER w, 0) AS BIGINT) AS before, CAST(coalesce(sum(CASE WHEN size > {_MOST // 2} THEN 1 ELSE 0 END) OVER w, 0) AS BIGINT) AS alone
FROM s WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT CASE WHEN size > {_MOST // 2} THEN 'alone-' || lpad(CAST(alone AS VARCHAR), 8, '0') ELSE 'rolled-' || lpad(CAST(before // ({_MOST} - largest) AS VARCHAR), 8, '0') END AS file, count(*) AS n_rows, CAST(sum(size) AS BIGINT) AS n_bytes, CAST(1 AS BIGINT) AS n_files
FROM b, l GROUP BY 1""")
def rolled_files(spark: SparkSession, d: str) -> DataFrame:
    """documents in files of 60,000 bytes of text at most; what the files hold."""
    at = _new_folder(spark, "rolled")
    sinks.write_rolled_by_bytes(table(spark, d, "documents"), at, "doc_id", F.octet_length("text"), _MOST)
    found = spark.read.parquet(at).select("file", "text", F.col("_metadata.file_path").alias("path"))
    return found.groupBy("file").agg(F.count(F.lit(1)).alias("n_rows"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("n_bytes"), F.count_distinct("path").alias("n_files"))


@query("""WITH q AS (SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q FROM orders GROUP BY ALL ORDER BY count(*) DESC, y, q LIMIT 3)
SELECT CAST(y AS INTEGER) AS year, CAST(q AS INTEGER) AS quarter, CAST(o_custkey AS VARCHAR) AS cik, o_orderpriority AS form_type, CAST(o_orderdate AS DATE) AS date_filed, o_orderkey || '.txt' AS filename
FROM orders JOIN q ON year(o_orderdate) = y AND quarter(o_orderdate) = q""")
def quarterly_index(spark: SparkSession, d: str) -> DataFrame:
    """An index of each quarter, parsed and kept by quarter; the three largest quarters are read."""
    o = table(spark, d, "orders").withColumns({"year": F.year("o_orderdate"), "quarter": F.quarter("o_orderdate")})
    line = F.concat_ws("|", "o_custkey", F.lit("Name"), "o_orderpriority", F.date_format("o_orderdate", "yyyy-MM-dd"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".txt")))
    month = F.month("o_orderdate")  # a file of each month, as if a quarter came in parts
    files = o.groupBy("year", "quarter", month).agg(F.concat(F.lit("CIK|Company Name|Form Type|Date Filed|Filename\n---\n"), F.array_join(F.collect_list(line), "\n")).alias("content"))
    docs = files.select(F.format_string("edgar/full-index/%d/QTR%d/master.idx", "year", "quarter").alias("path"), "content")
    at = _new_folder(spark, "index")
    sinks.write_quarters(filings.index_files(docs).drop("year", "quarter"), at, "date_filed")
    largest = o.groupBy("year", "quarter").count().orderBy(F.desc("count"), "year", "quarter").limit(3)
    return filings.quarters_of(spark, at, largest).select("year", "quarter", "cik", "form_type", "date_filed", "filename")


@query("""WITH a AS (SELECT url AS key, md5(coalesce(html, '')) || page_id % 3 AS content, TIMESTAMP '2024-05-01 00:00:00' + INTERVAL 1 DAY * r AS fetched_at FROM pages, range(3) AS t(r) WHERE url IS NOT NULL AND (page_id % 3 = r OR page_id % 4 = r)),
n AS (SELECT key, max(fetched_at) AS fetched_at FROM a GROUP BY 1)
SELECT key, max(content) AS content, strftime(fetched_at, '%Y-%m-%d') AS fetched_on FROM a JOIN n USING (key, fetched_at) WHERE fetched_at > TIMESTAMP '2024-05-01 12:00:00' GROUP BY key, fetched_at""")
def cache_rounds(spark: SparkSession, d: str) -> DataFrame:
    """Three days of answers for some pages each, the last day's read by those of two days and a half."""
    p = table(spark, d, "pages").withColumn("content", F.concat(F.md5(F.coalesce("html", F.lit(""))), (F.col("page_id") % 3).cast("string")))
    at = _new_folder(spark, "cache")
    time = lambda day: F.to_timestamp(F.lit(f"2024-05-0{day}"))
    for r in range(3):
        answers = p.filter((F.col("page_id") % 3 == r) | (F.col("page_id") % 4 == r)).select(F.col("url").alias("key"), "content", time(r + 1).alias("fetched_at"))
        cache.upsert(answers, at, now=time(r + 1))
    return cache.cached(spark, at, 60 * 3600, time(4)).select("key", "content", F.date_format("fetched_at", "yyyy-MM-dd").alias("fetched_on"))


@query("""WITH r AS (SELECT p_partkey AS label, CAST(floor(p_retailprice * 100) AS BIGINT) AS low, p_size + CASE WHEN p_partkey % 500 = 0 THEN 20000 ELSE 0 END - CASE WHEN p_partkey % 50 = 7 THEN 100 ELSE 0 END AS width FROM part)
SELECT o_orderkey, label AS part FROM orders LEFT JOIN r ON CAST(floor(o_totalprice) AS BIGINT) BETWEEN low AND low + width""")
def price_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Orders by the price ranges of parts: overlapping, narrow, wide and empty ones."""
    low, width = F.floor(F.col("p_retailprice") * 100), F.expr("p_size + IF(p_partkey % 500 = 0, 20000, 0) - IF(p_partkey % 50 = 7, 100, 0)")
    ranges = table(spark, d, "part").select(low.alias("low"), (low + width).alias("high"), F.col("p_partkey").alias("label"))
    orders = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").alias("price"))
    return entities.in_ranges(orders, "price", ranges, "low", "high", "label", "part").drop("price")
