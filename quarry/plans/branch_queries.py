"""Compositions and branches of the operators that other queries don't reach, over artifacts of the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import forms
from quarry.operators import documents, holdings, views
from quarry.plans import reports
from quarry.plans.queries import QUERIES, SQL, query
from quarry.plans.source_queries import INDEX_ROW, INFORMATION_TABLE, INVESTMENT, NPORT, POSITION, xml
from quarry.session import shared_folder, spread, table
from quarry.sources import filings, sinks

# ---- documents -------------------------------------------------------------------------------------------------------

_HTML = """concat('<html><head><title>t</title></head><body><ix:header>ITEM 1. Hidden ', repeat('h', 900), '</ix:header><p>ITEM 1. Business</p><p>ITEM 7. Discussion</p><p>ITEM 8. Statements</p>',
'<div style="x; display: none">ITEM 7. Hidden ', repeat('q', 5000), '</div><h2>I T E M 1. Business</h2><p>', repeat('x', CAST(300 + p_size * 10 AS INT)), '</p><p>12</p><h2>Item 7. Discussion</h2><p>', repeat('y', CAST(1900 + p_size * 20 AS INT)),
'</p><h2>Item 8. Statements</h2><p>', repeat('z', 600), '</p></body></html>')"""


@query("""SELECT p_partkey, 'item_1' AS section, CAST(318 + p_size * 10 AS BIGINT) AS n FROM part WHERE 318 + p_size * 10 >= 400 UNION ALL SELECT p_partkey, 'item_7', 1920 + p_size * 20 FROM part UNION ALL SELECT p_partkey, 'item_8', 620 FROM part""")
def html_reports(spark: SparkSession, d: str) -> DataFrame:
    """Reports in HTML with a contents page, hidden blocks, spaced headings and page numbers."""
    found = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", documents.to_sections(F.expr(_HTML)).alias("s"))
    return documents.each_section(found, "s", "p_partkey").select("p_partkey", "section", F.octet_length("text").cast("long").alias("n"))


@query("SELECT p_partkey, 'item_7' AS section, CAST(39 + 1900 + p_size * 10 AS BIGINT) AS n FROM part WHERE 39 + 1900 + p_size * 10 >= 2000")
def discussions_by_title(spark: SparkSession, d: str) -> DataFrame:
    """Reports without items: the discussion is the longest stretch behind its title."""
    report = """concat('Annual report\\n', "MANAGEMENT'S DISCUSSION AND ANALYSIS\\n", repeat('w', 1000), '\\nQUANTITATIVE AND QUALITATIVE\\n', 'MANAGEMENT’S DISCUSSION AND ANALYSIS\\n', repeat('y', CAST(1900 + p_size * 10 AS INT)), '\\n\\nCONSOLIDATED BALANCE SHEETS\\nx')"""
    found = spread(table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey").select("p_partkey", documents.to_sections(F.expr(report)).alias("s"))
    return documents.each_section(found, "s", "p_partkey").select("p_partkey", "section", F.octet_length("text").cast("long").alias("n"))


_UNIT = "concat('We sell ', p_name, ' to homes, offices and schools of every size in the land.')"


@query(f"""WITH u AS (SELECT p_partkey, {_UNIT} AS unit FROM part)
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN NULL WHEN 1 THEN unit ELSE rtrim(repeat(unit || ' ', CAST(800 // (length(unit) + 1) AS INTEGER))) END AS description FROM u""")
def report_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """What reports say of the business: nothing, a sentence, or more than is kept."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").withColumn("unit", F.expr(_UNIT))
    said = F.expr("CASE p_partkey % 3 WHEN 0 THEN 'too short' WHEN 1 THEN unit ELSE repeat(concat(unit, ' '), 15) END")
    report = F.concat(F.lit("<p>Item 1. Business</p><p>Item 1A. Risks</p><h2>Item&nbsp;1. Business</h2><p>Overview</p><p>"), said, F.lit("</p><p>Item 1A. Risks</p><p>many</p>"))
    return p.select("p_partkey", documents.to_description(report).alias("description"))


# ---- portfolios and coverage -----------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({SQL['holdings_diff_series']}) ORDER BY change_type, abs(delta) DESC NULLS LAST, l_suppkey, y, l_partkey, old_value, new_value LIMIT 300")
def largest_changes(spark: SparkSession, d: str) -> DataFrame:
    return holdings.largest_changes(QUERIES["holdings_diff_series"](spark, d)).limit(300)


@query("""WITH y AS (SELECT cik, filing_date, row_number() OVER (PARTITION BY cik ORDER BY filing_date) AS k FROM (SELECT DISTINCT l_suppkey AS cik, CAST(date_trunc('year', l_shipdate) AS DATE) AS filing_date FROM lineitem QUALIFY dense_rank() OVER (PARTITION BY l_suppkey ORDER BY date_trunc('year', l_shipdate) DESC) <= 4)),
p AS (SELECT l_suppkey AS cik, CAST(date_trunc('year', l_shipdate) AS DATE) AS filing_date, l_partkey AS cusip, max(l_quantity) AS w FROM lineitem GROUP BY ALL), r AS (SELECT p.*, k FROM p JOIN y USING (cik, filing_date)),
o AS (SELECT r.cik, r.cusip, r.w, y.filing_date FROM r JOIN y ON r.cik = y.cik AND y.k = r.k + 1)
SELECT coalesce(o.cik, n.cik) AS cik, coalesce(o.filing_date, n.filing_date) AS filing_date, coalesce(o.cusip, n.cusip) AS cusip, CASE WHEN o.w IS NULL THEN 'added' WHEN n.w IS NULL THEN 'removed' ELSE 'changed' END AS change_type, o.w AS old_value, n.w AS new_value, n.w - o.w AS delta
FROM o FULL JOIN (SELECT * FROM r WHERE k > 1) n ON o.cik = n.cik AND o.filing_date = n.filing_date AND o.cusip = n.cusip WHERE o.w IS NULL OR n.w IS NULL OR abs(n.w - o.w) >= 0.1""")
def snapshot_changes(spark: SparkSession, d: str) -> DataFrame:
    """The changes between the four newest yearly snapshots of each supplier."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("cik"), F.trunc("l_shipdate", "year").alias("filing_date"), F.col("l_partkey").alias("cusip"), F.col("l_quantity").alias("weight"))
    return reports.holdings_changes(rows)


_FORM = "CASE o_orderkey % 6 WHEN 0 THEN '10-k' WHEN 1 THEN 'S-2' WHEN 2 THEN 'zz' WHEN 3 THEN '10-Q' WHEN 4 THEN 'yy' || o_orderkey ELSE ' 8-K ' END"
_NAMED, _RETIRED = (", ".join(f"('{f}')" for f in names) for names in (forms.NAMED, forms.RETIRED))


@query(f"""WITH s AS (SELECT {_FORM} AS f FROM orders), n(form) AS (VALUES {_NAMED}), r(form) AS (VALUES {_RETIRED}), p AS (SELECT CASE WHEN upper(trim(f)) IN (SELECT form FROM n) THEN upper(trim(f)) ELSE f END AS form FROM s)
SELECT 'unseen' AS kind, form, CAST(NULL AS BIGINT) AS n FROM n WHERE form NOT IN (SELECT form FROM r) AND form NOT IN (SELECT form FROM p)
UNION ALL SELECT 'unknown', form, count(*) FROM p WHERE form NOT IN (SELECT form FROM n) GROUP BY form HAVING count(*) >= 20
UNION ALL SELECT 'named', NULL, count(DISTINCT form) FROM p WHERE form IN (SELECT form FROM n) UNION ALL SELECT 'other', NULL, count(DISTINCT form) FROM p WHERE form NOT IN (SELECT form FROM n)""")
def form_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Named forms that an index lacks, frequent ones without a name, and how many are which."""
    index = table(spark, d, "orders").select(F.expr(_FORM.replace("'yy' || o_orderkey", "concat('yy', o_orderkey)")).alias("form_type"))
    unseen, unknown, share = reports.form_coverage(index, 20)
    none, no_form = F.lit(None).cast("long").alias("n"), F.lit(None).cast("string").alias("form")
    out = unseen.select(F.lit("unseen").alias("kind"), "form", none).unionByName(unknown.select(F.lit("unknown").alias("kind"), "form", "n"))
    for kind in ("named", "other"):
        out = out.unionByName(share.select(F.lit(kind).alias("kind"), no_form, F.col(f"n_{kind}").alias("n")))
    return out


@query("""SELECT event_id, CASE WHEN event_id % 3 = 2 THEN '' WHEN event_type IN ('signup', 'click') THEN 'earnings' WHEN event_id % 3 = 0 AND event_type = 'view' THEN 'event' ELSE 'other' END AS route FROM events""")
def polled_feed(spark: SparkSession, d: str) -> DataFrame:
    items = F.expr("CASE event_type WHEN 'signup' THEN array('2.02', '9.01') WHEN 'purchase' THEN array('9.01') WHEN 'view' THEN array('8.01', '9.01') WHEN 'click' THEN array('12') ELSE array('') END")
    form = F.expr("CASE event_id % 3 WHEN 0 THEN '8-k' WHEN 1 THEN '8-K/A' ELSE '10-Q' END")
    return reports.polled(table(spark, d, "events").select("event_id", items.alias("items"), form.alias("form_type"))).select("event_id", "route")


# ---- artifacts located and parsed ------------------------------------------------------------------------------------

@query(f"""SELECT 'a' || filing AS accession_number, filing AS cik, name, cusip, value_usd, shares, put_call, weight_pct FROM ({SQL['source_holdings_13f']}) WHERE filing % 4 <> 0 AND filing % 5 <> 0""")
def located_13f(spark: SparkSession, d: str) -> DataFrame:
    """13F filings among others; their information table is found among their documents, where there is one."""
    filed = "CASE s_suppkey % 3 WHEN 0 THEN DATE '2022-12-31' WHEN 1 THEN DATE '2023-01-01' END AS filing_date"
    submissions = table(spark, d, "supplier").selectExpr("s_suppkey AS cik", "concat('a', s_suppkey) AS accession_number", "IF(s_suppkey % 4 = 0, '8-K', '13f-hr') AS form", filed, "'primary_doc.xml' AS primary_document")
    docs = xml(table(spark, d, "lineitem"), "l_suppkey", POSITION, *INFORMATION_TABLE).withColumn("accession_number", F.concat(F.lit("a"), "l_suppkey"))
    kinds = F.explode(F.expr("IF(l_suppkey % 5 = 0, array(struct(1 AS place, '13F-HR' AS type, 'primary_doc.xml' AS name)), array(struct(1 AS place, '13F-HR' AS type, 'primary_doc.xml' AS name), struct(2 AS place, 'Information Table' AS type, 'table.xml' AS name), struct(3 AS place, 'INFORMATION TABLE' AS type, 'other.xml' AS name)))"))
    parts = docs.select("accession_number", kinds.alias("p")).select("accession_number", "p.*")
    contents = docs.select("accession_number", F.explode(F.array(F.lit("table.xml"), F.lit("primary_doc.xml"))).alias("name"), "content")
    rows = reports.located(submissions, parts, contents, "holdings", filings.holdings_13f)
    return rows.select("accession_number", "cik", "name", "cusip", F.col("value_usd").cast("double").alias("value_usd"), F.col("shares").cast("double").alias("shares"), "put_call", "weight_pct")


@query("""SELECT l_suppkey AS cik, 'a' || l_suppkey AS accession_number, 'Issuer ' || l_partkey AS name, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, CAST(count(*) AS BIGINT) AS n, CASE WHEN p_partkey IS NOT NULL THEN 'P' || l_partkey END AS mapped_symbol, p_partkey AS mapped_cik
FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) ON l_partkey = p_partkey WHERE l_suppkey % 4 <> 0 GROUP BY ALL""")
def located_fund_holdings(spark: SparkSession, d: str) -> DataFrame:
    """Investments of fund reports among other filings, with the registrant that each one's name fits."""
    docs = xml(table(spark, d, "lineitem"), "l_suppkey", INVESTMENT, *NPORT).withColumn("accession_number", F.concat(F.lit("a"), "l_suppkey"))
    submissions = table(spark, d, "supplier").selectExpr("s_suppkey AS cik", "concat('a', s_suppkey) AS accession_number", "IF(s_suppkey % 4 = 0, 'NPORT-EX', 'NPORT-P') AS form", "DATE '2024-01-01' AS filing_date", "'primary_doc.xml' AS primary_document")
    listed = table(spark, d, "part").filter("p_partkey % 2 = 0").selectExpr("concat('P', p_partkey) AS symbol", "concat('Issuer ', p_partkey) AS company_name", "p_partkey AS cik")
    found = reports.fund_holdings(submissions, docs.select("accession_number", F.lit("primary_doc.xml").alias("name"), "content"), listed)
    return found.groupBy("cik", "accession_number", "name", "cusip", "mapped_symbol", "mapped_cik").agg(F.count(F.lit(1)).alias("n"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem), p AS (SELECT l_orderkey, string_agg('d' || l_partkey || '.htm:' || CASE WHEN l_linenumber = 7 THEN '12' ELSE 'EX-99.' || l_linenumber END, ';' ORDER BY 'd' || l_partkey || '.htm', CASE WHEN l_linenumber = 7 THEN '12' ELSE 'EX-99.' || l_linenumber END) AS documents FROM l WHERE l_orderkey % 6 <> 0 GROUP BY 1)
SELECT o_orderkey, 'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '24' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '/' || lpad(CAST(o_custkey AS VARCHAR), 10, '0') || '-24-' || lpad(CAST(o_orderkey % 1000000 AS VARCHAR), 6, '0') || '-index.htm' AS index_url,
coalesce(documents, '') AS documents FROM orders LEFT JOIN p ON o_orderkey = l_orderkey""")
def filings_with_index_pages(spark: SparkSession, d: str) -> DataFrame:
    """Filings joined to the pages that list their documents, by the address that a filing's number gives; some pages are lost."""
    accession = F.format_string("%010d-24-%06d", "o_custkey", F.col("o_orderkey") % 1000000)
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("cik"), accession.alias("accession_number"))
    pages = xml(table(spark, d, "lineitem").filter("l_orderkey % 6 != 0").withColumn("filing", F.col("l_orderkey")), "filing", INDEX_ROW, "<html><TABLE>", "</TABLE></html>")
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), "cik", F.lit("/"), F.replace("accession_number", F.lit("-")), F.lit("/"), "accession_number", F.lit("-index.htm"))
    pages = pages.join(o, F.col("filing") == F.col("o_orderkey")).select(url.alias("url"), "o_orderkey", "content")
    found = reports.with_index_pages(o, pages, ("o_orderkey",))
    name = F.transform(F.array_sort(F.transform(F.coalesce("documents", F.array().cast("array<struct<place:int,name:string,type:string>>")), lambda x: F.struct(x["name"].alias("n"), x["type"].alias("t")))), lambda x: F.concat(x["n"], F.lit(":"), x["t"]))
    return found.select("o_orderkey", "index_url", F.array_join(name, ";").alias("documents"))


# ---- sinks -----------------------------------------------------------------------------------------------------------


@query("""SELECT 'csv' AS sink, count(*) AS n, CAST(sum(o_custkey) AS BIGINT) AS total FROM orders UNION ALL SELECT 'by', count(*), count(DISTINCT o_orderpriority) FROM orders UNION ALL SELECT 'letter', count(*), count(DISTINCT upper(left(c_mktsegment, 1))) FROM customer
UNION ALL SELECT 'rolled', count(*), 1 FROM orders UNION ALL SELECT 'append', 2 * count(*), CAST(2 * sum(o_custkey) AS BIGINT) FROM orders UNION ALL SELECT 'texts', count(*), CAST(sum(strlen(text)) AS BIGINT) FROM documents""")
def sinks_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Rows, and a sum or a number of folders, of what each sink wrote; files of 1,000 records are none larger."""
    at = f"{shared_folder(spark)}/quarry/sinks-{uuid.uuid4().hex}"
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    sinks.write_csv(o, f"{at}/csv")
    sinks.write_by(o, f"{at}/by", "o_orderpriority")
    sinks.write_by_letter(table(spark, d, "customer").select("c_custkey", "c_mktsegment"), f"{at}/letter", "c_mktsegment")
    sinks.write_rolled(o, f"{at}/rolled", 1000)
    for _ in range(2):
        sinks.append(o, f"{at}/append")
    sinks.write_texts(table(spark, d, "documents").select(F.col("doc_id").alias("accession_number"), F.col("text").alias("content")), f"{at}/texts", "accession_number", "content")
    n = F.count(F.lit(1)).alias("n")
    largest = spark.read.parquet(f"{at}/rolled").groupBy(F.col("_metadata.file_path")).agg(n).agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    found = {
        "csv": spark.read.option("header", True).schema("o_orderkey long, o_custkey long, o_orderpriority string").csv(f"{at}/csv").agg(n, F.sum("o_custkey").alias("total")),
        "by": spark.read.parquet(f"{at}/by").agg(n, F.count_distinct("o_orderpriority").alias("total")),
        "letter": spark.read.parquet(f"{at}/letter").agg(n, F.count_distinct("letter").alias("total")),
        "rolled": largest.select("n", (F.col("most") <= 1000).cast("long").alias("total")),
        "append": spark.read.parquet(f"{at}/append").agg(n, F.sum("o_custkey").alias("total")),
        "texts": spark.read.parquet(f"{at}/texts").agg(n, F.sum(F.octet_length("content")).cast("long").alias("total")),
    }
    out = None
    for sink, rows in found.items():
        rows = rows.select(F.lit(sink).alias("sink"), "n", "total")
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- views, years and raw reports ------------------------------------------------------------------------------------


@query("""SELECT p_partkey, view, CASE p_partkey % 3 WHEN 0 THEN '**' || p_name || '** 1' WHEN 1 THEN '<b>' || p_name || '</b> 1' ELSE '[binary document: a.pdf]' END AS shown FROM part, (VALUES ('markdown'), ('embedding')) v(view)""")
def documents_in_views(spark: SparkSession, d: str) -> DataFrame:
    """HTML, text and binary documents as Markdown and as prose."""
    p = spread(table(spark, d, "part").select("p_partkey", "p_name"), "p_partkey").selectExpr("p_partkey", "element_at(array('a.htm', 'a.txt', 'a.pdf'), CAST(p_partkey % 3 + 1 AS INT)) AS name", "concat('<b>', p_name, '</b> 1') AS content")
    one = lambda kind, view: p.select("p_partkey", F.lit(kind).alias("view"), views.shown(F.col("name"), F.col("content"), view).alias("shown"))
    return one("markdown", views.MarkdownView()).unionByName(one("embedding", views.EmbeddingView()))


@query("SELECT o_orderkey, CAST(year(o_orderdate) AS INTEGER) AS year FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders)")
def latest_year(spark: SparkSession, d: str) -> DataFrame:
    """The newest year of a table kept by year."""
    at = f"{shared_folder(spark)}/quarry/years-{uuid.uuid4().hex}"
    sinks.write_by(table(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), at, "year")
    return filings.latest_year(spark.read.parquet(at), least=1990).select("o_orderkey", "year")


@query("SELECT 'k=' || coalesce(source, 'none') AS ticker_symbol, CAST(sum(strlen(coalesce(text, '')) + 1) AS BIGINT) AS n_bytes FROM documents GROUP BY 1")
def raw_report_files(spark: SparkSession, d: str) -> DataFrame:
    """Texts in a folder of each source, read whole, with the folder they stand in."""
    at = f"{shared_folder(spark)}/quarry/raw-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select(F.coalesce("source", F.lit("none")).alias("k"), F.coalesce("text", F.lit("")).alias("value"))
    docs.repartition("k").write.partitionBy("k").text(at)
    return filings.raw_reports(spark, at).groupBy("ticker_symbol").agg(F.sum(F.octet_length("raw_text")).cast("long").alias("n_bytes"))


# ---- what is shown and pulled ----------------------------------------------------------------------------------------


@query("""SELECT 'C-' || c_custkey AS symbol, c_custkey AS cik, c_name AS name, CASE WHEN c_custkey % 3 = 0 THEN 'Does ' || c_mktsegment END AS description, CASE WHEN c_custkey % 7 <> 0 THEN CAST(1000 + c_nationkey AS VARCHAR) ELSE 'n/a' END AS sic,
CASE WHEN c_custkey % 5 = 0 THEN 'n/a' ELSE c_mktsegment END AS sector, CASE WHEN c_custkey % 4 = 0 THEN 'n/a' ELSE 'DE' END AS state, CASE WHEN c_custkey % 3 = 0 THEN 'n/a' ELSE 'NYSE, Nasdaq' END AS exchanges, CASE WHEN c_custkey % 6 = 0 THEN 'n/a' ELSE 'Sep 30' END AS fiscal_year_end
FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 9 <> 0""")
def company_cards(spark: SparkSession, d: str) -> DataFrame:
    """Cards of companies asked for by symbol; some symbols aren't listed, some companies have no profile."""
    c = table(spark, d, "customer")
    asked = c.selectExpr("concat(' c.', c_custkey) AS symbol")
    listed = c.filter("c_custkey % 10 != 0").selectExpr("concat('C-', c_custkey) AS symbol", "c_custkey AS cik")
    profiles = c.filter("c_custkey % 9 != 0").selectExpr("c_custkey AS cik", "c_name AS name", "IF(c_custkey % 7 = 0, NULL, CAST(1000 + c_nationkey AS INT)) AS sic", "IF(c_custkey % 5 = 0, NULL, c_mktsegment) AS sector", "IF(c_custkey % 4 = 0, '', 'DE') AS state", "IF(c_custkey % 3 = 0, array(), array('NYSE', 'Nasdaq')) AS exchanges", "IF(c_custkey % 6 = 0, NULL, DATE '2000-09-30') AS fiscal_year_end_date")
    descriptions = c.filter("c_custkey % 3 = 0").selectExpr("c_custkey AS cik", "concat('Does ', c_mktsegment) AS description")
    return reports.company_cards(asked, listed, profiles, descriptions)


_SHOWN = "CASE o_orderkey % 8 WHEN 0 THEN 'NPORT-P' WHEN 1 THEN '10-K' WHEN 2 THEN '4' ELSE '8-K' END"
_NUMBER = "lpad(CAST(o_custkey AS {s}), 10, '0') || '-24-' || lpad(CAST(o_orderkey % 1000000 AS {s}), 6, '0')"


@query(f"""WITH r AS (SELECT o_custkey AS cik, {_NUMBER.format(s="VARCHAR")} AS accession_number, {_SHOWN} AS form, CAST(o_orderdate AS DATE) AS filing_date FROM orders),
p AS (SELECT *, row_number() OVER (PARTITION BY cik ORDER BY filing_date DESC, accession_number) AS place FROM r),
k AS (SELECT *, min(CASE WHEN form = 'NPORT-P' THEN place END) OVER (PARTITION BY cik) AS a, min(CASE WHEN form = '10-K' THEN place END) OVER (PARTITION BY cik) AS u FROM p)
SELECT cik, accession_number, form, filing_date, CAST(place AS INTEGER) AS place, 'https://www.sec.gov/Archives/edgar/data/' || cik || '/' || replace(accession_number, '-', '') AS url FROM k WHERE CASE WHEN a IS NOT NULL THEN place = a ELSE place <= coalesce(u, 1000000) END""")
def newest_or_history(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").selectExpr("o_custkey AS cik", f"{_NUMBER.format(s='STRING')} AS accession_number", f"{_SHOWN} AS form", "CAST(o_orderdate AS DATE) AS filing_date")
    return reports.newest_or_history(rows)


@query("""SELECT l_suppkey, l_orderkey, l_linenumber, CAST(k AS INTEGER) AS index FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, l_orderkey * 10 + l_linenumber) AS k FROM (SELECT DISTINCT l_suppkey, l_orderkey, l_linenumber, l_extendedprice FROM lineitem)) WHERE k <= 510""")
def largest_investments(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("pct_val")).distinct().withColumn("place", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    return reports.largest_investments(rows, ["l_suppkey"]).select("l_suppkey", "l_orderkey", "l_linenumber", "index")


@query("""WITH c AS (SELECT s_suppkey, CASE WHEN s_suppkey % 7 = 0 THEN 'no company' WHEN s_suppkey % 4 = 0 THEN 'no report' WHEN s_suppkey % 5 = 0 OR s_suppkey NOT IN (SELECT l_suppkey FROM lineitem) THEN 'no investments' END AS error FROM supplier)
SELECT 'F-' || s_suppkey AS symbol, error, CAST((SELECT count(*) FROM lineitem WHERE l_suppkey = s_suppkey AND error IS NULL) AS BIGINT) AS n FROM c""")
def fund_pull(spark: SparkSession, d: str) -> DataFrame:
    """Investments of the newest report behind each fund's symbol, written by letter and read back; or what went wrong."""
    s = table(spark, d, "supplier")
    listed = s.filter("s_suppkey % 7 != 0").selectExpr("concat('F-', s_suppkey) AS symbol", "s_suppkey AS cik")
    dates = s.selectExpr("s_suppkey", "explode(array(DATE '2023-01-01', DATE '2024-01-01')) AS filing_date")
    submissions = dates.selectExpr("s_suppkey AS cik", "concat('a', s_suppkey, '-', year(filing_date)) AS accession_number", "IF(s_suppkey % 4 = 0, '10-K', 'NPORT-P') AS form", "filing_date", "'primary_doc.xml' AS primary_document")
    docs = xml(table(spark, d, "lineitem").filter("l_suppkey % 5 != 0"), "l_suppkey", INVESTMENT, *NPORT)
    contents = docs.selectExpr("concat('a', l_suppkey, '-2024') AS accession_number", "'primary_doc.xml' AS name", "content")
    rows, errors = reports.fund_pull(s.selectExpr("concat('f.', s_suppkey, ' ') AS class_ticker"), listed, submissions, contents)
    at = f"{shared_folder(spark)}/quarry/pull-{uuid.uuid4().hex}"
    sinks.write_by_letter(rows, at, "symbol")
    found = spark.read.parquet(at).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))
    return found.select("symbol", F.lit(None).cast("string").alias("error"), "n").unionByName(errors.withColumn("n", F.lit(0).cast("long")))
