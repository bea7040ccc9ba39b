"""The readers applied to artifacts that are built from the driver's tables, and the SQL that gives their rows directly.

Artifacts hold faults on purpose: malformed texts, missing members, bad numbers and dates.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import table_functions, urls
from quarry.operators import coverage, entities
from quarry.plans import reports
from quarry.plans.queries import SQL, query
from quarry.session import BY_TASKS, shared_folder, spread, table
from quarry.sources import filings

_ACCESSION = "concat(lpad(CAST(o_custkey AS {s}), 10, '0'), '-', lpad(CAST(year(o_orderdate) % 100 AS {s}), 2, '0'), '-', lpad(CAST(o_orderkey % 1000000 AS {s}), 6, '0'))"
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"


def _orders(spark: SparkSession, d: str) -> DataFrame:
    """orders with the customer's name, the day as text and an accession number."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return o.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd")).withColumn("accn", F.expr(_ACCESSION.format(s="STRING")))


def _mapped(rows: DataFrame, keys: list[str], key: str, value: Column, out: str) -> DataFrame:
    """A map for each of keys; the pairs of a map come in key order."""
    return rows.groupBy(*keys).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col(key).alias("k"), F.to_json(value).alias("v"))))).alias(out))


def _json_of(pairs: str) -> Column:
    """A map of names to JSON texts as a JSON object."""
    quoted = F.transform(F.map_entries(pairs), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"]))
    return F.concat(F.lit("{"), F.array_join(quoted, ","), F.lit("}"))


def _broken(docs: DataFrame, *contents: str) -> DataFrame:
    """docs and a few artifacts that no reader can use."""
    return docs.select("content").unionByName(docs.sparkSession.createDataFrame([(c,) for c in contents], "content string"))


# ---- JSON ------------------------------------------------------------------------------------------------------------


def _facts_content(spark: SparkSession, d: str) -> DataFrame:
    o = _orders(spark, d).withColumn("taxonomy", F.expr("IF(o_orderstatus = 'F', 'dei', 'us-gaap')")).withColumn("unit", F.expr("IF(o_orderkey % 4 = 0, 'shares', 'USD')"))
    observation = F.struct(
        F.col("day").alias("end"),
        F.expr("IF(o_orderkey % 7 = 0, NULL, o_totalprice)").alias("val"),
        "accn",
        F.expr("IF(o_orderkey % 5 = 0, NULL, CAST(year(o_orderdate) AS BIGINT))").alias("fy"),
        F.expr("IF(o_orderkey % 3 = 0, NULL, concat('Q', quarter(o_orderdate)))").alias("fp"),
        F.lit("10-K").alias("form"),
        F.col("day").alias("filed"),
    )
    keys = ["o_custkey", "c_name", "taxonomy", "o_orderpriority"]
    units = o.groupBy(*keys, "unit").agg(F.collect_list(observation).alias("rows"))
    facts = _mapped(units, keys, "unit", F.col("rows"), "units").withColumn("fact", F.concat(F.lit('{"label":"L","units":'), _json_of("units"), F.lit("}")))
    names = facts.groupBy(*keys[:3]).agg(F.map_from_entries(F.collect_list(F.struct(F.col("o_orderpriority").alias("key"), F.col("fact").alias("value")))).alias("m")).withColumn("j", _json_of("m"))
    whole = names.groupBy(*keys[:2]).agg(F.map_from_entries(F.collect_list(F.struct(F.col("taxonomy").alias("key"), F.col("j").alias("value")))).alias("m"))
    return whole.select(F.concat(F.lit('{"cik":'), F.col("o_custkey").cast("string"), F.lit(',"entityName":"'), "c_name", F.lit('","facts":'), _json_of("m"), F.lit("}")).alias("content"))


@query(f"""SELECT o_custkey AS cik, c_name AS entity_name, CASE WHEN o_orderstatus = 'F' THEN 'dei' ELSE 'us-gaap' END AS taxonomy, o_orderpriority AS fact_name,
CASE WHEN o_orderkey % 4 = 0 THEN 'shares' ELSE 'USD' END AS unit, {_DAY} AS "end", CASE WHEN o_orderkey % 7 = 0 THEN 0.0::DOUBLE ELSE o_totalprice END AS value, {_ACCESSION.format(s='VARCHAR')} AS accn,
CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(year(o_orderdate) AS BIGINT) END AS fy, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'Q' || quarter(o_orderdate) END AS fp, '10-K' AS form, {_DAY} AS filed
FROM orders JOIN customer ON o_custkey = c_custkey""")
def source_company_facts(spark: SparkSession, d: str) -> DataFrame:
    return filings.company_facts(_broken(_facts_content(spark, d), '{"cik": 5', '{"cik": 5, "entityName": "none"}', ""))


_BLOCK = [("accessionNumber", "a"), ("filingDate", "d"), ("form", "f"), ("primaryDocument", "p"), ("items", "i")]


def _blocks(o: DataFrame) -> DataFrame:
    """A block of parallel arrays for each customer, in order of the order's key; one document less for every fourth customer."""
    fields = F.struct(
        "o_orderkey",
        F.expr("IF(o_orderkey % 11 = 0, 'unknown', IF(o_orderkey % 2 = 0, replace(accn, '-', ''), accn))").alias("a"),
        F.expr("IF(o_orderkey % 13 = 0, '19980101', day)").alias("d"),
        F.expr("IF(o_orderstatus = 'P', '10-K/A', IF(o_orderstatus = 'O', '8-K', 'NPORT-P'))").alias("f"),
        F.expr("concat('d', o_orderkey, '.htm')").alias("p"),
        F.expr("IF(o_orderstatus = 'O', '2.02, 9.01,', '')").alias("i"),
    )
    per = o.groupBy("o_custkey", "c_name").agg(F.sort_array(F.collect_list(fields)).alias("r"))
    column = lambda c: F.transform("r", lambda x: x[c])
    short = F.when(F.col("o_custkey") % 4 == 0, F.slice(column("p"), F.lit(1), F.size("r") - 1)).otherwise(column("p"))
    return per.select("o_custkey", "c_name", F.struct(*[(short if c == "p" else column(c)).alias(n) for n, c in _BLOCK]).alias("block"))


def _recent(o: DataFrame) -> DataFrame:
    b = _blocks(o)
    return b.select(F.to_json(F.struct(F.lpad(F.col("o_custkey").cast("string"), 10, "0").alias("cik"), F.col("c_name").alias("name"), F.struct(F.col("block").alias("recent")).alias("filings"))).alias("content"))


_SUBMITTED = f"""SELECT o_custkey AS cik, {{name}} AS entity_name, {_ACCESSION.format(s='VARCHAR')} AS accession_number, CASE o_orderstatus WHEN 'P' THEN '10-K/A' WHEN 'O' THEN '8-K' ELSE 'NPORT-P' END AS form,
'd' || o_orderkey || '.htm' AS primary_document, CASE WHEN o_orderkey % 13 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS filing_date, CASE WHEN o_orderstatus = 'O' THEN '2.02|9.01' ELSE '' END AS items
FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey{{part}} ORDER BY o_orderkey DESC) AS last FROM orders JOIN customer ON o_custkey = c_custkey)
WHERE o_orderkey % 11 <> 0 AND NOT (o_custkey % 4 = 0 AND last = 1)"""


@query(_SUBMITTED.format(name="c_name", part=""))
def source_submissions(spark: SparkSession, d: str) -> DataFrame:
    rows = filings.submissions(_broken(_recent(_orders(spark, d)), '{"cik":"7"}', "[", '{"cik":"8","filings":{"recent":{"accessionNumber":[]}}}'))
    return rows.withColumn("items", F.array_join("items", "|"))


_OLD = "(o_orderdate < TIMESTAMP '1996-01-01')"


@query(f"""WITH s AS ({_SUBMITTED.format(name="c_name", part=f", {_OLD}").replace("SELECT o_custkey AS cik", f"SELECT {_OLD} AS old, o_custkey AS cik")})
SELECT cik, CASE WHEN old THEN n.name ELSE entity_name END AS entity_name, accession_number, form, primary_document, filing_date, items
FROM s LEFT JOIN (SELECT cik AS c, max(entity_name) AS name FROM s WHERE NOT old GROUP BY 1) n ON cik = c""")
def source_submission_pages(spark: SparkSession, d: str) -> DataFrame:
    """Filings before 1996 come from older pages, the others from the recent block."""
    o = _orders(spark, d)
    recent = filings.submissions(_recent(o.filter("o_orderdate >= TIMESTAMP_NTZ '1996-01-01 00:00:00'")))
    pages = _blocks(o.filter("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'")).select(F.col("o_custkey").alias("cik"), F.to_json("block").alias("content"))
    return filings.all_submissions(recent, filings.submission_pages(pages)).withColumn("items", F.array_join("items", "|"))


_SYMBOL = "concat(IF(c_custkey % 3 = 0, 'c.', 'C/'), c_custkey, 'a ')"


def _tickers_content(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer").withColumn("t", F.expr("struct(IF(c_custkey % 10 = 0, NULL, c_custkey) AS cik_str, IF(c_custkey % 17 = 0, ' ', " + _SYMBOL + ") AS ticker, IF(c_custkey % 4 = 0, NULL, c_name) AS title)"))
    return _broken(c.groupBy("c_nationkey").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("c_custkey").cast("string").alias("key"), F.col("t").alias("value"))))).alias("content")), "oops")


def _ticker_lines(spark: SparkSession, d: str) -> DataFrame:
    """A line for each customer: the symbol of the other list, one of its own, or a malformed one."""
    c = table(spark, d, "customer").withColumn("line", F.expr("CASE c_custkey % 6 WHEN 0 THEN concat('c-', c_custkey, 'a\\t', c_custkey) WHEN 1 THEN concat('w', c_custkey, '\\t', c_custkey) WHEN 2 THEN 'no tab' WHEN 3 THEN concat('x', c_custkey, '\\tnone') WHEN 4 THEN concat('\\t', c_custkey) ELSE '' END"))
    lines = c.groupBy("c_nationkey").agg(F.sort_array(F.collect_list("line")).alias("l"))
    return lines.select(F.when(F.col("c_nationkey") % 2 == 0, F.array_join("l", "\n")).otherwise(F.array_join("l", "\r\n")).alias("content"))


_PRIMARY = "SELECT c_custkey AS cik, 'C-' || c_custkey || 'A' AS symbol, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END AS company_name, 'PrimaryListing' AS origin FROM customer WHERE c_custkey % 10 <> 0 AND c_custkey % 17 <> 0"
_DERIVED = "SELECT c_custkey AS cik, CASE c_custkey % 6 WHEN 0 THEN 'C-' || c_custkey || 'A' ELSE 'W' || c_custkey END AS symbol, '' AS company_name, 'DerivedInstrument' AS origin FROM customer WHERE c_custkey % 6 < 2"


@query(_PRIMARY)
def source_tickers_json(spark: SparkSession, d: str) -> DataFrame:
    return filings.tickers_json(_tickers_content(spark, d))


@query(_DERIVED)
def source_tickers_text(spark: SparkSession, d: str) -> DataFrame:
    return filings.tickers_text(_ticker_lines(spark, d)).drop("place")


@query(f"""WITH p AS ({_PRIMARY}), m AS (SELECT * FROM p UNION ALL SELECT * FROM ({_DERIVED}) WHERE symbol NOT IN (SELECT symbol FROM p))
SELECT m.symbol, m.cik, coalesce(nullif(m.company_name, ''), n.name) AS company_name, m.origin FROM m LEFT JOIN (SELECT cik, arg_max(company_name, symbol) AS name FROM p WHERE company_name <> '' GROUP BY 1) n ON m.cik = n.cik""")
def source_registry(spark: SparkSession, d: str) -> DataFrame:
    """Both lists as one registry: primary listings win, names are filled in by cik."""
    return reports.registry(filings.tickers_json(_tickers_content(spark, d)), filings.tickers_text(_ticker_lines(spark, d)))


@query("""SELECT c_custkey AS cik, nullif(trim(c_name), '') AS name, CASE WHEN c_custkey % 2 = 0 THEN 'operating' END AS entity_type, CASE WHEN c_custkey % 7 <> 0 THEN CAST(1000 + c_nationkey AS INT) END AS sic,
CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE '06 ' || c_mktsegment END AS owner_org, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS sector, CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'A|B' END AS tickers,
CASE WHEN c_custkey % 3 = 0 THEN '' ELSE 'NYSE|Nasdaq' END AS exchanges, CASE WHEN c_custkey % 6 = 0 THEN '1301' ELSE '0930' END AS fiscal_year_end, CASE WHEN c_custkey % 6 = 0 THEN NULL ELSE DATE '2000-09-30' END AS fiscal_year_end_date,
CASE WHEN c_custkey % 4 = 0 THEN 'DE' ELSE 'Delaware' END AS state FROM customer WHERE c_custkey % 9 <> 0""")
def source_profiles(spark: SparkSession, d: str) -> DataFrame:
    fields = """struct(IF(c_custkey % 9 = 0, 'none', lpad(c_custkey, 10, '0')) AS cik, concat(' ', c_name, ' ') AS name, IF(c_custkey % 2 = 0, 'operating', ' ') AS entityType, IF(c_custkey % 7 = 0, 'x', CAST(1000 + c_nationkey AS STRING)) AS sic,
    IF(c_custkey % 5 = 0, '', concat('06 ', c_mktsegment)) AS ownerOrg, IF(c_custkey % 3 = 0, NULL, array('A', 'B')) AS tickers, IF(c_custkey % 3 = 0, array(''), array('NYSE', 'Nasdaq', 'NYSE', NULL)) AS exchanges,
    IF(c_custkey % 6 = 0, '1301', '0930') AS fiscalYearEnd, 'DE' AS stateOfIncorporation, IF(c_custkey % 4 = 0, '', 'Delaware') AS stateOfIncorporationDescription)"""
    rows = filings.company_profiles(_broken(table(spark, d, "customer").select(F.to_json(F.expr(fields)).alias("content")), "{"))
    plain = rows.select("cik", "name", "entity_type", "sic", "owner_org", "sector", F.array_join("tickers", "|").alias("tickers"), F.array_join("exchanges", "|").alias("exchanges"), "fiscal_year_end", "fiscal_year_end_date", "state")
    return plain


@query("""WITH h AS (SELECT DISTINCT l_orderkey AS h, l_suppkey + 1 AS c FROM lineitem), p AS (SELECT h, min(c) AS p FROM h GROUP BY 1)
SELECT DISTINCT p AS "primary", c AS related FROM h JOIN p USING (h) WHERE c <> p AND c % 7 <> 0""")
def source_search_hits(spark: SparkSession, d: str) -> DataFrame:
    """An order is a hit that names its suppliers, some of them badly; the smallest is the one searched for."""
    rows = table(spark, d, "lineitem").withColumn("c", F.col("l_suppkey") + 1)
    hits = rows.groupBy("l_orderkey").agg(F.min("c").alias("primary"), F.collect_set(F.expr("IF(c % 7 = 0, concat('n', c), lpad(c, 10, '0'))")).alias("c"))
    own = F.expr("array_union(c, array(lpad(primary, 10, '0')))")
    answer = F.to_json(F.struct(F.struct(F.array(F.struct(F.struct(own.alias("ciks")).alias("_source"))).alias("hits")).alias("hits")))
    found = filings.search_hits(hits.select(answer.alias("content")))
    return entities.related_in_hits(found, F.regexp_replace(F.array_min("ciks"), "^0+", ""))


# ---- delimited -------------------------------------------------------------------------------------------------------


@query(f"""SELECT CAST(o_custkey AS VARCHAR) AS cik, c_name AS company_name, 'F ' || o_orderpriority AS form_type, CAST(o_orderdate AS DATE) AS date_filed, 'edgar/data/' || o_custkey || '/' || o_orderkey || '.txt' AS filename
FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 9 <> 0 AND o_orderkey % 10 <> 0""")
def source_master_index(spark: SparkSession, d: str) -> DataFrame:
    """An index for each quarter, with its header; every ninth line lacks a part, every tenth a proper date."""
    line = F.expr("""CASE WHEN o_orderkey % 9 = 0 THEN concat(o_custkey, '|', c_name, '|F') WHEN o_orderkey % 10 = 0 THEN concat_ws('|', o_custkey, c_name, 'F', 'soon', 'x.txt')
    ELSE concat_ws('|', o_custkey, concat(c_name, ' '), concat('F ', o_orderpriority), day, concat('edgar/data/', o_custkey, '/', o_orderkey, '.txt')) END""")
    lines = _orders(spark, d).groupBy(F.date_trunc("quarter", "o_orderdate").alias("q")).agg(F.array_join(F.collect_list(line), "\n").alias("rows"))
    head = "Description: Master Index\n\nCIK|Company Name|Form Type|Date Filed|Filename\n" + "-" * 80 + "\n"
    return filings.master_index(_broken(lines.select(F.concat(F.lit(head), "rows", F.lit("\n")).alias("content")), "no dashes|a|b|2001-01-01|c"))


@query("""SELECT '811-' || s_suppkey AS reporting_file_number, CAST(s_suppkey AS VARCHAR) AS cik_number, s_name || ', "The" Fund' AS entity_name, CAST(NULL AS VARCHAR) AS entity_org_type, 'S' || s_suppkey AS series_id,
s_name || ' Series' AS series_name, 'C' || s_suppkey AS class_id, 'Class A' AS class_name, CASE WHEN s_suppkey % 2 = 0 THEN 'T' || s_suppkey || 'X' END AS class_ticker, CAST(NULL AS VARCHAR) AS address_1, CAST(NULL AS VARCHAR) AS address_2,
CAST(NULL AS VARCHAR) AS city, CAST(NULL AS VARCHAR) AS state, lpad(CAST(s_nationkey AS VARCHAR), 5, '0') AS zip_code FROM supplier""")
def source_fund_series(spark: SparkSession, d: str) -> DataFrame:
    """A list that lacks columns, written as CSV and read again."""
    rows = table(spark, d, "supplier").selectExpr("concat('811-', s_suppkey) AS `Reporting File Number`", "CAST(s_suppkey AS STRING) AS `CIK Number`", "concat(s_name, ', \"The\" Fund') AS `Entity Name`", "concat('S', s_suppkey) AS `Series ID`", "concat(s_name, ' Series') AS `Series Name`", "concat('C', s_suppkey) AS `Class ID`", "'Class A' AS `Class Name`", "IF(s_suppkey % 2 = 0, concat('T', s_suppkey, 'X'), NULL) AS `Class Ticker`", "lpad(s_nationkey, 5, '0') AS `Zip Code`")
    path = f"{shared_folder(spark)}/quarry/funds-{uuid.uuid4().hex}"
    rows.write.option("header", True).option("escape", '"').csv(path)
    return filings.fund_series(spark, path)


# ---- XML -------------------------------------------------------------------------------------------------------------


def _tag(name: str, value: str) -> str:
    return f"'<{name}>', {value}, '</{name}>'"


#: Rows of a task that writes artifacts and parses them: some seconds of work.
ARTIFACT_ROWS = 100_000


def xml(rows: DataFrame, key: str, row: str, before: str, behind: str) -> DataFrame:
    """An artifact for each key. Rows are dealt out by the key first, so they are shuffled instead of their elements' texts, which are
    far longer, and tasks are as many as the parsing needs."""
    return spread(rows, key, most=ARTIFACT_ROWS).groupBy(key).agg(F.concat(F.lit(before), F.array_join(F.collect_list(F.expr(row)), ""), F.lit(behind)).alias("content"))


INFORMATION_TABLE = '<?xml version="1.0"?><informationTable xmlns="http://www.sec.gov/edgar/document/thirteenf/informationtable">', "</informationTable>"
NPORT = '<?xml version="1.0"?><edgarSubmission xmlns="http://www.sec.gov/edgar/nport"><formData><invstOrSecs>', "</invstOrSecs></formData></edgarSubmission>"
POSITION = "concat('<infoTable>', " + ", ".join([_tag("nameOfIssuer", "concat(' Part ', l_partkey, ' &amp; Co')"), _tag("titleOfClass", "'COM'"), _tag("cusip", "lpad(l_partkey, 9, '0')"), _tag("value", "CAST(floor(l_extendedprice) AS BIGINT)"), "'<shrsOrPrnAmt>'", _tag("sshPrnamt", "IF(l_linenumber = 2, 'many', CAST(CAST(l_quantity AS INT) AS STRING))"), _tag("sshPrnamtType", "'SH'"), "'</shrsOrPrnAmt>'", "IF(l_linenumber = 1, '<putCall>Put</putCall>', '')", _tag("investmentDiscretion", "'SOLE'")]) + ", '</infoTable>')"


def _tables_13f(spark: SparkSession, d: str) -> DataFrame:
    """A filing for each supplier; a third of them from before values were in dollars, a third without a date."""
    docs = xml(table(spark, d, "lineitem"), "l_suppkey", POSITION, *INFORMATION_TABLE)
    return docs.selectExpr("l_suppkey AS filing", "CASE l_suppkey % 3 WHEN 0 THEN DATE '2022-12-31' WHEN 1 THEN DATE '2023-01-01' END AS filing_date", "content")


@query("""WITH r AS (SELECT l_suppkey AS filing, 'Part ' || l_partkey || ' & Co' AS name, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, floor(l_extendedprice) * CASE WHEN l_suppkey % 3 = 0 THEN 1000 ELSE 1 END AS value_usd,
CASE WHEN l_linenumber = 2 THEN 0 ELSE l_quantity END AS shares, CASE WHEN l_linenumber = 1 THEN 'Put' END AS put_call FROM lineitem)
SELECT *, round_even(value_usd / sum(value_usd) OVER (PARTITION BY filing) * 100, 4) AS weight_pct FROM r""")
def source_holdings_13f(spark: SparkSession, d: str) -> DataFrame:
    rows = filings.holdings_13f(_tables_13f(spark, d))
    return rows.select("filing", "name", "cusip", F.col("value_usd").cast("double").alias("value_usd"), F.col("shares").cast("double").alias("shares"), "put_call", "weight_pct")


@query(SQL["source_holdings_13f"])
def source_holdings_13f_files(spark: SparkSession, d: str) -> DataFrame:
    """The same filings as files, read by row tag. Texts are packed, since they are some twenty times as long as the rows they come from."""
    docs = xml(table(spark, d, "lineitem"), "l_suppkey", POSITION, *INFORMATION_TABLE)
    path = f"{shared_folder(spark)}/quarry/13f-{uuid.uuid4().hex}"
    docs.withColumnRenamed("l_suppkey", "filing").write.options(**BY_TASKS, compression="gzip").partitionBy("filing").text(path)
    filed = table(spark, d, "supplier").selectExpr("s_suppkey AS filing", "CASE s_suppkey % 3 WHEN 0 THEN DATE '2022-12-31' WHEN 1 THEN DATE '2023-01-01' END AS filing_date")
    rows = filings.holdings_13f_files(spark, path, filed)
    return rows.select("filing", "name", "cusip", F.col("value_usd").cast("double").alias("value_usd"), F.col("shares").cast("double").alias("shares"), "put_call", "weight_pct")


@query("""WITH h AS (SELECT 'customer' AS name, unnest(['c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment', 'extra']) AS "column" UNION ALL SELECT 'part', unnest(['p_partkey', 'p_name', 'extra']) UNION ALL SELECT 'orders', unnest(['o_orderkey', 'o_custkey', 'o_totalprice']))
SELECT "column", CAST(sum(n) AS BIGINT) AS n FROM h JOIN (SELECT 'customer' AS name, count(DISTINCT c_nationkey) AS n FROM customer UNION ALL SELECT 'part', count(DISTINCT p_size) FROM part UNION ALL SELECT 'orders', count(DISTINCT o_orderpriority) FROM orders) USING (name) GROUP BY 1""")
def source_csv_headers(spark: SparkSession, d: str) -> DataFrame:
    """Files of customers by nation, parts by size and orders by priority; how many have each column."""
    path = f"{shared_folder(spark)}/quarry/headers-{uuid.uuid4().hex}"
    c, p, o = (table(spark, d, t) for t in ("customer", "part", "orders"))
    kinds = [
        ("customer", c.select("c_custkey", "c_name", F.col("c_nationkey").alias("k"), "c_nationkey", "c_mktsegment", F.lit("x").alias("extra")), "k"),
        ("part", p.select("p_partkey", "p_name", F.lit(1).alias("extra"), "p_size"), "p_size"),
        ("orders", o.select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority"), "o_orderpriority"),
    ]
    for name, rows, key in kinds:
        rows.repartition(key).write.option("header", True).partitionBy(key).csv(f"{path}/{name}")
    return coverage.header_stats(filings.csv_headers(spark, path))


INVESTMENT = "concat('<invstOrSec>', " + ", ".join([_tag("name", "concat('Issuer ', l_partkey)"), _tag("title", "IF(l_linenumber = 3, '', concat('Title ', l_linenumber))"), _tag("cusip", "lpad(l_partkey, 9, '0')"), "IF(l_linenumber = 4, '', concat('<identifiers><isin value=\"US', l_partkey, '\"/></identifiers>'))", _tag("balance", "concat(CAST(l_quantity AS INT), '.125')"), _tag("units", "'NS'"), _tag("curCd", "'USD'"), _tag("valUSD", "IF(l_linenumber = 5, 'N/A', concat(CAST(l_quantity AS INT), '.375'))"), _tag("pctVal", "concat('0.', lpad(l_partkey, 6, '0'))"), _tag("assetCat", "'EC'"), _tag("invCountry", "'US'")]) + ", '</invstOrSec>')"


@query("""SELECT l_suppkey AS filing, 'Issuer ' || l_partkey AS name, CASE WHEN l_linenumber = 3 THEN '' ELSE 'Title ' || l_linenumber END AS title, lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS cusip, CASE WHEN l_linenumber = 4 THEN '' ELSE 'US' || l_partkey END AS isin,
round_even(l_quantity + 0.125, 2) AS balance, CASE WHEN l_linenumber = 5 THEN 0 ELSE round_even(l_quantity + 0.375, 2) END AS val_usd, CAST('0.' || lpad(CAST(l_partkey AS VARCHAR), 6, '0') AS DOUBLE) AS pct_val, '' AS lei, 'EC' AS asset_category FROM lineitem""")
def source_holdings_nport(spark: SparkSession, d: str) -> DataFrame:
    docs = xml(table(spark, d, "lineitem"), "l_suppkey", INVESTMENT, *NPORT)
    rows = filings.holdings_nport(docs.withColumnRenamed("l_suppkey", "filing"))
    return rows.select("filing", "name", "title", "cusip", "isin", *[F.col(c).cast("double").alias(c) for c in ("balance", "val_usd", "pct_val")], "lei", "asset_category")


def _value(name: str, value: str) -> str:
    return f"'<{name}><value>', {value}, '</value></{name}>'"


_TRADE = "concat('<', kind, 'Transaction>', " + ", ".join([_value("securityTitle", "' Common '"), _value("transactionDate", "IF(l_linenumber = 6, 'never', date_format(l_shipdate, 'yyyy-MM-dd'))"), "'<transactionCoding><transactionCode>'", "element_at(array('P', 'S', 'A', 'F', 'M', 'X', 'G', 'D', 'V', 'J', 'Z'), CAST(l_partkey % 11 + 1 AS INT))", "'</transactionCode></transactionCoding><transactionAmounts>'", _value("transactionShares", "CAST(l_quantity AS INT)"), _value("transactionPricePerShare", "IF(l_linenumber = 1, '0', CAST(CAST(l_extendedprice AS INT) AS STRING))"), _value("transactionAcquiredDisposedCode", "IF(l_returnflag = 'R', 'D', 'A')"), "'</transactionAmounts><postTransactionAmounts>'", _value("sharesOwnedFollowingTransaction", "l_partkey"), "'</postTransactionAmounts>'"]) + ", '</', kind, 'Transaction>')"


def _insider_reports(spark: SparkSession, d: str) -> DataFrame:
    """A report for each supplier, with two owners of whom the second counts."""
    rows = table(spark, d, "lineitem").withColumn("derivative", F.col("l_returnflag") == "N").withColumn("kind", F.expr("IF(derivative, 'derivative', 'nonDerivative')"))
    tables = spread(rows, "l_suppkey", most=ARTIFACT_ROWS).groupBy("l_suppkey").agg(*[F.array_join(F.collect_list(F.when(F.col("derivative") == x, F.expr(_TRADE))), "").alias(n) for n, x in (("n", False), ("dv", True))])
    owner = "concat('<reportingOwner><reportingOwnerId><rptOwnerCik>', {cik}, '</rptOwnerCik><rptOwnerName>', {name}, '</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>', {director}, '</isDirector><isTenPercentOwner>', {ten}, '</isTenPercentOwner><officerTitle>', {title}, '</officerTitle></reportingOwnerRelationship></reportingOwner>')"
    one = F.expr(owner.format(cik="'1'", name="'First'", director="'1'", ten="'1'", title="'President'"))
    two = F.expr(owner.format(cik="lpad(l_suppkey, 10, '0')", name="concat('Owner ', l_suppkey)", director="IF(l_suppkey % 4 = 0, 'true', IF(l_suppkey % 4 = 1, '1', '0'))", ten="IF(l_suppkey % 4 = 2, 'TRUE', 'false')", title="IF(l_suppkey % 4 = 0, ' Chief ', ' ')"))
    return tables.select(F.col("l_suppkey").alias("filing"), F.concat(F.lit("<ownershipDocument>"), one, two, F.lit("<nonDerivativeTable>"), "n", F.lit("</nonDerivativeTable><derivativeTable>"), "dv", F.lit("</derivativeTable></ownershipDocument>")).alias("content"))


@query("""SELECT l_suppkey AS filing, 'Owner ' || l_suppkey AS owner_name, lpad(CAST(l_suppkey AS VARCHAR), 10, '0') AS owner_cik, CASE l_suppkey % 4 WHEN 0 THEN 'Chief' END AS officer_title, l_suppkey % 4 IN (0, 1) AS is_director, l_suppkey % 4 = 2 AS is_ten_percent_owner,
CASE l_suppkey % 4 WHEN 0 THEN 'Chief' WHEN 1 THEN 'Director' WHEN 2 THEN '10% Owner' ELSE 'Insider' END AS role, l_returnflag = 'N' AS is_derivative, 'Common' AS security_title, CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(l_shipdate AS DATE) END AS transaction_date,
['P', 'S', 'A', 'F', 'M', 'X', 'G', 'D', 'V', 'J', 'Z'][l_partkey % 11 + 1] AS transaction_code,
['Purchase', 'Sale', 'Award/Grant', 'Tax withholding', 'Option exercise', 'In-the-money exercise', 'Gift', 'Disposition to issuer', 'Voluntary report', 'Other', 'Transaction'][l_partkey % 11 + 1] AS transaction,
l_quantity AS shares, CASE WHEN l_linenumber = 1 THEN NULL ELSE CAST(trunc(l_extendedprice) AS DOUBLE) END AS price, CASE WHEN l_returnflag = 'R' THEN 'D' ELSE 'A' END AS acquired_disposed, CAST(l_partkey AS DOUBLE) AS shares_after FROM lineitem""")
def source_insider_transactions(spark: SparkSession, d: str) -> DataFrame:
    out = filings.insider_transactions(_insider_reports(spark, d))
    return out.select("filing", "owner_name", "owner_cik", "officer_title", "is_director", "is_ten_percent_owner", "role", "is_derivative", "security_title", "transaction_date", "transaction_code", "transaction", *[F.col(c).cast("double").alias(c) for c in ("shares", "price", "shares_after")], "acquired_disposed")


def _by_function(spark: SparkSession, docs: DataFrame, function: str) -> DataFrame:
    """The rows that a table function gives for docs, by SQL; a filing is a partition."""
    table_functions.register(spark)
    docs.createOrReplaceTempView(view := f"docs_{uuid.uuid4().hex}")
    return spark.sql(f"SELECT * FROM {function}(TABLE({view}) PARTITION BY filing)")


@query(SQL["source_holdings_13f"])
def table_function_13f(spark: SparkSession, d: str) -> DataFrame:
    rows = _by_function(spark, _tables_13f(spark, d), "positions_13f")
    return rows.select("filing", "name", "cusip", F.col("value_usd").cast("double").alias("value_usd"), F.col("shares").cast("double").alias("shares"), "put_call", "weight_pct")


@query(SQL["source_insider_transactions"])
def table_function_insiders(spark: SparkSession, d: str) -> DataFrame:
    out = _by_function(spark, _insider_reports(spark, d), "insider_transactions")
    plain = [c for c in out.columns if c not in ("place", "is_officer", "shares", "price", "shares_after")]
    return out.select(*plain, *[F.col(c).cast("double").alias(c) for c in ("shares", "price", "shares_after")])


ENTRY = "concat('<entry>', " + ", ".join([_tag("title", "concat('8-K - Filer ', user_id, ' Corp (', lpad(user_id, 10, '0'), ') (Filer)')"), "'<link rel=\"alternate\" href=\"', IF(event_id % 10 = 0, 'https://www.sec.gov/none', concat('https://www.sec.gov/Archives/edgar/data/', user_id, '/x-index.htm')), '\"/>'", "'<summary type=\"html\">&lt;b&gt;Filed:&lt;/b&gt; ', date_format(ts, 'yyyy-MM-dd'), IF(event_type = 'view', ' &lt;br&gt;Item 2.02: Results &lt;br&gt;Item 9.01: Exhibits', ''), '</summary>'", _tag("updated", "IF(event_id % 13 = 0, 'soon', concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '-05:00'))"), "'<category term=\"', IF(event_type = 'error', '10-Q', '8-K'), '\"/>'", _tag("id", "concat('urn:tag:sec.gov,2008:accession-number=', IF(event_id % 11 = 0, 'none', concat('0000000001-24-', lpad(event_id, 6, '0'))))")]) + ", '</entry>')"

ATOM = '<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom">', "</feed>"


@query("""SELECT '0000000001-24-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS accession_number, CASE WHEN event_id % 10 = 0 THEN NULL ELSE user_id END AS cik, 'Filer ' || user_id || ' Corp' AS company_name, CASE WHEN event_type = 'error' THEN '10-Q' ELSE '8-K' END AS form_type,
CAST(ts AS DATE) AS filing_date, CASE WHEN event_id % 10 = 0 THEN 'https://www.sec.gov/none' ELSE 'https://www.sec.gov/Archives/edgar/data/' || user_id || '/x-index.htm' END AS filing_href, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-05:00' AS updated_text,
CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 18000 AS updated, CASE WHEN event_type = 'view' THEN '2.02|9.01' ELSE '' END AS items FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0""")
def source_feed_entries(spark: SparkSession, d: str) -> DataFrame:
    """Feeds of an hour each; some entries lack an accession number, a registrant or a time."""
    e = table(spark, d, "events").withColumn("hour", F.date_trunc("hour", "ts"))
    docs = xml(e, "hour", ENTRY, *ATOM)
    rows = filings.feed_entries(docs.select("content"))
    return rows.withColumn("updated", F.unix_timestamp("updated")).withColumn("items", F.array_join("items", "|"))


# ---- HTML ------------------------------------------------------------------------------------------------------------

INDEX_ROW = "concat('<tr class=\"r\"><td>', l_linenumber, '</td><td>text</td><td><a href=\"', IF(l_linenumber = 2, '/ix?doc=', ''), '/Archives/edgar/data/1/', l_orderkey, '/d', l_partkey, '.htm\">d</a></td>', IF(l_linenumber = 7, '', concat('<td> EX-99.', l_linenumber, '&nbsp;</td>')), '<td>12</td></tr>')"


@query("SELECT l_orderkey AS filing, 'd' || l_partkey || '.htm' AS name, CASE WHEN l_linenumber = 7 THEN '12' ELSE 'EX-99.' || l_linenumber END AS type FROM lineitem")
def source_filing_index(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "filing").withColumn("l_orderkey", F.col("filing"))
    docs = xml(rows, "filing", INDEX_ROW, "<html><TABLE><tr><th>Seq</th><th>Description</th><th>Document</th><th>Type</th></tr><tr><td>1</td><td>short</td></tr>", "</TABLE></html>")
    return filings.filing_index(docs, keep=["filing"]).drop("place")


@query("SELECT CAST(100 + p_size AS INT) AS code, p_type AS office, p_name || ' & sons' AS description FROM part WHERE p_partkey % 5 <> 0 AND p_partkey % 7 <> 0")
def source_sic_codes(spark: SparkSession, d: str) -> DataFrame:
    row = "concat('<tr><td>', IF(p_partkey % 5 = 0, 'Code', CAST(100 + p_size AS STRING)), '</td><td> Office of ', p_type, '</td><td>', p_name, ' &amp;  sons</td>', IF(p_partkey % 7 = 0, '<td>more</td>', ''), '</tr>')"
    return filings.sic_codes(xml(table(spark, d, "part"), "p_size", row, "<table>", "</table>").select("content"))


# ---- addresses -------------------------------------------------------------------------------------------------------

_FLAT = _ACCESSION.format(s="VARCHAR")
_AT = "'https://www.sec.gov/Archives/edgar/data/' || o_custkey || '/'"
_CIK10 = "lpad(CAST(o_custkey AS VARCHAR), 10, '0')"


@query(f"""SELECT o_orderkey, {_AT} || replace({_FLAT}, '-', '') || '/' || {_FLAT} || '-index.htm' AS index_page, {_AT} || replace({_FLAT}, '-', '') || '/primary_doc.xml' AS primary_xml, {_AT} || {_FLAT} || '.txt' AS submission_text,
'https://www.sec.gov/Archives/edgar/x.txt' AS archive, 'https://data.sec.gov/submissions/CIK' || {_CIK10} || '.json' AS submissions, 'https://data.sec.gov/submissions/CIK' || o_custkey || '-1.json' AS submissions_page,
'https://data.sec.gov/api/xbrl/companyfacts/CIK' || {_CIK10} || '.json' AS company_facts, 'https://www.sec.gov/Archives/edgar/full-index/' || year(o_orderdate) || '/QTR' || quarter(o_orderdate) || '/master.idx' AS full_index,
'https://www.sec.gov/files/investment/data/other/investment-company-series-and-class-information/investment-company-series-class-' || year(o_orderdate) || '.csv' AS fund_series,
'https://www.sec.gov/cgi-bin/browse-edgar?action=getcurrent&type=8-K&dateb=&owner=include&count=40&search_text=&output=atom' AS current_feed,
'https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=' || {_CIK10} || '&type=8-K&dateb=&owner=include&count=40&search_text=&output=atom' AS company_feed,
'https://efts.sec.gov/LATEST/search-index?q=%22' || o_orderpriority || ' 5%25 %22x%22%22&forms=10-K&_source=ciks,display_names&from=0&size=100' AS related_search FROM orders""")
def addresses(spark: SparkSession, d: str) -> DataFrame:
    """The addresses of every artifact of an order's customer and filing."""
    o = table(spark, d, "orders").withColumn("accn", F.expr(_ACCESSION.format(s="STRING")))
    cik, accn, year, form, none, page = F.col("o_custkey"), F.col("accn"), F.year("o_orderdate"), F.lit("8-K"), F.lit(""), F.lit(40)
    made = {
        "index_page": urls.index_page(cik, accn),
        "primary_xml": urls.primary_xml(cik, accn),
        "submission_text": urls.submission_text(cik, accn),
        "archive": urls.archive(F.lit("edgar/x.txt")),
        "submissions": urls.submissions(cik),
        "submissions_page": urls.submissions_page(F.concat(F.lit("CIK"), cik.cast("string"), F.lit("-1.json"))),
        "company_facts": urls.company_facts(cik),
        "full_index": urls.full_index(year, F.quarter("o_orderdate")),
        "fund_series": urls.fund_series(year),
        "current_feed": urls.current_feed(form, none, page),
        "company_feed": urls.company_feed(cik, form, none, page),
        "related_search": urls.related_search(F.concat("o_orderpriority", F.lit(' 5% "x"'))),
    }
    return o.select("o_orderkey", *[c.alias(n) for n, c in made.items()])
