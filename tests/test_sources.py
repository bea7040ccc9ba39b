import datetime
import json

from pyspark.sql import functions as F

from quarry.plans import source_queries
from quarry.sources import filings, sinks
from quarry.streaming import feed


def docs(spark, *contents, **more):
    rows = [(c, *more.values()) for c in contents]
    return spark.createDataFrame(rows, ", ".join(["content string", *[f"{k} {'date' if k == 'filing_date' else 'string'}" for k in more]]))


def test_company_facts(spark):
    o = {"end": "2023-12-31", "val": 5, "accn": "a", "fy": 2023, "fp": "FY", "form": "10-K", "filed": "2024-01-01"}
    doc = json.dumps({"cik": 7, "entityName": "E", "facts": {"us-gaap": {"Rev": {"label": "r", "units": {"USD": [o, {"end": "2022-12-31"}]}}}}})
    rows = filings.company_facts(docs(spark, doc, "{", "")).orderBy("end").collect()
    assert [(r.cik, r.fact_name, r.unit, r.end, r.value, r.fp) for r in rows] == [(7, "Rev", "USD", "2022-12-31", 0.0, ""), (7, "Rev", "USD", "2023-12-31", 5.0, "FY")]


def test_submissions(spark):
    block = {"accessionNumber": ["0000000001-24-000001", "bad", "0000000001-24-000003"], "filingDate": ["2024-01-02", "2024-01-03"], "form": ["8-K", "8-K", "10-K"], "primaryDocument": ["a.htm", "b.htm", "c.htm"], "items": ["2.02, 9.01"]}
    doc = json.dumps({"cik": "1", "name": "E", "filings": {"recent": block, "files": []}})
    rows = filings.submissions(docs(spark, doc, json.dumps({"cik": "2", "name": "F", "filings": {}}))).collect()
    assert [(r.cik, r.accession_number, r.form, r.filing_date, r["items"]) for r in rows] == [(1, "0000000001-24-000001", "8-K", datetime.date(2024, 1, 2), ["2.02", "9.01"])]
    pages = filings.submission_pages(docs(spark, json.dumps(block | {"items": []}), cik="1").withColumn("cik", F.col("cik").cast("long")))
    both = filings.all_submissions(filings.submissions(docs(spark, doc)), pages).collect()
    assert len(both) == 2 and {r.entity_name for r in both} == {"E"}


def test_tickers(spark):
    js = json.dumps({"0": {"cik_str": 1, "ticker": "brk.b", "title": "B"}})
    assert [tuple(r) for r in filings.tickers_json(docs(spark, js)).collect()] == [(1, "BRK-B", "B", "PrimaryListing")]
    assert [(r.cik, r.symbol) for r in filings.tickers_text(docs(spark, "aa\t1\nbad\n\tx\nbb\ty\ncc\t3\n")).collect()] == [(1, "AA"), (3, "CC")]


def test_master_index(spark):
    doc = "Header\n\nCIK|Company Name|Form Type|Date Filed|Filename\n-----\n1|A|10-K|2024-01-02|edgar/a.txt\n2|B|10-K|bad|x\n3|C|10-K\n4|D|8-K|2024-01-03|edgar/d|e.txt"
    rows = filings.master_index(docs(spark, doc, "no dashes\n1|A|10-K|2024-01-02|x")).collect()
    assert [(r.cik, r.filename) for r in rows] == [("1", "edgar/a.txt"), ("4", "edgar/d|e.txt")]


def test_13f(spark):
    table = lambda v: f"<x:informationTable xmlns:x='u'><x:infoTable><x:nameOfIssuer>A</x:nameOfIssuer><x:cusip>1</x:cusip><x:value>{v}</x:value><x:shrsOrPrnAmt><x:sshPrnamt>3</x:sshPrnamt><x:sshPrnamtType>SH</x:sshPrnamtType></x:shrsOrPrnAmt></x:infoTable><x:infoTable><x:nameOfIssuer>B</x:nameOfIssuer><x:cusip>2</x:cusip><x:value>1</x:value><x:putCall>Put</x:putCall></x:infoTable></x:informationTable>"
    rows = filings.holdings_13f(docs(spark, table(2), filing_date=datetime.date(2020, 1, 1))).orderBy("place").collect()
    assert [(r.name, float(r.value_usd), float(r.shares), r.put_call, r.weight_pct) for r in rows] == [("A", 2000.0, 3.0, None, 66.6667), ("B", 1000.0, 0.0, "Put", 33.3333)]
    assert filings.holdings_13f(docs(spark, "<broken", filing_date=datetime.date(2020, 1, 1))).count() == 0


def test_nport(spark):
    doc = "<edgarSubmission><formData><invstOrSecs><invstOrSec><name>N</name><cusip>9</cusip><identifiers><isin value='US1'/></identifiers><balance>1.005</balance><valUSD>2.345</valUSD><pctVal>0.5</pctVal></invstOrSec></invstOrSecs></formData></edgarSubmission>"
    r = filings.holdings_nport(docs(spark, doc, id="x")).first()
    assert (r.name, r.isin, float(r.balance), float(r.val_usd), float(r.pct_val), r.id) == ("N", "US1", 1.0, 2.34, 0.5, "x")


def test_form_4(spark):
    t = lambda code, price: f"<securityTitle><value>Common</value></securityTitle><transactionDate><value>2024-01-02</value></transactionDate><transactionCoding><transactionCode>{code}</transactionCode></transactionCoding><transactionAmounts><transactionShares><value>10</value></transactionShares><transactionPricePerShare><value>{price}</value></transactionPricePerShare></transactionAmounts>"
    doc = f"<ownershipDocument><reportingOwner><reportingOwnerId><rptOwnerName>O</rptOwnerName></reportingOwnerId><reportingOwnerRelationship><isDirector>1</isDirector></reportingOwnerRelationship></reportingOwner><nonDerivativeTable><nonDerivativeTransaction>{t('P', '1.5')}</nonDerivativeTransaction></nonDerivativeTable><derivativeTable><derivativeTransaction>{t('M', '0')}</derivativeTransaction></derivativeTable></ownershipDocument>"
    rows = filings.insider_transactions(docs(spark, doc)).orderBy("place").collect()
    assert [(r.owner_name, r.role, r.is_derivative, r.transaction, r.price and float(r.price)) for r in rows] == [("O", "Director", False, "Purchase", 1.5), ("O", "Director", True, "Option exercise", None)]


def test_feed(spark):
    entry = "<entry><title>8-K - Multi - Co, Inc. (0000000007) (Filer)</title><updated>2026-03-13T17:00:00-04:00</updated><id>urn:tag:x,2008:accession-number=0000000007-26-000001</id><link href='https://x/Archives/edgar/data/7/1/i.htm'/><summary type='html'>&lt;b&gt;Filed:&lt;/b&gt; 2026-03-13 Item 2.02: x Item 9.01: y</summary><category term='8-K'/></entry>"
    rows = filings.feed_entries(docs(spark, f"<feed xmlns='a'>{entry}{entry.replace('2026-03-13T17:00:00-04:00', 'bad')}</feed>")).collect()
    assert [(r.accession_number, r.cik, r.company_name, r.form_type, r.filing_date, r["items"]) for r in rows] == [("0000000007-26-000001", 7, "Multi - Co, Inc.", "8-K", datetime.date(2026, 3, 13), ["2.02", "9.01"])]


def test_html_sources(spark):
    page = "<table><tr><th>Seq</th></tr><tr><td>1</td><td>x</td><td><a href='/ix?doc=/Archives/a/b.htm'>b.htm</a></td><td>10-K&nbsp;</td><td>9</td></tr></table>"
    assert [(r.name, r.type) for r in filings.filing_index(docs(spark, page)).collect()] == [("b.htm", "10-K")]
    sic = "<table><tr><td>100</td><td>Office of Life</td><td>Crops &amp; more</td></tr><tr><td>x</td><td>y</td><td>z</td></tr></table>"
    assert [tuple(r) for r in filings.sic_codes(docs(spark, sic)).collect()] == [(100, "Life", "Crops & more")]


def test_html_tables_are_taken_apart_once(spark):
    row = lambda *cells: "<TR class='r'>" + "".join(f"<td>{c}</TD>" for c in cells) + "</tr>"
    page = row("1", "x < y </b", "<a\nHREF = 'a/b.htm'>b</a>", "10-K\n&amp;") + row("2", "", "<a href='x?doc=/d/c.htm&y'>", "8-K") + row("3", "", "<a href='d/'>", "none") + row("4", "", "<a href='e.htm'>") + "<tr><td>5</td>"
    found = filings.filing_index(docs(spark, page, "", None))
    assert sorted(tuple(r) for r in found.collect()) == [(0, "b.htm", "10-K &"), (1, "c.htm", "8-K")]
    sic = filings.sic_codes(docs(spark, "<table>" + row("100", "Office of Life", "Crops < more") + row("1", "y") + "</table>"))
    assert [tuple(r) for r in sic.collect()] == [(100, "Life", "Crops < more")]
    for rows in (found, sic):
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract_all(") == 2  # rows, and cells in them


def test_artifacts_are_made_in_many_tasks(spark, sf_dir):
    least = 2 * spark.sparkContext.defaultParallelism
    for made in (source_queries.xml(spark.range(100).withColumn("k", F.col("id") % 10), "k", "concat('<r>', id, '</r>')", "<t>", "</t>"), source_queries._insider_reports(spark, sf_dir)):
        plan = made._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and plan.index("Exchange") > plan.rindex("collect_list")  # rows are shuffled, not their texts
        assert made.rdd.getNumPartitions() >= least  # small tables too: parsing takes far longer than reading
    assert {r.content.count("<r>") for r in source_queries.xml(spark.range(100).withColumn("k", F.col("id") % 10), "k", "concat('<r>', id, '</r>')", "<t>", "</t>").collect()} == {10}


def test_profile_and_hits(spark):
    doc = json.dumps({"cik": "5", "name": "N", "ownerOrg": "06 Technology", "fiscalYearEnd": "0930", "stateOfIncorporation": "CA", "exchanges": ["X", "X", None], "ein": ""})
    r = filings.company_profiles(docs(spark, doc)).first()
    assert (r.cik, r.sector, r.fiscal_year_end_date, r.state, r.exchanges, r.ein) == (5, "Technology", datetime.date(2000, 9, 30), "CA", ["X"], None)
    hit = json.dumps({"hits": {"hits": [{"_source": {"ciks": ["1", "2"]}}]}})
    assert filings.search_hits(docs(spark, hit)).first()["ciks"] == ["1", "2"]


def test_files_and_sinks(spark, tmp_path):
    (tmp_path / "raw" / "AA").mkdir(parents=True)
    (tmp_path / "raw" / "AA" / "0001.htm").write_text("<p>x</p>\ny")
    (tmp_path / "raw" / "AA" / "0002.pdf").write_text("no")
    rows = filings.raw_reports(spark, str(tmp_path / "raw"))
    assert [tuple(r) for r in rows.collect()] == [("AA", "0001", "<p>x</p>\ny")]
    df = spark.createDataFrame([("AA", 1, ["x"]), ("BB", None, [])], "symbol string, n int, tags array<string>")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    sinks.write_by_letter(df, str(tmp_path / "by"), "symbol")
    assert spark.read.parquet(str(tmp_path / "by")).filter("letter = 'A'").count() == 1
    sinks.write_rolled(spark.range(10), str(tmp_path / "rolled"), 3)
    assert spark.read.parquet(str(tmp_path / "rolled")).count() == 10
    (tmp_path / "fund.csv").write_text("CIK Number,Entity Name\n1,E\n")
    r = filings.fund_series(spark, str(tmp_path / "fund.csv")).first()
    assert (r.cik_number, r.entity_name, r.class_ticker) == ("1", "E", None)
    years = spark.createDataFrame([(2024, 1), (2025, 2)], "year int, x int")
    assert [r.x for r in filings.latest_year(years).collect()] == [2]


def test_stream_is_exactly_once(spark, tmp_path):
    src, out, mark = str(tmp_path / "src"), str(tmp_path / "out"), str(tmp_path / "mark")
    rows = spark.createDataFrame([("a", datetime.datetime(2024, 1, 1)), ("a", datetime.datetime(2024, 1, 1)), ("b", datetime.datetime(2024, 1, 2))], "id string, updated timestamp")
    rows.write.parquet(src)
    for _ in range(2):  # the second run finds nothing new
        feed.run_available(feed.unique(feed.stream(spark, src, rows.schema), ["id"], "updated"), out, mark)
    rows.filter("id = 'b'").write.mode("append").parquet(src)
    feed.run_available(feed.unique(feed.stream(spark, src, rows.schema), ["id"], "updated"), out, mark)
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b"]
    assert feed.high_water(rows, at="updated").first()["high_water"] == datetime.datetime(2024, 1, 2)
    assert [r.id for r in feed.delta(rows, "updated", datetime.datetime(2024, 1, 1)).collect()] == ["b"]
    assert feed.high_water(rows.filter("false"), at="updated").first()["high_water"] is None
