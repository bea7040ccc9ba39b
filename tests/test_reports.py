import datetime
import http.server
import re
import threading

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from quarry.functions import forms
from quarry.operators import views
from quarry.plans import reports
from quarry.sources import live, settings

D = datetime.date


def submissions(spark, *rows):
    return spark.createDataFrame(rows, "cik long, accession_number string, form string, filing_date date, primary_document string")


def test_forms(spark):
    assert len(forms.NAMED) == len(set(forms.NAMED)) and set(forms.RETIRED) <= set(forms.NAMED)
    row = spark.range(1).select(forms.parsed(F.lit(" 10-k/a ")).alias("a"), forms.parsed(F.lit("x-1")).alias("b"), forms.is_retired(F.lit("s-2")).alias("c"), forms.is_named(F.lit("8-K")).alias("d")).first()
    assert tuple(row) == ("10-K/A", "x-1", True, True)


def test_registry_and_resolution(spark):
    primary = spark.createDataFrame([("AA", 1, "A Inc", "PrimaryListing")], "symbol string, cik long, company_name string, origin string")
    derived = spark.createDataFrame([("AA", 9, "", "DerivedInstrument", 0), ("AA-W", 1, "", "DerivedInstrument", 1)], "symbol string, cik long, company_name string, origin string, place int")
    rows = {tuple(r) for r in reports.registry(primary, derived).collect()}
    assert rows == {("AA", 1, "A Inc", "PrimaryListing"), ("AA-W", 1, "A Inc", "DerivedInstrument")}
    funds = spark.createDataFrame([("fund.x", "0000000007")], "class_ticker string, cik_number string")
    asked = spark.createDataFrame([("aa",), ("FUND/X",), ("none",)], "symbol string")
    assert {tuple(r) for r in reports.resolved(asked, primary, funds).collect()} == {("AA", 1), ("FUND-X", 7), ("NONE", None)}


def test_fundamentals_have_addresses(spark):
    o = spark.createDataFrame([(7, "Rev", 5.0, "USD", 2023, "FY", "2023-12-31", "2024-02-01", "10-K", "0000000007-24-000001"), (7, "Rev", 4.0, "USD", 2022, "FY", "2022-12-31", "2023-02-01", "10-K", "0000000007-23-000001")], "cik long, fact_name string, value double, unit string, fy long, fp string, `end` string, filed string, form string, accn string")
    s = submissions(spark, (7, "0000000007-24-000001", "10-K", D(2024, 2, 1), "r.htm"))
    got = {r.fy: r.filing_url for r in reports.fundamentals(o, s, ["Rev"]).collect()}
    assert got[2023].endswith("/000000000724000001/r.htm") and got[2022].endswith("/0000000007-23-000001-index.htm")


def test_histories(spark):
    s = submissions(spark, (1, "a", "10-K", D(2024, 1, 1), ""), (2, "a", "10-K", D(2024, 1, 1), ""), (2, "b", "10-K405", D(2020, 1, 1), ""), (3, "c", "NPORT-P", D(2024, 1, 1), ""), (3, "d", "4", None, ""), (1, "e", "8-K", D(2024, 3, 1), ""), (1, "f", "8-K", D(2024, 2, 1), ""))
    related = spark.createDataFrame([(1, 2)], "entity long, related long")
    assert [(r.entity, r.accession_number) for r in reports.entity_filings(s, related, "annual").collect()] == [(1, "a"), (1, "b")]
    assert {tuple(r) for r in reports.holdings_source(s).collect()} == {(3, "fund_holdings")}
    docs = spark.createDataFrame([("e", "EX-10"), ("f", "EX-99.1")], "accession_number string, type string")
    assert [r.accession_number for r in reports.newest_press_release(s, docs).collect()] == ["f"]
    assert {r.accession_number for r in reports.first_report_of(s, 2024).collect()} == {"a"}
    done = spark.createDataFrame([(1, "a")], "cik long, accession_number string")
    tickers = spark.createDataFrame([("Z", 2), ("B", 2), ("A", 1)], "symbol string, cik long")
    assert {(r.ticker, r.accession_number) for r in reports.audit_rest(s.filter("cik = 2"), tickers, done).collect()} == {("B", "a"), ("B", "b")}


def test_holdings_changes(spark):
    p = spark.createDataFrame([(1, D(2024, 1, 1), "x", 5.0), (1, D(2024, 1, 1), "y", 5.0), (1, D(2024, 4, 1), "x", 6.0), (1, D(2024, 7, 1), "x", 6.05), (1, D(2024, 7, 1), "z", 1.0)], "cik long, filing_date date, cusip string, weight double")
    got = {(r.filing_date, r.cusip, r.change_type) for r in reports.holdings_changes(p).collect()}
    assert got == {(D(2024, 4, 1), "x", "changed"), (D(2024, 4, 1), "y", "removed"), (D(2024, 7, 1), "z", "added")}


def test_offerings_and_routes(spark):
    t = datetime.datetime
    feed = spark.createDataFrame([("a", "S-1", t(2024, 1, 2), None, "2024-01-02T10:00:00-04:00", []), ("a", "S-1", t(2024, 1, 1), None, "2024-01-01T10:00:00-04:00", []), ("b", "8-K", t(2024, 1, 3), D(2024, 1, 3), "x", ["2.02"])], "accession_number string, form_type string, updated timestamp, filing_date date, updated_text string, items array<string>")
    assert [(r.accession_number, r.day) for r in reports.offerings(feed).collect()] == [("a", D(2024, 1, 2))]
    assert {r.route for r in reports.polled(feed).collect()} == {"", "earnings"}


def test_audit_and_coverage(spark):
    long = "Many words about the business of the company. " * 60
    rows = [("T", 1, "a", D(2024, 1, 1), "10-K", f"Item 1. Business\n{long}\nItem 7. Discussion\n{long}\nItem 8. x\n{long}"), ("T", 1, "b", None, "10-K", None)]
    df = spark.createDataFrame(rows, "ticker string, cik long, accession_number string, filing_date date, form string, content string")
    a, b = reports.report_audit(df).orderBy("accession_number").collect()
    assert a.adequate and a.items_found == "item_1,item_7,item_8" and a.item_1 > 2000 and a.item_2 == 0 and a.error == "" and len(a.item_1_snippet) == 150
    assert b.error == "no document" and not b.adequate and b.items_found == ""
    index = spark.createDataFrame([("10-k",), ("X",), ("X",)], "form_type string")
    unseen, unknown, share = reports.form_coverage(index, 2)
    assert unseen.count() == len(forms.NAMED) - len(forms.RETIRED) - 1 and [tuple(r) for r in unknown.collect()] == [("X", 2)] and tuple(share.first()) == (1, 1)


def test_views(spark):
    class Shout(views.View):
        def render_html(self, markup):
            return markup.upper()

    df = spark.createDataFrame([("a.htm", "<p>x</p>"), ("b.txt", "y"), ("c.pdf", "z"), ("d.htm", None)], "name string, content string")
    show = lambda v: {r.name: r.s for r in df.select("name", views.shown(F.col("name"), F.col("content"), v).alias("s")).collect()}
    assert show(views.MarkdownView()) == {"a.htm": "x", "b.txt": "y", "c.pdf": "[binary document: c.pdf]", "d.htm": None}


def test_settings(tmp_path):
    f = tmp_path / "quarry.toml"
    f.write_text('email = "a@b.org"\nmin_delay_ms = 100\n')
    s = settings.load(f, {"QUARRY_MAX_CONCURRENT": "5"}, max_retries=2)
    assert (s.min_delay_ms, s.max_concurrent, s.max_retries, s.requests_a_second()) == (100, 5, 2, 50) and s.user_agent() == "quarry/0.1 (+a@b.org)"
    f.write_text("other = 1\n")
    with pytest.raises(ValueError, match="other"):
        settings.load(f, {})
    with pytest.raises(ValueError, match="email"):
        settings.Settings().user_agent()
    (tmp_path / "x").mkdir()
    assert settings.found_upwards(tmp_path / "x") == f.resolve()


def test_live_pulls_retry(spark):
    asked = []

    class Handler(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            asked.append(self.path)
            code = 503 if self.path == "/flaky" and asked.count("/flaky") == 1 else 404 if self.path == "/gone" else 200
            self.send_response(code)
            self.end_headers()
            self.wfile.write(self.headers["User-Agent"].encode())

        def log_message(self, *_):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    urls = spark.createDataFrame([(f"{base}/{p}",) for p in ("a", "a", "flaky", "gone")] + [(None,)], "url string")
    s = settings.Settings(email="a@b.org", min_delay_ms=1, max_concurrent=2, max_retries=2)
    got = {r.url.rsplit("/", 1)[1]: (r.status, r.content) for r in live.fetched(urls, s).collect()}
    server.shutdown()
    assert got == {"a": (200, s.user_agent()), "flaky": (200, s.user_agent()), "gone": (404, None)} and asked.count("/a") == 1 and asked.count("/flaky") == 2


@pytest.mark.parametrize("name", ["entity_filings", "filings_with_index_pages", "report_fundamentals", "audit_rest"])
def test_filings_with_equal_accession_numbers_stay_apart(spark, sf_dir, tmp_path, name):
    """Orders a million apart give a customer's filings one number; rows are still those of the SQL."""
    con = duckdb.connect()
    for t in ("orders", "lineitem", "customer"):
        key = {"orders": "o_orderkey", "lineitem": "l_orderkey"}.get(t)
        rows = f"SELECT * FROM '{sf_dir}/{t}.parquet'"
        if key:
            rows += f" UNION ALL SELECT * REPLACE ({key} + 1000000 AS {key}) FROM '{sf_dir}/{t}.parquet' WHERE {key} % 4 < 3"
        con.execute(f"COPY ({rows}) TO '{tmp_path}/{t}.parquet'")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = entry.queries()[name](spark, str(tmp_path))
    columns = sorted(df.columns)
    wanted = con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, wanted))


@pytest.mark.parametrize("name", ["html_reports", "discussions_by_title", "merged_reports", "report_sections"])
def test_documents_are_parsed_once(spark, sf_dir, name):
    plan = entry.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython [") == 1


def test_a_table_of_few_bytes_is_dealt_out(spark, sf_dir):
    """Parsing takes far longer than reading: rows of one small file go to several tasks, in small Arrow batches."""
    for name in ("html_reports", "rendered_pages", "audited_reports"):
        assert entry.queries()[name](spark, sf_dir).rdd.getNumPartitions() >= 4
    assert int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) <= 256


def test_texts_of_latest_sections_are_not_sorted_for_joins(spark):
    """Filings' keys are what joins hold, not texts; and tasks grow with documents."""
    filed = spark.range(9000).selectExpr("id AS cik", "concat('a', id) AS accession_number", "'10-K' AS form", "DATE '2020-01-01' AS filing_date", "'m.htm' AS primary_document")
    texts = filed.selectExpr("accession_number", "'m.htm' AS name", "'10-K' AS type", "'Item 1. Business' AS content")
    out = reports.latest_sections(filed, texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan
    assert int(re.findall(r"hashpartitioning\(cik#\d+L, accession_number#\d+, (\d+)\), REPARTITION_BY_NUM", plan)[0]) == max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3)
    assert out.count() == 9000
