import datetime

import pytest
from pyspark.sql import functions as F

from quarry.operators import coverage, documents, entities, facts, history, holdings


def observations(spark, rows):
    return spark.createDataFrame(rows, "cik long, fact_name string, value double, unit string, fy long, fp string, `end` string, filed string, form string, accn string")


def test_wide_facts_amendment_wins_tag_by_tag(spark):
    rows = [
        (1, "Revenue", 10.0, "USD", 2023, "FY", "2023-12-31", "2024-02-01", "10-K", "a"),
        (1, "Profit", 1.0, "USD", 2023, "FY", "2023-12-31", "2024-02-01", "10-K", "a"),
        (1, "Revenue", 11.5, "USD", 2023, "FY", "2023-12-31", "2024-05-01", "10-K/A", "b"),
        (1, "Revenue", 3.0, "USD", 2023, "Q3", "2023-09-30", "2023-11-01", "10-Q", "c"),
        (1, "Revenue", 4.0, "USD", 2023, "Q4", "2023-12-31", "2023-12-31", "10-K", "d"),
        (1, "Revenue", 9.0, "USD", 2023, "", "2023-09-30", "2023-11-01", "10-Q", "e"),
        (1, "Revenue", 9.0, "USD", 2025, "FY", "2023-12-31", "2024-02-01", "10-K", "f"),
        (1, "Revenue", 7.0, "USD", None, "Q1", "2023-03-31", "2023-05-01", "10-Q", "g"),
        (1, "Revenue", 9.0, "USD", 2023, "Q3", "2023-09-30", "2023-12-01", "8-K", "h"),
    ]
    out = facts.wide_facts(observations(spark, rows), ["Revenue", "Profit", "Missing"]).orderBy("canonical_order").collect()
    assert [(r.canonical_order, r.fy, r.fp, r.Revenue, r.Profit, r.Missing) for r in out] == [(0, 2023, "FY", "11.5::USD", "1::USD", None), (1, 2023, "Q3", "3::USD", None, None), (2, 2023, "Q1", "7::USD", None, None)]
    assert (out[0].form, out[0].is_amendment, out[0].accn) == ("10-K", True, "b")
    assert facts.wide_facts(observations(spark, []), ["Revenue"]).count() == 0


def test_holdings_difference(spark):
    old = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("c", 3.0)], "cusip string, weight double")
    new = spark.createDataFrame([("a", 1.05), ("b", 2.5), ("d", 4.0)], "cusip string, weight double")
    got = {(r.cusip, r.change_type) for r in holdings.difference(old, new, ["cusip"], "weight").collect()}
    assert got == {("b", "changed"), ("c", "removed"), ("d", "added")}
    last = holdings.last_of_key(spark.createDataFrame([("a", 1, 5.0), ("a", 2, 6.0)], "cusip string, n int, weight double"), ["cusip"], ["n"]).collect()
    assert [(r.cusip, r.weight) for r in last] == [("a", 6.0)]


def test_weights_sum_to_a_hundred(spark):
    rows = spark.createDataFrame([("f", 1.0), ("f", 2.0), ("g", 0.0)], "f string, v double")
    got = sorted((r.f, r.weight_pct) for r in holdings.weighted(rows, ["f"], "v").collect())
    assert got == [("f", pytest.approx(33.3333)), ("f", pytest.approx(66.6667)), ("g", 0)]


def test_asof(spark):
    d = datetime.date
    left = spark.createDataFrame([(1, d(2024, 1, 5), "x"), (1, d(2024, 1, 1), "y"), (2, d(2024, 1, 1), "z")], "cik int, day date, id string")
    right = spark.createDataFrame([(1, d(2024, 1, 1), "p"), (1, d(2024, 1, 4), "q"), (1, d(2024, 1, 5), "r")], "cik int, day date, id string")
    got = {r.id: r.previous_id for r in history.asof_before(left, right, ["cik"], "day", ["id"], "id").collect()}
    assert got == {"x": "q", "y": None, "z": None}


def test_merged_and_lookup(spark):
    a = spark.createDataFrame([("X", 1, 0), ("X", 2, 1), ("Y", 3, 2)], "symbol string, cik int, place int")
    b = spark.createDataFrame([("X", 9, 0)], "symbol string, cik int, place int")
    assert {(r.symbol, r.cik) for r in entities.merged([a, b], "symbol", "place").collect()} == {("X", 9), ("Y", 3)}
    asked = spark.createDataFrame([("X",), ("Z",)], "symbol string")
    assert {(r.symbol, r.found) for r in entities.looked_up(asked, [b.select("symbol", "cik"), a.select("symbol", "cik")], "symbol", "cik", "found").collect()} == {("X", 9), ("Z", None)}


def test_related_in_hits(spark):
    hits = spark.createDataFrame([(1, ["0000000001", "0000000002"]), (1, ["0000000003"]), (1, ["0000000000", "1"])], "p int, ciks array<string>")
    assert [(r.primary, r.related) for r in entities.related_in_hits(hits, F.col("p")).collect()] == [(1, 2)]


@pytest.mark.parametrize(
    ("name", "tokens"),
    [("A T & T Inc.", ["ATT", "INC"]), ("O'Neil COMPANY", ["ONEIL", "CO"]), ("Company", ["COMPANY"]), ("J. P. Morgan", ["JP", "MORGAN"]), ("", []), ("U S Steel", ["US", "STEEL"])],
)
def test_name_tokens(spark, name, tokens):
    assert spark.range(1).select(entities.name_tokens(F.lit(name)).alias("t")).first()["t"] == tokens


def test_fuzzy(spark):
    registry = spark.createDataFrame([("AAPL", "Apple Inc.", 1), ("AAPL-W", "Apple Inc.", 1), ("PEAR", "Pear Inc.", 2)], "symbol string, name string, cik int")
    asked = spark.createDataFrame([("APPLE INC",), ("unknown thing",), ("",), (None,)], "q string")
    assert [(r.query, r.symbol) for r in entities.fuzzy_matched(asked, "q", registry, "symbol", "name", "cik").collect()] == [("APPLE INC", "AAPL")]


def test_coverage(spark):
    seen = spark.createDataFrame([("a",), ("a",), ("b",), (None,)], "form string")
    known = spark.createDataFrame([("a",), ("z",)], "form string")
    assert [r.form for r in coverage.unseen(known, seen, "form").collect()] == ["z"]
    assert [tuple(r) for r in coverage.unknown(seen, known, "form", 1).filter("form is not null").collect()] == [("b", 1)]
    assert tuple(coverage.named_share(seen, known, "form").first()) == (1, 1)
    files = spark.createDataFrame([("f", 'a,"b",a'), ("g", "b")], "path string, value string")
    assert {tuple(r) for r in coverage.header_stats(files).collect()} == {("a", 1), ("b", 2)}


LONG = "The company makes many things for many people in many places. " * 60


def test_sections():
    report = f"Table\nItem 1. Business 3\nItem 7. Discussion 9\n\nITEM 1. BUSINESS\n{LONG}\n12\nI T E M  1 A. Risk\n{LONG}{LONG}\nItem 2. Properties\nshort\nItem 7—Discussion\n{LONG}\nItem 8. Statements\n{LONG}"
    found = documents.sections(report)
    assert list(found) == ["item_1", "item_1a", "item_7", "item_8"]
    assert "\n12\n" not in found["item_1"] and found["item_1a"].startswith("ITEM 1A")
    assert documents.sections(None) == {} and documents.sections("") == {}
    fallback = documents.sections(f"MANAGEMENT’S DISCUSSION AND ANALYSIS\n{LONG}\nCONSOLIDATED BALANCE SHEETS\nx")
    assert list(fallback) == ["item_7"] and "BALANCE" not in fallback["item_7"]


def test_markdown():
    page = "<html><head><title>t</title></head><body><ix:header>x</ix:header><h2>Head</h2><p>One <b>two</b></p><ul><li>a</li><li>b</li></ul><table><tr><th></th><th>2023</th></tr><tr><td>Sales</td><td>5</td></tr><tr><td>Loss</td><td></td></tr></table></body></html>"
    md = documents.markdown(page)
    assert "## Head" in md and "**two**" in md and "- a\n- b" in md and "| Sales | 5 |" in md and "x" not in md.split("Head")[0]
    assert "Sales — 2023: 5.\nLoss — 2023: —." in documents.prose(page)
    assert documents.sentences(["| a | b |", "| --- | --- |", "| 1 | 2 |"]) == "a: 1, b: 2.\n"
    assert documents.sentences(["|  |  |", "| 1 | 2 |"]) == "1, 2.\n"
    assert documents.markdown(None) == "" and documents.squeezed("a \n\n\n\nb\n") == "a\n\nb"


def test_description():
    said = "We make and sell a great many useful things to customers in all parts of the world. " * 20
    out = documents.description(f"<html><body><p>Item 1. Business</p><p>short</p><p>{said}</p><p>Item 1A. Risk</p></body></html>")
    assert out.startswith("We make") and out.endswith(".") and len(out) <= 800
    assert documents.description("nothing") is None


def test_documents_of_filings(spark):
    body = f"Item 1. Business\n{LONG}\nItem 7. Discussion\n{LONG}\nItem 8. x\n{LONG}"
    rows = [("f", "p.htm", "p.htm", "10-K", "Item 1. none", 0), ("f", "p.htm", "ex13.htm", "EX-13", body, 1), ("f", "p.htm", "pic.jpg", "GRAPHIC", "x", 2), ("f", "p.htm", "ex31.htm", "EX-31", "<p>cert</p>", 3), ("f", "p.htm", "ex10.htm", "EX-10", "<p>deal</p>", 4)]
    docs = spark.createDataFrame(rows, "filing string, primary_document string, name string, type string, content string, place int")
    assert documents.best_document(docs, ["filing"]).first()["name"] == "ex13.htm"
    assert {r.section for r in documents.merged_sections(docs, ["filing"]).collect()} == {"item_1", "item_7", "item_8"}
    out = documents.exhibits(docs, ["filing"]).first()
    assert [e["name"] for e in out["exhibits"]] == ["ex13.htm", "ex10.htm"] and out["exhibits"][1]["content"] == "deal" and out["body"] == "Item 1. none"


def test_related_pairs_are_distinct_before_they_are_turned(spark):
    hits = spark.createDataFrame([(1, "a"), (1, "b"), (1, "b"), (1, "c"), (1, None), (2, "b"), (2, "a"), (None, "a"), (None, "z")], "g int, m string")
    out = entities.related(hits, "g", "m")
    assert sorted(map(tuple, out.collect())) == [("a", "b"), ("a", "c"), ("b", "a"), ("b", "c"), ("c", "a"), ("c", "b")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") < plan.index("Join")
