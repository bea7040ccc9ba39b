import datetime

import pytest
from pyspark.sql import functions as F

from quarry.functions import dates, text, urls
from quarry.operators import documents


def value(spark, column, **row):
    names = {k: ("string" if v is None else None) for k, v in row.items()}
    df = spark.range(1).select(*[F.lit(v).cast(names[k]).alias(k) if names[k] else F.lit(v).alias(k) for k, v in row.items()] or [F.lit(1).alias("one")])
    return df.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("given", "wanted"), [(" brk.b ", "BRK-B"), ("a/b", "A-B"), (None, None), ("", "")])
def test_ticker_symbol(spark, given, wanted):
    assert value(spark, text.ticker_symbol(F.col("x")), x=given) == wanted


def test_identifiers(spark):
    assert value(spark, text.cik_number(F.col("x")), x="0000320193") == 320193
    assert value(spark, text.cik_number(F.col("x")), x="12345678901") is None
    assert value(spark, text.cik_text(F.lit(42))) == "0000000042"
    assert value(spark, text.accession_dashed(F.col("x")), x="000123456724000042") == "0001234567-24-000042"
    assert value(spark, text.accession_dashed(F.col("x")), x="123") is None
    parts = value(spark, text.accession_parts(F.col("x")), x="0001234567-24-000042")
    assert (parts["cik"], parts["year"], parts["sequence"]) == (1234567, 24, 42)
    assert value(spark, text.accession_from_parts(F.lit(7), F.lit(2024), F.lit(5))) == "0000000007-24-000005"
    assert value(spark, text.symbol_variants(F.lit("A.B"))) == ["A-B", "A.B"]


@pytest.mark.parametrize(("given", "wanted"), [(1e-7, "0.0000001"), (3.482e10, "34820000000"), (0.30000000000000004, "0.30000000000000004"), (-5.5, "-5.5"), (0.0, "0")])
def test_number_text(spark, given, wanted):
    assert value(spark, text.number_text(F.lit(given))) == wanted


def test_forms_and_items(spark):
    assert value(spark, text.base_form(F.lit("10-K/A"))) == "10-K"
    assert value(spark, text.period_label(F.lit(" q4 "))) == "FY"
    assert value(spark, text.items(F.lit(" 2.02, ,9.01,"))) == ["2.02", "9.01"]
    assert value(spark, text.route(F.array(F.lit("2.02")), F.lit("8-K"))) == "earnings"
    assert value(spark, text.route(F.array(F.lit("8.01"), F.lit("9.01")), F.lit("8-k"))) == "event"
    assert value(spark, text.route(F.array(F.lit("9.01")), F.lit("8-K"))) == "other"
    assert value(spark, text.route(F.array(F.lit("2.02")), F.lit("10-Q"))) == ""
    assert value(spark, text.is_substantive(F.lit("ex-10.1"))) is True
    assert value(spark, text.is_substantive(F.lit("EX-31.1"))) is False
    assert value(spark, text.transaction(F.lit("P"))) == "Purchase"
    assert value(spark, text.transaction(F.lit("?"))) == "Transaction"
    assert value(spark, text.usd_short(F.lit(2_500_000_000.0))) == "$2.50B"
    assert value(spark, text.usd_short(F.lit(1_234_000.0))) == "$1.23M"


def test_text_repair(spark):
    assert value(spark, text.collapse_blank_lines(F.lit("\n\na  \n\n\n\nb \n"))) == "a\n\nb"
    assert value(spark, text.snippet(F.lit(" a\n\n b\t c "), 3)) == "a b"
    assert value(spark, text.cleaned_report(F.lit("I T E M  7 A. x\n 12 \ny"))) == "ITEM 7A. x\n\ny"
    for report in ("I T E M  7 A. x\n 12 \ny", "i t e m 1 Abc", "I T E M 7 a. b", "ITEM 10\n--- 3 ---\n\n\n\nz", "Item\t9 B: x\n12345\n"):  # as whole documents
        assert value(spark, text.cleaned_report(F.lit(report))) == documents.report_text(report)
    assert value(spark, text.no_hidden_markup(F.lit('<ix:header>x</ix:header>a<div style="display:none">b</div>c'))) == "ac"
    assert value(spark, text.item_key(F.lit("Item 1 A"))) == "item_1a"
    assert value(spark, text.path_name(F.lit("a b/c"))) == "a_b_c"


@pytest.mark.parametrize(("given", "wanted"), [("2024Q3", 3), ("FY2023", 4), ("h1", 2), ("SA2 2020", 4), ("12M", 4), ("9M", 3), ("6M", 2), ("3M", 1), ("x", 0), ("Annual", 4)])
def test_period_rank(spark, given, wanted):
    assert value(spark, dates.period_rank(F.lit(given))) == wanted


def test_dates(spark):
    assert value(spark, dates.strict_date(F.lit("2024-02-30"))) is None
    assert value(spark, dates.strict_date(F.lit("2024-02-29"))) == datetime.date(2024, 2, 29)
    assert value(spark, dates.strict_date(F.lit("2024-2-9"))) is None
    assert value(spark, dates.end_year(F.lit("x"))) == 0
    assert value(spark, dates.month_day(F.lit("0229"))) == datetime.date(2000, 2, 29)
    assert value(spark, dates.first_year(F.lit("Q1 20241999"))) == 2024
    assert value(spark, dates.first_year(F.lit("none"))) is None
    assert value(spark, dates.compact_stamp(F.lit("2026-03-13T17:02:03-04:00"))) == "20260313170203"
    assert value(spark, dates.previous_quarter(F.lit(datetime.date(2024, 2, 10)))) == datetime.date(2023, 10, 1)
    assert value(spark, dates.feed_day(F.lit(None).cast("date"), F.lit("2026-03-13T23:59:00-04:00"))) == datetime.date(2026, 3, 13)


def test_amounts(spark):
    day = lambda s: F.lit(s).cast("date")
    assert value(spark, dates.dollars(F.lit(5), day("2022-12-31"))) == 5000
    assert value(spark, dates.dollars(F.lit(5), day("2023-01-01"))) == 5
    assert value(spark, dates.dollars(F.lit(5), day(None))) == 5
    assert value(spark, dates.pct(F.lit(2.0), F.lit(3.0))) == pytest.approx(66.6667)
    assert value(spark, dates.pct(F.lit(2.0), F.lit(0.0))) == 0
    assert value(spark, dates.decimal_or_zero(F.lit("x"))) == 0
    assert value(spark, dates.decimal_not_zero(F.lit("0.00"))) is None


def test_addresses(spark):
    a = F.lit("0001234567-24-000042")
    assert value(spark, urls.document(F.lit(7), a, F.lit("d.htm"))).endswith("/edgar/data/7/000123456724000042/d.htm")
    assert value(spark, urls.index_page(F.lit(7), a)).endswith("/000123456724000042/0001234567-24-000042-index.htm")
    assert value(spark, urls.submissions(F.lit(7))).endswith("/submissions/CIK0000000007.json")
    assert value(spark, urls.full_index(F.lit(2024), F.lit(2))).endswith("/2024/QTR2/master.idx")
    assert "q=%22a%22b%25%22" in value(spark, urls.related_search(F.lit('a"b%')))
