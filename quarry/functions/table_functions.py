"""Readers of artifacts as table functions, for use in SQL. register(spark) makes them known to a session:

    SELECT * FROM positions_13f(TABLE(SELECT filing, filing_date, content FROM docs) PARTITION BY filing)
    SELECT * FROM insider_transactions(TABLE(SELECT filing, content FROM docs) PARTITION BY filing)

They give the rows of quarry.sources.filings.holdings_13f() and insider_transactions(): the first column is the table's own,
whatever its type. A partition is a filing: one document after the other is parsed, and weights are given at its end.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from datetime import date
from decimal import ROUND_HALF_EVEN, ROUND_HALF_UP, Decimal, InvalidOperation
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import BooleanType, DateType, DecimalType, DoubleType, IntegerType, Row, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from quarry.functions import text
from quarry.functions.dates import DOLLARS_SINCE

KINDS = {"int": IntegerType(), "string": StringType(), "boolean": BooleanType(), "date": DateType(), "double": DoubleType(), "decimal": DecimalType(28, 8)}
CENTI, TEN_THOUSANDTH = Decimal("1e-8"), Decimal("1e-4")


@lru_cache(1024)
def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _children(e: ET.Element | None, name: str) -> list[ET.Element]:
    return [] if e is None else [c for c in e if _local(c.tag) == name]


def _members(e: ET.Element | None) -> dict[str, ET.Element]:
    """The elements in an element by name, the last where several are."""
    return {} if e is None else {_local(c.tag): c for c in e}


def _text(e: ET.Element | None) -> str:
    """An element's text, without spaces around; else empty."""
    return "" if e is None else (e.text or "").strip(" ")


def _number(s: str) -> Decimal | None:
    try:
        return Decimal(s).quantize(CENTI, ROUND_HALF_UP)
    except InvalidOperation:
        return None


def _root(content: str | None) -> ET.Element | None:
    try:
        return ET.fromstring(content or "")
    except ET.ParseError:
        return None


def _keyed(table: AnalyzeArgument, columns: str) -> AnalyzeResult:
    """The table's first column, then columns (name, type)."""
    schema = StructType([table.dataType.fields[0]])
    for column in columns.split(", "):
        name, kind = column.split(" ")
        schema.add(name, KINDS[kind])
    return AnalyzeResult(schema)


def _value(e: ET.Element | None) -> str:
    """The text of the element "value" in an element, of the last where several are."""
    found = _children(e, "value")
    return _text(found[-1]) if found else ""


class Positions13F:
    """Positions of information tables (key, filing_date, content), in dollars, with their weights in percent of the partition."""

    def __init__(self):
        self.rows: list[tuple] = []

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        return _keyed(docs, "place int, name string, cusip string, title_of_class string, value_usd decimal, shares decimal, shares_type string, put_call string, weight_pct double")

    def eval(self, doc: Row) -> None:
        thousands = doc["filing_date"] is not None and doc["filing_date"] < date.fromisoformat(DOLLARS_SINCE)
        for place, e in enumerate(_children(_root(doc["content"]), "infoTable")):
            of = _members(e).get
            amount = _members(of("shrsOrPrnAmt")).get
            value = (_number(_text(of("value"))) or Decimal(0)) * (1000 if thousands else 1)
            shares = _number(_text(amount("sshPrnamt"))) or Decimal(0)
            self.rows.append((doc[0], place, _text(of("nameOfIssuer")), _text(of("cusip")), _text(of("titleOfClass")), value, shares, _text(amount("sshPrnamtType")), _text(of("putCall")) or None))

    def terminate(self) -> Iterator[tuple]:
        total = float(sum((r[5] for r in self.rows), Decimal(0)))
        for r in self.rows:
            share = Decimal(repr(float(r[5]) / total * 100)).quantize(TEN_THOUSANDTH, ROUND_HALF_EVEN) if total else 0
            yield (*r, float(share))


class InsiderTransactions:
    """Transactions of insider reports (key, content), both tables; of several owners the last one's identity counts."""

    @staticmethod
    def analyze(docs: AnalyzeArgument) -> AnalyzeResult:
        return _keyed(
            docs,
            "place int, owner_name string, owner_cik string, officer_title string, is_director boolean, is_officer boolean, is_ten_percent_owner boolean, role string, is_derivative boolean, security_title string, transaction_date date, "
            "transaction_code string, transaction string, shares decimal, price decimal, acquired_disposed string, shares_after decimal",
        )

    def eval(self, doc: Row) -> Iterator[tuple]:
        root = _root(doc["content"])
        owner = (_children(root, "reportingOwner") or [None])[-1]
        relation, identity = (_members(_members(owner).get(f"reportingOwner{x}")).get for x in ("Relationship", "Id"))
        flag = lambda name: _text(relation(name)).lower() in ("1", "true")
        title = _text(relation("officerTitle")) or None
        director, ten = flag("isDirector"), flag("isTenPercentOwner")
        role = title or ("Director" if director else "10% Owner" if ten else "Insider")
        who = (_text(identity("rptOwnerName")), _text(identity("rptOwnerCik")), title, director, flag("isOfficer"), ten, role)
        tables = [(e, kind == "derivative") for kind in ("nonDerivative", "derivative") for t in _children(root, f"{kind}Table")[-1:] for e in _children(t, f"{kind}Transaction")]
        for place, (e, derivative) in enumerate(tables):
            of = _members(e).get
            amounts, after = (_members(of(x)).get for x in ("transactionAmounts", "postTransactionAmounts"))
            day, code = _value(of("transactionDate")), _text(_members(of("transactionCoding")).get("transactionCode"))
            yield (
                doc[0], place, *who, derivative, _value(of("securityTitle")), _day(day), code, text.TRANSACTIONS.get(code, "Transaction"),
                _number(_value(amounts("transactionShares"))) or Decimal(0), _number(_value(amounts("transactionPricePerShare"))) or None,
                _value(amounts("transactionAcquiredDisposedCode")), _number(_value(after("sharesOwnedFollowingTransaction"))) or Decimal(0),
            )


def _day(s: str) -> date | None:
    try:
        return date.fromisoformat(s) if re.fullmatch(r"\d{4}-\d{2}-\d{2}", s) else None
    except ValueError:
        return None


def register(spark: SparkSession) -> None:
    spark.udtf.register("positions_13f", udtf(Positions13F, useArrow=True))
    spark.udtf.register("insider_transactions", udtf(InsiderTransactions, useArrow=True))
