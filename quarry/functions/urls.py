"""Addresses of public filing artifacts, as expressions of their parts. The formats are fixed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import text

ARCHIVES = "https://www.sec.gov/Archives"
DATA = "https://data.sec.gov"


def _join(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def folder(cik: Column, accession: Column) -> Column:
    return _join(f"{ARCHIVES}/edgar/data/", cik, "/", text.accession_digits(accession))


def index_page(cik: Column, accession: Column) -> Column:
    return _join(folder(cik, accession), "/", text.accession_dashed(accession), "-index.htm")


def document(cik: Column, accession: Column, name: Column) -> Column:
    return _join(folder(cik, accession), "/", name)


def primary_xml(cik: Column, accession: Column) -> Column:
    return _join(folder(cik, accession), "/primary_doc.xml")


def submission_text(cik: Column, accession: Column) -> Column:
    return _join(f"{ARCHIVES}/edgar/data/", cik, "/", text.accession_dashed(accession), ".txt")


def archive(path: Column) -> Column:
    return _join(f"{ARCHIVES}/", path)


def submissions(cik: Column) -> Column:
    return _join(f"{DATA}/submissions/CIK", text.cik_text(cik), ".json")


def submissions_page(name: Column) -> Column:
    return _join(f"{DATA}/submissions/", name)


def company_facts(cik: Column) -> Column:
    return _join(f"{DATA}/api/xbrl/companyfacts/CIK", text.cik_text(cik), ".json")


def full_index(year: Column, quarter: Column) -> Column:
    return _join(f"{ARCHIVES}/edgar/full-index/", year, "/QTR", quarter, "/master.idx")


def fund_series(year: Column) -> Column:
    return _join("https://www.sec.gov/files/investment/data/other/investment-company-series-and-class-information/investment-company-series-class-", year, ".csv")


def current_feed(form: Column, before: Column, count: Column) -> Column:
    return _join("https://www.sec.gov/cgi-bin/browse-edgar?action=getcurrent&type=", form, "&dateb=", before, "&owner=include&count=", count, "&search_text=&output=atom")


def company_feed(cik: Column, form: Column, before: Column, count: Column) -> Column:
    return _join("https://www.sec.gov/cgi-bin/browse-edgar?action=getcompany&CIK=", text.cik_text(cik), "&type=", form, "&dateb=", before, "&owner=include&count=", count, "&search_text=&output=atom")


def related_search(name: Column) -> Column:
    quoted = F.replace(F.replace(name, F.lit("%"), F.lit("%25")), F.lit('"'), F.lit("%22"))
    return _join("https://efts.sec.gov/LATEST/search-index?q=%22", quoted, "%22&forms=10-K&_source=ciks,display_names&from=0&size=100")


TICKERS_JSON = "https://www.sec.gov/files/company_tickers.json"
TICKERS_TEXT = "https://www.sec.gov/include/ticker.txt"
SIC_CODES = "https://www.sec.gov/info/edgar/siccodes.htm"
