"""Sources: raw filing artifacts to typed rows.

Artifacts land as files; documents() reads them whole, one row each, and the readers turn such rows (path, content) into
rows of the artifact. Malformed artifacts give no rows; missing texts are empty and missing numbers 0, missing dates null.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions import dates, text
from quarry.session import written
from quarry.sources.file_heads import FileHeads


def documents(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content of all files below path; whole texts."""
    reader = spark.read.option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def raw_reports(spark: SparkSession, path: str) -> DataFrame:
    """ticker_symbol (the folder), accession_number (the file's stem), raw_text of .htm and .txt files."""
    d = documents(spark, path, "*.{htm,txt}")
    parts = F.split("path", "/")
    return d.select(F.element_at(parts, -2).alias("ticker_symbol"), F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "").alias("accession_number"), F.col("content").alias("raw_text"))


# ---- JSON ------------------------------------------------------------------------------------------------------------

OBSERVATION = T.StructType(
    [T.StructField(n, t) for n, t in (("end", T.StringType()), ("val", T.DoubleType()), ("accn", T.StringType()), ("fy", T.LongType()), ("fp", T.StringType()), ("form", T.StringType()), ("filed", T.StringType()))]
)
FACTS = T.StructType(
    [
        T.StructField("cik", T.LongType()),
        T.StructField("entityName", T.StringType()),
        T.StructField("facts", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StructType([T.StructField("label", T.StringType()), T.StructField("units", T.MapType(T.StringType(), T.ArrayType(OBSERVATION)))])))),
    ]
)


def company_facts(docs: DataFrame, content: str = "content") -> DataFrame:
    """A row for each observation: cik, entity_name, taxonomy, fact_name, unit, end, value, accn, fy, fp, form, filed."""
    doc = docs.select(F.from_json(content, FACTS).alias("d")).filter("d.facts is not null")
    facts = doc.select("d.cik", F.col("d.entityName").alias("entity_name"), F.explode("d.facts").alias("taxonomy", "m"))
    names = facts.select("cik", "entity_name", "taxonomy", F.explode("m").alias("fact_name", "fact"))
    units = names.select("cik", "entity_name", "taxonomy", "fact_name", F.explode("fact.units").alias("unit", "rows"))
    rows = units.select("cik", "entity_name", "taxonomy", "fact_name", "unit", F.explode("rows").alias("o"))
    blank = lambda c: F.coalesce(F.col(f"o.{c}"), F.lit("")).alias(c)
    return rows.select("cik", "entity_name", "taxonomy", "fact_name", "unit", blank("end"), F.coalesce("o.val", F.lit(0.0)).alias("value"), blank("accn"), "o.fy", blank("fp"), blank("form"), blank("filed"))


BLOCK = "struct<accessionNumber:array<string>,filingDate:array<string>,form:array<string>,primaryDocument:array<string>,items:array<string>>"
SUBMISSIONS = f"struct<cik:string,entityType:string,name:string,filings:struct<recent:{BLOCK},files:array<struct<name:string,filingCount:bigint>>>>"


def _block(rows: DataFrame, block: str, keep: list[Column]) -> DataFrame:
    """Parallel arrays to rows, up to the shortest of the required ones; items by position; bad accession numbers go."""
    b = lambda c: F.col(f"{block}.{c}")
    n = F.least(F.size(b("accessionNumber")), F.size(b("filingDate")), F.size(b("form")), F.size(b("primaryDocument")))
    zipped = F.arrays_zip(b("accessionNumber"), b("filingDate"), b("form"), b("primaryDocument"))
    rows = rows.filter(b("accessionNumber").isNotNull() & (n > 0)).select(*keep, b("items").alias("_items"), F.posexplode(F.slice(zipped, F.lit(1), n)).alias("_i", "_z"))
    accession = text.accession_dashed(F.col("_z.accessionNumber"))
    return rows.select(
        *[c for c in rows.columns if not c.startswith("_")],
        accession.alias("accession_number"),
        F.coalesce("_z.form", F.lit("")).alias("form"),
        F.coalesce("_z.primaryDocument", F.lit("")).alias("primary_document"),
        dates.strict_date(F.col("_z.filingDate")).alias("filing_date"),
        text.items(F.get("_items", F.col("_i"))).alias("items"),
    ).filter("accession_number is not null")


def submissions(docs: DataFrame, content: str = "content") -> DataFrame:
    """cik, entity_name, accession_number, form, primary_document, filing_date, items of the recent block."""
    d = docs.select(F.from_json(content, SUBMISSIONS).alias("d"))
    return _block(d, "d.filings.recent", [F.col("d.cik").try_cast("long").alias("cik"), F.col("d.name").alias("entity_name")])


def submission_pages(docs: DataFrame, content: str = "content", cik: str = "cik") -> DataFrame:
    """The same from older pages, whose top level is the block itself; rows of docs say whose they are."""
    d = docs.select(F.col(cik).alias("cik"), F.lit(None).cast("string").alias("entity_name"), F.from_json(content, BLOCK).alias("d"))
    return _block(d, "d", [F.col("cik"), F.col("entity_name")])


def all_submissions(recent: DataFrame, pages: DataFrame) -> DataFrame:
    names = recent.groupBy(F.col("cik").alias("_c")).agg(F.max("entity_name").alias("_n"))
    old = pages.join(names, F.col("cik") == F.col("_c"), "left").withColumn("entity_name", F.coalesce("entity_name", "_n")).drop("_c", "_n")
    return recent.unionByName(old.select(recent.columns))


def tickers_json(docs: DataFrame, content: str = "content") -> DataFrame:
    """cik, symbol, company_name, origin of the list of primary listings."""
    rows = docs.select(F.explode(F.from_json(content, "map<string,struct<cik_str:bigint,ticker:string,title:string>>")).alias("_k", "t"))
    return rows.select(F.col("t.cik_str").alias("cik"), text.ticker_symbol(F.col("t.ticker")).alias("symbol"), F.coalesce("t.title", F.lit("")).alias("company_name"), F.lit("PrimaryListing").alias("origin")).filter("cik is not null and symbol != ''")


def tickers_text(docs: DataFrame, content: str = "content") -> DataFrame:
    """The same of lines of symbol, tab, cik; malformed lines go. place is a line's number."""
    rows = docs.select(F.posexplode(F.split(content, r"\r?\n")).alias("place", "line")).withColumn("p", F.split("line", "\t", 2))
    out = rows.select("place", text.cik_number(F.try_element_at("p", F.lit(2))).alias("cik"), text.ticker_symbol(F.get("p", F.lit(0))).alias("symbol"))
    return out.filter("cik is not null and symbol != ''").select("cik", "symbol", F.lit("").alias("company_name"), F.lit("DerivedInstrument").alias("origin"), "place")


def company_profiles(docs: DataFrame, content: str = "content") -> DataFrame:
    """One row for each company: names, industry, tickers, exchanges, state, fiscal year end; empty texts are null."""
    schema = "struct<cik:string,name:string,entityType:string,sic:string,sicDescription:string,ownerOrg:string,tickers:array<string>,exchanges:array<string>,ein:string,website:string,category:string,fiscalYearEnd:string,stateOfIncorporation:string,stateOfIncorporationDescription:string,phone:string>"
    d = docs.select(F.from_json(content, schema).alias("d"))
    t = lambda c: F.nullif(F.trim(F.col(f"d.{c}")), F.lit(""))
    return d.select(
        F.col("d.cik").try_cast("long").alias("cik"),
        t("name").alias("name"),
        t("entityType").alias("entity_type"),
        t("sic").try_cast("int").alias("sic"),
        t("sicDescription").alias("sic_description"),
        t("ownerOrg").alias("owner_org"),
        text.after_first_space(t("ownerOrg")).alias("sector"),
        F.coalesce("d.tickers", F.array().cast("array<string>")).alias("tickers"),
        F.array_distinct(F.filter(F.coalesce("d.exchanges", F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))).alias("exchanges"),
        t("ein").alias("ein"),
        t("website").alias("website"),
        t("category").alias("category"),
        t("fiscalYearEnd").alias("fiscal_year_end"),
        dates.month_day(t("fiscalYearEnd")).alias("fiscal_year_end_date"),
        F.coalesce(t("stateOfIncorporationDescription"), t("stateOfIncorporation")).alias("state"),
        t("phone").alias("phone"),
    ).filter("cik is not null")


def search_hits(docs: DataFrame, content: str = "content") -> DataFrame:
    """ciks (array<string>) of each hit of a search answer."""
    d = docs.select(F.explode(F.from_json(content, "struct<hits:struct<hits:array<struct<_source:struct<ciks:array<string>>>>>>")["hits"]["hits"]).alias("h"))
    return d.select(F.col("h._source.ciks").alias("ciks")).filter("ciks is not null")


# ---- delimited -------------------------------------------------------------------------------------------------------


def master_index(docs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """cik, company_name, form_type, date_filed, filename of the rows below the line of dashes, and keep; malformed rows go."""
    keep = keep or []
    lines = F.split(content, r"\r?\n")
    begin = F.array_position(F.transform(lines, lambda x: x.startswith("---")), F.lit(True)).cast("int")
    rows = docs.select(*keep, lines.alias("lines"), begin.alias("b")).filter("b > 0").select(*keep, F.explode(F.slice("lines", F.col("b") + 1, F.size("lines"))).alias("line"))
    p = F.split("line", r"[|]", 5)
    rows = rows.select(*keep, p.alias("p")).filter(F.size("p") == 5)
    part = lambda i: F.trim(F.get("p", F.lit(i)))
    return rows.select(*keep, part(0).alias("cik"), part(1).alias("company_name"), part(2).alias("form_type"), dates.strict_date(part(3)).alias("date_filed"), part(4).alias("filename")).filter("date_filed is not null")


#: Quarters that may be broadcast: more than there are.
MOST_QUARTERS = 10_000


def index_files(docs: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """master_index() of files of quarters, with year and quarter from their paths (.../2024/QTR1/...)."""
    part = lambda k, i: F.regexp_extract(path, r"/(\d{4})/QTR([1-4])/", i).try_cast("int").alias(k)
    return master_index(docs.select(part("year", 1), part("quarter", 2), content), content, ["year", "quarter"]).filter("year is not null")


def quarters_of(spark: SparkSession, path: str, quarters: DataFrame) -> DataFrame:
    """The rows of some quarters (year, quarter) of what sinks.write_quarters() wrote: only their folders are read.

    The filter is one that Spark takes for selective, so it prunes partitions by the quarters it finds when the query runs.
    """
    wanted = quarters.select("year", "quarter").filter("quarter BETWEEN 1 AND 4").distinct()
    n = wanted.limit(MOST_QUARTERS + 1).count()
    return spark.read.parquet(path).join(F.broadcast(wanted) if n <= MOST_QUARTERS else wanted, ["year", "quarter"])


FUND_COLUMNS = [  # fixed values: headers of the list of fund series and classes
    "Reporting File Number", "CIK Number", "Entity Name", "Entity Org Type", "Series ID", "Series Name", "Class ID", "Class Name", "Class Ticker", "Address_1", "Address_2", "City", "State", "Zip Code",
]


def fund_series(spark: SparkSession, path: str) -> DataFrame:
    """The list of fund series and classes: 14 nullable texts; columns that a year's file lacks are null."""
    read = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    there = {c.strip(): c for c in read.columns}
    name = lambda c: c.lower().replace(" ", "_")
    return read.select(*[(F.col(f"`{there[c]}`") if c in there else F.lit(None).cast("string")).alias(name(c)) for c in FUND_COLUMNS])


def latest_year(years: DataFrame, year: str = "year", least: int = 2024) -> DataFrame:
    """The rows of the newest year there is, least at the earliest. The maximum prunes partitions by year."""
    found = years.agg(F.max(year)).first()[0]
    return years.filter(F.lit(False)) if found is None or int(found) < least else years.filter(F.col(year) == found)


def csv_headers(spark: SparkSession, path: str) -> DataFrame:
    """path and first line of each CSV file; no more of it is read."""
    spark.dataSource.register(FileHeads)
    return spark.read.format("file_heads").options(at=path, suffix=".csv").load()


# ---- XML -------------------------------------------------------------------------------------------------------------


def _rows(docs: DataFrame, content: str, root: str, schema: str, keep: list[str]) -> DataFrame:
    parsed = F.from_xml(F.col(content), schema, {"ignoreNamespace": "true", "mode": "PERMISSIVE", "attributePrefix": "@"})
    return docs.select(*keep, F.posexplode(parsed[root]).alias("place", "r"))


def _number(path: str) -> Column:
    return dates.decimal_or_zero(F.col(path))


def _text(path: str) -> Column:
    return F.coalesce(F.trim(F.col(path)), F.lit(""))


#: Members of a position of an information table, by the names of the public schema.
POSITION = "nameOfIssuer:string,titleOfClass:string,cusip:string,value:string,shrsOrPrnAmt:struct<sshPrnamt:string,sshPrnamtType:string>,putCall:string,investmentDiscretion:string"


def _positions(rows: DataFrame, filed: str, *keep: str) -> DataFrame:
    value = dates.dollars(_number("r.value"), F.col(filed)).cast("decimal(28,8)")
    return rows.select(*keep, _text("r.nameOfIssuer").alias("name"), _text("r.cusip").alias("cusip"), _text("r.titleOfClass").alias("title_of_class"), value.alias("value_usd"), _number("r.shrsOrPrnAmt.sshPrnamt").alias("shares"), _text("r.shrsOrPrnAmt.sshPrnamtType").alias("shares_type"), F.nullif(_text("r.putCall"), F.lit("")).alias("put_call"), _text("r.investmentDiscretion").alias("investment_discretion"))


def holdings_13f(docs: DataFrame, content: str = "content", filed: str = "filing_date", keep: list[str] | None = None) -> DataFrame:
    """Positions of information tables, in dollars, with weights in percent of the filing; largest first within a filing.

    docs has filing_date (null: values are in dollars) and the columns keep, which name a filing.
    """
    keep = keep or [c for c in docs.columns if c != content]
    rows = _positions(_rows(docs, content, "infoTable", f"infoTable array<struct<{POSITION}>>", keep), filed, *keep, "place")
    total = F.sum("value_usd").over(Window.partitionBy(*keep))
    return rows.withColumn("weight_pct", dates.pct(F.col("value_usd").cast("double"), total.cast("double")))


#: Of a part of a text cut behind each "tag>": what stood in the element that it closes, opened in this part or at its end before.
_INNER = r"(?s)^(?:.*<(?:[\w.-]+:)?{tag}\b[^>]*>)?(.*)</(?:[\w.-]+:)?$"


def elements(spark: SparkSession, path: str, tag: str, members: str) -> DataFrame:
    """r, a struct of members, for each element of a name in the XML files below path; and the columns of their folders.

    Files are cut behind each end of the tag, as lines are at line breaks, so one large file is read by many tasks, each from
    the first end in its share on; a packed one (.gz) by one task. Elements don't hold others of their name. Prefixes of names don't count.
    """
    parts = spark.read.option("lineSep", f"{tag}>").text(path).filter(F.col("value").rlike(r"</(?:[\w.-]+:)?$"))
    inner = F.regexp_replace(F.regexp_extract("value", _INNER.replace("{tag}", tag), 1), r"(</?)[\w.-]+:", "$1")
    parsed = F.from_xml(F.concat(F.lit("<r>"), inner, F.lit("</r>")), f"struct<{members}>", {"mode": "PERMISSIVE"})
    return parts.select(*[c for c in parts.columns if c != "value"], parsed.alias("r"))


def holdings_13f_files(spark: SparkSession, path: str, filings_: DataFrame, filing: str = "filing", filed: str = "filing_date") -> DataFrame:
    """holdings_13f() of files below path, in a folder filing=... for each, however large: elements() reads them in shares.

    filings_ (filing, filing_date) says when each was filed; filings without a row there count as undated. A filing's total is
    summed by position and joined back, after positions are parsed once and written. Rows have no place, since a task doesn't know how many stand before its share.
    """
    read = elements(spark, path, "infoTable", POSITION).withColumn(filing, F.col(filing).cast(filings_.schema[filing].dataType))
    dated = filings_.groupBy(filing).agg(F.max(filed).alias(filed))
    rows = written(_positions(read.join(dated, filing, "left"), filed, filing, filed), "positions")
    total = rows.groupBy(filing).agg(F.sum("value_usd").alias("_total"))
    weight = dates.pct(F.col("value_usd").cast("double"), F.col("_total").cast("double"))
    return rows.join(total, filing).withColumn("weight_pct", weight).drop("_total")


def holdings_nport(docs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Investments of fund reports; amounts rounded half to even to cents. Largest share first: order by pct_val, place."""
    keep = keep or [c for c in docs.columns if c != content]
    inner = "array<struct<name:string,lei:string,title:string,cusip:string,identifiers:struct<isin:struct<`@value`:string>>,balance:string,units:string,curCd:string,valUSD:string,pctVal:string,payoffProfile:string,assetCat:string,issuerCat:string,invCountry:string>>"
    parsed = F.from_xml(F.col(content), f"formData struct<invstOrSecs:struct<invstOrSec:{inner}>>", {"ignoreNamespace": "true", "attributePrefix": "@"})
    rows = docs.select(*keep, F.posexplode(parsed["formData"]["invstOrSecs"]["invstOrSec"]).alias("place", "r"))
    two = lambda p: F.bround(_number(p), 2).cast("decimal(28,2)")
    t = {"name": "name", "lei": "lei", "title": "title", "cusip": "cusip", "units": "units", "curCd": "currency", "payoffProfile": "payoff_profile", "assetCat": "asset_category", "issuerCat": "issuer_category", "invCountry": "country"}
    isin = F.coalesce(F.col("r.identifiers.isin.`@value`"), F.lit("")).alias("isin")
    return rows.select(*keep, "place", *[_text(f"r.{a}").alias(b) for a, b in t.items()], isin, two("r.balance").alias("balance"), two("r.valUSD").alias("val_usd"), dates.decimal_or_zero(F.col("r.pctVal"), "decimal(28,12)").alias("pct_val"))


def insider_transactions(docs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Transactions of insider reports, both tables; of several owners the last one's identity counts."""
    keep = keep or [c for c in docs.columns if c != content]
    v = "struct<value:string>"
    row = f"array<struct<securityTitle:{v},transactionDate:{v},transactionCoding:struct<transactionCode:string>,transactionAmounts:struct<transactionShares:{v},transactionPricePerShare:{v},transactionAcquiredDisposedCode:{v}>,postTransactionAmounts:struct<sharesOwnedFollowingTransaction:{v}>>>"
    owner = "array<struct<reportingOwnerId:struct<rptOwnerCik:string,rptOwnerName:string>,reportingOwnerRelationship:struct<isDirector:string,isOfficer:string,isTenPercentOwner:string,officerTitle:string>>>"
    schema = f"reportingOwner {owner}, nonDerivativeTable struct<nonDerivativeTransaction:{row}>, derivativeTable struct<derivativeTransaction:{row}>"
    d = docs.select(*keep, F.from_xml(F.col(content), schema, {"ignoreNamespace": "true"}).alias("d"))
    mark = lambda path, flag: F.transform(F.coalesce(F.col(path), F.array().cast(row)), lambda x: F.struct(x.alias("t"), F.lit(flag).alias("is_derivative")))
    both = F.concat(mark("d.nonDerivativeTable.nonDerivativeTransaction", False), mark("d.derivativeTable.derivativeTransaction", True))
    rows = d.select(*keep, F.try_element_at("d.reportingOwner", F.lit(-1)).alias("o"), F.posexplode(both).alias("place", "x"))
    flag = lambda c: F.coalesce(F.lower(F.trim(F.col(f"o.reportingOwnerRelationship.{c}"))).isin("1", "true"), F.lit(False))
    title = F.nullif(_text("o.reportingOwnerRelationship.officerTitle"), F.lit(""))
    return rows.select(
        *keep,
        "place",
        _text("o.reportingOwnerId.rptOwnerName").alias("owner_name"),
        _text("o.reportingOwnerId.rptOwnerCik").alias("owner_cik"),
        title.alias("officer_title"),
        flag("isDirector").alias("is_director"),
        flag("isOfficer").alias("is_officer"),
        flag("isTenPercentOwner").alias("is_ten_percent_owner"),
        text.insider_role(title, flag("isDirector"), flag("isTenPercentOwner")).alias("role"),
        "x.is_derivative",
        _text("x.t.securityTitle.value").alias("security_title"),
        dates.strict_date(F.trim("x.t.transactionDate.value")).alias("transaction_date"),
        _text("x.t.transactionCoding.transactionCode").alias("transaction_code"),
        text.transaction(F.trim("x.t.transactionCoding.transactionCode")).alias("transaction"),
        _number("x.t.transactionAmounts.transactionShares.value").alias("shares"),
        dates.decimal_not_zero(F.col("x.t.transactionAmounts.transactionPricePerShare.value")).alias("price"),
        _text("x.t.transactionAmounts.transactionAcquiredDisposedCode.value").alias("acquired_disposed"),
        _number("x.t.postTransactionAmounts.sharesOwnedFollowingTransaction.value").alias("shares_after"),
    )


def feed_entries(docs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """Entries of Atom feeds: accession, cik, company, form, filing date, address, time of update, items; and the columns keep."""
    schema = "entry array<struct<title:string,updated:string,id:string,link:struct<`@href`:string>,summary:struct<`_VALUE`:string>,category:struct<`@term`:string>>>"
    rows = _rows(docs, content, "entry", schema, keep or [])
    accession = text.accession_dashed(F.regexp_extract("r.id", r"accession-number=([0-9-]+)", 1))
    summary = F.coalesce("r.summary._VALUE", F.lit(""))
    return rows.select(
        *(keep or []),
        accession.alias("accession_number"),
        text.feed_cik(F.col("r.link.`@href`")).alias("cik"),
        F.coalesce(text.feed_company(F.col("r.title")), F.lit("")).alias("company_name"),
        F.coalesce("r.category.`@term`", F.lit("")).alias("form_type"),
        text.feed_filed(summary).alias("filing_date"),
        F.coalesce("r.link.`@href`", F.lit("")).alias("filing_href"),
        F.try_to_timestamp(F.col("r.updated")).alias("updated"),
        F.col("r.updated").alias("updated_text"),
        text.feed_items(summary).alias("items"),
    ).filter("accession_number is not null and updated is not null")


# ---- HTML ------------------------------------------------------------------------------------------------------------


#: An element of a name and what it holds, up to the first end of that name. Each character is looked at once, and nothing is tried again.
_ELEMENT = r"(?is)<{name}\b[^>]*>([^<]*+(?:<(?!/{name}>)[^<]*+)*+)</{name}>"


def _cells(docs: DataFrame, content: str, keep: list[str], row: Callable[[Column], Column]) -> DataFrame:
    """keep, place and r, which row() makes of a table row's cells; rows of which it makes null go.

    All of it stands within the generator, so a filter on its columns takes no cell apart again.
    """
    inside = lambda c, name: F.regexp_extract_all(c, F.lit(_ELEMENT.replace("{name}", name)), F.lit(1))
    cells = F.transform(inside(F.col(content), "tr"), lambda tr: inside(tr, "t[dh]"))
    return docs.select(*keep, F.posexplode(F.transform(cells, row)).alias("place", "r")).filter("r is not null")


def _plain(c: Column) -> Column:
    c = F.replace(text.no_tags(c), F.lit("&nbsp;"), F.lit(" "))
    return F.trim(F.regexp_replace(F.replace(c, F.lit("&amp;"), F.lit("&")), r"\s+", " "))


def filing_index(docs: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """name and type of each document on a filing's index page: rows of four cells or more with a link in the third."""
    keep = keep or [c for c in docs.columns if c != content]

    def row(c: Column) -> Column:
        href = F.regexp_extract(F.get(c, F.lit(2)), r"(?is)href\s*=\s*[\"']([^\"']*)[\"']", 1)
        href = F.when(F.contains(href, F.lit("doc=")), F.regexp_replace(href, r"^.*[?&]doc=([^&]*).*$", "$1")).otherwise(href)
        return F.when(F.size(c) >= 4, F.struct(text.base_name(href).alias("name"), _plain(F.get(c, F.lit(3))).alias("type")))

    return _cells(docs, content, keep, row).select(*keep, "place", "r.name", "r.type").filter("name != ''")


def sic_codes(docs: DataFrame, content: str = "content") -> DataFrame:
    """code, office, description of the rows of exactly three cells with a numeric code."""

    def row(c: Column) -> Column:
        cell = lambda i: _plain(F.get(c, F.lit(i)))
        return F.when(F.size(c) == 3, F.struct(cell(0).try_cast("int").alias("code"), text.office_name(cell(1)).alias("office"), cell(2).alias("description")))

    return _cells(docs, content, [], row).select("r.*").filter("code is not null")
