"""Column functions on identifiers and text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions import patterns as P


def ticker_symbol(c: Column) -> Column:
    """Trimmed and upper case, with "." and "/" as "-"."""
    return F.translate(F.upper(F.trim(c)), "./", "--")


def cik_number(c: Column) -> Column:
    """A registrant number of at most ten digits, else null."""
    return F.when(F.trim(c).rlike(r"^[0-9]{1,10}$"), F.trim(c).cast("long"))


def cik_text(c: Column) -> Column:
    return F.lpad(c.cast("string"), 10, "0")


def accession_digits(c: Column) -> Column:
    """The 18 digits of an accession number, with or without dashes; null if there aren't 18."""
    digits = F.replace(F.trim(c), F.lit("-"))
    return F.when(digits.rlike(r"^[0-9]{18}$"), digits)


def accession_dashed(c: Column) -> Column:
    d = accession_digits(c)
    return F.when(d.isNotNull(), F.concat_ws("-", F.substring(d, 1, 10), F.substring(d, 11, 2), F.substring(d, 13, 6)))


def accession_parts(c: Column) -> Column:
    """struct<cik bigint, year int, sequence int>."""
    d = accession_digits(c)
    return F.when(d.isNotNull(), F.struct(F.substring(d, 1, 10).cast("long").alias("cik"), F.substring(d, 11, 2).cast("int").alias("year"), F.substring(d, 13, 6).cast("int").alias("sequence")))


def accession_from_parts(cik: Column, year: Column, sequence: Column) -> Column:
    return F.concat_ws("-", F.lpad(cik.cast("string"), 10, "0"), F.lpad((year % 100).cast("string"), 2, "0"), F.lpad(sequence.cast("string"), 6, "0"))


def is_amendment(form: Column) -> Column:
    return F.endswith(form, F.lit("/A"))


def base_form(form: Column) -> Column:
    return F.regexp_replace(form, "/A$", "")


def period_label(fp: Column) -> Column:
    """Q4 is the full year; everything else stays as it is."""
    return F.when(F.upper(F.trim(fp)) == "Q4", F.lit("FY")).otherwise(fp)


def number_text(x: Column) -> Column:
    """The shortest decimal text of a double, without exponent."""
    return F.call_function("format_number", x, F.lit("0.#################"))


def value_unit(value: Column, unit: Column) -> Column:
    return F.concat(number_text(F.coalesce(value, F.lit(0.0))), F.lit("::"), unit)


def items(c: Column) -> Column:
    """A comma-separated list as an array of its non-empty trimmed members."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")


def after_first_space(c: Column) -> Column:
    return F.regexp_replace(c, r"^[^ ]* ", "")


def office_name(c: Column) -> Column:
    return F.regexp_replace(c, "^Office of ", "")


def snippet(c: Column, n: int = 150) -> Column:
    return F.left(F.trim(F.regexp_replace(c, r"\s+", " ")), F.lit(n))


def path_name(c: Column) -> Column:
    """A name with everything but letters, digits, dot, dash and underscore as an underscore."""
    return F.regexp_replace(c, r"[^A-Za-z0-9._-]", "_")


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def base_name(c: Column) -> Column:
    return F.substring_index(c, "/", -1)


def symbol_variants(c: Column) -> Column:
    """The spellings of a symbol with dots and with dashes, sorted and distinct."""
    return F.array_sort(F.array_distinct(F.array(c, F.replace(c, F.lit("."), F.lit("-")), F.replace(c, F.lit("-"), F.lit(".")))))


def no_tags(c: Column) -> Column:
    return F.regexp_replace(c, P.TAG, "")


def no_hidden_markup(c: Column) -> Column:
    """Without inline-XBRL headers and hidden blocks."""
    for p in P.HIDDEN:
        c = F.regexp_replace(c, p, "")
    return c


def collapse_blank_lines(c: Column) -> Column:
    """Lines without spaces at their ends, and at most one blank line in a row; none at either end."""
    c = F.regexp_replace(c, r"[ \t]+(\n|$)", "$1")
    return F.regexp_replace(F.regexp_replace(c, r"\n{3,}", "\n\n"), r"^\n+|\n+$", "")


def item_key(c: Column) -> Column:
    """The key of a report section: item_ and the designator, e.g. of "Item 1A"."""
    return F.concat(F.lit("item_"), F.lower(F.regexp_extract(F.regexp_replace(c, r"\s", ""), r"(?i)^(?:item_?)?([0-9]+[a-c]?)$", 1)))


def cleaned_report(c: Column) -> Column:
    """Report text with spaced-out item headings joined, lines of a page number gone and newlines collapsed."""
    for pattern, by in ((P.SPACED_ITEM, "$1ITEM $2$3"), (P.PAGE_NUMBER, ""), (P.BLANK_LINES, "\n\n")):
        c = F.regexp_replace(c, pattern, by)
    return c


TRANSACTIONS = {  # fixed values: codes of insider transactions
    "P": "Purchase",
    "S": "Sale",
    "A": "Award/Grant",
    "F": "Tax withholding",
    "M": "Option exercise",
    "X": "In-the-money exercise",
    "G": "Gift",
    "D": "Disposition to issuer",
    "V": "Voluntary report",
    "J": "Other",
}


def transaction(code: Column) -> Column:
    out = F.lit("Transaction")
    for k, v in TRANSACTIONS.items():
        out = F.when(code == k, F.lit(v)).otherwise(out)
    return out


def insider_role(title: Column, director: Column, owner: Column) -> Column:
    return F.when(F.coalesce(F.trim(title), F.lit("")) != "", F.trim(title)).when(director, "Director").when(owner, "10% Owner").otherwise("Insider")


def usd_short(x: Column) -> Column:
    """Dollars, with B or M from a thousand million and from one million on."""
    plain = lambda v, n: F.replace(F.format_number(v, n), F.lit(","))
    return F.concat(F.lit("$"), F.when(x >= 1e9, F.concat(plain(x / 1e9, 2), F.lit("B"))).when(x >= 1e6, F.concat(plain(x / 1e6, 2), F.lit("M"))).otherwise(plain(x, 0)))


def cut(c: Column, n: int = 45) -> Column:
    return F.left(c, F.lit(n))


# ---- documents of a filing -------------------------------------------------------------------------------------------


def is_exhibit(kind: Column) -> Column:
    return F.upper(kind).startswith("EX-")


def is_press_release(kind: Column) -> Column:
    return F.upper(kind).startswith("EX-99")


def is_certification(kind: Column) -> Column:
    return F.upper(kind).startswith("EX-31") | F.upper(kind).startswith("EX-32")


def is_auditor_consent(kind: Column) -> Column:
    return F.upper(kind).startswith("EX-23")


def is_xbrl(kind: Column) -> Column:
    return F.upper(kind).startswith("EX-101")


def is_substantive(kind: Column) -> Column:
    return is_exhibit(kind) & ~is_certification(kind) & ~is_auditor_consent(kind) & ~is_xbrl(kind)


def is_html(name: Column) -> Column:
    return F.lower(name).endswith(".htm") | F.lower(name).endswith(".html")


def is_text(name: Column) -> Column:
    return F.lower(name).endswith(".txt")


#: Extensions of documents that hold no prose; fixed values.
NOT_PROSE = ["jpg", "jpeg", "png", "gif", "pdf", "xlsx", "zip", "xsd", "xml", "js", "css"]


def is_binary(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([A-Za-z]+)$", 1)).isin(NOT_PROSE)


# ---- items of current reports ----------------------------------------------------------------------------------------


def is_earnings(items_: Column) -> Column:
    return F.coalesce(F.arrays_overlap(items_, F.array(F.lit("2.02"), F.lit("12"))), F.lit(False))


def significant_items(items_: Column) -> Column:
    return F.filter(items_, lambda i: ~i.isin("9.01", ""))


def is_mid_quarter(items_: Column, form: Column) -> Column:
    return ~is_earnings(items_) & (F.upper(form) == "8-K") & (F.size(significant_items(items_)) > 0)


def route(items_: Column, form: Column) -> Column:
    """earnings, event or other of a current report; empty for other forms."""
    return F.when(~F.upper(form).isin("8-K", "8-K/A"), "").when(is_earnings(items_), "earnings").when(is_mid_quarter(items_, form), "event").otherwise("other")


# ---- fields of feed entries ------------------------------------------------------------------------------------------


def feed_cik(href: Column) -> Column:
    return F.regexp_extract(href, P.FEED_CIK, 1).try_cast("long")


def feed_company(title: Column) -> Column:
    return F.nullif(F.regexp_extract(title, P.FEED_COMPANY, 1), F.lit(""))


def feed_filed(summary: Column) -> Column:
    return F.try_to_date(F.regexp_extract(no_tags(summary), P.FEED_FILED, 1), "yyyy-MM-dd")


def feed_items(summary: Column) -> Column:
    return F.regexp_extract_all(no_tags(summary), F.lit(P.FEED_ITEM), F.lit(1))
