"""Column functions on dates, periods and amounts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: From this filing date on, values are in dollars; before, in thousands.
DOLLARS_SINCE = "2023-01-01"


def strict_date(c: Column) -> Column:
    """A date of the form yyyy-MM-dd, else null."""
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(c, "yyyy-MM-dd"))


def end_year(c: Column) -> Column:
    return F.coalesce(F.substring(c, 1, 4).try_cast("int"), F.lit(0))


def month_day(c: Column) -> Column:
    """MMDD as a date of the leap year 2000."""
    return F.when(c.rlike(r"^[0-9]{4}$"), F.try_to_date(F.concat(F.lit("2000"), c), "yyyyMMdd"))


def compact_stamp(c: Column) -> Column:
    """yyyyMMddHHmmss of an RFC 3339 text, in its own offset."""
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}"), F.regexp_replace(F.substring(c, 1, 19), "[-T:]", ""))


def period_rank(label: Column) -> Column:
    """1 to 4 of a period label, by the months it reaches to; 0 of others. The first pattern that fits decides."""
    u = F.upper(F.trim(label))
    quarter = F.regexp_extract(u, r"^[^Q]*Q([1-4])", 1)
    has = lambda *names: F.lit(False) if not names else _any(u, names)
    return (
        F.when(quarter != "", quarter.cast("int"))
        .when(has("FY", "ANNUAL"), 4)
        .when(has("H1", "HY1", "SA1", "S1"), 2)
        .when(has("H2", "HY2", "SA2", "S2"), 4)
        .when(has("12M"), 4)
        .when(has("9M"), 3)
        .when(has("6M"), 2)
        .when(has("3M"), 1)
        .otherwise(0)
    )


def _any(c: Column, names: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for n in names:
        out = out | F.contains(c, F.lit(n))
    return out


def first_year(c: Column) -> Column:
    """The first four digits in a row, overlapping runs included, that make a year from 1900 to 2100; else null."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(c) - 3, F.lit(1)))
    years = F.transform(starts, lambda i: F.when(F.substr(c, i, F.lit(4)).rlike("^[0-9]{4}$"), F.substr(c, i, F.lit(4)).cast("int")))
    return F.get(F.filter(years, lambda y: (y >= 1900) & (y <= 2100)), F.lit(0))


def previous_quarter(d: Column) -> Column:
    """The first day of the last completed quarter."""
    return F.to_date(F.add_months(F.trunc(d, "quarter"), -3))


def in_thousands(filed: Column, since: str = DOLLARS_SINCE) -> Column:
    return F.coalesce(filed < F.lit(since).cast("date"), F.lit(False))


def dollars(value: Column, filed: Column, since: str = DOLLARS_SINCE) -> Column:
    """A reported value in dollars, whichever unit its filing date implies; without a date, it is in dollars."""
    return F.when(in_thousands(filed, since), value * 1000).otherwise(value)


def decimal_or_zero(c: Column, kind: str = "decimal(28,8)") -> Column:
    return F.coalesce(F.trim(c).try_cast(kind), F.lit(0).cast(kind))


def decimal_not_zero(c: Column, kind: str = "decimal(28,8)") -> Column:
    return F.nullif(F.trim(c).try_cast(kind), F.lit(0).cast(kind))


def pct(part: Column, whole: Column, digits: int = 4) -> Column:
    """part in percent of whole, rounded half to even; 0 of a zero whole."""
    return F.when(whole == 0, F.lit(0)).otherwise(F.bround(F.try_divide(part, whole) * 100, digits))


def feed_day(filed: Column, updated: Column) -> Column:
    """The filing date, else the day of the update in its own offset (updated is RFC 3339 text)."""
    return F.coalesce(filed, strict_date(F.substring(updated, 1, 10)))
