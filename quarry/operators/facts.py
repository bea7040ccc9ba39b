"""Reported facts to one row a period: latest values win tag by tag."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dates, text


def usable_facts(facts: DataFrame, fp: str = "fp", form: str = "form", fy: str = "fy", end: str = "end") -> DataFrame:
    """Observations of a period that aren't from current reports and whose fiscal year can be right.

    A full-year value can't be of a year after its period's end; an interim one may be of the next. The check takes the label as
    reported, before Q4 becomes FY, and leaves out ends without a year.
    """
    year = dates.end_year(F.col(end))
    sane = (year == 0) | F.when(F.trim(fp) == "FY", F.col(fy) <= year).otherwise(F.col(fy) <= year + 1)
    current = F.upper(F.trim(form)).isin("8-K", "8-K/A")
    return facts.filter((F.trim(F.coalesce(fp, F.lit(""))) != "") & ~F.coalesce(current, F.lit(False)) & F.coalesce(sane, F.lit(True)))


def with_fiscal_year(facts: DataFrame, fy: str = "fy", end: str = "end") -> DataFrame:
    return facts.withColumn(fy, F.coalesce(F.col(fy), dates.end_year(F.col(end))))


def latest_values(facts: DataFrame, keys: list[str], name: str, value: str, names: list[str], order: list[str], columns: list[str] | None = None) -> DataFrame:
    """One row for each key with a column for each of names: the value of the greatest `order`. One hash aggregation, no sort.

    columns, if given, are those of the key's row of the greatest order, whatever its name, from the same aggregation.
    """
    when = lambda n: F.max_by(F.when(F.col(name) == n, F.col(value)), F.when((F.col(name) == n) & F.col(value).isNotNull(), F.struct(*order)))
    best = [F.max_by(F.struct(*columns), F.struct(*order)).alias("_best")] if columns else []
    out = facts.groupBy(*keys).agg(*[when(n).alias(n) for n in names], *best)
    return out.select(*keys, *names, *[F.col(f"_best.{c}").alias(c) for c in columns]) if columns else out


def latest_rows(facts: DataFrame, keys: list[str], columns: list[str], order: list[str]) -> DataFrame:
    """For each key the columns of its row of the greatest `order`."""
    best = F.max_by(F.struct(*columns), F.struct(*order)).alias("_best")
    return facts.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_best.{c}").alias(c) for c in columns])


def numbered(rows: DataFrame, entity: list[str], order: list[Column], out: str = "canonical_order") -> DataFrame:
    w = Window.partitionBy(*entity).orderBy(*order) if entity else Window.orderBy(*order)
    return rows.withColumn(out, (F.row_number().over(w) - 1).cast("long"))


def wide_facts(facts: DataFrame, names: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Facts (cik, fact_name, value, unit, fy, fp, end, filed, form, accn) to a row for each (cik, fy, fp).

    Metadata comes first: canonical_order, fy, fp, period_end, filed, form, is_amendment, accn; then names as value::unit, and the
    columns keep of the row that metadata is of, whose greatest breaks ties.
    """
    f = usable_facts(with_fiscal_year(facts)).withColumn("fp", text.period_label(F.col("fp")))
    f = f.withColumn("value", text.value_unit(F.col("value"), F.col("unit")))
    order = ["filed", "end", "accn", "unit", "value", *keep]
    keys = ["cik", "fy", "fp"]
    out = latest_values(f, keys, "fact_name", "value", names, order, ["end", "filed", "form", "accn", *keep])
    out = out.withColumn("is_amendment", text.is_amendment(F.col("form"))).withColumn("form", text.base_form(F.col("form")))
    out = numbered(out, ["cik"], [F.desc("fy"), F.desc(dates.period_rank(F.col("fp"))), F.col("fp")])
    first = ["cik", "canonical_order", "fy", "fp", F.col("end").alias("period_end"), "filed", "form", "is_amendment", "accn"]
    return out.select(*first, *names, *keep)


def with_urls(rows: DataFrame, documents: DataFrame, key: str, url: str, fallback: Column) -> DataFrame:
    """rows with filing_url: that of documents (key, url) by key, else the fallback."""
    d = documents.groupBy(F.col(key).alias("_key")).agg(F.min(url).alias("_url"))
    return rows.join(d, F.col(key) == F.col("_key"), "left").withColumn("filing_url", F.coalesce("_url", fallback)).drop("_key", "_url")
