"""Filing histories: filters by form and items, deduplication, latest filings, as-of pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def filings(rows: DataFrame, forms: list[str], form: str = "form", date: str | None = None) -> DataFrame:
    """Rows of these forms in any case, newest first if date is given (undated last)."""
    out = rows.filter(F.upper(form).isin([f.upper() for f in forms]))
    return out.orderBy(F.desc_nulls_last(date), form) if date else out


#: Forms and their amendments that are listed together; fixed values.
FAMILIES = {
    "annual": ["10-K", "10-K/A", "10-K405", "10-K405/A"],
    "quarterly": ["10-Q"],
    "current": ["8-K"],
    "holdings": ["13F-HR"],
    "fund_holdings": ["NPORT-P"],
    "proxy": ["DEF 14A"],
    "insider": ["4", "4/A"],
    "s1": ["S-1", "S-1/A"],
    "s2": ["S-2", "S-2/A"],
    "s3": ["S-3", "S-3/A"],
    "schedule_13d": ["SC 13D", "SC 13D/A", "SCHEDULE 13D", "SCHEDULE 13D/A"],
    "schedule_13g": ["SC 13G", "SC 13G/A", "SCHEDULE 13G", "SCHEDULE 13G/A"],
    "ipo": ["S-1", "S-1/A", "F-1", "F-1/A"],
}


def family(rows: DataFrame, name: str, form: str = "form") -> DataFrame:
    return filings(rows, FAMILIES[name], form)


def first_rows(rows: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return rows.withColumn("_k", F.row_number().over(w)).filter(F.col("_k") <= n).drop("_k")


def latest(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of the greatest order of each key, by aggregation."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_b")).select(*keys, "_b.*")


def from_end(rows: DataFrame, keys: list[str], order: list[str], n: int) -> DataFrame:
    """The n-th row of each key by rising order: from the front (0 is the first) or, below zero, from the end (-1 is the last).

    From the end, it is the order turned round, so no more than the first rows of each key are kept in a task.
    """
    way, at = (F.desc, -n) if n < 0 else (F.asc, n + 1)
    w = Window.partitionBy(*keys).orderBy(*[way(c) for c in order])
    return rows.withColumn("_at", F.row_number().over(w)).filter(F.col("_at") <= at).filter(F.col("_at") == at).drop("_at")


def of_entities(rows: DataFrame, related: DataFrame, key: str, entity: str, member: str) -> DataFrame:
    """rows of all members of each entity (related: entity, member), with the entity they count for."""
    links = related.select(F.col(entity).alias("_entity"), F.col(member).alias("_member")).distinct()
    own = links.select("_entity", F.col("_entity").alias("_member")).distinct()
    return rows.join(links.union(own).distinct(), F.col(key) == F.col("_member")).drop("_member").withColumnRenamed("_entity", entity if entity not in rows.columns else f"{entity}_of")


def asof_before(left: DataFrame, right: DataFrame, keys: list[str], at: str, right_columns: list[str], ties: str) -> DataFrame:
    """left with the columns of the latest row of right of the same keys strictly before `at`; nulls without one.

    Both sides go to one sort by (keys, at): a row of left takes the last row of right above it. Rows at the same time come
    left first, so they don't pair. No join, so a key with many rows on both sides gives no more rows than it has.
    """
    carried = F.struct(F.col(ties).alias("_tie"), *[F.col(c).alias(f"_{c}") for c in right_columns]).alias("_r")
    r = right.select(*keys, at, F.lit(1).alias("_side"), carried)
    l = left.withColumn("_side", F.lit(0)).withColumn("_r", F.lit(None).cast(r.schema["_r"].dataType))  # noqa: E741
    w = Window.partitionBy(*keys).orderBy(at, "_side", "_r._tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = l.unionByName(r, allowMissingColumns=True).withColumn("_last", F.last("_r", ignorenulls=True).over(w))
    return both.filter("_side = 0").select(*left.columns, *[F.col(f"_last._{c}").alias(f"previous_{c}") for c in right_columns])


def having(rows: DataFrame, parts: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key that has a part: the newest filing with a press release, for instance."""
    return first_rows(rows.join(parts.select(*parts.columns).distinct(), parts.columns, "left_semi"), keys, order)


def not_done(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that an earlier output doesn't have."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def browse(rows: DataFrame, columns: list[str], needle: str, order: list[Column], limit: int = 0) -> DataFrame:
    """Rows with needle, in any case, in one of the columns; 0 is no limit."""
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(c), F.lit(needle.lower()))
    out = rows.filter(found).orderBy(*order)
    return out.limit(limit) if limit else out


def head(rows: DataFrame, n: int, order: list[Column]) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def tail(rows: DataFrame, n: int, order: list[str]) -> DataFrame:
    """The last n rows by rising order; the last comes first."""
    return rows.orderBy(*[F.desc(c) for c in order]).limit(n)


def spanned(rows: DataFrame, group: list[str], member: str, out: str = "members") -> DataFrame:
    """The distinct members of each group, for instance the registrants that a history spans, as a sorted list."""
    return rows.groupBy(*group).agg(F.array_sort(F.collect_set(member)).alias(out))
