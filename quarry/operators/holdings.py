"""Portfolios: weights, positions and what changed between two snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import dates

#: A change of weight of this many percentage points or more is a change.
CHANGE = 0.10


def weighted(rows: DataFrame, portfolio: list[str], value: str, out: str = "weight_pct", digits: int = 4) -> DataFrame:
    """Each value in percent of its portfolio's sum."""
    return rows.withColumn(out, dates.pct(F.col(value).cast("double"), F.sum(value).over(Window.partitionBy(*portfolio)).cast("double"), digits))


def positions(rows: DataFrame, key: str, name: str, value: str, weight: str) -> DataFrame:
    """cusip, name, val_usd, weight of any list of holdings."""
    return rows.select(F.col(key).alias("cusip"), F.col(name).alias("name"), F.col(value).alias("val_usd"), F.col(weight).alias("weight"))


def last_of_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    best = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), F.struct(*order)).alias("_best")
    return rows.groupBy(*keys).agg(best).select(*keys, "_best.*")


def difference(old: DataFrame, new: DataFrame, keys: list[str], value: str, least: float = CHANGE, also: list[str] | None = None) -> DataFrame:
    """keys, change_type (added, removed, changed), old value, new value, delta: one full outer join by the keys.

    old must have one row for a key (see last_of_key). Keys are compared as they are; null keys equal none.
    """
    same = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    both = old.alias("o").join(new.alias("n"), on, "full")
    delta = F.col(f"n.{value}") - F.col(f"o.{value}")
    kind = F.when(F.col(f"o.{keys[-1]}").isNull(), "added").when(F.col(f"n.{keys[-1]}").isNull(), "removed").when(F.abs(delta) >= least, "changed")
    out = [F.coalesce(f"n.{k}", f"o.{k}").alias(k) for k in keys] + [F.coalesce(f"n.{c}", f"o.{c}").alias(c) for c in also or []]
    return both.select(*out, kind.alias("change_type"), F.col(f"o.{value}").alias("old_value"), F.col(f"n.{value}").alias("new_value"), delta.alias("delta")).filter("change_type is not null")


def consecutive(snapshots: DataFrame, entity: list[str], at: str, key: str, value: str, least: float = CHANGE) -> DataFrame:
    """The differences of each snapshot of an entity to the one before it; a snapshot is all rows of one `at`.

    at numbers snapshots without looking at their rows, so the join is by entity, number and key.
    """
    numbered = snapshots.select(*entity, at).distinct().withColumn("_n", F.row_number().over(Window.partitionBy(*entity).orderBy(at)))
    rows = snapshots.join(numbered, [*entity, at])
    old = rows.withColumn("_n", F.col("_n") + 1).join(numbered.select(*entity, F.col("_n"), F.col(at).alias("_next")), [*entity, "_n"])
    old = old.select(*entity, F.col("_next").alias(at), key, value)
    later = rows.filter("_n > 1").select(*entity, at, key, value)
    return difference(old, later, [*entity, at, key], value, least)


def by_value(rows: DataFrame, value: str, *ties: str) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last(value), *ties)


def by_date(rows: DataFrame, date: str, *ties: str) -> DataFrame:
    """Newest first, undated last."""
    return rows.orderBy(F.desc_nulls_last(date), *ties)


def largest_changes(changes: DataFrame) -> DataFrame:
    order: list[Column] = [F.desc_nulls_last(F.abs("delta"))]
    return changes.orderBy("change_type", *order, *[c for c in changes.columns if c not in ("change_type", "delta")])
