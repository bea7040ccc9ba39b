"""Running sums over all rows of a table in the order of a key, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of the key at most; their sums are the only rows that meet in one task.
RANGES = 512


def ranges_of(rows: DataFrame, key: str, ranges: int = RANGES) -> Column:
    """The number of the range of a numeric key; ranges have about as many rows each. Null is in the first."""
    n = min(ranges, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = rows.agg(F.percentile_approx(F.col(key), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0]
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts or [0])))), lambda x: x < F.col(key))), F.lit(0))


def before(rows: DataFrame, key: str, amounts: dict[str, Column], ties: list[Column] | None = None) -> DataFrame:
    """rows with columns that hold the sums of amounts over all rows before, in the order of key (nulls first), then ties.

    Rows are summed for each range of the key; the sums of the ranges before, one row a range, are joined to running sums inside
    a range. A key that very many rows share stands in one range.
    """
    placed = rows.withColumns({"_range": ranges_of(rows, key)} | {f"_a_{c}": a.cast("long") for c, a in amounts.items()})
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = placed.groupBy("_range").agg(*[F.sum(f"_a_{c}").alias(f"_s_{c}") for c in amounts])
    bases = bases.select("_range", *[F.coalesce(F.sum(f"_s_{c}").over(earlier), F.lit(0)).alias(f"_b_{c}") for c in amounts])
    inside = Window.partitionBy("_range").orderBy(F.asc_nulls_first(key), *(ties or [])).rowsBetween(Window.unboundedPreceding, -1)
    numbered = placed.withColumns({f"_r_{c}": F.coalesce(F.sum(f"_a_{c}").over(inside), F.lit(0)) for c in amounts})
    out = numbered.join(F.broadcast(bases), "_range")  # RANGES rows at most
    return out.select(*rows.columns, *[(F.col(f"_r_{c}") + F.col(f"_b_{c}")).alias(c) for c in amounts])
