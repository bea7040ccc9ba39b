"""Coverage of known names by data, and statistics of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def summary(rows: DataFrame, key: str) -> DataFrame:
    """Counts in order of the key, with their place: a row for each of a few names, such as forms."""
    return counts(rows, key).withColumn("place", F.row_number().over(Window.orderBy(key)).cast("long")).orderBy(key)


def unseen(known: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    """Known names that the data doesn't have."""
    return known.join(seen.select(key).distinct(), key, "left_anti")


def unknown(seen: DataFrame, known: DataFrame, key: str, least: int) -> DataFrame:
    """Names the data has `least` times or more that aren't known: most frequent first, then by name."""
    return counts(seen, key).filter(F.col("n") >= least).join(known.select(key).distinct(), key, "left_anti").orderBy(F.desc("n"), key)


def named_share(seen: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """n_named, n_other: distinct names of the data that are known, and that aren't."""
    names = seen.select(key).filter(F.col(key).isNotNull()).distinct().join(known.select(F.col(key).alias("_k")).distinct(), F.col(key) == F.col("_k"), "left")
    return names.agg(F.count_if(F.col("_k").isNotNull()).alias("n_named"), F.count_if(F.col("_k").isNull()).alias("n_other"))


def first_seen(rows: DataFrame, key: str, year: Column, quarter: Column, back: int | None = None) -> DataFrame:
    """key, year, quarter where a name was last seen, looking back at most `back` quarters from the newest in the data."""
    at = rows.select(key, (year * 4 + quarter - 1).alias("_q"))
    per = at.groupBy(key).agg(F.max("_q").alias("_q"))
    if back is not None:
        newest = at.agg(F.max("_q").alias("_newest"))  # one row
        per = per.join(F.broadcast(newest), F.col("_q") > F.col("_newest") - back)
    return per.select(key, F.floor(F.col("_q") / 4).cast("int").alias("year"), (F.pmod("_q", F.lit(4)) + 1).cast("int").alias("quarter"))


def column_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """column, n: how many rows have a value; one pass, then a row for each column."""
    row = rows.agg(*[F.count(c).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n")) for c in columns])).alias("x")).select("x.*")


def header_stats(files: DataFrame, header: str = "value", path: str = "path") -> DataFrame:
    """column, n: how many files have a column, from the first lines of CSV files."""
    names = F.transform(F.split(header, ","), lambda c: F.trim(F.replace(c, F.lit('"'))))
    return files.select(path, F.explode(F.array_distinct(names)).alias("column")).groupBy("column").agg(F.count(F.lit(1)).alias("n"))


def first_values(rows: DataFrame, keys: list[str], value: str, n: int, order: list[Column]) -> DataFrame:
    """The first n non-empty values of each key, and how many more it has.

    Rows are cut to n a key before the shuffle (by the window's rank limit) and counted by an aggregation of their own.
    """
    rows = rows.filter(F.trim(F.coalesce(F.col(value).cast("string"), F.lit(""))) != "")
    first = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= n)
    total = rows.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count(F.lit(1)).alias("_all"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    on = same[0]
    for c in same[1:]:
        on = on & c
    return first.join(total, on).select(*keys, "rank", value, F.greatest(F.col("_all") - n, F.lit(0)).alias("more"))


def errors(rows: DataFrame, error: str) -> DataFrame:
    return rows.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(F.coalesce(F.col(error), F.lit("")) != "").alias("n_errors"))
