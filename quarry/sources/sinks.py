"""Sinks: CSV, partitioned Parquet, rolled files, quarters of an index, append-only logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.operators import running
from quarry.session import BY_TASKS


def write_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    """CSV with a header; nulls are empty, arrays and structs are JSON."""
    plain = [F.to_json(c.name).alias(c.name) if c.dataType.typeName() in ("array", "map", "struct") else F.col(c.name) for c in rows.schema]
    rows.select(*plain).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def write_by(rows: DataFrame, path: str, *keys: str, mode: str = "overwrite") -> None:
    """Parquet in a folder for each key. Rows are dealt out by the keys; Spark parts what is too much for a task, so a folder has one file
    or few, and most folders one."""
    rows.hint("rebalance", *[F.col(k) for k in keys]).write.mode(mode).options(**BY_TASKS).partitionBy(*keys).parquet(path)


def write_by_letter(rows: DataFrame, path: str, symbol: str, mode: str = "overwrite") -> None:
    write_by(rows.withColumn("letter", F.upper(F.substring(symbol, 1, 1))), path, "letter", symbol, mode=mode)


def write_rolled(rows: DataFrame, path: str, records: int, mode: str = "overwrite") -> None:
    """Zstandard Parquet in files of at most so many records."""
    rows.write.mode(mode).option("compression", "zstd").option("maxRecordsPerFile", records).parquet(path)


def rolled_by_bytes(rows: DataFrame, key: str, size: Column, most: int, ties: list[Column] | None = None) -> DataFrame:
    """rows with `file`, a name: rows of a file follow each other by key (numeric), and their sizes add up to `most` at most.

    Sizes before a row, summed over all rows, say which file it is in: one begins every most - largest bytes, where largest is the
    greatest size up to half of most, so a row that reaches behind the end of its stretch still fits. Rows above half of most
    are left out of that and stand alone, numbered by themselves; only such a file can be larger, where its row is.
    """
    sized = rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0)))
    large = F.col("_size") > most // 2
    largest = sized.filter(~large).agg(F.max("_size")).first()[0] or 0
    placed = running.before(sized, key, {"_before": F.when(large, 0).otherwise(F.col("_size")), "_alone": large.cast("int")}, ties)
    name = F.when(large, F.format_string("alone-%08d", "_alone")).otherwise(F.format_string("rolled-%08d", F.floor(F.col("_before") / (most - largest))))
    return placed.withColumn("file", name).drop("_size", "_before", "_alone")


def write_rolled_by_bytes(rows: DataFrame, path: str, key: str, size: Column, most: int, ties: list[Column] | None = None, mode: str = "overwrite") -> None:
    """Zstandard Parquet: a folder file=... with one file for each name of rolled_by_bytes(), in order of key."""
    named = rolled_by_bytes(rows, key, size, most, ties).repartition("file").sortWithinPartitions("file", F.asc_nulls_first(key), *(ties or []))
    named.write.mode(mode).options(**BY_TASKS).option("compression", "zstd").partitionBy("file").parquet(path)


def write_quarters(rows: DataFrame, path: str, day: str, mode: str = "overwrite") -> None:
    """Parquet by year and quarter of a date; with mode "overwrite", only quarters that rows have are written anew."""
    parts = rows.withColumns({"year": F.year(day), "quarter": F.quarter(day)})
    salted = parts.repartition("year", "quarter", F.pmod(F.xxhash64(*rows.columns), F.lit(8)))
    salted.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("year", "quarter").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def write_texts(rows: DataFrame, path: str, key: str, content: str) -> None:
    """Raw documents with their accession numbers, as columns of Parquet."""
    rows.select(key, content).write.mode("overwrite").parquet(path)
