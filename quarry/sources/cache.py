"""A cache of answers by key: Parquet in parts by hash, newest answer wins, answers expire.

upsert() rewrites only the parts that new answers fall into; a part is read, merged and overwritten as a partition, so the others
keep their files. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

PARTS = 64
SCHEMA = "key string, content string, fetched_at timestamp, part int"
WEEK_S = 7 * 24 * 3600


def _young(max_age_s: int, now: Column | None) -> Column:
    return F.col("fetched_at") > (F.current_timestamp() if now is None else now) - F.make_dt_interval(secs=F.lit(max_age_s).cast("decimal(18,6)"))


def _all(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], SCHEMA)


def cached(spark: SparkSession, path: str, max_age_s: int = WEEK_S, now: Column | None = None) -> DataFrame:
    """key, content, fetched_at of the answers that are younger than max_age_s; of no cache, no rows."""
    return _all(spark, path).filter(_young(max_age_s, now)).drop("part")


def upsert(answers: DataFrame, path: str, parts: int = PARTS, max_age_s: int = WEEK_S, now: Column | None = None) -> None:
    """Adds answers (key, content, fetched_at): of each key the newest stays, ties by content, and what is too old goes.

    Rows without a key or a time are left out. What is kept in parts that get no answer stays as it is, expired answers too;
    cached() doesn't give those.
    """
    newest = lambda rows: rows.groupBy("key", "part").agg(F.max_by(F.struct("content", "fetched_at"), F.struct("fetched_at", "content")).alias("a")).select("key", "a.content", "a.fetched_at", "part")
    new = newest(answers.filter("key is not null and fetched_at is not null").select("key", "content", F.col("fetched_at").cast("timestamp").alias("fetched_at"), F.pmod(F.xxhash64("key"), F.lit(parts)).cast("int").alias("part")))
    touched = [r[0] for r in new.select("part").distinct().collect()]  # parts at most
    old = _all(answers.sparkSession, path).filter(F.col("part").isin(touched)).filter(_young(max_age_s, now))
    merged = newest(old.unionByName(new)).repartition("part")
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)


def through(asked: DataFrame, path: str, fetch: Callable[[DataFrame], DataFrame], key: str = "url", max_age_s: int = WEEK_S) -> DataFrame:
    """key, content, fetched_at of the keys asked for: cached ones, and those that fetch() (key to key, content) gives, which are cached too.

    fetch() is asked once for what the cache lacks; answers without content are not kept, so they are asked for again.
    """
    spark = asked.sparkSession
    wanted = asked.select(F.col(key).alias("key")).filter("key is not null").distinct()
    lacking = wanted.join(cached(spark, path, max_age_s).select("key"), "key", "left_anti")
    found = fetch(lacking.withColumnRenamed("key", key)).filter("content is not null")
    upsert(found.select(F.col(key).alias("key"), "content", F.current_timestamp().alias("fetched_at")), path, max_age_s=max_age_s)
    return wanted.join(cached(spark, path, max_age_s), "key")
