"""Feeds as streams over artifacts of the driver's events: pages walked back to a mark, and state by accession number."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.plans.queries import query
from quarry.plans.source_queries import ATOM, ENTRY
from quarry.session import shared_folder, table
from quarry.sources import feed_pages
from quarry.streaming import feed

_FORMS = "CASE event_type WHEN 'error' THEN '10-Q' ELSE '8-K' END"
#: The feed is read when it reaches so far, and again at its end.
_FIRST_RUN = "2024-01-20 12:30:30"


def archive_of(events: DataFrame, path: str) -> None:
    """Pages of at most feed_pages.PAGE entries of a form and an hour, newest first, as an archive."""
    form = F.expr(_FORMS)
    newest = Window.partitionBy("form", "hour").orderBy(F.desc("ts"), F.desc("event_id"))
    numbered = events.withColumns({"form": form, "hour": F.date_trunc("hour", "ts")}).withColumn("page", F.floor((F.row_number().over(newest) - 1) / feed_pages.PAGE))
    at = F.to_timestamp(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00")))
    entry = F.struct(F.col("ts"), F.col("event_id"), F.expr(ENTRY).alias("e"))
    pages = numbered.groupBy("form", "hour", "page").agg(F.unix_micros(F.max(at)).alias("newest"), F.unix_micros(F.min(at)).alias("oldest"), F.sort_array(F.collect_list(entry), asc=False).alias("e"))
    content = F.concat(F.lit(ATOM[0]), F.array_join(F.transform("e", lambda e: e["e"]), ""), F.lit(ATOM[1]))
    pages = pages.select("form", "newest", "oldest", content.alias("content"))
    # in order of time, so that a walk reads the files of its own pages alone
    pages.repartitionByRange("form", "newest").sortWithinPartitions("form", "newest").write.mode("overwrite").parquet(path)


@query(f"""WITH e AS (SELECT *, {_FORMS} AS form, date_trunc('second', ts) AS tick FROM events WHERE event_id % 11 <> 0 AND event_id % 13 <> 0),
m AS (SELECT {_FORMS} AS form, max(date_trunc('second', ts)) AS mark FROM events WHERE ts < TIMESTAMP '{_FIRST_RUN}' GROUP BY 1)
SELECT '0000000001-24-' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS accession_number, form AS form_type, CASE WHEN ts < TIMESTAMP '{_FIRST_RUN}' THEN 1 ELSE 2 END AS run
FROM e JOIN m USING (form) WHERE ts < TIMESTAMP '{_FIRST_RUN}' OR tick > mark""")
def feed_page_stream(spark: SparkSession, d: str) -> DataFrame:
    """The feed at two times, each read from the last mark on, and a restart that finds nothing new."""
    events = table(spark, d, "events")
    at = f"{shared_folder(spark)}/quarry/feed-pages-{uuid.uuid4().hex}"
    for run, there in ((1, events.filter(F.col("ts") < F.lit(_FIRST_RUN).cast("timestamp_ntz"))), (2, events), (3, None)):
        if there is not None:
            archive_of(there, f"{at}/pages")
        rows = feed.new_entries(feed.pages_of(spark, f"{at}/pages", "8-K", "10-Q"))
        rows = rows.select("accession_number", F.col("form").alias("form_type"), F.lit(run).alias("run"))
        feed.run_available(rows, f"{at}/rows", f"{at}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")


#: Entries come in files of so many days; some come a file late, some again in the next. A key's state goes after more days.
_DAYS, _LATE = 10, 12


@query(f"""WITH e AS (SELECT event_id, event_type, date_trunc('millisecond', ts) AS tick, CASE WHEN event_id % 7 = 0 THEN 3 ELSE 1 END + CASE WHEN event_id % 5 = 0 THEN 1 ELSE 0 END AS times FROM events)
SELECT event_id, event_type, CAST(NULL AS BIGINT) AS times FROM e
UNION ALL SELECT event_id, NULL, CAST(times AS BIGINT) FROM e WHERE tick < (SELECT max(tick) FROM e) - INTERVAL {_LATE} DAY""")
def feed_keyed_state(spark: SparkSession, d: str) -> DataFrame:
    """Events in shuffled files, a seventh of them three times in one, a fifth again in the next: each once, with a tally when its state goes."""
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    at = f"{shared_folder(spark)}/quarry/feed-state-{uuid.uuid4().hex}"
    file = F.expr(f"CAST(floor((unix_timestamp(ts) - unix_timestamp(TIMESTAMP '2024-01-01 00:00:00')) / (86400 * {_DAYS})) AS LONG)")
    again = F.explode(F.expr("concat(array_repeat(IF(event_id % 17 = 0, 1, 0), IF(event_id % 7 = 0, 3, 1)), IF(event_id % 5 = 0, array(1), array()))"))
    sent = events.select("*", file.alias("file"), again.alias("later")).withColumn("file", F.col("file") + F.col("later")).drop("later")
    sent.repartition(F.xxhash64("event_id", "event_type")).write.partitionBy("file").parquet(f"{at}/sent")
    for r in sent.select("file").distinct().orderBy("file").collect():  # one for each ten days
        spark.read.schema(events.schema).parquet(f"{at}/sent/file={r['file']}").write.mode("append").parquet(f"{at}/feed")
        rows = feed.once(feed.stream(spark, f"{at}/feed", events.schema), ["event_id"], "ts", f"{_LATE} days").drop("ts")
        feed.run_available(rows, f"{at}/rows", f"{at}/checkpoint")
    return spark.read.schema(rows.schema).parquet(f"{at}/rows")
