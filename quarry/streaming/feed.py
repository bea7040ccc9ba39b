"""Feeds as streams: pages behind a mark, deduplicated deltas, state by key, high-water marks, paging."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quarry.sources import filings
from quarry.sources.feed_pages import FeedPages


def pages_of(spark: SparkSession, at: str, *forms_: str, **options: str) -> DataFrame:
    """Pages of a site or an archive as a stream, see quarry.sources.feed_pages."""
    spark.dataSource.register(FeedPages)
    return spark.readStream.format("feed_pages").options(at=at, forms=",".join(forms_), **options).load()


def new_entries(pages: DataFrame) -> DataFrame:
    """The entries of pages that are newer than their page's mark, and not newer than the run's, with the page's form."""
    rows = filings.feed_entries(pages, keep=["form", "since", "until"])
    return rows.filter("(since IS NULL OR updated > since) AND updated <= until").drop("since", "until")


def stream(spark: SparkSession, path: str, schema, files_per_trigger: int | None = None) -> DataFrame:
    """New Parquet files of a folder, as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def unique(entries: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Entries once each: repeats within the watermark go; entries later than it are dropped, not returned twice."""
    return entries.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).dropDuplicatesWithinWatermark(key)


#: The store of state that timers of keys need; the setting holds for queries that start after it.
STATE_STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Keys are dealt into so many buckets, whose state is one table each: calls and state accesses are counted by bucket, not by key.
BUCKETS = 512


class _Once(StatefulProcessor):
    """For each bucket of keys: when each key was first seen, and how often, until the watermark has passed it.

    Keys are texts (once_key); times are microseconds (once_at). State is a table of key, first, times as an Arrow stream.
    """

    def __init__(self, columns: list[str]):
        self.columns = columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "rows binary")

    def _load(self) -> pd.DataFrame:
        found = self.seen.get()
        if not found:
            return pd.DataFrame({"once_key": pd.Series([], dtype=object), "once_at": pd.Series([], dtype="int64"), "times": pd.Series([], dtype="int64")})
        with pa.ipc.open_stream(bytes(found[0])) as r:
            return r.read_all().to_pandas()

    def _store(self, known: pd.DataFrame) -> None:
        if not len(known):
            self.seen.clear()
            return
        rows = pa.table({"once_key": pa.array(known["once_key"], pa.string()), "once_at": pa.array(known["once_at"], pa.int64()), "times": pa.array(known["times"], pa.int64())})
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, rows.schema) as w:
            w.write_table(rows)
        self.seen.update((sink.getvalue().to_pybytes(),))

    def _timer(self, known: pd.DataFrame) -> None:
        """One timer for the key whose time is the first to pass."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if len(known):
            self.handle.registerTimer(int(known["once_at"].min()) // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        came = [b for b in rows if len(b)]
        if not came:
            return
        batch, known = pd.concat(came, ignore_index=True), self._load()
        counts = batch.groupby("once_key", sort=False).size()
        fresh = batch[~batch["once_key"].isin(known["once_key"])]
        best = fresh.sort_values(self.columns, na_position="last", kind="stable").drop_duplicates("once_key")
        if len(best):
            yield best.assign(times=pd.array([None] * len(best), "Int64"))
        known = pd.concat([known, pd.DataFrame({"once_key": best["once_key"], "once_at": best["once_at"].astype("int64"), "times": 0})], ignore_index=True)
        known["times"] += known["once_key"].map(counts).fillna(0).astype("int64")
        self._store(known)
        self._timer(known)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        known = self._load()
        # a timer of a millisecond goes off once the watermark, in whole milliseconds, has reached it
        over = known["once_at"] // 1000 <= timerValues.getCurrentWatermarkInMs()
        self._store(known[~over])
        self._timer(known[~over])
        if over.any():
            yield self.tally(known[over])

    def tally(self, gone: pd.DataFrame) -> pd.DataFrame:
        none = {c: [None] * len(gone) for c in self.columns}
        return pd.DataFrame(none | {"once_key": gone["once_key"].tolist(), "once_at": [None] * len(gone), "times": pd.array(gone["times"], "Int64")})

    def close(self) -> None:
        pass


def once(entries: DataFrame, key: list[str], at: str, late: str = "1 day") -> DataFrame:
    """Entries once each by their key, in whatever order and however often they come, and a tally when a key's state goes.

    The first batch that has a key gives its entry, the least by all columns where there are several, and null `times`. Further
    ones are counted. Once the watermark, the newest time less `late`, has passed the entry's time, later copies of it are too
    late for the stream; then its state is dropped and a row of the key and `times`, how often it came, follows, with other
    columns null. Entries later than that, and those without a time, are dropped, never given twice.
    """
    entries.sparkSession.conf.set(*STATE_STORE)
    rows = entries.withColumn(at, F.col(at).cast("timestamp")).filter(F.col(at).isNotNull()).withWatermark(at, late)
    exact = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}
    keys = F.to_json(F.struct(*key), exact)
    keyed = rows.select("*", keys.alias("once_key"), F.unix_micros(at).alias("once_at"), F.pmod(F.xxhash64(*key), F.lit(BUCKETS)).alias("once_bucket"))
    made = keyed.drop("once_bucket")
    out = keyed.groupBy("once_bucket").transformWithStateInPandas(_Once(rows.columns), made.select("*", F.lit(None).cast("long").alias("times")).schema, "append", "EventTime")
    named = F.from_json("once_key", rows.select(*key).schema, exact)
    plain = [F.when(F.col("times").isNotNull(), named[c]).otherwise(F.col(c)).alias(c) if c in key else F.col(c) for c in rows.columns]
    return out.select(*plain, "times")


def union_of(streams: list[DataFrame]) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def run_available(entries: DataFrame, sink: Callable[[DataFrame, int], None] | str, checkpoint: str) -> None:
    """Takes what there is, exactly once by the checkpoint, and ends. sink: a folder of Parquet, or a function of each batch."""
    w = entries.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    q = w.format("parquet").option("path", sink).start() if isinstance(sink, str) else w.foreachBatch(sink).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


def delta(entries: DataFrame, at: str, since=None, ties: tuple[str, ...] = ()) -> DataFrame:
    """Entries strictly newer than the mark, newest first, then by the columns ties."""
    out = entries if since is None else entries.filter(F.col(at) > F.lit(since))
    return out.orderBy(F.desc(at), *ties)


def high_water(entries: DataFrame, *keys: str, at: str) -> DataFrame:
    """The newest time, of all or of each key; of no rows, null: the old mark stays then."""
    return entries.groupBy(*keys).agg(F.max(at).alias("high_water")) if keys else entries.agg(F.max(at).alias("high_water"))


def pages(entries: DataFrame, at: str, key: str, since, page: int = 40, most: int = 25) -> DataFrame:
    """What backward paging reads: whole pages of the newest entries, until one reaches behind since, at most `most` (1 at least).

    The number of pages follows from a count of newer entries, so no page is read to find out.
    """
    newer = entries.filter(F.col(at) > F.lit(since)).count() if since is not None else page * most
    n = min(max(1, most), newer // page + 1)
    return entries.orderBy(F.desc(at), F.desc(key)).limit(n * page)
