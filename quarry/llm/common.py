"""What the operators share: scratch tables, Arrow batch limits, numbering of rows, hashing in workers."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quarry.session import ARROW_BYTES as ARROW_BYTES
from quarry.session import arrow_batches as arrow_batches
from quarry.session import shared_folder

#: A word is a run of characters other than space and the five ASCII controls tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"

#: Lets a query's shuffle files go with its end. Else they stay until the driver collects garbage, which on a large heap is late.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder, read back: its lineage is cut, and lost executors cost nothing.

    Tables of a context stand in one folder, which goes when the driver's Python ends; discard() takes a table earlier. The
    shuffle files behind a table go once it is written.
    """
    spark = df.sparkSession
    path = f"{_scratch(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


_folders: dict[str, str] = {}


def _scratch(spark: SparkSession) -> str:
    name = spark.sparkContext.applicationId
    if name not in _folders:
        _folders[name] = f"{shared_folder(spark)}/quarry/{name}"
        atexit.register(_delete, spark, _folders[name])
    return _folders[name]


def _delete(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is not None:
        at = sc._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table that materialise() made and that nothing reads any more."""
    if path := getattr(df, "_scratch", None):
        _delete(df.sparkSession, path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """df for an operator that reads it more than once and needs the same rows in the same partitions and order each time.

    A scan of files gives that, a shuffle doesn't (an executor's loss or another order of fetching changes it): such a df is written.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()
    return materialise(df, name) if re.search("Exchange|Sample", plan) else df


def fresh(df: DataFrame | list[str] | tuple[str, ...], stem: str) -> str:
    """A column name that df, or a list of names, doesn't have."""
    taken = {c.lower() for c in getattr(df, "columns", df)}
    while stem.lower() in taken:
        stem += "_"
    return stem


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def ranked(df: DataFrame, by: list[str], order: list[Column], bucket: Column, out: str, amount: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `amount` (1 if none) over all rows of the same `by` that come before in (bucket, order).

    bucket must not decrease along the wanted order. Rows are summed per bucket, the few bucket sums are added up, and
    only then are rows numbered inside a bucket, so that no task holds all rows of a key.
    """
    amount = F.lit(1) if amount is None else amount
    b, s, base = "_bucket", "_amount", "_base"
    df = df.withColumn(b, bucket).withColumn(s, amount.cast("long"))
    same = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in [*by, b]]
    before = Window.partitionBy(*by).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    bases = df.groupBy(*by, b).agg(F.sum(s).alias(s)).withColumn(base, F.coalesce(F.sum(s).over(before), F.lit(0))).drop(s)
    inside = Window.partitionBy(*by, b).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    numbered = df.withColumn(out, F.coalesce(F.sum(s).over(inside), F.lit(0)))
    cond = same[0]
    for c in same[1:]:
        cond = cond & c
    keep = [F.col(f"l.{c}") for c in numbered.columns if c not in (out, b, s)]
    return numbered.alias("l").join(bases.alias("r"), cond).select(*keep, (F.col(f"l.{out}") + F.col(f"r.{base}")).alias(out))


#: Rows of numbers that may be broadcast, after they are counted; about 16 MB in a hash table.
MOST_BROADCAST = 250_000


def few(keys: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    """keys, a written table, marked for broadcast if it has numbers alone and its counted rows are at most `most`.

    So what is broadcast has a size known beforehand. Else Spark decides by the size of its files.
    """
    if not all(isinstance(f.dataType, NumericType) for f in keys.schema.fields):
        return keys
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


#: What empties the memory that an operator's functions keep in a worker, by a name of its own.
KEPT: dict[str, Callable[[], None]] = {}
_owner: list[str] = [""]


def claim(name: str) -> None:
    """Workers live on from one operator to the next: the first call of another empties what the others keep."""
    if _owner[0] != name:
        _owner[0] = name
        for other, empty in KEPT.items():
            if other != name:
                empty()
        give_back()


def give_back() -> None:
    """Returns free memory to the system: workers share the executor's with the JVM, and live on when their task is over."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, a function for mapInArrow, that gives back free memory at the end of its partition."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return tidied


def bloom_bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    """The bits of a Bloom filter of size bits (a power of two) that 64-bit hashes have."""
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(size - 1)) for i in range(BLOOM_PROBES)]


def bloom_has(words: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes a filter, of 64-bit words, lets pass: all that are in it and few others."""
    out = np.ones(len(h), bool)
    for bit in bloom_bits(h, len(words) * 64):
        out &= (words[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) != 0
    return out


#: Bits of a Bloom filter that goes to workers, at least and at most (16 MB); probes of a key.
LEAST_BLOOM, MOST_BLOOM, BLOOM_PROBES = 1 << 16, 1 << 27, 4


def bloom(rows: DataFrame, columns: list[str], name: Callable[..., np.ndarray]) -> np.ndarray:
    """A Bloom filter of rows by columns (of longs), which name() hashes: about 16 bits a row, MOST_BLOOM at most.

    Beyond 8 million rows it lets more others pass, so what it is for must be right without it.
    """
    size = min(MOST_BLOOM, max(LEAST_BLOOM, 1 << (16 * max(1, rows.count()) - 1).bit_length()))

    def run(batches):
        for b in batches:
            bits = np.concatenate([np.zeros(0, np.uint64), *bloom_bits(name(*(c.to_numpy() for c in b.columns)), size)])
            at = (bits >> np.uint64(6)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array((np.uint64(1) << (bits & np.uint64(63))).view(np.int64))], names=["at", "bits"])

    found = rows.select(*columns).mapInArrow(tidy(run), "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros(size // 64, np.uint64)
    words[found["at"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return words


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words. To hash a word anew is cheaper than to look it up."""
    claim("words")
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, A-Z in lower case. bytes.split() parts at exactly the six ASCII spaces of WORD."""
    return text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
