"""Mixing sources to target weights by a low-discrepancy schedule.

The mix has as many words as the input. Sources in code-point order, null last, weigh `weights` in turn; a source's target
is its share of all words, but at most `cap` times its own words, the excess reshared by weight until none is above.

The mix is a row of slots of equal length. The golden-ratio point of a slot, laid on the cumulative targets, chooses its
source, so that every stretch of the mix is near the targets. Slots are ranked per source; the r-th slot of a source takes
the r-th block of equal length of its shuffled documents, laid end to end and repeated `cap` times. A document yields its
words in all blocks that are taken.

Slots have 16 words at every size, and a source's last block is cut at its target, so what a source gets is never above its
target and at most a few slots below it, however small its share. Points are 32-bit integers, so beyond 2^36 words they
repeat and a target is met to a 2^32nd of the mix. The shuffle orders documents by md5 of seed and id, so reruns agree.

Nulls: a null text has no words, a null source is a source of its own, a null doc_id is shuffled as an empty id. Documents
without words are never taken. Repeated rows are documents of their own. Extra columns are ignored here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common

GOLDEN = 2654435769  #: 2^32 divided by the golden ratio
SLOT = 16  #: words of a slot


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source and size of every document; only these go through shuffles."""
    return common.materialise(docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size")), "mix-sizes")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """source, source_size, target, and lo, hi: the source's range of 32-bit points.

    Sources are few; by rising cap / weight, those that get their whole cap come first, so running sums find the rest's share.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    names = Window.orderBy(F.col("source").isNull(), "source")
    w = F.array(*[F.lit(x).cast("long") for x in weights])
    per = per.withColumn("at", F.row_number().over(names)).withColumn("weight", F.element_at(w, (F.pmod(F.col("at") - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumn("most", F.col("source_size") * cap)
    rising = Window.orderBy(F.col("most") / F.col("weight"), "at")
    earlier = rising.rowsBetween(Window.unboundedPreceding, -1)
    later = rising.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    per = per.withColumn("total", F.sum("source_size").over(everything))
    left = F.col("total") - F.coalesce(F.sum("most").over(earlier), F.lit(0))
    per = per.withColumn("full", F.col("weight") * left / F.sum("weight").over(later) > F.col("most"))
    rest = F.col("total") - F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(everything)
    heavy = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(everything)
    per = per.withColumn("rest", rest).withColumn("heavy", heavy)
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("rest") / F.col("heavy"))
    so_far = names.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    capped = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0)).over(so_far)
    shared = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(so_far)
    point = F.floor((capped + F.coalesce(F.try_divide(shared * F.col("rest"), F.col("heavy")), F.lit(0.0))) / F.greatest("total", F.lit(1)) * F.lit(4294967296.0)).cast("long")
    per = per.withColumn("target", target).withColumn("hi", F.least(point, F.lit(4294967296)))
    per = per.withColumn("hi", F.when(F.col("at") == F.max("at").over(everything), F.lit(4294967296)).otherwise(F.col("hi")))
    return per.select("source", "at", "source_size", "total", "target", F.coalesce(F.lag("hi").over(names), F.lit(0)).alias("lo"), "hi")


def golden(slot: Column) -> Column:
    """The slot's golden-ratio point, as a 32-bit integer: slot * GOLDEN modulo 2^32, without overflow."""
    low, high = slot.bitwiseAND(F.lit(65535)), F.shiftright(slot, 16).bitwiseAND(F.lit(65535))
    return F.pmod(low * F.lit(GOLDEN) + F.pmod(high * F.lit(GOLDEN), F.lit(65536)) * F.lit(65536), F.lit(4294967296))


def chosen(shares: DataFrame, total: int, length: int) -> DataFrame:
    """slot, at (the source's number): the slots of the mix, each with its source.

    A point finds its source by an equi-join on its upper 8 bits: each source stands in the few bins it reaches into.
    """
    spark = shares.sparkSession
    slots = spark.range(0, -(-total // length)).select(F.col("id").alias("slot"), golden(F.col("id")).alias("point"))
    slots = slots.withColumn("bin", F.shiftright("point", 24))
    reach = shares.filter("hi > lo").select("at", "lo", "hi", F.explode(F.sequence(F.shiftright("lo", 24), F.shiftright(F.col("hi") - 1, 24))).alias("bin"))
    return slots.join(reach, "bin").filter("point >= lo and point < hi").select("slot", "at")


def schedule(shares: DataFrame, total: int, length: int) -> DataFrame:
    """slot, at, rank: the slots of the mix, each with its source and its rank among the source's slots."""
    return common.ranked(chosen(shares, total, length), ["at"], [F.col("slot")], F.shiftright("slot", 14), "rank")


def shuffled(sizes: DataFrame, shares: DataFrame, seed: int) -> DataFrame:
    """Documents with words, each at its begin on the axis of its source's shuffled words."""
    known = sizes.filter("size > 0").alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")))
    known = known.select("d.*", "s.at", "s.source_size", "s.target").withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"))))
    return common.ranked(known, ["at"], [F.col("key"), F.col("size")], F.substring("key", 1, 3), "begin", F.col("size"))


def blocks(docs: DataFrame, length: int, cap: int) -> DataFrame:
    """The pieces of documents in blocks of equal length, the last cut at the target: doc_id, at, block, first (word of the document), words."""
    turns = docs.select("*", F.explode(F.sequence(F.lit(0), F.lit(cap - 1))).alias("turn")).withColumn("lo", F.col("begin") + F.col("turn") * F.col("source_size"))
    turns = turns.withColumn("hi", F.least(F.col("lo") + F.col("size"), F.ceil("target"))).filter("hi > lo")
    pieces = turns.select("*", F.explode(F.sequence(F.floor(F.col("lo") / length), F.floor((F.col("hi") - 1) / length))).alias("block"))
    first = F.greatest(F.col("lo"), F.col("block") * length)
    last = F.least(F.col("hi"), (F.col("block") + 1) * length)
    return pieces.select("doc_id", "at", "size", "key", "turn", "block", (first - F.col("lo")).alias("first"), (last - first).alias("words"))


def mix(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """The mix itself: slot, doc_id, first, words; in slot order it is the training sequence."""
    shares, total = _plan(sizes, weights, cap)
    slots = schedule(shares, total, SLOT).withColumnRenamed("rank", "block")
    return blocks(shuffled(sizes, shares, seed), SLOT, cap).join(slots, ["at", "block"]).select("slot", "doc_id", "first", "words")


def _plan(sizes: DataFrame, weights: tuple[int, ...], cap: int) -> tuple[DataFrame, int]:
    shares = common.materialise(targets(sizes, weights, cap), "mix-targets")
    return shares, (shares.agg(F.max("total")).first() or [0])[0] or 0


def taken(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """Every document of sizes with doc_id, source, size, source_size, target, taken: how many of its words the mix takes.

    A source's slots take its words from the first on, so their count, or its target, says where it ends; no slot is ranked or joined for it.
    """
    shares, total = _plan(sizes, weights, cap)
    reach = chosen(shares, total, SLOT).groupBy("at").agg((F.count(F.lit(1)) * SLOT).alias("reach"))
    docs = shuffled(sizes, shares, seed).join(common.few(common.materialise(reach, "mix-reach")), "at", "left")
    left = F.least(F.coalesce("reach", F.lit(0)), F.ceil("target")) - F.col("begin")
    got = sum((F.greatest(F.lit(0), F.least(F.col("size"), left - F.col("source_size") * turn)) for turn in range(cap)), F.lit(0))
    empty = sizes.filter("size = 0").alias("d").join(shares.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", F.lit(0).cast("long").alias("taken"))
    return docs.select("doc_id", "source", "size", "source_size", "target", got.cast("long").alias("taken")).unionByName(empty)


def mixed_documents(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), cap: int = 3, seed: int = 7) -> DataFrame:
    """docs as the mix has them: each as often as its words are taken, to the nearest whole; those without words once.

    All columns stay, whatever their names. Null sources and ids count as equal; rows equal in id, source and size are taken alike.
    """
    sizes = sized(docs)
    got = taken(sizes, weights, cap, seed).groupBy("doc_id", "source", "size").agg(F.sum("taken").alias("_t"), F.count(F.lit(1)).alias("_n"))
    times = F.when(F.col("g.size") == 0, F.lit(1)).otherwise(F.round(F.col("g._t") / F.col("g._n") / F.col("g.size")).cast("int")).alias("times")
    keep = common.materialise(got.alias("g").select("g.doc_id", "g.source", "g.size", times).filter("times > 0"), "mix-times")
    size, copy = common.fresh(docs, "_size"), common.fresh(docs, "_copy")
    d = docs.withColumn(size, common.n_words(F.col("text")))
    cond = F.col("d.doc_id").eqNullSafe(F.col("k.doc_id")) & F.col("d.source").eqNullSafe(F.col("k.source")) & (F.col(f"d.{size}") == F.col("k.size"))
    joined = d.alias("d").join(keep.alias("k"), cond)
    return joined.select(*[F.col(f"d.{c}") for c in docs.columns], F.explode(F.sequence(F.lit(1), F.col("k.times"))).alias(copy)).drop(copy)
