"""Filter interaction audit: what each filter removes, in every order in which the filters can be applied.

A document fails a set of filters, a mask of bits. In an order of the filters it is removed by the first that it fails, so a
table of masks by orders, 32 by 120 for five filters, holds the step at which each mask goes. Rows of masks are looked up in
it, counts by part, order and step are gathered with np.bincount, overall and by label, and the partial arrays of all
tasks are summed; what is redundant, what only one filter fails and Shapley values follow from the sums.

measured() gives masks of five filters: A, few words; B, few distinct words; C, many capitals A-Z; D, a mark; E, the text of
a smaller doc_id. Identical texts have the same 128-bit hash. Texts are read once and never shuffled: E compares rows of
hashes, with the smallest doc_id of each hash, by hash and doc_id together, so a text that a third of all rows share stands
in many tasks.

Nulls: a null text is empty, a null lang is part ''; a null doc_id passes E, makes no other row fail and has no labels. Rows
that repeat a doc_id count each, and none of them is a smaller one of the other. A doc_id with several labels is good or
toxic if any of them says so. A table without rows gives none. Other columns are not read.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

NAMES = "ABCDE"
CAPITALS = bytes(range(65, 91))
CONTINUED = bytes(range(128, 192))  #: bytes of UTF-8 that don't begin a code point
MARKS = b"#$%&*|"

#: Parts that a task counts at a time; further ones are counted in arrays of their own.
PARTS = 64


def measured(docs: DataFrame, least_words: int = 200, least_distinct: int = 50, most_capitals: int = 3, marks: bytes = MARKS) -> DataFrame:
    """doc_id, part, mask of A to D, high and low (the text's hash), for each row; written, since it is read more than once."""

    def mask(text: bytes) -> int:
        words = text.split()  # bytes part at exactly the six ASCII spaces
        points = len(text.translate(None, CONTINUED))
        return (
            (len(words) < least_words)
            | (100 * len(set(words)) < least_distinct * len(words)) << 1
            | (100 * (len(text) - len(text.translate(None, CAPITALS))) > most_capitals * points) << 2
            | (len(text.translate(None, marks)) < len(text)) << 3
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, texts)), "<i8").reshape(-1, 2)
            masks = np.fromiter(map(mask, texts), np.int32, len(texts))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(masks), pa.array(hashes[:, 0]), pa.array(hashes[:, 1])], names=["doc_id", "part", "mask", "high", "low"])

    common.arrow_batches(docs.sparkSession, 2000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return common.materialise(rows.mapInArrow(common.tidy(run), "doc_id long, part string, mask int, high long, low long"), "filter-masks")


def with_repeats(rows: DataFrame, bit: int = 4) -> DataFrame:
    """rows of measured() with `bit` set in the mask where a smaller doc_id has the same hash."""
    firsts = rows.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(0)).filter("doc_id is not null")
    known = rows.filter("doc_id is not null").join(firsts, ["high", "low", "doc_id"], "left")
    return known.withColumn("mask", F.col("mask") + F.coalesce("first", F.lit(1 << bit))).drop("first").unionByName(rows.filter("doc_id is null"))


def labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """rows with booleans good (quality 1) and toxic of their doc_id."""
    any_of = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(*(F.coalesce(F.max(F.col(c) == 1), F.lit(False)).alias(as_) for c, as_ in (("quality", "good"), ("toxic", "toxic"))))
    known = rows.filter("doc_id is not null").join(any_of, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return known.unionByName(rows.filter("doc_id is null").withColumn("good", F.lit(False)).withColumn("toxic", F.lit(False)))


def orders_of(k: int) -> np.ndarray:
    """All orders of k filters, a row each."""
    return np.array(list(itertools.permutations(range(k))), np.int64).reshape(-1, k)


def first_failures(k: int) -> np.ndarray:
    """By mask and order: the step, from 0, of the first filter that fails; k if none does."""
    fails = (np.arange(1 << k)[:, None, None] >> orders_of(k)[None]) & 1
    return np.where(fails.any(2), fails.argmax(2), k)


def counted(rows: DataFrame, k: int) -> DataFrame:
    """part, pos, n: summed arrays of counts by order and step (overall, good, toxic), then by mask, of rows of part, mask, good, toxic."""
    table = first_failures(k)
    cells, masks = table.shape[1] * (k + 1), 1 << k

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.arange(table.shape[1]) * (k + 1)
        sums: dict[str, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            full = pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array([s.tolist() for s in sums.values()], pa.list_(pa.int64()))], names=["part", "counts"])
            sums.clear()
            return full

        for b in batches:
            coded = b.column(0).dictionary_encode()
            part, mask = coded.indices.to_numpy(), b.column(1).to_numpy()
            for first in range(0, len(coded.dictionary), PARTS):
                here = (part >= first) & (part < first + PARTS)
                names = coded.dictionary[first : first + PARTS].to_pylist()
                own, own_mask = part[here] - first, mask[here]
                at = own[:, None] * cells + place + table[own_mask]  # part, order and step of removal
                picked = [slice(None), *(b.column(c).to_numpy(zero_copy_only=False)[here] for c in (2, 3))]
                found = [np.bincount(at[p].ravel(), minlength=len(names) * cells).reshape(len(names), cells) for p in picked]
                found.append(np.bincount(own * masks + own_mask, minlength=len(names) * masks).reshape(len(names), masks))
                for name, counts in zip(names, np.concatenate(found, 1), strict=True):
                    sums[name] = sums[name] + counts if name in sums else counts
                if len(sums) > PARTS:
                    yield out()
        if sums:
            yield out()

    partial = rows.select("part", "mask", "good", "toxic").mapInArrow(common.tidy(run), "part string, counts array<long>")
    return partial.select("part", F.posexplode("counts").alias("pos", "n")).filter("n > 0").groupBy("part", "pos").agg(F.sum("n").alias("n"))


def interactions(rows: DataFrame, names: str = NAMES) -> DataFrame:
    """A row for each part, order of the filters and step, of rows of part, mask (bit i: filter i fails), good, toxic."""
    k, orders = len(names), orders_of(len(names))
    cells = len(orders) * (k + 1)

    def of_part(key: tuple[str], found: pd.DataFrame) -> pd.DataFrame:
        """found has a row for each count above 0, as many as the array is long at most."""
        counts = np.zeros(3 * cells + (1 << k), np.int64)
        counts[found["pos"]] = found["n"]
        removed, good, toxic = (x.reshape(-1, k + 1)[:, :k] for x in counts[: 3 * cells].reshape(3, cells))
        by_mask = counts[3 * cells :]
        fails = np.array([by_mask[(np.arange(1 << k) >> f) & 1 == 1].sum() for f in range(k)])
        alone = by_mask[1 << np.arange(k)]
        shapley = np.bincount(orders.ravel(), removed.ravel(), k).astype(np.int64)
        columns = {
            "kept": by_mask.sum() - removed.cumsum(1),
            "removed": removed,
            "redundant": fails[orders] - removed,
            "unique_fails": alone[orders],
            "good_lost": good,
            "toxic_lost": toxic,
            "shapley": shapley[orders],
        }
        out = {"part": key[0], "filter_order": np.repeat(["".join(names[f] for f in o) for o in orders], k), "step": np.tile(np.arange(1, k + 1), len(orders))}
        return pd.DataFrame(out | {c: v.ravel() for c, v in columns.items()})

    schema = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"
    return counted(rows, k).groupBy("part").applyInPandas(of_part, schema)


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The interactions of filters A to E on docs (doc_id, text, lang) with labels (doc_id, quality, toxic)."""
    return interactions(labelled(with_repeats(measured(docs)), labels))
