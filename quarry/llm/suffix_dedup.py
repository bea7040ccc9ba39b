"""Repeated passages by a sparse suffix array.

A passage is a run of `words` words (50) or more; it is repeated if it stands anywhere else in the corpus, A-Z in lower case.
Each stretch of `words` words retains one suffix: that at its minimiser, the leftmost of the smallest hashes of K words in it.
Equal stretches retain equal suffixes, so all repeats are found from about one suffix in sixteen words.

1. retain: suffixes of a document, each with its reach: the stretches that chose it, as the numbers of words that they reach
   to its left and right. Equal suffixes of equal reach form a class, counted and named by its first place before the shuffle.
2. sort and compare: classes are sorted by their first K words, then by their whole reach; those whose neighbours differ in the
   first K words are dropped. A class of two or more is repeated over its whole reach.
3. extend: classes that share K words with another class are extended left and right as far as both agree: the stretches in
   their reach, by hash, are matched against those of the other classes of the run.
4. collect: the document's own suffixes meet their classes, and the stretches found repeated are merged into spans.

A class is compared once, however many documents have it. What steps 3 and 4 need of the texts and suffixes is chosen by a Bloom
filter of the keys wanted (16 MB at most), before any shuffle; an exact join then takes off what it passed wrongly. Hashes of 64 bits stand for words and stretches. Spans are in words
of a document; for each, the parts that stand earlier in the corpus too (by doc_id, then position) are listed as later parts.

Nulls and empty texts, and texts of fewer words, have no spans. A null doc_id comes first in the order. Each row is a document:
rows without an id, and those whose id others have too, are told apart and ordered by a hash of their text (`row`, 0 for all
others); rows equal in both are copies, numbered from 1, and all of a copy but the first stands earlier. Columns other than
doc_id and text are not read by spans().
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from quarry.llm import common

WORDS, K = 50, 20
NO_ID = -(1 << 63)
BASE = np.uint64(0x9E3779B97F4A7C15)
POSITION_BITS = np.uint64(28)
_word = re.compile(common.WORD)

_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE^i and its inverse modulo 2^64, for i below n."""
    if not _powers or len(_powers[0]) < n:
        size = max(1 << 15, 1 << n.bit_length())
        inverse = np.uint64(pow(int(BASE), -1, 1 << 64))
        _powers[:] = [np.concatenate([[np.uint64(1)], np.full(size - 1, x)]).cumprod(dtype=np.uint64) for x in (BASE, inverse)]
    return _powers[0], _powers[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)


#: Words after which the texts read so far are taken at once: arrays of one short text cost more to make than to fill.
MOST_WORDS = 50_000


class Suffixes:
    """The retained suffixes of texts that follow each other: text (its number), key (hash of K words), at, begin and n (stretches
    begin..begin+n-1 chose it), kind. counts: words of each text; at and begin are words of the suffix's own text."""

    def __init__(self, counts: np.ndarray, words: list[bytes], length: int):
        n = len(words)
        self.length = length
        if n < length:
            self.text = self.at = self.begin = self.n = self.key = self.kind = self.place = np.zeros(0, np.int64)
            return
        up, self.down = _power(n + 1)
        self.sums = np.concatenate([[np.uint64(0)], (common.word_hashes(words) * up[:n]).cumsum(dtype=np.uint64)])
        grams = self.hashes(np.arange(n - K + 1), K)
        order = (_mix(grams) >> POSITION_BITS << POSITION_BITS) | np.arange(len(grams), dtype=np.uint64)
        width, low, have = length - K + 1, order, 1
        while have * 2 <= width:
            low = np.minimum(low[:-have], low[have:])
            have *= 2
        if have < width:
            low = np.minimum(low[: len(low) - (width - have)], low[width - have :])
        chosen = (low & np.uint64((1 << int(POSITION_BITS)) - 1)).astype(np.int64)
        ends = counts.cumsum()
        text = np.repeat(np.arange(len(counts)), counts)[: len(chosen)]
        inside = np.arange(len(chosen)) + length <= ends[text]  # other stretches reach from one text into the next
        first = inside.copy()
        first[1:] &= (chosen[1:] != chosen[:-1]) | ~inside[:-1]
        self.place = np.flatnonzero(first)
        self.n = np.diff(np.concatenate([np.flatnonzero(first[inside]), [np.count_nonzero(inside)]]))
        self.text, at = text[self.place], chosen[self.place]
        self.key = _mix(grams[at]).view(np.int64)
        reach = (self.sums[self.place + self.n - 1 + length] - self.sums[self.place]) * self.down[self.place]
        shape = ((at - self.place) << 16 | self.n).astype(np.uint64)
        self.kind = _mix(reach ^ _mix(shape)).view(np.int64)
        before = (ends - counts)[self.text]
        self.at, self.begin = at - before, self.place - before

    def hashes(self, begin: np.ndarray, length: int) -> np.ndarray:
        return (self.sums[begin + length] - self.sums[begin]) * self.down[begin]

    def stretches(self, chosen: np.ndarray) -> pa.ListArray:
        """Hashes of the stretches of each of some suffixes, in order."""
        n = self.n[chosen]
        offsets = np.concatenate([[0], n.cumsum()])
        begin = np.repeat(self.place[chosen] - offsets[:-1], n) + np.arange(offsets[-1])
        return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(_mix(self.hashes(begin, self.length)).view(np.int64)))


def _suffixes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple[np.ndarray, np.ndarray, Suffixes]]:
    """Of rows doc, row, text: the suffixes of some texts at once, and the doc and row of each suffix."""

    def taken() -> tuple[np.ndarray, np.ndarray, Suffixes]:
        s = Suffixes(np.array(counts, np.int64), words, length)
        return np.array(docs, np.int64)[s.text], np.array(rows, np.int64)[s.text], s

    docs, rows, counts, words = [], [], [], []
    for b in batches:
        for doc, row, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            own = common.words_of(text.as_py())
            if len(own) < length:
                continue
            docs.append(doc)
            rows.append(row)
            counts.append(len(own))
            words += own
            if len(words) > MOST_WORDS:
                yield taken()
                docs, rows, counts, words = [], [], [], []
    if words:
        yield taken()


FIELDS = "key long, kind long, count long, doc long, row long, at long, begin long, n long"
NAMES = ["key", "kind", "count", "doc", "row", "at", "begin", "n"]
PLACED = [x for x in NAMES if x != "count"]


#: Rows of numbers that go back to Spark at once.
MOST_OUT = 20_000


def _sliced(columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    whole = pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=names)
    for at in range(0, whole.num_rows, MOST_OUT):
        yield whole.slice(at, MOST_OUT)


def _retained(length: int):
    """Suffixes of all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row, s in _suffixes(batches, length):
            yield from _sliced([s.key, s.kind, doc, row, s.at, s.begin, s.n], PLACED)

    return run


def _merged_classes(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """One row for each class among the suffixes of a stretch of rows, with their count and the first's place."""

    def out(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        a = np.concatenate(parts, axis=1)
        a = a[:, np.lexsort((a[4], a[3], a[2], a[1], a[0]))]
        first = np.flatnonzero(np.concatenate([[True], (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1])]))
        count = np.diff(np.concatenate([first, [a.shape[1]]]))
        a = a[:, first]
        return _sliced([a[0], a[1], count, *a[2:]], NAMES)

    parts, held = [], 0
    for b in batches:
        parts.append(np.stack([c.to_numpy() for c in b.columns]))
        held += b.num_rows
        if held > most:
            yield from out(parts)
            parts, held = [], 0
    if held:
        yield from out(parts)


def _name(*columns: np.ndarray) -> np.ndarray:
    """A hash of rows of longs, for Bloom filters."""
    h = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        h = _mix((h ^ c.view(np.uint64)) * BASE + np.uint64(1))
    return h


def _passing(df: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of df (of longs) that the Bloom filter of keys by the columns lets pass, as do few others."""
    words = df.sparkSession.sparkContext.broadcast(common.bloom(keys, columns, _name))
    where = [df.columns.index(c) for c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.bloom_has(words.value, _name(*(b.column(i).to_numpy() for i in where)))))

    return df.mapInArrow(common.tidy(run), df.schema)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted by key, kind, doc, row, at: merges rows of a class; drops classes alone with their key; mixed: not the key's only class."""
    run: list[list] = []  # the rows of a key that aren't out yet: at most the last class, once the key is known to be mixed
    mixed, key = False, None
    out: list[list] = []

    def end() -> None:
        if run and (mixed or run[-1][2] > 1):
            out.append([*run[-1], mixed])

    def batch() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True))
        out.clear()
        return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:8]], pa.array(columns[8], pa.bool_())], names=[*NAMES, "mixed"])

    for b in batches:
        a = np.stack([b.column(i).to_numpy() for i in range(8)], axis=1)
        # most rows are one suffix alone with its key and can't matter; of the last one in a batch, that isn't known yet
        same = a[1:, 0] == a[:-1, 0]
        alone = ~np.concatenate([[key is not None and a[0, 0] == key], same]) & np.concatenate([~same, [False]]) & (a[:, 2] == 1)
        for row in a[~alone].tolist():
            if row[0] != key:
                end()
                run, mixed, key = [row], False, row[0]
            elif row[1] == run[-1][1]:
                run[-1][2] += row[2]
            else:
                mixed = True
                end()
                run = [row]
        if len(out) > 10_000:
            yield batch()
    end()
    if out:
        yield batch()


def _stretches(length: int, documents, wanted):
    """Of (doc, row, text): key, kind, doc, row, at and hashes (of its stretches, in order) for the suffixes that a filter passes,
    in the documents that another passes."""

    def those(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.bloom_has(documents.value, _name(b.column(0).to_numpy(), b.column(1).to_numpy()))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, row, s in _suffixes(those(batches), length):
            places = np.stack([s.key, s.kind, doc, row, s.at])
            chosen = np.flatnonzero(common.bloom_has(wanted.value, _name(*places)))
            if len(chosen):
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in places[:, chosen]], s.stretches(chosen)], names=["key", "kind", "doc", "row", "at", "hashes"])

    return run


_PART = pa.struct([("begin", pa.int64()), ("end", pa.int64())])


def _runs(group: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of ranges sorted by group, then begin: where those begin that no earlier one of their group reaches, and how far each such run reaches."""
    base = group << 40  # words of a document are far fewer, so ranges of different groups never meet
    reach = np.maximum.accumulate(base + end)
    first = np.flatnonzero(np.concatenate([[True], base[1:] + begin[1:] > reach[:-1]]))
    return first, reach[np.concatenate([first[1:], [len(reach)]]) - 1] - base[first]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows doc, row, begin, end, later, sorted by doc, row and begin, to spans with their later parts."""

    def merged(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Spans (doc, row, begin, end), how many later parts each has, and these (begin, end)."""
        other = (a[0, 1:] != a[0, :-1]) | (a[1, 1:] != a[1, :-1])
        group = np.concatenate([[0], other.cumsum()])
        first, end = _runs(group, a[2], a[3])
        z = np.flatnonzero(a[4])
        if not len(z):
            return np.stack([*a[:3, first], end]), np.zeros(len(first), np.int64), np.zeros((2, 0), np.int64)
        part, reach = _runs(group[z], a[2, z], a[3, z])
        of = np.searchsorted(first, z[part], "right") - 1
        return np.stack([*a[:3, first], end]), np.bincount(of, minlength=len(first)), np.stack([a[2, z[part]], reach])

    def out(spans: np.ndarray, n: np.ndarray, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
        offsets = np.concatenate([[0], n.cumsum()]).astype(np.int32)
        later = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(x) for x in parts], fields=list(_PART)))
        whole = pa.RecordBatch.from_arrays([*[pa.array(x) for x in spans], later], names=["doc", "row", "begin_word", "end_word", "later"])
        for at in range(0, whole.num_rows, MOST_OUT):
            yield whole.slice(at, MOST_OUT)

    held = np.zeros((5, 0), np.int64)  # the last span, as the first of the next rows
    for b in batches:
        if not b.num_rows:
            continue
        rows = [*[b.column(i).to_numpy() for i in range(4)], b.column(4).to_numpy(zero_copy_only=False).astype(np.int64)]
        spans, n, parts = merged(np.concatenate([held, np.stack(rows)], axis=1))
        yield from out(spans[:, :-1], n[:-1], parts[:, : len(parts[0]) - n[-1]])
        last = np.concatenate([spans[2:, -1:], parts[:, len(parts[0]) - n[-1] :]], axis=1)
        held = np.stack([np.full(len(last[0]), spans[0, -1]), np.full(len(last[0]), spans[1, -1]), *last, np.arange(len(last[0])) > 0])
    if len(held[0]):
        yield from out(*merged(held))


def _keyed(docs: DataFrame, doc: str, row: str) -> tuple[DataFrame, DataFrame | None]:
    """docs with its documents' keys (doc, row); and doc, row, copies of those keys that several rows have, if there are any."""
    id_, mark = docs["doc_id"].cast("long"), common.fresh(docs, "_shared")
    shared = docs.filter(id_.isNotNull()).groupBy(id_.alias(mark)).count().filter("count > 1").select(mark)
    shared = common.materialise(shared, "shared-ids")
    told, alone = id_.isNull(), shared.limit(1).count() == 0
    if not alone:
        docs = docs.join(common.few(shared), id_ == F.col(mark), "left")
        told = told | F.col(mark).isNotNull()
    docs = docs.withColumn(doc, F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn(row, F.when(told, F.xxhash64("text")).otherwise(F.lit(0)).cast("long"))
    if alone and docs.filter("doc_id is null").limit(2).count() < 2:
        return docs, None
    several = docs.filter(told).groupBy(F.col(doc).alias("doc"), F.col(row).alias("row")).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    several = common.materialise(several, "copies")
    return docs.drop(mark), several if several.limit(1).count() else None


def spans(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id, begin_word, end_word (behind the last), later (parts that stand earlier in the corpus): the repeated passages of each row."""
    keyed, copies = _keyed(docs.select("doc_id", "text"), "doc", "row")
    return _spans(keyed, copies, words).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "begin_word", "end_word", "later")


def _spans(docs: DataFrame, copies: DataFrame | None, words: int) -> DataFrame:
    """doc, row, copy, begin_word, end_word, later of docs (doc, row, text)."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select("doc", "row", "text")
    suffixes = common.materialise(docs.mapInArrow(common.tidy(_retained(words)), ", ".join(f"{x} long" for x in PLACED)), "suffixes")
    sorted_ = suffixes.mapInArrow(common.tidy(_merged_classes), FIELDS).repartition(parts, "key").sortWithinPartitions("key", "kind", "doc", "row", "at")
    classes = common.materialise(sorted_.mapInArrow(common.tidy(_compared), FIELDS + ", mixed boolean"), "suffix-classes")

    # extension of classes that share K words with others: their stretches, taken from the texts once more
    one = ["key", "kind", "doc", "row", "at"]
    mixed = classes.filter("mixed").select(one)
    wanted, documents = (spark.sparkContext.broadcast(common.bloom(mixed, of, _name)) for of in (one, ["doc", "row"]))
    found = docs.mapInArrow(common.tidy(_stretches(words, documents, wanted)), ", ".join(f"{x} long" for x in one) + ", hashes array<long>")
    # false ones go; copies bring the same suffixes again
    found = common.materialise(found.join(mixed, one, "left_semi").dropDuplicates(one), "stretches")
    each_hash = found.select("key", "kind", F.struct("doc", "row", "at").alias("place"), F.posexplode("hashes").alias("i", "hash"))
    place = F.struct("doc", "row", "at")
    shared = each_hash.groupBy("key", "hash").agg(F.count(F.lit(1)).alias("c"), F.min("place").alias("first")).filter("c > 1")
    extended = each_hash.drop("place").join(shared, ["key", "hash"]).groupBy("key", "kind").agg(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), "first")).alias("shared"))

    known = classes.select("key", "kind", "count", place.alias("own")).join(extended, ["key", "kind"], "left")
    known = common.materialise(known.filter("count > 1 or shared is not null"), "repeated-suffixes")

    each = _passing(suffixes, known, ["key", "kind"]).join(known, ["key", "kind"])
    whole = F.when(F.col("count") > 1, F.array(F.struct(F.col("begin").alias("b"), (F.col("begin") + F.col("n") - 1 + words).alias("e"), (place > F.col("own")).alias("later"))))
    some = F.transform("shared", lambda x: F.struct((F.col("begin") + x["i"]).alias("b"), (F.col("begin") + x["i"] + words).alias("e"), (place > F.least(x["first"], F.col("own"))).alias("later")))
    none = F.array().cast("array<struct<b:bigint,e:bigint,later:boolean>>")
    pieces = each.select("doc", "row", F.explode(F.concat(F.coalesce(whole, none), F.coalesce(some, none))).alias("p")).select("doc", "row", "p.b", "p.e", "p.later")
    merged = pieces.repartition(parts, "doc", "row").sortWithinPartitions("doc", "row", "b", "e").mapInArrow(common.tidy(_merged), "doc long, row long, begin_word long, end_word long, later array<struct<begin:bigint,end:bigint>>")
    if copies is None:
        return merged.withColumn("copy", F.lit(1).cast("long"))
    each_copy = F.explode(F.sequence(F.lit(1).cast("long"), F.coalesce("copies", F.lit(1)).cast("long"))).alias("copy")
    merged = merged.join(common.few(copies), ["doc", "row"], "left").select("doc", "row", each_copy, "begin_word", "end_word", "later")
    all_of_it = F.array(F.struct(F.col("begin_word").alias("begin"), F.col("end_word").alias("end")))
    return merged.withColumn("later", F.when(F.col("copy") > 1, all_of_it).otherwise(F.col("later")))


def without_later(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """docs without the passages that stand earlier in the corpus; documents of which nothing is left go.

    All columns stay, whatever their names; n_chars, if there, is counted anew for the texts that change. Null and empty texts
    stay, as an empty table does; of equal rows the first stays.
    """
    doc, row, copy, cut_doc, cut_row, cut_copy, cuts = (common.fresh(docs, x) for x in ("_doc", "_row", "_copy", "_cut_doc", "_cut_row", "_cut_copy", "_cut"))
    keyed, copies = _keyed(docs, doc, row)
    cut = _spans(keyed.select(F.col(doc).alias("doc"), F.col(row).alias("row"), "text"), copies, words).filter(F.size("later") > 0)
    cut = cut.groupBy(F.col("doc").alias(cut_doc), F.col("row").alias(cut_row), F.col("copy").alias(cut_copy)).agg(F.flatten(F.collect_list("later")).alias(cuts))
    cut = common.materialise(cut, "cuts")
    numbered = keyed.withColumn(copy, F.lit(1).cast("long"))
    if copies is not None:
        ids = common.few(copies.select(F.col("doc").alias(cut_doc), F.col("row").alias(cut_row)))
        same = (F.col(doc) == F.col(cut_doc)) & (F.col(row) == F.col(cut_row))
        plain = [F.col(f.name) for f in docs.schema.fields if isinstance(f.dataType, AtomicType)]
        again = keyed.join(ids, same, "left_semi").withColumn(copy, F.row_number().over(Window.partitionBy(doc, row).orderBy(*plain)).cast("long"))
        numbered = numbered.join(ids, same, "left_anti").unionByName(again)

    def left(texts: pa.Array, cuts: pa.Array) -> pa.Array:
        return pa.array((_without(t.as_py(), c.as_py()) for t, c in zip(texts, cuts, strict=True)), pa.string())

    left.__annotations__ = {"texts": pa.Array, "cuts": pa.Array, "return": pa.Array}
    left = F.arrow_udf(left, "string")

    mine = (F.col(doc) == F.col(cut_doc)) & (F.col(row) == F.col(cut_row)) & (F.col(copy) == F.col(cut_copy))
    keys = common.few(cut.select(cut_doc, cut_row, cut_copy))  # texts without cuts need not move
    whole = numbered.join(keys, mine, "left_anti")
    changed = numbered.join(keys, mine, "left_semi").join(cut, mine).withColumn("text", left("text", cuts)).filter(F.col("text").rlike(common.WORD))
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return whole.select(docs.columns).unionByName(changed.select(docs.columns))


def _without(text: str | None, cuts) -> str | None:
    if text is None:
        return None
    at = [m.span() for m in _word.finditer(text)]
    out, last = [], 0
    for c in sorted((int(c["begin"]), int(c["end"])) for c in cuts):
        if c[0] >= len(at):
            break
        begin, end = at[c[0]][0], at[min(c[1], len(at)) - 1][1]
        out.append(text[last:begin])
        last = max(last, end)
    return "".join([*out, text[last:]]).strip()
