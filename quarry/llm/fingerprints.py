"""Document fingerprints by a randomised edit embedding, and near duplicates by bands of them.

A text is walked by WALKS pointers that, at each step, stay or move on by a bit drawn from shared random numbers for the walk,
the step and the character it stands on (Chakraborty, Goldenberg, Koucky 2016). Two texts share the draws, so after an edit their
walks meet again, and the share of steps at which they see different characters grows with their edit distance: edit distance
becomes Hamming distance. The fingerprint samples the walks at fixed random steps: the first 32, then SAMPLES in each doubling of
the length. Each sample is a hex digit of the three characters at a pointer, 0 once its walk is over; those of all walks at
a step stand together.

When two walks meet again is chance: after an insertion of k characters it takes k^2 steps or many more. So likeness goes by
stretches of BLOCK samples, and counts in each the walk that agrees best. Stretches are weighed by the steps they stand for, and
what unrelated digits agree by chance is taken off: 1 for equal texts, near 0 for unrelated ones. Two empty texts have 1.

Near duplicates are found by bands: a band is the digits of one walk in one whole stretch, of the last STRETCHES that a text has,
so texts whose walks agree in a stretch meet. All in a band are compared with its first (verification); bands where some do not match it are
compared in blocks, but for pairs that both match it. Links of likeness 0.8 or more make groups.

Fingerprints are whole-text: every character is walked. A task holds GROUP_CHARS of text, or one longer document with the
next. Nulls: a null text is empty; a null doc_id comes last in the descending order and is in no group. Rows that share a doc_id
follow each other by text, and share the smallest group of theirs. Empty texts link with nothing. A single document is its own
next one. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quarry.llm import common
from quarry.llm.components import components

SEED, PERIOD, WALKS, FIRST, SAMPLES, LEVELS = 11, 4096, 5, 32, 24, 27
#: Samples of a stretch, of which FIRST and SAMPLES are multiples; stretches whose bands a text has; every which walk of them.
BLOCK, STRETCHES, EVERY = 8, 8, 2
GROUP_CHARS = 6_000_000
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)
#: What the best of WALKS unrelated stretches agrees by chance: the mean of the greatest of as many binomial draws.
_TAIL = np.cumsum([np.prod(np.arange(BLOCK, BLOCK - j, -1)) / np.prod(np.arange(1, j + 1)) * (1 / 15) ** j * (14 / 15) ** (BLOCK - j) for j in range(BLOCK)])
CHANCE = float((1 - _TAIL**WALKS).sum() / BLOCK)

_made: dict[str, object] = {}


def _shared() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The draws (step modulo PERIOD, walk and character class), the sampled steps in order, and the weight of each sample."""
    if "walk" not in _made:
        rng = np.random.default_rng(SEED)
        moves = rng.integers(0, 2, (PERIOD, WALKS, 256)).astype(np.uint8)
        moves[:, :, 0] = 0  # class 0 stands behind the end: there a pointer stays
        steps, weights = [np.arange(FIRST)], [np.ones(FIRST)]
        for k in range(5, 5 + LEVELS):
            n = min(SAMPLES, 1 << k)
            steps.append(np.sort(rng.choice(1 << k, n, replace=False) if k < 20 else np.unique(rng.integers(0, 1 << k, 2 * n))[:n]) + (1 << k))
            weights.append(np.full(len(steps[-1]), (1 << k) / len(steps[-1])))
        _made["walk"] = moves.reshape(PERIOD, WALKS * 256), np.concatenate(steps), np.concatenate(weights)
    return _made["walk"]


def _classes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Classes 1 to 255 of all characters with three zeros behind each text; begins; lengths."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    points = np.frombuffer("\0\0\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    classes = ((points * np.uint32(2654435761)) >> np.uint32(16)) % np.uint32(255) + np.uint32(1)
    begins = np.concatenate([[0], np.cumsum(n + 3)[:-1]]).astype(np.int64) if len(texts) else n
    classes = classes.astype(np.uint16)
    for k in range(3):
        classes[begins + n + k] = 0
    return classes, begins, n


def samples_of(texts: list[str]) -> np.ndarray:
    """A row of digits 0 to 15 for each text, WALKS for each step; rows are as long as the longest text needs, shorter texts end in zeros."""
    moves, steps, _ = _shared()
    if not texts:
        return np.zeros((0, FIRST * WALKS), np.uint8)
    classes, begins, n = _classes(texts)
    digit = np.zeros(len(classes), np.uint8)
    mixed = classes[:-2].astype(np.uint32) * np.uint32(40503) + classes[1:-1].astype(np.uint32) * np.uint32(60493) + classes[2:].astype(np.uint32) * np.uint32(37813)
    digit[:-2] = ((mixed * np.uint32(2246822519)) >> np.uint32(13)) % np.uint32(15) + np.uint32(1)
    digit[classes == 0] = 0
    order = np.argsort(-n, kind="stable")
    p, ends = np.repeat(begins[order], WALKS), np.repeat((begins + n)[order], WALKS)
    walk = np.tile(np.arange(WALKS, dtype=np.uint16) * 256, len(texts))
    out = np.zeros((len(texts), len(steps), WALKS), np.uint8)
    step, k, live, filled = 0, 0, len(texts), 0
    while live and k < len(steps):
        # up to the next sample, but look now and then for texts whose walks are all over
        stop = min(int(steps[k]), step + 256)
        q, own = p[: live * WALKS], walk[: live * WALKS]
        while step < stop:
            q += moves[step % PERIOD].take(classes.take(q) + own)
            step += 1
        if step == steps[k]:
            out[order[:live], k] = digit.take(q).reshape(live, WALKS)
            k += 1
            filled = k
        if step % 256 == 0 or step == stop:
            on = (q < ends[: live * WALKS]).reshape(live, WALKS).any(1)
            while live and not on[live - 1]:
                live -= 1
    return out[:, : max(FIRST, filled)].reshape(len(texts), -1)


def to_text(digits: np.ndarray) -> list[str]:
    """Hex digits without the zeros at the end."""
    rows = DIGITS[digits]
    return [r.tobytes().decode().rstrip("0") for r in rows]


def from_text(fingerprints: list[str]) -> np.ndarray:
    width = max(map(len, fingerprints), default=0)
    width += -width % (WALKS * BLOCK)
    raw = "".join([f.ljust(width, "0") for f in fingerprints]).encode()
    a = np.frombuffer(raw, np.uint8).reshape(len(fingerprints), width)
    return np.where(a >= 97, a - 87, a - 48).astype(np.uint8)


def packed(digits: np.ndarray) -> list[bytes]:
    """Two digits a byte, without the zeros at the end."""
    digits = np.pad(digits, ((0, 0), (0, digits.shape[1] % 2)))
    both = digits[:, 0::2] << 4 | digits[:, 1::2]
    return [r.tobytes().rstrip(b"\0") for r in both]


def unpacked(prints: list[bytes]) -> np.ndarray:
    width = max(map(len, prints), default=0)
    width += -width % (WALKS * BLOCK // 2)
    both = np.frombuffer(b"".join([f.ljust(width, b"\0") for f in prints]), np.uint8).reshape(len(prints), width)
    return np.stack([both >> 4, both & 15], 2).reshape(len(prints), 2 * width)


def _stretches(digits: np.ndarray) -> np.ndarray:
    """Rows of digits as rows, stretches, samples, walks."""
    n = -(-digits.shape[1] // (WALKS * BLOCK))
    return np.pad(digits, ((0, 0), (0, n * WALKS * BLOCK - digits.shape[1]))).reshape(len(digits), n, BLOCK, WALKS)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of the rows of a to the rows of b; of equal width."""
    if a.shape[1] == 0:
        return np.ones(len(a))
    x, y = _stretches(a), _stretches(b)
    some = (x | y) > 0
    seen = some.sum(2)
    agree = np.where(seen > 0, ((x == y) & some).sum(2) / np.maximum(seen, 1), 0.0).max(2)
    weight = (some.any(3) * _shared()[2][: x.shape[1] * BLOCK].reshape(-1, BLOCK)).sum(2)
    total = weight.sum(1)
    share = np.where(total > 0, (agree * weight).sum(1) / np.maximum(total, 1e-9), 1.0)
    return np.clip((share - CHANCE) / (1 - CHANCE), 0.0, 1.0)


def fingerprints(docs: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with a column of fingerprints; other columns pass through (out replaces a column of that name)."""

    @F.pandas_udf("string")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(to_text(samples_of([x or "" for x in s])))

    common.arrow_batches(docs.sparkSession)
    return docs.withColumn(out, of(F.col(text)))


# ---- near duplicates -------------------------------------------------------------------------------------------------

#: Fingerprints in a block of those that did not match their band's hub.
PER_BLOCK = 512


def bands_of(digits: np.ndarray) -> list[list[int]]:
    """64-bit keys of the bands of each row: of its last STRETCHES whole stretches, EVERY other walk in turn; its first where none is whole."""
    rows = _stretches(digits)
    whole = (rows > 0).all(2)  # by row, stretch and walk
    out = []
    for row, full in zip(rows, whole, strict=True):
        there = np.flatnonzero(full.any(1))
        keys = []
        for k in (there[-STRETCHES:] if len(there) else [0]):
            walks = np.flatnonzero(full[k]) if len(there) else range(WALKS)
            walks = [v for v in walks if v % EVERY == k % EVERY]
            keys += [xxhash.xxh3_64_intdigest(b"%d:%d:" % (k, v) + row[k, :, v].tobytes()) - (1 << 63) for v in walks]
        out.append(keys)
    return out


def prints_of(docs: DataFrame) -> DataFrame:
    """doc_id, node (a hash of the fingerprint), print (packed), bands of every row of docs (doc_id, text); written."""

    def of(held: list[tuple[int | None, str]]) -> pa.RecordBatch:
        digits = samples_of([t for _, t in held])
        prints = packed(digits)
        nodes = np.fromiter((xxhash.xxh3_64_intdigest(f) for f in prints), np.uint64, len(prints)).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in held], pa.int64()), pa.array(nodes), pa.array(prints, pa.binary()), pa.array(bands_of(digits), pa.list_(pa.int64()))], names=["doc_id", "node", "print", "bands"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars = [], 0
        for b in batches:  # many texts walk as fast as a few
            held += [(d, t or "") for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            chars += sum(len(t) for _, t in held[-b.num_rows :]) if b.num_rows else 0
            if chars >= GROUP_CHARS:
                yield of(held)
                held, chars = [], 0
        if held:
            yield of(held)

    common.arrow_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id long, node long, print binary, bands array<long>")
    return common.materialise(rows, "prints")


@F.pandas_udf(DoubleType())
def _alike(a: pd.Series, b: pd.Series) -> pd.Series:
    both = unpacked([*a, *b])
    return pd.Series(likeness(both[: len(a)], both[len(a) :]))


def _within(rows: list[tuple[int, bool, int, bytes]], i: int, j: int, least: float) -> Iterator[tuple[int, int, float]]:
    """Of (node, matches the hub, block, print): a forest of the pairs of blocks i and j that are alike."""
    digits, nodes = unpacked([r[3] for r in rows]), [r[0] for r in rows]
    block = np.array([r[2] for r in rows])
    root = np.where(np.array([r[1] for r in rows]), -1, np.arange(len(rows)))
    for x in range(len(rows)):
        other = (np.arange(len(rows)) > x) if i == j else (block != block[x]) & (block[x] == i)
        to = np.flatnonzero(other & (root != root[x]))
        like = likeness(np.repeat(digits[x : x + 1], len(to), 0), digits[to])
        for y, v in zip(to[like >= least].tolist(), like[like >= least].tolist(), strict=True):
            if root[x] != root[y]:
                yield nodes[x], nodes[y], v
                low, high = sorted((root[x], root[y]))
                root[root == high] = low


def links(prints: DataFrame, least: float = 0.8) -> DataFrame:
    """a, b, likeness: pairs of nodes of prints_of() that join all of likeness `least` or more in a band.

    Bands are grouped by sums for each key, never gathered, so one that a third of all texts share stands in many tasks; prints of
    texts that share no band aren't shuffled (a Bloom filter of 16 MB at most tells which).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for b in batches:
            for band, i, j, block, node, linked, f in zip(*(b.column(k).to_pylist() for k in range(7)), strict=True):
                if (band, i, j) != key:
                    yield from out(held, key)
                    key, held = (band, i, j), []
                held.append((node, linked, block, f))
        yield from out(held, key)

    def out(held: list, key: tuple | None) -> Iterator[pa.RecordBatch]:
        if held and (found := list(_within(held, key[1], key[2], least))):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found, strict=True)], names=["a", "b", "likeness"])

    spark = prints.sparkSession
    banded = prints.filter("length(print) > 0").select("node", F.explode("bands").alias("band"))
    hubs = banded.groupBy("band").agg(F.min("node").alias("hub"), F.max("node").alias("last")).filter("hub != last").drop("last")
    near = common.materialise(banded.join(hubs, "band").filter("node != hub").distinct(), "hubs")

    met = near.select("node").unionByName(near.select(F.col("hub").alias("node"))).distinct()
    filter_ = spark.sparkContext.broadcast(common.bloom(met, ["node"], _named))

    def passing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(common.bloom_has(filter_.value, _named(b.column(0).to_numpy()))))

    of = prints.select("node", "print").mapInArrow(common.tidy(passing), "node long, print binary").groupBy("node").agg(F.first("print").alias("print"))
    of = common.materialise(of, "met-prints")
    filter_.destroy()
    one, two = of.select(F.col("node").alias("hub"), F.col("print").alias("other")), of
    verified = near.select("hub", "node").distinct().join(one, "hub").join(two, "node").withColumn("likeness", _alike("other", "print"))
    verified = common.materialise(verified.select("hub", "node", "likeness").filter(F.col("likeness") >= least), "verified")

    # what does not match its hub meets all others of the band
    members = near.join(verified.withColumn("linked", F.lit(True)), ["hub", "node"], "left").select("band", "node", F.coalesce("linked", F.lit(False)).alias("linked"))
    open_ = members.groupBy("band").agg(F.min("linked").alias("all"), F.count(F.lit(1)).alias("n")).filter("not all and n > 1").select("band")
    placed = common.ranked(members.join(open_, "band"), ["band"], [F.col("linked").cast("int"), F.col("node")], F.col("linked").cast("long") * 256 + F.shiftright("node", 56) + 128, "before")
    placed = common.materialise(placed.select("band", "node", "linked", F.floor(F.col("before") / PER_BLOCK).alias("block")), "print-blocks")
    blocks = placed.groupBy("band", "block").agg(F.min("linked").alias("all"))
    other = blocks.select("band", F.col("block").alias("j"), F.col("all").alias("all_j"))
    tasks = blocks.join(other, "band").filter("block <= j and not (all and all_j)").select("band", F.col("block").alias("i"), "j", F.explode(F.array_distinct(F.array("block", "j"))).alias("block"))
    work = tasks.join(placed, ["band", "block"]).join(two, "node").select("band", "i", "j", "block", "node", "linked", "print")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    more = work.repartition(parts, "band", "i", "j").sortWithinPartitions("band", "i", "j", "block", "node").mapInArrow(common.tidy(run), "a long, b long, likeness double")
    return verified.select(F.col("hub").alias("a"), F.col("node").alias("b"), "likeness").unionByName(more).groupBy("a", "b").agg(F.max("likeness").alias("likeness"))


def _named(node: np.ndarray) -> np.ndarray:
    return node.view(np.uint64)


def near_duplicates(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, near_id: of every doc_id that isn't the smallest of its group of near duplicates, the smallest; nulls are left out."""
    prints = prints_of(docs)
    pairs = common.materialise(links(prints, least).select("a", "b"), "links")
    # a node hangs on the least it is linked to, and those it is linked to on that one: the same groups by about a link a node
    hung = pairs.groupBy("b").agg(F.min("a").alias("m"))
    between = pairs.join(hung, "b").filter("a != m").select("a", F.col("m").alias("b")).distinct()
    found = common.materialise(hung.select(F.col("m").alias("a"), "b").unionByName(between), "links")
    ids = prints.filter("doc_id is not null and length(print) > 0").groupBy("node").agg(F.min("doc_id").alias("id"))
    groups = components(found).select("node", F.col("component").alias("group"))
    whole = common.materialise(ids.join(groups, "node", "left").select("node", "id", F.coalesce("group", "node").alias("group")), "print-groups")
    least_of = whole.groupBy("group").agg(F.min("id").alias("near_id"))
    near = prints.select("doc_id", "node").filter("doc_id is not null").join(whole.join(least_of, "group").select("node", "near_id"), "node")
    out = common.materialise(near.groupBy("doc_id").agg(F.min("near_id").alias("near_id")).filter("near_id < doc_id"), "near")
    common.discard(prints)
    common.discard(pairs)
    common.discard(found)
    common.discard(whole)
    return out


def _ranges(docs: DataFrame, spark: SparkSession) -> tuple[list[int], int]:
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    return sorted(set(cuts)), n


def with_edited(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id of every document.

    near_id is the smallest doc_id of its group of near duplicates, its own if it has none; null for a null doc_id.

    The edited text has its last third replaced by the first characters of the next document in descending doc_id. Documents
    are dealt out by ranges of doc_id, one text shuffle; the first document of a range goes to the range before it too, as the
    next of its last. Only those first ids, one for each range, pass through the driver.
    """
    spark = docs.sparkSession
    common.arrow_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    near = near_duplicates(docs)
    cuts, n = _ranges(docs, spark)

    @F.pandas_udf("long")
    def bucket_of(s: pd.Series) -> pd.Series:
        known = s.notna()
        out = np.full(len(s), -1, np.int64)
        out[known] = np.searchsorted(np.array(cuts, np.int64), s[known].astype("int64"), side="left")
        return pd.Series(out)

    placed = docs.withColumn("bucket", bucket_of("doc_id"))
    heads = sorted(((r["bucket"], r["head"]) for r in docs.select("doc_id").withColumn("bucket", bucket_of("doc_id")).groupBy("bucket").agg(F.max("doc_id").alias("head")).collect()), reverse=True)
    after = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]  # the head of a range is the next one of the range above; the first's, of the last range
    known = spark.createDataFrame([x for x in after if x[0] is not None] or [(0, 0)], "head long, above long")
    if not any(x[0] is not None for x in after):
        known = known.filter("false")
    lost = next((above for head, above in after if head is None), None)
    extra = F.broadcast(known)  # a row for each range
    both = placed.join(extra, placed["doc_id"] == extra["head"], "left").withColumn("above", F.coalesce("above", F.when(F.col("doc_id").isNull(), F.lit(lost).cast("long"))))
    own = F.struct(F.col("bucket"), F.lit(0).alias("extra"))
    copies = F.when(F.col("above").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("above").alias("bucket"), F.lit(1).alias("extra"))))
    rows = both.select("doc_id", "text", F.explode(copies).alias("c")).select("c.bucket", "c.extra", "doc_id", "text")
    # the group of a document comes just before it
    rows = rows.withColumn("near_id", F.lit(None).cast("long")).unionByName(near.select(bucket_of("doc_id").alias("bucket"), F.lit(0).alias("extra"), "doc_id", F.lit(None).cast("string").alias("text"), "near_id"))
    rows = rows.repartition(n, "bucket").sortWithinPartitions("bucket", "extra", F.desc_nulls_last("doc_id"), F.col("near_id").isNull(), "text")

    def of(held: list[tuple]) -> pa.RecordBatch:
        """held: (doc_id, text, near_id), each but the last with its next one behind it."""
        texts = [h[1] for h in held]
        edited = [t[: len(t) - len(t) // 3] + u[: len(t) // 3] for t, u in zip(texts, texts[1:], strict=False)]
        digits = samples_of(texts + edited)
        m = len(edited)
        own, cut = digits[: len(texts)], digits[len(texts) :]
        return pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array([h[0] for h in held[:m]], pa.int64()),
                "n_chars": pa.array([len(t) for t in texts[:m]], pa.int64()),
                "edited_sha256": [hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited],
                "fingerprint": to_text(own[:m]),
                "edited_fingerprint": to_text(cut),
                "near_edited": likeness(own[:m], cut),
                "near_next": likeness(own[:m], own[1:]),
                "near_id": pa.array([h[2] for h in held[:m]], pa.int64()),
            }
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, chars, bucket, closed, group = [], 0, None, False, (None, None)
        for b in batches:
            for at, more, doc_id, text, near_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4).to_pylist(), strict=True):
                if at != bucket:
                    held, chars, bucket, closed = [], 0, at, False
                if near_id is not None:
                    group = doc_id, near_id
                    continue
                if closed:
                    continue
                held.append((doc_id, text.as_py() or "", group[1] if doc_id == group[0] else doc_id))
                chars += len(held[-1][1])
                closed = bool(more)
                if len(held) > 1 and (closed or chars >= GROUP_CHARS):
                    yield of(held)
                    held = held[-1:]
                    chars = len(held[0][1])

    return rows.mapInArrow(common.tidy(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, near_id long")
