"""Best-fit packing: pieces of documents go into as few sequences of a fixed room as can be, without a gap.

Only lengths matter, and there are at most `room` of them, so what is solved is their histogram, whatever the corpus. Patterns
of one, two or three lengths that fill a sequence exactly are enumerated; how often each is repeated is fitted to the
histogram by non-negative least squares, rounded so that errors don't add up, and cut to what there is; what is left,
and lengths too short for three to fill the room, is packed best fit first, longest first, many equal sequences at a time.

The plan says which ranks among the pieces of a length go where. Pieces are ranked within their length in buckets dealt out
by chance, so neither a length nor a document that a third of all rows share stands in one task. Through the driver go the
histogram and the plan (three rows a pattern, MOST_PATTERNS patterns at most, and a few rows for each length).

Documents longer than the room are cut into pieces that fill it; the last may be shorter. Nulls: a null text is empty; each row
gets its end id, so none is lost; a null doc_id stays null. Rows that share a doc_id are packed each. An empty table gives no
rows. Other columns are not read. Sequences are numbered from 0 without gaps.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common, token_files

#: Patterns of a plan at most; steps of a fit.
MOST_PATTERNS, STEPS = 20_000, 150
#: Pieces of one length that a task ranks, about.
RANKED = 500_000
PLAN = ["length", "rank", "sequences", "times", "sequence", "offset"]


def pieces(docs: DataFrame, path: str, end_id: int, room: int) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece, and chance, a number of no meaning; written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = token_files._encoder(path), np.uint32(end_id).tobytes()
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            out = []
            for doc_id, raw in zip(b.column(0).to_pylist(), encode(b.column(1).to_pylist()), strict=True):
                raw += end
                for piece, at in enumerate(range(0, len(raw), 4 * room)):
                    part = raw[at : at + 4 * room]
                    out.append((doc_id, piece, at // 4, len(part) // 4, zlib.crc32(part)))
            chance = (np.arange(row, row + len(out), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
            row += len(out)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in zip(*out, strict=True)), pa.array(chance)], names=["doc_id", "piece", "start", "length", "ids_crc32", "chance"])

    common.arrow_batches(docs.sparkSession, 1000)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), "doc_id long, piece long, start long, length long, ids_crc32 long, chance long")
    return common.materialise(rows.withColumn("piece", F.col("piece").cast("int")), "pieces")


def patterns(lengths: np.ndarray, room: int) -> np.ndarray:
    """All ways to fill the room with one, two or three of the lengths, a row each, longest first; 0 stands for none."""
    there = np.zeros(room + 1, bool)
    there[lengths] = True
    there[0] = True
    found = []
    for a in lengths[::-1].tolist():
        rest = room - a
        b = np.arange((rest + 1) // 2, min(a, rest) + 1)
        b = b[there[b] & there[rest - b]]
        found.append(np.stack([np.full(len(b), a), b, rest - b], 1))
    return np.concatenate([np.zeros((0, 3), np.int64), *found])


def fitted(ways: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Repeats of the patterns by non-negative least squares, by accelerated projected gradient.

    Errors are weighed by length, since what is left of short pieces is easily packed.
    """
    weight = np.arange(len(wanted)) / len(wanted)
    wanted = wanted * weight

    def used(x: np.ndarray) -> np.ndarray:
        return np.bincount(ways.ravel(), np.repeat(x, ways.shape[1]), len(wanted)) * weight

    def back(r: np.ndarray) -> np.ndarray:
        return (r * weight)[ways].sum(1)

    x = np.ones(len(ways))
    for _ in range(20):
        x = back(used(x))
        size = np.linalg.norm(x)
        x /= size
    x = y = np.zeros(len(ways))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0.0, y - back(used(y) - wanted) / (1.05 * size))
        if ((y - new) * (new - x)).sum() > 0:
            t = 1.0
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / after * (new - x)
        x, t = new, after
    return x


class _Plan:
    """Rows of PLAN, while lengths are used up."""

    def __init__(self, histogram: np.ndarray):
        self.left, self.rank, self.sequence = histogram.copy(), np.zeros_like(histogram), 0
        self.rows: list[tuple[int, ...]] = []

    def add(self, contents: list[tuple[int, int]], sequences: int) -> None:
        """So many sequences of (length, times) each."""
        offset = 0
        for length, times in contents:
            self.rows.append((length, int(self.rank[length]), sequences, times, self.sequence, offset))
            self.rank[length] += sequences * times
            self.left[length] -= sequences * times
            offset += length * times
        self.sequence += sequences


def _by_patterns(plan: _Plan, room: int, most: int) -> None:
    """Adds fitted and rounded patterns of `most` lengths or fewer."""
    left = plan.left
    lengths = np.flatnonzero(left[:room])
    ways = patterns(lengths[lengths > 0], room)
    ways = ways[(ways > 0).sum(1) <= most]
    if not len(ways):
        return
    wanted = left.astype(float)
    wanted[room] = 0
    x = fitted(ways, wanted)
    if len(ways) > MOST_PATTERNS:
        best = np.sort(np.argpartition(-x, MOST_PATTERNS)[:MOST_PATTERNS])
        ways = ways[best]
        x = fitted(ways, wanted)
    # errors of rounding are carried on to the next pattern, so sums of repeats stay
    repeats = np.diff(np.floor(np.cumsum(x) + 0.5), prepend=0.0).astype(np.int64)
    for way, n in zip(ways[repeats > 0].tolist(), repeats[repeats > 0].tolist(), strict=True):
        contents = [(length, way.count(length)) for length in dict.fromkeys(way) if length]
        n = min(n, *(int(left[length]) // times for length, times in contents))
        if n > 0:
            plan.add(contents, n)


def _best_fit(plan: _Plan, room: int) -> None:
    """Packs what is left: longest first, each into the open sequence of the least sufficient room, equal sequences together."""
    open_: dict[int, list[tuple[list[tuple[int, int]], int]]] = {}
    rests = np.zeros(room + 1, np.int64)  # how many entries of open_ have this room

    def put(contents: list[tuple[int, int]], sequences: int, rest: int) -> None:
        if sequences:
            open_.setdefault(rest, []).append((contents, sequences))
            rests[rest] += 1

    for length in range(room, 0, -1):
        n = int(plan.left[length])
        while n:
            fit = np.flatnonzero(rests[length:])
            rest = length + int(fit[0]) if len(fit) else room
            if len(fit):
                contents, sequences = open_[rest].pop()
                rests[rest] -= 1
            else:
                contents, sequences = [], -(-n // (room // length))
            times = rest // length
            full = min(sequences, n // times)
            put([*contents, (length, times)], full, rest - times * length)
            n -= full * times
            if full < sequences and n:
                part = min(n, times)
                put([*contents, (length, part)], 1, rest - part * length)
                n -= part
                full += 1
            if contents:
                put(contents, sequences - full, rest)
    for groups in open_.values():
        for contents, sequences in groups:
            plan.add(contents, sequences)


def planned(histogram: np.ndarray, room: int) -> np.ndarray:
    """Rows of PLAN for so many pieces of each length from 0 to room: sequences sequence.. hold `times` pieces each, from rank and offset on.

    Patterns of up to three lengths are tried, and of up to two; the plan with fewer sequences is taken.
    """
    plans = []
    for most in (3, 2):
        plan = _Plan(np.asarray(histogram, np.int64))
        if plan.left[room]:
            plan.add([(room, 1)], int(plan.left[room]))
        _by_patterns(plan, room, most)
        _best_fit(plan, room)
        plans.append(plan)
    return np.array(min(plans, key=lambda p: p.sequence).rows, np.int64).reshape(-1, len(PLAN))


def placed(rows: DataFrame, plan: np.ndarray) -> DataFrame:
    """rows of pieces() with sequence_id and offset, by their rank among those of their length."""
    n = int(plan[:, 2] @ plan[:, 3])
    buckets = max(64, n // RANKED)
    ranked = common.ranked(rows, ["length"], [F.col("chance")], F.pmod("chance", F.lit(buckets)), "rank")
    plan = plan[np.lexsort((plan[:, 1], plan[:, 0]))]
    keys = plan[:, 0] << 48 | plan[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            row = plan[np.searchsorted(keys, length << 48 | rank, side="right") - 1]
            nth = rank - row[:, 1]
            places = [row[:, 4] + nth // row[:, 3], row[:, 5] + nth % row[:, 3] * length]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), *map(pa.array, places)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def packed(docs: DataFrame, path: str, end_id: int, room: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of docs (doc_id, text)."""
    rows = pieces(docs, path, end_id, room)
    histogram = np.zeros(room + 1, np.int64)
    for length, n in rows.groupBy("length").count().collect():  # room rows at most
        histogram[length] = n
    return placed(rows, planned(histogram, room))
