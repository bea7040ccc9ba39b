"""Conversation structure repair: the cheapest edits that give a conversation roles `(s?(ua)+)?`.

s, u and a are the first letters of system, user and assistant. A row may be kept, given another role, or deleted; an empty
user or assistant turn may be inserted anywhere. What has been accepted so far is one of four states: nothing, a system
turn, a user turn, an assistant turn; nothing and an assistant turn may end a conversation. In a state, a turn with a new
role and an inserted one can be of one role only, so the letters of the edits (Keep, Rerole, Delete, Insert) say all.

Rows of a conversation go through a task in order, as numbers without texts. Conversations are put into buckets by length,
each a tensor of turns by conversations: backward costs of all four states of all conversations are updated turn by turn and
stored, then the edits of all of them are traced together, at each step by the least letter among the cheapest. Then texts,
in the same order behind their conversation's letters, are read once more and hashed as they pass: no task holds the
texts of a conversation, and of its rows it holds some 60 bytes each, where the result has a letter for each in one value.

Rows come by turn, nulls first, then by role and hash of the text. Nulls: a null role or text is one space, a null
conv_id is a conversation of its own. A row without a role has no initial, fits nowhere and can't be kept. Rows that repeat
another are duplicates. A conversation without rows (each has no copies) has zeros, no edits, and the hash of nothing. An empty
table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from quarry.llm import common

#: States; what a turn with a new role and an inserted one leads to; what a kept s, u or a (1, 2, 3) leads to, or -1.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = np.array([USER, USER, ASSISTANT, USER])
KEPT = np.array([[-1, SYSTEM, USER, -1], [-1, -1, USER, -1], [-1, -1, -1, ASSISTANT], [-1, -1, USER, -1]])
ROLES = {USER: "user", ASSISTANT: "assistant"}
SPACES = " \t\n\x0b\x0c\r"

#: Rows of whole conversations that a task repairs together; cells of a tensor.
ROWS, CELLS = 50_000, 1 << 20


@dataclass(frozen=True)
class Costs:
    rerole: int = 1
    delete: int = 2
    insert: int = 5
    truncated: int = 5  #: of a truncated row that stays


def backward(initial: np.ndarray, forced: np.ndarray, cut: np.ndarray, length: np.ndarray, costs: Costs) -> np.ndarray:
    """Least costs of what follows, by turn, state and conversation; the inputs are turns by conversations."""
    never = np.int64(1) << 40

    def with_inserts(c: np.ndarray) -> np.ndarray:
        for _ in range(3):  # more in a row come back to the same state
            c = np.minimum(c, costs.insert + c[NEXT])
        return c

    turns, n = initial.shape
    out = np.empty((turns + 1, 4, n), np.int64)
    out[turns] = with_inserts(np.repeat(np.array([[0], [never], [never], [0]]), n, 1))
    for t in range(turns - 1, -1, -1):
        after, stays = out[t + 1], np.where(forced[t], never, cut[t] * costs.truncated)
        to = KEPT[:, initial[t]]
        kept = np.where(to < 0, never, np.take_along_axis(after, np.maximum(to, 0), 0))
        best = np.minimum(costs.delete + after, stays + np.minimum(kept, costs.rerole + after[NEXT]))
        out[t] = np.where(t < length, with_inserts(best), after)
    return out


def traced(cost: np.ndarray, initial: np.ndarray, forced: np.ndarray, cut: np.ndarray, length: np.ndarray, costs: Costs) -> list[str]:
    """The letters of the cheapest edits of each conversation, ties to the least in ASCII."""
    n = len(length)
    at, state, each = np.zeros(n, np.int64), np.zeros(n, np.int64), np.arange(n)
    rows = np.zeros(initial.shape[1], np.int64) if not len(initial) else None
    letters, live = [], np.ones(n, bool)
    while True:
        now = cost[at, state, each]
        live = live & ~((at == length) & ((state == START) | (state == ASSISTANT)))
        if not live.any():
            break
        more = at < length
        here = np.minimum(at, max(len(initial) - 1, 0))
        kind, must, short = (rows if rows is not None else x[here, each] for x in (initial, forced, cut))
        after = np.minimum(at + 1, cost.shape[0] - 1)
        stays = short * costs.truncated
        to = KEPT[state, kind]
        keeps = more & (must == 0) & (to >= 0) & (stays + cost[after, np.maximum(to, 0), each] == now)
        deletes = more & (costs.delete + cost[after, state, each] == now)
        inserts = costs.insert + cost[at, NEXT[state], each] == now
        letter = np.select([~live, deletes, inserts, keeps], [0, ord("D"), ord("I"), ord("K")], ord("R")).astype(np.uint8)
        letters.append(letter)
        state = np.select([letter == 0, letter == ord("D"), letter == ord("K")], [state, state, to], NEXT[state])
        at = at + ((letter != 0) & (letter != ord("I")))
    if not letters:
        return [""] * n
    return [row.tobytes().rstrip(b"\0").decode() for row in np.ascontiguousarray(np.array(letters).T)]


def repairs(begin: np.ndarray, length: np.ndarray, initial: np.ndarray, forced: np.ndarray, cut: np.ndarray, costs: Costs) -> tuple[np.ndarray, list[str]]:
    """Cost and edits of conversations, whose rows stand from begin; by buckets of like length."""
    total, audits = np.zeros(len(length), np.int64), [""] * len(length)
    bucket = np.ceil(np.log2(np.maximum(length, 1))).astype(np.int64)
    for size in np.unique(bucket):
        members = np.flatnonzero(bucket == size)
        turns = int(length[members].max())
        step = max(1, CELLS // max(turns, 1))
        for k in range(0, len(members), step):
            some = members[k : k + step]
            rows = np.arange(turns)[:, None]
            at = np.where(rows < length[some], begin[some] + rows, 0)
            inside = rows < length[some]
            tensors = [np.where(inside, x[at], 0) if len(x) else np.zeros(at.shape, np.int64) for x in (initial, forced, cut)]
            cost = backward(*tensors, length[some], costs)
            total[some] = cost[0, START]
            for i, letters in zip(some.tolist(), traced(cost, *tensors, length[some], costs), strict=True):
                audits[i] = letters
    return total, audits


def prepared(rows: DataFrame, copies: Column | None = None) -> DataFrame:
    """conv_id, turn, role, text, copies (how often a row stands; 0: not at all) and digest of the text, nulls replaced."""
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), (F.lit(1) if copies is None else copies).cast("int").alias("copies"))
    return rows.withColumn("digest", F.unhex(F.md5("text")))


ORDER = ["conv_id", "kind", "turn", "role", "digest"]


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows of a conversation in one partition, in order."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, "conv_id").sortWithinPartitions(*ORDER)


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole conversations, of ROWS rows or, where one is longer, of that one."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        rows += b.num_rows
        if rows < ROWS:
            continue
        starts = np.flatnonzero(_begins(b.column(0)))
        last = int(starts[-1]) if len(starts) else 0
        if last == 0 and (len(held) == 1 or _same(held[-2].column(0)[-1], b.column(0)[0])):
            continue
        ready = pa.Table.from_batches([*held[:-1], b.slice(0, last)])
        if ready.num_rows:
            yield ready
        held, rows = [b.slice(last)], b.num_rows - last
    if held:
        yield pa.Table.from_batches(held)


def _same(a: pa.Scalar, b: pa.Scalar) -> bool:
    return a.as_py() == b.as_py()


def _begins(conv: pa.Array) -> np.ndarray:
    """Where a value differs from the one before it; not at the first."""
    if isinstance(conv, pa.ChunkedArray):
        conv = conv.combine_chunks()
    codes = conv.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return np.concatenate([[False], codes[1:] != codes[:-1]])


def summaries(rows: DataFrame, costs: Costs) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation, of rows of prepared()."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    small = rows.select(
        "conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "copies",
        (trimmed == "").alias("blank"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
    )

    def of(t: pa.Table) -> pa.RecordBatch:
        first = _begins(t["conv_id"])
        first[:1] = True
        names = t["conv_id"].take(pa.array(np.flatnonzero(first)))
        conv = np.cumsum(first) - 1
        copies = t["copies"].to_numpy()
        row = np.repeat(np.arange(len(copies)), copies)
        conv, n = conv[row], len(names)
        length = np.bincount(conv, minlength=n)
        begin = np.cumsum(length) - length
        roles = t["role"].combine_chunks().dictionary_encode()
        initials = np.array([" sua".find(r[:1]) if r[:1] in ("s", "u", "a") else 0 for r in roles.dictionary.to_pylist()], np.int64)
        role = roles.indices.to_numpy()[row]
        initial = initials[role] if len(initials) else role
        digest = np.frombuffer(b"".join(t["digest"].to_pylist()), "<i8").reshape(-1, 2)[row]
        blank = t["blank"].to_numpy()[row]
        # the first of equal rows is not a duplicate: the sort is stable
        order = np.lexsort((digest[:, 0], digest[:, 1], role, conv))
        keys = np.stack([conv, role, digest[:, 0], digest[:, 1]])[:, order]
        again = np.zeros(len(row), bool)
        again[order[1:]] = (keys[:, 1:] == keys[:, :-1]).all(0)
        again &= ~blank
        cut = t["cut"].to_numpy()[row] & ~blank & ~again
        sum_of = lambda x: np.bincount(conv, x, n).astype(np.int64)
        follows = np.zeros(len(row), bool)
        follows[1:] = conv[1:] == conv[:-1]
        legal = np.zeros(len(row), bool)
        legal[1:] = ((initial[1:] == 2) & (initial[:-1] == 1)) | ((initial[1:] == 3) & (initial[:-1] == 2)) | ((initial[1:] == 2) & (initial[:-1] == 3))
        turn, known = pc.fill_null(t["turn"], 0).to_numpy()[row], t["turn"].is_valid().to_numpy()[row]
        fresh = known.copy()
        fresh[1:] &= ~(follows[1:] & known[:-1] & (turn[1:] == turn[:-1]))
        distinct, low, high = sum_of(fresh), np.full(n, np.iinfo(np.int64).max), np.full(n, np.iinfo(np.int64).min)
        np.minimum.at(low, conv[known], turn[known])
        np.maximum.at(high, conv[known], turn[known])
        gaps = np.where(distinct > 0, high - low + 1 - distinct, 0)
        cost, audit = repairs(begin, length, initial, (blank | again).astype(np.int64), cut.astype(np.int64), costs)
        values = [gaps, sum_of(blank), sum_of(again), sum_of(cut), sum_of(follows & ~legal), cost]
        return pa.RecordBatch.from_arrays([names.combine_chunks(), *(pa.array(v, pa.int64()) for v in values), pa.array(audit, pa.string())], names=["conv_id", *COUNTS, "audit"])

    kind = small.schema["conv_id"].dataType.simpleString()
    return _dealt(small).mapInArrow(common.tidy(lambda batches: map(of, _whole(batches))), f"conv_id {kind}, {', '.join(f'{c} long' for c in COUNTS)}, audit string")


COUNTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


class _Replay:
    """Follows the letters of a conversation while its rows pass, and gives the lines of the repaired one."""

    def __init__(self, audit: str):
        self.letters, self.at, self.state = audit, 0, START

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.letters[self.at : self.at + 1] == "I":
            self.at, self.state = self.at + 1, int(NEXT[self.state])
            yield ROLES[self.state], ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self.inserted()
        letter = self.letters[self.at]
        self.at += 1
        if letter == "K":
            self.state = int(KEPT[self.state, " sua".find(role[:1])])
            yield role, text
        elif letter == "R":
            self.state = int(NEXT[self.state])
            yield ROLES[self.state], text


def _replayed(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Rows of prepared() behind the summary of their conversation: columns of ORDER, text, copies, and those of a summary."""
    void = {c: F.lit(None).cast("long" if c in (*COUNTS, "turn") else "binary" if c == "digest" else "int" if c == "copies" else "string") for c in (*COUNTS, "audit", "turn", "role", "digest", "text", "copies")}
    heads = found.select("conv_id", F.lit(0).alias("kind"), *COUNTS, "audit", *(void[c].alias(c) for c in ("turn", "role", "digest", "text", "copies")))
    bodies = rows.filter("copies > 0").select("conv_id", F.lit(1).alias("kind"), *(void[c].alias(c) for c in (*COUNTS, "audit")), "turn", "role", "digest", "text", "copies")
    return _dealt(heads.unionByName(bodies)).select("conv_id", "kind", *COUNTS, "audit", "role", "text", "copies")


def _passed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple | None, tuple[str, str] | None]]:
    """Of rows of _replayed(): the summary of each conversation, then the turns of the repaired one."""
    replay = None
    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("conv_id", "kind", *COUNTS, "audit", "role", "text", "copies")]
        for conv, is_row, *counts, audit, role, text, often in zip(*columns, strict=True):
            if is_row:
                for _ in range(often):
                    yield from ((None, turn) for turn in replay.row(role, text))
                continue
            if replay:
                yield from ((None, turn) for turn in replay.inserted())
            replay = _Replay(audit)
            yield (conv, *counts, audit), None
    if replay:
        yield from ((None, turn) for turn in replay.inserted())


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _schema(rows: DataFrame, *more: tuple[str, pa.DataType]) -> pa.Schema:
    return pa.schema([("conv_id", to_arrow_type(rows.schema["conv_id"].dataType)), *more])


def repaired(rows: DataFrame, copies: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """conv_id, place, role, text: the turns of the repaired conversations of rows (conv_id, turn, role, text), placed from 0."""
    rows = prepared(rows, copies)
    schema = _schema(rows, ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, place, size, done = None, 0, 0, []
        for head, turn in _passed(batches):
            if head:
                conv, place = head[0], 0
                continue
            done.append((conv, place, *turn))
            place, size = place + 1, size + len(turn[1])
            if len(done) >= 1000 or size >= common.ARROW_BYTES:
                yield _arrow(done, schema)
                size, done = 0, []
        if done:
            yield _arrow(done, schema)

    return _replayed(rows, summaries(rows, costs)).mapInArrow(common.tidy(run), from_arrow_schema(schema))


def audited(rows: DataFrame, copies: Column | None = None, costs: Costs = Costs()) -> DataFrame:
    """conv_id, counts of faults, cost and letters of the edits, and the hash of the repaired `role:text` lines."""
    rows = prepared(rows, copies)
    schema = _schema(rows, *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, lines, digest, done = None, 0, hashlib.sha256(), []
        for head, turn in _passed(batches):
            if turn:
                digest.update(f"{chr(10) if lines else ''}{turn[0]}:{turn[1]}".encode("utf-8", "surrogatepass"))
                lines += 1
                continue
            if last:
                done.append((*last, digest.hexdigest()))
            if len(done) >= 1000:
                yield _arrow(done, schema)
                done = []
            last, lines, digest = head, 0, hashlib.sha256()
        if last:
            yield _arrow([*done, (*last, digest.hexdigest())], schema)

    return _replayed(rows, summaries(rows, costs)).mapInArrow(common.tidy(run), from_arrow_schema(schema))


def damaged(rows: DataFrame) -> DataFrame:
    """rows (conv_id, turn, role, text) with faults by crc32(`conv_id:turn`) % 20, nulls as one space: conv_id, turn, role, text, copies.

    0: no copy stays; 1: no text; 2: no `.`, `!`, `?`; 3: two copies; 4: role user.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat_ws(":", text("conv_id"), text("turn")).cast("binary")) % 20
    rows = rows.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), fate.alias("fate"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1).alias("copies"),
    )
