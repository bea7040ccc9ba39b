"""Byte-level BPE by a global shuffle of distinct words.

1. split: texts are parted at each single space between two other characters. Every match of the pattern lies within one such
   part, and the matches of a part don't depend on its neighbours. A chunk of documents becomes a list of its distinct parts
   and, for each document, the sequence of their numbers: the parts exploded with their positions, held as packed integers.
2. exchange: the distinct parts of all chunks are dealt out by hash, so that a part meets only one task, which encodes it
   once: each match of the pattern separately, by merge ranks. The ids go back to the chunks.
3. reassemble: ids are joined to the positions of the chunk's documents. Decoding joins ids with the table of token bytes.

Tasks hold one chunk (CHUNK_CHARS of text unless told otherwise, or one longer document), or the distinct parts of one hash bucket. Nothing is
broadcast; the rank file is read from its path by each worker. The first step runs for both the parts and the positions,
which costs less than keeping its output; chunks are named by their content, so both runs agree.

Nulls and empty texts: no ids, empty bytes. A null doc_id stays null; repeated rows give repeated results; other columns
are not read. Lone surrogates can't occur in a Spark string.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm import common

CHUNK_CHARS = 16_000_000
BUCKETS_PER_PARTITION = 2

_loaded: dict[str, object] = {}
common.KEPT["bpe"] = _loaded.clear


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of a base64 token and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _encoder(path: str, pattern: str):
    """tiktoken's encoder of a file, and its tokens' bytes by id; loaded once in a worker."""
    common.claim("bpe")
    if path not in _loaded:
        import tiktoken

        ranks = read_ranks(path)
        made = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = (made, [t for t, _ in sorted(ranks.items(), key=lambda x: x[1])] if sorted(ranks.values()) == list(range(len(ranks))) else {r: t for t, r in ranks.items()})
    return _loaded[path]


_between = regex.compile(r"(?<=\S) (?=\S)")


def parts_of(text: str) -> list[str]:
    """The text, parted before single spaces between other characters; parts but the first lack that space."""
    parts = text.split(" ")
    for p in parts:
        if not p or p[0].isspace() or p[-1].isspace():
            return _between.split(text)
    return parts


def _pack(a: np.ndarray) -> bytes:
    """32-bit integers as four planes of bytes, compressed."""
    a = a.astype(np.uint32)
    return zstandard.ZstdCompressor(level=3).compress(np.concatenate([((a >> (8 * k)) & 255).astype(np.uint8) for k in range(4)]).tobytes())


def _unpack(b: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8).astype(np.uint32).reshape(4, -1)
    return planes[0] | planes[1] << 8 | planes[2] << 16 | planes[3] << 24


def _pack_words(words: list[bytes]) -> bytes:
    lengths = np.fromiter(map(len, words), np.uint32, len(words))
    return zstandard.ZstdCompressor(level=3).compress(np.uint32(len(words)).tobytes() + lengths.tobytes() + b"".join(words))


def _unpack_words(b: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(b)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64) + 4 + 4 * n
    begin, out = 4 + 4 * n, []
    for e in ends.tolist():
        out.append(raw[begin:e])
        begin = e
    return out


class _Chunk:
    def __init__(self):
        self.known: dict[str, int] = {}
        self.docs: list = []
        self.sequences: list[np.ndarray] = []
        self.chars, self.name = 0, xxhash.xxh3_128()

    def add(self, doc_id, text: str | None) -> None:
        known, parts = self.known, []
        if text:
            parts = parts_of(text)
            parts[0] = " " + parts[0]  # other parts don't begin with a space: it marks the first, which has none before it
            for p in set(parts).difference(known):
                known[p] = len(known)
            self.chars += len(text)
            self.name.update(text.encode("utf-8", "surrogatepass"))
        self.docs.append(doc_id)
        self.name.update(f"\0{doc_id}\0")
        self.sequences.append(np.fromiter(map(known.__getitem__, parts), np.uint32, len(parts)))


def _chunks(batches: Iterator[pa.RecordBatch], chars: int) -> Iterator[_Chunk]:
    common.claim("bpe")
    chunk = _Chunk()
    for batch in batches:
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            chunk.add(doc_id, text.as_py())
            if chunk.chars >= chars:
                yield chunk
                chunk = _Chunk()
    if chunk.docs:
        yield chunk


def _positions(chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chars):
            lengths = np.fromiter(map(len, c.sequences), np.uint32, len(c.sequences))
            yield pa.RecordBatch.from_pydict({"chunk": [c.name.digest()], "docs": pa.array([c.docs], pa.list_(pa.int64())), "lengths": [_pack(lengths)], "sequence": [_pack(np.concatenate(c.sequences))]})

    return run


def _words_of(buckets: int, chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for c in _chunks(batches, chars):
            words = [p.encode("utf-8", "surrogatepass") for p in c.known]
            if not words:
                continue
            where = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) % np.uint64(buckets)
            order = np.argsort(where, kind="stable")
            cuts = np.flatnonzero(np.diff(where[order])) + 1
            slots = np.split(order, cuts)
            yield pa.RecordBatch.from_pydict(
                {"chunk": [c.name.digest()] * len(slots), "bucket": pa.array([int(where[s[0]]) for s in slots], pa.int64()), "slots": [_pack(s) for s in slots], "words": [_pack_words([words[i] for i in s.tolist()]) for s in slots]}
            )

    return run


def _encoded(path: str, pattern: str):
    """Replaces words by ids; a word is encoded once in a partition, and its bucket is in no other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, _ = _encoder(path, pattern)
        matches, single = regex.compile(pattern).findall, encoding.encode_single_piece if hasattr(encoding, "encode_single_piece") else encoding._encode_single_piece
        known: dict[bytes, bytes] = {}
        for batch in batches:
            out = []
            for packed in batch.column(batch.schema.get_field_index("words")).to_pylist():
                words = _unpack_words(packed)
                for w in words:
                    if w not in known:
                        text = w.decode("utf-8", "surrogatepass")
                        text = text[1:] if text[0] == " " else " " + text
                        ids: list[int] = []
                        for m in matches(text):
                            ids += single(m)
                        known[w] = np.array(ids, np.uint32).tobytes()
                found = [known[w] for w in words]
                n = np.fromiter(map(len, found), np.uint32, len(found)) // 4
                out.append((_pack(n), _pack(np.frombuffer(b"".join(found), np.uint32))))
            yield pa.RecordBatch.from_pydict({"chunk": batch.column(0), "slots": batch.column(batch.schema.get_field_index("slots")), "counts": pa.array([x[0] for x in out], pa.binary()), "ids": pa.array([x[1] for x in out], pa.binary())})

    return run


class Dictionary:
    """The distinct parts of a chunk by number: their ids, as numbers and as text, and the bytes they decode to."""

    def __init__(self, replies: pa.Table, tokens):
        slots = [_unpack(x) for x in replies["slots"].to_pylist()]
        n = max((int(s.max()) + 1 for s in slots if len(s)), default=0)
        self.counts = np.zeros(n, np.int64)
        self.ids: list = [b""] * n
        for s, c, i in zip(slots, replies["counts"].to_pylist(), replies["ids"].to_pylist(), strict=True):
            counts, raw = _unpack(c), _unpack(i).tobytes()
            self.counts[s] = counts
            begin = 0
            for slot, k in zip(s.tolist(), counts.tolist(), strict=True):
                self.ids[slot] = raw[begin : begin + 4 * k]
                begin += 4 * k
        self.tokens = tokens

    def texts(self) -> list[str]:
        return [",".join(map(str, np.frombuffer(x, np.uint32).tolist())) for x in self.ids]

    def decoded(self) -> list[bytes]:
        t = self.tokens
        return [b"".join([t[i] for i in np.frombuffer(x, np.uint32).tolist()]) for x in self.ids]


def _documents(positions: pa.Table) -> Iterator[tuple[object, np.ndarray]]:
    for docs, lengths, sequence in zip(positions["docs"].to_pylist(), positions["lengths"].to_pylist(), positions["sequence"].to_pylist(), strict=True):
        seq = _unpack(sequence)
        ends = np.cumsum(_unpack(lengths), dtype=np.int64).tolist()
        begin = 0
        for doc, end in zip(docs, ends, strict=True):
            yield doc, seq[begin:end]
            begin = end


def _joined(docs: DataFrame, path: str, pattern: str, build, schema: str, chars: int) -> DataFrame:
    """docs (doc_id, text) through the three steps; build makes the result from a chunk's documents and dictionary."""
    spark = docs.sparkSession
    common.arrow_batches(spark)
    # both passes over docs must cut the same chunks
    docs = common.settled(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "bpe-docs")
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS_PER_PARTITION
    words = docs.mapInArrow(common.tidy(_words_of(buckets, chars)), "chunk binary, bucket long, slots binary, words binary")
    replies = words.repartition(buckets, "bucket").mapInArrow(common.tidy(_encoded(path, pattern)), "chunk binary, slots binary, counts binary, ids binary")
    positions = docs.mapInArrow(common.tidy(_positions(chars)), "chunk binary, docs array<long>, lengths binary, sequence binary")

    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        return build(left, Dictionary(right, _encoder(path, pattern)[1]))

    return positions.groupBy("chunk").cogroup(replies.groupBy("chunk")).applyInArrow(run, schema)


def digests(docs: DataFrame, path: str, pattern: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes decoded from the ids)."""

    def build(positions: pa.Table, words: Dictionary) -> pa.Table:
        texts, decoded = words.texts(), words.decoded()
        ids, n, a, b = [], [], [], []
        for doc, seq in _documents(positions):
            slots = seq.tolist()
            ids.append(doc)
            n.append(int(words.counts[seq].sum()))
            a.append(hashlib.sha256(",".join([texts[i] for i in slots]).encode()).hexdigest())
            b.append(hashlib.sha256(b"".join([decoded[i] for i in slots])).hexdigest())
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(a, pa.string()), "decoded_sha256": pa.array(b, pa.string())})

    return _joined(docs, path, pattern, build, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", chars)


def encode(docs: DataFrame, path: str, pattern: str, chars: int = CHUNK_CHARS) -> DataFrame:
    """doc_id, n_tokens, ids: the ids of every whole text. Chunks of fewer chars take less memory and more of the shuffle."""

    def build(positions: pa.Table, words: Dictionary) -> pa.Table:
        ids, n, values = [], [], []
        for doc, seq in _documents(positions):
            ids.append(doc)
            n.append(int(words.counts[seq].sum()))
            values.append(b"".join([words.ids[i] for i in seq.tolist()]))
        offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        flat = np.frombuffer(b"".join(values), np.uint32).astype(np.int32)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids": pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))})

    return _joined(docs, path, pattern, build, "doc_id long, n_tokens long, ids array<int>", chars)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and decoded (binary) of doc_id and ids, by the token-byte table of the rank file. Unknown ids fail."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = f"bytes of {path}"
        if key not in _loaded:
            _loaded[key] = {r: t for t, r in read_ranks(path).items()}
        t = _loaded[key]
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b.column(0), "decoded": pa.array([b"".join([t[i] for i in x or ()]) for x in b.column(1).to_pylist()], pa.binary())})

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(common.tidy(run), "doc_id long, decoded binary")
