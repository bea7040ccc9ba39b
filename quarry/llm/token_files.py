"""Token files: ids of documents in independent zstandard frames with a trailing seek table and a checksum for each frame.

A file holds the ids of documents in ascending doc_id order. It follows the public seekable layout of zstandard:
    frames     each: documents' ids, valid flags, counts, then token ids; about FRAME_TOKENS tokens, or one longer document
    index      a skippable frame: for each frame its first and last doc_id, its documents and its tokens
    seek table a skippable frame: compressed size, size and checksum of each frame; number of frames, flags, magic number
A reader fetches the end of a file, then only the frames that hold the documents it is asked for.

Documents are encoded where they are read, dealt out by ranges of doc_id and written by one task for each range, under a
name of the attempt that is renamed when complete, so a lost executor or a second attempt leaves no torn file. Words
between white space are encoded once in a worker as long as its bounded memory keeps them; the ids are those of whole texts,
since neither the normaliser nor the pre-tokeniser looks across white space.

Nulls: a null text is empty and still gets its end id; null doc_ids come first. Rows that share a doc_id are ordered by
their ids. An empty table gives no file. Other columns are not read.
"""

from __future__ import annotations

import re
import string
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm import common
from quarry.session import shared_folder

FRAME_TOKENS = 1 << 16
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
INDEX = np.dtype([("first", "<i8"), ("last", "<i8"), ("docs", "<u4"), ("tokens", "<u8")])
ENTRY = np.dtype([("packed", "<u4"), ("size", "<u4"), ("checksum", "<u4")])

#: Words that a worker remembers; beyond it starts anew.
REMEMBERED = 700_000
RUN = 2000  #: words of letters encoded in one call

_odd_space = re.compile("[\x1c-\x1f]").search
_loaded: dict[str, _Encoder] = {}
common.KEPT["token_files"] = _loaded.clear


def _words(text: str) -> list[str]:
    """Parts of a text at white space. str.split() also parts at four control characters that aren't white space."""
    return re.split(r"[ \n]+", text) if _odd_space(text) else text.split()


def _letters(word: str) -> bool:
    """Whether a word is of letters, also once the normaliser has composed it and made it lower case."""
    return word.isalpha() and (word.isascii() or unicodedata.normalize("NFC", word).lower().isalpha())


def _kind(c: int) -> str:
    """Of a Latin-1 character: odd space, comma or full stop, white space, letter or number, other."""
    ch = chr(c)
    return "?" if 0x1C <= c <= 0x1F else "," if ch in ",." else " " if ch.isspace() else "a" if ch.isalnum() else "."


#: Latin-1 characters in lower case, ASCII white space as blanks; and their kinds.
LOWER = bytes(32 if chr(c) in "\t\n\v\f\r" else ord(chr(c).lower()) for c in range(256))
KINDS = "".join(map(_kind, range(256))).encode()


class _Encoder:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.added = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    def parts(self, text: str) -> list[str]:
        """Words of a text, fewer distinct ones if it is of Latin-1 characters: in lower case, commas and full stops apart.

        The normaliser changes such a text by nothing but lower case. A comma or full stop before a blank is a match of its own
        unless it ends a run of punctuation. Texts with one of these runs, odd spaces or added tokens aren't changed that way.
        """
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return _words(text)
        kinds, raw = raw.translate(KINDS), raw.translate(LOWER)
        if b"?" in kinds or any(t in raw for t in self.added):
            return _words(text)
        if b"., " not in kinds and b",, " not in kinds:
            raw = raw.replace(b", ", b" , ").replace(b". ", b" . ")
        return raw.decode("latin-1").split()

    def learn(self, words: set[str]) -> None:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        todo = words.difference(self.known)
        # letters, then a run of punctuation: two matches of the pre-tokeniser
        ends = {w: base for w in todo if (base := w.rstrip(string.punctuation)) != w and _letters(base)}
        plain = todo.difference(ends).union(ends.values(), [w[len(base) :] for w, base in ends.items()]).difference(self.known)
        letters = [w for w in plain if _letters(w)]
        self._one_by_one(list(plain.difference(letters)))
        for k in range(0, len(letters), RUN):
            self._as_text(letters[k : k + RUN])
        for w, base in ends.items():
            self.known[w] = self.known[base] + self.known[w[len(base) :]]

    def _one_by_one(self, words: list[str]) -> None:
        for w, e in zip(words, self.tokenizer.encode_batch_fast(words, add_special_tokens=False), strict=True):
            self.known[w] = np.array(e.ids, np.uint32).tobytes()

    def _as_text(self, words: list[str]) -> None:
        """Words of letters in one call, parted again behind each token that ends a word."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.last[ids]) + 1 if len(ids) else []
        if len(ends) != len(words):  # lower case or composition made other characters of some letters
            return self._one_by_one(words)
        begin = 0
        for w, end in zip(words, ends.tolist(), strict=True):
            self.known[w] = ids[begin:end].tobytes()
            begin = end

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        parted = [self.parts(t) if t else [] for t in texts]
        try:
            return [b"".join(map(self.known.__getitem__, words)) for words in parted]
        except KeyError:
            self.learn(set().union(*parted))
            return [b"".join(map(self.known.__getitem__, words)) for words in parted]


def _encoder(path: str) -> _Encoder:
    common.claim("token_files")
    if path not in _loaded:
        _loaded[path] = _Encoder(path)
    return _loaded[path]


def encoded(docs: DataFrame, path: str, end_id: int, bounds: list[int]) -> DataFrame:
    """bucket (the range of doc_id), doc_id, ids (16-bit little-endian if all fit, with a leading mark of the width)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end, edges = _encoder(path), np.uint32(end_id).tobytes(), np.array(bounds, np.int64)
        for b in batches:
            ids = b.column(0).to_pylist()
            out = []
            for raw in encode(b.column(1).to_pylist()):
                a = np.frombuffer(raw + end, np.uint32)
                out.append(b"\2" + a.astype("<u2").tobytes() if int(a.max()) < 65536 else b"\4" + a.astype("<u4").tobytes())
            bucket = [0 if i is None else int(np.searchsorted(edges, i, side="left")) for i in ids]
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(bucket, pa.int64()), "doc_id": pa.array(ids, pa.int64()), "ids": pa.array(out, pa.binary())})

    common.arrow_batches(docs.sparkSession, 1000)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(common.tidy(run), "bucket long, doc_id long, ids binary")


def _ids(packed: bytes) -> np.ndarray:
    return np.frombuffer(packed, "<u2" if packed[0] == 2 else "<u4", offset=1).astype("<u4")


class Writer:
    """Writes one file to an open binary stream."""

    def __init__(self, out, frame_tokens: int = FRAME_TOKENS):
        self.out, self.frame_tokens = out, frame_tokens
        self.docs: list[int | None] = []
        self.parts: list[np.ndarray] = []
        self.held = self.tokens = self.written = 0
        self.entries: list[tuple] = []
        self.index: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.parts.append(ids)
        self.held += len(ids)
        if self.held >= self.frame_tokens:
            self.flush()

    def flush(self) -> None:
        if not self.docs:
            return
        n, known = len(self.docs), [d for d in self.docs if d is not None]
        raw = b"".join(
            [np.uint32(n).tobytes(), np.array([d or 0 for d in self.docs], "<i8").tobytes(), np.array([d is not None for d in self.docs], "u1").tobytes(), np.array([len(p) for p in self.parts], "<u4").tobytes()]
            + [p.astype("<u4").tobytes() for p in self.parts]
        )
        packed = zstandard.ZstdCompressor(level=3, write_checksum=True).compress(raw)
        self.out.write(packed)
        self.entries.append((len(packed), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        least = -(1 << 63)
        self.index.append((least if len(known) < n else known[0], known[-1] if known else least, n, self.held))
        self.tokens += self.held
        self.docs, self.parts, self.held = [], [], 0

    def close(self) -> None:
        self.flush()
        index = np.array(self.index, INDEX).tobytes()
        self._skippable(index)
        entries = np.array([*self.entries, (len(index) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)], ENTRY)
        self._skippable(entries.tobytes() + np.uint32(len(entries)).tobytes() + bytes([CHECKSUMS]) + np.uint32(SEEKABLE).tobytes())

    def _skippable(self, content: bytes) -> None:
        self.out.write(np.array([SKIPPABLE, len(content)], "<u4").tobytes() + content)


class Reader:
    """Reads a file from a stream that can seek; fetches and decompresses only the frames it is asked for."""

    def __init__(self, stream):
        self.stream = stream
        size = stream.seek(0, 2)
        tail = self._at(size - 9, 9)
        frames, flags, magic = int.from_bytes(tail[:4], "little"), tail[4], int.from_bytes(tail[5:], "little")
        if magic != SEEKABLE or flags != CHECKSUMS:
            raise ValueError("not a token file")
        self.entries = np.frombuffer(self._at(size - 9 - frames * ENTRY.itemsize, frames * ENTRY.itemsize), ENTRY)
        self.offsets = np.concatenate([[0], np.cumsum(self.entries["packed"], dtype=np.int64)])
        self.index = np.frombuffer(self._at(int(self.offsets[-2]) + 8, int(self.entries[-1]["packed"]) - 8), INDEX)

    def _at(self, offset: int, n: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(n)

    def frame(self, k: int) -> Iterator[tuple[int | None, np.ndarray]]:
        e = self.entries[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(e["packed"])), max_output_size=int(e["size"]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != int(e["checksum"]):
            raise ValueError(f"frame {k} is damaged")
        n = int(np.frombuffer(raw, "<u4", 1)[0])
        docs, valid, counts = np.frombuffer(raw, "<i8", n, 4), np.frombuffer(raw, "u1", n, 4 + 8 * n), np.frombuffer(raw, "<u4", n, 4 + 9 * n)
        ids = np.frombuffer(raw, "<u4", offset=4 + 13 * n)
        ends = np.cumsum(counts, dtype=np.int64)
        for i in range(n):
            yield (int(docs[i]) if valid[i] else None), ids[ends[i] - counts[i] : ends[i]]

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.frame(k)

    def documents(self, wanted: set[int]) -> Iterator[tuple[int, np.ndarray]]:
        """The documents with these ids, from the frames that can hold them."""
        order = np.array(sorted(wanted), np.int64)
        for k, x in enumerate(self.index):
            if np.searchsorted(order, x["first"]) < np.searchsorted(order, x["last"], side="right"):
                yield from ((d, ids) for d, ids in self.frame(k) if d in wanted)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def write(docs: DataFrame, folder: str, path: str, end_id: int) -> DataFrame:
    """Writes docs as token files below folder; gives the manifest: path, bucket, n_docs, n_tokens, start.

    A file's name is that of its task's attempt, so no attempt touches another's file: the manifest has one file for each
    bucket, and what other attempts left is deleted at the end. Ranges of doc_id come from approximate quantiles of that column alone, one for each shuffle partition.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx(F.col("doc_id").cast("long"), [i / n for i in range(1, n)] or [0.5], 10_000)).first()[0] or []
    rows = encoded(docs, path, end_id, sorted(set(cuts))).repartition(n, "bucket").sortWithinPartitions("bucket", "doc_id", "ids")

    call = uuid.uuid4().hex[:12]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        fs.create_dir(base, recursive=True)
        bucket = writer = stream = file = None
        count, made = 0, []

        def done():
            writer.close()
            stream.close()
            made.append((file, bucket, count, writer.tokens))

        for b in batches:
            for at, doc_id, ids in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if at != bucket:
                    if writer:
                        done()
                    bucket, count, file = at, 0, f"part-{at:06d}-{call}-{uuid.uuid4().hex}.tok"
                    stream = fs.open_output_stream(f"{base}/{file}")
                    writer = Writer(stream)
                writer.add(doc_id, _ids(ids))
                count += 1
        if writer:
            done()
        if made:
            yield pa.RecordBatch.from_pydict(dict(zip(("file", "bucket", "n_docs", "n_tokens"), map(list, zip(*made, strict=True)), strict=True)))

    files = common.materialise(rows.mapInArrow(common.tidy(run), "file string, bucket long, n_docs long, n_tokens long"), "token-files")
    _without_leftovers(folder, call, {r.file for r in files.select("file").collect()})
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _without_leftovers(folder: str, call: str, kept: set[str]) -> None:
    """Deletes the files of this call of write() that the manifest doesn't name. There is a file for each shuffle partition."""
    fs, base = _filesystem(folder)
    from pyarrow.fs import FileSelector

    for f in fs.get_file_info(FileSelector(base, allow_not_found=True)):
        if f"-{call}-" in f.base_name and f.base_name not in kept:
            fs.delete_file(f.path)


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document in the files, and ids (binary, 32-bit) is kept out of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _filesystem(folder)
        for b in batches:
            for file, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_file(f"{base}/{file}") as stream:
                    reader = Reader(stream)
                    for k in range(len(reader.index)):
                        rows = []
                        for doc, ids in reader.frame(k):
                            rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
                            start += len(ids)
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.select("file", "start").repartition(n, "file").mapInArrow(common.tidy(run), "doc_id long, start long, n_tokens long, ids_crc32 long")


def new_folder(docs: DataFrame) -> str:
    return f"{shared_folder(docs.sparkSession)}/quarry/tokens-{uuid.uuid4().hex}"
