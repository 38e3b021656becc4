"""Token ids in files of fixed-width bit packing, with block offsets for random access.

A file holds the ids of many documents, in ascending doc_id order, each id in the fewest bits that
hold the vocabulary. Layout, all numbers little-endian:

    8 bytes   magic "TMTOKENS"
    4 x u32   version, bits of an id, ids in a block, 0
    ...       blocks: each BLOCK ids (the last fewer), packed most significant bit first, padded to a byte
    footer    u64 block offsets (one more than blocks), i64 doc_ids, u64 first ids (one more than documents)
    4 x u64   offset of the footer, numbers of blocks, of documents, and of those, the first ones, without a doc_id

A block unpacks by itself with numpy (``unpack``); ``TokenFile.read(a, b)`` touches only the blocks
that hold ids a to b. Files are written whole under a temporary name and renamed, so that a task that
runs again after a lost executor replaces its own file and a reader never sees half of one.

The folder is any URI that pyarrow.fs opens (file, hdfs, s3, gs). Placement: Spark's range partitioner, by
doc_id, sends every document to its file once; there it is sorted, encoded and written in a stream of blocks.

Defined results: a null text is empty and holds the end id only; a null doc_id sorts first; rows of
equal doc_id are all kept, in order of the first 64 characters of their texts and then of the texts' hashes;
an empty table makes no file and no row; further columns of any name are left out.
"""

from __future__ import annotations

import re
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.bpe import Encoder, Kept, Splitter, tokenizer_path
from tracemill.llm.common import located, map_in_arrow, scratch, strings, table, text_or_empty, written

MAGIC = b"TMTOKENS"
BLOCK = 1 << 16
END_ID = 1
#: Bytes, about, that a worker keeps for chunks of text that it has seen, and half as many for their pieces.
LIBRARY_CACHE_BYTES = 192 << 20
#: Bytes of text that a file's ids come from, on average.
FILE_TEXT_BYTES = 32 << 20


def width(vocabulary: int) -> int:
    """Bits that hold ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """The ids' lowest ``bits`` bits one after the other, most significant first, padded to a byte."""
    if bits in (8, 16, 32):
        return ids.astype(f">u{bits // 8}").tobytes()
    wide = ids.astype(">u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(wide, axis=1)[:, 32 - bits :].reshape(-1)).tobytes()


def unpack(data: bytes, bits: int, count: int) -> np.ndarray:
    """The first ``count`` ids of a packed block."""
    if bits in (8, 16, 32):
        return np.frombuffer(data, f">u{bits // 8}", count).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=count * bits).reshape(count, bits)
    out = np.zeros((count, 32), np.uint8)
    out[:, 32 - bits :] = flags
    return np.packbits(out, axis=1).view(">u4").reshape(-1).astype(np.uint32)


class Writer:
    """Streams documents into one file; holds one block of ids and the documents' index."""

    def __init__(self, uri: str, vocabulary: int):
        self.fs, self.path = pa.fs.FileSystem.from_uri(uri)
        self.bits = width(vocabulary)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.part = f"{self.path}.{uuid.uuid4().hex}.part"
        self.out = self.fs.open_output_stream(self.part)
        self.out.write(MAGIC + struct.pack("<4I", 1, self.bits, BLOCK, 0))
        self.offsets, self.docs, self.firsts, self.nulls = [24], [], [0], 0
        self.rest: list[np.ndarray] = []
        self.n_rest = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        """Documents without a doc_id come first."""
        self.nulls += doc_id is None
        self.docs.append(doc_id or 0)
        self.firsts.append(self.firsts[-1] + len(ids))
        self.rest.append(ids)
        self.n_rest += len(ids)
        if self.n_rest >= BLOCK:
            whole = np.concatenate(self.rest)
            cut = len(whole) // BLOCK * BLOCK
            for k in range(0, cut, BLOCK):
                self._block(whole[k : k + BLOCK])
            self.rest, self.n_rest = [whole[cut:]], len(whole) - cut

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.out.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> int:
        if self.n_rest:
            self._block(np.concatenate(self.rest))
        self.out.write(np.array(self.offsets, "<u8").tobytes() + np.array(self.docs, "<i8").tobytes() + np.array(self.firsts, "<u8").tobytes())
        self.out.write(struct.pack("<4Q", self.offsets[-1], len(self.offsets) - 1, len(self.docs), self.nulls))
        self.out.close()
        self.fs.move(self.part, self.path)
        return self.firsts[-1]


class TokenFile:
    """Random access to a written file."""

    def __init__(self, uri: str):
        fs, path = pa.fs.FileSystem.from_uri(uri)
        self.file = fs.open_input_file(path)
        head = self.file.read_at(24, 0)
        if head[:8] != MAGIC:
            raise ValueError(f"{uri} is no token file")
        _, self.bits, self.block, _ = struct.unpack("<4I", head[8:])
        size = self.file.size()
        at, blocks, docs, self.nulls = struct.unpack("<4Q", self.file.read_at(32, size - 32))
        footer = self.file.read_at(size - 32 - at, at)
        self.offsets = np.frombuffer(footer, "<u8", blocks + 1)
        self.docs = np.frombuffer(footer, "<i8", docs, 8 * (blocks + 1))
        self.firsts = np.frombuffer(footer, "<u8", docs + 1, 8 * (blocks + 1 + docs)).astype(np.int64)

    def read_block(self, k: int) -> np.ndarray:
        start, end = int(self.offsets[k]), int(self.offsets[k + 1])
        return unpack(self.file.read_at(end - start, start), self.bits, min(self.block, int(self.firsts[-1]) - k * self.block))

    def read(self, first: int, end: int) -> np.ndarray:
        """Ids first to end - 1 of the file."""
        if end <= first:
            return np.zeros(0, np.uint32)
        low = first // self.block
        ids = np.concatenate([self.read_block(k) for k in range(low, (end - 1) // self.block + 1)])
        return ids[first - low * self.block : end - low * self.block]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, first id and ids of every document, each block unpacked once."""
        k, held, at = -1, np.zeros(0, np.uint32), 0  # ids at to at + len(held) are unpacked
        for n, (doc, first, end) in enumerate(zip(self.docs.tolist(), self.firsts[:-1].tolist(), self.firsts[1:].tolist(), strict=True)):
            parts = [held[first - at :]]
            while at + len(held) < end:
                k, at = k + 1, at + len(held)
                held = self.read_block(k)
                parts.append(held)
            ids = np.concatenate(parts)[: end - first] if len(parts) > 1 else parts[0][: end - first]
            yield None if n < self.nulls else doc, first, ids


class LibraryEncoder(Encoder):
    """Ids by the tokenizers library, each distinct word asked for once; a chunk is kept as its ids' bytes."""

    def __init__(self, path: str, cache_bytes: int = LIBRARY_CACHE_BYTES):
        self.splitter = Splitter(path)
        self.kept, self.pieces = Kept(cache_bytes, self._chunk), Kept(cache_bytes // 2, self._piece)
        self.simple = re.compile("[!-;=-~À-ÖØ-öø-ÿß]+")  # no "<", with which the special tokens begin

    def _piece(self, piece: str) -> bytes:
        return np.array([t.id for t in self.splitter.library.model.tokenize(piece)], "<u4").tobytes()

    def _chunk(self, chunk: bytes) -> bytes:
        text, pieces = chunk.decode(), self.pieces
        if self.splitter.known and self.simple.fullmatch(text):
            return b"".join([pieces[p] for p in self.splitter._plain(text)])
        return np.array(self.splitter.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _block(self, block: list[list[bytes]]) -> Iterator[list]:
        kept = self.kept
        for chunks in block:
            yield [kept[c] for c in chunks]
        kept.settle()
        self.pieces.settle()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def write_tokens(docs: DataFrame, folder: str, path: str, files: int, end_id: int = END_ID) -> DataFrame:
    """Encodes and writes all documents; a row for each file: file (its number), first_doc, n_docs, n_ids.

    Spark's range partitioner cuts the order into about equal files. The order is that of doc_id, then of the
    text's beginning and its hash, then of the row's place in the input, so that no doc_id, however many rows it
    has, is a file by itself, and no cut depends on how doc_ids are spread.
    """
    kept = docs.select("doc_id", "text")
    rows = located(kept).select(F.col("doc.doc_id").cast("long").alias("doc_id"), text_or_empty("doc.text").alias("text"), "file", "row")
    order = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text"), F.xxhash64("file"), "row"]
    placed = rows.repartitionByRange(max(1, files), *order).sortWithinPartitions(*order).select("doc_id", "text")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = library_encoder(path)
        vocabulary = e.splitter.library.get_vocab_size(with_added_tokens=True)
        out, name, first = None, TaskContext.get().partitionId(), None
        for b in batches:
            if not b.num_rows:
                continue
            if out is None:
                out, first = Writer(f"{folder}/{name:08d}.tok", vocabulary), b["doc_id"][0].as_py()
            for doc, chunks in zip(b["doc_id"].to_pylist(), e.texts(strings(b["text"])), strict=True):
                out.add(doc, np.frombuffer(b"".join(chunks) + end, "<u4"))
        if out is not None:
            n_docs = len(out.docs)
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in ((name, pa.int64()), (first, pa.int64()), (n_docs, pa.int64()), (out.close(), pa.int64()))], ["file", "first_doc", "n_docs", "n_ids"])

    # written: a later read of these rows must not encode again
    return written(map_in_arrow(placed, run, "file long, first_doc long, n_docs long, n_ids long"), "token-files")


def read_tokens(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids of every document, from the files alone."""
    # over a row of two numbers for each file
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    listed = files.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b["file"].to_pylist(), b["base"].to_pylist(), strict=True):
                rows: list[tuple] = []
                for doc, first, ids in TokenFile(f"{folder}/{name:08d}.tok").documents():
                    rows.append((doc, base + first, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    if len(rows) == 20_000:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)

    n = files.agg(F.max("file")).first()[0]
    return map_in_arrow(listed.repartitionById(1 if n is None else n + 1, F.col("file").cast("int")), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])


def op4_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    folder = scratch(spark, "tokens")
    size = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return read_tokens(write_tokens(docs, folder, tokenizer_path(), int(size // FILE_TEXT_BYTES) + 1), folder)
