"""Substring deduplication by relative Lempel-Ziv factors.

The corpus is cut into reference blocks of whole documents. Every block is indexed: a dictionary of all blocks'
windows of WINDOW words, dealt over shards, gives for each window the first place (block and word) that has it,
the first being that of the smallest doc_id, and in a document the one furthest ahead. A block is then parsed
against the dictionary: from the first word whose window stands at an earlier place on, a factor follows that
place for as long as the next window is found at the next word of the same block, so a factor is WINDOW words
or more that equal a stretch of one reference block. Where a factor ends, the windows that begin in its last
WINDOW - 1 words cross the boundary; they are looked up by themselves, and those that are found elsewhere
are factors too, so that no repeat is missed at a boundary. The words of factors go. Shorter factors can't
hold a window and aren't formed.

Hashes find factors and words decide: each factor's words are digested (SHA-256) where they stand and where the
reference block has them, and if any two differ, the parse is made again with other hashes.

How the blocks' indexes meet without moving any text:

1.  Each task cuts its documents into blocks, writes each block (compressed) to the shared folder, and
    sends, to the shard that owns them, the hashes of the block's anchors and the bits of their numbers of
    windows. An anchor is the least of the hashes of a window's ANCHOR-word runs, so equal windows have
    equal anchors, and about one word in seven begins one.
2.  A shard answers, a byte for each anchor, whether another block has it too, and over how many shards
    its windows are spread if it has more than HOT of them.
3.  Each block sends the windows of such anchors: a hash, the document and the place. A window that
    repeats inside its block is sent once, so that a passage in a third of all documents is a row for
    each block and no more.
4.  The shard that owns a window answers with the first place of each one that isn't first itself, in runs.
5.  Each block is parsed with the answers, and gives its documents' rows and its factors.
6.  Distinct factors go to tasks that read their reference blocks, and are compared.

Shuffled are hashes and places, about two bytes for a word of text that is unique, 13 for one that isn't; a
block sends a shard one message at most, and no more messages than it has anchors.

Blocks are named by a digest of their rows, so a task that runs again after a lost executor writes the
same files and sends the same rows. Memory is bounded by one block and one shard; the number of shards
grows with the characters of the corpus.

Defined results: a null or empty text has no words; texts under WINDOW words lose nothing; a null doc_id
comes before all others; repeated rows of one doc_id hold their windows at the same places, and neither
row is earlier than the other; an empty table gives no rows; a text longer than a block is a block; further
columns of any name are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import map_in_arrow, scratch, strings, table, text_or_empty, written

WINDOW = 20
ANCHOR = 8
BLOCK_WORDS = 1 << 20
#: Characters of text for each shard; there are no fewer shards than the session's shuffle partitions.
SHARD_CHARS = 64 << 20
#: Windows of one anchor beyond which they are spread over shards.
HOT = 1 << 12
#: Hashes that are tried before the parse is given up.
SEEDS = 4
_NULL_ID = -(1 << 63)
_BASE = np.array([0x9E3779B97F4A7C15], np.uint64)
SENT = "shard int, block string, payload binary"


class _Hashes(dict):
    def __init__(self, seed: int):
        from xxhash import xxh64_intdigest

        super().__init__()
        self.seed, self.hash = seed, xxh64_intdigest

    def __missing__(self, word: bytes) -> int:
        h = self.hash(word, self.seed)
        if len(word) <= 64:  # at most some 60 MB
            if len(self) > 300_000:
                self.clear()
            self[word] = h
        return h


@lru_cache(maxsize=1)
def _hashes(seed: int) -> _Hashes:
    return _Hashes(seed)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _runs(x: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hashes of every n consecutive elements, by doubling."""
    out, size, at, power, width = None, 0, x, _BASE, 1
    while True:
        if n & width:
            if out is None:
                out, size = at, width
            else:  # the run so far, followed by the doubled one
                m = max(0, len(x) - size - width + 1)
                out, size = out[:m] * power + at[size : size + m], size + width
        if width * 2 > n:
            return out
        m = max(0, len(at) - width)
        at, power, width = at[:m] * power + at[width : width + m], power * power, width * 2


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The least of every n consecutive elements."""
    width, at = 1, x
    while width * 2 <= n:
        at, width = np.minimum(at[:-width], at[width:]) if len(at) > width else at[:0], width * 2
    rest = n - width
    return at if not rest else np.minimum(at[: len(at) - rest], at[rest:]) if len(at) > rest else at[:0]


class Block:
    """Documents in the order of their ids, and the hashes of their windows."""

    def __init__(self, ids: list[int | None], texts: list[str], seed: int = 0):
        own = np.array([_NULL_ID if i is None else i for i in ids], np.int64)
        order = np.argsort(own, kind="stable")
        self.ids = own[order]
        self.words = [texts[k].encode("utf-8", "replace").split() for k in order]
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.ends = np.cumsum(self.sizes)
        self.starts = self.ends - self.sizes
        self.flat = [w for words in self.words for w in words]
        n = len(self.flat)
        hashes = _mix(np.fromiter(map(_hashes(seed).__getitem__, self.flat), np.uint64, n))
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        place = np.arange(n) - self.starts[doc]
        self.at = np.flatnonzero(place + WINDOW <= self.sizes[doc])  # the words at which a window of one document begins
        if len(self.at):
            self.hash = _mix(_runs(hashes, WINDOW))[self.at]
            self.anchor = _least(_mix(_runs(hashes, ANCHOR) ^ np.uint64(0x5851F42D4C957F2D)), WINDOW - ANCHOR + 1)[self.at]
        else:
            self.hash = self.anchor = np.zeros(0, np.uint64)
        self.doc, self.place = doc[self.at], place[self.at]

    def digest(self, start: int, size: int) -> bytes:
        return hashlib.sha256(b" ".join(self.flat[start : start + size])).digest()

    def first_inside(self) -> np.ndarray:
        """For each window, the word at which the block's first equal one begins if that is earlier; else -1."""
        order = np.argsort(self.hash, kind="stable")
        later, first = _later(self.hash[order], self.anchor[order], self.ids[self.doc[order]], self.place[order])
        out = np.full(len(order), -1, np.int64)
        out[order[later]] = self.at[order[first[later]]]
        return out


def _later(h: np.ndarray, a: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows sorted by hash and then by document and place: whether each is later than the first of its kind, and that one's index."""
    if not len(h):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    first = np.flatnonzero(np.r_[True, (h[1:] != h[:-1]) | (a[1:] != a[:-1])])
    start = np.repeat(first, np.diff(np.r_[first, len(h)]))
    return (doc != doc[start]) | (place != place[start]), start


def _shard(anchor: np.ndarray, shards: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _by_shard(shard: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each shard that owns something, with the indices, in ascending order, of what it owns."""
    order = np.argsort(shard, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(shard[order]) > 0]) if len(order) else order
    for s, k in zip(shard[order[first]].tolist(), np.split(order, first[1:]), strict=False):
        yield s, k


def _save(folder: str, ids: list, texts: list[str]) -> str:
    digest = hashlib.blake2b(digest_size=16)
    for i, t in zip(ids, texts, strict=True):
        digest.update(b"%d %d " % (_NULL_ID if i is None else i, len(t)) + t.encode("utf-8", "replace"))
    name = digest.hexdigest()
    fs, path = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(path, recursive=True)
    rows = pa.table({"id": pa.array(ids, pa.int64()), "text": pa.array(texts, pa.large_string())})
    part = f"{path}/{name}.{np.random.default_rng().integers(1 << 62):x}.part"
    with fs.open_output_stream(part) as out, pa.ipc.new_file(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_table(rows)
    fs.move(part, f"{path}/{name}.arrow")
    return name


def _load(folder: str, name: str, seed: int) -> Block:
    fs, path = pa.fs.FileSystem.from_uri(folder)
    with fs.open_input_file(f"{path}/{name}.arrow") as f:
        rows = pa.ipc.open_file(f).read_all()
    return Block(rows["id"].to_pylist(), rows["text"].to_pylist(), seed)


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    shard, block, payload = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(shard, pa.int32()), pa.array(block), pa.array(payload, pa.binary())], ["shard", "block", "payload"])


def _rows(batches: Iterator[pa.RecordBatch]) -> list[tuple]:
    return [row for b in batches for row in zip(*(b[c].to_pylist() for c in ("shard", "block", "payload")), strict=True)]


def _low(x: np.ndarray) -> np.ndarray:
    return (x & np.uint64(0xFFFFFFFF)).astype("<u4")


def _bytes(*arrays: np.ndarray) -> bytes:
    return b"".join(a.tobytes() for a in arrays)


def _index(docs: DataFrame, folder: str, shards: int, seed: int) -> DataFrame:
    """Step 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[str] = []
        size = 0

        def flush() -> pa.RecordBatch:
            name, rows = _save(folder, ids, texts), []
            anchors, n = np.unique(Block(ids, texts, seed).anchor, return_counts=True)
            for s, k in _by_shard(_shard(anchors, shards)):
                rows.append((s, name, _bytes(_low(anchors[k]), np.ceil(np.log2(n[k])).astype("u1"))))
            return _sent(rows or [(0, name, b"")])

        for b in batches:
            for i, t in zip(b["doc_id"].to_pylist(), strings(b["text"]), strict=True):
                n = len(t) // 6 + 1  # about a word
                if ids and size + n > BLOCK_WORDS:
                    yield flush()
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += n
        if ids:
            yield flush()

    return map_in_arrow(docs, run, SENT)


def _answer_anchors(hot: int):
    """Step 2. 0: no other block has the anchor; else 1 and the bits of its spread."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(s, b, np.frombuffer(p, "<u4", len(p) // 5), np.frombuffer(p, "u1", len(p) // 5, len(p) // 5 * 4)) for s, b, p in _rows(batches)]
        if not rows:
            return
        # two copies of a block (equal rows under one name) are a repeat as well
        values, back, blocks = np.unique(np.concatenate([a for _, _, a, _ in rows]), return_inverse=True, return_counts=True)
        windows = np.bincount(back, np.exp2(np.concatenate([n for *_, n in rows])), len(values))
        spread = np.where(blocks > 1, 1 + np.ceil(np.log2(np.maximum(1, windows / hot))), 0).astype("u1")
        for k in range(0, len(rows), 512):
            yield _sent([(s, b, spread[np.searchsorted(values, a)].tobytes()) for s, b, a, _ in rows[k : k + 512]])

    return run


def _answered(rows: DataFrame) -> DataFrame:
    """A row for each block and its copies, with the answers of all shards."""
    return rows.groupBy("block", "shard").agg(F.first("payload").alias("payload"), F.count("*").alias("copies")).groupBy("block").agg(F.collect_list(F.struct("shard", "payload")).alias("answers"), F.max("copies").alias("copies"))


def _asked(block: Block, answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each window's first place inside the block; in order, the other windows whose anchors other blocks have; and their shards."""
    inside = block.first_inside()
    anchors = np.unique(block.anchor)
    if not len(anchors):
        return inside, np.zeros(0, np.int64), np.zeros(0, np.int64)
    of, spread = {a["shard"]: a["payload"] for a in answers}, np.zeros(len(anchors), np.uint8)
    for s, k in _by_shard(_shard(anchors, shards)):
        spread[k] = np.frombuffer(of[s], "u1")
    spread = spread[np.searchsorted(anchors, block.anchor)]
    asked = np.flatnonzero((spread > 0) & (inside < 0))
    salt = block.hash[asked] & ((np.uint64(1) << (spread[asked].astype(np.uint64) - np.uint64(1))) - np.uint64(1))
    return inside, asked, _shard(_mix(block.anchor[asked] + salt * _BASE), shards)


def _lengths(*xs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Run-length code of several columns: their values, and counts."""
    new = np.zeros(len(xs[0]), bool)
    new[:1] = True
    for x in xs:
        new[1:] |= x[1:] != x[:-1]
    first = np.flatnonzero(new)
    return *(x[first] for x in xs), np.diff(np.r_[first, len(new)]).astype("<u4")


def _windows(folder: str, shards: int, seed: int):
    """Step 3."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, answers, copies in zip(b["block"].to_pylist(), b["answers"].to_pylist(), b["copies"].to_pylist(), strict=True):
                block, rows = _load(folder, name, seed), []
                _, asked, shard = _asked(block, answers, shards)
                for s, k in _by_shard(shard):
                    k = asked[k]
                    (docs, n_docs), (anchors, n_anchors) = _lengths(block.doc[k]), _lengths(_low(block.anchor[k]))
                    head = np.array([len(k), len(docs), len(anchors)], "<u4")
                    numbers = (block.hash[k].astype("<u8"), block.ids[docs].astype("<i8"), block.starts[docs].astype("<u4"), n_docs, block.place[k].astype("<u4"), anchors, n_anchors)
                    rows.append((s, name, _bytes(head, *numbers)))
                for _ in range(copies):
                    yield _sent(rows or [(0, name, b"")])

    return run


def _read_windows(p: bytes) -> tuple[np.ndarray, ...]:
    """Hash, anchor, doc_id, place and the block's word of each window of a message."""
    n, d, a = np.frombuffer(p, "<u4", 3).tolist()
    h, docs = np.frombuffer(p, "<u8", n, 12), np.frombuffer(p, "<i8", d, 12 + 8 * n)
    starts, n_docs, place, anchors, n_anchors = np.split(np.frombuffer(p, "<u4", 2 * d + n + 2 * a, 12 + 8 * (n + d)).astype(np.int64), np.cumsum([d, d, n, a]))
    return h, np.repeat(anchors, n_anchors), np.repeat(docs, n_docs), place, np.repeat(starts, n_docs) + place


def _answer_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 4: the rows of one shard. Which windows aren't first, and, in runs, the block and the distance of the first ones."""
    rows = _rows(batches)
    full = [_read_windows(p) for _, _, p in rows if p]
    if full:
        names, number = np.unique([b for _, b, p in rows if p], return_inverse=True)
        of = np.repeat(number, [len(x[0]) for x in full])
        h, a, doc, place, at = (np.concatenate(x) for x in zip(*full, strict=True))
        order = np.lexsort((place, doc, a, h))
        is_later, start = _later(h[order], a[order], doc[order], place[order])
        later, first = np.zeros(len(h), bool), np.zeros(len(h), np.int64)
        later[order], first[order] = is_later, order[start]
    k, out = 0, []
    for s, b, p in rows:
        n = int(np.frombuffer(p, "<u4", 1)[0]) if p else 0
        if n:
            mine = later[k : k + n]
            to = first[k : k + n][mine]
            ref, step, runs = _lengths(of[to], at[to] - at[k : k + n][mine])
            known, ref = np.unique(ref, return_inverse=True)
            head = np.array([len(known), len(runs)], "<u4")
            p = head.tobytes() + "".join(names[known]).encode() + _bytes(step.astype("<i8"), ref.astype("<u4"), runs, np.packbits(mine))
            k += n
        out.append((s, b, p))
        if len(out) == 512:
            yield _sent(out)
            out = []
    if out:
        yield _sent(out)


def _read_places(p: bytes, n: int) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray]:
    """Which of a message's n windows aren't first; names of blocks; and of those windows, the number of the block and the distance."""
    m, r = np.frombuffer(p, "<u4", 2).tolist()
    at = 8 + 32 * m
    names = [p[k : k + 32].decode() for k in range(8, at, 32)]
    step, ref, runs = np.frombuffer(p, "<i8", r, at), np.frombuffer(p, "<u4", r, at + 8 * r), np.frombuffer(p, "<u4", r, at + 12 * r)
    return np.unpackbits(np.frombuffer(p, np.uint8, -1, at + 16 * r), count=n).astype(bool), names, np.repeat(ref, runs), np.repeat(step, runs)


def places(block: Block, name: str, first: list[dict], answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """For each window, the number of the block (-1: none) and the word of an earlier equal one; and the blocks' names."""
    inside, asked, shard = _asked(block, first, shards)
    numbers = {name: 0}
    ref, word = np.where(inside >= 0, 0, -1), inside.copy()
    of = {a["shard"]: a["payload"] for a in answers}
    for s, k in _by_shard(shard):
        later, names, b, step = _read_places(of[s], len(k))
        k = asked[k[later]]
        own = np.array([numbers.setdefault(x, len(numbers)) for x in names] or [0])
        ref[k], word[k] = own[b], block.at[k] + step
    return ref, word, list(numbers)


def factors(block: Block, ref: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, ...]:
    """The parse: of each factor its first word, its length, and the number and the word of the block that it equals.

    A factor goes on while the next word's window is found at the next word of its reference; factors of
    neighbouring windows that refer to different places overlap, which is the check of the boundary between them.
    """
    found = np.flatnonzero(ref >= 0)
    if not len(found):
        return (found,) * 4
    at, step = block.at[found], word[found] - block.at[found]
    new = np.r_[True, (at[1:] != at[:-1] + 1) | (step[1:] != step[:-1]) | (ref[found][1:] != ref[found][:-1])]
    start = np.flatnonzero(new)
    windows = np.diff(np.r_[start, len(found)])
    return at[start], windows + WINDOW - 1, ref[found][start], word[found][start]


def _parse(folder: str, shards: int, full: bool, seed: int):
    """Step 5."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, first, answers, copies in zip(*(b[c].to_pylist() for c in ("block", "first_answers", "answers", "copies")), strict=True):
                block = _load(folder, name, seed)
                ref, word, names = places(block, name, first, answers, shards)
                start, size, of, to = factors(block, ref, word)
                step = np.zeros(len(block.flat) + 1, np.int64)
                np.add.at(step, start, 1)
                np.subtract.at(step, start + size, 1)
                covered = np.cumsum(step[:-1]) > 0
                claims: list[list] = [[] for _ in block.words]
                at_doc = np.searchsorted(block.ends, start, side="right").tolist()
                for d, a, n, r, t in zip(at_doc, start.tolist(), size.tolist(), of.tolist(), to.tolist(), strict=True):
                    claims[d].append({"ref": names[r], "word": t, "size": n, "digest": block.digest(a, n)})
                rows: list[tuple] = []
                for k, (doc, words, a, z) in enumerate(zip(block.ids.tolist(), block.words, block.starts.tolist(), block.ends.tolist(), strict=True)):
                    gone = covered[a:z]
                    n_gone = int(gone.sum())
                    kept = b" ".join(words if not n_gone else [words[j] for j in np.flatnonzero(~gone).tolist()])
                    row = (None if doc == _NULL_ID else doc, len(words), n_gone, hashlib.sha256(kept).hexdigest(), claims[k])
                    if full:
                        edges = np.flatnonzero(np.diff(np.r_[0, gone.astype(np.int8), 0]))
                        row += (kept.decode(), [{"start": s, "end": e} for s, e in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
                    rows.append(row)
                for _ in range(copies):
                    for k in range(0, len(rows), 1024):
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 1024], strict=True), _TYPES, strict=False)], _NAMES[: 7 if full else 5])

    return run


def _differ(folder: str):
    """Step 6: rows sorted by the reference block; those factors whose words the block doesn't have there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, flat = None, []
        for b in batches:
            wrong = []
            for ref, word, size, digest in zip(*(b[c].to_pylist() for c in ("ref", "word", "size", "digest")), strict=True):
                if ref != at:
                    fs, path = pa.fs.FileSystem.from_uri(folder)
                    with fs.open_input_file(f"{path}/{ref}.arrow") as f:
                        rows = pa.ipc.open_file(f).read_all()
                    own = [_NULL_ID if i is None else i for i in rows["id"].to_pylist()]
                    texts = rows["text"].to_pylist()
                    at, flat = ref, [w for k in np.argsort(np.array(own, np.int64), kind="stable") for w in texts[k].encode("utf-8", "replace").split()]
                wrong.append(hashlib.sha256(b" ".join(flat[word : word + size])).digest() != digest)
            yield pa.RecordBatch.from_arrays([b["ref"].filter(pa.array(wrong, pa.bool_()))], ["ref"])

    return run


CLAIM = "array<struct<ref: string, word: long, size: long, digest: binary>>"
_NAMES = ["doc_id", "n_words", "n_removed", "kept_sha256", "claims", "kept_text", "removed"]
_TYPES = [
    pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("ref", pa.string()), ("word", pa.int64()), ("size", pa.int64()), ("digest", pa.binary())])),
    pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])),
]


def _parsed(rows: DataFrame, folder: str, shards: int, full: bool, seed: int) -> DataFrame:
    """Steps 1 to 5, written."""
    anchors = map_in_arrow(_index(rows, folder, shards, seed).repartitionById(shards, "shard"), _answer_anchors(HOT), SENT)
    first = written(_answered(anchors), "anchor-answers")
    tasks = min(max(1, first.count()), 4 * shards)  # dealt in turn: every block is about as much work
    asked = map_in_arrow(first.repartition(tasks), _windows(folder, shards, seed), SENT)
    second = _answered(map_in_arrow(asked.repartitionById(shards, "shard"), _answer_windows, SENT)).select("block", "answers")
    both = first.withColumnRenamed("answers", "first_answers").join(second, "block")
    types = f"doc_id long, n_words long, n_removed long, kept_sha256 string, claims {CLAIM}" + ", kept_text string, removed array<struct<start: long, end: long>>" * full
    return written(map_in_arrow(both.repartition(tasks), _parse(folder, shards, full, seed), types), "parsed")


def _wrong(parsed: DataFrame, folder: str, shards: int) -> DataFrame:
    """Step 6. Copies of a passage make the same claim about its first place, which is checked once."""
    claims = parsed.select(F.explode("claims").alias("c")).select("c.*").distinct()
    dealt = claims.repartition(shards, "ref", F.pmod(F.xxhash64("word"), F.lit(8))).sortWithinPartitions("ref")
    return map_in_arrow(dealt, _differ(folder), "ref string")


def remove_repeats(docs: DataFrame, full: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if full, kept_text and removed (the spans of words that went)."""
    spark = docs.sparkSession
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    chars = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // SHARD_CHARS))
    for seed in range(SEEDS):
        folder = scratch(spark, "blocks")
        parsed = _parsed(rows, folder, shards, full, seed)
        if _wrong(parsed, folder, shards).isEmpty():
            return parsed.drop("claims")
    raise RuntimeError(f"different words had equal hashes under {SEEDS} seeds")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"), full=False)
