"""SentencePiece encoding and decoding for merge-type vocabularies, by an agenda of adjacent symbol pairs.

A text is cut where no piece of the vocabulary can reach across: before a word's space mark, and around line
ends where no longer piece holds one. In a chunk all pairs of neighbouring symbols whose joined form is a piece
stand on an agenda, best score first, the leftmost of equal ones; the first is merged and its new neighbours
join the agenda. Many distinct chunks hold their agendas side by side in arrays, one merge in each at a time;
long ones have a heap of their own. Symbols that are no piece fall back to their bytes.

What an Arrow batch has learned is compared with the sentencepiece library before it is used: all new chunks in
one call, ids against ids; a difference is an error. Known chunks are kept in a bounded cache, so a batch costs
what is new in it. Decoding is the library's, on the ids of every whole text.

Defined results: a null text is empty and has the begin and end ids only; white space is kept, as the model's
normaliser is the identity; control tokens written out in a text are plain characters; repeated rows are encoded
one by one; a null doc_id stays null; an empty table gives no rows; further columns of any name are left out.
Texts are encoded whole; memory is bounded by the cache, one text and one block of new chunks.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.bpe import Kept
from tracemill.llm.common import map_in_arrow, strings, table, text_or_empty

MARK = "▁"
#: Symbols of a chunk up to which its agenda is held in the arrays of its batch.
SHORT = 48
#: Bytes, about, that a worker keeps for chunks it has seen.
CACHE_BYTES = 96 << 20
#: Characters of text whose chunks are encoded together, and rows whose results are sent together.
BATCH_CHARS = 1 << 21
ROWS = 1024
_NONE = np.iinfo(np.int64).max


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def _number(b: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (b[at] & 127) << shift
        shift, at = shift + 7, at + 1
        if b[at - 1] < 128:
            return value, at


def message(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and value; values of fixed size stay bytes."""
    at = 0
    while at < len(b):
        key, at = _number(b, at)
        if key & 7 == 0:
            value, at = _number(b, at)
        else:
            size, at = _number(b, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = b[at : at + size], at + size
        yield key >> 3, value


class Pieces:
    """A merge-type model: its pieces, the pairs that join to one, and the agenda."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        kinds, merges, prefix, rules = [], False, True, b""
        for field, value in message(sp.serialized_model_proto()):
            if field == 1:
                kinds.append(dict(message(value)).get(3, 1))
            elif field == 2:
                merges = dict(message(value)).get(3, 1) == 2
            elif field == 3:
                normal = dict(message(value))
                prefix, rules, squeeze, escape = bool(normal.get(3, 1)), normal.get(2, b""), normal.get(4, 1), normal.get(5, 1)
        if not merges or rules or squeeze or not escape or 4 in kinds or 5 in kinds:
            raise ValueError(f"{path}: not a merge-type model with the identity normaliser and plain pieces only")
        self.prefix = MARK if prefix else ""
        self.text = [sp.id_to_piece(k) for k in range(len(kinds))]
        plain = [k for k, kind in enumerate(kinds) if kind == 1]
        self.ids = {self.text[k]: k for k in plain}
        # every character of a piece is a symbol, a piece of its own or not
        self.symbols = {c: self.ids.get(c, -1) for p in self.ids for c in p}
        for k, c in enumerate(sorted(c for c, i in self.symbols.items() if i < 0)):
            self.symbols[c] = len(kinds) + k
        self.size = len(kinds) + len(self.symbols) + 1
        self.stranger = self.size - 1  # any other character
        self.of_point = np.full(0x110000, self.stranger, np.int64)
        self.of_point[[ord(c) for c in self.symbols]] = list(self.symbols.values())
        self.pieces = len(kinds)
        part = self.symbols | self.ids
        pairs = {}
        for piece, k in self.ids.items():
            for cut in range(1, len(piece)):
                if (a := part.get(piece[:cut])) is not None and (b := part.get(piece[cut:])) is not None:
                    pairs[a * self.size + b] = (-sp.get_score(k), k)
        self.pairs = pairs
        # agendas in arrays compare whole numbers: the place of a score among all scores, equal ones together
        place = {s: n for n, s in enumerate(sorted({s for s, _ in pairs.values()}))}
        self.keys = np.array(sorted(pairs), np.int64)
        self.order = np.array([place[pairs[k][0]] for k in self.keys.tolist()], np.int64)
        self.made = np.array([pairs[k][1] for k in self.keys.tolist()], np.int64)
        fallback = dict(message(next(v for f, v in message(sp.serialized_model_proto()) if f == 2))).get(35, 0)
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if fallback else None
        self.unknown = sp.unk_id()
        longer = "".join(p for p in self.ids if len(p) > 1)
        inside = any(MARK in p.lstrip(MARK) for p in self.ids)
        alone = "".join(c for c in "\n\r\t" if c not in longer)
        self.line = alone[:1] == "\n" and self.bytes is not None
        self.chunk = re.compile(".+" if inside else f"[{alone}]|{MARK}*[^{MARK}{alone}]+|{MARK}+" if alone else f"{MARK}*[^{MARK}]+|{MARK}+", re.S)

    def chunks(self, text: str) -> list[str]:
        return self.chunk.findall(self.prefix + text.replace(" ", MARK)) if text else []

    def out(self, symbols: list[int], chunk: str) -> list[int]:
        """The ids of what is left after merging; a symbol that is no piece gives its bytes, or the unknown id once a run."""
        if max(symbols, default=0) < self.pieces:
            return symbols
        ids, at = [], 0
        for s in symbols:
            n = len(self.text[s]) if s < self.pieces else 1
            if s < self.pieces:
                ids.append(s)
            elif self.bytes:
                ids += [self.bytes[b] for b in chunk[at].encode()]
            elif not ids or ids[-1] != self.unknown:
                ids.append(self.unknown)
            at += n
        return ids

    def agenda(self, chunk: str) -> list[int]:
        """One chunk, by a heap: the pair with the best score, the leftmost of equal ones, until none is left."""
        ids = [self.symbols.get(c, self.stranger) for c in chunk]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = []

        def enter(k: int, j: int) -> None:
            if (found := self.pairs.get(ids[k] * self.size + ids[j])) is not None:
                heap.append((found[0], k, ids[k], ids[j]))

        for k in range(n - 1):
            enter(k, k + 1)
        heapq.heapify(heap)
        while heap:
            _, k, a, b = heapq.heappop(heap)
            if ids[k] != a or (j := after[k]) < 0 or ids[j] != b:
                continue  # a neighbour has been merged since this pair entered
            ids[k], ids[j] = self.pairs[a * self.size + b][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (found := self.pairs.get(ids[x] * self.size + ids[y])) is not None:
                    heapq.heappush(heap, (found[0], x, ids[x], ids[y]))
        return self.out([i for i in ids if i >= 0], chunk)

    def agendas(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks: all ids, one chunk after the other, and where each begins. The short ones' agendas stand in
        arrays and give their first pair all at once."""
        short = np.array([k for k, c in enumerate(chunks) if len(c) <= SHORT], np.int64)
        points = np.frombuffer("".join([chunks[k] for k in short.tolist()]).encode("utf-32-le", "surrogatepass"), "<u4")
        ids = self.of_point[points]
        owner = np.repeat(short, [len(chunks[k]) for k in short.tolist()])
        odd = set(owner[ids >= self.pieces].tolist())  # chunks with symbols that are no pieces
        place = self._pairs(ids, owner)
        owners, found = [], []
        while len(ids):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            sizes = np.diff(np.r_[starts, len(ids)])
            rank = np.where(place < 0, _NONE, self.order[place])
            best = np.minimum.reduceat(rank, starts)
            over = np.repeat(best == _NONE, sizes)
            owners.append(owner[over])
            found.append(ids[over])
            at = np.flatnonzero((rank == np.repeat(best, sizes)) & ~over)
            if len(at):
                at = at[np.r_[True, owner[at][1:] != owner[at][:-1]]]  # the leftmost
            ids[at] = self.made[place[at]]
            keep = ~over
            keep[at + 1] = False
            moved = np.zeros(len(ids), bool)  # pairs to look up anew: the merged symbol's with its neighbours
            moved[at] = True
            moved[np.maximum(at - 1, 0)] = True
            ids, owner, place, moved = ids[keep], owner[keep], place[keep], moved[keep]
            fresh = np.flatnonzero(moved)
            place[fresh] = self._pairs(ids, owner, fresh)
        single = {k: self.agenda(c) for k, c in enumerate(chunks) if len(c) > SHORT}
        owner, ids = (np.concatenate([np.empty(0, np.int64), *x]) for x in (owners, found))
        if odd:
            take = np.isin(owner, np.fromiter(odd, np.int64))
            of, their = owner[take], ids[take]
            starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.empty(0, np.int64)
            for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=False):
                single[int(of[s])] = self.out(their[s:e].tolist(), chunks[of[s]])
            owner, ids = owner[~take], ids[~take]
        if single:
            owner = np.concatenate([owner, np.repeat(np.fromiter(single, np.int64), [len(x) for x in single.values()])])
            ids = np.concatenate([ids, np.array([i for x in single.values() for i in x], np.int64)])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.searchsorted(owner[order], np.arange(len(chunks) + 1))

    def _pairs(self, ids: np.ndarray, owner: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """Where in the table the pair of a symbol and the next one of its chunk stands; -1: nowhere."""
        at = np.arange(len(ids)) if at is None else at
        after = np.minimum(at + 1, len(ids) - 1)
        keys = ids[at] * self.size + ids[after]
        k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where((self.keys[k] == keys) & (owner[at] == owner[after]) & (after > at), k, -1)

    def check(self, chunks: list[str], ids: np.ndarray, starts: np.ndarray) -> None:
        """Compares with the library; an error if any chunk differs."""
        if self.line:  # lines keep chunks apart, so that one call takes them all
            want = np.array(self.library.encode(("\n" + "\n".join(chunks)).replace(MARK, " "), num_threads=1), np.int64)
            first = np.array(self.agenda(self.prefix) if self.prefix else [], np.int64)
            same = np.array_equal(want, np.concatenate([first, np.insert(ids, starts[:-1], self.bytes[10])]))
        else:
            whole = [k for k, c in enumerate(chunks) if c.startswith(self.prefix)]
            want = self.library.encode([chunks[k][len(self.prefix) :] for k in whole], num_threads=1)
            same = all(ids[starts[k] : starts[k + 1]].tolist() == w for k, w in zip(whole, want, strict=True))
        if not same:
            raise RuntimeError("the agenda's ids differ from the library's")


class Encoder:
    """Encodes texts, with what it knows of chunks."""

    def __init__(self, path: str, cache_bytes: int = CACHE_BYTES):
        self.model, self.kept = Pieces(path), Kept(cache_bytes)

    def learn(self, chunks: set[str]) -> None:
        new = list(chunks)
        if not new:
            return
        ids, starts = self.model.agendas(new)
        self.model.check(new, ids, starts)
        flat, at = ids.astype("<u4").tobytes(), (starts * 4).tolist()
        self.kept.add({c: flat[at[k] : at[k + 1]] for k, c in enumerate(new)})

    def texts(self, texts: Iterable[str | None], batch_chars: int = BATCH_CHARS) -> Iterator[bytes]:
        """The ids of each text, without begin and end, as little-endian numbers."""
        block: list[list[str]] = []
        size = 0
        for t in texts:
            block.append(self.model.chunks(t or ""))
            size += len(t or "")
            if size >= batch_chars:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[str]]) -> Iterator[bytes]:
        self.learn(self.kept.missing({c for chunks in block for c in chunks}))
        get = self.kept.__getitem__
        for chunks in block:
            yield b"".join(map(get, chunks))
        self.kept.settle()


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each model in a worker, so that its cache outlives a task."""
    return Encoder(path)


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True, digests: bool = True) -> DataFrame:
    """doc_id and n_tokens (begin and end ids among them) of every row and, as wanted, its ids, the decoded text, both digests."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    fields = [("doc_id", pa.int64(), "long"), ("n_tokens", pa.int64(), "long")]
    fields += [("ids", pa.list_(pa.int32()), "array<int>")] * ids + [("decoded", pa.string(), "string")] * decoded
    fields += [("ids_sha256", pa.string(), "string"), ("decoded_sha256", pa.string(), "string")] * digests
    shape = pa.schema([f[:2] for f in fields])

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        e = encoder(path)
        sp = e.model.library
        begin, end = (np.array([k], "<u4").tobytes() for k in (sp.bos_id(), sp.eos_id()))
        numbers, texts, of_ids, of_text = [], [], [], []
        for inner in e.texts(strings(b["text"])):
            numbers.append(begin + inner + end)
            text = sp.decode(np.frombuffer(numbers[-1], "<u4").tolist()) if decoded or digests else ""
            if digests:
                of_ids.append(hashlib.sha256(numbers[-1]).hexdigest())
                of_text.append(hashlib.sha256(text.encode()).hexdigest())
            texts.append(text if decoded else "")
        counts = [len(x) // 4 for x in numbers]
        flat = pa.array(np.frombuffer(b"".join(numbers), "<i4")) if ids else None
        starts = pa.array(np.cumsum([0, *counts]), pa.int32())
        found = {"doc_id": b["doc_id"], "n_tokens": counts, "ids": ids and pa.ListArray.from_arrays(starts, flat), "decoded": texts, "ids_sha256": of_ids, "decoded_sha256": of_text}
        return pa.RecordBatch.from_arrays([x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield part(b.slice(k, ROWS))

    return map_in_arrow(rows, run, ", ".join(f"{name} {kind}" for name, _, kind in fields))


def op12_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), model_path(), ids=False, decoded=False)
