"""BPE encoding and decoding by speculation and verification.

A word's tokens are proposed by greedy longest match over the vocabulary. A proposal is the true
encoding exactly if every two neighbours are compatible, that is, if merging their joined symbols
gives the two back; that test is done for all distinct neighbours of a batch at once, by undoing the
latest merge on either side of the seam and looking for an earlier merge across it. Only words with
an incompatible pair, or without a proposal, undergo exact merging. Distinct words are encoded once
for each batch and kept in a bounded cache.

Normalisation and splitting follow the tokenizer's file: plain Latin words take a short path, all
other ones the library's own normaliser and splitter; no library model is asked for tokens.

Defined results: a null text is empty and has no token; a text of white space only has none; literal
special tokens become their ids, as in the library; repeated rows are encoded one by one; an empty
table gives no rows; texts are encoded whole, in pieces of words, so memory is bounded by one text
and one batch of distinct words.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tracemill.llm.common import map_in_arrow, strings, table, text_or_empty

#: White-space-free stretches of printable ASCII and composed Latin-1 letters: lower-casing and
#: splitting them needs no tables of Unicode.
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿß]+")
_PIECES = re.compile("'(?:s|t|re|ve|m|ll|d)|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
#: The file's normaliser and splitter that _SIMPLE and _PIECES stand for; others take the library's.
_KNOWN_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Bytes, about, that a worker keeps for chunks and for pieces that it has seen; longer ones than LONG_ENTRY aren't kept.
CACHE_BYTES = 64 << 20
LONG_ENTRY = 256
#: Bytes of an entry besides its key: two objects, their parts, and their slot.
ENTRY_BYTES = 250
#: Characters of text whose chunks are encoded together.
BATCH_CHARS = 1 << 21
_NEVER = np.iinfo(np.int64).max


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    kept = set(own)
    return [chr(b) if b in kept else chr(next(rest)) for b in range(256)]


class Splitter:
    """Cuts white-space-free chunks into the byte-symbol pieces that BPE works on, and finds special tokens."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_mark = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        parts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self.known = parts[0].get("pattern", {}).get("Regex") == _KNOWN_SPLIT
        self.symbols = byte_symbols()

    def pieces(self, chunk: str) -> list[str | int]:
        """A chunk's pieces in byte symbols; special tokens as their ids."""
        if self.special_mark and self.special_mark.search(chunk):
            out, at = [], 0
            for m in self.special_mark.finditer(chunk):
                out += self._plain(chunk[at : m.start()]) + [self.special[m[0]]]
                at = m.end()
            return out + self._plain(chunk[at:])
        return self._plain(chunk)

    def _plain(self, chunk: str) -> list[str]:
        if self.known and _SIMPLE.fullmatch(chunk):
            found = _PIECES.findall(chunk.lower())
            if chunk.isascii():
                return found
            return ["".join([self.symbols[b] for b in p.encode()]) for p in found]
        if not chunk:
            return []
        normal = self.library.normalizer.normalize_str(chunk) if self.library.normalizer else unicodedata.normalize("NFC", chunk)
        return [p for p, _ in self.library.pre_tokenizer.pre_tokenize_str(normal)]


class Vocabulary:
    """Tokens, merges and the pair test."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.ids: dict[str, int] = model["vocab"]
        size = max([*self.ids.values(), *(t["id"] for t in spec["added_tokens"])]) + 1
        self.text = [""] * size
        for token, i in [*self.ids.items(), *((t["content"], t["id"]) for t in spec["added_tokens"])]:
            self.text[i] = token
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank = {(self.ids[a], self.ids[b]): (r, self.ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.made = np.full(size, -1, np.int64)  # the rank of the merge that makes a token; -1: a symbol
        self.left = np.arange(size)
        self.right = np.arange(size)
        for (a, b), (r, t) in self.rank.items():
            if self.made[t] < 0:
                self.made[t], self.left[t], self.right[t] = r, a, b
        keys = np.array([a * size + b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.size, self.keys, self.ranks = size, keys[order], np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.products = np.array([t for _, t in self.rank.values()], np.int64)[order]
        # a token that merging its own symbols doesn't give is never proposed
        self.open: dict[str, int] = {}
        self.closing: dict[str, int] = {}
        for token, i in self.ids.items():
            closed = bool(self.suffix) and token.endswith(self.suffix)
            word = token[: -len(self.suffix)] if closed else token
            if word and self.merge(list(word[:-1]) + [word[-1] + self.suffix * closed]) == [i]:
                (self.closing if closed or not self.suffix else self.open)[word] = i
                if not self.suffix:
                    self.open[word] = i
        self.reach: dict[str, int] = {}  # the longest token with these first two characters
        for token in [*self.open, *self.closing]:
            self.reach[token[:2]] = max(self.reach.get(token[:2], 1), len(token))

    def merge(self, symbols: list[str]) -> list[int]:
        """Exact merging of one word with a heap: always the earliest-ranked pair, the leftmost of equal ones."""
        ids = [self.ids[s] for s in symbols if s in self.ids]
        n = len(ids)
        after, before = [*range(1, n), -1][:n], list(range(-1, n - 1))
        heap = [(self.rank[p][0], k, p) for k, p in enumerate(zip(ids, ids[1:], strict=False)) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, k, pair = heapq.heappop(heap)
            if ids[k] != pair[0] or (j := after[k]) < 0 or ids[j] != pair[1]:
                continue  # one of the two has been merged meanwhile
            ids[k], ids[j] = self.rank[pair][1], -1
            after[k] = after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (p := (ids[x], ids[y])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], x, p))
        return [i for i in ids if i >= 0]

    def merge_words(self, words: list[str]) -> list[list[int]]:
        """Exact merging of many words, one merge in each at a time; long words one by one."""
        out: list[list[int]] = [self.merge_word(w) if len(w) > 48 else [] for w in words]
        short = [k for k, w in enumerate(words) if len(w) <= 48]
        symbols = [[*words[k][:-1], words[k][-1] + self.suffix] for k in short]
        ids = np.array([self.ids.get(c, -1) for ss in symbols for c in ss], np.int64)
        word = np.repeat(np.array(short, np.int64), [len(ss) for ss in symbols])
        word, ids = word[ids >= 0], ids[ids >= 0]
        while len(ids):
            keys = ids[:-1] * self.size + ids[1:]
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            rank = np.full(len(ids), _NEVER)
            rank[:-1] = np.where((self.keys[k] == keys) & (word[:-1] == word[1:]), self.ranks[k], _NEVER)
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.r_[starts, len(ids)])
            done = np.repeat(least == _NEVER, sizes)
            for s, n in zip(starts[least == _NEVER].tolist(), sizes[least == _NEVER].tolist(), strict=True):
                out[word[s]] = ids[s : s + n].tolist()
            at = np.flatnonzero((rank == np.repeat(least, sizes)) & ~done)
            at = at[np.r_[True, word[at][1:] != word[at][:-1]]] if len(at) else at
            ids[at] = self.products[k[at]]
            keep = ~done
            keep[at + 1] = False
            ids, word = ids[keep], word[keep]
        return out

    def merge_word(self, word: str) -> list[int]:
        return self.merge([*word[:-1], word[-1] + self.suffix])

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match, the last token being one that closes a word."""
        out, at, n = [], 0, len(word)
        while at < n:
            reach = self.reach.get(word[at : at + 2], 1)
            if n - at <= reach and (t := self.closing.get(word[at:])) is not None:
                return [*out, t]
            for end in range(min(n - 1, at + reach), at, -1):
                if (t := self.open.get(word[at:end])) is not None:
                    break
            else:
                return None
            out.append(t)
            at = end
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether they stay apart when their joined symbols are merged."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)  # a merge across the seam of a rank below comes first
        while len(at):
            keys = a * self.size + b
            k = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
            crossed = (self.keys[k] == keys) & (self.ranks[k] < limit) if len(self.keys) else np.zeros(len(at), bool)
            good[at[crossed]] = False
            undo_left = self.made[a] > self.made[b]
            rank = np.where(undo_left, self.made[a], self.made[b])
            go = ~crossed & (rank >= 0)
            # on the left, the leftmost of equal merges comes first, so that one across the seam of the same rank comes later
            limit = np.where(undo_left, rank, rank + 1)[go]
            a, b, at = np.where(undo_left, self.right[a], a)[go], np.where(undo_left, b, self.left[b])[go], at[go]
        return good

    def encode_words(self, words: list[str]) -> list[list[int]]:
        """The words' tokens: proposals, the pair test for all of them at once, exact merging for the rest."""
        proposals = [self.propose(w) for w in words]
        owner = np.repeat(np.arange(len(words)), [max(0, len(p) - 1) if p else 0 for p in proposals])
        left = np.array([t for p in proposals if p for t in p[:-1]], np.int64)
        right = np.array([t for p in proposals if p for t in p[1:]], np.int64)
        failed = np.zeros(len(words), bool)
        if len(left):
            pairs, back = np.unique(left * self.size + right, return_inverse=True)
            failed[owner[~self.compatible(pairs // self.size, pairs % self.size)[back]]] = True
        wrong = [k for k, p in enumerate(proposals) if p is None or failed[k]]
        for k, ids in zip(wrong, self.merge_words([words[k] for k in wrong]), strict=True):
            proposals[k] = ids
        return proposals


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One for all encoders of a worker."""
    return Vocabulary(path)


class Kept(dict):
    """What a worker keeps, in two generations of half the bytes each: what is met again moves to the young one,
    and when that is full the old one goes. Long keys stay until the next ``settle`` only.

    ``kept[key]`` makes what it lacks, one by one; ``missing`` and ``add`` are for keys that are made together.
    """

    def __init__(self, limit: int, make: Callable | None = None):
        super().__init__()
        self.limit, self.make, self.old, self.size, self.long = limit, make, {}, 0, []

    def __missing__(self, key):
        value = self.old.pop(key, None)
        if value is None:
            value = self.make(key)
        self[key] = value
        if len(key) > LONG_ENTRY:
            self.long.append(key)
        self.size += ENTRY_BYTES + 5 * len(key)
        return value

    def missing(self, keys: set) -> set:
        """Those of the keys that are unknown; the known ones are in the young generation then."""
        new = keys.difference(self)
        if self.old:
            again = {k: self.old.pop(k) for k in new.intersection(self.old)}
            self.add(again)
            new.difference_update(again)
        return new

    def add(self, made: dict) -> None:
        self.update(made)
        self.size += ENTRY_BYTES * len(made) + 5 * sum(map(len, made))
        self.long += [k for k in made if len(k) > LONG_ENTRY]

    def settle(self) -> None:
        """Ends a batch: only now may something go."""
        for k in self.long:
            self.pop(k, None)
        self.long = []
        if self.size > self.limit // 2:
            self.old = dict(self)
            self.clear()
            self.size = 0


class Encoder:
    """Encodes texts; ``render`` turns a chunk's ids into what is kept for it, ready to be joined."""

    def __init__(self, path: str, render: Callable[[list[int]], object], cache_bytes: int = CACHE_BYTES):
        self.splitter, self.render = Splitter(path), render
        self.vocabulary = vocabulary(path)
        self.kept, self.pieces = Kept(cache_bytes), Kept(cache_bytes)

    def learn(self, chunks: set[bytes]) -> None:
        """Encodes the chunks that aren't kept yet, their distinct pieces at once."""
        split = {c: self.splitter.pieces(c.decode()) for c in chunks}
        words = list(self.pieces.missing({p for ps in split.values() for p in ps if isinstance(p, str)}))
        self.pieces.add(dict(zip(words, self.vocabulary.encode_words(words), strict=True)))
        ids, render = self.pieces, self.render
        self.kept.add({c: render(ids[ps[0]] if len(ps) == 1 and ps[0] in ids else [i for p in ps for i in ([p] if isinstance(p, int) else ids[p])]) for c, ps in split.items()})

    def texts(self, texts: Iterable[str | None], batch_chars: int = BATCH_CHARS) -> Iterator[list]:
        """For each text, what is kept for its chunks in order."""
        block: list[list[bytes]] = []
        size = 0
        for t in texts:
            block.append((t or "").encode("utf-8", "replace").split())
            size += len(t or "")
            if size >= batch_chars:
                yield from self._block(block)
                block, size = [], 0
        yield from self._block(block)

    def _block(self, block: list[list[bytes]]) -> Iterator[list]:
        self.learn(self.kept.missing({c for chunks in block for c in chunks}))
        kept = self.kept
        for chunks in block:
            yield [kept[c] for c in chunks]
        self.kept.settle()
        self.pieces.settle()


def rendered(vocabulary_text: list[str]) -> Callable[[list[int]], tuple[bytes, bytes, bytes]]:
    """Renders ids as little-endian numbers, and as their decimals and their tokens, each joined by one space."""
    return lambda ids: (struct.pack(f"<{len(ids)}I", *ids), " ".join(map(str, ids)).encode(), " ".join([vocabulary_text[i] for i in ids]).encode())


def decode(vocabulary_text: list[str], ids: list[int]) -> str:
    """As the library decodes for a file without a decoder: tokens joined by one space."""
    return " ".join([vocabulary_text[i] for i in ids if i < len(vocabulary_text)])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder for each file in a worker, so that its cache outlives a task."""
    e = Encoder(path, list)
    e.render = rendered(e.vocabulary.text)
    return e


#: Rows that are encoded before their results are sent on.
ROWS = 1024


def encode(docs: DataFrame, path: str, ids: bool = True, decoded: bool = True, digests: bool = True) -> DataFrame:
    """doc_id and n_tokens of every row and, as wanted, its ids, the decoded text, and the digests of both."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] * ids + [("decoded", pa.string())] * decoded + [("ids_sha256", pa.string()), ("decoded_sha256", pa.string())] * digests
    shape = pa.schema(fields)

    def part(b: pa.RecordBatch) -> pa.RecordBatch:
        numbers, counts, texts, of_ids, of_text = [], [], [], [], []
        for chunks in encoder(path).texts(strings(b["text"])):
            chunks = [c for c in chunks if c[0]]  # a chunk may hold nothing that the normaliser keeps
            numbers.append(b"".join([c[0] for c in chunks]))
            counts.append(len(numbers[-1]) // 4)
            text = b" ".join([c[2] for c in chunks]) if decoded or digests else b""
            if digests:
                of_ids.append(hashlib.sha256(b" ".join([c[1] for c in chunks])).hexdigest())
                of_text.append(hashlib.sha256(text).hexdigest())
            texts.append(text.decode() if decoded else "")
        flat = pa.array(np.frombuffer(b"".join(numbers), "<i4")) if ids else None
        starts = pa.array(np.cumsum([0, *counts]), pa.int32())
        found = {"doc_id": b["doc_id"], "n_tokens": counts, "ids": ids and pa.ListArray.from_arrays(starts, flat), "decoded": texts, "ids_sha256": of_ids, "decoded_sha256": of_text}
        return pa.RecordBatch.from_arrays([x if isinstance(x := found[f.name], pa.Array) else pa.array(x, f.type) for f in shape], schema=shape)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, ROWS):
                yield part(b.slice(k, ROWS))

    names = {pa.int64(): "long", pa.string(): "string", pa.list_(pa.int32()): "array<int>"}
    return map_in_arrow(rows, run, ", ".join(f"{name} {names[kind]}" for name, kind in fields))


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens and the digests of the ids and of the decoded text, for every row."""
    return encode(docs, path, ids=False, decoded=False)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokenizer_path())


def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last one: the ids of every document that is left, their number, and the digests.

    A row for each row, repeated ones included; a null doc_id stays null; a null, empty or blank text has no ids;
    texts of any length are encoded whole; no row of an empty table; further columns of any name are left out.
    """
    return encode(docs, tokenizer_path(), decoded=False)
