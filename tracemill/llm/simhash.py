"""SimHash near-duplicate detection over sharded BK-trees.

A fingerprint bit is 1 if it is set in over half of the hashes of a text's word shingles. Two
fingerprints link when they differ in at most RADIUS bits. By the pigeonhole principle, linked
fingerprints agree in at least one of RADIUS + 1 blocks of bits, so every distinct fingerprint goes to
one shard for each block; a shard that holds more than SHARD fingerprints is dealt again by the blocks
of the bits that are left, as often as needed, which loses no link. A shard's fingerprints form a
BK-tree: a child's key is its Hamming distance to the parent, and a search at distance d from a node
follows only the edges with keys d - RADIUS to d + RADIUS. Trees are built and searched level by level
with numpy, many shards at once. Trees aren't broadcast, as their size has no bound: each is built in
the task that searches it.

A shard gives the edges of a spanning star for each of its components, never all pairs. Rows of equal
fingerprints are one node throughout, so large groups of copies cost one node.

Defined results: a null or empty text has fingerprint 0, which links like any other; a text with fewer
words than a shingle is one shingle; a null doc_id takes part, and a component of nothing else has a
null component_id; repeated rows are returned one by one; an empty table gives no rows; texts are read
whole, hashes in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import located, map_in_arrow, strings, table, text_or_empty, written
from tracemill.llm.components import components

RADIUS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints in a shard beyond which it is dealt again.
SHARD = 1024
#: Times that a shard is dealt; 64 bits leave at most 18 after that.
LEVELS = 6
#: Pairs of a fingerprint and a tree node that a search holds at once.
FRONTIER = 1 << 20


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """The text's fingerprint as an unsigned number."""
    from xxhash import xxh64_intdigest

    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1][: max(1, len(words) - shingle + 1)]
    ends = ends[min(shingle, len(words)) - 1 :]
    ones, n = np.zeros(64, np.int64), len(starts)
    for k in range(0, n, 1 << 16):
        a, b = starts[k : k + (1 << 16)].tolist(), ends[k : k + (1 << 16)].tolist()
        h = np.fromiter([xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a, b, strict=True)], np.uint64, len(a))
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, and fp (the bits of the text's fingerprint as a signed number) of every row."""
    kept = ["doc_id", *keep]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *keep, text_or_empty().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t, shingle) for t in strings(b["text"])], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b[c] for c in kept), pa.array(fps)], [*kept, "fp"])

    return map_in_arrow(rows, run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", fp long")


# The trees. Arrays over the fingerprints of a task, all shards together.


def _popcount(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int64)


class Forest:
    """A BK-tree for each shard; shard: a number for each fingerprint, in ascending order; fp: unsigned."""

    def __init__(self, shard: np.ndarray, fp: np.ndarray):
        self.fp, n = fp, len(fp)
        self.parent, self.key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        first = np.r_[True, shard[1:] != shard[:-1]] if n else np.zeros(0, bool)
        self.root = np.flatnonzero(first)[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        left, at = np.flatnonzero(~first), self.root[~first]  # not placed yet, and the node that each has come to
        while len(left):
            d = _popcount(fp[left] ^ fp[at])
            slot = at * 65 + d
            _, chosen, back = np.unique(slot, return_index=True, return_inverse=True)
            placed = left[chosen]  # the first of those with the same parent and key becomes that child
            self.parent[placed], self.key[placed] = at[chosen], d[chosen]
            go = np.ones(len(left), bool)
            go[chosen] = False
            left, at = left[go], placed[back][go]
        self.order = np.lexsort((self.key, self.parent))
        self.slots = self.parent[self.order] * 65 + self.key[self.order]

    def search(self, radius: int = RADIUS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of members within the radius, in parts of bounded size; every pair at least once."""
        for k in range(0, len(self.fp), FRONTIER >> 8):
            work = [(np.arange(k, min(len(self.fp), k + (FRONTIER >> 8))), None)]
            while work:
                query, node = work.pop()
                node = self.root[query] if node is None else node
                d = _popcount(self.fp[query] ^ self.fp[node])
                near = (d <= radius) & (query != node)
                if near.any():
                    yield query[near], node[near]
                low = np.searchsorted(self.slots, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.slots, node * 65 + np.minimum(d + radius, 64), side="right")
                n = high - low
                for a, b in _parts(n):
                    m = n[a:b]
                    if m.sum():
                        step = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
                        work.append((np.repeat(query[a:b], m), self.order[np.repeat(low[a:b], m) + step]))


def _parts(n: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of n whose sums are about FRONTIER at most."""
    total, a = np.cumsum(n), 0
    while a < len(n):
        b = max(a + 1, int(np.searchsorted(total, (total[a - 1] if a else 0) + FRONTIER, side="right")))
        yield a, b
        a = b


def local_roots(shard: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """For each member, the index of a member that stands for its component within the shard."""
    root = np.arange(len(fp))

    def settle(r: np.ndarray) -> np.ndarray:
        while not (r == (up := r[r])).all():
            r = up
        return r

    for a, b in Forest(shard, fp).search():
        while True:
            x, y = root[a], root[b]
            if not (apart := x != y).any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            root = settle(root)
    return root


def _widths(bits: int) -> list[int]:
    return [bits // (RADIUS + 1) + (k < bits % (RADIUS + 1)) for k in range(RADIUS + 1)]


def _dealt(rows: DataFrame, bits: int) -> DataFrame:
    """rows: key, rest (the bits that aren't in the key), fp. A row for each block of rest: its own key, and rest without it."""
    rest, at, made = F.col("rest"), 0, []
    for k, w in enumerate(_widths(bits)):
        value = F.shiftrightunsigned(rest, at).bitwiseAND(F.lit((1 << w) - 1))
        without = rest.bitwiseAND(F.lit((1 << at) - 1)).bitwiseOR(F.shiftleft(F.shiftrightunsigned(rest, at + w), at)) if at + w < 64 else rest.bitwiseAND(F.lit((1 << at) - 1))
        made.append(F.struct(F.xxhash64("key", F.lit(k), value).alias("key"), without.alias("rest")))
        at += w
    return rows.select("fp", F.explode(F.array(*made)).alias("x")).select("x.key", "x.rest", "fp")


def links(distinct: DataFrame, shard_limit: int = SHARD) -> DataFrame:
    """distinct: fp. Edges u, v between linked fingerprints that hold every component of every shard together."""
    spark = distinct.sparkSession
    found, bits = None, 64
    rows = distinct.select(F.lit(0).cast("long").alias("key"), F.col("fp").alias("rest"), "fp")
    for level in range(LEVELS):
        rows = _dealt(rows, bits)
        bits -= min(_widths(bits))
        large = written(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > shard_limit).select("key"), "large-shards")
        if level == LEVELS - 1 or large.isEmpty():
            part, rows = rows, None
        else:
            rows = written(rows, "shards")
            part, rows = rows.join(large, "key", "left_anti"), rows.join(large, "key", "left_semi")
        found = part.select("key", "fp") if found is None else found.unionByName(part.select("key", "fp"))
        if rows is None:
            break
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_in_arrow(found.repartition(n, "key").sortWithinPartitions("key"), _stars, "u long, v long")


def _stars(batches: Iterator[pa.RecordBatch], at_once: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key; whole shards, about at_once rows together."""
    keys, fps, size = [], [], 0

    def flush(key: np.ndarray, fp: np.ndarray) -> pa.RecordBatch:
        root = local_roots(key, fp.view(np.uint64))
        own = root != np.arange(len(fp))
        edges = np.unique(np.stack([fp[own], fp[root[own]]], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], ["u", "v"])

    for b in batches:
        keys.append(b["key"].to_numpy())
        fps.append(b["fp"].to_numpy())
        size += b.num_rows
        if size >= at_once:
            key, fp = np.concatenate(keys), np.concatenate(fps)
            if cut := int(np.searchsorted(key, key[-1])):  # the last shard may go on
                yield flush(key[:cut], fp[:cut])
            keys, fps, size = [key[cut:]], [fp[cut:]], len(key) - cut
    if size:
        yield flush(np.concatenate(keys), np.concatenate(fps))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns to keep, fp, root (the component's least fingerprint), component_id and group_size of every row."""
    fps = written(fingerprints(docs, shingle, keep), "fingerprints")
    nodes = written(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "nodes")
    roots = components(links(nodes.select("fp")))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    groups = written(rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.sum("n").alias("group_size")), "groups")
    named = written(rooted.join(groups, "root").select("fp", "root", "component_id", "group_size"), "named")
    return fps.join(named, "fp")


def hexadecimal(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op3_simhash_bk_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", hexadecimal(F.col("fp")).alias("fingerprint"), "component_id", "group_size")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component, one document stays: that of the smallest doc_id.

    A null doc_id is less than any other; of rows that agree in it the one with the least text hash stays, and of
    repeated rows the one with the first place in the files. Null, empty and blank texts have the fingerprint 0 and
    so are copies of each other; texts of any length are read whole; no row of an empty table; further columns of
    any name are kept.
    """
    places = located(docs)
    rows = places.select(F.col("doc.doc_id").alias("doc_id"), F.col("doc.text").alias("text"), F.xxhash64(text_or_empty("doc.text")).alias("th"), "file", "row")
    grouped = written(near_duplicates(rows, keep=("th", "file", "row")).where("group_size > 1").select("root", "doc_id", "th", "file", "row"), "grouped")
    own = F.struct("doc_id", "th", "file", "row")
    keep = grouped.groupBy("root").agg(F.min(own).alias("keep"))
    # the rows that go are few; texts move only where they are too many to broadcast
    gone = written(grouped.join(keep, "root").where(~own.eqNullSafe(F.col("keep"))).select("file", "row"), "gone")
    return places.join(gone, ["file", "row"], "left_anti").select("doc.*")
