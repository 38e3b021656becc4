"""Spelling variants: words at edit distance one, found by a self-join of the vocabulary's trie.

Two words at distance one agree before the first place where they differ and, one code point aside, behind it. The
vocabulary trie is partitioned by prefixes. Below a prefix of ``FIRST`` code points the subtrie is one group; a group
of more than ``GROUP`` words is cut again ``STEP`` code points deeper. Pairs that differ behind the prefix are in one
group. For those that differ within a cut, words meet at what follows the cut (with and without one more code point
inside of it), and the trie of the few code points within the cut is joined; such a group holds no more than the
strings of that length. So no group grows with the input, and each pair is found in exactly one.

A task joins many groups' tries at once, level by level. A node's active set holds the nodes that one edit separates
from it: a sibling by a replaced code point, a child by an inserted one, and below such a pair the children with the
same code point. The sets go down with the trie in arrays; pairs of ends of words are emitted.

Defined results: a null or empty text has no words; a null doc_id counts as an empty string before the colon; repeated
rows count each; texts and words of any length are whole; an empty table, or one without words that occur twice, gives
no rows; further columns of any name are left out. Of near words with the same largest n the smallest in code-point
order is the form. Forms grow tenfold at each step, so that chains are short and have no cycles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import map_in_arrow, table, text_or_empty, written

RUN = "[A-Za-z\\u00C0-\\u00FF]+"
LEAST_LENGTH, LEAST_COUNT, RATIO, TYPO = 7, 2, 10, 31
FIRST, STEP = 3, 2
#: Words of a subtrie that one task joins; a larger one is cut deeper.
GROUP = 50_000
#: Rows whose tries a task joins together; whole groups.
CHUNK = 100_000


def vocabulary(docs: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n: the runs of letters, lower-cased, one in TYPO of them without one of its code points."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(text_or_empty("text"), F.lit(RUN), F.lit(0))).alias("run"))
    runs = runs.where(F.length("run") >= least_length).select("key", F.translate("run", upper, lower).alias("run"))
    runs = runs.select("run", F.crc32(F.concat("key", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    words = runs.select(F.when(F.col("h") % TYPO == 0, cut).otherwise(F.col("run")).alias("word")).where(F.length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _from(word: Column, start: int) -> Column:
    """What follows the first ``start`` code points."""
    return F.substring(word, F.lit(start + 1), F.length(word))


def _within(words: DataFrame, start: int, end: int) -> DataFrame:
    """Rows for pairs that differ at a place in [start, end): the words by what follows the cut, with tag 1, and by
    what follows one code point more, with tag 2."""
    w = F.col("word")

    def one(tag: int) -> Column:
        stop = end + tag - 1
        group = F.concat(F.lit(f"{start} {end} "), F.substring(w, 1, start), F.lit(" "), _from(w, stop))
        body = F.substring(w, start + 1, stop - start)
        return F.struct(group.alias("group"), body.alias("body"), F.lit(tag).alias("tag"), (F.length(w) >= end).alias("full"))

    return words.select("word", "n", F.explode(F.array(one(1), one(2))).alias("x")).select("x.*", "word", "n")


def dealt(words: DataFrame, group: int = GROUP) -> DataFrame:
    """group, body, tag, full, word, n: the rows of every trie that is to be joined."""
    active, depth = words, FIRST
    parts = [_within(words, 0, FIRST)]
    while True:
        prefix = F.substring("word", 1, depth)
        hot = written(active.groupBy(prefix.alias("prefix")).agg(F.count("*").alias("words")).where(F.col("words") > group), "hot-prefixes")
        some = not hot.isEmpty()
        ending = active.join(hot, prefix == hot["prefix"], "left_anti") if some else active
        parts.append(ending.select(F.concat(F.lit(f"{depth} "), prefix).alias("group"), _from(F.col("word"), depth).alias("body"), F.lit(0).alias("tag"), F.lit(False).alias("full"), "word", "n"))
        if not some:
            break
        active = active.join(hot, prefix == hot["prefix"], "left_semi")
        parts.append(_within(active, depth, depth + STEP))
        depth += STEP
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


class Trie:
    """The tries of rows sorted by group and body, level by level; a node's children are neighbours."""

    def __init__(self, group: np.ndarray, bodies: list[str], tag: np.ndarray):
        rows = len(bodies)
        size = np.array([len(b) for b in bodies], np.int64)
        points = np.frombuffer("".join(bodies).encode("utf-32-le", "surrogatepass"), "<u4")
        letters, letter = np.unique(points, return_inverse=True)
        self.base = len(letters) + 1
        start = np.cumsum(size) - size
        node = np.cumsum(np.r_[True, group[1:] != group[:-1]]) - 1 if rows else np.empty(0, np.int64)
        self.levels, total = [0], int(node[-1]) + 1 if rows else 0
        parent, char, ends = [np.full(total, -1)], [np.full(total, -1)], [(np.flatnonzero(size == 0), node[size == 0])]
        alive, depth = np.flatnonzero(size > 0), 0
        node = node[size > 0]
        while len(alive):
            self.levels.append(total)
            c = letter[start[alive] + depth]
            fresh = np.r_[True, (node[1:] != node[:-1]) | (c[1:] != c[:-1])]
            parent.append(node[fresh])
            char.append(c[fresh])
            node = total + np.cumsum(fresh) - 1
            total += int(fresh.sum())
            depth += 1
            over = size[alive] == depth
            ends.append((alive[over], node[over]))
            alive, node = alive[~over], node[~over]
        self.levels.append(total)
        self.parent, self.char = np.concatenate(parent), np.concatenate(char)
        self.key = self.parent * self.base + self.char  # ascends with the number of the node
        self.children = np.bincount(self.parent[self.parent >= 0], minlength=total)
        self.first = np.searchsorted(self.parent, np.arange(total))
        row, at = (np.concatenate([e[k] for e in ends]) for k in (0, 1))
        #: The row that ends at a node: the shorter side of a pair, and the longer one.
        self.short, self.long = np.full(total, -1), np.full(total, -1)
        plain = tag[row] != 2
        self.short[at[plain]] = row[plain]
        longer = tag[row] != 1
        self.long[at[longer]] = row[longer]

    def below(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes' children, and which of the nodes each is below."""
        n = self.children[nodes]
        of = np.repeat(np.arange(len(nodes)), n)
        return self.first[nodes][of] + np.arange(len(of)) - (np.cumsum(n) - n)[of], of

    def down(self, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of the children of u and v that have the same code point."""
        a, of = self.below(u)
        key = v[of] * self.base + self.char[a]
        b = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        same = self.key[b] == key
        return a[same], b[same]

    def siblings(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of two children of one node; a node has no more than there are letters."""
        a, of = self.below(nodes)
        last = (self.first + self.children)[nodes][of]
        n = last - a - 1
        at = np.repeat(np.arange(len(a)), n)
        return a[at], a[at] + 1 + np.arange(len(at)) - (np.cumsum(n) - n)[at]

    def pairs(self, full: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows at distance one, level by level; full: rows whose body goes on behind the cut."""
        none = np.empty(0, np.int64)
        replaced, inserted = (none, none), (none, none)
        for d in range(len(self.levels) - 1):
            nodes = np.arange(self.levels[d], self.levels[d + 1])
            if d:
                new = self.siblings(np.arange(self.levels[d - 1], self.levels[d]))
                replaced = tuple(map(np.concatenate, zip(self.down(*replaced), new, strict=True)))
                a, b = self.down(*inserted)
                other = self.parent[b] != a  # those are the node's own children, entered below
                inserted = a[other], b[other]
            child, of = self.below(nodes)
            inserted = np.concatenate([inserted[0], nodes[of]]), np.concatenate([inserted[1], child])
            r, s = self.short[replaced[0]], self.short[replaced[1]]
            found = (r >= 0) & (s >= 0)
            yield r[found], s[found]
            r, s = self.short[inserted[0]], self.long[inserted[1]]
            found = (r >= 0) & (s >= 0)
            # a body that is a prefix of the other goes on behind the cut: the words differ there, not within it
            found &= ~((self.parent[inserted[1]] == inserted[0]) & full[np.maximum(r, 0)])
            yield r[found], s[found]


def joined(rows: pa.Table) -> pa.RecordBatch | None:
    """The pairs of whole groups' rows."""
    group = rows["group"].combine_chunks().dictionary_encode().indices.to_numpy()
    trie = Trie(group, rows["body"].to_pylist(), rows["tag"].to_numpy())
    found = list(trie.pairs(rows["full"].to_numpy(zero_copy_only=False)))
    a, b = (pa.array(np.concatenate([f[k] for f in found])) for k in (0, 1))
    if not len(a):
        return None
    word, n = rows["word"].combine_chunks(), rows["n"].combine_chunks()
    return pa.RecordBatch.from_arrays([word.take(a), n.take(a), word.take(b), n.take(b)], names=["a", "an", "b", "bn"])


def near_pairs(words: DataFrame, group: int = GROUP, chunk: int = CHUNK) -> DataFrame:
    """words: word, n. Returns a, an, b, bn: every pair of words at distance one, once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0
        for b in batches:
            held.append(b)
            rows += b.num_rows
            if rows < chunk:
                continue
            whole = pa.Table.from_batches(held)
            names = whole["group"].combine_chunks()
            last = names[len(names) - 1].as_py()
            lo, hi = 0, len(names) - 1  # where the last group begins: it may go on
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (lo, mid) if names[mid].as_py() == last else (mid + 1, hi)
            if lo and (out := joined(whole.slice(0, lo))):
                yield out
            held = whole.slice(lo).combine_chunks().to_batches()
            rows = len(names) - lo
        if rows and (out := joined(pa.Table.from_batches(held))):
            yield out

    rows = dealt(words, group).repartition("group").sortWithinPartitions("group", "body")
    return map_in_arrow(rows, run, "a string, an long, b string, bn long")


def forms(words: DataFrame, ratio: int = RATIO, group: int = GROUP) -> DataFrame:
    """words: word, n. Returns word, n, n_near, form, form_n."""
    p = near_pairs(words, group)
    sides = F.array(F.struct(F.col("a").alias("word"), F.struct((-F.col("bn")).alias("m"), F.col("b").alias("form")).alias("best")), F.struct(F.col("b").alias("word"), F.struct((-F.col("an")).alias("m"), F.col("a").alias("form")).alias("best")))
    near = p.select(F.explode(sides).alias("x")).select("x.*").groupBy("word").agg(F.count("*").alias("n_near"), F.min("best").alias("best"))
    taken = -F.col("best.m") >= ratio * F.col("n")
    return words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(taken, F.col("best.form")).alias("form"),
        F.when(taken, -F.col("best.m")).alias("form_n"),
    )


def variants(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word."""
    words = written(vocabulary(docs), "vocabulary")
    known = written(forms(words, group=group), "forms")
    links = known.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    most = known.agg(F.max("n")).first()[0] or 1
    # n grows by the ratio along a chain, so its length is known, and each round doubles what has been followed
    for _ in range(math.ceil(math.log2(max(1.0, math.log(most, RATIO)))) + 1):
        links = written(links.alias("l").join(links.alias("r"), F.col("l.root") == F.col("r.word"), "left").select("l.word", F.coalesce("r.root", "l.root").alias("root")), "roots")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))


#: CRC-32 byte by byte from its table, pairs by one code point left out of a word, chains by recursion.
ORACLE_SQL = f"""
WITH RECURSIVE steps AS MATERIALIZED (
  SELECT list(c ORDER BY b) AS t
  FROM (SELECT b, list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM range(256) r(b))
),
runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc,
         unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[A-Za-z\\x{{00C0}}-\\x{{00FF}}]+')) AS run
  FROM documents
),
counted AS (SELECT doc, run, count(*) AS n, hex(encode(concat(doc, ':', run))) AS bytes FROM runs WHERE length(run) >= {LEAST_LENGTH} GROUP BY doc, run),
hashed AS (
  SELECT run, n, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(1, len(bytes) + 1, 2), lambda k: CAST('0x' || substr(bytes, k, 2) AS BIGINT))),
                                 lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS h
  FROM counted, steps
),
words AS MATERIALIZED (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % {TYPO} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed)
  WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING sum(n) >= {LEAST_COUNT}
),
less AS MATERIALIZED (
  SELECT word, n, k, substr(word, 1, k) || substr(word, k + 2) AS rest FROM (SELECT word, n, unnest(range(length(word))) AS k FROM words)
),
pairs AS (
  SELECT a.word, a.n, b.word AS other, b.n AS m FROM less a JOIN less b ON a.rest = b.rest AND a.k = b.k AND a.word <> b.word
  UNION SELECT l.word, l.n, w.word, w.n FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, w.n, l.word, l.n FROM less l JOIN words w ON w.word = l.rest
),
near AS (SELECT word, n, count(*) AS n_near, max(m) AS m, arg_min(other, (-m, other)) AS other FROM pairs GROUP BY word, n),
known AS MATERIALIZED (
  SELECT w.word, w.n, coalesce(p.n_near, 0) AS n_near, CASE WHEN p.m >= {RATIO} * w.n THEN p.other END AS form, CASE WHEN p.m >= {RATIO} * w.n THEN p.m END AS form_n
  FROM words w LEFT JOIN near p USING (word)
),
chain AS (
  SELECT word, form AS root, 1 AS step FROM known WHERE form IS NOT NULL
  UNION ALL SELECT c.word, k.form, c.step + 1 FROM chain c JOIN known k ON k.word = c.root WHERE k.form IS NOT NULL
),
last AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT k.word, k.form, coalesce(l.root, k.word) AS root, k.n, k.n_near, k.form_n FROM known k LEFT JOIN last l USING (word)
"""
