"""Hashed TF-IDF embeddings, exact neighbours in blocks, identical vectors, density clusters, alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.sources.shipping import ship

#: A word of an embedding: back-ticked code, or a run that begins with a letter.
WORD = "`[^`]{1,60}`|[a-z][a-z0-9_./:-]{1,40}"
#: FNV-1a, 32 bits: fixed values of the published hash.
FNV_OFFSET, FNV_PRIME = 2166136261, 16777619
#: A word is common if it has one in so many of all pairs of a text and one of its words; so many words at most can be.
COMMON = 1 << 19
#: Classes of ids by hash: which of them hold an id of several texts is broadcast.
CLASSES = 1 << 18
#: Queries whose similarities to a block are held at once.
STRIP = 128
#: Components of a block's vectors; up to so many blocks a side of at least so many rows, to have tasks.
VALUES, SIDES, LEAST = 1 << 21, 4, 4096
FOUND = "id long, neighbour long, similarity double"


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def fnv1a(word: Column) -> Column:
    """FNV-1a over the UTF-16 units of a word; equal to the hash of the bytes for ASCII words."""
    raw = F.hex(F.encode(word, "UTF-16BE"))
    units = F.transform(F.sequence(F.lit(1), F.length(raw) - 3, F.lit(4)), lambda k: F.conv(F.substring(raw, k, F.lit(4)), 16, 10).cast("long"))
    plain = F.transform(F.filter(F.split(word, ""), lambda c: c != ""), lambda c: F.ascii(c).cast("long"))
    codes = F.when(word.rlike("[^\\x{0}-\\x{FFFF}]"), units).otherwise(plain)
    # the product of two 32-bit numbers exceeds 63 bits in part: multiply by halves
    step = lambda h, c: ((h.bitwiseXOR(c) * F.lit(FNV_PRIME & 0xFFFF)) + F.shiftleft(h.bitwiseXOR(c) * F.lit(FNV_PRIME >> 16), 16)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(codes, F.lit(FNV_OFFSET).cast("long"), step)


def counted(words: Column) -> Column:
    """Each distinct word of an array, and how often it is there: runs of equal words in the sorted array."""
    starts = lambda s: F.array_compact(F.transform(s, lambda w, k: F.when((k == 0) | (w != F.get(s, k - 1)), k)))
    runs = lambda s, at: F.transform(at, lambda k, j: F.struct(F.get(s, k).alias("word"), (F.coalesce(F.get(at, j + 1), F.size(s)) - k).cast("long").alias("tf")))
    # an array of one holds what a lambda uses more than once
    return F.transform(F.array(F.sort_array(words)), lambda s: F.transform(F.array(starts(s)), lambda at: runs(s, at))[0])[0]


def hashed_tfidf(texts: DataFrame, id: str, text: str, dimensions: int) -> DataFrame:
    """id, slot, weight: log-tf times smoothed idf, added with the hash's sign into the slots and scaled to length 1.

    A text's words are counted in its row, so that no exchange holds all pairs of a text and a word; the counts of texts
    that share an id meet in one, with those of ids of the same hash classes. Common words get their document frequency
    by a broadcast and add up to slots before any exchange; pairs with other words are joined by the word. A word is
    hashed once, where its document frequency is counted, not once for each text. Texts without a word that weighs
    anything have no rows.
    """

    def pairs_of(rows: DataFrame) -> DataFrame:
        return rows.select(id, F.inline(counted(words(F.col(text))))).where(F.col("word").isNotNull())  # never null; said so that all uses share an exchange

    classed = texts.select(id, text, F.pmod(F.xxhash64(id), F.lit(CLASSES)).alias("__class"))
    shared = classed.groupBy(id, "__class").count().where(F.col("count") > 1).select("__class").distinct()  # CLASSES rows at most
    if shared.isEmpty():
        tf = pairs_of(texts)
    else:
        apart, together = (pairs_of(classed.join(F.broadcast(shared), "__class", how)) for how in ("left_anti", "left_semi"))
        tf = apart.unionByName(together.groupBy(id, "word").agg(F.sum("tf").alias("tf")))
    df = tf.groupBy("word").agg(F.count("*").alias("df"))
    pairs = df.agg(F.sum("df").alias("pairs"))
    ranked = df.crossJoin(F.broadcast(pairs)).withColumn("common", F.col("df") * COMMON >= F.col("pairs"))  # one row
    common, others = (ranked.where(c).select("word", "df", fnv1a(F.col("word")).alias("h")) for c in (F.col("common"), ~F.col("common")))
    common = F.broadcast(common)  # COMMON words at most
    rows = tf.join(common, "word").unionByName(tf.join(common, "word", "left_anti").join(others, "word"))
    rows = rows.crossJoin(F.broadcast(texts.agg(F.count("*").alias("n"))))  # one row
    sign = F.when(F.col("h") >= 1 << 31, -1).otherwise(1)
    weight = (1 + F.log("tf")) * F.log((1 + F.col("n")) / (1 + F.col("df"))) * sign
    slots = rows.select(id, (F.col("h") % dimensions).alias("slot"), weight.alias("w")).groupBy(id, "slot").agg(F.sum("w").alias("w"))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(W.partitionBy(id)))
    return slots.withColumn("__norm", norm).select(id, "slot", F.when(F.col("__norm") > 0, F.col("w") / F.col("__norm")).otherwise(0.0).alias("weight"))


def densify(slots: DataFrame, id: str, dimensions: int) -> DataFrame:
    entries = F.map_from_entries(F.collect_list(F.struct("slot", "weight")))
    zeros = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at(F.col("__m"), k.cast("long")), F.lit(0.0)).cast("float"))
    return slots.groupBy(id).agg(entries.alias("__m")).select(id, zeros.alias("embedding"))


def best_of(own: np.ndarray, x: np.ndarray, ids: np.ndarray, y: np.ndarray, keep: int) -> pd.DataFrame:
    """Of each query (ids ``own``, vectors ``x``) the ``keep`` rows of another id whose cosine is the greatest, ties by id.

    Products of unit vectors in single precision, a strip of queries at a time, tell which rows can be among the best: the
    ``keep``-th of the greatest of disjoint groups is no more than the ``keep``-th of all. The cosines of those rows are
    added up component by component in double precision, so that equal vectors are equally near wherever they stand.
    """
    order = np.argsort(ids, kind="stable")
    ids, y = ids[order], y[order]
    x_squares, y_squares = (np.add.accumulate(m * m, axis=1)[:, -1] for m in (x, y))
    u, w = ((m / np.maximum(np.sqrt(n), 1e-300)[:, None]).astype(np.float32) for m, n in ((x, x_squares), (y, y_squares)))
    lost, bare = np.flatnonzero(~np.isfinite(y_squares)), ~np.isfinite(x_squares)
    first, last = np.searchsorted(ids, own, "left"), np.searchsorted(ids, own, "right")
    rounding = np.float32(2 * (x.shape[1] + 2) * np.finfo(np.float32).eps)
    groups = max(512, 2 * keep)
    parts = [pd.DataFrame({"id": own[:0], "neighbour": ids[:0], "similarity": np.empty(0)})]
    for at in range(0, len(x), STRIP):
        s = u[at : at + STRIP] @ w.T
        s[:, lost] = -np.inf
        s[bare[at : at + STRIP]] = -np.inf
        for row in np.flatnonzero((last > first)[at : at + STRIP]):
            s[row, first[at + row] : last[at + row]] = -np.inf
        deep = s.shape[1] // groups
        tops = np.hstack([s[:, : deep * groups].reshape(len(s), deep, groups).max(1), s[:, deep * groups :]]) if deep > 1 else s
        least = np.partition(tops, tops.shape[1] - keep, axis=1)[:, tops.shape[1] - keep] if tops.shape[1] > keep else np.full(len(s), -np.inf, np.float32)
        flat = np.flatnonzero(s >= (least - rounding)[:, None])
        q, v = np.divmod(flat[s.ravel()[flat] > -np.inf], s.shape[1])
        starts = np.searchsorted(q, np.arange(len(s)))  # copies may be candidates by the thousand: a bounded number at once
        cuts = starts[1:][np.diff(starts // max(1, VALUES // x.shape[1])) > 0]
        for rows, found in zip(np.split(q, cuts), np.split(v, cuts), strict=True):
            dots = np.add.accumulate(x[at + rows] * y[found], axis=1)[:, -1]
            similarity = np.clip(dots / np.maximum(np.sqrt(x_squares[at + rows] * y_squares[found]), 1e-300), -1, 1)
            order = np.lexsort((found, -similarity, rows))
            order = order[np.arange(len(rows)) - np.searchsorted(rows, rows) < keep]
            parts.append(pd.DataFrame({"id": own[at + rows[order]], "neighbour": ids[found[order]], "similarity": similarity[order]}))
    return pd.concat(parts, ignore_index=True)


def sides(dealt: DataFrame, vector: str) -> int:
    """Into how many blocks vectors are dealt: at most ``VALUES`` components each, but several where tasks are worth it."""
    n, size = dealt.agg(F.count("*"), F.max(F.size(vector))).first()
    return max(1, -(-n * max(1, size or 1) // VALUES), min(SIDES, n // LEAST))


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.array(vectors.tolist(), np.float64)


def nearest(queries: DataFrame, vectors: DataFrame, id: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """The k vectors of the greatest cosine with each query, itself excluded: a stated query set against all rows.

    Both sides are dealt in blocks of so many rows, or of ``VALUES`` components; a pair of blocks is a matrix product, strip by strip, that keeps k rows of
    each query, and the blocks' best meet in a window. A task holds two blocks and the similarities of one strip. Returns id, neighbour, similarity and rank.
    """
    ship(vectors.sparkSession)
    n_q, n_v = (max(1, -(-d.count() // block)) if block else sides(d, vector) for d in (queries, vectors))
    deal = lambda d, n, name: d.select(F.col(id).alias(name), F.col(vector).alias(f"{name}_v"), F.pmod(F.xxhash64(id), F.lit(n)).alias(f"{name}_b"))
    q = deal(queries, n_q, "q").withColumn("v_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_v - 1).cast("long"))))
    v = deal(vectors, n_v, "v").withColumn("q_b", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_q - 1).cast("long"))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        return best_of(a["q"].to_numpy(), _matrix(a["q_v"]), b["v"].to_numpy(), _matrix(b["v_v"]), k)

    return _ranked(q.groupBy("q_b", "v_b").cogroup(v.groupBy("q_b", "v_b")).applyInPandas(best, FOUND), k)


def mutual(vectors: DataFrame, id: str, vector: str, k: int, block: int | None = None) -> DataFrame:
    """``nearest`` where every row is a query. Two blocks meet once for both directions, so that a row is sent as often as
    there are blocks, and a task holds two blocks and one strip whatever the number of rows."""
    ship(vectors.sparkSession)
    n = max(1, -(-vectors.count() // block)) if block else sides(vectors, vector)
    dealt = vectors.select(F.col(id).alias("v"), F.col(vector).alias("x"), F.pmod(F.xxhash64(id), F.lit(n)).alias("own"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
    met = met.select("v", "x", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).alias("second"))

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x, second = rows["v"].to_numpy(), _matrix(rows["x"]), rows["second"].to_numpy()
        if rows["a"].iat[0] == rows["b"].iat[0]:
            return best_of(ids, x, ids, x, k)
        if second.all() or not second.any():  # the other block has no row
            return pd.DataFrame({"id": [], "neighbour": [], "similarity": []})
        one, two = (ids[~second], x[~second]), (ids[second], x[second])
        return pd.concat([best_of(*one, *two, k), best_of(*two, *one, k)], ignore_index=True)

    return _ranked(met.groupBy("a", "b").applyInPandas(best, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def identical(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """Each distinct vector with the least id that has it and how many do."""
    return vectors.groupBy(vector).agg(F.min(id).alias("first_id"), F.count("*").alias("copies")).select("first_id", "copies")


def density_clusters(points: DataFrame, id: str, x: str, y: str, grid: int = 256, least: int = 4) -> DataFrame:
    """Clusters of a density raster: cells with ``least`` points or more, connected by their sides.

    This stands in for a contour method that isn't published with the figures; labels are the least cell of
    each component. The raster has grid * grid cells at most, so its components are found in one task.
    """
    box = points.agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    rows = points.crossJoin(F.broadcast(box))  # one row
    cell = lambda c, lo, hi: F.least(F.lit(grid - 1), F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6)) * grid)).cast("long")
    rows = rows.select(id, (cell(y, "y0", "y1") * grid + cell(x, "x0", "x1")).alias("cell"))
    dense = rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") >= least)

    def connect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cells = sorted(int(c) for b in batches for c in b["cell"])
        label = {c: c for c in cells}

        def root(c: int) -> int:
            while label[c] != c:
                label[c] = label[label[c]]
                c = label[c]
            return c

        for c in cells:
            for d in ([c + 1] if (c + 1) % grid else []) + [c + grid]:
                if d in label:
                    a, b = sorted((root(c), root(d)))
                    label[b] = a
        yield pd.DataFrame({"cell": cells, "cluster": [root(c) for c in cells]})

    labels = dense.select("cell").coalesce(1).mapInPandas(connect, "cell long, cluster long")
    return rows.join(labels, "cell", "left").select(id, "cell", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


def label_positions(points: DataFrame, cluster: str, x: str, y: str) -> DataFrame:
    """Per cluster, where its label stands: the upper medians of its points' coordinates, and how many points it has."""
    upper = lambda c: F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {c} DESC)")
    return points.groupBy(cluster).agg(upper(x).alias("label_x"), upper(y).alias("label_y"), F.count("*").alias("priority"))


def align(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds the longest common subsequence of two arrays of actions: its length, the similarity 2m / (a + b), and
    how many divergent stretches of three or more steps its alignment has."""

    ship(pairs.sparkSession)

    @F.pandas_udf("struct<common: long, similarity: double, divergent: long>")
    def lcs(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_lcs(list(x), list(y)) for x, y in zip(a, b, strict=True)], columns=["common", "similarity", "divergent"])

    return pairs.withColumn("__lcs", lcs(left, right)).select(*pairs.columns, "__lcs.common", "__lcs.similarity", "__lcs.divergent")


def _lcs(a: list, b: list) -> tuple[int, float, int]:
    n, m = len(a), len(b)
    best = np.zeros((n + 1, m + 1), np.int32)
    for i in range(n - 1, -1, -1):
        for j in range(m - 1, -1, -1):
            best[i, j] = best[i + 1, j + 1] + 1 if a[i] == b[j] else max(best[i + 1, j], best[i, j + 1])
    common, stretches, run, i, j = int(best[0, 0]), 0, 0, 0, 0
    while i < n or j < m:
        if i < n and j < m and a[i] == b[j]:
            stretches, run, i, j = stretches + (run >= 3), 0, i + 1, j + 1
        elif j == m or (i < n and best[i + 1, j] >= best[i, j + 1]):
            run, i = run + 1, i + 1
        else:
            run, j = run + 1, j + 1
    return common, (2 * common / (n + m) if n + m else 1.0), stretches + (run >= 3)
