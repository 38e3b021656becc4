"""Neighbour graphs and density maps at a size where all pairs are out of reach.

The graph: each of several random projection trees deals the vectors to leaves of about ``leaf``; within a leaf the
cosines of all pairs are one matrix product that keeps the best k of each vector, and the trees' finds meet in a window.
Rounds of descent follow: a vector is compared with its neighbours' neighbours, in both directions, since a neighbour of
a neighbour is likely one. Exact neighbours of at most ``PROBES`` vectors tell how many were found; the last round runs
only if it brings theirs to ``REACHED``. Where that isn't reached, trees with larger leaves are added if as many as the
misses ask for send fewer rows than blocks of all pairs do; if not, or if they don't suffice, all pairs are compared by
blocks. Vectors without structure come to that: their neighbours share leaves only in so many trees that each is compared
with all others, more than once. A tree's upper splits are fitted on a sample of ``SAMPLE`` vectors, lower ones are random
directions; every vector is dealt and compared. Leaves that hold more than four times their size are split by further
directions. Equal vectors are one class, so that no leaf is filled by copies; members have their class's neighbours.

The map: points on a raster, smoothed by box blurs. A box is a sum over a row's window and then over a column's, so a blur
is two windows over the raster; cells above a threshold that touch by their sides are one cluster.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracemill.operators.vectors import FOUND, mutual, nearest, sides
from tracemill.sources.scratch import written
from tracemill.sources.shipping import ship

SAMPLE, LEAF, TREES, DESCENTS = 20_000, 256, 6, 1
#: The share of the exact neighbours that a graph must have of so many of its vectors, before it is given.
REACHED, PROBES = 0.93, 256


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


class Tree:
    """A projection tree: at each node a direction and where it is cut. Below the sample's reach, nodes of a level
    share a random direction, cut at zero."""

    def __init__(self, sample: np.ndarray, depth: int, seed: int):
        rnd = np.random.default_rng(seed)
        self.levels: list[dict[int, tuple[np.ndarray, float]]] = []
        self.spare = rnd.standard_normal((depth + 32, sample.shape[1]))
        node = np.zeros(len(sample), np.int64)
        for _ in range(depth):
            here = {}
            for n in np.unique(node):
                rows = sample[node == n]
                if len(rows) >= 8:
                    a, b = rows[rnd.choice(len(rows), 2, replace=False)]
                    along = a - b
                    here[int(n)] = (along, float(np.median(rows @ along)))
            self.levels.append(here)
            node = self._down(sample, node, here, len(self.levels) - 1)

    def _down(self, x: np.ndarray, node: np.ndarray, here: dict, level: int) -> np.ndarray:
        right = x @ self.spare[level] > 0
        for n in np.unique(node):
            if (split := here.get(int(n))) is not None:
                at = node == n
                right[at] = x[at] @ split[0] > split[1]
        return node * 2 + right

    def leaves(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for level, here in enumerate(self.levels):
            node = self._down(x, node, here, level)
        return node

    def further(self, x: np.ndarray, bits: int) -> np.ndarray:
        """More bits of a leaf, by directions that no level uses."""
        depth = len(self.levels)
        return ((x @ self.spare[depth : depth + bits].T > 0) * (1 << np.arange(bits))).sum(1)


def _best(ids: np.ndarray, similarity: np.ndarray, others: np.ndarray, k: int) -> pd.DataFrame:
    """The best k of each row of a matrix of similarities, ties by id; what is minus infinity isn't there."""
    take = np.argpartition(-similarity, min(k, similarity.shape[1] - 1), axis=1)[:, : k + 1] if similarity.shape[1] > k + 1 else np.broadcast_to(np.arange(similarity.shape[1]), similarity.shape)
    rows = np.repeat(np.arange(len(ids)), take.shape[1])
    out = pd.DataFrame({"id": ids[rows], "neighbour": others[take.ravel()], "similarity": similarity[rows, take.ravel()]})
    return out[np.isfinite(out["similarity"])]


def _top(found: DataFrame, k: int) -> DataFrame:
    """The best k of each id among finds that may repeat."""
    one = found.groupBy("id", "neighbour").agg(F.max("similarity").alias("similarity"))
    return one.withColumn("rank", F.row_number().over(W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour"))).where(F.col("rank") <= k)


def _forest(points: DataFrame, n: int, k: int, leaf: int, trees: int, seed: int) -> DataFrame:
    """points: id, v (unit vectors). Finds of all trees, id to neighbour and back."""
    size = math.ceil(SAMPLE * 1.2) / max(n, 1)
    sample = points.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1_000_003)) < min(1.0, size) * 1_000_003).limit(SAMPLE).select("v").collect()  # at most SAMPLE vectors
    sample = np.array([r["v"] for r in sample], np.float64)
    depth = max(0, math.ceil(math.log2(max(1, n / leaf))))
    forest = [Tree(sample, depth, seed + t) for t in range(trees)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.array(b["v"].to_pylist(), np.float64)
            for t, tree in enumerate(forest):
                if len(x):
                    yield pa.RecordBatch.from_arrays([b["id"], pa.array(np.full(len(x), t, np.int32)), pa.array(tree.leaves(x))], names=["id", "tree", "leaf"])

    dealt = written(points.mapInArrow(deal, "id long, tree int, leaf long"), "forest")  # without the vectors, which are as many times larger
    full = dealt.groupBy("tree", "leaf").agg(F.count("*").alias("rows")).where(F.col("rows") > 4 * leaf).select("tree", "leaf", F.ceil(F.log2(F.col("rows") / leaf)).cast("int").alias("bits"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, bits, of = np.array(b["v"].to_pylist(), np.float64), b["bits"].to_numpy(), b["tree"].to_numpy()
            part = np.zeros(len(x), np.int64)
            for t, m in {(t, m) for t, m in zip(of.tolist(), bits.tolist(), strict=True) if m}:
                at = (of == t) & (bits == m)
                part[at] = forest[t].further(x[at], min(m, 31))
            yield pa.RecordBatch.from_arrays([b["id"], b["v"], b["tree"], b["leaf"], pa.array(part)], names=["id", "v", "tree", "leaf", "part"])

    fuller = dealt.join(full, ["tree", "leaf"], "left").join(points, "id").select("id", "v", "tree", "leaf", F.coalesce("bits", F.lit(0)).alias("bits"))
    shape = "id long, v array<double>, tree int, leaf long, part long"

    def pairs(rows: pd.DataFrame) -> pd.DataFrame:
        ids, x = rows["id"].to_numpy(), np.array(rows["v"].tolist(), np.float64)
        out = []
        for at in range(0, len(x), 2048):  # a leaf of more is a matrix at a time
            s = x[at : at + 2048] @ x.T
            s[np.arange(len(s)), np.arange(at, at + len(s))] = -np.inf
            out.append(_best(ids[at : at + 2048], s, ids, k))
        return pd.concat(out)

    return fuller.mapInArrow(split, shape).groupBy("tree", "leaf", "part").applyInPandas(pairs, FOUND)


def _descend(points: DataFrame, graph: DataFrame, k: int, n: int, only: DataFrame | None = None) -> DataFrame:
    """A vector's neighbours and those that have it as one, compared with each other; finds at least as near as the
    farthest that each has. ``only``: ids that all this is done for.

    A vector is sent once to each that it is next to, and compared there, rather than with every pair; what is not near
    enough isn't sent on.
    """
    edges = graph.select(F.col("id").alias("mid"), F.col("neighbour").alias("id"))
    # those that have a vector as a neighbour may be many: a third of all, if it is a hub; the nearest k stand for them
    back = graph.withColumn("r", F.row_number().over(W.partitionBy("neighbour").orderBy(F.desc("similarity"), "id"))).where(F.col("r") <= k)
    both = edges.unionByName(back.select(F.col("neighbour").alias("mid"), "id")).distinct()
    if only is not None:
        both = both.join(both.join(F.broadcast(only), "id", "left_semi").select("mid").distinct(), "mid", "left_semi")  # PROBES ids at most
    least = graph.groupBy("id").agg(F.when(F.count("*") >= k, F.min("similarity")).otherwise(float("-inf")).alias("least"))
    batch = F.pmod(F.xxhash64("mid"), F.lit(max(1, n // 128))).alias("batch")
    met = both.join(least, "id", "left").join(points, "id").select(batch, "mid", "id", F.coalesce("least", F.lit(float("-inf"))).alias("least"), "v")

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("mid")
        mid, ids, least, x = rows["mid"].to_numpy(), rows["id"].to_numpy(), rows["least"].to_numpy(), np.array(rows["v"].tolist(), np.float64)
        parts = [pd.DataFrame({"id": ids[:0], "neighbour": ids[:0], "similarity": least[:0]})]
        ends = [*(np.flatnonzero(np.diff(mid)) + 1).tolist(), len(mid)]
        for a, b in zip([0, *ends[:-1]], ends, strict=True):
            s = x[a:b] @ x[a:b].T
            np.fill_diagonal(s, np.nan)
            one, two = np.nonzero(s >= least[a:b, None])
            parts.append(pd.DataFrame({"id": ids[a + one], "neighbour": ids[a + two], "similarity": s[one, two]}))
        return pd.concat(parts)

    return met.groupBy("batch").applyInPandas(compare, FOUND)


def knn_graph(vectors: DataFrame, id: str, vector: str, k: int, leaf: int = LEAF, trees: int = TREES, descents: int = DESCENTS, seed: int = 42) -> DataFrame:
    """id, neighbour, similarity and rank: of every vector the k nearest that were found, by cosine, ties by id.

    Rows without a vector, or with one of length zero or a component that isn't finite, have no neighbours. Of equal
    vectors the least id stands for all; the others have it first, then its neighbours.
    """
    ship(vectors.sparkSession)
    good = F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).where(good)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("n", norm).where("n > 0").select("id", F.transform("v", lambda x: x / F.col("n")).alias("v"))
    classes = rows.groupBy("v").agg(F.min("id").alias("first"))
    points = written(classes.select(F.col("first").alias("id"), "v"), "classes")
    n = points.count()
    if not n:
        return vectors.sparkSession.createDataFrame([], FOUND + ", rank int")
    probes = points.where(F.pmod(F.xxhash64("id", F.lit(seed - 1)), F.lit(1_000_003)) < min(1.0, 1.2 * PROBES / n) * 1_000_003).limit(PROBES)
    exact = written(nearest(probes, points, "id", "v", k), "probes")
    probed = exact.select("id").distinct()

    def share(found: DataFrame) -> float:
        there = recall(found.join(F.broadcast(probed), "id", "left_semi"), exact, 1e-6).first()["recall"]  # PROBES ids at most
        return 1.0 if there is None else there

    def with_more(further: DataFrame) -> DataFrame:
        return _top(graph.drop("rank").unionByName(further), k)

    graph = written(_top(_forest(points, n, k, leaf, trees, seed), k), "graph")
    for left in range(descents, 0, -1):
        if left == 1 and share(with_more(_descend(points, graph, k, n, probed))) < REACHED:
            break
        graph = written(with_more(_descend(points, graph, k, n)), "graph")
    there = share(graph)
    if 0 < there < REACHED:
        wanted = math.ceil(trees * math.log(1 - REACHED) / math.log(1 - there))
        if wanted < sides(points, "v"):
            graph = written(with_more(_forest(points, n, k, 4 * leaf, wanted, seed + trees)), "graph")
            there = share(graph)
    if there < REACHED:
        graph = written(mutual(points, "id", "v", k), "graph")
    members = rows.join(classes, "v").select("id", "first")
    copies = members.where("id <> first")
    own = graph.select("id", "neighbour", "similarity")
    theirs = copies.join(own.withColumnRenamed("id", "first"), "first").select("id", "neighbour", "similarity")
    whole = own.unionByName(theirs).unionByName(copies.select("id", F.col("first").alias("neighbour"), F.lit(1.0).alias("similarity")))
    return _top(whole, k)


def recall(found: DataFrame, exact: DataFrame, slack: float = 1e-9) -> DataFrame:
    """queries and recall: how many of the exact neighbours were found; one as near as the last exact one counts."""
    last = exact.groupBy("id").agg(F.min("similarity").alias("least"), F.count("*").alias("n"))
    hits = last.join(found, "id", "left").groupBy("id", "n").agg(F.count_if(F.col("similarity") >= F.col("least") - slack).alias("hits"))
    return hits.agg(F.count("*").alias("queries"), (F.sum(F.least("hits", "n")) / F.sum("n")).alias("recall"))


def density_map(points: DataFrame, family: str, x: str, y: str, grid: int = 256, radius: int = 3, passes: int = 2) -> DataFrame:
    """family, px, py and density of every cell of each family's raster: its points, smoothed by box blurs that shrink at the edges."""
    box = points.groupBy(family).agg(F.min(x).alias("x0"), F.max(x).alias("x1"), F.min(y).alias("y0"), F.max(y).alias("y1"))
    cells = pixels(points, box, family, x, y, grid).groupBy(family, "px", "py").agg(F.count("*").alias("n"))
    line = F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))
    raster = box.select(family, F.explode(line).alias("py")).withColumn("px", F.explode(line)).join(cells, [family, "px", "py"], "left").select(family, "px", "py", F.coalesce("n", F.lit(0)).cast("double").alias("density"))
    inside = lambda at: F.least(at, F.lit(radius)) + F.least(F.lit(grid - 1) - at, F.lit(radius)) + 1
    for _ in range(passes):
        for along, across in (("px", "py"), ("py", "px")):
            w = W.partitionBy(family, across).orderBy(along).rowsBetween(-radius, radius)
            raster = raster.select(family, "px", "py", (F.sum("density").over(w) / inside(F.col(along))).alias("density"))
    return raster


def pixels(points: DataFrame, box: DataFrame, family: str, x: str, y: str, grid: int) -> DataFrame:
    at = lambda c, lo, hi: F.least(F.lit(grid - 1), F.floor((F.col(c) - F.col(lo)) / F.greatest(F.col(hi) - F.col(lo), F.lit(1e-6)) * grid)).cast("long")
    return points.join(box, family).select(*points.columns, at(x, "x0", "x1").alias("px"), at(y, "y0", "y1").alias("py"))


def clusters(density: DataFrame, family: str, threshold: float) -> DataFrame:
    """family, px, py and cluster of the cells at the threshold or above; a cluster is named by its first cell in row order.

    A family's raster has a fixed number of cells, so its components are found in one task; families are dealt out.
    """
    ship(density.sparkSession)

    def connect(rows: pd.DataFrame) -> pd.DataFrame:
        cells = sorted(zip(rows["py"].tolist(), rows["px"].tolist(), strict=True))
        root = {c: c for c in cells}

        def top(c: tuple) -> tuple:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        for py, px in cells:
            for d in ((py - 1, px), (py, px - 1)):
                if d in root:
                    a, b = sorted((top((py, px)), top(d)))
                    root[b] = a
        tops = [top(c) for c in cells]
        return pd.DataFrame({family: rows[family].iloc[0], "px": [c[1] for c in cells], "py": [c[0] for c in cells], "top_x": [t[1] for t in tops], "top_y": [t[0] for t in tops]})

    kind = dict(density.dtypes)[family]
    return density.where(F.round("density", 9) >= threshold).groupBy(family).applyInPandas(connect, f"`{family}` {kind}, px long, py long, top_x long, top_y long")
