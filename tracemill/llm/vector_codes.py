"""Product codes for vectors, the nearest codebook entry being found by a VA-file's filter.

Components become integers, floor(256 * x); a vector is cut into equal consecutive parts, and each part position
has a codebook. The entries of a codebook are kept as an approximation beside their coordinates: in each dimension
the span of the entries is cut into 16 cells (four bits a coordinate), and a cell knows the least and the largest
coordinate in it. For a query, a lookup table gives each cell's least and largest squared distance in a dimension;
sums over the dimensions bound an entry's distance from below and above. Only entries whose lower bound doesn't
exceed the least upper bound are refined, with exact integer distances, ties to the lower index.

Codebooks are fitted in rounds over all rows: a task sums its rows for each entry, Spark adds the tasks' sums up,
and the driver gets one row for each entry, which depends on no row count. No table is written but the codes; every
pass reads the input, so a lost executor repeats its own tasks only.

Defined results: a row whose vector is null, or holds a null or a component that isn't finite, is dropped; vectors
have one length, the one most rows have (the longer of equally frequent ones), rows of another length are dropped,
and a length that the parts don't divide is an error. Integers are held within 2^24 on either side, beyond which no
squared error would fit. Rows with the same id are coded one by one, and the codebook starts from the first rows in
the order of id (null last), then vector. Fewer rows than entries give a smaller codebook; an empty table gives no
rows; further columns of any name are left out. A sum of errors that no long can hold is null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import map_in_arrow, table, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a coordinate's cell.
BITS = 4
#: Integers beyond this are held at it.
BOUND = 1 << 24
#: Vectors whose tables stand in memory together.
ROWS = 2048
#: Rows of label sums up to which they are broadcast.
SMALL = 100_000


class Cells:
    """A codebook's entries (entries x dimensions) with their cells."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries
        low, high = entries.min(0), entries.max(0)
        self.cell = (entries - low) * (1 << bits) // (high - low + 1)
        shape = (entries.shape[1], 1 << bits)
        self.least, self.most = np.full(shape, np.iinfo(np.int64).max // 4), np.full(shape, np.iinfo(np.int64).min // 4)
        for j in range(entries.shape[1]):
            np.minimum.at(self.least[j], self.cell[:, j], entries[:, j])
            np.maximum.at(self.most[j], self.cell[:, j], entries[:, j])
            empty = self.least[j] > self.most[j]  # no entry looks there
            self.least[j][empty] = self.most[j][empty] = 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the index of its nearest entry, the lowest of equal ones, and the squared distance."""
        lower = np.zeros((len(self.entries), len(x)), np.int64)
        upper = np.zeros_like(lower)
        for j in range(x.shape[1]):
            from_least, to_most = self.least[j][:, None] - x[:, j], x[:, j] - self.most[j][:, None]
            lower += (np.maximum(np.maximum(from_least, to_most), 0) ** 2)[self.cell[:, j]]
            upper += (np.maximum(np.abs(from_least), np.abs(to_most)) ** 2)[self.cell[:, j]]
        row, entry = np.nonzero((lower <= upper.min(0)).T)
        distance = ((x[row] - self.entries[entry]) ** 2).sum(1)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        least = np.minimum.reduceat(distance, starts)
        at = np.flatnonzero(distance == least[row])
        at = at[np.r_[True, row[at][1:] != row[at][:-1]]]  # entries ascend within a row
        return entry[at], least


def integers(x: Column) -> Column:
    """Of one component, in Spark."""
    whole = F.floor(x.cast("double") * SCALE)
    return F.greatest(F.least(whole, F.lit(BOUND)), F.lit(-BOUND)).cast("long")


def proper(vector: str) -> Column:
    """Whether the vector and all its components are there and finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.col(vector).isNotNull() & finite


def length(df: DataFrame, vector: str) -> int:
    """The length that most rows' proper vectors have."""
    sizes = df.where(proper(vector)).groupBy(F.size(vector).alias("n")).agg(F.count("*").alias("rows"))
    top = sizes.orderBy(F.desc("rows"), F.desc("n")).first()
    return top["n"] if top else 0


def _blocks(batches: Iterator[pa.RecordBatch], dims: int, rows: int = ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Blocks of rows with proper vectors of that length, and their integers."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            b = batch.slice(k, rows)
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dims)  # nulls are nan
            good = np.isfinite(x).all(1)
            if good.any():
                ints = np.clip(np.floor(x[good] * SCALE), -BOUND, BOUND).astype(np.int64)
                yield b.filter(pa.array(good)), ints


def sums(rows: DataFrame, codebooks: np.ndarray) -> list:
    """part, entry, n and the sums of every coordinate, over all rows; rows: the vectors alone."""
    parts, _, width = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        count, total = np.zeros(codebooks.shape[:2], np.int64), np.zeros(codebooks.shape, np.int64)
        for _, x in _blocks(batches, parts * width):
            for p in range(parts):
                own = x[:, p * width : (p + 1) * width]
                entry, _ = cells[p].nearest(own)
                count[p] += np.bincount(entry, minlength=count.shape[1])
                for j in range(width):
                    total[p, :, j] += np.bincount(entry, weights=own[:, j], minlength=count.shape[1]).astype(np.int64)
        part, entry = np.nonzero(count)
        if len(part):
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].ravel()))
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(count[part, entry]), flat], names=["part", "entry", "n", "total"])

    partial = map_in_arrow(rows, run, "part int, entry int, n long, total array<long>")
    added = F.array(*(F.sum(F.col("total")[j]) for j in range(width)))
    return partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), added.alias("total")).collect()  # one row for each entry


def fit(df: DataFrame, vector: str, order: str, dims: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """The codebooks: part x entry x position."""
    if dims % parts:
        raise ValueError(f"vectors of {dims} components can't be cut into {parts} equal parts")
    usable = df.where(proper(vector) & (F.size(vector) == dims))
    first = usable.select(F.col(order).alias("id"), F.transform(vector, integers).alias("x")).orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).collect()
    codebooks = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, dims // parts).transpose(1, 0, 2).copy()
    rows = df.where(F.size(vector) == dims).select(F.col(vector).alias("x"))
    for _ in range(rounds):
        for r in sums(rows, codebooks):
            codebooks[r["part"], r["entry"]] = [t // r["n"] for t in r["total"]]
    return codebooks


def codes(df: DataFrame, vector: str, keep: list[str], codebooks: np.ndarray) -> DataFrame:
    """The kept columns, code (two hex digits for each part) and error (squared distances summed) of every proper row."""
    parts, _, width = codebooks.shape
    rows = df.where(F.size(vector) == parts * width).select(F.col(vector).alias("__x"), *keep)
    shape = rows.drop("__x").schema.add("code", "string").add("error", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(c) for c in codebooks]
        for b, x in _blocks(batches, parts * width):
            code, error = np.empty((len(x), parts), np.uint8), np.zeros(len(x), np.int64)
            for p in range(parts):
                entry, distance = cells[p].nearest(x[:, p * width : (p + 1) * width])
                code[:, p] = entry
                error += distance
            text = code.tobytes().hex()
            text = [text[k : k + 2 * parts] for k in range(0, len(text), 2 * parts)]
            yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(text), pa.array(error)], names=[*b.schema.names[1:], "code", "error"])

    return map_in_arrow(rows, run, shape)


def digest(codebooks: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compressed(df: DataFrame, vector: str = "embedding", id: str = "vec_id", label: str = "label") -> DataFrame:
    """vec_id, label, code, error, label_error and the codebooks' digest of every row with a proper vector."""
    df = df.select(vector, id, label)
    dims = length(df, vector)
    kind = dict(df.dtypes)
    if not dims:
        return df.sparkSession.createDataFrame([], f"vec_id {kind[id]}, label {kind[label]}, code string, error long, label_error long, codebooks_sha256 string")
    codebooks = fit(df, vector, id, dims)
    coded = written(codes(df, vector, [id, label], codebooks).toDF("vec_id", "label", "code", "error"), "codes")
    total = written(coded.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error")), "label-errors")
    if total.count() <= SMALL:
        total = F.broadcast(total)
    joined = coded.join(total, F.col("label").eqNullSafe(F.col("of")))  # a label's sum is one row: a hot one is split by adaptive execution
    return joined.select("vec_id", "label", "code", "error", "label_error", F.lit(digest(codebooks)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compressed(table(spark, sf_dir, "embeddings")).drop("label")


def _round(k: int) -> str:
    """One assignment and update in SQL: a{k} from the entries e{k}, then e{k + 1}."""
    return f"""
a{k} AS (
  SELECT rid, label, p.part, any_value(p.x) AS x, arg_min(e.entry, (d, e.entry)) AS entry, min(d) AS d
  FROM parts p JOIN e{k} e USING (part),
       LATERAL (SELECT list_sum(list_transform(list_zip(p.x, e.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d)
  GROUP BY rid, label, p.part
),
s{k} AS (
  SELECT part, entry, pos, CAST(floor(sum(v) / count(*)) AS BIGINT) AS v
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM a{k}) GROUP BY part, entry, pos
),
e{k + 1} AS (
  SELECT e.part, e.entry, coalesce(n.x, e.x) AS x FROM e{k} e
  LEFT JOIN (SELECT part, entry, list(v ORDER BY pos) AS x FROM s{k} GROUP BY part, entry) n ON n.part = e.part AND n.entry = e.entry
)"""


ORACLE_SQL = f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS q,
         row_number() OVER (ORDER BY vec_id NULLS LAST, embedding) AS rid
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
parts AS (
  SELECT rid, label, k AS part, list_slice(q, k * (len(q) // {PARTS}) + 1, (k + 1) * (len(q) // {PARTS})) AS x
  FROM kept, range({PARTS}) r(k)
),
e0 AS (SELECT part, rid - 1 AS entry, x FROM parts WHERE rid <= {ENTRIES}),
{_round(0)},
{_round(1)},
{_round(2)},
books AS (
  SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY part, entry, pos)) AS codebooks_sha256
  FROM (SELECT part, entry, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS pos FROM e2)
),
coded AS (
  SELECT rid, label, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM a2 GROUP BY rid, label
)
SELECT k.vec_id, c.code, c.error, CAST(sum(c.error) OVER (PARTITION BY c.label) AS BIGINT) AS label_error, b.codebooks_sha256
FROM coded c JOIN kept k USING (rid), books b
"""
