"""What the operators share: word rules, scratch folders and small Arrow helpers."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.sources.shipping import ship

#: White space between words, in Java's regular expressions; ``bytes.split()`` has the same rule.
SPACES = "[\\x20\\x09-\\x0D]+"
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, purpose: str, kept: bool = False) -> str:
    """A new folder's path under the shared ``spark.checkpoint.dir``; kept: it outlives the innermost scope.

    Where that is unset, a local folder is set, but only under a local master: on a cluster, executors would
    write to disks of their own and rows would be missing.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir is not set, and {master} has no folder that all executors share")
        if not (root := getattr(spark, "_tracemill_scratch", None)):
            root = spark._tracemill_scratch = "file://" + tempfile.mkdtemp(prefix="tracemill-")
    path = f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"
    if len(_scopes()) > kept:
        _scopes()[-1 - kept].append(path)
    return path


_OWN = threading.local()


def _scopes() -> list[list[str]]:
    """Folders made since each of the open scopes of this thread began: runs side by side have their own."""
    if not hasattr(_OWN, "scopes"):
        _OWN.scopes = []
    return _OWN.scopes


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Folders that are made inside go at the end: what is to stay must have been written outside of them by then."""
    _scopes().append([])
    try:
        yield
    finally:
        discard(spark, *_scopes().pop())


def discard(spark: SparkSession, *paths: str) -> None:
    """Deletes scratch folders, through Spark's own file systems."""
    for p in paths:
        path = spark._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, purpose: str, kept: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read again: the lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, purpose, kept)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def located(docs: DataFrame) -> DataFrame:
    """doc (the row, as one column), file and row, where each row's content is found; no two rows share a place.

    A plain scan, filtered or projected, has such places; whatever else may repeat rows is written first. The
    input's columns may have any names, these three among them.
    """
    whole = F.struct(*docs.columns).alias("doc")
    places = (F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    if _is_scan(docs) and "_metadata" not in map(str.lower, docs.columns):
        return docs.select(whole, *places)
    return written(docs.select(whole), "located").select("doc", *places)


def _is_scan(df: DataFrame) -> bool:
    plan = df._jdf.queryExecution().analyzed()
    while True:
        name = plan.nodeName()
        if name == "LogicalRelation" or name.startswith("Relation"):
            return "parquet" in plan.simpleString(10).lower()
        if name not in ("Project", "Filter", "SubqueryAlias"):
            return False
        plan = plan.children().head()


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    return F.filter(F.split(text, SPACES), lambda w: w != "")


def strings(column: pa.Array, rows: int = 256) -> Iterator[str | None]:
    """The column's values one by one; only ``rows`` of them are Python's at a time."""
    for k in range(0, len(column), rows):
        yield from column.slice(k, rows).to_pylist()


def map_in_arrow(df: DataFrame, run, schema: str) -> DataFrame:
    """``df.mapInArrow``; a worker gives Arrow's spare memory back at the end of a task, as it stays for others."""
    ship(df.sparkSession)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(task, schema)
