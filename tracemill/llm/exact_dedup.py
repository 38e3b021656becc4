"""Exact deduplication as a stateful stream whose keyed state never expires.

The input's journal (digest, doc_id and content locator of every row, no text) is written once and
streamed. The stream's state lives in RocksDB on the executors' disks, with its checkpoint in the shared
folder, and holds for each digest the stable identifier (the largest doc_id), the locator of its
content and the number of rows. It is a keyed aggregate: each task sends a row for a digest, however
many copies it has seen, so a text that a third of all rows share is no hot key.

Full bytes are checked on hits: the texts whose digest the state has met more than once are read again
and grouped by digest and text. A bitmap of the repeated digests, of a fixed size that is proven by its
parameter, keeps all other texts out of that shuffle; a wrong bit only lets a text be checked in vain.
Texts that share a digest without being equal are then grouped by their bytes.

Defined results: a null text is empty; a null doc_id is less than any other; of rows that agree in text
and doc_id the one with the last locator stays; an empty table gives no rows; texts are compared whole.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import located, scratch, table, text_or_empty, written

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Bits of the bitmap of repeated digests: 8 MB at most, in rows of 4 kB.
BITMAP_BITS = 1 << 26
_ROW_BITS = 32768


def digest(text: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text), 256))


def stream_state(spark: SparkSession, journal: str, files_per_batch: int | None = None) -> DataFrame:
    """Streams the journal through the keyed state. Returns digest, keep (doc_id, file, row) and n: the state at the end.

    The stream runs in a session of its own, so that its settings hold for no other query.
    """
    out = scratch(spark, "dedup-state")
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    own.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    # a store's log files take the space they need, not what RocksDB reserves for large ones
    own.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    rows = own.readStream.schema(own.read.parquet(journal).schema)
    rows = (rows if files_per_batch is None else rows.option("maxFilesPerTrigger", files_per_batch)).parquet(journal)
    state = rows.groupBy("digest").agg(F.max(F.struct("doc_id", "file", "row")).alias("keep"), F.count("*").alias("n"))
    # a batch that runs again replaces what it wrote
    write = lambda df, batch: df.write.mode("overwrite").parquet(f"{out}/batch={batch}")
    query = state.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", scratch(spark, "dedup-stream")).trigger(availableNow=True).start()
    query.awaitTermination()
    shape = "digest binary, keep struct<doc_id: long, file: string, row: long>, n long"
    try:
        seen = spark.read.schema(shape).parquet(out)
    except AnalysisException:  # no batch, as there was no row
        return spark.createDataFrame([], shape)
    return seen.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("last")).select("digest", "last.keep", "last.n")  # n grows from batch to batch


def _collisions(docs: DataFrame, repeated: DataFrame) -> DataFrame:
    """The full-bytes check: digests that texts with different bytes share."""
    slot = F.pmod(F.xxhash64("digest"), F.lit(BITMAP_BITS))
    maps = repeated.select(slot.alias("s")).groupBy(F.floor(F.col("s") / _ROW_BITS).alias("part")).agg(F.bitmap_construct_agg(F.col("s") % _ROW_BITS).alias("bits"))
    rows = docs.select(digest().alias("digest"), text_or_empty().alias("text")).withColumn("s", slot)
    rows = rows.withColumn("part", F.floor(F.col("s") / _ROW_BITS)).join(F.broadcast(maps), "part")
    place = F.col("s") % _ROW_BITS
    byte = F.conv(F.hex(F.substring(F.col("bits"), (place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hits = rows.where(F.getbit(byte, (place % 8).cast("int")) == 1)
    return hits.groupBy("digest", "text").agg(F.count("*").alias("n")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def exact_duplicates(docs: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256, file and row of every row."""
    return _classes(located(docs), files_per_batch)


def _classes(places: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    spark = places.sparkSession
    docs = places.select(F.col("doc.text").alias("text"), F.col("doc.doc_id").cast("long").alias("doc_id"), "file", "row")
    path = scratch(spark, "dedup-journal")
    docs.select(digest().alias("digest"), "doc_id", "file", "row").write.parquet(path)
    journal = spark.read.parquet(path)
    state = written(stream_state(spark, path, files_per_batch), "dedup-classes")
    collided = written(_collisions(docs, state.where("n > 1").select("digest")), "dedup-collisions")
    own = F.struct("doc_id", "file", "row")
    found = journal.join(state, "digest").select("digest", "doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.eqNullSafe(F.col("keep")).alias("kept"))
    if not collided.isEmpty():
        rows = docs.select(digest().alias("digest"), text_or_empty().alias("text"), "doc_id", "file", "row").join(collided, "digest", "left_semi")
        by_text = written(rows.groupBy("digest", "text").agg(F.max(own).alias("keep"), F.count("*").alias("n")), "dedup-by-text")
        apart = rows.join(by_text, ["digest", "text"]).select("digest", "doc_id", "file", "row", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), own.eqNullSafe(F.col("keep")).alias("kept"))
        found = found.join(collided, "digest", "left_anti").unionByName(apart)
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one row of each group of equal texts stays, that of the largest doc_id.

    Null texts are empty ones, and so copies of each other; a null doc_id is less than any other; of rows that
    agree in both (repeated rows among them) the one with the last place in the files stays; texts of any length
    are compared whole; no row of an empty table; further columns of any name are kept.
    """
    rows = located(docs)
    gone = written(_classes(rows).where("NOT kept").select("file", "row"), "dedup-gone")
    return rows.join(gone, ["file", "row"], "left_anti").select("doc.*")


ORACLE_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
