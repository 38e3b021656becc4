"""An evidence log as a stream's sink: every record once, numbered without gaps within its log.

A batch writes three things, in this order: its records with their numbers, the heads (the last number of every log up to
and with this batch), and a commit. Numbers go on from the heads of the batch committed last before it, so they are
recovered from what is on disk, not from memory. A batch that runs again, after a failure at any point, finds the same
heads and replaces what it had written; one that is committed already is left alone. Readers see committed batches only.

Records of a batch are numbered in the order that is given; ties in it are broken by all columns. A null log is a log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.streaming import StreamingQuery


def _exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class EvidenceLog:
    """path: a shared folder. log: the column that names a record's log. order: how a batch's records are numbered."""

    def __init__(self, spark: SparkSession, path: str, log: str, order: list[str]):
        self.spark, self.path, self.log, self.order = spark, path.rstrip("/"), log, order

    def committed(self) -> list[int]:
        """Numbers of the committed batches, in order."""
        spark, root = self.spark, f"{self.path}/commits"
        if not _exists(spark, root):
            return []
        where = spark._jvm.org.apache.hadoop.fs.Path(root)
        names = [s.getPath().getName() for s in where.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(where)]
        done = (int(n.removeprefix("batch=")) for n in names if n.startswith("batch="))
        return sorted(n for n in done if _exists(spark, f"{root}/batch={n}/_SUCCESS"))

    def heads(self, before: int | None = None) -> DataFrame | None:
        """log and head, the last number of every log, after the last committed batch, or after that before one."""
        done = [n for n in self.committed() if before is None or n < before]
        return self.spark.read.parquet(f"{self.path}/heads/batch={done[-1]}") if done else None

    def append(self, rows: DataFrame, batch: int, fail: Callable[[str], None] = lambda stage: None) -> None:
        """Numbers a batch's records and commits them; ``fail`` is called between the steps."""
        if batch in self.committed():
            return
        ties = [c for c, t in rows.dtypes if c not in self.order and not t.startswith("map")]
        w = W.partitionBy(self.log).orderBy(*self.order, *ties)
        numbered = rows.withColumn("sequence", F.row_number().over(w).cast("long") - 1)
        heads = self.heads(batch)
        if heads is not None:
            known = heads.withColumnRenamed(self.log, "__log")
            numbered = numbered.join(known, F.col(self.log).eqNullSafe(F.col("__log")), "left").withColumn("sequence", F.col("sequence") + F.coalesce(F.col("head") + 1, F.lit(0))).drop("__log", "head")
        numbered.write.mode("overwrite").parquet(f"{self.path}/records/batch={batch}")
        fail("records")
        new = self.spark.read.schema(numbered.schema).parquet(f"{self.path}/records/batch={batch}").groupBy(self.log).agg(F.max("sequence").alias("head"))
        new = new if heads is None else new.unionByName(heads).groupBy(self.log).agg(F.max("head").alias("head"))
        new.write.mode("overwrite").parquet(f"{self.path}/heads/batch={batch}")
        fail("heads")
        self.spark.range(1).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/batch={batch}")

    def read(self) -> DataFrame | None:
        """The records of the committed batches."""
        paths = [f"{self.path}/records/batch={n}" for n in self.committed()]
        return self.spark.read.parquet(*paths) if paths else None

    def breaches(self) -> DataFrame:
        """Logs whose numbers have a gap or a repeat: none, if the log is sound."""
        records = self.read()
        per = records.groupBy(self.log).agg(F.count("*").alias("n"), F.count_distinct("sequence").alias("distinct"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))
        return per.where((F.col("n") != F.col("distinct")) | (F.col("first") != 0) | (F.col("last") != F.col("n") - 1))

    def sink(self, frame: DataFrame, checkpoint: str, fail: Callable[[int, str], None] = lambda batch, stage: None, **trigger) -> StreamingQuery:
        write = lambda rows, batch: self.append(rows, batch, lambda stage: fail(batch, stage))
        return frame.writeStream.option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).foreachBatch(write).start()
