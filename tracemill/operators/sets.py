"""Set invariants: edges, manifests against files, indexes against sources, partitions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(df: DataFrame, src_type: str, src: Column, rel: str, dst_type: str, dst: Column) -> DataFrame:
    return df.select(F.lit(src_type).alias("src_type"), src.cast("string").alias("src_id"), F.lit(rel).alias("rel"), F.lit(dst_type).alias("dst_type"), dst.cast("string").alias("dst_id"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def verify_manifest(found: DataFrame, listed: DataFrame) -> DataFrame:
    """found, listed: path, digest, size. Paths that are missing, unlisted or changed."""
    f = found.select("path", F.struct("digest", "size").alias("found"))
    both = f.join(listed.select("path", F.struct("digest", "size").alias("listed")), "path", "full")
    status = F.when(F.col("found").isNull(), "missing").when(F.col("listed").isNull(), "unlisted").when(F.col("found") != F.col("listed"), "changed")
    return both.select("path", status.alias("status")).where("status IS NOT NULL")


def validate_index(rebuilt: DataFrame, stored: DataFrame) -> DataFrame:
    """rebuilt, stored: manifest_path, digest. Entries that are unindexed, missing, duplicate or stale."""
    per = stored.groupBy("manifest_path").agg(F.count("*").alias("n"), F.min("digest").alias("stored"))
    both = rebuilt.select("manifest_path", F.col("digest").alias("rebuilt")).join(per, "manifest_path", "full")
    issue = F.when(F.col("n").isNull(), "unindexed").when(F.col("rebuilt").isNull(), "missing").when(F.col("n") > 1, "duplicate").when(F.col("stored") != F.col("rebuilt"), "digest-mismatch")
    return both.select("manifest_path", issue.alias("issue")).where("issue IS NOT NULL")


def partition_breaches(captured: DataFrame, mapped: DataFrame, unmapped: DataFrame, key: str) -> DataFrame:
    """Captured keys that are both mapped and unmapped, or neither; mapped or unmapped keys that weren't captured."""
    parts = [d.select(key, *(F.lit(k == j).alias(n) for j, n in enumerate(("c", "m", "u")))) for k, d in enumerate((captured, mapped, unmapped))]
    per = union_all(parts).groupBy(key).agg(*(F.bool_or(n).alias(n) for n in ("c", "m", "u")))
    breach = F.when(~F.col("c"), "not-captured").when(F.col("m") & F.col("u"), "mapped-and-unmapped").when(~F.col("m") & ~F.col("u"), "neither")
    return per.select(key, breach.alias("breach")).where("breach IS NOT NULL")


def same_set(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that only one side has, with the side; empty if both are the same set."""
    return left.exceptAll(right).withColumn("only_in", F.lit("left")).unionByName(right.exceptAll(left).withColumn("only_in", F.lit("right")))


def distinct_references(references: Column) -> Column:
    return F.array_distinct(references)
