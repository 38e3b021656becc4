"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A source's target over its size is a number of copies r: every document gets floor(r) whole copies for
certain, and a sample of the source's documents one more. A document of size z is included with the odds
of p = f * b / B, f being the fraction of r, b the bits of z and B their mean over the source's words:
longer documents are somewhat likelier than short ones, and the expected words are the target. Documents
are ranked by Q = odds(U) / odds(p), U being uniform and a function of the seed and the doc_id, and taken
from the least Q on until their words reach what is left of the target; the last one is taken if that
ends nearer to it.

The rank at which a source's sample ends is found without sorting it: two rounds of histograms over Q,
1024 bins for each source, close in on the bin in which the words run out; only that bin's documents,
about a millionth of the source, are ordered. A source that holds a third of all rows is thus a few
partial aggregates.

Targets: sources by code point, null last, weigh 3, 1, 2, repeating; a share that exceeds the cap of
CAP times the source's size is cut there and the excess shared anew by weight, until none exceeds it.
That end is computed at once: in ascending order of cap over weight, the first so many sources are cut.

Defined results: a null text has size 0; documents of size 0 take part and count nothing; a null source
is a source; a null doc_id has a U of its own; repeated rows have the same U, and ties in Q are broken
by doc_id, then size, rows that agree in all being taken in any order; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracemill.llm.common import WORD, located, table, text_or_empty, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2
SEED = 17
BINS = 1024
#: The nearest that an inclusion probability comes to 0 or 1.
EDGE = 1e-9


def sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.regexp_count(text_or_empty(), F.lit(WORD)).cast("long").alias("size"))


def targets(sized: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """source, source_size, bit_words (the sum of size times its bits) and target, for each source."""
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum(F.col("size") * _bits(F.col("size"))).alias("bit_words"))
    # over sources only, not documents
    ranked = s.withColumn("__k", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("__k") % len(weights)).cast("int") + 1)
    ranked = ranked.withColumn("__w", w).withColumn("__cap", F.col("source_size") * F.lit(float(cap)))
    order = Window.orderBy(F.col("__cap") / F.col("__w"), "__k")
    every = Window.partitionBy()
    ranked = ranked.select(
        "*",
        (F.sum("source_size").over(every) * F.lit(share)).alias("__total"),
        F.coalesce(F.sum("__cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("__cut"),
        F.sum("__w").over(order.rowsBetween(0, Window.unboundedFollowing)).alias("__rest"),
    )
    # the level: words for a unit of weight if exactly the sources before this one are cut
    level = (F.col("__total") - F.col("__cut")) / F.col("__rest")
    ranked = ranked.withColumn("__level", F.when(level * F.col("__w") <= F.col("__cap"), level))
    first = F.first("__level", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    target = F.least(F.col("__cap"), F.coalesce(first * F.col("__w"), F.col("__cap")))
    return ranked.select("source", "source_size", "bit_words", target.alias("target"))


def _bits(size: Column) -> Column:
    """Bits of a whole number; 1 for 0."""
    return F.length(F.bin(size)).cast("long")


def uniform(seed: int) -> Column:
    """In (0, 1), from the doc_id: the first 52 bits of a digest, and a half."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    return (F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long").cast("double") + F.lit(0.5)) / F.lit(4503599627370496.0)


def _ranked(sized: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """Rows with doc_id, source and size, and from their source's row: whole copies, what is left, and their rank q and bin."""
    s = sized.join(sources.withColumnRenamed("source", "__source"), sized["source"].eqNullSafe(F.col("__source"))).drop("__source")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    p = F.try_divide(F.col("f") * _bits(F.col("size")) * F.col("source_size"), F.col("bit_words"))
    p = F.greatest(F.lit(EDGE), F.least(F.lit(1 - EDGE), p))
    u = F.col("u")
    q = (u * (F.lit(1.0) - F.col("p"))) / (F.col("p") * (F.lit(1.0) - u))
    s = s.withColumn("whole", F.floor(ratio)).withColumn("f", ratio - F.floor(ratio)).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    s = s.withColumn("p", F.coalesce(p, F.lit(EDGE))).withColumn("u", uniform(seed))
    # q / (1 + q) orders alike and lies in [0, 1): its first and its next ten bits are the bins
    s = s.withColumn("q", q).withColumn("z", F.col("q") / (F.lit(1.0) + F.col("q")))
    fine = F.least(F.lit(BINS * BINS - 1), F.floor(F.col("z") * (BINS * BINS))).cast("long")
    return s.withColumn("bin", fine).drop("f", "p", "u", "z", "bit_words")


def _plan(sized: DataFrame, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sources with their targets and the bin that ends each one's sample; the documents' ranks; and the
    documents of those bins, with whether they are taken once more."""
    sources = written(targets(sized), "sources")
    s = written(_ranked(sized, sources, seed), "ranked")

    by_source = Window.partitionBy("source").orderBy("b")
    before = by_source.rowsBetween(Window.unboundedPreceding, -1)

    def ends(rows: DataFrame, bins: Column) -> DataFrame:
        """For each source, the bin in which the words run out, and the words in the bins before."""
        h = rows.groupBy("source", "left", bins.alias("b")).agg(F.sum("size").alias("n"))
        h = h.withColumn("past", F.coalesce(F.sum("n").over(before), F.lit(0)))
        return h.where((F.col("past") < F.col("left")) & (F.col("past") + F.col("n") >= F.col("left"))).groupBy("source").agg(F.min(F.struct("b", "past")).alias("e")).select(F.col("source").alias("s"), F.col("e.b").alias("end"), F.col("e.past").alias("past"))

    coarse = written(ends(s, F.floor(F.col("bin") / BINS)), "coarse-ends")
    inside = s.join(coarse, s["source"].eqNullSafe(coarse["s"])).where(F.floor(F.col("bin") / BINS) == F.col("end")).select("source", (F.col("left") - F.col("past")).alias("left"), "past", "bin", "size")
    found = inside.groupBy("source", "left", "past", "bin").agg(F.sum("size").alias("n")).withColumnRenamed("bin", "b")
    found = found.withColumn("more", F.coalesce(F.sum("n").over(before), F.lit(0)))
    found = found.where((F.col("more") < F.col("left")) & (F.col("more") + F.col("n") >= F.col("left")))
    end = found.groupBy("source").agg(F.min(F.struct("b", (F.col("past") + F.col("more")).alias("past"))).alias("e")).select(F.col("source").alias("s"), F.col("e.b").alias("end"), F.col("e.past").alias("past"))
    sources = written(sources.join(end, sources["source"].eqNullSafe(end["s"]), "left").drop("s"), "ends")

    marks = sources.where("end IS NOT NULL").select(F.col("source").alias("s"), "end", "past")
    edge = s.join(marks, s["source"].eqNullSafe(marks["s"])).where((F.col("left") > 0) & (F.col("bin") == F.col("end"))).drop("s")
    order = Window.partitionBy("source").orderBy("q", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    edge = edge.withColumn("cum", F.col("past") + F.sum("size").over(order))
    return sources, s, edge.withColumn("extra", (F.col("cum") - F.col("size") / 2 <= F.col("left")).cast("int"))


def _clear() -> Column:
    """1 or 0 for a document that lies before or after its source's end bin; null for one in it.

    Without an end, either nothing is left to take (0) or the words never reach it (1).
    """
    return F.when(F.col("left") <= 0, 0).when(F.col("end").isNull() | (F.col("bin") < F.col("end")), 1).when(F.col("bin") > F.col("end"), 0)


def sample(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row."""
    sources, s, edge = _plan(written(sizes(docs), "sized"), seed)
    marks = sources.select(F.col("source").alias("s"), "end")
    clear = s.join(marks, s["source"].eqNullSafe(marks["s"])).withColumn("extra", _clear()).where("extra IS NOT NULL")
    columns = ["doc_id", "source", "size", "source_size", "target", "whole", "extra"]
    out = clear.select(*columns).unionByName(edge.select(*columns)).withColumn("copies", F.col("whole") + F.col("extra"))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def _some_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """groups: k and n. As many places (file, row) of each group's rows as its n says, in the order of the places.

    A group may hold any number of rows: they are numbered within their files, and the files' counts, of which there
    are few, are added up.
    """
    own = written(rows.join(groups, "k").select("k", "n", "file", "row"), "end-bin-rows")
    counts = own.groupBy("k", "file").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(Window.partitionBy("k").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("k", "file", before.alias("before"))
    numbered = own.withColumn("at", F.row_number().over(Window.partitionBy("k", "file").orderBy("row")))
    return numbered.join(counts, ["k", "file"]).where(F.col("before") + F.col("at") <= F.col("n")).select("file", "row")


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: every document as often as the mix takes it.

    A document's copies follow from its own rank and its source's row, so texts don't move: they meet a row
    for each source and, for the end bins, about a millionth of the documents. Rows that agree in id, source and
    size lie together in a source's order; where its sample ends among them, the first of them by place are taken.

    Rows without an id, and repeated ones, are taken row by row, as many as the sample has; a null text has no words
    and is never taken; a null source is one of its own, the last; an empty table gives no rows; columns may have any name.
    """
    columns = docs.columns
    located_docs = located(docs).select("doc", "file", "row", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.source").cast("string").alias("source"), F.regexp_count(text_or_empty("doc.text"), F.lit(WORD)).cast("long").alias("size"))
    sources, _, edge = _plan(written(located_docs.select("doc_id", "source", "size"), "sized"), SEED)
    key = lambda df: F.struct(df["doc_id"], df["source"], df["size"])
    ends = edge.groupBy("doc_id", "source", "size").agg(F.sum("extra").alias("n"), F.count("*").alias("rows"))
    ends = written(ends.select(F.struct("doc_id", "source", "size").alias("k"), "n", "rows"), "end-bins")
    ranked = _ranked(located_docs, sources, SEED).withColumn("extra", _clear())
    found = ranked.join(ends, (key(ranked) == ends["k"]) & ranked["extra"].isNull(), "left")
    extra = F.coalesce("extra", F.when(F.col("n") == F.col("rows"), 1).when(F.col("n") == 0, 0))
    split = ends.where("n > 0 AND n < rows").select("k", "n")
    if not split.isEmpty():  # at most one group of a source
        places = written(_some_of(located_docs.select(key(located_docs).alias("k"), "file", "row"), split), "end-rows").select(F.col("file").alias("__file"), F.col("row").alias("__row"))
        found = found.join(places, (F.col("file") == F.col("__file")) & (F.col("row") == F.col("__row")) & extra.isNull(), "left")
        extra = F.coalesce(extra, F.col("__row").isNotNull().cast("int"))
    copies = (F.col("whole") + F.coalesce(extra, F.lit(0))).cast("int")
    taken = found.select("doc", copies.alias("copies")).where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    return taken.select(*(F.col("doc")[c].alias(c) for c in columns))


ORACLE_SQL = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents
), b AS (
  SELECT *, length(bin(size)) AS bits FROM d
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(sum(size * bits) AS DOUBLE) AS bit_words FROM b GROUP BY source
), w AS (
  SELECT *, CAST({list(WEIGHTS)}[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)}] AS DOUBLE) AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS k, source_size * CAST({CAP} AS DOUBLE) AS cap FROM s
), r AS (
  SELECT *, (sum(source_size) OVER ()) * CAST({SHARE} AS DOUBLE) AS total,
         coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cut,
         sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w
), l AS (
  SELECT arg_min((total - cut) / rest, cap / w) AS level FROM r WHERE (total - cut) / rest * w <= cap
), t AS (
  SELECT source, source_size, bit_words, least(cap, coalesce((SELECT level FROM l) * w, cap)) AS target FROM r
), f AS (
  SELECT b.*, t.source_size, t.target, t.bit_words, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS ratio
  FROM b JOIN t ON b.source IS NOT DISTINCT FROM t.source
), p AS (
  SELECT *, floor(ratio) AS whole, target - floor(ratio) * source_size AS rest,
         greatest({EDGE}, least(CAST(1 AS DOUBLE) - {EDGE}, coalesce((ratio - floor(ratio)) * bits * source_size / bit_words, {EDGE}))) AS p,
         (CAST(CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM f
), q AS (
  SELECT *, (u * (1 - p)) / (p * (1 - u)) AS q FROM p
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q, doc_id, size ROWS UNBOUNDED PRECEDING) AS cum FROM q
)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN rest > 0 AND cum - size / 2 <= rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""


def op6_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")
