"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Every rule is a row ``(name, numerator, denominator, low, high)``; a text fails a rule when
numerator / denominator leaves [low, high]. Ratios are compared by multiplication of whole numbers,
so no result depends on floating-point division. All features come from built-in expressions.

Defined results: a null text has no words and fails the base rule; an empty table gives no rows;
repeated rows are judged one by one; very long texts are judged whole (repeated windows are found
by sorting a text's windows, n log n in its length); further columns of the input, of any name, decide nothing.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import table, text_or_empty, words_of

#: Function words of the four languages the corpus is in.
STOP_WORDS = (
    "the be to of and that have with is a for it on as are by this "
    "de la le et les des du un une en que qui est dans pour sur "
    "der die das und zu den von mit sich ein eine ist nicht "
    "el los las y del se por con para una no su"
).split()
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Fails when 1000 * top < low * bottom or 1000 * top > high * bottom (thousandths; None: no bound)."""

    name: str
    top: str
    bottom: str
    low: int | None = None
    high: int | None = None

    def fails(self) -> Column:
        top, bottom = F.col(self.top) * 1000, F.col(self.bottom)
        bounds = [] if self.low is None else [top < bottom * self.low]
        bounds += [] if self.high is None else [top > bottom * self.high]
        return reduce(Column.__or__, bounds)

    def sql(self) -> str:
        bounds = [] if self.low is None else [f"1000 * {self.top} < {self.low} * {self.bottom}"]
        bounds += [] if self.high is None else [f"1000 * {self.top} > {self.high} * {self.bottom}"]
        return " OR ".join(bounds)


BASE = (
    Rule("too_short", "n_words", "one", low=50_000),
    Rule("repeated_windows", "n_repeat_words", "n_words", high=500),
)
#: The production threshold table.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2_500, high=12_000),
    Rule("symbols_per_word", "n_symbols", "n_words", high=100),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=500),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=500),
    Rule("stop_words", "n_stop_words", "n_words", low=10),
)


_ALL = 1 << 30


def _triples(w: Column, join) -> Column:
    """join(join(w[i], w[i + 1]), w[i + 2]) of every three consecutive words."""
    inner = F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0)))
    pairs = F.zip_with(inner, F.slice(F.slice(w, 2, _ALL), 1, F.size(inner)), join)
    return F.zip_with(pairs, F.slice(w, 3, _ALL), join)


def _repeated_starts(s: Column) -> Column:
    """Of windows ``(g, i)`` sorted by g: the starts i, in order, of those whose g another window shares."""
    as_next = F.zip_with(s, F.slice(s, 2, _ALL), lambda x, y: F.coalesce(x["g"] == y["g"], F.lit(False)))
    as_either = F.zip_with(as_next, F.concat(F.array(F.lit(False)), as_next), lambda x, y: F.coalesce(x, F.lit(False)) | F.coalesce(y, F.lit(False)))
    return F.sort_array(F.array_compact(F.zip_with(s, as_either, lambda x, y: F.when(y, x["i"]))))


COUNTS = ["one", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_ellipsis_lines", "n_stop_words", "n_repeat_words"]
VERDICTS = ["base_failed", "failed_rules", "kept"]


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc (the row, as one column) and the counts that the rules name.

    Repeated windows: a text whose windows have distinct 64-bit hashes has none; in others, the
    windows themselves are sorted and compared, so that no hash decides.
    """
    long = lambda c: c.cast("long")
    d = docs.select(F.struct(*docs.columns).alias("doc"), text_or_empty(text).alias("t"))
    d = d.select("doc", "t", words_of(F.col("t")).alias("words"), F.filter(F.split("t", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"))
    w = F.col("words")
    d = d.withColumn("hashes", _triples(w, lambda a, b: F.xxhash64(a, b)))
    strings = _triples(w, lambda a, b: F.concat(a, F.lit(" "), b))
    indexed = F.transform(strings, lambda g, i: F.struct(g.alias("g"), i.alias("i")))
    distinct = F.size(F.array_distinct("hashes")) == F.size("hashes")
    d = d.withColumn("sorted", F.when(~distinct, F.sort_array(indexed)))
    d = d.withColumn("starts", F.when(F.col("sorted").isNotNull(), _repeated_starts(F.col("sorted"))).otherwise(F.array().cast("array<int>")))
    p = F.col("starts")
    steps = F.zip_with(F.slice(F.concat(F.array(F.lit(-3)), p), 1, F.size(p)), p, lambda x, y: F.least(F.lit(3), y - x))
    return d.select(
        "doc",
        F.lit(1).cast("long").alias("one"),
        long(F.size("words")).alias("n_words"),
        long(F.length(F.array_join("words", ""))).alias("word_chars"),
        long(F.regexp_count("t", F.lit(SYMBOLS))).alias("n_symbols"),
        long(F.size("lines")).alias("n_lines"),
        long(F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        long(F.size(F.filter("lines", lambda x: x.endswith("...") | x.endswith("…")))).alias("n_ellipsis_lines"),
        long(F.size(F.filter("words", lambda x: F.lower(x).isin(STOP_WORDS)))).alias("n_stop_words"),
        long(F.aggregate(steps, F.lit(0), lambda a, x: a + x)).alias("n_repeat_words"),
    )


def _judged(docs: DataFrame, text: str, rules: tuple[Rule, ...]) -> DataFrame:
    f = features(docs, text)
    any_of = lambda rs: reduce(Column.__or__, (r.fails() for r in rs))
    f = f.withColumn("base_failed", any_of(BASE))
    f = f.withColumn("failed_rules", F.array_compact(F.array(*(F.when(r.fails(), F.lit(r.name)) for r in (*BASE, *rules)))))
    return f.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))


def judge(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The input's columns, the counts, base_failed, failed_rules and kept; an input's column that bears the name
    of one of these is left out for it."""
    made = {*COUNTS, *VERDICTS}
    own = [F.col("doc")[c].alias(c) for c in docs.columns if c.lower() not in made]
    return _judged(docs, text, rules).select(*own, *COUNTS, *VERDICTS)


OUT = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*OUT)


def filter_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go.

    A null, empty or blank text has no words and goes, whatever else its row holds; texts of any length are judged
    whole; repeated rows are judged one by one; no row of an empty table; further columns of any name are kept.

    The optimizer would push the verdict's filter below the projections and so write out every feature anew
    wherever a rule names it; a column that it may not move keeps the filter where it is.
    """
    judged = _judged(docs, "text", RULES).withColumn("task", F.spark_partition_id())
    return judged.where(F.col("kept") & (F.col("task") >= 0)).select("doc.*")


_WORD = r"[\x20\x09-\x0D]+"
ORACLE_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents
), s AS (
  SELECT r, doc_id, t, list_filter(string_split_regex(t, '{_WORD}'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d
), g AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM s WHERE len(w) >= 3
), h AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM g
), c AS (
  SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY r
), f AS (
  SELECT doc_id, 1 AS one, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(l) AS BIGINT) AS n_lines,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(len(list_filter(l, lambda x: ends_with(x, '...') OR ends_with(x, chr(8230)))) AS BIGINT) AS n_ellipsis_lines,
         CAST(len(list_filter(w, lambda x: list_contains({STOP_WORDS!r}, lower(x)))) AS BIGINT) AS n_stop_words,
         CAST(coalesce(c.n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM s LEFT JOIN c USING (r)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       ({" OR ".join(r.sql() for r in BASE)}) AS base_failed,
       NOT ({" OR ".join(r.sql() for r in (*BASE, *RULES))}) AS kept
FROM f
"""
