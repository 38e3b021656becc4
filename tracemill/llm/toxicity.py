"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = sigmoid(w . x - t_k), with one weight vector for all of the ordered thresholds t_1 < t_2.
Features are the counts of the terms (words, and beginnings of words) that the labelled sample ties to
toxic texts beyond chance, and the text's length. The severity grade of a labelled text is 0 if it is clean; of a
toxic one it is 2 if it has more toxic sentences than the median toxic text, else 1. Which sentences are toxic is
told by words that the other half of the sample ties to toxic texts, so that no text helps to choose the words that
grade it. The output is the expected severity P(grade > 0) + P(grade > 1), the likeliest grade and the flag toxic.

Fitting takes a bounded sample of the labelled documents (SAMPLE of them, by a digest of the doc_id; an even
split over grades isn't forced). Their terms are counted, ranked and looked up on the executors; the driver
gets at most FEATURES terms and, for each sampled document, its counts of these, and no text. Scoring reads
every word of every document, in one pass without a shuffle; the model that it needs is a dictionary of at
most FEATURES terms.

Defined results: a text without any of the model's terms, such as a null or empty one, has severity 0; null labels
and labels without a document aren't used for fitting; of several labels of a document the worst counts, and of
several texts with its doc_id the least; without a toxic and a clean label nothing is flagged and the severity
is 0; repeated rows are scored one by one; texts are scored whole, whatever their length; an empty table gives no
rows; further columns of any name are left out.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracemill.llm.common import map_in_arrow, strings, table, text_or_empty, written

#: Labelled rows at most that a fit takes; documented bound.
SAMPLE = 4_000
#: Words at most that carry a weight.
FEATURES = 4096
MIN_TEXTS = 5
ROUNDS = 400
LEAST_Z = 4.0
PENALTY = 1e-3
HEAD, STEM = 4, 8
#: Occurrences of a term beyond which further ones add nothing.
MOST = 6
_WORD = re.compile(r"[^\W\d_]+")
_END = re.compile(r"[.!?\n]+")
LENGTH = ""  # the term whose count is the text's number of words


def terms(words: list[str]) -> Counter:
    """Counts of a text's terms: its words, and their beginnings of HEAD to STEM - 1 letters, marked by a dash."""
    out = Counter(words)
    for w, n in list(out.items()):
        for k in range(HEAD, min(STEM, len(w))):
            out[w[:k] + "-"] += n
    out[LENGTH] = len(words)
    return out


def value(term: str, count: int) -> float:
    return math.log(1 + count) if term == LENGTH else float(min(count, MOST))


@dataclass
class Model:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, float] = (math.inf, math.inf)

    def severity(self, score: float) -> tuple[float, float]:
        """P(grade > 0) and P(grade > 1)."""
        return tuple(0.0 if t - score > 700 else 1 / (1 + math.exp(max(-700.0, t - score))) for t in self.thresholds)

    def score(self, counts: Counter) -> float:
        known = self.weights.keys() & counts.keys()
        if not known - {LENGTH}:
            return -math.inf
        return sum(self.weights[t] * value(t, counts[t]) for t in sorted(known))


def loss(w: np.ndarray, t: np.ndarray, x: np.ndarray, grade: np.ndarray) -> tuple[float, np.ndarray]:
    """The mean negative log-likelihood of the grades with its penalty on the weights, and its gradient over w and t."""
    n = len(grade)
    above = 1 / (1 + np.exp(np.clip(t[None, :] - (x @ w)[:, None], -50, 50)))  # P(grade > k)
    slope = above * (1 - above)
    mine = np.clip(np.stack([1 - above[:, 0], above[:, 0] - above[:, 1], above[:, 1]], 1)[np.arange(n), grade], 1e-12, 1)
    by_score = np.stack([-slope[:, 0], slope[:, 0] - slope[:, 1], slope[:, 1]], 1)[np.arange(n), grade] / mine
    sign = np.stack([(grade == 0) * 1.0 - (grade == 1), (grade == 1) * 1.0 - (grade == 2)], 1)
    return -np.log(mine).mean() + PENALTY / 2 * float(w @ w), np.r_[-(x.T @ by_score) / n + PENALTY * w, -(slope * sign / mine[:, None]).mean(0)]


def fit(x: np.ndarray, grade: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds, by Adam. Without a text of grade 2 the second threshold lies out of reach."""
    w, t = np.zeros(x.shape[1]), np.array([0.0, 1.0])
    m, v = np.zeros(len(w) + 2), np.zeros(len(w) + 2)
    for r in range(1, rounds + 1):
        _, g = loss(w, t, x, grade)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**r)) / (np.sqrt(v / (1 - 0.999**r)) + 1e-8)
        w, t = w - step[:-2], t - step[-2:]
        t[1] = max(t[1], t[0] + 1e-3)
    return w, t


def sample_terms(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> DataFrame:
    """toxic, half (0 or 1), counted terms, and the distinct words of each sentence, of at most ``limit`` labelled
    documents. The labels are few and go to the documents."""
    label = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    few = label.withColumn("by", F.sha2(F.col("doc_id").cast("string"), 256)).orderBy("by", "doc_id").limit(limit)
    few = few.select("doc_id", "toxic", (F.conv(F.substring("by", 16, 4), 16, 10) % 2).cast("int").alias("half"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).join(F.broadcast(few), "doc_id")  # ``limit`` rows of three numbers
    one = rows.groupBy("doc_id", "toxic", "half").agg(F.min("text").alias("text")).select("toxic", "half", "text")
    shape = pa.schema([("toxic", pa.bool_()), ("half", pa.int32()), ("terms", pa.list_(pa.string())), ("counts", pa.list_(pa.int64())), ("sentences", pa.list_(pa.list_(pa.string())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for toxic, half, text in zip(b["toxic"].to_pylist(), b["half"].to_pylist(), strings(b["text"], 16), strict=True):
                sentences = [_WORD.findall(x) for x in _END.split(text.lower())]
                counts = terms([w for ws in sentences for w in ws])
                yield pa.RecordBatch.from_pylist([{"toxic": toxic, "half": half, "terms": list(counts), "counts": list(counts.values()), "sentences": [sorted(set(ws)) for ws in sentences]}], schema=shape)

    return map_in_arrow(one, run, "toxic boolean, half int, terms array<string>, counts array<long>, sentences array<array<string>>")


def tied_terms(sample: DataFrame) -> list[str]:
    """The FEATURES terms whose log odds ratio is most above its standard error, of those beyond chance."""
    n_toxic, n_clean = sample.agg(F.expr("count_if(toxic)"), F.expr("count_if(NOT toxic)")).first()
    if not n_toxic or not n_clean:
        return []
    seen = sample.select("toxic", F.explode("terms").alias("term")).where(F.col("term") != LENGTH)
    seen = seen.groupBy("term").agg(F.expr("count_if(toxic)").alias("a"), F.expr("count_if(NOT toxic)").alias("b")).where(F.col("a") + F.col("b") >= MIN_TEXTS)
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    rest_a, rest_b = F.lit(n_toxic + 1.0) - a, F.lit(n_clean + 1.0) - b
    odds = F.log(a / rest_a) - F.log(b / rest_b)
    error = F.sqrt(1 / a + 1 / rest_a + 1 / b + 1 / rest_b)
    found = seen.select("term", odds.alias("odds"), (odds / error).alias("z")).where((F.col("z") >= LEAST_Z) & (F.col("odds") >= 1))
    return [r["term"] for r in found.orderBy(F.desc("z"), "term").limit(FEATURES).collect()]


def graded(sample: DataFrame) -> DataFrame:
    """The sample with grade."""
    words = [F.array(*(F.lit(t) for t in tied_terms(sample.where(F.col("half") == 1 - k)) if not t.endswith("-"))).cast("array<string>") for k in (0, 1)]
    bad = lambda of: F.size(F.filter("sentences", lambda s: F.arrays_overlap(s, of)))
    rows = written(sample.withColumn("bad", F.when(F.col("half") == 0, bad(words[0])).otherwise(bad(words[1]))).drop("sentences"), "toxicity-graded")
    median = rows.where("toxic").agg(F.median("bad")).first()[0] or 0.0
    return rows.withColumn("grade", F.when(~F.col("toxic"), 0).when(F.col("bad") > median, 2).otherwise(1))


def fit_sample(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE) -> Model:
    """The model of the labelled sample."""
    sample = written(sample_terms(docs, labels, limit), "toxicity-sample")
    chosen = tied_terms(sample)
    if not chosen:
        return Model()
    names = [*chosen, LENGTH]
    known = F.array(*map(F.lit, names))
    counted = F.map_from_arrays("terms", "counts")
    found = graded(sample).select("grade", F.map_filter(counted, lambda t, n: F.array_contains(known, t)).alias("counts")).collect()  # ``limit`` rows
    index, x = {w: k for k, w in enumerate(names)}, np.zeros((len(found), len(names)), np.float32)
    for i, r in enumerate(found):
        for w, n in r["counts"].items():
            x[i, index[w]] = value(w, n)
    w, t = fit(x, np.array([r["grade"] for r in found]))
    return Model({c: float(a) for c, a in zip(names, w, strict=True)}, (float(t[0]), float(t[1])))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, severity, grade and toxic of every row."""
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_or_empty("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads = {t[:HEAD] for t in model.weights}
        for b in batches:
            severity, grade, toxic = [], [], []
            for text in strings(b["text"]):
                found = _WORD.findall(text.lower())
                counts = terms([w for w in found if w[:HEAD] in heads])  # no other word has a term of the model
                counts[LENGTH] = len(found)
                one, two = model.severity(model.score(counts))
                severity.append(one + two)
                grade.append(max((1 - one, 0), (one - two, 1), (two, 2))[1])
                toxic.append(one >= 0.5)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(severity, pa.float64()), pa.array(grade, pa.int32()), pa.array(toxic)], ["doc_id", "severity", "grade", "toxic"])

    return map_in_arrow(rows, run, "doc_id long, severity double, grade int, toxic boolean")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit_sample(docs, table(spark, sf_dir, "labels")))
