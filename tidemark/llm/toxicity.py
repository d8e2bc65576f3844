"""Toxicity as an ordinal severity, by cumulative-link regression over sparse words.

P(severity > k) = sigmoid(w . x - theta_k) with one weight vector for all ordered thresholds; the
result is the expected severity, the sum of those probabilities. Features are the logarithms of the
counts of selected words and of word beginnings of whole letters: those whose presence goes clearly
with toxicity.

Labels with a column ``grade`` (0, 1, 2) are taken as they are. Those that only say toxic or not are
graded by a rule: 0 not toxic, and among toxic texts 2 where the selected words that speak for toxicity
occur at least as often as in the median one, else 1.

The model is fitted on a bounded, hash-chosen sample of labelled rows; scoring reads every text
whole, once, without a shuffle.

Edge cases: a null or empty text has no features and gets the severity that the thresholds give
alone; without labelled rows of both kinds every severity is 0; of equal texts one is learned from;
an empty table gives an empty result; other columns stay, those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import codes, mix, small_batches, text_chunks, words

MAX_LABELLED = 20_000
MAX_FEATURES = 4096
PREFIXES = (4, 5)


@dataclass
class SeverityModel:
    """Sorted word codes, their weights and the ordered thresholds."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray

    def chances(self, linear: np.ndarray) -> np.ndarray:
        """P(severity > k) for each text (rows) and threshold (columns)."""
        return 1 / (1 + np.exp(-np.clip(linear[:, None] - self.thresholds, -60, 60)))


def word_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of every word and of its beginnings of PREFIXES letters, and the text of each."""
    data, starts, ends, code, first = words(texts, punctuation=True)
    text_of = np.repeat(np.arange(len(texts)), np.diff(first))
    found, of = [code], [text_of]
    letters = np.flatnonzero((data & 0xC0) != 0x80)  # where a character begins
    at = np.searchsorted(letters, starts)
    for size in PREFIXES:
        cut = letters[np.minimum(at + size, len(letters) - 1)] if len(letters) else starts
        long = np.flatnonzero((at + size < len(letters)) & (cut < ends))
        found.append(mix(codes(data, starts[long], cut[long]) + np.array([size], dtype=np.uint64)))
        of.append(text_of[long])
    return np.concatenate(found), np.concatenate(of)


def feature_counts(texts: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, count) of the selected words in a chunk of texts."""
    code, text_of = word_features(texts)
    at = np.minimum(np.searchsorted(features, code), max(len(features) - 1, 0))
    hit = features[at] == code if len(features) else np.zeros(len(code), dtype=bool)
    pair, count = np.unique(text_of[hit] * max(len(features), 1) + at[hit], return_counts=True)
    return pair // max(len(features), 1), pair % max(len(features), 1), count


def fit_cumulative(row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray, n_features: int, n_grades: int, prior: float = 0.3, steps: int = 800, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood of ``grade``, by Adam on the full sample.

    Threshold k is the first one plus a sum of k positive gaps, so the order holds throughout.
    """
    n = len(grade)
    ridge = prior / n  # a prior of fixed width on each weight: words of few texts stay weak however large the sample
    share = [(np.sum(grade > k) + 1) / (n + 2) for k in range(n_grades - 1)]
    theta = np.maximum.accumulate(np.array([-np.log(s / (1 - s)) for s in share]) + np.arange(n_grades - 1) * 1e-3)
    free = np.concatenate([np.zeros(n_features), theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for step in range(1, steps + 1):
        w, gaps = free[:n_features], np.exp(free[n_features + 1 :])
        theta = free[n_features] + np.concatenate([[0], np.cumsum(gaps)])
        linear = np.bincount(row, value * w[column], minlength=n)
        above = np.hstack([np.ones((n, 1)), sigmoid(linear[:, None] - theta), np.zeros((n, 1))])
        slope = above * (1 - above)
        at = np.arange(n)
        p = np.maximum(above[at, grade] - above[at, grade + 1], 1e-12)
        upper, lower = slope[at, grade] / p, slope[at, grade + 1] / p
        d_linear = upper - lower
        d_theta = np.zeros(n_grades - 1)
        for k in range(n_grades - 1):
            d_theta[k] = -np.sum(upper[grade == k + 1]) + np.sum(lower[grade == k])
        tail = np.cumsum(d_theta[::-1])[::-1]
        gradient = np.concatenate([np.bincount(column, value * d_linear[row], minlength=n_features) / n - ridge * w, tail[:1] / n, tail[1:] / n * gaps])
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        free = free + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:n_features], free[n_features] + np.concatenate([[0], np.cumsum(np.exp(free[n_features + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_features: int = MAX_FEATURES, min_z: float = 5.0, min_texts: int = 5) -> SeverityModel:
    """Learn from at most ``max_labelled`` labelled documents, those of the smallest hashes of their ids; of several labels of an id the highest grade counts."""
    graded = "grade" in labels.columns
    grade = F.col("grade").cast("int") if graded else (F.col("toxic") > 0).cast("int")
    known = "grade" if graded else "toxic"
    marked = labels.where(f"doc_id is not null and {known} is not null").groupBy("doc_id").agg(F.max(grade).alias("grade"))
    marked = marked.select("doc_id", "grade", (F.col("grade") > 0).alias("toxic"))
    n = marked.count()
    if n > max_labelled:
        marked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    # at most max_labelled rows of an id, a grade and a flag: small by that bound
    sample = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(marked), "doc_id")
    # copies of one text would speak for its rare words: one is learned from, at the highest grade
    sample = sample.groupBy("text").agg(F.max("grade").alias("grade")).withColumn("toxic", F.col("grade") > 0)

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch["text"]):
                code, text_of = word_features(chunk)
                toxic = np.array(batch["toxic"].slice(at, len(chunk)).to_pylist(), dtype=bool)
                order = np.lexsort((code, text_of))
                code, text_of = code[order], text_of[order]
                new = np.ones(len(code), dtype=bool)
                new[1:] = (code[1:] != code[:-1]) | (text_of[1:] != text_of[:-1])
                code, is_toxic = code[new], toxic[text_of[new]]
                distinct, inverse = np.unique(code, return_inverse=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "code": pa.array(distinct.view(np.int64)),
                        "toxic": pa.array(np.bincount(inverse, is_toxic, minlength=len(distinct)).astype(np.int64)),
                        "clean": pa.array(np.bincount(inverse, ~is_toxic, minlength=len(distinct)).astype(np.int64)),
                    }
                )

    kinds = {r["toxic"]: r["count"] for r in sample.groupBy("toxic").count().collect()}
    t, c = kinds.get(True, 0), kinds.get(False, 0)
    empty = SeverityModel(np.zeros(0, dtype=np.uint64), np.zeros(0), np.array([60.0, 60.0]))
    if not t or not c:
        return empty
    # signed root of the likelihood-ratio statistic of the word's presence against toxicity
    n, a, b = t + c, F.col("toxic"), F.col("clean")
    cells = [(a, t, a + b), (b, c, a + b), (t - a, t, n - a - b), (c - b, c, n - a - b)]
    ratio = sum(F.when(seen_in > 0, seen_in * F.log(seen_in * n / (column * row))).otherwise(0.0) for seen_in, column, row in cells)
    z = F.sqrt(F.greatest(2 * ratio, F.lit(0.0))) * F.when(a * c >= b * t, 1).otherwise(-1)
    table = sample.mapInArrow(seen, "code long, toxic long, clean long").groupBy("code").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    picked = table.where(F.col("toxic") + F.col("clean") >= min_texts).select("code", z.alias("z")).where(F.abs("z") >= min_z).orderBy(F.abs("z").desc(), "code").limit(max_features).toArrow()
    code, sign = picked["code"].to_numpy().astype(np.int64).view(np.uint64), picked["z"].to_numpy()
    if not len(code):
        return empty
    order = np.argsort(code)
    features, speaks = code[order], sign[order] > 0

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, chunk in text_chunks(batch["text"]):
                row, column, count = feature_counts(chunk, features)
                cuts = np.searchsorted(row, np.arange(len(chunk) + 1))
                yield pa.RecordBatch.from_pydict(
                    {
                        "grade": batch["grade"].slice(at, len(chunk)),
                        "features": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(column, pa.int32())),
                        "counts": pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(count, pa.int32())),
                    }
                )

    got = sample.mapInArrow(counted, "grade int, features array<int>, counts array<int>").toArrow().combine_chunks()
    features_of, counts_of = (got[k].combine_chunks() if isinstance(got[k], pa.ChunkedArray) else got[k] for k in ("features", "counts"))
    sizes = np.diff(features_of.offsets.to_numpy())
    row, column, count = np.repeat(np.arange(len(sizes)), sizes), features_of.values.to_numpy(), counts_of.values.to_numpy()
    grade = np.clip(got["grade"].to_numpy().astype(np.int64), 0, 2)
    if not graded:
        evidence = np.bincount(row, count * speaks[column], minlength=len(sizes))
        grade = np.where(grade > 0, np.where(evidence >= max(np.median(evidence[grade > 0]), 1), 2, 1), 0)
    weights, thresholds = fit_cumulative(row, column, np.log1p(count), grade, len(features), 3)
    return SeverityModel(features, weights, thresholds)


def score(docs: DataFrame, model: SeverityModel, text_col: str = "text") -> DataFrame:
    """``docs`` with ``severity`` (expected, 0 to 2), ``grade`` (the likeliest) and ``toxic`` (more likely than not above grade 0)."""
    small_batches(docs.sparkSession)
    docs = docs.drop("severity", "grade", "toxic")
    schema = T.StructType([*docs.schema.fields, T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # at most max_features words

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            linear = np.zeros(batch.num_rows)
            for at, chunk in text_chunks(batch[text_col]):
                row, column, count = feature_counts(chunk, model.features)
                if len(row):
                    linear[at : at + len(chunk)] = np.bincount(row, np.log1p(count) * model.weights[column], minlength=len(chunk))
            above = model.chances(linear)
            each = np.hstack([np.ones((len(above), 1)), above]) - np.hstack([above, np.zeros((len(above), 1))])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(above.sum(axis=1)), pa.array(each.argmax(axis=1), pa.int32()), pa.array(above[:, 0] >= 0.5)],
                names=[*batch.schema.names, "severity", "grade", "toxic"],
            )

    return docs.mapInArrow(predict, schema)
