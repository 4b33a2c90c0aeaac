"""Toxicity: cumulative-link ordinal regression over sparse text features.

P(grade > k) = logistic(w . x - t_k) with one weight vector w for all thresholds t_0 < t_1 < ...;
the expected severity is the sum of these probabilities over k. A feature is a word, or its first
four to seven bytes, that stands at least once, twice or four times in the text. Features are
chosen and the model is fitted on a bounded sample of labelled rows (``sample_docs``,
``features``); every document is rated, on its whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sonagrid.llm import storage
from sonagrid.llm.sampling import distinct_texts
from sonagrid.llm.textarrays import ALNUM, LOWER, Block, SpanHasher, blocks, lookup, words

PREFIXES = (4, 5, 6, 7)
LEVELS = np.array([1, 2, 4])


class Model(NamedTuple):
    grams: np.ndarray  # hashes of words and prefixes, ascending
    weights: np.ndarray  # per gram and level
    thresholds: np.ndarray  # one between each two grades, ascending


def gram_places(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text, gram) for every word and each of its prefixes."""
    data = LOWER[block.data]
    at = words(block._replace(data=data), ALNUM)
    hashed = SpanHasher(data)
    texts, grams = [at.text], [hashed(at.start, at.end)]
    for k in PREFIXES:
        long = at.end - at.start > k
        texts.append(at.text[long])
        grams.append(~hashed(at.start[long], at.start[long] + k))  # a prefix isn't the word of its bytes
    return np.concatenate(texts), np.concatenate(grams)


def counted(text: np.ndarray, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, gram, times), each pair once."""
    order = np.lexsort((gram, text))
    t, g = text[order], gram[order]
    new = np.ones(len(g), bool)
    new[1:] = (t[1:] != t[:-1]) | (g[1:] != g[:-1])
    heads = np.flatnonzero(new)
    return t[heads], g[heads], np.diff(np.append(heads, len(g)))


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(grade, text) to (gram, level, n, p): texts with the feature, and those with a grade over 0."""
    for b in batches:
        grade = b.column(0).to_numpy(zero_copy_only=False)
        for block in blocks(b.column(1)):
            t, g, times = counted(*gram_places(block))
            positive = grade[block.first + t] > 0
            for level, least in enumerate(LEVELS):
                own = times >= least
                gram, back = np.unique(g[own], return_inverse=True)
                n, p = np.bincount(back, minlength=len(gram)), np.bincount(back, positive[own], len(gram)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(np.full(len(gram), level, np.int32)), pa.array(n), pa.array(p)], names=["gram", "level", "n", "p"])


def _marks(shared):
    """(id, text) to (id, gram): number of the gram and its times, for the chosen grams only."""

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = b.column(0).to_numpy(zero_copy_only=False)
            for block in blocks(b.column(1)):
                t, g, times = hits(shared.value, block)
                yield pa.RecordBatch.from_arrays([pa.array(row[block.first + t]), pa.array(g), pa.array(times)], names=["id", "gram", "times"])

    return marks


def hits(grams: np.ndarray, block: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in ``grams``, times) for the grams of a text that are there."""
    text, gram = gram_places(block)
    at = lookup(grams, gram)
    own = at >= 0
    return counted(text[own], at[own])


def log_likelihood(theta: np.ndarray, rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, penalty: float) -> tuple[float, np.ndarray]:
    """The mean log-likelihood less penalty / 2 * |w|^2, and its gradient.

    theta: weights, then t_0, then the logarithms of the gaps between thresholds.
    """
    n, w = len(grades), theta[:n_features]
    gaps = np.exp(theta[n_features + 1 :])
    t = np.cumsum(np.concatenate([theta[n_features : n_features + 1], gaps]))
    eta = np.bincount(rows, w[columns], n) if len(rows) else np.zeros(n)
    p = 1 / (1 + np.exp(-np.clip(eta[:, None] - t, -30, 30)))  # P(grade > k)
    padded = np.column_stack([np.ones(n), p, np.zeros(n)])
    at = np.arange(n)
    own = np.maximum(padded[at, grades] - padded[at, grades + 1], 1e-12)
    slope = padded * (1 - padded)
    lower, upper = slope[at, grades] / own / n, slope[at, grades + 1] / own / n
    d_eta = lower - upper
    d_t = np.bincount(grades, upper, len(t) + 1)[:-1] - np.bincount(grades, lower, len(t) + 1)[1:]
    d_w = (np.bincount(columns, d_eta[rows], n_features) if len(rows) else 0.0) - penalty * w
    return float(np.log(own).mean() - penalty / 2 * (w @ w)), np.concatenate([d_w, [d_t.sum()], gaps * np.cumsum(d_t[::-1])[::-1][1:]])


def fit(rows: np.ndarray, columns: np.ndarray, grades: np.ndarray, n_features: int, n_grades: int, penalty: float = 5e-5, steps: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by gradient steps on the mean log-likelihood (Adam); rows and columns name the ones of x.

    Thresholds are t_0 and positive gaps, so they stay in order.
    """
    share = np.array([np.mean(grades > k) for k in range(n_grades - 1)]).clip(1e-3, 1 - 1e-3)
    start = np.maximum.accumulate(-np.log(share / (1 - share)) + 1e-3 * np.arange(n_grades - 1))
    theta = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(np.diff(start), 1e-3))])
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        _, grad = log_likelihood(theta, rows, columns, grades, n_features, penalty)
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    return theta[:n_features], np.cumsum(np.concatenate([theta[n_features : n_features + 1], np.exp(theta[n_features + 1 :])]))


def train(labelled: DataFrame, grade: Column, n_grades: int, sample_docs: int = 20_000, features: int = 8192, least_docs: int = 3, least_ratio: float = 5.0, texts: DataFrame | None = None) -> Model:
    """Fit on rows with text and a grade from 0 to n_grades - 1; rows without either are left out.

    The sample holds at most ``sample_docs`` distinct texts, see :func:`sampling.distinct_texts`. Features of at
    least ``least_docs`` of them are ranked by the likelihood ratio of grade > 0; the first
    ``features`` whose ratio is at least ``least_ratio`` are kept. If ``texts`` is given, ``labelled`` has
    text_hash instead of text (null where there is none), so that a join with labels moves no text.
    """
    spark = labelled.sparkSession
    text = "text" if texts is None else "text_hash"
    rows = labelled.filter(F.col(text).isNotNull()).select(grade.cast("int").alias("grade"), text).filter(F.col("grade").between(0, n_grades - 1))
    picked = storage.written(distinct_texts(rows, "grade", sample_docs, False, texts).withColumn("id", F.monotonically_increasing_id()), "labelled")
    grades = picked.select("id", "grade").toArrow()  # sample_docs rows at most
    ids, y = grades["id"].to_numpy(), grades["grade"].to_numpy().astype(np.int64)
    total, positive = len(y), int((y > 0).sum())
    if not positive:
        return Model(np.zeros(0, np.uint64), np.zeros((0, len(LEVELS))), np.full(n_grades - 1, 30.0))
    counts = picked.select("grade", "text").mapInArrow(_totals, "gram long, level int, n long, p long").groupBy("gram", "level").agg(F.sum("n").cast("double").alias("n"), F.sum("p").cast("double").alias("p")).filter(F.col("n") >= least_docs)

    def part(k: Column, m: Column) -> Column:
        return F.when(k > 0, k * F.log(k / m)).otherwise(0.0)

    toxic = positive / total
    ratio = 2 * (part(F.col("p"), F.col("n") * toxic) + part(F.col("n") - F.col("p"), F.col("n") * (1 - toxic)))
    ranked = counts.withColumn("ratio", F.round(ratio, 9)).filter(F.col("ratio") >= least_ratio)
    chosen = ranked.orderBy(F.desc("ratio"), "gram", "level").select("gram", "level").limit(features).toArrow()  # the model's size
    kept = np.unique(chosen["gram"].to_numpy().view(np.uint64))
    marks = picked.select("id", "text").mapInArrow(_marks(spark.sparkContext.broadcast(kept)), "id long, gram long, times long").toArrow()
    order = np.argsort(ids)
    row = order[np.searchsorted(ids[order], marks["id"].to_numpy())]
    level = len(LEVELS)
    feature = lookup(kept, chosen["gram"].to_numpy().view(np.uint64)) * level + chosen["level"].to_numpy()
    used = np.zeros(len(kept) * level, bool)
    used[feature] = True
    cells = [(row[own], marks["gram"].to_numpy()[own] * level + k) for k, least in enumerate(LEVELS) if (own := marks["times"].to_numpy() >= least).any()]
    row, column = (np.concatenate([c[i] for c in cells]) if cells else np.zeros(0, np.int64) for i in (0, 1))
    row, column = row[used[column]], column[used[column]]
    weights, thresholds = fit(row, column, y, len(used), n_grades)
    storage.delete(picked)
    return Model(kept, weights.reshape(-1, level), thresholds)


def grade_probabilities(column: pa.Array, model: Model) -> np.ndarray:
    """P(grade > k) of every text, one column for each k."""
    eta = np.zeros(len(column))
    for block in blocks(column):
        text, gram, times = hits(model.grams, block)
        texts = len(block.bounds) - 1
        for k, least in enumerate(LEVELS):
            own = times >= least
            eta[block.first : block.first + texts] += np.bincount(text[own], model.weights[gram[own], k], texts)
    return 1 / (1 + np.exp(-np.clip(eta[:, None] - model.thresholds, -30, 30)))


def rate(docs: DataFrame, model: Model, threshold: float = 0.35) -> DataFrame:
    """doc_id, severity, grade, toxic and p_toxic of every document.

    severity is the expected grade, grade the most probable one, p_toxic is P(grade > 0) and toxic
    whether that is at least ``threshold``. Null and empty texts have no words: the model's base rate.
    Without a positive label nothing is toxic. Repeated rows come out as often as they are; a null
    doc_id stays null; an empty table gives an empty result; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``features`` words

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p = grade_probabilities(b.column(1), shared.value)
            padded = np.column_stack([np.ones(len(p)), p, np.zeros(len(p))])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p.sum(axis=1)), pa.array((padded[:, :-1] - padded[:, 1:]).argmax(axis=1).astype(np.int32)), pa.array(p[:, 0] >= threshold), pa.array(p[:, 0])], names=["doc_id", "severity", "grade", "toxic", "p_toxic"])

    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("severity", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("toxic", T.BooleanType()), T.StructField("p_toxic", T.DoubleType())])
    return docs.select("doc_id", "text").mapInArrow(rows, schema)
