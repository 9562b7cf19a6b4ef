"""Toxicity by cumulative-link ordinal regression (operator 3).

Severity has three grades, from the labels: 0 for rows labelled clean, 1 for rows labelled toxic, and 2 for
those of them that are labelled of low quality too, the worst that the labels tell.  The model is
P(y <= k) = sigmoid(theta_k - w . x), with one weight vector for both ordered thresholds, over
sparse features x = log(1 + count) of hashed lower-case letter runs.  The output is the expected
severity P(y >= 1) + P(y >= 2).

The model is fitted on the driver from at most ``max_rows`` labelled documents of each class, those of
least hash of the id, over at most ``max_terms`` terms.  The sample is written to the shared folder; terms
are chosen there by a distributed count, and only counts of chosen terms come to the driver: 2 * max_rows
rows of max_terms numbers at most, however long the texts and however often a row occurs.  Scoring is one
narrow pass over whole texts.

Null and empty texts have no terms and score as the intercept alone.  Rows without an id match no label
and are scored.  Repeated rows of one document count once in the sample; several labels of one document
count each; null labels are left out, and a null quality is not low.  Terms that stand out equally go by
their number.  With no labels, or one class only, every document scores 0.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .store import keep

BITS = 20
_LETTER = np.arange(256, dtype=np.uint8)
_LETTER[[x for x in range(128) if not chr(x).isalpha()]] = 0x20


@dataclass(frozen=True)
class Model:
    terms: np.ndarray
    weights: np.ndarray
    theta: tuple[float, float]

    def severity(self, score: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """P(y >= 1) and P(y >= 2)."""
        return tuple(1 / (1 + np.exp(np.clip(t - score, -500, 500))) for t in self.theta)


def term_blocks(texts: pa.Array) -> Iterator[tuple[int, int, B.Block, np.ndarray]]:
    """Blocks of letter runs with the feature number of each run."""
    data, off = B.buffers(texts)
    for lo, hi in B.slices(off):
        b = B.Block(_LETTER[data[off[lo] : off[hi]]], off[lo : hi + 1] - off[lo], lower=True)
        yield lo, hi, b, (b.word_hash >> np.uint64(64 - BITS)).astype(np.int64)


def labelled_sample(docs: DataFrame, labels: DataFrame, max_rows: int) -> DataFrame:
    """(grade, text) of at most ``max_rows`` documents labelled toxic and as many labelled clean, kept."""
    low = F.coalesce(F.col("quality") == 0, F.lit(False)) if "quality" in labels.columns else F.lit(False)
    grade = F.when(F.col("toxic") > 0, F.when(low, 2).otherwise(1)).otherwise(0).alias("grade")
    known = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id"), grade)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce("text", F.lit("")).alias("text")).withColumn("_h", F.xxhash64("text"))

    def least(rows: DataFrame, *key: str) -> DataFrame:
        order = [F.xxhash64("_id"), *key]
        return rows.where("grade > 0").orderBy(*order).limit(max_rows).union(rows.where("grade = 0").orderBy(*order).limit(max_rows))

    picked = least(known.distinct(), "_id", "grade")
    found = texts.select("_id", "_h").join(F.broadcast(picked), "_id").distinct()
    keys = least(found.select("_id", "_h", "grade"), "_id", "_h", "grade")
    return keep(texts.join(F.broadcast(keys), ["_id", "_h"]).groupBy("_id", "_h", "grade").agg(F.any_value("text").alias("text")), "labelled")


def chosen_terms(sample: DataFrame, share: float, max_terms: int) -> np.ndarray:
    """The terms whose counts in toxic rows stand out most from ``share``, the part of such rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, toxic = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
        for batch in batches:
            grade = batch.column(0).to_numpy()
            for lo, hi, b, terms in term_blocks(batch.column(1)):
                every += np.bincount(terms, minlength=1 << BITS)
                toxic += np.bincount(terms[(grade[lo:hi] > 0)[b.doc]], minlength=1 << BITS)
        at = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(every[at]), pa.array(toxic[at])], ["term", "every", "toxic"])

    counts = sample.select("grade", "text").mapInArrow(run, "term long, every long, toxic long").groupBy("term").agg(F.sum("every").alias("every"), F.sum("toxic").alias("toxic"))
    z = (F.col("toxic") - F.col("every") * share) / F.sqrt(F.col("every") * (share * (1 - share)))
    strong = counts.withColumn("z", z).where("every >= 4 AND abs(z) > 4 AND (z < 0 OR toxic >= 3)")
    return np.sort(np.array([r.term for r in strong.orderBy(F.abs("z").desc(), "term").limit(max_terms).select("term").collect()], np.int64))


def sample_counts(sample: DataFrame, terms: np.ndarray) -> DataFrame:
    """(grade, columns, counts) of the rows of a sample: which of the terms they hold, and how often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        column = np.full(1 << BITS, -1, np.int64)
        column[terms] = np.arange(len(terms))
        for batch in batches:
            for lo, hi, b, own in term_blocks(batch.column(1)):
                c = column[own]
                key, count = np.unique(b.doc[c >= 0] * len(terms) + c[c >= 0], return_counts=True)
                at = np.searchsorted(key, np.arange(b.n + 1) * len(terms))
                col, count = (key % max(1, len(terms))).astype(np.int32), count.astype(np.int32)
                cut = lambda x: pa.array([x[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), cut(col), cut(count)], ["grade", "columns", "counts"])

    return sample.select("grade", "text").mapInArrow(run, "grade int, columns binary, counts binary")


def loss(w: np.ndarray, theta: float, gap: float, grade: np.ndarray, row: np.ndarray, col: np.ndarray, x: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Mean negative log-likelihood with the ridge, and its gradient by (w, theta, gap); the second threshold is theta + exp(gap)."""
    s = np.bincount(row, weights=w[col] * x, minlength=len(grade))
    p1, p2 = (1 / (1 + np.exp(-np.clip(t - s, -30, 30))) for t in (theta, theta + np.exp(gap)))
    d1, d2 = p1 * (1 - p1), p2 * (1 - p2)
    mid = np.maximum(p2 - p1, 1e-12)
    g1 = np.where(grade == 0, 1 - p1, np.where(grade == 1, -d1 / mid, 0))  # d log-likelihood / d first threshold, and second
    g2 = np.where(grade == 1, d2 / mid, np.where(grade == 2, -p2, 0))
    n = len(grade)
    value = -np.log(np.where(grade == 0, p1, np.where(grade == 1, mid, 1 - p2))).sum() / n + ridge * (w @ w) / 2
    return value, np.concatenate([np.bincount(col, weights=(g1 + g2)[row] * x, minlength=len(w)) / n + ridge * w, [-(g1 + g2).sum() / n, -(g2 * np.exp(gap)).sum() / n]])


NONE = Model(np.zeros(0, np.int64), np.zeros(0, np.float32), (1e3, 1e3))


def fit(terms: np.ndarray, rows: list, steps: int = 400, ridge: float = 1e-3) -> Model:
    """Fits from (grade, columns, counts) rows over the chosen terms."""
    grade = np.array([r.grade for r in rows], np.int64)
    if not len(terms) or not grade.any() or grade.all():
        return NONE
    columns = [np.frombuffer(r.columns, np.int32) for r in rows]
    row, col = np.repeat(np.arange(len(rows)), [len(c) for c in columns]), np.concatenate(columns)
    x = np.log1p(np.concatenate([np.frombuffer(r.counts, np.int32) for r in rows]))
    w, theta, gap = np.zeros(len(terms)), 1.0, 0.0
    m, v = np.zeros(len(terms) + 2), np.zeros(len(terms) + 2)
    for step in range(1, steps + 1):
        _, grad = loss(w, theta, gap, grade, row, col, x, ridge)
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-9)
        w, theta, gap = w - move[:-2], theta - move[-2], gap - move[-1]
    return Model(terms, w.astype(np.float32), (float(theta), float(theta + np.exp(gap))))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = 4000, max_terms: int = 2000) -> Model:
    """The model of a bounded sample of labelled documents."""
    sample = labelled_sample(docs, labels, max_rows)
    n = sample.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("grade") > 0).alias("toxic")).first()
    if not n.toxic or n.toxic == n.n:
        return NONE
    terms = chosen_terms(sample, n.toxic / n.n, max_terms)
    return fit(terms, sample_counts(sample, terms).collect()) if len(terms) else NONE


SCHEMA = "doc_id long, toxic boolean, severity int, expected_severity double, p_toxic double, n_terms long"


def score(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """Expected severity of every document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << BITS, np.float32)
        table[model.terms] = model.weights
        for batch in batches:
            for lo, hi, b, terms in term_blocks(batch.column(1)):
                hit = np.flatnonzero(table[terms])
                key, count = np.unique((b.doc[hit] << BITS) | terms[hit], return_counts=True)
                s = np.bincount(key >> BITS, weights=table[key & ((1 << BITS) - 1)] * np.log1p(count), minlength=b.n)
                p1, p2 = model.severity(s)
                grade = (p1 >= threshold).astype(np.int32) + (p2 >= threshold)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(p1 >= threshold), pa.array(grade.astype(np.int32)), pa.array(p1 + p2), pa.array(p1), pa.array(np.bincount(key >> BITS, minlength=b.n).astype(np.int64))], [x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
