"""Quality by ordinal cumulative-link regression over hashed text.

A document's features are the rates of its hashed words and word shapes, and four
rates of its form. One weight vector, shared by all grades, gives a document a
place on a line; ordered thresholds cut the line into grades:
P(grade <= k) = logistic(threshold_k - weight . x). The model yields the expected
grade and the tail probabilities that selection uses.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orrery.llm.common import least_hashed, materialise, table, whole_text
from orrery.llm.tokens import Memo
from orrery.llm.toxicity import _chunks, _slices, held_out

BUCKETS = 1 << 16
FORM = 4
SIZE = BUCKETS + FORM
#: The bounds of the labelled sample that the weights are fitted on: documents, and bytes of their features.
TRAIN_ROWS, TRAIN_BYTES = 4096, 64 << 20
STEPS, RATE, PENALTY = 200, 0.3, 1e-5
_SHAPE = ((re.compile(r"[^\W\d_]+"), "a"), (re.compile(r"\d+"), "0"))


def chunk_features(chunk: str) -> tuple[int, int, int]:
    """Buckets of a chunk's word and of its shape, and its length."""
    shape = chunk
    for pattern, mark in _SHAPE:
        shape = pattern.sub(mark, shape)
    word = zlib.crc32(chunk.lower().encode()) % BUCKETS
    return word, zlib.crc32(b"shape " + shape[:16].encode()) % BUCKETS, len(chunk)


def _form(codes: np.ndarray, lengths: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Rates of form per text: repeated neighbours, distinct chunks, mean chunk length, log length."""
    first = np.cumsum(per_text) - per_text
    same = np.zeros(len(codes))
    same[1:] = codes[1:] == codes[:-1]
    same[first] = 0
    owner = np.repeat(np.arange(len(per_text)), per_text)
    distinct = np.bincount(np.unique(owner * (int(codes.max(initial=0)) + 1) + codes) // (int(codes.max(initial=0)) + 1), minlength=len(per_text))
    mean = np.add.reduceat(lengths[codes].astype(float), first) / per_text
    return np.stack([np.add.reduceat(same, first) / per_text, distinct / per_text, np.minimum(mean, 40) / 10, np.log1p(per_text) / 10], 1)


def _known(chunks: list[str], known: Memo[tuple[int, int, int]]) -> np.ndarray:
    return np.array(known.all(chunks, lambda new: [chunk_features(x) for x in new]), np.int64).reshape(-1, 3)


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, place: np.ndarray) -> np.ndarray:
        """P(grade >= k) for every grade but the lowest, one column each."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - place[:, None], -40, 40)))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], grades: list[int]) -> OrdinalModel:
    """Fit weights and thresholds by Adam on the mean negative log-likelihood.

    rows: feature places and values of each document. The levels are the grades
    that occur; with one level alone there are no thresholds.
    """
    levels = sorted(set(grades))
    y = np.searchsorted(levels, grades)
    cuts = len(levels) - 1
    if cuts < 1:
        return OrdinalModel(np.zeros(SIZE), np.zeros(0), levels or [0])
    size = np.array([len(k) for k, _ in rows])
    column, value = np.concatenate([k for k, _ in rows]), np.concatenate([v for _, v in rows])
    row, n = np.repeat(np.arange(len(rows)), size), len(rows)
    share = np.clip(np.cumsum(np.bincount(y, minlength=cuts + 1))[:-1] / n, 1e-3, 1 - 1e-3)
    start = np.log(share / (1 - share))
    # thresholds are a first one and the logs of the gaps, so they stay ordered
    free = np.concatenate([np.zeros(SIZE), start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, STEPS + 1):
        gaps = np.exp(np.clip(free[SIZE + 1 :], -8, 5))
        cut = free[SIZE] + np.concatenate([[0], np.cumsum(gaps)])
        place = np.bincount(row, value * free[column], minlength=n)
        below = 1 / (1 + np.exp(-np.clip(cut[None, :] - place[:, None], -40, 40)))
        edge = np.concatenate([np.zeros((n, 1)), below, np.ones((n, 1))], 1)
        chance = np.maximum(edge[np.arange(n), y + 1] - edge[np.arange(n), y], 1e-9)
        slope = edge * (1 - edge)
        upper, lower = slope[np.arange(n), y + 1] / chance, slope[np.arange(n), y] / chance
        by_place = (upper - lower) / n  # of the negative log-likelihood
        by_cut = np.zeros(cuts)
        np.add.at(by_cut, np.minimum(y, cuts - 1), np.where(y < cuts, -upper, 0) / n)
        np.add.at(by_cut, np.maximum(y - 1, 0), np.where(y > 0, lower, 0) / n)
        grad = np.concatenate([np.bincount(column, value * by_place[row], minlength=SIZE) + PENALTY * free[:SIZE], [by_cut.sum()], np.cumsum(by_cut[::-1])[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        free = free - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8) * (1 - step / (STEPS + 1))
    gaps = np.exp(np.clip(free[SIZE + 1 :], -8, 5))
    return OrdinalModel(free[:SIZE], free[SIZE] + np.concatenate([[0], np.cumsum(gaps)]), levels)


def sample_features(labelled: DataFrame) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[int]]:
    """Features and grades of at most TRAIN_ROWS labelled documents, least hash first.

    Tasks work out the features; of these no more reach the driver than TRAIN_BYTES hold, and
    at least one document's.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Memo[tuple[int, int, int]] = Memo()
        for batch in batches:
            for part in _slices(batch, 0):
                codes, chunks, per_text = _chunks(part.column(0))
                facts = _known(chunks, known)
                form, at, places, values = _form(codes, facts[:, 2], per_text), 0, [], []
                for r, n in enumerate(per_text.tolist()):
                    own = facts[codes[at : at + n], :2].ravel()
                    at += n
                    k, c = np.unique(own, return_counts=True)
                    places.append(np.concatenate([k, BUCKETS + np.arange(FORM)]).astype(np.int32))
                    values.append(np.concatenate([c / n, form[r]]))
                yield pa.RecordBatch.from_arrays([pa.array(places, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float64())), part.column(1), part.column(2)], names=["places", "values", "grade", "h"])

    chosen = least_hashed(labelled, "doc_id", TRAIN_ROWS).select("text", "grade", F.xxhash64("doc_id", "text").alias("h"))
    coded = materialise(chosen.mapInArrow(run, "places array<int>, values array<double>, grade int, h long"), "graded-features")
    size, last = 0, None
    for row in coded.select("h", (F.size("places") * 12).alias("bytes")).orderBy("h").collect():
        size += row["bytes"]
        if size > TRAIN_BYTES and last is not None:
            break
        last = row["h"]
    if last is None:
        return [], []
    found = coded.where(F.col("h") <= last).toArrow()
    rows = [(np.array(a.as_py()), np.array(b.as_py())) for a, b in zip(found["places"], found["values"], strict=True)]
    return rows, found["grade"].to_pylist()


def score(docs: DataFrame, model: OrdinalModel) -> DataFrame:
    """``doc_id, expected_grade, tails``: tails[i] is P(grade >= the model's level i + 1)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    known: Memo[tuple[int, int, int]] = Memo()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in _slices(batch, 1):
                codes, chunks, per_text = _chunks(part.column(1))
                facts = _known(chunks, known)
                own = model.weights[facts[:, :2]].sum(1)
                first = np.cumsum(per_text) - per_text
                place = np.add.reduceat(own[codes], first) / per_text + _form(codes, facts[:, 2], per_text) @ model.weights[BUCKETS:]
                tails = model.tails(place)
                expected = model.grades[0] + tails @ np.diff(model.grades).astype(float)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(expected), pa.array(list(tails), pa.list_(pa.float64()))], names=["doc_id", "expected_grade", "tails"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", whole_text().alias("text")).mapInArrow(run, f"doc_id {kind}, expected_grade double, tails array<double>")


def rate_documents(docs: DataFrame, ratings: DataFrame) -> DataFrame:
    """Fit on ``ratings`` (``doc_id, grade``) and score every row of ``docs``.

    Held-out rows and null grades are not learnt from; of several grades of a
    document the least counts. Null texts are empty. Without ratings, every
    expected grade is 0 and there are no tails. Repeated rows are scored once each;
    an empty table gives an empty table; columns but doc_id and text are not read.
    """
    least = ratings.where("grade is not null").groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    labelled = docs.select("doc_id", whole_text().alias("text")).where(~held_out()).join(least, "doc_id")
    return score(docs, fit(*sample_features(labelled)))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades: 0 low quality; 1 of quality, but toxic; 2 of quality and not toxic."""
    labels = table(spark, sf_dir, "labels").where("quality is not null")
    grade = F.when(F.col("quality") == 0, 0).when(F.coalesce("toxic", F.lit(0)) == 1, 1).otherwise(2)
    rated = rate_documents(table(spark, sf_dir, "documents"), labels.select("doc_id", grade.alias("grade")))
    tail = lambda k: F.coalesce(F.get("tails", F.lit(k)), F.lit(1.0))
    return rated.select("doc_id", held_out().alias("held_out"), "expected_grade", tail(0).alias("p_grade_1_up"), tail(1).alias("p_grade_2_up"), (tail(0) >= 0.5).alias("selected"))
